"""Supervised models and their metrics on Spark ML."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.storage import saved
from ..schema import ColumnType, Metadata, label, number, plain_label
from . import kernels as K
from .neighbors import auc, workers_can_import

TREES, BOOSTS = 100, 20
#: Classes beyond which a target is no target for a classifier; places of a rank that are told apart.
MOST_CLASSES, RANKS = 1000, 100_000
#: Rows with a weight that a model is trained on in place of rows alike; tables of fewer rows are taken as they are.
COMPACT = 20_000
#: Rows from which, and encoded features up to which, all labels of a pair are fitted in the same passes; permutations of a batch; passes at most.
MANY, NARROW, BATCH, PASSES = 1000, 64, 20, 100


def vectors(pair: DataFrame, meta: Metadata) -> tuple[DataFrame, int]:
    """-> _row, y (1: synthetic), features; and their width. Numbers standardised over the pair (null is 0 first), labels one-hot."""
    num, cat = meta.numeric, meta.categorical
    if not num and not cat:
        from ..registry import Skip

        raise Skip("no numeric or categorical column to encode")
    rows = pair.select("_row", (F.col("_side") == "s").cast("double").alias("y"), *[F.coalesce(number(c), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(num)], *[label(c).alias(f"g{i}") for i, c in enumerate(cat)])
    if num:
        s = rows.agg(*[f(f"f{i}").alias(f"{n}{i}") for i in range(len(num)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        rows = rows.withColumns({f"f{i}": (F.col(f"f{i}") - F.lit(s[f"m{i}"])) / F.lit(s[f"s{i}"]) if s[f"s{i}"] else F.lit(0.0) for i in range(len(num))})
    stages, inputs = [], [f"f{i}" for i in range(len(num))]
    if cat:
        stages += [StringIndexer(inputCols=[f"g{i}" for i in range(len(cat))], outputCols=[f"i{i}" for i in range(len(cat))]), OneHotEncoder(inputCols=[f"i{i}" for i in range(len(cat))], outputCols=[f"h{i}" for i in range(len(cat))], dropLast=False)]
        inputs += [f"h{i}" for i in range(len(cat))]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    out = saved(Pipeline(stages=stages).fit(rows).transform(rows).select("_row", "y", "features"), "vectors")
    first = out.select("features").first()
    return out, first["features"].size if first else 0


def logistic(data: DataFrame, y: str, n: int, scale: float = 1.0):
    """L2-penalised logistic regression with unit inverse strength over n rows."""
    return LogisticRegression(featuresCol="features", labelCol=y, regParam=scale / n, elasticNetParam=0.0, standardization=False, maxIter=100, tol=1e-6).fit(data)


def standardised(data: DataFrame) -> DataFrame:
    """All features centred and divided by their sample deviation."""
    scaled = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(data).transform(data)
    return scaled.drop("features").withColumnRenamed("z", "features")


def propensity_mse(data: DataFrame, share: float, n: int) -> float:
    """Mean squared gap between in-sample propensities and the synthetic share; ``data`` is standardised."""
    p = vector_to_array("probability")[1]
    # the features have unit sample deviation; the penalty is adapted to the population one
    got = logistic(data, "y", n, (n - 1) / n).transform(data)
    return got.agg(F.avg((p - F.lit(share)) * (p - F.lit(share)))).first()[0]


def _rank_hash(seed: int) -> Column:
    """53 bits, which a double holds, as the sketches of quantiles do."""
    return F.shiftright(F.xxhash64(F.lit(seed), "_row"), 11)


def _cuts(data: DataFrame, hashes: list[Column], ones: int, n: int) -> list[int]:
    """For each ``_rank_hash`` of the n rows its value of rank ``ones``, sought near where an even spread has it."""
    if not hashes:
        return []
    lowest, size = -(1 << 52), 1 << 53
    share, wide = ones / n, 8 * (ones / n * (1 - ones / n) / n) ** 0.5
    lo, hi = (max(lowest, min(lowest + size - 1, lowest + int(x * size))) for x in (share - wide, share + wide))
    got = data.agg(*[F.count_if(t).alias(f"{p}{i}") for i, h in enumerate(hashes) for p, t in (("b", h < F.lit(lo)), ("w", h.between(lo, hi)))]).first()
    ranks = [(h.between(lo, hi), ones - got[f"b{i}"], got[f"w{i}"]) for i, h in enumerate(hashes)]
    ranks = [r if 0 < r[1] <= r[2] else (F.lit(True), ones, n) for r in ranks]
    return list(data.agg(*[F.percentile_approx(F.when(there, h), (rank - 0.5) / of, RANKS).alias(f"c{i}") for i, (h, (there, rank, of)) in enumerate(zip(hashes, ranks, strict=True))]).first())


def permuted(data: DataFrame, seed: int, ones: int, n: int) -> DataFrame:
    """Labels dealt anew by the rank of a hash of the row; the count of ones is met."""
    h = _rank_hash(seed)
    if not 0 < ones < n:
        return data.withColumn("y", F.lit(float(ones > 0)))
    return data.withColumn("y", (h <= F.lit(_cuts(data, [h], ones, n)[0])).cast("double"))


def _matrix(features: pa.StructArray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Vectors, sparse or dense, as rows of standardised features (0 where they do not vary) and a last 1 for the intercept."""
    x = np.zeros((len(features), len(mean)))
    places, values = features.field("indices"), features.field("values")
    sparse = features.field("type").to_numpy(zero_copy_only=False) == 0
    many = values.value_lengths().to_numpy(zero_copy_only=False)
    v = values.flatten().to_numpy(zero_copy_only=False)
    of_sparse = np.repeat(sparse, many)
    x[np.repeat(np.arange(len(x)), many)[of_sparse], places.flatten().to_numpy(zero_copy_only=False)] = v[of_sparse]
    x[~sparse] = v[~of_sparse].reshape(-1, len(mean))
    z = np.divide(x - mean, sd, out=np.zeros_like(x), where=sd > 0)
    return np.column_stack([z, np.ones(len(z))])


def _newton_sums(data: DataFrame, labels: list[Column], at: np.ndarray, share: float, mean: np.ndarray, sd: np.ndarray) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
    """Of each label's logistic model ``at`` its coefficients: loss, squared gaps of the propensities to ``share``, gradient and Hessian, summed over all rows in one pass."""
    width, upper = at.shape[1], np.triu_indices(at.shape[1])

    def sums(batches):
        total = np.zeros((len(at), 2 + width + len(upper[0])))
        for b in batches:
            z = _matrix(b.column("features"), mean, sd)
            y = b.column("y").flatten().to_numpy(zero_copy_only=False).reshape(len(z), -1).astype(float)
            eta = z @ at.T
            p = np.exp(-np.logaddexp(0.0, -eta))
            total[:, 0] += (np.logaddexp(0.0, eta) - y * eta).sum(axis=0)
            total[:, 1] += ((p - share) ** 2).sum(axis=0)
            total[:, 2 : 2 + width] += (p - y).T @ z
            for i, w in enumerate((p * (1 - p)).T):
                total[i, 2 + width :] += ((z * w[:, None]).T @ z)[upper]
        yield pa.RecordBatch.from_pydict({"i": np.arange(total.size), "v": total.ravel()})

    rows = data.select("features", F.array(*labels).alias("y")).mapInArrow(sums, "i long, v double")
    got = rows.groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # as many as labels by squared features
    total = np.zeros(len(at) * (2 + width + len(upper[0])))
    total[got.column("i").to_numpy()] = got.column("v").to_numpy()
    out = []
    for t in total.reshape(len(at), -1):
        h = np.zeros((width, width))
        h[upper] = t[2 + width :]
        out.append((t[0], t[1], t[2 : 2 + width], h + np.triu(h, 1).T))
    return out


def propensity_mses(data: DataFrame, share: float, n: int, ones: int, seeds: list[int]) -> tuple[float, list[float]]:
    """The mean squared gap of ``propensity_mse`` for the true labels of ``vectors`` and for those ``permuted`` by each seed.

    Newton's method takes all labels through the rows together: a few passes serve them all, where single fits take dozens each.
    """
    workers_can_import(data.sparkSession)
    scale = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=True).fit(data)
    mean, sd = scale.mean.toArray(), scale.std.toArray()
    penalty = np.append(np.full(len(mean), (n - 1) / n / n), 0.0)  # the features have unit sample deviation; the penalty is adapted to the population one
    found: list[float] = []
    for first in range(0, max(1, len(seeds)), BATCH):
        hashes = [_rank_hash(s) for s in seeds[first : first + BATCH]]
        labels = [*([F.col("y") > 0] if not first else []), *[h <= F.lit(c) for h, c in zip(hashes, _cuts(data, hashes, ones, n), strict=True)]]
        gap = np.full(len(labels), np.nan)
        at = np.zeros((len(labels), len(mean) + 1))
        at[:, -1] = np.log(share / (1 - share))
        before, least, todo = at.copy(), np.full(len(labels), np.inf), list(range(len(labels)))
        for _ in range(PASSES):
            left = []
            for i, (loss, squares, slope, curve) in zip(todo, _newton_sums(data, [labels[i] for i in todo], at[todo], share, mean, sd), strict=True):
                value = loss / n + (penalty * at[i] ** 2).sum() / 2
                if value > least[i] + 1e-12:  # too far: half the step
                    at[i] = (at[i] + before[i]) / 2
                    left.append(i)
                    continue
                least[i], gap[i], before[i] = value, squares / n, at[i]
                slope = slope / n + penalty * at[i]
                step = np.linalg.lstsq(curve / n + np.diag(penalty), slope, rcond=None)[0]
                if slope @ step > 1e-16:
                    at[i] = at[i] - step
                    left.append(i)
            if not (todo := left):
                break
        found += gap.tolist()
    return found[0], found[1:]


def dealt(df: DataFrame, parts: list[float], seed: int, by: Column | None = None, row: str = "_row") -> DataFrame:
    """A ``fold`` for each row: how many of the rising shares ``parts`` its rank by a hash lies above, within its class.

    The ranks' cuts are approximate quantiles of each class that are exact up to ``RANKS`` rows and within 1 in
    ``RANKS`` beyond, so classes are dealt in proportion without sorting any of them. A null class is a class of its own.
    """
    by = F.lit(0) if by is None else by
    h = F.xxhash64(F.lit(seed), row)
    df = df.withColumn("_class", F.coalesce(by.cast("string"), F.lit(""))).withColumn("_h", h)
    cuts = df.groupBy("_class").agg(F.percentile_approx("_h", parts, RANKS).alias("_cuts"))
    return df.join(cuts, "_class").withColumn("fold", F.size(F.filter("_cuts", lambda c: c < F.col("_h")))).drop("_class", "_h", "_cuts")


def folds(data: DataFrame, n: int, seed: int, by: str | None = None) -> DataFrame:
    """``fold`` 0 to n - 1, stratified by the column ``by``."""
    return dealt(data, [i / n for i in range(1, n)], seed, F.col(by) if by else None)


def area(scored: DataFrame, y: str) -> float:
    """ROC area of the probability of class 1."""
    return auc(scored.select(vector_to_array("probability")[1].alias("p"), (F.col(y) == 1).alias("pos")), "p", "pos").first()["auc"]


def principal(data: DataFrame, k: int) -> DataFrame:
    """-> _row, y, p: scores on the first k principal components of the centred features."""
    centred = StandardScaler(inputCol="features", outputCol="z", withMean=True, withStd=False).fit(data).transform(data)
    return PCA(k=k, inputCol="z", outputCol="pc").fit(centred).transform(centred).select("_row", "y", vector_to_array("pc").alias("p"))


# ---- tasks -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class UtilityTask:
    target: str
    task_type: str | None = None  # classification or regression; None: by the target's role
    features: tuple[str, ...] | None = None


def task_type(task: UtilityTask, meta: Metadata) -> str:
    if task.task_type:
        return task.task_type
    return "regression" if meta.columns[task.target].dtype is ColumnType.NUMERIC else "classification"


def suggest_tasks(meta: Metadata) -> list[UtilityTask]:
    """Every numeric, categorical or boolean column as a target."""
    return [UtilityTask(c.name, "regression" if c.dtype is ColumnType.NUMERIC else "classification") for c in meta if c.dtype in (ColumnType.NUMERIC, ColumnType.CATEGORICAL, ColumnType.BOOLEAN)]


def feature_columns(task: UtilityTask, meta: Metadata) -> list[str]:
    asked = list(dict.fromkeys(task.features or meta.columns))
    return [c for c in asked if c != task.target and c in meta.columns and meta.columns[c].dtype in (ColumnType.NUMERIC, ColumnType.CATEGORICAL, ColumnType.BOOLEAN)]


@dataclass
class Prepared:
    """A fitted preprocessor: mean-imputed standardised numbers, mode-imputed one-hot labels (unknown labels are all zero)."""

    numeric: list[str]
    labelled: list[str]
    moments: dict[str, tuple[float, float]]
    modes: dict[str, str]
    encoder: PipelineModel
    sources: list[str]  # source column of each encoded place

    def apply(self, df: DataFrame) -> DataFrame:
        cols = {}
        for i, c in enumerate(self.numeric):
            m, s = self.moments[c]
            cols[f"_f{i}"] = (F.coalesce(number(c), F.lit(m)) - F.lit(m)) / F.lit(s)
        for i, c in enumerate(self.labelled):
            cols[f"_g{i}"] = F.coalesce(plain_label(c), F.lit(self.modes[c]))
        return self.encoder.transform(df.withColumns(cols))


def prepare(df: DataFrame, columns: list[str], meta: Metadata) -> Prepared:
    num = [c for c in columns if meta.columns[c].dtype is ColumnType.NUMERIC]
    lab = [c for c in columns if c not in num]
    moments = {}
    if num:
        for r in K.profile(df.withColumn("_side", F.lit("r")), num).collect():
            moments[r["column"]] = (r["mean"] or 0.0, r["sd_pop"] or 1.0)
    modes = {c: "" for c in lab}
    if lab:
        f = K.label_long(df.withColumn("_side", F.lit("r")), lab, missing=False).groupBy("column", "label").count()
        for r in f.groupBy("column").agg(F.min(F.struct(-F.col("count"), F.col("label"))).alias("m")).collect():
            modes[r["column"]] = r["m"]["label"]
    rows = df
    for i, c in enumerate(num):
        rows = rows.withColumn(f"_f{i}", (F.coalesce(number(c), F.lit(moments[c][0])) - F.lit(moments[c][0])) / F.lit(moments[c][1]))
    for i, c in enumerate(lab):
        rows = rows.withColumn(f"_g{i}", F.coalesce(plain_label(c), F.lit(modes[c])))
    stages, inputs = [], [f"_f{i}" for i in range(len(num))]
    if lab:
        stages = [StringIndexer(inputCols=[f"_g{i}" for i in range(len(lab))], outputCols=[f"_i{i}" for i in range(len(lab))], handleInvalid="keep"), OneHotEncoder(inputCols=[f"_i{i}" for i in range(len(lab))], outputCols=[f"_h{i}" for i in range(len(lab))], dropLast=True)]
        inputs += [f"_h{i}" for i in range(len(lab))]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    encoder = Pipeline(stages=stages).fit(rows)
    sources = list(num)
    if lab:
        for c, labels in zip(lab, encoder.stages[0].labelsArray, strict=True):
            sources += [c] * len(labels)
    return Prepared(num, lab, moments, modes, encoder, sources)


def estimator(name: str, kind: str, n: int, classes: int, sd: float, seed: int):
    """A model by name: linear, forest or boosted, for classification or regression."""
    if kind == "regression":
        if name == "linear":  # ridge of strength 1
            return LinearRegression(featuresCol="features", labelCol="_y", solver="normal", elasticNetParam=0.0, standardization=False, regParam=sd / n)
        if name == "forest":
            return RandomForestRegressor(featuresCol="features", labelCol="_y", numTrees=TREES, maxDepth=10, seed=seed)
        return GBTRegressor(featuresCol="features", labelCol="_y", maxIter=BOOSTS, maxDepth=5, seed=seed)
    if name == "linear":
        return LogisticRegression(featuresCol="features", labelCol="_y", regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=100)
    if name == "forest":
        return RandomForestClassifier(featuresCol="features", labelCol="_y", numTrees=TREES, maxDepth=10, seed=seed)
    boosted = GBTClassifier(featuresCol="features", labelCol="_y", maxIter=BOOSTS, maxDepth=5, seed=seed)
    return boosted if classes == 2 else OneVsRest(classifier=boosted, featuresCol="features", labelCol="_y")


def split(df: DataFrame, by: str | None, share: float, seed: int, id_column: str = "_row") -> tuple[DataFrame, DataFrame]:
    """A seeded split, stratified by the labels of the column ``by``."""
    parts = dealt(df, [share], seed, plain_label(by) if by else None, id_column)
    return parts.where("fold = 0").drop("fold"), parts.where("fold = 1").drop("fold")


def classes_of(df: DataFrame, target: str, notes: list[str] | None = None, most: int = MOST_CLASSES) -> list[str] | None:
    """The sorted labels of a target; None, with a note, if they are more than a classifier is made for."""
    found = [r[0] for r in df.select(plain_label(target).alias("v")).where("v is not null").distinct().limit(most + 1).collect()]
    if len(found) > most:
        if notes is not None:
            notes.append(f"{target}: more than {most} classes")
        return None
    return sorted(found)


def class_index(target: str, classes: list[str]) -> Column:
    """The place of a row's label among the classes, from 0; -1 for other labels, null for none."""
    return F.array_position(F.array(*[F.lit(x) for x in classes]), plain_label(target)).cast("double") - 1


def compacted(d: DataFrame, columns: list[str]) -> DataFrame | None:
    """Rows alike in the features and ``_y`` as one with their count ``_w``; None if more than ``COMPACT`` are left."""
    rows = saved(d.groupBy(*[F.col(f"`{c}`") for c in columns], "_y").agg(F.count(F.lit(1)).cast("double").alias("_w")).limit(COMPACT + 1), "compact")
    return rows if rows.count() <= COMPACT else None


def bagged(few: DataFrame, few_test: DataFrame, ready: Prepared, classes: int, seed: int) -> dict[int, np.ndarray]:
    """Mean class probabilities of a forest's trees for the rows of ``few_test`` (_i).

    A bootstrap of rows takes Poisson(1) of each, so Poisson(w) of w rows alike: those are the weights of a tree's rows.
    """
    rng, schema = np.random.default_rng(seed), few.schema
    rows = sorted(few.collect(), key=str)  # at most COMPACT
    drawn = rng.poisson(np.array([r["_w"] for r in rows])[:, None], (len(rows), TREES)).astype(float)
    spark = few.sparkSession
    data = spark.createDataFrame([(*r, w.tolist()) for r, w in zip(rows, drawn, strict=True)], StructType([*schema.fields, StructField("_b", ArrayType(DoubleType()))]))
    train, test = ready.apply(data).select("features", "_y", "_b").coalesce(1).persist(), ready.apply(few_test).select("_i", "features").coalesce(1).persist()

    def tree(i: int):
        one = RandomForestClassifier(featuresCol="features", labelCol="_y", weightCol="_wi", numTrees=1, bootstrap=False, featureSubsetStrategy="sqrt", maxDepth=10, seed=seed + i)
        model = one.fit(train.withColumn("_wi", F.col("_b")[i]).where("_wi > 0"))
        got = model.transform(test).select("_i", vector_to_array("probability").alias("p")).collect()
        return {r["_i"]: np.array([*r["p"], *[0.0] * (classes - len(r["p"]))]) for r in got}

    with ThreadPoolExecutor(8) as pool:
        parts = list(pool.map(tree, range(TREES)))
    train.unpersist()
    test.unpersist()
    return {i: sum(p[i] for p in parts) / TREES for i in parts[0]}


def weighted_area(p: np.ndarray, positive: np.ndarray, w: np.ndarray) -> float | None:
    """ROC area of weighted rows, ties counted half."""
    value, at = np.unique(p, return_inverse=True)
    good, bad = (np.bincount(at, weights=w * side, minlength=len(value)) for side in (positive, ~positive))
    whole = good.sum() * bad.sum()
    return float((good * (np.cumsum(bad) - bad / 2)).sum() / whole) if whole else None


def fit_and_score(train: DataFrame, test: DataFrame, task: UtilityTask, meta: Metadata, names: tuple[str, ...], seed: int, labels: list[str] | None = None) -> dict[str, float | None]:
    """Train on one table, score on the other: ROC area (two classes), accuracy or R squared for each model; None if it cannot be trained.

    ``labels`` are the sorted classes of the real target; rows of other classes are left out of training.
    Rows alike are learned and scored once, with their count as weight, where that leaves at most ``COMPACT`` of each table.
    """
    kind, columns = task_type(task, meta), feature_columns(task, meta)
    if kind == "regression":
        y = number(task.target)
    else:
        y = class_index(task.target, labels or [])
    train, test = (d.withColumn("_y", y).where("_y is not null and _y >= 0" if kind != "regression" else "_y is not null") for d in (train, test))
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_y").alias("k"), F.stddev_pop("_y").alias("s"), F.min("_y").alias("lo")).first()
    if stats["n"] < 2:
        return dict.fromkeys(names)
    if kind != "regression" and stats["k"] < 2:  # always the one class it saw
        return dict.fromkeys(names, 0.5 if len(labels) == 2 else test.agg(F.avg((F.col("_y") == F.lit(stats["lo"])).cast("double"))).first()[0])
    ready = prepare(train, columns, meta)
    few = few_test = None
    if kind != "regression" and stats["n"] > COMPACT and (few := compacted(train, columns)) is not None and (few_test := compacted(test, columns)) is not None:
        few_test = saved(few_test.withColumn("_i", F.monotonically_increasing_id()), "compact")
    compact, out = few_test is not None, {}
    for name in names:
        if compact:
            rows = {r["_i"]: (r["_y"], r["_w"]) for r in few_test.select("_i", "_y", "_w").collect()}
            if name == "forest":
                p = bagged(few, few_test, ready, len(labels), seed)
            else:
                model = estimator(name, kind, stats["n"], len(labels), 0.0, seed).setWeightCol("_w").fit(ready.apply(few.coalesce(1)))
                got = model.transform(ready.apply(few_test))
                if "probability" in got.columns:
                    p = {r["_i"]: np.array(r["p"]) for r in got.select("_i", vector_to_array("probability").alias("p")).collect()}
                else:
                    p = {r["_i"]: np.eye(len(labels))[int(r["prediction"])] for r in got.select("_i", "prediction").collect()}
            if not (ids := sorted(rows)):
                out[name] = None
                continue
            true, w = (np.array([rows[i][j] for i in ids]) for j in (0, 1))
            table = np.array([p[i] for i in ids])
            out[name] = weighted_area(table[:, 1], true == 1, w) if len(labels) == 2 else float(w[table.argmax(axis=1) == true].sum() / w.sum())
            continue
        model = estimator(name, kind, stats["n"], len(labels or []), stats["s"] or 0.0, seed).fit(ready.apply(train))
        got = model.transform(ready.apply(test))
        if kind == "regression":
            r = got.agg(F.sum((F.col("_y") - F.col("prediction")) ** 2).alias("e"), (F.var_pop("_y") * F.count(F.lit(1))).alias("t")).first()
            out[name] = 1 - r["e"] / r["t"] if r["t"] else None
        elif len(labels) == 2:
            out[name] = area(got, "_y")
        else:
            out[name] = got.agg(F.avg((F.col("_y") == F.col("prediction")).cast("double"))).first()[0]
    return out


def importances(df: DataFrame, task: UtilityTask, meta: Metadata, columns: list[str], labels: list[str], seed: int) -> dict[str, float]:
    """Impurity importances of a forest, summed to the source columns."""
    kind = task_type(task, meta)
    y = number(task.target) if kind == "regression" else class_index(task.target, labels)
    df = df.withColumn("_y", y).where("_y is not null" if kind == "regression" else "_y >= 0")
    ready = prepare(df, columns, meta)
    model = estimator("forest", kind, 1, len(labels), 1.0, seed).fit(ready.apply(df))
    out = {c: 0.0 for c in columns}
    for c, v in zip(ready.sources, model.featureImportances.toArray(), strict=True):
        out[c] += float(v)
    return out
