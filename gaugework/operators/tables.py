"""What each metric measures, as a DataFrame: a row a column, pair of columns, subgroup or table.

``pair`` is the tagged union of plans.kernels. Everything returned is small (it grows with the number
of columns or groups, not of rows), so metrics may collect it.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import kernels as K
from ..plans import neighbors as N
from ..schema import ColumnType, Metadata, label, number, plain_label

GRID = [round(0.05 * i, 2) for i in range(1, 20)]


def clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _below(x: Column):
    return lambda v: v < x


# ---- congruence ------------------------------------------------------------------------------


def ks(pair: DataFrame, columns: list[str], sweep: DataFrame | None = None) -> DataFrame:
    sweep = K.ks_w1(K.numeric_long(pair, columns)) if sweep is None else sweep
    return sweep.select("column", "n_r", "n_s", F.col("ks").alias("ks_statistic"))


def wasserstein(pair: DataFrame, columns: list[str], sweep: DataFrame | None = None, moments: DataFrame | None = None) -> DataFrame:
    moments = K.moments(pair, columns) if moments is None else moments
    sweep = K.ks_w1(K.numeric_long(pair, columns)) if sweep is None else sweep
    scaled = F.least(F.lit(1.0), F.col("w1") / F.greatest(F.coalesce("sd_r", F.lit(0.0)), F.lit(1e-9)))
    return sweep.join(moments.select("column", "sd_r"), "column").select("column", F.col("w1").alias("wasserstein"), scaled.alias("normalised"))


def ci_overlap(pair: DataFrame, columns: list[str], use_real_se: bool = False, moments: DataFrame | None = None) -> DataFrame:
    m = (K.moments(pair, columns) if moments is None else moments).where("n_r >= 2 and n_s >= 2")
    half = lambda s, t: F.lit(1.96) * F.col(f"sd_{s}") / F.sqrt(F.col(f"n_{t}"))
    m = m.withColumns({"hr": half("r", "r"), "hs": half("r", "r") if use_real_se else half("s", "s")})
    lr, ur, ls, us = F.col("mean_r") - F.col("hr"), F.col("mean_r") + F.col("hr"), F.col("mean_s") - F.col("hs"), F.col("mean_s") + F.col("hs")
    common = F.greatest(F.lit(0.0), F.least(ur, us) - F.greatest(lr, ls))
    wr, ws = 2 * F.col("hr"), 2 * F.col("hs")
    both = F.least(F.lit(1.0), (F.try_divide(common, wr) + F.try_divide(common, ws)) / 2)
    same = (F.abs(F.col("mean_r") - F.col("mean_s")) <= 1e-12).cast("double")
    return m.select("column", F.when((wr == 0) & (ws == 0), same).when((wr == 0) | (ws == 0), F.lit(0.0)).otherwise(both).alias("ci_overlap"))


def standardised_means(pair: DataFrame, columns: list[str], moments: DataFrame | None = None) -> DataFrame:
    m = (K.moments(pair, columns) if moments is None else moments).where("n_r >= 2 and n_s >= 2 and lo_r < hi_r")
    return m.select("column", (F.abs(F.col("mean_r") - F.col("mean_s")) / F.col("sd_r")).alias("std_mean_diff"))


def quantile_mse(pair: DataFrame, columns: list[str], moments: DataFrame | None = None) -> DataFrame:
    q = K.both_quantiles(K.numeric_long(pair, columns), GRID).where("q_r is not null and q_s is not null")
    q = q.join((K.moments(pair, columns) if moments is None else moments).where("lo_r < hi_r").select("column", "sd_pop_r"), "column")
    parts = F.zip_with("q_r", "q_s", lambda x, y: ((x - y) / F.col("sd_pop_r")) * ((x - y) / F.col("sd_pop_r")))
    return q.select("column", (F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / len(GRID)).alias("quantile_mse"))


def shares(pair: DataFrame, columns: list[str], freq: DataFrame | None) -> DataFrame:
    """The frequencies of the columns' labels, null being one of them; from a table of them if there is one."""
    return K.frequencies(K.label_long(pair, columns)) if freq is None else freq.where(F.col("column").isin(columns))


def tvd(pair: DataFrame, columns: list[str], missing: bool = True, freq: DataFrame | None = None) -> DataFrame:
    f = shares(pair, columns, freq) if missing else K.frequencies(K.label_long(pair, columns, missing=False))
    return f.groupBy("column").agg((F.sum(F.abs(F.col("p_r") - F.col("p_s"))) / 2).alias("tvd"))


def _hell(f: DataFrame) -> DataFrame:
    gap = F.sqrt("p_r") - F.sqrt("p_s")
    return f.groupBy("column").agg(F.sqrt(F.sum(gap * gap) / 2).alias("hellinger"))


def hellinger(pair: DataFrame, numeric: list[str], categorical: list[str], n_bins: int = 20, moments: DataFrame | None = None, freq: DataFrame | None = None) -> DataFrame:
    """Labels as they are; numbers in equal bins over the range of both sides (one value only: distance 0)."""
    out = _hell(shares(pair, categorical, freq)) if categorical else None
    if numeric:
        m = [r for r in (K.moments(pair, numeric) if moments is None else moments).collect() if r.n_r and r.n_s]
        span = {r["column"]: (min(r.lo_r, r.lo_s), max(r.hi_r, r.hi_s)) for r in m}
        edges = {c: K.bins(lo, hi, n_bins) for c, (lo, hi) in span.items() if hi > lo}
        flat = [(c, 0.0) for c, (lo, hi) in span.items() if hi <= lo]
        parts = [_hell(K.frequencies(K.histogram(pair, edges)))] if edges else []
        parts += [pair.sparkSession.createDataFrame(flat, "column string, hellinger double")] if flat else []
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out if out is not None else pair.sparkSession.createDataFrame([], "column string, hellinger double")


def jsd(pair: DataFrame, columns: list[str], freq: DataFrame | None = None) -> DataFrame:
    f = shares(pair, columns, freq)
    m = (F.col("p_r") + F.col("p_s")) / 2
    half = lambda p: F.when(F.col(p) > 0, F.col(p) * F.log2(F.col(p) / m)).otherwise(0.0)
    return f.groupBy("column").agg(F.greatest(F.lit(0.0), (F.sum(half("p_r")) + F.sum(half("p_s"))) / 2).alias("jsd"))


def associations(pair: DataFrame, columns: list[str], meta: Metadata) -> DataFrame:
    """-> a, b (metadata order), real, synthetic, abs_corr_diff (null where a side is undefined)."""
    place = {c: i for i, c in enumerate(columns)}
    num = [c for c in columns if meta.columns[c].dtype is ColumnType.NUMERIC]
    cat = [c for c in columns if c not in num]
    parts = []
    if len(num) > 1:
        parts.append(K.pearson(pair, num))
    if len(cat) > 1:
        parts.append(K.cramers_v(pair, cat))
    if num and cat:
        parts.append(K.correlation_ratio(pair, list(itertools.product(cat, num))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = F.create_map(*[F.lit(x) for c, i in place.items() for x in (c, i)])
    swap = F.element_at(order, F.col("a")) > F.element_at(order, F.col("b"))
    out = out.select("_side", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), "value")
    g = out.groupBy("a", "b").agg(*[F.max(F.when(F.col("_side") == s, F.col("value"))).alias(n) for s, n in (("r", "real"), ("s", "synthetic"))])
    return g.withColumn("abs_corr_diff", F.when(F.col("real").isNotNull() & F.col("synthetic").isNotNull(), F.least(F.abs(F.col("real") - F.col("synthetic")), F.lit(1.0))))


def mutual_information(pair: DataFrame, numeric: list[str], labelled: list[str], n_bins: int = 10) -> DataFrame:
    """-> a, b, real, synthetic, abs_mi_diff: normalised mutual information; numbers fall in deciles of their own side."""
    probs = [i / n_bins for i in range(1, n_bins)]
    cell = {c: label(c) for c in labelled}
    if numeric:
        got = K.both_quantiles(K.numeric_long(pair, numeric), [0.0, *probs, 1.0]).collect()
        edges = {(s, r["column"]): sorted(set(r[f"q_{s}"])) for r in got for s in "rs" if r[f"q_{s}"]}
        for c in numeric:
            out = F.lit("-1")
            for s in "rs":
                e = edges.get((s, c), [])
                if len(e) > 1:  # bins are (a, b], the first one closed
                    place = F.size(F.filter(F.array(*[F.lit(float(v)) for v in e[1:-1]]), _below(number(c)))) if len(e) > 2 else F.lit(0)
                    out = F.when((F.col("_side") == s) & number(c).isNotNull(), place.cast("string")).otherwise(out)
            cell[c] = out
    columns = [*numeric, *labelled]
    g = K.entropies(K.contingency(pair, list(itertools.combinations(columns, 2)), cell))
    mi = F.greatest(F.col("hu") + F.col("hv") - F.col("huv"), F.lit(0.0))
    nmi = F.when((F.col("ku") == 1) & (F.col("kv") == 1), F.lit(1.0)).otherwise(clip(F.try_divide(2 * mi, F.col("hu") + F.col("hv"))))
    g = g.select("_side", "a", "b", nmi.alias("value")).groupBy("a", "b").agg(*[F.max(F.when(F.col("_side") == s, F.col("value"))).alias(x) for s, x in (("r", "real"), ("s", "synthetic"))])
    return g.withColumn("abs_mi_diff", F.abs(F.col("real") - F.col("synthetic")))


def sliced(pair: DataFrame, columns: list[str], directions: list[list[float]]) -> DataFrame:
    """-> direction, w1: first Wasserstein distance of the rows projected on each direction.

    Complete rows only; columns are divided by the real side's largest magnitude, then standardised by its moments.
    """
    ok = F.lit(True)
    for c in columns:
        ok &= number(c).isNotNull() & (F.abs(number(c)) < F.lit(float("inf")))
    rows = pair.where(ok)
    m = {r["column"]: r for r in K.profile(rows.where("_side = 'r'"), columns).collect()}
    z = []
    for c in columns:
        size = max(abs(m[c]["lo"]), abs(m[c]["hi"])) or 1.0
        z.append((number(c) / F.lit(size) - F.lit(m[c]["mean"] / size)) / F.lit(m[c]["sd"] / size))
    cells = []
    for i, d in enumerate(directions):
        x = F.lit(0.0)
        for w, c in zip(d, z, strict=True):
            x = x + F.lit(float(w)) * c
        cells.append(F.struct(F.lit(i).alias("direction"), x.alias("x")))
    long = rows.select("_side", F.explode(F.array(*cells)).alias("_c")).select("_side", "_c.*")
    return K.ks_w1(long, by=("direction",)).select("direction", "w1")


# ---- coverage --------------------------------------------------------------------------------


def category_coverage(pair: DataFrame, columns: list[str], freq: DataFrame | None = None) -> DataFrame:
    f = shares(pair, columns, freq)
    got = F.sum(F.when((F.col("n_r") > 0) & (F.col("n_s") > 0), 1).otherwise(0))
    return f.groupBy("column").agg(F.try_divide(got.cast("double"), F.sum(F.when(F.col("n_r") > 0, 1).otherwise(0)).cast("double")).alias("coverage")).where("coverage is not null")


def range_coverage(pair: DataFrame, columns: list[str], moments: DataFrame | None = None) -> DataFrame:
    m = (K.moments(pair, columns) if moments is None else moments).where("n_r > 0 and n_s > 0")
    overlap = F.greatest(F.lit(0.0), F.least("hi_r", "hi_s") - F.greatest("lo_r", "lo_s"))
    inside = ((F.col("lo_s") <= F.col("lo_r")) & (F.col("lo_r") <= F.col("hi_s"))).cast("double")
    return m.select("column", F.when(F.col("hi_r") == F.col("lo_r"), inside).otherwise(F.try_divide(overlap, F.col("hi_r") - F.col("lo_r"))).alias("coverage"), (F.col("hi_r") == F.col("lo_r")).alias("constant"))


def entropy_ratio(pair: DataFrame, columns: list[str], freq: DataFrame | None = None) -> DataFrame:
    h = lambda p: -F.sum(F.when(F.col(p) > 0, F.col(p) * F.log(p)).otherwise(0.0))
    g = shares(pair, columns, freq).groupBy("column").agg(h("p_r").alias("entropy_real"), h("p_s").alias("entropy_synthetic"))
    return g.where("entropy_real > 0").select("column", F.least(F.lit(1.0), F.col("entropy_synthetic") / F.col("entropy_real")).alias("ratio"), "entropy_real", "entropy_synthetic")


# ---- preservation ----------------------------------------------------------------------------


def rare_categories(pair: DataFrame, columns: list[str], threshold: float = 0.05) -> DataFrame:
    f = K.frequencies(K.label_long(pair, columns, missing=False)).where((F.col("p_r") > 0) & (F.col("p_r") < threshold))
    kept = F.least(F.coalesce(F.col("p_s"), F.lit(0.0)) / F.col("p_r"), F.lit(1.0))
    return f.groupBy("column").agg(F.count(F.lit(1)).alias("n_rare"), F.sum((F.coalesce("n_s", F.lit(0)) == 0).cast("int")).alias("n_missing"), F.sum(kept).alias("kept")).withColumn("retention", F.col("kept") / F.col("n_rare"))


def minority_density(pair: DataFrame, columns: list[str]) -> DataFrame:
    f = K.frequencies(K.label_long(pair, columns, missing=False)).where("n_r > 0")
    g = f.groupBy("column").agg(F.min(F.struct("p_r", "label", F.coalesce("p_s", F.lit(0.0)).alias("p_s"))).alias("m"))
    return g.select("column", F.col("m.label").alias("label"), F.least(F.col("m.p_s") / F.col("m.p_r"), F.lit(1.0)).alias("density_ratio"))


def tail_coverage(pair: DataFrame, columns: list[str], q: float = 0.05) -> DataFrame:
    """-> column, lower, upper: share of synthetic values beyond the real tail's cut, over q; null where the real tail is empty."""
    cut = K.quantiles(K.numeric_long(pair, columns), [q, 1 - q], "r").select("column", F.element_at("q", 1).alias("a"), F.element_at("q", 2).alias("b"))
    cut = cut.join(K.moments(pair, columns).where("n_s > 0").select("column", "lo_r", "hi_r"), "column")
    rows = {r["column"]: r for r in cut.collect()}
    if not rows:
        return pair.sparkSession.createDataFrame([], "column string, lower double, upper double")
    syn = pair.where("_side = 's'")
    share = lambda test: F.least(F.avg(test.cast("double")) / q, F.lit(1.0))
    aggs = []
    for i, (c, r) in enumerate(rows.items()):
        x = number(c)
        aggs += [(share(x < r["a"]) if r["a"] != r["lo_r"] else F.max(F.lit(None).cast("double"))).alias(f"l{i}"), (share(x > r["b"]) if r["b"] != r["hi_r"] else F.max(F.lit(None).cast("double"))).alias(f"u{i}")]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"l{i}").alias("lower"), F.col(f"u{i}").alias("upper")) for i, c in enumerate(rows)])
    return syn.agg(*aggs).select(F.explode(cells).alias("_c")).select("_c.*")


def subgroup_shapes(pair: DataFrame, where: dict[str, Column], numeric: list[str], labelled: list[str]) -> DataFrame:
    """-> subgroup, n_real, n_syn, share_real, share_syn, shape_score: all subgroups in the same scans."""
    member = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in where.items()]), lambda x: x.isNotNull())
    inside = pair.withColumn("subgroup", F.explode(member))
    sizes = inside.groupBy("subgroup").agg(*[F.sum((F.col("_side") == s).cast("int")).alias(n) for s, n in (("r", "n_real"), ("s", "n_syn"))])
    whole = pair.agg(*[F.sum((F.col("_side") == s).cast("int")).alias(n) for s, n in (("r", "all_real"), ("s", "all_syn"))]).first()
    parts, by = [], ("subgroup", "column")
    if numeric:
        parts.append(K.ks_w1(K.numeric_long(inside, numeric, ("_side", "subgroup")), by).select("subgroup", F.col("ks").alias("d")))
    if labelled:
        f = K.frequencies(K.label_long(inside, labelled, missing=False, keep=("_side", "subgroup")), by)
        parts.append(f.groupBy(*by).agg((F.sum(F.abs(F.col("p_r") - F.col("p_s"))) / 2).alias("d")).where("d is not null").select("subgroup", "d"))
    gaps = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    shape = gaps.groupBy("subgroup").agg((1 - F.avg("d")).alias("shape_score"))
    out = sizes.join(shape, "subgroup", "left")
    return out.select("subgroup", "n_real", "n_syn", F.try_divide(F.col("n_real").cast("double"), F.lit(float(whole[0] or 0))).alias("share_real"), F.try_divide(F.col("n_syn").cast("double"), F.lit(float(whole[1] or 0))).alias("share_syn"), "shape_score")


# ---- fairness --------------------------------------------------------------------------------


def outcome_rates(pair: DataFrame, attribute: str, outcome: str, favourable: str | float) -> DataFrame:
    """-> _side, grp, rate of the favourable outcome among complete rows. A number is compared by value, a string as a label."""
    y = plain_label(outcome) if isinstance(favourable, str) else number(outcome)
    rows = pair.where("_side in ('r', 's')").select("_side", plain_label(attribute).alias("grp"), y.alias("y")).where("grp is not null and y is not null")
    return rows.groupBy("_side", "grp").agg(F.avg((F.col("y") == favourable).cast("double")).alias("rate"))


def parity(pair: DataFrame, attribute: str, outcome: str, favourable: str | float) -> DataFrame:
    """-> spd_real, spd_synthetic, parity_drift (1 if a real group is missing)."""
    g = outcome_rates(pair, attribute, outcome, favourable).groupBy("grp").agg(*[F.max(F.when(F.col("_side") == s, F.col("rate"))).alias(s) for s in "rs"])
    g = g.where("r is not null")
    spread = lambda s: F.coalesce(F.max(s) - F.min(s), F.lit(0.0))
    lost = F.max(F.col("s").isNull().cast("int")) == 1
    g = g.agg(spread("r").alias("spd_real"), spread("s").alias("spd_synthetic"), F.coalesce(lost, F.lit(False)).alias("lost"))
    return g.select("spd_real", "spd_synthetic", F.when(F.col("lost"), F.lit(1.0)).otherwise(F.abs(F.col("spd_synthetic") - F.col("spd_real"))).alias("parity_drift"))


# ---- compliance ------------------------------------------------------------------------------


#: Numbers that are cut into bins together, and thresholds that a bin is wide.
BINNED, WIDTH = 6, 4


def hits(pair: DataFrame, numeric: list[str], categorical: list[str], thresholds: dict[str, float], id_column: str) -> DataFrame:
    """-> n_real, n_hit: real rows with a synthetic row equal in all labels and within the thresholds in all numbers.

    A band join with an equality key: up to ``BINNED`` numbers with a threshold are cut into bins of
    ``WIDTH`` thresholds, a real row lies in one cell of them, and a synthetic row in the cells that its
    thresholds reach (one or two bins a number, 1.5 on the average). With r bins a number the rows spread over r to the
    power of the numbers cells, so that tables without labels do not meet in a few tasks either.
    """
    real = pair.where("_side = 'r'").select(F.col(f"`{id_column}`").alias("_id"), *[number(c).alias(f"x{i}") for i, c in enumerate(numeric)], *[label(c).alias(f"k{i}") for i, c in enumerate(categorical)])
    syn = pair.where("_side = 's'").select(*[number(c).alias(f"y{i}") for i, c in enumerate(numeric)], *[label(c).alias(f"m{i}") for i, c in enumerate(categorical)]).distinct()
    cond = [F.col(f"k{i}") == F.col(f"m{i}") for i in range(len(categorical))]
    for i in [i for i, c in enumerate(numeric) if thresholds.get(c, 0) > 0][:BINNED]:
        t = thresholds[numeric[i]]
        # A little beyond the threshold, so that rounding at a border loses no row; the exact test follows.
        at = lambda x: F.floor(x / F.lit(WIDTH * t))  # noqa: B023, E731
        low, high = at(F.col(f"y{i}") - F.lit(t * (1 + 1e-6))), at(F.col(f"y{i}") + F.lit(t * (1 + 1e-6)))
        real = real.withColumn(f"_bin{i}", at(F.col(f"x{i}")))
        syn = syn.withColumn(f"_cell{i}", F.explode(F.sequence(low, high)))
        cond.append(F.col(f"_bin{i}") == F.col(f"_cell{i}"))
    for i, c in enumerate(numeric):
        cond.append(F.abs(F.col(f"x{i}") - F.col(f"y{i}")) <= F.lit(thresholds[c]) if thresholds.get(c, 0) > 0 else F.col(f"x{i}") == F.col(f"y{i}"))
    hit = real.join(syn, cond, "left_semi").agg(F.count(F.lit(1)).alias("n_hit"))
    return real.agg(F.count(F.lit(1)).alias("n_real")).join(F.broadcast(hit))  # one row each


def first_quantile(d: DataFrame, probs: list[float]) -> DataFrame:
    """Exact quantiles of the distances ``d`` -> q (array)."""
    return K.quantiles(d.select(F.lit("r").alias("_side"), F.lit("d").alias("column"), F.col("d").alias("x")).where("x is not null"), probs, "r").select("q")


def side(rows: DataFrame, s: str) -> DataFrame:
    return rows.where(F.col("_side") == s)


def near(rows: DataFrame, space: N.Space, a: str, b: str, k: int) -> DataFrame:
    """k nearest of side b for each row of side a; of its own side without itself."""
    return N.knn(side(rows, a), side(rows, b), space, k, exclude_self=a == b)
