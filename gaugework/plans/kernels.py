"""The dataflow kernels that metrics are made of. Every one returns a DataFrame.

A *pair* is the tagged union of the tables that are compared, with ``_side`` r (real), s (synthetic)
or h (holdout). Kernels take all columns at once, so that a scorecard scans the pair a few times and
not once for each metric and column.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ColumnType, Metadata, label, number, plain_label

#: Cuts of a column's value range for distributed running sums.
CUTS = 64


def tag(real: DataFrame | None, synthetic: DataFrame, holdout: DataFrame | None = None) -> DataFrame:
    sides = [(d, s) for d, s in ((real, "r"), (synthetic, "s"), (holdout, "h")) if d is not None]
    out = None
    for d, s in sides:
        d = d.withColumn("_side", F.lit(s))
        out = d if out is None else out.unionByName(d)
    return out


def numeric_long(pair: DataFrame, columns: list[str], keep: tuple[str, ...] = ("_side",)) -> DataFrame:
    """-> keep..., column, x: a row for each number; nulls and NaN are left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("x")) for c in columns])
    return pair.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.column", "_c.x").where("x is not null")


def label_long(pair: DataFrame, columns: list[str], *, missing: bool = True, keep: tuple[str, ...] = ("_side",)) -> DataFrame:
    """-> keep..., column, label; nulls are the label __NA__, or left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), (label(c) if missing else plain_label(c)).alias("label")) for c in columns])
    return pair.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.column", "_c.label").where("label is not null")


def profile(pair: DataFrame, columns: list[str], by: tuple[str, ...] = ("_side",)) -> DataFrame:
    """Moments of each side and column, from one aggregation over the wide table: no row is multiplied."""
    stats = {"n": F.count, "mean": F.avg, "sd": F.stddev_samp, "sd_pop": F.stddev_pop, "lo": F.min, "hi": F.max}
    wide = pair.groupBy(*by).agg(*[f(number(c)).alias(f"{i}_{s}") for i, c in enumerate(columns) for s, f in stats.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{s}").alias(s) for s in stats]) for i, c in enumerate(columns)])
    return wide.select(*by, F.explode(rows).alias("_p")).select(*by, "_p.*")


def moments(pair: DataFrame, columns: list[str], sides: tuple[str, ...] = ("r", "s")) -> DataFrame:
    """The profile with the sides beside each other: column, n_r, mean_r, ..., n_s, mean_s, ..."""
    p = profile(pair, columns)
    stats = ("n", "mean", "sd", "sd_pop", "lo", "hi")
    return p.groupBy("column").agg(*[F.max(F.when(F.col("_side") == side, F.col(s))).alias(f"{s}_{side}") for side in sides for s in stats])


def cuts_for(rows: int) -> int:
    """As many cuts of a value range as leave some 100 000 of ``rows`` between two of them, in steps of 64."""
    return CUTS * max(1, min(CUTS, rows // (100_000 * CUTS)))


def ecdf(long: DataFrame, sides: tuple[str, ...] = ("r", "s"), by: tuple[str, ...] = ("column",), cuts: int = CUTS) -> DataFrame:
    """Counts up to each distinct value: by..., x, next_x, and n_<side> (at x), c_<side> (up to x), t_<side> (all).

    A column's values never meet in one task: they are cut at ``cuts`` approximate quantiles (see
    ``cuts_for``), summed inside each cut, and only the cuts' totals are scanned in order. A value finds
    its cut in two steps, among every 64th edge and then among the 64 that follow.
    """
    counts = long.groupBy(*by, "x").agg(*[F.sum(F.when(F.col("_side") == s, 1).otherwise(0)).alias(f"n_{s}") for s in sides])
    found = F.array_distinct(F.percentile_approx("x", [i / cuts for i in range(1, cuts)], 8 * cuts))
    # their sum, always positive, makes the edges read the same table of counts, so that Spark makes it once
    edges = counts.groupBy(*by).agg(found.alias("_edges"), F.sum(sum(F.col(f"n_{s}") for s in sides)).alias("_all"))
    upto = lambda e: e <= F.col("x")
    if cuts > CUTS:
        edges = edges.withColumn("_far", F.filter("_edges", lambda _, i: i % CUTS == CUTS - 1))
        coarse = F.size(F.filter("_far", upto)) * CUTS
        place = coarse + F.size(F.filter(F.slice("_edges", coarse + 1, CUTS), upto))
    else:
        place = F.size(F.filter("_edges", upto))
    counts = counts.join(F.broadcast(edges), list(by)).withColumn("_cut", F.when(F.col("_all") >= 0, place)).drop("_edges", "_far", "_all")
    totals = counts.groupBy(*by, "_cut").agg(F.min("x").alias("_first"), *[F.sum(f"n_{s}").alias(f"_n_{s}") for s in sides])
    order = Window.partitionBy(*by).orderBy("_cut")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    totals = totals.select(
        *by, "_cut", F.lead("_first").over(order).alias("_then"),
        *[F.coalesce(F.sum(f"_n_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sides],
        *[F.sum(f"_n_{s}").over(whole).alias(f"t_{s}") for s in sides],
    )
    inside = Window.partitionBy(*by, "_cut").orderBy("x")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumns({"_next": F.lead("x").over(inside)} | {f"_c_{s}": F.sum(f"n_{s}").over(upto) for s in sides})
    counts = counts.join(F.broadcast(totals), [*by, "_cut"])  # a row a cut; unasked, the planner may send the values to all tasks instead
    return counts.select(*by, "x", F.coalesce("_next", "_then").alias("next_x"), *[f"n_{s}" for s in sides], *[(F.col(f"_c_{s}") + F.col(f"_b_{s}")).alias(f"c_{s}") for s in sides], *[f"t_{s}" for s in sides])


def ks_w1(long: DataFrame, by: tuple[str, ...] = ("column",), cuts: int = CUTS) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and first Wasserstein distance: by..., n_r, n_s, ks, w1."""
    e = ecdf(long, by=by, cuts=cuts).where("t_r > 0 and t_s > 0")
    gap = F.abs(F.col("c_r") / F.col("t_r") - F.col("c_s") / F.col("t_s"))
    return e.groupBy(*by).agg(F.max("t_r").alias("n_r"), F.max("t_s").alias("n_s"), F.max(gap).alias("ks"), F.coalesce(F.sum(gap * (F.col("next_x") - F.col("x"))), F.lit(0.0)).alias("w1"))


def _holding(side: str, probs: list[float]) -> Column:
    """The few rows of an ECDF between which the quantiles of a side lie."""
    c, n, t = (F.col(f"{x}_{side}") for x in "cnt")
    return F.exists(F.array(*[F.lit(float(p)) for p in probs]), lambda p: (p * (t - 1) < c) & (p * (t - 1) >= c - n - 1))


def _held(side: str, probs: list[float]) -> list[Column]:
    """Aggregates over an ECDF from which ``_between`` makes the quantiles of a side."""
    return [F.collect_list(F.when(_holding(side, probs), F.struct("x", F.col(f"c_{side}").alias("c")))).alias(f"held_{side}"), F.max(f"t_{side}").alias(f"t_{side}")]


def _between(side: str, probs: list[float]) -> Column:
    t = F.col(f"t_{side}")

    def at(k: Column) -> Column:  # the k-th smallest value, from 0
        return F.array_min(F.transform(F.filter(f"held_{side}", lambda e: e["c"] > k), lambda e: e["x"]))

    def value(p: Column) -> Column:
        pos = p * (t - 1)
        a, b = at(F.floor(pos)), at(F.least(F.floor(pos) + 1, t - 1))
        return a + (b - a) * (pos - F.floor(pos))

    return F.transform(F.array(*[F.lit(float(p)) for p in probs]), value)


def quantiles(long: DataFrame, probs: list[float], side: str = "r", by: tuple[str, ...] = ("column",)) -> DataFrame:
    """Exact quantiles with linear interpolation: by..., q (array in the order of ``probs``)."""
    g = ecdf(long.where(F.col("_side") == side), (side,), by).where(_holding(side, probs)).groupBy(*by).agg(*_held(side, probs))
    return g.select(*by, _between(side, probs).alias("q"))


def both_quantiles(long: DataFrame, probs: list[float], by: tuple[str, ...] = ("column",)) -> DataFrame:
    """The quantiles of both sides from one sweep: by..., q_r, q_s (null where a side has no value)."""
    g = ecdf(long, by=by).where(_holding("r", probs) | _holding("s", probs)).groupBy(*by).agg(*[x for s in "rs" for x in _held(s, probs)])
    return g.select(*by, *[F.when(F.col(f"t_{s}") > 0, _between(s, probs)).alias(f"q_{s}") for s in "rs"])


def frequencies(long: DataFrame, by: tuple[str, ...] = ("column",)) -> DataFrame:
    """Shares of each label on both sides: by..., label, n_r, n_s, p_r, p_s (0 where a side lacks it; null where a side is empty)."""
    n = long.groupBy(*by, "label").agg(*[F.sum(F.when(F.col("_side") == s, 1).otherwise(0)).alias(f"n_{s}") for s in "rs"])
    totals = n.groupBy(*by).agg(*[F.sum(f"n_{s}").alias(f"t_{s}") for s in "rs"])
    n = n.join(totals, list(by))
    return n.select(*by, "label", "n_r", "n_s", *[F.try_divide(F.col(f"n_{s}").cast("double"), F.col(f"t_{s}").cast("double")).alias(f"p_{s}") for s in "rs"])


def histogram(pair: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """Counts in given bins (the last one closed): _side, column, label (the bin), n. Values outside are left out."""
    cells = []
    for c, e in edges.items():
        x, lits = number(c), F.array(*[F.lit(float(v)) for v in e])
        place = F.least(F.size(F.filter(lits, _at_most(x))), F.lit(len(e) - 1))
        cells.append(F.struct(F.lit(c).alias("column"), F.when((x >= e[0]) & (x <= e[-1]), place).alias("bin")))
    rows = pair.select("_side", F.explode(F.array(*cells)).alias("_c")).select("_side", "_c.column", F.col("_c.bin").cast("string").alias("label"))
    return rows.where("label is not null")


def _at_most(x: Column):
    return lambda v: v <= x


def bins(lo: float, hi: float, n: int) -> list[float]:
    step = (hi - lo) / n
    return [*[lo + i * step for i in range(n)], hi]


# ---- rows ------------------------------------------------------------------------------------


def row_key(meta: Metadata) -> list[Column]:
    """What makes two rows the same: all but identifiers (unless there is nothing else), numbers by value, nulls alike."""
    cols = [c for c in meta if c.dtype is not ColumnType.ID] or list(meta)
    return [(number(c.name) if c.dtype is ColumnType.NUMERIC else F.col(f"`{c.name}`").cast("string")).alias(f"_k{i}") for i, c in enumerate(cols)]


def matches(real: DataFrame, synthetic: DataFrame, meta: Metadata) -> DataFrame:
    """-> n, matched: synthetic rows, and those that are also real rows. One shuffle of distinct rows, no join."""
    keys = row_key(meta)
    both = real.select(F.lit(1).alias("_r"), F.lit(0).alias("_s"), *keys).unionAll(synthetic.select(F.lit(0).alias("_r"), F.lit(1).alias("_s"), *keys))
    g = both.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.max("_r").alias("r"), F.sum("_s").alias("s"))
    return g.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("r") * F.col("s")), F.lit(0)).alias("matched"))


def group_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    key = [(number(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`")).alias(f"_g{i}") for i, c in enumerate(columns)]
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


# ---- association -----------------------------------------------------------------------------


def pearson(pair: DataFrame, columns: list[str]) -> DataFrame:
    """-> _side, a, b, value for numeric column pairs, from pairwise complete rows; null where undefined."""
    pairs = list(itertools.combinations(columns, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        ok = number(a).isNotNull() & number(b).isNotNull()
        x, y = F.when(ok, number(a)), F.when(ok, number(b))
        flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
        aggs.append(F.when(~flat, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))).alias(f"v{i}"))
    wide = pair.groupBy("_side").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"v{i}").alias("value")) for i, (a, b) in enumerate(pairs)])
    return wide.select("_side", F.explode(rows).alias("_v")).select("_side", "_v.*")


def contingency(pair: DataFrame, pairs: list[tuple[str, str]], cell: dict[str, Column]) -> DataFrame:
    """-> _side, a, b, u, v, n: counts of label pairs; one explode serves all column pairs. Null labels are left out.

    Rows are summed up by the number of their pair before they are shuffled; its names come in afterwards.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), cell[a].alias("u"), cell[b].alias("v")) for i, (a, b) in enumerate(pairs)])
    long = pair.select("_side", F.explode(cells).alias("_c")).select("_side", "_c.*").where("u is not null and v is not null")
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])[F.col("i")]
    return long.groupBy("_side", "i", "u", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("_p", names).select("_side", "_p.a", "_p.b", "u", "v", "n")


def entropies(table: DataFrame) -> DataFrame:
    """Contingency counts -> _side, a, b, hu, hv (entropies of the margins), huv (of the pairs), ku, kv (levels); no pair meets in one task."""
    pair, side = ("_side", "a", "b"), lambda c: c.cast("double") * F.log(c.cast("double"))
    out = table.groupBy(*pair).agg(F.sum("n").alias("t"), F.sum(side(F.col("n"))).alias("huv"))
    for c in "uv":
        margin = table.groupBy(*pair, c).agg(F.sum("n").alias("n")).groupBy(*pair)
        out = out.join(margin.agg(F.sum(side(F.col("n"))).alias(f"h{c}"), F.count(F.lit(1)).alias(f"k{c}")), list(pair))
    h = lambda c: F.greatest(F.log("t") - F.col(c) / F.col("t"), F.lit(0.0)).alias(c)
    return out.select(*pair, h("hu"), h("hv"), h("huv"), "ku", "kv")


def cramers_v(pair: DataFrame, columns: list[str]) -> DataFrame:
    """-> _side, a, b, value: without bias or continuity correction; null where a side has one level only."""
    table = contingency(pair, list(itertools.combinations(columns, 2)), {c: plain_label(c) for c in columns})
    margin = lambda c: F.sum("n").over(Window.partitionBy("_side", "a", "b", c))
    table = table.withColumns({"nu": margin("u"), "nv": margin("v")})
    # chi2 = t * (sum n^2 / (nu nv) - 1), so empty cells need no rows
    g = table.groupBy("_side", "a", "b").agg(
        F.sum(F.col("n").cast("double") * F.col("n") / (F.col("nu").cast("double") * F.col("nv"))).alias("q"),
        F.countDistinct("u").alias("k"), F.countDistinct("v").alias("l"),
    )
    v = F.sqrt(F.greatest(F.col("q") - 1, F.lit(0.0)) / (F.least("k", "l") - 1))
    return g.select("_side", "a", "b", F.when((F.col("k") > 1) & (F.col("l") > 1), v).alias("value"))


def correlation_ratio(pair: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``pairs`` (category, number) -> _side, a, b, value: sqrt of the between-group share of the sum of squares.

    Mean and total take every number; groups take those with a category. Null where undefined.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("a"), F.lit(x).alias("b"), plain_label(c).alias("u"), number(x).alias("x")) for c, x in pairs])
    long = pair.select("_side", F.explode(cells).alias("_c")).select("_side", "_c.*").where("x is not null")
    g = long.groupBy("_side", "a", "b", "u").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    every = Window.partitionBy("_side", "a", "b")
    g = g.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(every) / F.sum("n").over(every))
    between = F.sum(F.when(F.col("u").isNotNull(), F.col("n") * (F.col("m") - F.col("mean")) ** 2))
    total = F.sum(F.col("n") * (F.col("v") + (F.col("m") - F.col("mean")) ** 2))
    levels = F.count("u")
    flat = F.min("lo") == F.max("hi")
    return g.groupBy("_side", "a", "b").agg(F.when((levels > 1) & ~flat, F.sqrt(F.try_divide(between, total))).alias("value"))
