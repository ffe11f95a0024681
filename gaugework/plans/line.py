"""Sums over all pairs of rows that have one number at most, without visiting the pairs.

Where distances are euclidean over one number and some labels, d * d is dx * dx + 2 * (labels that differ).
Rows that agree in a set of labels, whatever the others are, lie on a line: along it pairs within a radius are
counted from sorted blocks, and the kernel is summed from moments of short cells. Inclusion and exclusion over
the sets of labels gives back the pairs that differ in exactly m. The cost follows the rows, not their pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import saved
from .neighbors import Space, arrays, distances, workers_can_import

#: Points of a sorted block; labels at most (2 to their power sets are looked at); points from which the first bounds are guessed.
BLOCK, LABELS, GUESS = 32_768, 4, 2000
#: Terms of a cell's expansion, and the distance (in units of 1 / sqrt(gamma)) from which the kernel is below 1e-18.
TERMS, FAR = 28, 6.5
SUPER = 1024


def on_a_line(pool: DataFrame, space: Space) -> bool:
    if space.ranges is not None or len(space.numeric) > 1 or len(space.categorical) > LABELS:
        return False
    size = F.abs(_x(space))
    least, most = pool.agg(F.min(F.when(size > 0, size)), F.max(size)).first()  # NaN is the largest number to Spark
    return most is not None and most < 1e100 and (least is None or least > 1e-100)  # squares neither vanish nor overflow


def _x(space: Space) -> Column:
    return F.col(space.numeric[0]) if space.numeric else F.lit(0.0)


def _levels(d: DataFrame, space: Space) -> DataFrame:
    """Each row once for every set of labels: ``_k``, the set's size, ``_s``, the set, and 0 for labels outside it."""
    c = space.categorical
    sets = [F.struct(F.lit(s).alias("_s"), F.lit(s.bit_count()).alias("_k"), *[(F.col(g) if s >> i & 1 else F.lit(0).cast("long")).alias(g) for i, g in enumerate(c)]) for s in range(1 << len(c))]
    rest = [x for x in d.columns if x not in c]
    return d.select(*rest, F.explode(F.array(*sets)).alias("_l")).select("_l.*", *rest)


def _distance(dx, m: int):
    """The distance of rows ``dx`` apart that differ in m labels, added up as ``distances`` does."""
    d = dx * dx
    for _ in range(m):
        d = d + 2.0
    return np.sqrt(d)


def _radius(t: float, m: int) -> float:
    """The largest dx whose distance is at most t; -1 if there is none."""
    if _distance(np.float64(0.0), m) > t:
        return -1.0
    lo, hi = 0, int(np.float64(np.inf).view(np.int64))  # bits of numbers from 0 on have their order
    while lo < hi:
        mid = (lo + hi + 1) // 2
        with np.errstate(over="ignore"):
            lo, hi = (mid, hi) if _distance(np.int64(mid).view(np.float64), m) <= t else (lo, mid - 1)
    return float(np.int64(lo).view(np.float64))


def _weight(k: int, m: int, labels: int) -> int:
    """How often pairs that agree in a set of k labels count among those that differ in exactly m."""
    j = labels - m
    return (-1) ** (k - j) * math.comb(k, j) if j <= k else 0


def _within(x: np.ndarray, n: np.ndarray, y: np.ndarray, total: np.ndarray, r: float, own: bool) -> tuple[int, float, float]:
    """Pairs of rows of two sorted blocks (``own``: of one) at most r apart, y after x; the widest of them and the narrowest other (dx)."""
    first = np.arange(1, len(x) + 1) if own else np.zeros(len(x), np.int64)
    at = np.maximum(np.searchsorted(y, x + r, side="right"), first)
    while True:  # x + r is rounded, y - x decides
        more = (at < len(y)) & (y[np.minimum(at, len(y) - 1)] - x <= r)
        less = (at > first) & (y[np.maximum(at - 1, 0)] - x > r)
        if not (more.any() or less.any()):
            break
        at = at + more - less
    there, beyond = at > first, at < len(y)
    down = float((y[at[there] - 1] - x[there]).max()) if there.any() else -math.inf
    up = float((y[at[beyond]] - x[beyond]).min()) if beyond.any() else math.inf
    return int((n * (total[at] - total[first])).sum()), down, up


def _count(x: np.ndarray, n: np.ndarray, y: np.ndarray, w: np.ndarray, own: bool, m: int, ts: list[float], radii: list[float]) -> Iterable[tuple[int, float, float]]:
    """For each of ``ts``: pairs up to it, the largest distance up to it and the least beyond."""
    total = np.concatenate([[0], np.cumsum(w)])
    same = int((n * (n - 1) // 2).sum()) if own else 0  # rows of one point
    zero = float(_distance(np.float64(0.0), m))
    for r in radii:
        if r < 0:
            yield 0, -math.inf, zero if own else float(_distance(y[0] - x[-1], m))
        elif not own and y[0] - x[-1] > r:
            yield 0, -math.inf, float(_distance(y[0] - x[-1], m))
        elif not own and y[-1] - x[0] <= r:
            yield int(n.sum() * total[-1]), float(_distance(y[-1] - x[0], m)), math.inf
        else:
            found, down, up = _within(x, n, y, total, r, own)
            if own:
                down = max(down, 0.0)
            yield found + same, float(_distance(down, m)) if down >= 0 else -math.inf, float(_distance(up, m))


def _blocks(pool: DataFrame, space: Space, n: int, block: int) -> DataFrame:
    """Points of a set of labels in sorted blocks of about ``block``: _s, _k, labels, _b, lo, hi, rows, x (array), w (array: rows of each)."""
    key, labels = ["_s", "_k", *space.categorical], list(space.categorical)
    parts, edges = math.ceil(n / block), np.empty(0)
    if parts > 1:
        edges = np.array(pool.agg(F.percentile_approx(_x(space), [i / parts for i in range(1, parts)], max(10_000, 8 * parts))).first()[0])

    def placed(batches):
        for t in batches:
            yield t.append_column("_cut", pa.array(np.searchsorted(edges, t.column("_x").to_numpy()), pa.int64()))

    level = _levels(pool.select(*labels, _x(space).alias("_x"), "_n").mapInArrow(placed, ", ".join([*[f"{c} long" for c in labels], "_x double, _n long, _cut long"])), space)
    # a group of more than a block takes as many of the cuts as it has blocks; at most n / block groups of a set do
    wide = _levels(pool.groupBy(*labels).agg(F.count(F.lit(1)).alias("_of")), space).groupBy(*key).agg(F.ceil(F.sum("_of") / block).cast("long").alias("_of")).where("_of > 1")
    at = F.expr(f"CAST(_cut * coalesce(_of, 1) div {parts} AS INT)")
    names = [*key, "_b"]
    # points of one number are one before they are dealt out, however many labels they have
    rows = level.join(F.broadcast(wide), key, "left").withColumn("_b", at).groupBy(*names, "_x").agg(F.sum("_n").alias("_n")).repartition(*names).sortWithinPartitions(*names, "_x")

    def gathered(t: pa.Table) -> pa.RecordBatch:
        keys = {c: t.column(c).to_numpy() for c in names}
        x, w, new = t.column("_x").to_numpy(), t.column("_n").to_numpy(), np.zeros(t.num_rows, bool)
        new[0] = True
        for v in keys.values():
            new[1:] |= v[1:] != v[:-1]
        first = np.flatnonzero(new)
        ends = np.append(first, len(x))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v)) for v in (x, w)]
        return pa.RecordBatch.from_arrays([*[pa.array(v[first]) for v in keys.values()], pa.array(x[first]), pa.array(x[ends[1:] - 1]), pa.array(np.add.reduceat(w, first)), *lists], [*names, "lo", "hi", "rows", "x", "w"])

    def cut(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            last = np.ones(t.num_rows, bool)
            for c in names:
                v = t.column(c).to_numpy()
                last &= v == v[-1]
            done = t.num_rows - int(last.sum())  # the last block may go on
            if done:
                yield gathered(t.slice(0, done))
            rest = t.slice(done)
        if rest is not None:
            yield gathered(rest)

    schema = ", ".join(["_s int, _k int", *[f"{c} long" for c in labels], "_b int, lo double, hi double, rows long, x array<double>, w array<long>"])
    return saved(rows.mapInArrow(cut, schema), "blocks")


class _Counts:
    """Pairs of rows up to given distances, between two bounds. Pairs of blocks that lie on one side of both are counted by their sizes, the others kept."""

    def __init__(self, blocks: DataFrame, pairs: DataFrame, space: Space, lo: float, hi: float):
        self.labels, key = len(space.categorical), ["_s", "_k", *space.categorical]
        inside = {m: (_radius(lo, m), _radius(hi, m)) for m in range(self.labels + 1)}
        crossed, whole = F.lit(False), F.lit(0).cast("long")
        for k in range(self.labels + 1):
            for m in range(self.labels - k, self.labels + 1):
                r, far = inside[m]
                crossed = crossed | ((F.col("_k") == k) & (F.col("near") <= far) & (F.col("wide") > r))
                whole = whole + F.when((F.col("_k") == k) & (F.col("wide") <= r), F.col("all") * _weight(k, m, self.labels)).otherwise(0)
        got = pairs.agg(F.sum(F.when(~crossed, whole)).alias("sure"), F.sum(crossed.cast("long")).alias("open")).first()
        self.sure = got["sure"] or 0
        spark = blocks.sparkSession
        a = blocks.select(*key, F.col("_b").alias("_a"), F.col("x").alias("xa"), F.col("w").alias("wa"))
        b = blocks.select(*key, "_b", F.col("x").alias("xb"), F.col("w").alias("wb"))
        tasks = max(3 * spark.sparkContext.defaultParallelism, math.ceil((got["open"] or 0) / 64))
        open_ = pairs.where(crossed).select(*key, "_a", "_b").join(a, [*key, "_a"]).join(b, [*key, "_b"])
        self.open = saved(open_.select("_k", "_a", "_b", "xa", "wa", "xb", "wb", *space.categorical).repartition(tasks, *space.categorical, "_k", "_a", "_b").drop(*space.categorical), "open")

    def at(self, ts: list[float]) -> dict[float, tuple[int, float, float]]:
        """Pairs up to each of ``ts``, the largest distance up to it and the least beyond (or others between them that no pair has)."""
        labels, radii = self.labels, {m: [_radius(t, m) for t in ts] for m in range(self.labels + 1)}

        def count(batches):
            total = [[0, -math.inf, math.inf] for _ in ts]
            for batch in batches:
                k, a, b, xa, wa, xb, wb = (batch.column(c) for c in ("_k", "_a", "_b", "xa", "wa", "xb", "wb"))
                for i in range(batch.num_rows):
                    lines = [c[i].values.to_numpy() for c in (xa, wa, xb, wb)]
                    for m in range(labels - k[i].as_py(), labels + 1):
                        times = _weight(k[i].as_py(), m, labels)
                        for out, (n, down, up) in zip(total, _count(*lines, a[i].as_py() == b[i].as_py(), m, ts, radii[m]), strict=True):
                            out[:] = out[0] + times * n, max(out[1], down), min(out[2], up)
            n, down, up = zip(*total, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(ts)), pa.int32()), pa.array(n, pa.int64()), pa.array(down, pa.float64()), pa.array(up, pa.float64())], ["i", "n", "down", "up"])

        got = self.open.mapInArrow(count, "i int, n long, down double, up double").groupBy("i").agg(F.sum("n").alias("n"), F.max("down").alias("down"), F.min("up").alias("up")).collect()
        found = {r["i"]: r for r in got}
        return {t: (self.sure + r["n"], r["down"], r["up"]) if (r := found.get(i)) else (self.sure, -math.inf, math.inf) for i, t in enumerate(ts)}


def _guess(pool: DataFrame, space: Space, n: int) -> tuple[float, float]:
    """Bounds that most likely hold the median, from some points. Whether they do is counted; they only save work."""
    some = pool.where(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(math.ceil(n / GUESS))) == 0)
    a = arrays(some.toArrow())
    if len(a["_id"]) < 2:
        return 0.0, math.inf
    upper = np.triu_indices(len(a["_id"]), 1)
    d = distances(space, a, a, 0, len(a["_id"]))[upper]
    w = (a["_n"][:, None] * a["_n"][None, :])[upper]
    d, w = d[d > 0], w[d > 0]
    if not len(d):
        return 0.0, math.inf
    order = np.argsort(d)
    share = np.cumsum(w[order]) / w.sum()
    lo, hi = (float(d[order[min(len(d) - 1, np.searchsorted(share, p))]]) for p in (0.48, 0.52))
    return float(np.nextafter(lo, 0)), hi


def _between(a: float, b: float, share: float) -> list[float]:
    """Distances from a to below b to be counted next: about where the counts point to, and such as halve the numbers between."""
    low, high = (int(np.float64(v).view(np.int64)) for v in (a, b))
    wide = b - a if math.isfinite(b) else 0.0
    near = [a + wide * min(max(share + e, 0.0), 1.0) for e in (-1 / 16, -1 / 512, 0.0, 1 / 512, 1 / 16)]
    near += [a, a + wide / 2, float(np.int64((low + high) // 2).view(np.float64))]
    return sorted({min(max(t, a), float(np.nextafter(b, 0))) for t in near})


def median(pool: DataFrame, space: Space, n: int, block: int = BLOCK) -> float:
    """Exact median of the positive distances between all pairs of rows (1 if there are none), by counting pairs up to ever closer bounds."""
    workers_can_import(pool.sparkSession)
    rows, zero = pool.agg(F.sum("_n"), F.sum(F.expr("_n * (_n - 1) div 2"))).first()
    positive = (rows or 0) * ((rows or 0) - 1) // 2 - (zero or 0)
    if positive <= 0:
        return 1.0
    blocks = _blocks(pool, space, n, block)
    key = ["_s", "_k", *space.categorical]
    meta = blocks.select(*key, "_b", "lo", "hi", "rows")
    left = meta.select(*key, *[F.col(c).alias(f"{c}a") for c in ("_b", "lo", "hi", "rows")])
    own = F.col("_ba") == F.col("_b")
    pairs = left.join(meta, key).where("_ba <= _b").select(
        *key, F.col("_ba").alias("_a"), "_b", F.when(own, 0.0).otherwise(F.col("lo") - F.col("hia")).alias("near"), (F.col("hi") - F.col("loa")).alias("wide"),
        F.when(own, F.expr("rows * (rows - 1) div 2")).otherwise(F.col("rows") * F.col("rowsa")).alias("all"),
    )
    pairs = saved(pairs, "pairs")
    wanted = [zero + (positive - 1) // 2, zero + positive // 2]  # of all distances in order
    lo, hi = _guess(pool, space, n)
    counts = _Counts(blocks, pairs, space, lo, hi)
    known = counts.at([lo, hi])
    if not known[lo][0] <= wanted[0] <= wanted[1] < known[hi][0]:
        counts = _Counts(blocks, pairs, space, 0.0, math.inf)
        known = counts.at([0.0, math.inf])
    out = []
    for k in wanted:
        while True:
            lo, hi = max(t for t, v in known.items() if v[0] <= k), min(t for t, v in known.items() if v[0] > k)
            a, b = known[lo][2], known[hi][1]
            if a >= b:
                break
            known |= counts.at(_between(a, b, (k - known[lo][0]) / (known[hi][0] - known[lo][0])))
        out.append(b)
    return (out[0] + out[1]) / 2


def kernel_sum(pool: DataFrame, space: Space, gamma: float) -> float:
    """The sum of ``neighbors.kernel_sum`` from the moments of short cells, whose expansions are good to the last digits.

    exp(-gamma * d * d) is a product over the number and the labels; a label's factor is q = exp(-2 * gamma) plus, where
    it agrees, 1 - q. So each set of labels has the sum over a line of the rows that agree in it.
    """
    workers_can_import(pool.sparkSession)
    scale = math.sqrt(gamma)
    h = 2.0 ** math.floor(math.log2(0.5 / scale))  # cells' middles are exact
    reach = math.ceil(FAR / (scale * h)) + 1
    cell = F.floor(_x(space) / h).cast("long")
    u = (_x(space) - (cell.cast("double") + 0.5) * h) * scale
    names = [f"_m{i}" for i in range(TERMS)]
    cells = pool.select(*space.categorical, "_v", cell.alias("_c"), u.alias("_u")).groupBy(*space.categorical, "_c").agg(*[F.sum(F.col("_v") * F.pow("_u", F.lit(i)) / float(math.factorial(i))).alias(m) for i, m in enumerate(names)])
    key = ["_s", "_k", *space.categorical]
    cells = saved(_levels(cells, space).groupBy(*key, "_c").agg(*[F.sum(m).alias(m) for m in names]), "cells")
    lots = math.ceil(cells.count() / 8192) or 1
    # a cell meets those after it: the first of a run of cells also go to the run before
    home = F.floor(F.col("_c") / SUPER).cast("long")
    runs = F.when(F.pmod("_c", F.lit(SUPER)) <= reach, F.array(home, home - 1)).otherwise(F.array(home))
    cells = cells.withColumn("_r", F.explode(runs)).withColumn("_own", F.col("_r") == home).withColumn("_lot", F.pmod(F.xxhash64(*key, "_r"), F.lit(lots)).cast("int"))
    q = math.exp(-2 * gamma)
    groups = [*space.categorical, "_r"]
    hermite = {}
    for o in range(reach + 1):
        z = o * h * scale
        f = [math.exp(-z * z), 2 * z * math.exp(-z * z)]
        for i in range(1, TERMS - 1):
            f.append(2 * z * f[i] - 2 * i * f[i - 1])
        hermite[o] = np.array([[(-1) ** j * f[i + j] if i + j < TERMS else 0.0 for i in range(TERMS)] for j in range(TERMS)])

    def add(t: pa.Table) -> pa.Table:
        g = np.unique(np.column_stack([t.column(c).to_numpy() for c in groups]), axis=0, return_inverse=True)[1].ravel()
        c = t.column("_c").to_numpy()
        order = np.lexsort((c, g))
        g, c, own = g[order], c[order], t.column("_own").to_numpy()[order]
        m = np.column_stack([t.column(x).to_numpy() for x in names])[order]
        place = g * SUPER * 4 + c - t.column("_r").to_numpy()[order] * SUPER  # a run's cells and those after it lie within two runs
        total = 0.0
        for o, f in hermite.items():
            to = np.minimum(np.searchsorted(place, place + o), len(place) - 1)
            hit = own & (place[to] == place + o)
            # h(o + right - left), both from their middles
            total += (1 if o == 0 else 2) * float(np.einsum("ij,ij->", m[to[hit]] @ f, m[hit]))
        return pa.table({"_k": pa.array([int(t.column("_k")[0].as_py())], pa.int32()), "sum": [total]})

    sums = cells.groupBy("_s", "_lot").applyInArrow(add, "_k int, sum double").groupBy("_k").agg(F.sum("sum").alias("sum")).collect()
    c = len(space.categorical)
    return math.fsum(q ** (c - r["_k"]) * (1 - q) ** r["_k"] * r["sum"] for r in sums)
