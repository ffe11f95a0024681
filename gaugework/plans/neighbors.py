"""Shared encoding, exact nearest neighbours over the parts of a k-d tree, and sums over a grid of blocks.

Neither side is broadcast and no pair of rows is ever a row of a DataFrame: both sides are cut into
parts of bounded size, a query meets only the parts that can hold one of its k nearest, and a last
aggregation merges them. Sums over all pairs compare every pair of blocks.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import saved
from ..schema import Metadata, label, number
from . import kernels

BLOCK, LEAF, CHUNK = 16_384, 64, 128
_ROOT = str(Path(__file__).resolve().parents[2])


def workers_can_import(spark) -> None:
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


@dataclass(frozen=True)
class Space:
    """How distances are taken: number columns, label columns, and for Gower the ranges of the numbers."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    ranges: tuple[float | None, ...] | None = None  # None: euclidean

    @property
    def width(self) -> int:
        return len(self.numeric) + len(self.categorical)


def encode(pair: DataFrame, meta: Metadata, id_column: str, numeric: list[str] | None = None, categorical: list[str] | None = None) -> tuple[DataFrame, Space]:
    """-> _side, _id, f0.. (numbers, standardised over all sides after null became 0), g0.. (labels).

    Labels stay labels: two different ones add 2 to a squared distance, as one-hot columns would.
    """
    num, cat = numeric if numeric is not None else meta.numeric, categorical if categorical is not None else meta.categorical
    filled = pair.select("_side", F.col(f"`{id_column}`").cast("long").alias("_id"), *[F.coalesce(number(c), F.lit(0.0)).alias(f"f{i}") for i, c in enumerate(num)], *[label(c).alias(f"g{i}") for i, c in enumerate(cat)])
    if num:
        s = filled.agg(*[f(f"f{i}").alias(f"{n}{i}") for i in range(len(num)) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        scaled = {f"f{i}": (F.col(f"f{i}") - F.lit(s[f"m{i}"])) / F.lit(s[f"s{i}"]) if s[f"s{i}"] else F.lit(0.0) for i in range(len(num))}
        filled = filled.withColumns(scaled)
    return filled, Space(tuple(f"f{i}" for i in range(len(num))), tuple(f"g{i}" for i in range(len(cat))))


def gower(pair: DataFrame, meta: Metadata, id_column: str, numeric: list[str] | None = None, categorical: list[str] | None = None) -> tuple[DataFrame, Space]:
    """-> _side, _id, f0.. (raw numbers or null), g0.. (labels); ranges are those of the whole real side."""
    num, cat = numeric if numeric is not None else meta.numeric, categorical if categorical is not None else meta.categorical
    p = {r["column"]: r for r in kernels.profile(pair.where("_side = 'r'"), num).collect()} if num else {}
    num = [c for c in num if c in p and p[c]["lo"] is not None and math.isfinite(p[c]["hi"] - p[c]["lo"])]
    rows = pair.select("_side", F.col(f"`{id_column}`").cast("long").alias("_id"), *[number(c).alias(f"f{i}") for i, c in enumerate(num)], *[label(c).alias(f"g{i}") for i, c in enumerate(cat)])
    return rows, Space(tuple(f"f{i}" for i in range(len(num))), tuple(f"g{i}" for i in range(len(cat))), tuple(p[c]["hi"] - p[c]["lo"] for c in num))


def cap(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n rows, those with the least md5 of seed and id: the same rows in any layout."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_id").cast("string")).cast("binary")), "_id").limit(n)


Arrays = dict[str, np.ndarray]


def arrays(t: pa.Table) -> Arrays:
    """The columns in the order of the ids."""
    got = {c: t.column(c).to_numpy() for c in t.column_names}
    order = np.argsort(got["_id"], kind="stable")
    return {c: v[order] for c, v in got.items()}


def distances(space: Space, a: Arrays, b: Arrays, lo: int, hi: int) -> np.ndarray:
    """Distances of rows lo to hi of a to all of b."""
    out = np.zeros((hi - lo, len(b["_id"])))
    for i, c in enumerate(space.numeric):
        x, y = a[c], b[c]
        d = x[lo:hi, None] - y[None, :]
        if space.ranges is None:
            out += d * d
        elif space.ranges[i]:
            out += np.nan_to_num(np.minimum(np.abs(d) / space.ranges[i], 1.0))
        else:
            out += np.nan_to_num(np.where(np.isnan(d), np.nan, d != 0))
    for c in space.categorical:
        x, y = a[c], b[c]
        out += (x[lo:hi, None] != y[None, :]) * (2.0 if space.ranges is None else 1.0)
    return np.sqrt(out) if space.ranges is None else out / max(1, space.width)


def _codes(rows: DataFrame, space: Space, more: list[str]) -> DataFrame:
    """Labels as 64-bit codes; nulls of numbers as NaN. Every column is new, as a cogroup of two parts of one table needs."""
    return rows.select((F.col("_id") + F.lit(0)).alias("_id"), *[F.coalesce(F.col(c), F.lit(float("nan"))).alias(c) for c in space.numeric], *[F.xxhash64(c).alias(c) for c in space.categorical], *more)


Boxes = dict[str, tuple[np.ndarray, np.ndarray]]


def _cut(space: Space, a: Arrays, at: np.ndarray) -> tuple[str, float, np.ndarray] | None:
    """The column, the value and the rows up to it that halve the rows ``at`` where they lie widest apart; None if all are alike."""
    best, column = 0.0, None
    for i, c in enumerate((*space.numeric, *space.categorical)):
        x = a[c][at]
        label_like = i >= len(space.numeric)
        if not label_like and 0 < (n := int(np.isnan(x).sum())):
            if n < len(x):
                return c, -np.inf, np.isnan(x)
            continue
        lo, hi = x.min(), x.max()
        if lo == hi:
            continue
        if space.ranges is None:
            wide = math.sqrt(2.0) if label_like else float(hi - lo)
        else:
            wide = 1.0 if label_like or not space.ranges[i] else min(float(hi - lo) / space.ranges[i], 1.0)
        if wide > best:
            best, column = wide, c
    if column is None:
        return None
    x = a[column][at]
    v = np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]
    if v == x.max():
        v = x[x < v].max()
    return column, v, x <= v


def _leaves(space: Space, a: Arrays, most: int) -> tuple[list[np.ndarray], list[tuple]]:
    """Rows in leaves of at most ``most``, unless they are alike; and the tree: (column, value, low, high) a node, where ~i is leaf i."""
    leaves: list[np.ndarray] = []
    tree: list[tuple] = []
    todo = [(np.arange(len(a["_id"])), -1, 0)]
    while todo:
        at, parent, side = todo.pop()
        cut = _cut(space, a, at) if len(at) > most else None
        if cut is None:
            place = ~len(leaves)
            leaves.append(at)
        else:
            place = len(tree)
            tree.append((cut[0], cut[1], None, None))
            todo += [(at[~cut[2]], place, 3), (at[cut[2]], place, 2)]
        if parent >= 0:
            tree[parent] = tuple(place if i == side else v for i, v in enumerate(tree[parent]))
    return leaves, tree


def _part(tree: list[tuple], a: Arrays, n: int) -> np.ndarray:
    """The leaf of each row."""
    out = np.zeros(n, np.int32)
    todo = [(0, np.arange(n))] if tree else []
    while todo:
        node, at = todo.pop()
        column, v, low, high = tree[node]
        x = a[column][at]
        left = (x <= v) | np.isnan(x) if x.dtype.kind == "f" else x <= v
        for place, rows in ((low, at[left]), (high, at[~left])):
            if place >= 0:
                todo.append((place, rows))
            else:
                out[rows] = ~place
    return out


def _open(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A box with a missing number has no bound there."""
    return (np.where(np.isnan(lo), -np.inf, lo), np.where(np.isnan(hi), np.inf, hi)) if lo.dtype.kind == "f" else (lo, hi)


def _boxes(space: Space, a: Arrays, leaves: list[np.ndarray]) -> Boxes:
    order = np.concatenate(leaves)
    start = np.cumsum([0, *map(len, leaves[:-1])])
    return {c: _open(*(f.reduceat(a[c][order], start) for f in (np.minimum, np.maximum))) for c in (*space.numeric, *space.categorical)}


def _bounds(space: Space, a: Boxes, b: Boxes) -> np.ndarray:
    """No row of a box of ``a`` is nearer to a row of a box of ``b``. The sums are those of ``distances`` over lesser terms, so rounding keeps their order."""
    out: np.ndarray | float = 0.0
    for i, c in enumerate(space.numeric):
        (al, ah), (bl, bh) = a[c], b[c]
        gap = np.fmax(np.fmax(bl[None, :] - ah[:, None], al[:, None] - bh[None, :]), 0.0)
        out = out + (gap * gap if space.ranges is None else np.minimum(gap / space.ranges[i], 1.0) if space.ranges[i] else (gap > 0) * 1.0)
    for c in space.categorical:
        (al, ah), (bl, bh) = a[c], b[c]
        out = out + ((bl[None, :] > ah[:, None]) | (bh[None, :] < al[:, None])) * (2.0 if space.ranges is None else 1.0)
    return np.sqrt(out) if space.ranges is None else out / max(1, space.width)


def _search(space: Space, a: Arrays, b: Arrays, k: int, limit: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest points of ``b`` (by distance, then id) for each of ``a`` that lie within ``limit``: distances (inf: none), ids, counts.

    Leaves are taken nearest first, until their boxes lie beyond the k-th distance of all rows of a leaf of ``a``.
    """
    n = len(a["_id"])
    near, who, many = np.full((n, k), np.inf), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
    if not n or not len(b["_id"]):
        return near, who, many
    mine, others = (_leaves(space, x, LEAF)[0] for x in (a, b))
    boxes = _boxes(space, b, others)
    columns = ("_id", "_n", *space.numeric, *space.categorical)
    for at in mine:
        q = {c: a[c][at] for c in columns}
        bound = _bounds(space, _boxes(space, q, [np.arange(len(at))]), boxes)[0]
        order = np.argsort(bound, kind="stable")
        d, ids, n_of = near[at], who[at], many[at]
        for first in range(0, len(order), 4):
            if bound[order[first]] > np.minimum(limit[at], d[:, -1]).max():
                break
            rows = np.sort(np.concatenate([others[j] for j in order[first : first + 4]]))  # b is in the order of its ids
            t = {c: b[c][rows] for c in columns}
            gap, count = distances(space, q, t, 0, len(at)), np.broadcast_to(t["_n"], (len(at), len(rows)))
            if own:
                same = q["_id"][:, None] == t["_id"][None, :]
                count = count - same
                gap[count == 0] = np.inf
            line = np.arange(len(at))
            for _ in range(min(k, len(rows))):
                j = gap.argmin(axis=1)  # of equal ones that with the least id
                d, ids, n_of = (np.column_stack([x, y]) for x, y in ((d, gap[line, j]), (ids, t["_id"][j]), (n_of, count[line, j])))
                gap[line, j] = np.inf
            best = np.lexsort((ids, d), axis=-1)[:, :k]
            d, ids, n_of = (np.take_along_axis(x, best, axis=1) for x in (d, ids, n_of))
        near[at], who[at], many[at] = d, ids, n_of
    return near, who, many


def _points(codes: DataFrame, columns: list[str]) -> DataFrame:
    """Rows alike in all columns as one: its least _id, how many they are (_n)."""
    return codes.groupBy(*columns).agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))


def _renewed(d: DataFrame) -> DataFrame:
    return d.select(*[F.col(c).alias(c) for c in d.columns])


def _compared(q: DataFrame, t: DataFrame, space: Space, k: int, own: bool, block: int) -> DataFrame:
    """``q`` with ``c``, the nearest points (d, id, n) of ``t`` in its ``_part`` within ``_limit``, and ``_limit`` by them. Parts with many queries are dealt out."""
    deals = F.broadcast(q.groupBy("_part").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_deals")))  # a row a part
    q = q.join(deals, "_part").withColumn("_deal", F.pmod(F.xxhash64("_id"), "_deals").cast("int")).drop("_deals")
    t = _renewed(t).join(deals, "_part").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1))).drop("_deals")
    keep = [c for c in q.columns if c not in ("_deal", "_limit")]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = arrays(left), arrays(right)
        d, ids, n = _search(space, a, b, k, a["_limit"], own)
        there = np.isfinite(d)
        ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
        cells = pa.StructArray.from_arrays([pa.array(x[there]) for x in (d, ids, n)], ["d", "id", "n"])
        return pa.table({**{c: a[c] for c in keep}, "_limit": np.minimum(a["_limit"], d[:, -1]), "c": pa.ListArray.from_arrays(pa.array(ends), cells)})

    kinds = dict(q.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in keep], "_limit double", "c array<struct<d: double, id: bigint, n: bigint>>"])
    return _renewed(q).groupBy("_part", "_deal").cogroup(t.groupBy("_part", "_deal")).applyInArrow(compare, schema)


def knn(query: DataFrame, target: DataFrame, space: Space, k: int, *, exclude_self: bool = False, block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """-> _id, d (the k least distances, ascending), nn (id of the nearest; ties: the least id), keep.... ``exclude_self``: of a table to itself.

    Rows alike are compared once. A k-d tree, fitted on some of the target's points, cuts all of them into parts of
    about ``block``. Each query is compared within its own part, then with every part whose box is not farther
    than the k-th distance found there. The sample only shapes the parts; the result is exact with any.
    """
    spark = query.sparkSession
    workers_can_import(spark)
    columns = [*space.numeric, *space.categorical]
    codes, most = _codes(query, space, list(keep)), k + exclude_self
    t = saved(_points(_codes(target, space, []), columns), "points")
    n = t.count()
    parts, tree = math.ceil(n / block), []
    if parts > 1:
        share = math.ceil(n / max(20_000, 64 * parts))
        some = arrays(t.where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(share)) == 0).toArrow())
        tree = _leaves(space, some, max(most, math.ceil(len(some["_id"]) / parts)))[1]

    def placed(batches):
        for x in batches:
            a = {c: x.column(c).to_numpy(zero_copy_only=False) for c in columns}
            yield x.append_column("_part", pa.array(_part(tree, a, x.num_rows)))

    def parted(d: DataFrame) -> DataFrame:
        kinds = dict(d.dtypes)
        return saved(d.mapInArrow(placed, ", ".join([*[f"{c} {kinds[c]}" for c in d.columns], "_part int"])), "parts")

    t = parted(t)
    q = t if exclude_self else parted(_points(codes, columns))
    home = _compared(q.withColumn("_limit", F.lit(math.inf)), t, space, most, exclude_self, block)
    got = home.select("_id", "c")
    if tree:
        home = saved(home, "home")
        edge = t.groupBy("_part").agg(*[f(c).alias(f"{p}{c}") for c in columns for p, f in (("lo", F.min), ("hi", F.max))], *[F.max(F.isnan(c)).alias(f"nan{c}") for c in space.numeric]).toArrow()  # a row a part
        names, boxes = edge.column("_part").to_numpy(), {}
        for c in columns:
            lo, hi = (edge.column(f"{p}{c}").to_numpy() for p in ("lo", "hi"))
            if c in space.numeric:  # NaN is the largest number to Spark
                lost = edge.column(f"nan{c}").to_numpy()
                lo, hi = np.where(lost, -np.inf, lo), np.where(lost, np.inf, hi)
            boxes[c] = (lo, hi)
        rest = [c for c in home.columns if c != "c"]

        def reached(batches):
            for x in batches:
                for lo in range(0, x.num_rows, 4096):
                    y = x.slice(lo, 4096)
                    a = {c: y.column(c).to_numpy(zero_copy_only=False) for c in (*columns, "_part", "_limit")}
                    reach = _bounds(space, {c: _open(a[c], a[c]) for c in columns}, boxes) <= a["_limit"][:, None]
                    i, j = np.nonzero(reach & (a["_part"][:, None] != names[None, :]))
                    z = y.take(pa.array(i))
                    yield z.set_column(z.schema.get_field_index("_part"), "_part", pa.array(names[j], pa.int32()))

        kinds = dict(home.dtypes)
        far = saved(home.select(*rest).mapInArrow(reached, ", ".join(f"{c} {kinds[c]}" for c in rest)), "far")
        got = got.unionByName(_compared(far, t, space, most, exclude_self, block).select("_id", "c"))
        got = got.groupBy("_id").agg(F.flatten(F.collect_list("c")).alias("c"))
    got = got.select(F.col("_id").alias("_p"), F.array_sort("c").alias("c")).join(q.select(*columns, F.col("_id").alias("_p")), "_p")
    every = F.flatten(F.transform("c", lambda x: F.array_repeat(x["d"], F.least(x["n"], F.lit(k)).cast("int"))))
    got = codes.join(got, columns).select("_id", "_p", *keep, F.slice(every, 1, k).alias("d"), F.try_element_at("c", F.lit(1)).alias("_1"), F.try_element_at("c", F.lit(2)).alias("_2")).where(F.size("d") > 0)
    nn = F.col("_1.id")
    if exclude_self:  # a copy is named by the least id of its point, which may be the row's own
        second = codes.join(q.select(*columns, F.col("_id").alias("_p")), columns).where("_id <> _p").groupBy(F.col("_p").alias("_of")).agg(F.min("_id").alias("_next"))
        got = got.join(second, F.col("_p") == F.col("_of"), "left")
        nn = F.when(nn != F.col("_id"), nn).otherwise(F.least("_next", F.when(F.col("_2.d") == F.col("_1.d"), F.col("_2.id"))))
    return got.select("_id", "d", nn.alias("nn"), *keep)


def _grid(pool: DataFrame, n: int, compare, schema: str, block: int) -> DataFrame:
    """``compare(left, right, same)`` for each unordered pair of blocks of the n points of ``pool``; ``same``: a block and itself."""
    workers_can_import(pool.sparkSession)
    blocks = max(1, math.ceil(n / block))
    mine = F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")
    new = pool.select(*[F.col(c).alias(c) for c in pool.columns])
    a = pool.withColumn("_q", mine).withColumn("_t", F.explode(F.sequence(F.col("_q"), F.lit(blocks - 1))))
    b = new.withColumn("_t", mine).withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_t"))))

    def cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return compare(arrays(left), arrays(right), key[0].as_py() == key[1].as_py())

    return a.groupBy("_q", "_t").cogroup(b.groupBy("_q", "_t")).applyInArrow(cell, schema)


def pooled(rows: DataFrame, space: Space) -> tuple[DataFrame, dict[str, int]]:
    """Rows of sides r and s that are alike in all columns as one point: _id, _n (rows), _v (their sum of 1 / size of r less that of s); and the sizes."""
    sizes = {"r": 0, "s": 0} | {r["_side"]: r["count"] for r in rows.groupBy("_side").count().collect()}
    real = F.col("_side") == "r"
    codes = _codes(rows, space, [real.cast("long").alias("_r")])
    points = codes.groupBy(*space.numeric, *space.categorical).agg(F.min(F.struct("_id", "_r")).alias("_k"), F.count(F.lit(1)).alias("_n"), F.sum("_r").alias("_r"))
    v = F.col("_r") / F.lit(max(1, sizes["r"])) - (F.col("_n") - F.col("_r")) / F.lit(max(1, sizes["s"]))
    # the sides may use the same ids
    return points.select((F.col("_k._id") * 2 + F.col("_k._r")).alias("_id"), "_n", v.alias("_v"), *space.numeric, *space.categorical), sizes


def _bits(space: Space, a: Arrays, b: Arrays, same: bool):
    """Positive distances between the points of two blocks, each pair once, as integers of the same order; and the pairs of rows that have them."""
    for lo in range(0, len(a["_id"]), CHUNK):
        hi = min(len(a["_id"]), lo + CHUNK)
        d = distances(space, a, b, lo, hi)
        if same:
            d[np.arange(lo, hi)[:, None] >= np.arange(d.shape[1])[None, :]] = 0
        there = d > 0
        yield d[there].view(np.uint64), (a["_n"][lo:hi, None] * b["_n"][None, :])[there]


def pooled_median(pool: DataFrame, space: Space, n: int, block: int) -> float:
    """Exact median of the positive distances between all pairs of rows (1 if there are none).

    The bits of the two middle values are found 16 at a time by counting, so that no distance is stored.
    """

    def counts(found: list[int], shift: int) -> dict[int, dict[int, int]]:
        def compare(a: Arrays, b: Arrays, same: bool) -> pa.Table:
            total = {p: np.zeros(1 << 16, np.int64) for p in found}
            for x, n_of in _bits(space, a, b, same):
                for p in found:
                    mine = slice(None) if shift == 48 else (x >> np.uint64(shift + 16)) == np.uint64(p)
                    place = ((x[mine] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)
                    total[p] += np.bincount(place, weights=n_of[mine], minlength=1 << 16).astype(np.int64)  # whole numbers below 2 to the power of 53
            cells = [(p, i, int(c[i])) for p, c in total.items() for i in np.flatnonzero(c).tolist()]
            p, i, c = zip(*cells, strict=True) if cells else ((), (), ())
            return pa.table({"p": pa.array(p, pa.int64()), "i": pa.array(i, pa.int64()), "c": pa.array(c, pa.int64())})

        got: dict[int, dict[int, int]] = {p: {} for p in found}
        for r in _grid(pool, n, compare, "p long, i long, c long", block).groupBy("p", "i").agg(F.sum("c").alias("c")).collect():  # at most 65 536 a middle value
            got[r["p"]][r["i"]] = r["c"]
        return got

    middle: list[list[int]] = []
    for shift in (48, 32, 16, 0):
        got = counts(sorted({p for p, _ in middle}) or [0], shift)
        if not middle:
            total = sum(got[0].values())
            if not total:
                return 1.0
            middle = [[0, (total - 1) // 2], [0, total // 2]]
        for m in middle:
            of = got[m[0]]
            for i in sorted(of):
                if m[1] < of[i]:
                    m[0] = m[0] << 16 | i
                    break
                m[1] -= of[i]
    return float(np.array([p for p, _ in middle], np.uint64).view(np.float64).mean())


def kernel_sum(pool: DataFrame, space: Space, n: int, gamma: float, block: int) -> float:
    """Squared maximum mean discrepancy: the kernel's sum over all pairs of rows, weighted by 1 / n of its side and the sides' signs."""

    def compare(a: Arrays, b: Arrays, same: bool) -> pa.Table:
        v, w = a["_v"], b["_v"]
        total = 0.0
        for lo in range(0, len(v), CHUNK):
            hi = min(len(v), lo + CHUNK)
            d = distances(space, a, b, lo, hi)
            total += float(v[lo:hi] @ np.exp(-gamma * d * d) @ w)
        return pa.table({"k": [total if same else 2 * total]})

    return _grid(pool, n, compare, "k double", block).agg(F.sum("k").alias("k")).first()["k"] or 0.0


def kth(near: DataFrame, k: int) -> DataFrame:
    """-> _id, d: distance to the k-th neighbour (null if there are fewer)."""
    return near.select("_id", F.try_element_at("d", F.lit(k)).alias("d"))


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """-> auc: rank-sum area for ``positive`` (boolean) by ``score``, ties counted half. Distinct scores are ranked by distributed sums."""
    long = rows.select(F.when(F.col(positive), "r").otherwise("s").alias("_side"), F.lit("auc").alias("column"), F.col(score).cast("double").alias("x"))
    e = kernels.ecdf(long)
    below = F.sum(F.col("n_r") * (F.col("c_s") - F.col("n_s") / 2.0))
    return e.agg(F.try_divide(below, F.max(F.col("t_r").cast("double") * F.col("t_s").cast("double"))).alias("auc"))
