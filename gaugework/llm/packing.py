"""Best-fit packing with Martello-Toth dominance reduction, on the histogram of lengths.

Only lengths matter to a bin, and there are at most ``capacity`` of them, so the instance is a table
of counts whose size does not depend on the corpus. The driver reduces it (sets that provably
dominate every alternative for their largest member are fixed, many at a time), fits the remainder
best-fit by falling length, and gets bin patterns with multiplicities. Each piece then finds its
place from its rank among the pieces of its length, which is a distributed prefix sum.

Defined cases: null text is an empty document of one end token; null ids and repeated rows are
packed like any other; rows alike in all of id, piece and content are interchangeable; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scale, tokens
from ._words import chunks

CAPACITY, END = 2048, 0
Pattern = tuple[tuple[int, ...], int]


def _largest(count: np.ndarray, most: int) -> int:
    at = np.flatnonzero(count[: most + 1])
    return int(at[-1]) if most > 0 and len(at) else 0


def _smallest(count: np.ndarray, n: int) -> list[int]:
    out: list[int] = []
    for v in np.flatnonzero(count)[:n]:
        out += [int(v)] * int(min(n, count[v]))
    return out[:n]


def _best_pair(count: np.ndarray, room: int) -> int:
    """The largest sum of two items that is at most ``room`` (0: none)."""
    v = np.flatnonzero(count[: room + 1])
    best, hi = 0, len(v) - 1
    for lo in range(len(v)):
        while hi >= lo and v[lo] + v[hi] > room:
            hi -= 1
        if hi < lo:
            break
        if hi > lo or count[v[lo]] > 1:
            best = max(best, int(v[lo] + v[hi]))
        elif hi > 0 and lo < hi:
            best = max(best, int(v[lo] + v[hi - 1]))
    return best


def _least_of_pair(count: np.ndarray, room: int) -> int:
    """The largest y such that some pair x >= y fits in ``room`` (0: none)."""
    v = np.flatnonzero(count[: room + 1])
    for i in range(len(v) - 1, -1, -1):
        y = int(v[i])
        if 2 * y <= room and count[y] > 1 or i + 1 < len(v) and y + int(v[i + 1]) <= room:
            return y
    return 0


def reduce_dominating(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Fix sets that dominate all others for their largest member; ``count`` is left with the rest.

    With room R beside item j, and k the largest item that fits:
    alone, if nothing fits; {j, k}, if k fills R, if no two items fit, or if no three fit and k is at
    least every pair that fits; {j, k, b}, if no three fit, b is the largest beside k, and the lesser
    item of every pair that fits is at most b. Taking items away keeps each of these true, so a set
    is fixed as often as its items last.
    """
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for j in range(capacity, 0, -1):
            while count[j]:
                room = capacity - j
                count[j] -= 1
                few, k = _smallest(count, 3), _largest(count, room)
                chosen: tuple[int, ...] | None = None
                if not k:
                    chosen = (j,)
                elif k == room or sum(few[:2]) > room or len(few) < 2:
                    chosen = (j, k)
                elif len(few) < 3 or sum(few) > room:
                    if k >= _best_pair(count, room):
                        chosen = (j, k)
                    else:
                        count[k] -= 1
                        b = _largest(count, room - k)
                        count[k] += 1
                        if b and b >= _least_of_pair(count, room):
                            chosen = (j, k, b)
                count[j] += 1
                if chosen is None:
                    break
                need = {x: chosen.count(x) for x in chosen}
                times = min(int(count[x]) // n for x, n in need.items())
                for x, n in need.items():
                    count[x] -= n * times
                fixed.append((chosen, times))
                again = True
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit by falling length; bins with the same content are held as one entry with a count."""
    open_bins: dict[int, list[Pattern]] = {}
    for size in range(capacity, 0, -1):
        n = int(count[size])
        while n:
            room = min((r for r, g in open_bins.items() if r >= size and g), default=0)
            if room:
                inside, m = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            else:
                room, inside, m = capacity, (), n
            fit = room // size
            full = min(m, n // fit)
            if full:
                open_bins.setdefault(room - fit * size, []).append((inside + (size,) * fit, full))
                n -= fit * full
            if full < m and 0 < n < fit:
                open_bins.setdefault(room - n * size, []).append((inside + (size,) * n, 1))
                full, n = full + 1, 0
            if full < m and inside:
                open_bins.setdefault(room, []).append((inside, m - full))
    return [x for g in open_bins.values() for x in g]


def plan_bins(sizes: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Counts by length (1 to ``capacity``) -> bin contents and how often each."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in sizes.items():
        count[length] = n
    return reduce_dominating(count, capacity) + best_fit(count, capacity)


def _slots(plan: list[Pattern]) -> tuple[np.ndarray, ...]:
    """For each length, runs of ranks: (length, first rank) sorted, first bin, pieces a bin, offset in it."""
    rows, base, used = [], 0, {}
    for inside, times in plan:
        offset = 0
        for size in sorted(set(inside), reverse=True):
            m = inside.count(size)
            rows.append((size, used.get(size, 0), base, m, offset))
            used[size] = used.get(size, 0) + m * times
            offset += m * size
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return (table[:, 0] << 44 | table[:, 1], table[:, 2], table[:, 3], table[:, 4])


def pack(pieces: DataFrame, *, keys: list[str], capacity: int = CAPACITY, seed: str = "pack-") -> DataFrame:
    """``pieces`` with a ``length`` of 1 to ``capacity`` -> sequence_id and offset beside all columns.

    ``keys`` identify a piece; the order within a length is random by their hash.
    """
    spark = pieces.sparkSession
    _scale.workers_can_import(spark)
    pieces = _scale.saved(pieces, "pieces")
    sizes = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    slots = spark.sparkContext.broadcast(_slots(plan_bins(sizes, capacity)))  # a few runs for each length
    key = F.md5(F.concat_ws("/", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in keys]).cast("binary"))
    rows = pieces.withColumn("_key", key)
    ties = [F.col(c) for c in pieces.columns]
    ranked = _scale.prefix_sums(rows, "length", "_key", ties, F.lit(1), _scale.bits_for(sum(sizes.values())), "_rank").drop("_key")
    out = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        start, first, many, offset = slots.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(start, length << 44 | rank, side="right") - 1
            k = rank - (start[at] & ((1 << 44) - 1))
            cols = [batch.column(n) for n in out.names[:-2]] + [pa.array(first[at] + k // many[at]), pa.array(offset[at] + k % many[at] * length)]
            yield pa.RecordBatch.from_arrays(cols, out.names)

    return _scale.map_arrow(ranked, place, out)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every whole text's ids and the end id, cut at ``capacity``: doc_id, piece, start, length, ids_crc32 (and the ids)."""
    _scale.workers_can_import(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        encode, step, end = tokens.encoder(tokenizer).encode_all, 4 * capacity, END.to_bytes(4, "little")
        for batch, data in chunks(batches, "text"):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(data), strict=True):
                ids += end
                rows += [(doc, p, p * capacity, len(x := ids[p * step : (p + 1) * step]) // 4, zlib.crc32(x), x if with_ids else None) for p in range(-(-len(ids) // step))]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: len(names)], names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return _scale.map_arrow(docs.select("doc_id", "text"), run, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    pieces = token_pieces(docs, tokenizer or tokens.public_path("word_bpe_49k.json"), capacity, with_ids)
    return pack(pieces, keys=["doc_id", "piece"], capacity=capacity)


def op4_pack(spark, sf_dir: str) -> DataFrame:
    got = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
