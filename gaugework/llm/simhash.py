"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a random non-zero vector of radius + 1 bits; for each non-zero vector v of
that space a table keeps the positions whose vector has odd inner product with v. The vectors of up
to ``radius`` differing positions cannot span the space, so some v is orthogonal to them all: every
pair within the radius agrees on all kept positions of some table. No pair is missed.

Pairs are looked for between distinct fingerprints only. A bucket's members are linked in its task
by a spanning forest, never by all pairs; a bucket larger than ``block`` is cut into blocks, each
pair of blocks being a bucket of its own, so that its work spreads over tasks and stays exact.

Defined cases: null and wordless texts have fingerprint zero and are linked like any other; texts of
one or two words have their whole sequence as the one shingle; repeated rows share a component; a
null id never is a component's id unless the component has no other; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _graph, _scale
from ._words import chunks

RADIUS, K, SEED = 3, 3, 42
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def hashes(text: bytes, k: int = K) -> list[int]:
    """XXH64 of every shingle of the lower-cased words, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(itertools.accumulate(map(len, words)))
    n, digest = len(words), xxhash.xxh64_intdigest
    # word i ends at ends[i] + i and starts at ends[i - 1] + i
    return [digest(joined[(ends[i - 1] if i else 0) + i : ends[i + k - 1] + i + k - 1], SEED) for i in range(n - k + 1)]


def simhash(data: list[bytes], k: int = K) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is set if it is in more than half of the hashes."""
    out = np.zeros(len(data), np.uint64)
    for i, text in enumerate(data):
        if h := hashes(text, k):
            bits = np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
            out[i] = int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(h)).tobytes(), "big")
    return out


def masks(radius: int = RADIUS, bits: int = 64, seed: int = 1) -> list[int]:
    """The 2**(radius + 1) - 1 covering masks. Vectors are dealt evenly, so each keeps about half of the positions."""
    dim = radius + 1
    deck = np.resize(np.arange(1, 2**dim), bits)
    vector = np.random.default_rng(seed).permutation(deck)
    return [sum(1 << i for i in range(bits) if bin(int(vector[i]) & v).count("1") & 1) for v in range(1, 2**dim)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_edges(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of distinct fingerprints within ``radius`` (indices), a row of pairs at a time."""
    n = len(fp)
    root = np.arange(n)
    edges = []
    for i in range(n - 1):
        hit = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= radius) + i + 1
        for r in np.unique(root[hit[root[hit] != root[i]]]):
            j = int(hit[root[hit] == r][0]) if len(hit) else i
            edges.append((i, j))
            root[root == r] = root[i]
    return edges


def _prints(batches):
    for batch, data in chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), pa.array(simhash(data).view(np.int64))], ["doc_id", "body", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> doc_id, body (hash of the text, for finding the row again), fp (signed long)."""
    _scale.workers_can_import(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), body(text_col).alias("body"))
    return _scale.map_arrow(rows, _prints, f"doc_id {kind}, body long, fp long")


def body(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


class _Link:
    """Spanning edges of the buckets in a task's rows, which come sorted by bucket."""

    def __init__(self, radius: int):
        self.radius = radius

    def __call__(self, batches):
        key, rest = None, []
        for batch in batches:
            names = [n for n in batch.schema.names if n != "fp"]
            keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names], axis=1)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
                now = tuple(keys[lo])
                if now != key:
                    yield from self.edges(rest)
                    key, rest = now, []
                rest.append(fp[lo:hi])
        yield from self.edges(rest)

    def edges(self, parts):
        fp = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        if len(fp) > 1 and (e := near_edges(fp, self.radius)):
            i, j = np.array(e).T
            yield pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], ["a", "b"])


def link_edges(distinct: DataFrame, radius: int = RADIUS, block: int = 2048) -> DataFrame:
    """``distinct`` (fp) -> edges (a, b) that connect exactly what pairs within ``radius`` connect."""
    spark = distinct.sparkSession
    _scale.workers_can_import(spark)
    table = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks(radius)])).alias("t", "key")
    rows = distinct.select("fp", table)
    sizes = rows.groupBy("t", "key").count().where("count > 1")
    rows = _scale.saved(rows.join(sizes, ["t", "key"]), "buckets")
    small = rows.where(F.col("count") <= block).select(F.lit(0).alias("x"), F.lit(0).alias("y"), "t", "key", "fp")
    g = F.ceil(F.col("count") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), g).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), g - 1), lambda o: F.struct(F.least(o, mine).alias("x"), F.greatest(o, mine).alias("y"))))
    large = rows.where(F.col("count") > block).select(pairs.alias("p"), "t", "key", "fp").select("p.x", "p.y", "t", "key", "fp")
    dealt = small.union(large).repartition(_scale.partitions(spark), "t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y")
    return _scale.map_arrow(dealt, _Link(radius), "a long, b long")


def classes_of(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """-> fp, component_id (least doc_id of all rows that its fingerprint reaches)."""
    distinct = _scale.saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = _graph.components(link_edges(distinct.select("fp"), radius))
    classes = distinct.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    return _scale.saved(classes.join(least, "label").select("fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """-> doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    prints = _scale.saved(fingerprints(docs, id_col, text_col), "prints")
    return prints.join(classes_of(prints, radius), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def rows_kept(docs: DataFrame, keep: DataFrame, prints: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) that ``keep`` (doc_id, body) names, one of each; ``prints`` has doc_id and body of every row."""
    rows, name = _scale.positional(docs)
    row_id, text = name["doc_id"], name["text"]
    keep = _scale.saved(keep.select(F.col("doc_id").alias("_keep"), F.col("body").alias("_body")).distinct(), "keep")
    like = F.col(row_id).eqNullSafe(F.col("_keep")) & (body(text) == F.col("_body"))
    rows = rows.join(keep, like, "left_semi")
    again = prints.groupBy("doc_id", "body").count().where("count > 1").select(F.col("doc_id").alias("_keep"), F.col("body").alias("_body"))
    again = _scale.saved(again, "again")
    if again.limit(1).count() == 0:
        return rows.toDF(*docs.columns)
    # Only rows that are repeated as a whole need a shuffle of their own.
    one = rows.join(again, like, "left_semi").withColumn("_body", body(text)).dropDuplicates([row_id, "_body"]).drop("_body")
    return rows.join(again, like, "left_anti").unionByName(one).toDF(*docs.columns)


def id_and_text(docs: DataFrame) -> DataFrame:
    rows, name = _scale.positional(docs)
    return rows.select(F.col(name["doc_id"]).alias("doc_id"), F.col(name["text"]).alias("text"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of near-duplicates: that with its least id (of repeated rows one). All columns stay, whatever their names."""
    prints = _scale.saved(fingerprints(id_and_text(docs)), "prints")
    got = prints.join(classes_of(prints), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Rows of one id may share a fingerprint with different texts; the one with the least hash stays.
    return rows_kept(docs, got.groupBy("doc_id", "fp").agg(F.min("body").alias("body")), prints)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
