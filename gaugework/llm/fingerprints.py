"""Document fingerprints: threshold-scaled sketches of word shingles.

The sketch of a text is every distinct hash of its five-word shingles that lies below 1/``scaled``
of the hash range; the least hash stays if none does, so that only wordless texts have an empty
sketch. Sketches merge by union (least hashes at or above the limit go once one lies below) and
compare by containment: of two sketches, the share of the smaller that the larger holds. That
stays meaningful between very unequal texts. The string form is the sorted hashes, 8 characters of
base 64 each (the top 48 bits).

Defined cases: null text is empty; texts of 1 to 4 words have their whole sequence as the one
shingle; two empty sketches have likeness 1, an empty and a full one 0; null ids come last in
descending order; rows with equal ids follow each other in the order of their texts; a table of one
row is its own next; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scale
from ._words import CHUNK, U, Words, chunks

K, SCALED, BITS = 5, 8, 48


def sketches(data: list[bytes], k: int = K, scaled: int = SCALED) -> list[np.ndarray]:
    """Sorted distinct hashes (48 bits) of each text's sketch."""
    w = Words(data)
    h, doc = w.shingles(w.hashes(), k)
    h >>= U(64 - BITS)
    low = h < U((1 << BITS) // scaled)
    has = np.zeros(len(data), bool)
    has[doc[low]] = True
    rest = np.flatnonzero((w.count > 0) & ~has)
    h1, d1 = h[low], doc[low]
    if len(rest):
        least = np.full(len(data), np.iinfo(np.uint64).max, U)
        np.minimum.at(least, doc, h)
        h1, d1 = np.concatenate([h1, least[rest]]), np.concatenate([d1, rest])
    order = np.lexsort((h1, d1))
    h1, d1 = h1[order], d1[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (d1[1:] != d1[:-1])
    h1, d1 = h1[new], d1[new]
    return np.split(h1, np.searchsorted(d1, np.arange(1, len(data))))


def to_string(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_string(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(U)


def merged(a: np.ndarray, b: np.ndarray, scaled: int = SCALED) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    both = np.union1d(a, b)
    low = both[both < U((1 << BITS) // scaled)]
    return low if len(low) else both[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return float(not len(large))
    at = np.searchsorted(large, small)
    return float((large[np.minimum(at, len(large) - 1)] == small).mean())


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many leading code points of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches):
    """Rows in order; each but the carried ones is compared with the row after it."""

    def flush(rows):
        texts = [r[1].decode("utf-8", "surrogatepass") for r in rows]
        live = [i for i in range(len(rows) - 1) if not rows[i][2]]
        new = [edited(texts[i], texts[i + 1]).encode("utf-8", "surrogatepass") for i in live]
        own, changed = sketches([r[1] for r in rows]), sketches(new) if new else []
        cols = [
            pa.array([rows[i][0] for i in live], kind),
            pa.array([len(texts[i]) for i in live], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in new], pa.string()),
            pa.array([to_string(own[i]) for i in live], pa.string()),
            pa.array([to_string(x) for x in changed], pa.string()),
            pa.array([likeness(own[i], x) for i, x in zip(live, changed, strict=True)], pa.float64()),
            pa.array([likeness(own[i], own[i + 1]) for i in live], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", *[x.split()[0] for x in OUT.split(", ")]])

    rows, size, kind = [], 0, pa.int64()
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for i, t, c in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("carried").to_pylist(), strict=True):
            rows.append((i, t, c))
            size += len(t)
            if size > CHUNK:
                if len(rows) > 1:
                    yield flush(rows)
                rows, size = rows[-1:], len(t)
    if len(rows) > 1:
        yield flush(rows)


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its text edited with the next one's start, in descending id order.

    Ids are cut into ranges; the first row of each range is also carried at the end of the range
    before it (and the very first at the end of the last), so every row meets its successor inside
    one sorted range and no range is larger than a few partitions' share.
    """
    spark = docs.sparkSession
    _scale.workers_can_import(spark)
    n = _scale.partitions(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    ids = docs.select(F.col(id_col).cast("long").alias("i")).where("i is not null")
    # One edge for each range: bounded by the number of ranges, not by the rows.
    edges = sorted({int(x) for x in ids.approxQuantile("i", [k / (2 * n) for k in range(1, 2 * n)], 1 / (8 * n))}, reverse=True)

    @F.pandas_udf("int")
    def cell(i):
        known = i.notna().to_numpy()
        at = np.full(len(i), len(edges), np.int32)
        at[known] = np.searchsorted(-np.array(edges, np.float64), -i[known].to_numpy(np.float64), side="right")
        return pd.Series(at)

    ids = docs.select(F.col(id_col).alias("doc_id")).withColumn("cell", cell(F.col("doc_id").cast("long")))
    first = ids.groupBy("cell").agg(F.max("doc_id").alias("doc_id")).collect()  # a row a range
    first = sorted((r.cell, r.doc_id) for r in first)
    if not first:
        return spark.createDataFrame([], f"doc_id {kind}, {OUT}")
    to = {c: first[k - 1][0] for k, (c, _) in enumerate(first)}
    heads = spark.createDataFrame([(c, i, to[c]) for c, i in first], f"cell int, head {kind}, to int")
    rows = rows.withColumn("cell", cell(F.col("doc_id").cast("long")))
    rows = rows.join(F.broadcast(heads), "cell")
    places = F.array(F.struct(F.col("cell").alias("c"), F.lit(False).alias("carried")))
    both = F.concat(places, F.array(F.struct(F.col("to").alias("c"), F.lit(True).alias("carried"))))
    rows = rows.select("doc_id", "text", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), both).otherwise(places)).alias("p"))
    rows = rows.select("doc_id", "text", F.col("p.c").alias("cell"), F.col("p.carried").alias("carried"))
    rows = rows.repartition(n, "cell").sortWithinPartitions("cell", "carried", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    return _scale.map_arrow(rows.select("doc_id", "text", "carried"), _pairs, f"doc_id {kind}, {OUT}")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> id and fingerprint of every whole text."""
    _scale.workers_can_import(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return _scale.map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), _alone, f"doc_id {kind}, fingerprint string")


def _alone(batches):
    for batch, data in chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([to_string(x) for x in sketches(data)], pa.string())], ["doc_id", "fingerprint"])


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
