"""Near-duplicates by Jaccard likeness of 5-word shingles, for the pipeline.

Candidates agree under one of the covering masks of op8's SimHash fingerprints (no pair within its
3 bits escapes) or share one of 24 bands of five minima (two sets of likeness 0.8 share none with
chance 1 in 14 000); every candidate pair is then measured on the whole sets, so nothing is linked by
chance. A bucket's members are linked in its task by a spanning forest, never by all pairs; a bucket
with much text is cut into blocks, each pair of blocks being a bucket of its own.

Defined cases: words are runs of non-space bytes, lower-cased in ASCII; texts of one to four words
have their whole sequence as the one shingle; null and wordless texts are copies of each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _graph, _scale
from ._words import Words, chunks, mix, texts_of
from .simhash import LOWER, body, id_and_text, masks, rows_kept, simhash

K, LIKENESS, BANDS, ROWS = 5, 0.8, 24, 5
U = np.uint64
_SALT = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
MASKS = np.array(masks(), U)
KEYS = BANDS + len(MASKS)
XOR, FACTOR = _SALT[: BANDS * ROWS], _SALT[BANDS * ROWS :] | U(1)


def sets(data: list[bytes], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after the other, and how many each has."""
    words = Words([x.translate(LOWER) for x in data])
    h, doc = words.shingles(words.hashes(), k)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(data))


def bands(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of band keys for each text that has shingles."""
    sizes = sizes[sizes > 0]
    start = np.cumsum(sizes) - sizes
    keys = np.zeros((len(sizes), BANDS), U)
    for i in range(BANDS * ROWS if len(sizes) else 0):
        least = np.minimum.reduceat((h ^ XOR[i]) * FACTOR[i], start)
        keys[:, i // ROWS] = mix(keys[:, i // ROWS] * U(0x9E3779B97F4A7C15) + least)
    return keys


def _prints(batches):
    for batch, data in chunks(batches, "text"):
        h, sizes = sets(data)
        prints = simhash([x for x, n in zip(data, sizes, strict=True) if n])
        keys = np.hstack([bands(h, sizes), prints[:, None] & MASKS]).view(np.int64)
        ends = np.cumsum(np.where(sizes > 0, KEYS, 0))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(keys.ravel()))
        node = np.where(sizes > 0, batch.column("body").to_numpy(), 0)  # wordless texts are one node
        size = np.array([len(x) for x in data], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), pa.array(node), pa.array(size), lists], ["doc_id", "body", "node", "size", "keys"])


def prints_of(docs: DataFrame) -> DataFrame:
    """-> doc_id, body (hash of the text), node (body, 0 if wordless), size (bytes), keys (one a band, then the fingerprint under each mask)."""
    _scale.workers_can_import(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _scale.map_arrow(docs.select("doc_id", "text", body("text").alias("body")), _prints, f"doc_id {kind}, body long, node long, size long, keys array<long>")


def alike(h: np.ndarray, sizes: np.ndarray, likeness: float = LIKENESS) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with Jaccard likeness of at least ``likeness`` (indices), a row of pairs at a time."""
    n = len(sizes)
    start = np.cumsum(sizes) - sizes
    word = np.unique(h, return_inverse=True)[1]
    mark = np.zeros(int(word.max()) + 1 if len(word) else 0, np.int64)
    root, edges = np.arange(n), []
    for i in range(n - 1):
        if (root == root[0]).all():
            break
        mine = word[start[i] : start[i] + sizes[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[word[start[i + 1] :]], start[i + 1 :] - start[i + 1])
        mark[mine] = 0
        # Integers, so that a likeness of exactly the limit counts.
        hit = np.flatnonzero(both >= likeness * (sizes[i] + sizes[i + 1 :] - both) - 1e-9) + i + 1
        for r in np.unique(root[hit[root[hit] != root[i]]]):
            edges.append((i, int(hit[root[hit] == r][0])))
            root[root == r] = root[i]
    return edges


def _link(batches):
    """Spanning edges of the buckets in a task's rows, which come sorted by bucket."""
    key, nodes, texts = None, [], []
    for batch in batches:
        keys = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in ("t", "key", "x", "y")], axis=1)
        if not len(keys):
            continue
        node, text = batch.column("node").to_numpy(), batch.column("text")
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            now = tuple(keys[lo])
            if now != key:
                yield from _edges(nodes, texts)
                key, nodes, texts = now, [], []
            nodes += node[lo:hi].tolist()
            texts += texts_of(text.slice(lo, hi - lo))
    yield from _edges(nodes, texts)


def _edges(nodes, texts):
    if len(nodes) > 1 and (e := alike(*sets(texts))):
        i, j = np.array(nodes)[np.array(e).T]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j)], ["a", "b"])


def link_edges(docs: DataFrame, distinct: DataFrame, block: int = 1 << 21, most: int = 1024) -> DataFrame:
    """``distinct`` (node, size, keys) -> edges (a, b) that connect exactly what candidate pairs of enough likeness connect."""
    spark = docs.sparkSession
    rows = distinct.select("node", "size", F.posexplode("keys").alias("t", "key"))
    members = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("i"))
    sizes = rows.groupBy("t", "key").agg(members.alias("members"), F.sum("size").alias("bytes")).where("members.n > 1")
    # Bands in which the same texts meet are one bucket.
    once = sizes.groupBy("members").agg(F.min(F.struct("t", "key")).alias("b"), F.first("bytes").alias("bytes"))
    g = F.greatest(F.ceil(F.col("bytes") / block), F.ceil(F.col("members.n") / most)).cast("int")
    once = _scale.saved(once.select("b.t", "b.key", g.alias("g")), "buckets")
    mine = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.struct(F.least(o, mine).alias("x"), F.greatest(o, mine).alias("y"))))
    dealt = rows.join(once, ["t", "key"]).select("t", "key", "node", cells.alias("c")).select("t", "key", "c.x", "c.y", "node")
    dealt = _scale.saved(dealt, "dealt")
    text = docs.select(body("text").alias("node"), "text").join(dealt.select("node").distinct(), "node", "left_semi")
    text = text.groupBy("node").agg(F.first("text").alias("text"))
    met = dealt.join(text, "node").select("t", "key", "x", "y", "node", "text")
    met = met.repartition(_scale.partitions(spark), "t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y")
    return _scale.map_arrow(met, _link, "a long, b long")


def classes_of(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """-> node, label (least node that it reaches), component_id (least doc_id of all rows of its component)."""
    distinct = _scale.saved(prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys")), "distinct")
    labels = _graph.components(link_edges(docs, distinct.select("node", "size", "keys")))
    classes = distinct.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    return _scale.saved(classes.join(least, "label").select("node", "label", "component_id"), "classes")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of near-duplicates: that with its least id (of its texts that with the least hash, of
    repeated rows one). All columns stay, whatever their names."""
    slim = id_and_text(docs)
    prints = _scale.saved(prints_of(slim), "prints")
    got = prints.join(classes_of(slim, prints), "node").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return rows_kept(docs, got.groupBy("label", "doc_id").agg(F.min("body").alias("body")), prints)
