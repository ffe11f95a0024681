"""Language ID by prediction by partial matching.

For each language a variable-order byte context tree is grown from labelled texts and frozen. A node
is a context of up to ``order`` bytes; a byte seen there costs its count's share of the node's total
plus its number of distinct bytes (escape method C); else an escape is coded and the next shorter
context tried, down to all bytes alike. A text's exact code length under each language is the sum
over its bytes of the cost at the deepest node that matches the bytes before; the shortest wins.
The tree is held as tables: node x byte -> node of the context one byte longer, and node x byte ->
cost in bits. All trees together take at most ``max_model`` bytes: where contexts are too many, those
seen least often are left out, and the next shorter one stands for them.

Training takes whole distinct rows of at most ``max_langs`` languages (the largest), at most ``max_docs``
a language and at most ``max_bytes`` of text; the rows are those with the least hash of id and text,
and texts beyond ``max_bytes`` are not learned from. Lang, source and id play no part in a prediction.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with no training rows
every text is; equal code lengths go to the first language in code point order; a null id is in
fold crc32("") mod 4; rows with the same id are sampled by their texts, and rows alike in both count
once; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _scale
from ._words import chunks


#: Bytes of all trees together.
MAX_MODEL = 64 << 20


@dataclass
class Tree:
    """A frozen context tree: ``steps[m][node, c]`` is the deepest node when the byte before the last m has class c, ``cost[node, c]`` is in bits."""

    steps: list[np.ndarray]
    cost: np.ndarray


@dataclass
class Model:
    langs: list[str]
    order: int
    classes: np.ndarray  # byte -> class; class 0 is every byte never seen in training
    n_classes: int
    trees: list[Tree]


def grow(texts: list[np.ndarray], order: int, k: int, most_nodes: int) -> Tree:
    """``texts``: byte classes, each padded in front with ``order`` zeros."""
    base = np.concatenate(texts).astype(np.int64)
    skip = np.concatenate([np.r_[np.ones(order, bool), np.zeros(len(t) - order, bool)] for t in texts])
    at = np.flatnonzero(~skip)
    ctx = np.zeros(len(at), np.int64)
    levels = []  # of contexts of m bytes: their codes, the nearest byte in the lowest digit; (context, class) codes and counts; total of each context
    for m in range(order + 1):
        if m:
            ctx = ctx + base[at - m] * k ** (m - 1)
        codes, counts = np.unique(ctx * k + base[at], return_counts=True)
        nodes, first = np.unique(codes // k, return_index=True)
        row = np.repeat(np.arange(len(nodes)), np.diff(np.r_[first, len(codes)]))
        levels.append((nodes, codes, counts, row, np.bincount(row, weights=counts, minlength=len(nodes))))
    # A context is seen at least as often as a longer one, so a limit on the counts leaves whole trees.
    totals = -np.sort(-np.concatenate([x[4] for x in levels]))
    least = 0 if len(totals) <= most_nodes else totals[most_nodes]
    steps, costs, n_nodes, previous = [], [], 0, None
    for m, (nodes, codes, counts, row, total) in enumerate(levels):
        keep = total > least if m else np.ones(1, bool)
        kinds = np.bincount(row, minlength=len(nodes))[keep]
        some, new = keep[row], np.cumsum(keep) - 1
        nodes, codes, counts, row, total = nodes[keep], codes[some], counts[some], new[row[some]], total[keep]
        escape = np.log2((total + kinds) / np.maximum(kinds, 1))
        if m == 0:
            cost = np.full((1, k), np.log2(256.0)) + escape[:, None]
        else:
            parent = np.searchsorted(previous[0], nodes % k ** (m - 1))
            step = np.repeat(np.arange(n_nodes, dtype=np.int32)[:, None], k, axis=1)
            step[previous[1] + parent, nodes // k ** (m - 1)] = n_nodes + np.arange(len(nodes))
            steps.append(step)
            cost = previous[2][parent] + escape[:, None]
        cost[row, codes % k] = np.log2((total + kinds)[row] / counts)
        costs.append(cost.astype(np.float32))
        previous = nodes, n_nodes, cost
        n_nodes += len(nodes)
    return Tree(steps, np.concatenate(costs))


def train(samples: dict[str, list[bytes]], order: int = 3, max_model: int = MAX_MODEL) -> Model:
    langs = sorted(samples)
    seen = np.unique(np.frombuffer(b"".join(x for t in samples.values() for x in t), np.uint8))
    classes = np.zeros(256, np.uint8)
    if len(seen) < 256:
        classes[seen] = np.arange(1, len(seen) + 1)
    else:
        classes[:] = np.arange(256)
    k = int(classes.max()) + 1
    pad = np.zeros(order, np.uint8)
    most_nodes = max(1, max_model // (4 * k * (order + 1) * max(1, len(langs))))
    trees = [grow([np.r_[pad, classes[np.frombuffer(x, np.uint8)]] for x in samples[g] if x], order, k, most_nodes) for g in langs]
    return Model(langs, order, classes, k, trees)


def code_lengths(model: Model, data: list[bytes]) -> np.ndarray:
    """Bits of each text (row) under each language (column)."""
    pad, k = bytes(model.order), model.n_classes
    sizes = np.array([len(x) for x in data])
    c = model.classes[np.frombuffer(b"".join(pad + x for x in data), np.uint8)].astype(np.int32)
    start = np.cumsum(sizes + model.order) - sizes  # first byte of each text proper
    front = np.zeros(len(c), bool)
    for j in range(model.order):
        front[start - 1 - j] = True
        c[start - 1 - j] = 0
    at = np.flatnonzero(~front)
    before = [c[at - m] for m in range(model.order + 1)]
    edge = np.r_[0, np.cumsum(sizes)]
    out = np.empty((len(data), len(model.langs)))
    for g, tree in enumerate(model.trees):
        node = np.zeros(len(at), np.int32)
        for m, step in enumerate(tree.steps, 1):
            node = step.ravel()[node * np.int32(k) + before[m]]
        total = np.r_[0.0, np.cumsum(tree.cost.ravel()[node * np.int32(k) + before[0]], dtype=np.float64)]
        out[:, g] = total[edge[1:]] - total[edge[:-1]]
    return out


def decide(model: Model | None, data: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predicted language, score (its posterior share among the languages), bits a byte."""
    if model is None or not model.langs:
        return ["und"] * len(data), np.zeros(len(data)), np.zeros(len(data))
    bits = code_lengths(model, data)
    best = bits.argmin(axis=1)
    least = bits[np.arange(len(data)), best]
    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
    lang = [model.langs[b] for b in best]
    for i, x in enumerate(data):
        if not any(map(str.isalpha, x.decode("utf-8", "replace"))):
            lang[i], score[i] = "und", 0.0
    return lang, score, least / np.maximum(1, [len(x) for x in data])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(docs: DataFrame, max_docs: int = 300, max_bytes: int = 2_000_000, max_langs: int = 200) -> dict[str, list[bytes]]:
    """Bounded training texts of each language: counts first, then a hash threshold that lets about 1.3 times ``max_docs`` pass.

    At most ``max_bytes`` and one text more of each language reach the driver.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.octet_length("text").between(1, max_bytes))
    rows = rows.select("lang", "text", F.xxhash64(F.lit(9), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("h"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, (1.3 * max_docs + 30) / n))])
    some = rows.where((F.col("h").cast("double") + 2.0**63) / 2.0**64 < F.element_at(share, F.col("lang")))
    some = some.groupBy("lang", "h").agg(F.first("text").alias("text"))  # rows alike count once, summed up before they are shuffled
    within = Window.partitionBy("lang").orderBy("h")
    some = some.withColumn("nth", F.row_number().over(within))
    some = some.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got: dict[str, list[bytes]] = {}
    for r in some.where((F.col("nth") <= max_docs) & (F.col("before") < max_bytes)).orderBy("lang", "h").select("lang", "text").collect():
        got.setdefault(r.lang, []).append(r.text.encode("utf-8", "surrogatepass"))
    return got


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """-> doc_id, lang_pred, score, bits_per_byte."""
    spark = docs.sparkSession
    _scale.workers_can_import(spark)
    frozen = spark.sparkContext.broadcast(model)  # at most max_model bytes
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, data in chunks(batches, "text"):
            lang, score, bits = decide(frozen.value, data)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return _scale.map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def fit(docs: DataFrame, order: int = 3, **bounds) -> Model | None:
    got = sample(docs, **bounds)
    return train(got, order) if got else None


def limits(samples: dict[str, list[bytes]], order: int = 3, fold: int = 5, slack: float = 64.0) -> np.ndarray:
    """Most bits a byte that text of each language may cost: what plain bytes cost, 8, or the worst of every ``fold``-th sample
    under trees of the others (``slack`` bits spare short texts). No limit where there are fewer than ``fold`` samples."""
    rest = train({g: [x for i, x in enumerate(t) if i % fold] for g, t in samples.items()}, order)
    out = np.full(len(rest.langs), np.inf)
    for g, name in enumerate(rest.langs):
        held = samples[name][::fold]
        if len(samples[name]) >= fold:
            out[g] = max(8.0, ((code_lengths(rest, held)[:, g] - slack) / [len(x) for x in held]).max())
    return out


def accepted(docs: DataFrame, least_score: float = 0.5, slack: float = 64.0) -> DataFrame:
    """The rows whose language is recognised: not ``und``, a score of at least ``least_score``, and a code length within the
    language's ``limits``, which text in a language that was not learned exceeds."""
    spark = docs.sparkSession
    _scale.workers_can_import(spark)
    got = sample(docs)
    model = train(got) if got else None
    most = dict(zip(model.langs, limits(got, slack=slack), strict=True)) if model else {}
    frozen = spark.sparkContext.broadcast((model, most))  # at most max_model bytes

    def run(batches):
        model, most = frozen.value
        for batch, data in chunks(batches, "text"):
            lang, score, bits = decide(model, data)
            sizes = np.array([len(x) for x in data])
            ok = np.array([g != "und" for g in lang], bool) & (score >= least_score)
            yield batch.filter(pa.array(ok & (bits * sizes <= np.array([most.get(g, np.inf) for g in lang]) * np.maximum(1, sizes) + slack)))

    return _scale.map_arrow(docs, run, docs.schema)


def op9_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = predict(docs, fit(docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")
