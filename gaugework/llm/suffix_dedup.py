"""Suffix-array removal of repeated byte strings, by difference covers at two levels.

A byte goes if a string of ``length`` bytes that covers it also starts somewhere else.

1. Cover. A position is sampled if the hash of the 32 bytes there is the least in some window of
   ``length`` bytes. Like a difference cover, the sample meets any two equal windows at equal
   distances; unlike positions modulo 3 it needs about one position in 170. Every window belongs to
   its one sampled position, and a position's windows form its context.
2. Names. Sampled positions are shuffled by name (their hash); names that occur once leave, and with
   them every context that cannot hold a repeat. Contexts that are equal as a whole are one class; a
   class with two occurrences is repeated throughout, and only classes that share a name with another
   class go on, one occurrence each.
3. Suffixes. The contexts of a name meet in a task, where the suffix array of their bytes is made by
   the skew algorithm (sort sampled triples, recurse on their names, merge the remaining suffixes)
   and adjacent prefixes of ``length`` bytes are compared. A name whose contexts exceed ``wide``
   bytes does not meet in one task: its windows are counted by 128-bit names, a row each.

Copies of a whole text are worked on once. Nothing is gathered on the driver.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; a text that occurs in
two rows (same id or not) is repeated throughout if it is long enough; text of a short period is
repeated throughout and marked once a run, not once a byte; where a cut falls inside a character,
``cleaned`` keeps that character whole; an empty table gives an empty result; other columns, whatever
their names, are carried by ``cleaned`` and ignored otherwise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scale
from ._words import CHUNK, U, chunks, mix

LENGTH, GRAM = 400, 32
#: Window starts of a text that are sampled at once; positions must fit in 24 bits.
SEGMENT = 1 << 23
#: Bytes of contexts under one name that one suffix array may hold; its names must fit in 21 bits.
WIDE = 2_000_000
_PLACE = U((1 << 24) - 1)
_EMPTY = np.iinfo(np.int64).min


# ---- arrays --------------------------------------------------------------------------------


def gram_hashes(t: np.ndarray, size: int, factor: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of the ``size`` bytes from each position on, put together from powers of two."""
    h, n, out, done = mix(t.astype(U) + U(factor & 0xFFFF)), 1, None, 0
    join = lambda a, b: mix(a * U(factor) + b)
    while True:
        if size & n:
            # the parts taken so far lie in front
            out = h if out is None else join(out[: max(0, min(len(out), len(h) - done))], h[done : done + len(out)])
            done += n
        if done == size:
            return out
        h = join(h[:-n], h[n:]) if len(h) > n else h[:0]
        n *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Skew algorithm over integers of 1 to 2**21 - 1."""
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    t = np.concatenate([t.astype(np.int64), np.zeros(3, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    # Sort the sampled triples and name them by their order.
    key = t[sample] << 42 | t[sample + 1] << 21 | t[sample + 2]
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), np.int64)
    new[1:] = key[order][1:] != key[order][:-1]
    name = np.empty(len(key), np.int64)
    name[order] = np.cumsum(new)
    # Names that repeat are sorted by what follows: recurse on the string of names.
    if new.sum() < len(key):
        order = suffix_array(name)
    by_rank = sample[order]
    rank = np.zeros(n + 3, np.int64)
    rank[by_rank] = np.arange(1, len(by_rank) + 1)
    # The remaining suffixes, by their first symbol and the sampled suffix behind it.
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(t[zeros] << 22 | rank[zeros + 1], kind="stable")]
    # Merge: against each residue both sides have symbols and a sampled rank to compare.
    one, two = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    pair = lambda i: t[i] << 22 | rank[i + 1]
    triple = lambda i: t[i].astype(U) << U(43) | t[i + 1].astype(U) << U(22) | rank[i + 2].astype(U)
    place = np.arange(len(zeros)) + np.searchsorted(pair(one), pair(zeros)) + np.searchsorted(triple(two), triple(zeros))
    if n % 3 == 1:  # the sampled end position sorts first and is no suffix
        by_rank, place = by_rank[by_rank < n], place - 1
    out = np.empty(n, np.int64)
    rest = np.ones(n, bool)
    rest[place] = False
    out[place], out[rest] = zeros, by_rank
    return out


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, which of its windows' strings start at another place in them too."""
    joined = np.frombuffer(b"\0".join(contexts), np.uint8)
    sizes = np.array([len(x) for x in contexts])
    start = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)])
    t = joined.astype(np.int64) + len(contexts)
    t[start[1:] - 1] = np.arange(1, len(contexts))  # a separator of its own ends each context
    valid = np.zeros(len(t), bool)
    for a, n in zip(start.tolist(), sizes.tolist(), strict=True):
        valid[a : a + n - length + 1] = True
    sa = suffix_array(t)
    sa = sa[valid[sa]]
    prefix = gram_hashes(joined, length)[sa]
    same = prefix[1:] == prefix[:-1]
    hit = np.zeros(len(t), bool)
    hit[sa[1:][same]] = hit[sa[:-1][same]] = True
    return [hit[a : a + n - length + 1] for a, n in zip(start.tolist(), sizes.tolist(), strict=True)]


def runs(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"lo": int(a), "hi": int(b)} for a, b in edge.reshape(-1, 2)]


# ---- stages in tasks -----------------------------------------------------------------------


def sampled(data: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text, name, first window start, last) of every sampled position; texts shorter than ``length`` have none."""
    out = []
    for lo in range(0, max((len(x) for x in data), default=0), SEGMENT):
        who = np.array([i for i, x in enumerate(data) if len(x) - lo >= length], np.int64)
        part = [data[i][lo : lo + SEGMENT + length - 1] for i in who]
        if not part:
            continue
        t = np.frombuffer(b"".join(part), np.uint8)
        sizes = np.array([len(x) for x in part])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        h = gram_hashes(t, GRAM)
        least = sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=U), length - GRAM + 1) & _PLACE
        doc = np.repeat(np.arange(len(part)), sizes)[: len(least)]
        ok = np.arange(len(least)) + length <= begin[doc + 1]
        s, at = np.flatnonzero(ok), least[ok]
        cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)]))
        first, last = s[cut], s[np.concatenate([cut[1:], [len(s)]]) - 1]
        d = doc[first]
        out.append((who[d], h[at[cut].astype(np.int64)].view(np.int64), first - begin[d] + lo, last - begin[d] + lo))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


class _Sample:
    schema = "name long, class long, t1 long, t2 long, doc long, first int, last int, reps int"

    def __init__(self, length: int):
        self.length = length

    def __call__(self, batches):
        seen: set[tuple[int, int]] = set()  # whole texts met in this task
        for batch, data in chunks(batches, "text"):
            t1, t2, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("t1", "t2", "doc"))
            keep = []
            for i, k in enumerate(zip(t1.tolist(), t2.tolist(), strict=True)):
                if k not in seen:
                    keep.append(i)
                    if len(seen) < 1_000_000:
                        seen.add(k)
            d, name, first, last = sampled([data[i] for i in keep], self.length)
            if not len(d):
                continue
            d = np.array(keep)[d]
            kind = [xxhash.xxh64_intdigest(data[i][a : b + self.length], 7) for i, a, b in zip(d.tolist(), first.tolist(), last.tolist(), strict=True)]
            kind = np.array(kind, U).view(np.int64)
            # Text of a short period gives one context over and over, end to end: one row tells how often.
            other = np.concatenate([[True], (d[1:] != d[:-1]) | (kind[1:] != kind[:-1]) | (name[1:] != name[:-1]) | (first[1:] != last[:-1] + 1)])
            at = np.flatnonzero(other)
            reps = np.diff(np.append(at, len(d)))
            d = d[at]
            cols = [name[at], kind[at], t1[d], t2[d], doc[d], first[at].astype(np.int32), last[at].astype(np.int32), reps.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [x.split()[0] for x in self.schema.split(", ")])


class _Suffixes:
    """Contexts sorted by name -> repeated windows of each class, names being kept whole."""

    schema = "name long, class long, runs array<struct<lo: int, hi: int>>"

    def __init__(self, length: int):
        self.length = length

    def __call__(self, batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("name", "class", "bytes")], strict=True):
                if rows and rows[-1][:2] == row[:2]:
                    continue
                if size > CHUNK // 2 and rows[-1][0] != row[0]:
                    yield self.done(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
        if rows:
            yield self.done(rows)

    def done(self, rows):
        hits = repeated_starts([r[2] for r in rows], self.length)
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([runs(x) for x in hits], kind)], ["name", "class", "runs"])


class _Windows:
    """Contexts of wide names -> a row for each window with its 128-bit name."""

    schema = "name long, class long, at int, w1 long, w2 long"

    def __init__(self, length: int):
        self.length = length

    def __call__(self, batches):
        for batch in batches:
            for name, kind, x in zip(*[batch.column(c).to_pylist() for c in ("name", "class", "bytes")], strict=True):
                t = np.frombuffer(x, np.uint8)
                w1, w2 = gram_hashes(t, self.length), gram_hashes(t, self.length, 0xA0761D6478BD642F)
                n = len(w1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(np.full(n, kind)), pa.array(np.arange(n, dtype=np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], ["name", "class", "at", "w1", "w2"])


# ---- Spark ---------------------------------------------------------------------------------


def repeated_spans(texts: DataFrame, length: int = LENGTH, wide: int = WIDE) -> DataFrame:
    """``texts`` (t1, t2, doc, text) -> t1, t2, spans: byte ranges [lo, hi) of each text to remove (unsorted, may overlap)."""
    spark = texts.sparkSession
    _scale.workers_can_import(spark)
    n = _scale.partitions(spark)
    long_enough = F.octet_length("text") >= length
    marks = _scale.map_arrow(texts.where(long_enough), _Sample(length), _Sample.schema)
    marks = _scale.saved(marks.withColumn("key", F.xxhash64("t1", "t2", "first")), "marks")
    again = marks.groupBy("name").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max("reps").alias("reps")).where("a <> b or reps > 1").select("name")
    again = _scale.saved(again, "names")  # so that the join has exchanges of its own, which may be split where a name is hot
    marks = _scale.saved(marks.join(again, "name", "left_semi"), "repeated")
    classes = marks.groupBy("name", "class").agg(F.min("key").alias("key"), F.max("key").alias("other"), F.max("reps").alias("reps"), F.max(F.col("last") - F.col("first")).alias("span"))
    classes = classes.select("name", "class", "key", "span", ((F.col("key") != F.col("other")) | (F.col("reps") > 1)).alias("many"))
    names = classes.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("span").cast("long") + length).alias("size"))
    classes = _scale.saved(classes.join(names, "name"), "classes")
    # One occurrence of each class that shares its name with another class, with its bytes.
    mixed = classes.where("n > 1").select("name", "class", "key", "size")
    shown = marks.join(mixed, ["name", "class", "key"]).groupBy("name", "class", "key", "t1", "t2", "first", "last", "size").agg(F.min("doc").alias("doc"))
    piece = F.substring(F.col("text").cast("binary"), F.col("first") + 1, F.col("last") - F.col("first") + length)
    shown = texts.where(long_enough).join(shown, ["t1", "t2", "doc"]).select("name", "class", "size", piece.alias("bytes"))
    shown = _scale.saved(shown, "contexts")
    cols = ["name", "class", "bytes"]
    narrow = shown.where(F.col("size") <= wide).select(*cols).repartition(n, "name").sortWithinPartitions("name", "class")
    found = _scale.map_arrow(narrow, _Suffixes(length), _Suffixes.schema)
    rows = _scale.map_arrow(shown.where(F.col("size") > wide).select(*cols).dropDuplicates(["name", "class"]), _Windows(length), _Windows.schema)
    twice = rows.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    spot = F.struct(F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))
    far = rows.join(twice, ["w1", "w2"], "left_semi").groupBy("name", "class").agg(F.collect_list(spot).alias("runs"))
    found = found.unionByName(far)
    whole = F.array(F.struct(F.lit(0).alias("lo"), (F.col("span") + 1).alias("hi")))
    found = classes.where("many").select("name", "class", whole.alias("runs")).unionByName(found.join(classes.where("many").select("name", "class"), ["name", "class"], "left_anti"))
    spans = marks.join(_scale.saved(found.where(F.size("runs") > 0), "runs"), ["name", "class"])
    spans = spans.select("t1", "t2", "first", ((F.col("reps") - 1) * (F.col("last") - F.col("first") + 1)).alias("more"), F.explode("runs").alias("r"))
    spans = spans.select("t1", "t2", (F.col("first") + F.col("r.lo")).alias("lo"), (F.col("first") + F.col("more") + F.col("r.hi") + (length - 1)).alias("hi"))
    copies = texts.where(long_enough).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("k"), F.max(F.octet_length("text")).alias("hi")).where("k > 1")
    spans = spans.unionByName(copies.select("t1", "t2", F.lit(0).alias("lo"), "hi"))
    return spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def merge_spans(spans: list[dict[str, int]] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted(spans or [], key=lambda s: s["lo"]):
        if out and s["lo"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["hi"])
        else:
            out.append([s["lo"], s["hi"]])
    return [(a, b) for a, b in out]


def kept_bytes(x: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(x[at:a])
        at = b
    return b"".join([*out, x[at:]])


def _digest(batches):
    names, kinds = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "has_repeats"], (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    for batch in batches:
        rows = []
        for x, s in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("_spans").to_pylist(), strict=True):
            spans = merge_spans(s)
            rows.append((len(x), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept_bytes(x, spans)).hexdigest(), bool(spans)))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", *names])


def at_borders(x: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without parts of characters that do not lie wholly in them."""
    out = []
    for a, b in spans:
        while a < b and x[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(x) and x[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out


def with_spans(docs: DataFrame, row_id: str, text: str, length: int = LENGTH, wide: int = WIDE) -> DataFrame:
    """All columns of ``docs`` (text never null; names that ``positional`` gives), and _spans (null: nothing repeats)."""
    rows = docs.withColumn(text, F.coalesce(F.col(text), F.lit(""))).withColumn("_t1", F.xxhash64(text)).withColumn("_t2", F.xxhash64(F.lit(1), text))
    texts = rows.select(F.col("_t1").alias("t1"), F.col("_t2").alias("t2"), F.coalesce(F.col(row_id).cast("long"), F.lit(_EMPTY)).alias("doc"), F.col(text).alias("text"))
    spans = _scale.saved(repeated_spans(texts, length, wide), "spans")
    spans = spans.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("spans").alias("_spans"))
    return rows.join(spans, ["_t1", "_t2"], "left").drop("_t1", "_t2")


def removal_digest(docs: DataFrame, length: int = LENGTH, wide: int = WIDE) -> DataFrame:
    """-> doc_id, n_bytes, n_removed, n_spans, kept_sha256, and has_repeats: whether any byte goes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows, name = _scale.positional(docs.select("doc_id", "text"))
    rows = with_spans(rows, name["doc_id"], name["text"], length, wide).toDF("doc_id", "text", "_spans")
    return _scale.map_arrow(rows, _digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, has_repeats boolean")


def cleaned(docs: DataFrame, length: int = LENGTH, wide: int = WIDE) -> DataFrame:
    """``docs`` with repeated strings taken out of their texts; rows that lose all their words go."""
    columns = docs.columns
    rows, name = _scale.positional(docs)
    own, text = rows.schema, name["text"]
    rows = with_spans(rows, name["doc_id"], text, length, wide)

    def run(batches):
        for batch in batches:
            texts, spans = [], batch.column("_spans").to_pylist()
            for x, s in zip(batch.column(text).cast(pa.binary()).to_pylist(), spans, strict=True):
                texts.append(kept_bytes(x, at_borders(x, merge_spans(s))).decode("utf-8", "replace"))
            cols = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in own.names]
            touched = pa.array([bool(s) and not t.strip() for t, s in zip(texts, spans, strict=True)])
            yield pa.RecordBatch.from_arrays(cols, own.names).filter(pc.invert(touched))

    out = _scale.map_arrow(rows.select(*own.names, "_spans"), run, own)
    if "n_chars" in columns:
        out = out.withColumn(name["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*columns)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return removal_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
