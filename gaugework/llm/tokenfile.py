"""Token files of directly addressable codes.

An id is split into chunks of 8 bits, lowest first. Level 0 holds the first chunk of every id, level
n + 1 the next chunk of those ids that go on; a bitmap beside each level tells which do, and a rank
directory counts its set bits before every 512. Token i is read by stepping down: its chunk, its
bit, and if set the rank of that bit, which is its place in the next level. No block is decoded.

File: ``DAC1``, then little-endian 64-bit header (documents, tokens, levels), document ids, a byte a
document that is 1 where the id is null, offsets (documents + 1), and for each level its length, its
chunks, its bitmap (lowest bit first) and its directory (unsigned 64-bit). Documents lie in ascending
id order within a file and from file to file; file names sort in that order.

Defined cases: null text is empty (the end id alone); null ids come first; rows with equal ids
follow each other by their text's hash; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _files, _scale, tokens
from ._words import chunks

MAGIC, STEP, END = b"DAC1", 512, 0
#: Tokens in a file; a longer document has a file of its own.
MOST_TOKENS = 4_000_000


def pack_levels(ids: np.ndarray) -> list[bytes]:
    parts: list[bytes] = []
    rest, n = ids.astype(np.uint32), 0
    while len(rest) or not n:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.bitwise_count(np.pad(bits, (0, -len(bits) % (STEP // 8)))).reshape(-1, STEP // 8).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)])
        parts += [len(rest).to_bytes(8, "little"), (rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
        rest, n = rest[more] >> 8, n + 1
    return [n.to_bytes(8, "little"), *parts]


def dump(doc_ids: list[int | None], ids: list[np.ndarray]) -> list[bytes]:
    """The parts of a file."""
    offsets = np.zeros(len(ids) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    every = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    levels = pack_levels(every)
    head = [MAGIC, len(ids).to_bytes(8, "little"), len(every).to_bytes(8, "little")]
    names = np.array([i or 0 for i in doc_ids], "<i8").tobytes()
    return [*head, levels[0], names, bytes(i is None for i in doc_ids), offsets.astype("<i8").tobytes(), *levels[1:]]


class TokenFile:
    """Random access to the tokens of a file, by range reads of what a request touches."""

    def __init__(self, uri: str):
        self.file = _files.Reader(uri)
        head = self.file.at(0, 28)
        if head[:4] != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        self.n_docs, self.n_tokens, n = (int.from_bytes(head[i : i + 8], "little") for i in (4, 12, 20))
        at = 28
        null = np.frombuffer(self.file.at(at + 8 * self.n_docs, self.n_docs), np.uint8)
        self.doc_ids = [None if z else int(i) for i, z in zip(np.frombuffer(self.file.at(at, 8 * self.n_docs), "<i8"), null, strict=True)]
        at += 9 * self.n_docs
        self.offsets = np.frombuffer(self.file.at(at, 8 * self.n_docs + 8), "<i8")
        at += 8 * self.n_docs + 8
        self.levels = []
        for _ in range(n):
            size = int.from_bytes(self.file.at(at, 8), "little")
            bits = at + 8 + size
            ranks = bits + -(-size // 8)
            self.levels.append((size, at + 8, bits, ranks))
            at = ranks + 8 * (-(-size // STEP) + 1)

    def close(self) -> None:
        self.file.file.close()

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place i."""
        _, _, bits, ranks = self.levels[level]
        block = i // STEP
        base = int.from_bytes(self.file.at(ranks + 8 * block, 8), "little")
        raw = np.frombuffer(self.file.at(bits + block * STEP // 8, (i % STEP + 7) // 8), np.uint8)
        return base + int(np.unpackbits(raw, bitorder="little")[: i % STEP].sum())

    def __getitem__(self, i: int) -> int:
        """Token i."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (_, data, bits, _) in enumerate(self.levels):
            value |= self.file.at(data + i, 1)[0] << (8 * level)
            if not self.file.at(bits + i // 8, 1)[0] >> i % 8 & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """Tokens lo to hi - 1: of each level the one run that they use."""
        out = np.zeros(hi - lo, np.uint32)
        who = np.arange(hi - lo)
        for level, (_, data, bits, _) in enumerate(self.levels):
            if lo >= hi:
                break
            out[who] |= np.frombuffer(self.file.at(data + lo, hi - lo), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            raw = np.frombuffer(self.file.at(bits + lo // 8, (hi + 7) // 8 - lo // 8), np.uint8)
            more = np.unpackbits(raw, bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            if not more.any():
                break
            lo = self._rank(level, lo)
            who, hi = who[more], lo + int(more.sum())
        return out

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, first token, tokens) of each document, read in runs of about ``most`` tokens."""
        d = 0
        while d < self.n_docs:
            e = max(d + 1, int(np.searchsorted(self.offsets, self.offsets[d] + most, side="right")) - 1)
            run, base = self.slice(int(self.offsets[d]), int(self.offsets[e])), self.offsets[d]
            for i in range(d, e):
                yield self.doc_ids[i], int(self.offsets[i]), run[self.offsets[i] - base : self.offsets[i + 1] - base]
            d = e


MANIFEST = "shard int, part int, path string, n_docs long, n_tokens long, n_bytes long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """Write the token files of all documents under ``folder`` -> their manifest, a row a file.

    A task writes whole files under names of its own, so a task run twice leaves at most files that
    no manifest names.
    """
    spark = docs.sparkSession
    _scale.workers_can_import(spark)

    def run(batches):
        encode, end = tokens.encoder(tokenizer).encode_all, END.to_bytes(4, "little")
        shard, part, names, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            path = f"{folder}/{shard:06d}-{part:05d}-{uuid.uuid4().hex}.dac"
            n = _files.write(path, dump(names, ids))
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, "path": path, "n_docs": len(names), "n_tokens": size, "n_bytes": n}], pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

        for batch, data in chunks(batches, "text"):
            for i, raw in zip(batch.column("doc_id").to_pylist(), encode(data), strict=True):
                got = np.frombuffer(raw + end, "<u4")
                if names and size + len(got) > most_tokens:
                    yield flush()
                    part, names, ids, size = part + 1, [], [], 0
                names.append(i)
                ids.append(got)
                size += len(got)
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(_scale.partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return _scale.saved(_scale.map_arrow(rows, run, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Read the files back -> doc_id, start (tokens of all documents before), n_tokens, ids (little-endian, 32 bits)."""
    spark = manifest.sparkSession
    _scale.workers_can_import(spark)
    # A prefix sum in two steps: over the files of a shard, and over the shards, which are as many as tasks wrote.
    before = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("t"))
    shards = shards.select("shard", before(Window.orderBy("shard"), "t").alias("ahead"))
    files = manifest.withColumn("inside", before(Window.partitionBy("shard").orderBy("part"), "n_tokens")).join(shards, "shard")
    files = files.select("path", (F.col("ahead") + F.col("inside")).alias("base")).repartition(_scale.partitions(spark))

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                f, rows = TokenFile(path), []
                for i, start, ids in f.documents():
                    rows.append((i, base + start, len(ids), ids.astype("<u4").tobytes()))
                    if len(rows) == 256:
                        yield pack(rows)
                        rows = []
                if rows:
                    yield pack(rows)
                f.close()

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])

    return _scale.map_arrow(files, run, "doc_id long, start long, n_tokens long, ids binary")


def op7_tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_tokens(docs, f"{_scale.shared_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}", tokens.public_path("byte_bpe_50k.json"))
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
