"""Quality rules: a learned decision list over text statistics, emitted as ordered Spark conditions.

Sequential covering on labelled statistics: a conjunction of thresholds is grown on two thirds of
the labelled rows until it covers (almost) only bad ones, pruned on the last third, and kept if it
is precise there; covered rows leave and the next rule is learned. The list is then one
``CASE WHEN`` over the statistics, so verdicts cost no Python.

The learner sees at most ``max_labelled`` labelled rows (those with the least md5 of their id).

Defined cases: null text has no words and fails the base rules; null ids are kept and never
labelled; a label that is null is ignored, several labels of an id count as several rows; with no
usable labels the list is empty and only the base rules decide; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _scale
from ._words import U, Words, chunks, mix, windows

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long, n_upper long, n_digits long, n_ends long"
SYMBOLS = b"#*$%&|<>"
RUN = 8
_FLAGS = {name: np.isin(np.arange(256), list(chars)) for name, chars in (("n_symbols", SYMBOLS), ("n_upper", bytes(range(65, 91))), ("n_digits", bytes(range(48, 58))), ("n_ends", b".!?"))}


def statistics(data: list[bytes]) -> dict[str, np.ndarray]:
    """The statistics of each text, over all of it."""
    w = Words(data)
    out = {"n_words": w.count, "word_chars": w.per_doc(((w.buf & 0xC0) != 0x80) & ~w.space)}
    out |= {k: w.per_doc(v[w.buf]) for k, v in _FLAGS.items()}
    dup, lines = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
    for i, x in enumerate(data):
        if b"\n" in x:
            full = [y for y in x.split(b"\n") if y.strip()]
            lines[i], dup[i] = len(full), len(full) - len(set(full))
        else:
            lines[i] = bool(x.strip())
    out |= {"n_dup_lines": dup, "n_lines": lines}
    h = w.hashes()
    salt = mix(w.doc.astype(U) + U(0xA5A5))
    out["n_distinct"] = np.zeros(len(data), np.int64)
    out["n_repeat_words"] = np.zeros(len(data), np.int64)
    if len(h):
        first = np.unique(h ^ salt, return_index=True)[1]
        out["n_distinct"] = np.bincount(w.doc[first], minlength=len(data))
        keys, doc = windows(h, w.doc, RUN)
        if len(keys):
            n = len(h) - RUN + 1
            at = np.flatnonzero(w.doc[:n] == w.doc[RUN - 1 :])
            order = np.argsort(keys ^ mix(doc.astype(U) + U(0x77)), kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            same &= doc[order][1:] == doc[order][:-1]
            hit = np.zeros(len(keys), bool)
            hit[order[1:][same]] = hit[order[:-1][same]] = True
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, at[hit], 1)
            np.add.at(edge, at[hit] + RUN, -1)
            out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(edge)[:-1] > 0], minlength=len(data))
    return out


def _measure(batches):
    names = [x.split()[0] for x in STATS.split(", ")]
    for batch, data in chunks(batches, "text"):
        s = statistics(data)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(s[n], pa.int64()) for n in names]], ["doc_id", *names])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> doc_id and the statistics of every whole text."""
    _scale.workers_can_import(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return _scale.map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), _measure, f"doc_id {kind}, {STATS}")


def features() -> dict[str, Column]:
    """What rules may test: name -> expression over the statistics (never null)."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "chars_per_word": per("word_chars", "n_words"),
        "distinct_share": per("n_distinct", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "digit_share": per("n_digits", "word_chars"),
        "ends_per_word": per("n_ends", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
        "n_words": F.col("n_words").cast("double"),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    limit: float

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.limit if self.above else x[self.feature] <= self.limit

    def column(self, f: dict[str, Column]) -> Column:
        return f[self.feature] >= F.lit(self.limit) if self.above else f[self.feature] <= F.lit(self.limit)


def _covered(rule: list[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for t in rule:
        out &= t.rows(x)
    return out


def _best_test(x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Test, float] | None:
    """The threshold with the largest information gain for the bad class (ties: feature order, then the lower limit)."""
    p0, n0 = bad.sum(), (~bad).sum()
    base, best, found = np.log2(p0 / (p0 + n0)), 1e-9, None
    for name, v in x.items():
        order = np.argsort(v, kind="stable")
        s, b = v[order], bad[order]
        last = np.flatnonzero(s[1:] != s[:-1])  # a cut lies after each of these
        if not len(last):
            continue
        p, n = np.cumsum(b)[last], np.cumsum(~b)[last]
        for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - base), 0)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, found = gain[i], Test(name, above, float((s[last[i]] + s[last[i] + 1]) / 2))
    return (found, best) if found else None


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, max_rules: int = 12, max_tests: int = 4, min_precision: float = 0.9, min_cover: int = 5, seed: int = 7) -> list[list[Test]]:
    """Ordered conjunctions that mark bad rows."""
    n = len(bad)
    if not n or not bad.any() or bad.all():
        return []
    grow = np.random.default_rng(seed).permutation(n) % 3 != 0
    left, rules = np.ones(n, bool), []
    pick = lambda m: {k: v[m] for k, v in x.items()}
    while len(rules) < max_rules:
        g = left & grow
        if not bad[g].any():
            break
        rule, live = [], g.copy()
        while len(rule) < max_tests and (~bad[live]).any():
            got = _best_test(pick(live), bad[live])
            if not got:
                break
            rule.append(got[0])
            live &= got[0].rows(x)
        if not rule:
            break
        held = left & ~grow
        worth = lambda r: ((c := _covered(r, x, n) & held) & bad).sum() - (c & ~bad).sum() if r else -n
        value = lambda r: (worth(r) / max(1, (_covered(r, x, n) & held).sum()), -len(r))
        rule = max((rule[:i] for i in range(len(rule), 0, -1)), key=value)
        covered = _covered(rule, x, n) & left
        out = covered & held
        if covered.sum() < min_cover or not out.any() or bad[out].mean() < min_precision or bad[covered].mean() < min_precision:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def verdict(rules: list[list[Test]]) -> Column:
    """Ordered conditional expression over the statistics: true keeps the row."""
    f, out = features(), None
    for rule in rules:
        test = rule[0].column(f)
        for t in rule[1:]:
            test = test & t.column(f)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed(least_words: int = 20, most_repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))


def fit(stats: DataFrame, labels: DataFrame, *, max_labelled: int = 20_000, **options) -> list[list[Test]]:
    """Learn from at most ``max_labelled`` rows of ``labels`` (doc_id, quality) joined to the statistics, and as many pairs of them.

    Both bounds take the rows with the least hash of their id, so an id of many rows does not reach the driver either. Rows that the base rules drop anyway teach nothing and are left out.
    """
    f = features()
    rows = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("_q"))
    rows = rows.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "_q").limit(max_labelled)
    table = stats.where(~base_failed()).join(rows, "doc_id").select("doc_id", "_q", *[v.alias(k) for k, v in f.items()])
    table = table.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "_q", *f).limit(max_labelled).toPandas()
    table = table.sort_values(["doc_id", "_q", *f]).reset_index(drop=True)
    return learn({k: table[k].to_numpy() for k in f}, (table["_q"] == 0).to_numpy(), **options)


def judge(stats: DataFrame, rules: list[list[Test]]) -> DataFrame:
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    stats = _scale.saved(measure(docs), "stats")
    got = judge(stats, fit(stats, labels))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
