import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugework.llm import _scale, chat, mixing, packing, quality, suffix_dedup, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, length int, spans string, taken string"


def frame(spark, rows):
    """Documents with columns whose names clash with those the operators use."""
    full = [(i, t, None, s, len(t or ""), 1, 2, "x", "y") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (3, "one", None), (3, "one", None), (None, "two  three\n\n", "b"), (5, "x " * 3000, "b"), (6, "é" * 50, "a"), (6, "ü ß", None)]


# ---- 1 ---------------------------------------------------------------------------------------


def base(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), dup, len(hit)


def test_statistics_against_brute_force():
    rng = random.Random(0)
    texts = ["".join(rng.choice(["a", "bc", " ", " ", "\n", "#", "é", "\t", "long line\n"]) for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["", " \n ", "a b " * 40, "\x1ca\xa0b"]
    s = quality.statistics([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(int(s[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base(t), t


def test_learner_finds_a_conjunction():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(900), "b": rng.random(900), "c": rng.random(900)}
    bad = (x["a"] > 0.7) & (x["b"] < 0.4)
    rules = quality.learn(x, bad)
    got = np.zeros(900, bool)
    for r in rules:
        got |= quality._covered(r, x, 900)
    assert (got == bad).mean() > 0.97
    assert quality.learn(x, np.zeros(900, bool)) == [] and quality.learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []


def test_quality_on_odd_rows(spark):
    stats = quality.measure(frame(spark, ODD))
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judge(stats, quality.fit(stats, none)).collect()
    assert len(got) == len(ODD) and all(r["base_failed"] and not r["kept"] for r in got)
    assert quality.measure(frame(spark, [])).count() == 0


def test_rules_become_one_expression(spark):
    texts = [(i, ("word%d " % i) * 0 + " ".join(f"w{j}{'%%%' if i % 2 else ''}" for j in range(30)), "a") for i in range(60)]
    stats = quality.measure(frame(spark, texts))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rules = quality.fit(stats, labels)
    assert rules
    assert {r["doc_id"]: r["kept"] for r in quality.judge(stats, rules).collect()} == {i: i % 2 == 0 for i in range(60)}


# ---- 2 ---------------------------------------------------------------------------------------


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(0)
    for n in [*range(1, 30), 100, 301]:
        for a in (1, 2, 30):
            t = rng.integers(1, a + 1, n)
            assert suffix_dedup.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def removal(texts, length):
    data = [(t or "").encode() for t in texts]
    c = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("wide", [suffix_dedup.WIDE, 1])
def test_removal_against_brute_force(spark, wide):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7)))
    passage = [" ".join(word() for _ in range(30)) for _ in range(5)]
    texts = [" ".join([word() for _ in range(rng.randint(0, 60))] + [rng.choice(passage)[: rng.randint(30, 200)]] + [word() for _ in range(rng.randint(0, 60))]) for _ in range(60)]
    texts += [texts[0], texts[0], None, "", "ab" * 300, "x" * 900, passage[0] + passage[0]]
    rows = [(i if i != 7 else None, t, "a") for i, t in enumerate(texts)]
    got = suffix_dedup.removal_digest(frame(spark, rows), 60, wide).collect()
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    want = sorted((-1 if i is None else i, *x) for (i, _, _), x in zip(rows, removal(texts, 60), strict=True))
    assert found == want


def test_text_of_a_short_period_is_marked_once_a_run(spark):
    texts = ["x" * 50_000, "ab" * 20_000 + " end", "start " + "abc" * 5_000, "é" * 3_000]
    marks = list(suffix_dedup._Sample(400)([pa.RecordBatch.from_pydict({"t1": [1, 2, 3, 4], "t2": [1, 2, 3, 4], "doc": [1, 2, 3, 4], "text": texts})]))
    assert sum(m.num_rows for m in marks) < 100
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    got = sorted(tuple(r)[1:5] for r in suffix_dedup.removal_digest(frame(spark, rows)).collect())
    assert got == sorted(removal(texts, 400))


def test_cleaned_keeps_whole_characters(spark):
    same = "x" * 100 + "é" * 200 + "y" * 100
    got = suffix_dedup.cleaned(frame(spark, [(1, "aé" + same[:350], "a"), (2, "bà" + same[:350], "a")])).collect()
    assert all("\ufffd" not in r["text"] for r in got)


def test_cleaned_keeps_columns_and_clean_rows(spark):
    same = "the very same passage " * 40
    rows = [(1, "head one " + same, "a"), (2, "head two " + same, "a"), (3, same, "b"), (4, "clean", None), (5, None, None)]
    got = {r["doc_id"]: r for r in suffix_dedup.cleaned(frame(spark, rows)).collect()}
    assert set(got) == {1, 2, 4, 5} and got[4]["text"] == "clean" and got[1]["spans"] == "x"
    clash = frame(spark, rows).selectExpr("*", "1 as _spans", "2 as _t1", "3 as in0", "4 as _keep", "5 as _body", "6 as `a.b`", "7 as TEXT")
    assert {r["doc_id"]: tuple(r)[9:] for r in suffix_dedup.cleaned(clash).collect()} == dict.fromkeys((1, 2, 4, 5), (1, 2, 3, 4, 5, 6, 7))
    assert got[1]["text"].startswith("head on") and len(got[1]["text"]) < 60 and got[1]["n_chars"] == len(got[1]["text"])
    assert suffix_dedup.cleaned(frame(spark, [])).count() == 0


# ---- 3 ---------------------------------------------------------------------------------------


def test_mixing_meets_budgets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 50), "abc"[i % 3] if i % 20 else None) for i in range(300)] + [(7, "w w", "tiny"), (None, None, "none"), (8, "x", "tiny2"), (8, "x", "tiny2")]
    got = mixing.mix_sources(frame(spark, rows)).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    by = got.groupby(got.source.fillna("~")).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by.taken - by.target) <= 0.5).all() and (by.target <= 3 * by["size"]).all()
    assert by.target.sum() == pytest.approx(got["size"].sum())
    again = mixing.mix_sources(frame(spark, rows[::-1]).repartition(5)).toPandas()
    key = lambda d: sorted(map(str, d[["doc_id", "size", "taken"]].itertuples(index=False)))
    assert key(got) == key(again)
    assert mixing.mix_sources(frame(spark, [])).count() == 0


def test_mixed_rows_repeat_and_cut(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(10)), "big" if i < 90 else "small") for i in range(100)]
    got = mixing.mixed_rows(frame(spark, rows))
    assert got.columns == frame(spark, []).columns
    words = got.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    targets = {r["source"]: r["target"] for r in mixing.mix_sources(frame(spark, rows)).collect()}
    assert {r["source"]: r["n"] for r in words} == {s: round(t) for s, t in targets.items()}


def test_mixed_rows_hold_the_words_that_are_taken(spark):
    """Against plain code: whole copies and the cut row's first words, with rows alike on both sides of the cut."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{j}" for j in range(rng.randint(0, 30))), "abc"[i % 3]) for i in range(60)]
    rows += [(100, "same words here again", "a")] * 40 + [(None, "n one", "b"), (None, "n two x", "b"), (None, "n one", "b"), (101, None, None), (102, "k " * 20, None)]
    taken = Counter()
    for r in mixing.mix_sources(frame(spark, rows)).collect():
        taken[(r["doc_id"], r["source"], r["size"])] += r["taken"]
    got, texts = Counter(), Counter((i, s, t) for i, t, s in rows)
    for r in mixing.mixed_rows(frame(spark, rows)).collect():
        got[(r["doc_id"], r["source"])] += len(WORD.findall(r["text"]))
        whole = {t for i, s, t in texts if (i, s) == (r["doc_id"], r["source"])}
        assert r["text"] in whole or any(" ".join(WORD.findall(t or "")).startswith(r["text"]) for t in whole)
        assert r["n_chars"] == len(r["text"]) and r["spans"] == "x"
    by_source = lambda c: {s: sum(n for k, n in c.items() if k[1] == s) for s in {k[1] for k in c}}
    assert by_source(got) == by_source(taken)
    unlike = [k for k in taken if sum(1 for i, t, s in rows if (i, s) == k[:2]) == 1]
    assert all(got[k[:2]] == taken[k] for k in unlike)
    hot = [r["text"] for r in mixing.mixed_rows(frame(spark, rows)).where("doc_id = 100").collect()]
    assert sum(len(t.split()) for t in hot) == taken[(100, "a", 4)]


def test_prefix_sums_over_blocks_of_cuts(spark):
    df = spark.range(3000).selectExpr("cast(id % 3 as string) as g", "md5(cast(id as string)) as k", "id % 7 as v")
    want, run = {}, Counter()
    for r in sorted(df.collect(), key=lambda r: r.k):
        want[r.k] = run[r.g]
        run[r.g] += r.v
    for bits in (0, 3, 13, 32):
        got = _scale.prefix_sums(df, "g", "k", [], F.col("v"), bits, "before")
        assert {r.k: r.before for r in got.collect()} == want, bits


def test_mixing_sql(spark, duck):
    want = duck.sql(mixing.OP3_SQL).df()
    got = mixing.op3_mix(spark, "/root/testdata/sf0.001").toPandas()
    cols = sorted(want.columns)
    assert sorted(want[cols].itertuples(index=False, name=None)) == sorted(got[cols].itertuples(index=False, name=None))


# ---- 4 ---------------------------------------------------------------------------------------


def filled(plan):
    c = Counter()
    for inside, times in plan:
        for x in inside:
            c[x] += times
    return {k: v for k, v in c.items() if v}


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_exact_covers_and_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    cap = 64
    sizes = Counter(rng.integers(1, cap + 1, 400).tolist()) if seed % 2 else Counter(np.minimum(cap, rng.exponential(15, 400).astype(int) + 1).tolist())
    plan = packing.plan_bins(dict(sizes), cap)
    assert filled(plan) == dict(sizes) and all(sum(i) <= cap for i, _ in plan)
    assert sum(t for _, t in plan) <= 1.05 * sum(k * v for k, v in sizes.items()) / cap + sum(v for k, v in sizes.items() if k > cap // 2) * 0.2 + 2


def optimum(items, cap):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in sorted({b: k for k, b in enumerate(bins)}.values()):
            if bins[j] + items[i] <= cap:
                go(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(25))
def test_dominance_reduction_loses_no_optimum(seed):
    rng = np.random.default_rng(seed)
    items = sorted(rng.integers(2, 18, 9).tolist(), reverse=True)
    count = np.bincount(items, minlength=21)
    fixed = packing.reduce_dominating(count, 20)
    rest = [v for v in range(20, 0, -1) for _ in range(count[v])]
    assert sum(t for _, t in fixed) + optimum(rest, 20) == optimum(items, 20)


def test_packing_on_odd_rows(spark):
    e = tokens.encoder(tokens.public_path("word_bpe_49k.json"))
    got = packing.pack_documents(frame(spark, ODD), with_ids=True).toPandas()
    want = Counter()
    for i, t, _ in ODD:
        ids = e.encode(t or "") + b"\0\0\0\0"
        for p in range(-(-len(ids) // 8192)):
            x = ids[p * 8192 : (p + 1) * 8192]
            want[(-1 if i is None else i, p, p * 2048, len(x) // 4, zlib.crc32(x))] += 1
    assert Counter((int(-1 if r.doc_id != r.doc_id else r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got.itertuples())
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1].tolist()] and g.length.sum() <= 2048
    assert packing.pack_documents(frame(spark, [])).count() == 0


# ---- 5 ---------------------------------------------------------------------------------------

LOG = "conv_id long, seq long, turn long, kind string, role string, text string, formatted string"


def test_log_is_folded(spark):
    rows = [(1, 1, 0, "message", "user", "hi"), (1, 2, 1, "delta", "assistant", "dra"), (1, 3, 1, "delta", "assistant", "ft"), (1, 4, 1, "regenerate", "assistant", None), (1, 6, 1, "delta", "assistant", "lo"), (1, 5, 1, "delta", "assistant", "hel")]
    rows += [(1, 7, 0, "edit", "user", "hey"), (1, 8, 2, "message", "user", "gone"), (1, 9, 2, "delete", "user", None), (None, 1, None, None, None, None), (2, 1, 0, "delete", "user", "x")]
    log = spark.createDataFrame([(*r, "clash") for r in rows], LOG)
    got = {r["conv_id"]: [tuple(x) for x in r["turns"]] for r in chat.read_back(chat.format_chats(log)).collect()}
    assert got == {1: [("user", "hey"), ("assistant", "hello")], None: [("", "")]}
    assert chat.format_chats(log.limit(0)).count() == 0


def test_control_strings_survive(spark):
    rng = random.Random(4)
    odd = ["</s>", "[INST]", "[/INST]", "~", "~0", "~1", "<s>", "[", "]", "é👍", "\n", "R:", ""]
    make = lambda: "".join(rng.choice(odd) for _ in range(6))
    turns = [[(rng.choice(["user", "assistant", "INST", "a]b", "R:x", ""]), make()) for _ in range(rng.randint(1, 5))] for _ in range(40)]
    log = spark.createDataFrame([(c, 0, i, "message", r, t, "") for c, ts in enumerate(turns) for i, (r, t) in enumerate(ts)], LOG)
    for r in chat.read_back(chat.format_chats(log)).collect():
        assert [tuple(x) for x in r["turns"]] == turns[r["conv_id"]]
        assert r["loss_text"] == "".join(t for role, t in turns[r["conv_id"]] if role == "assistant")


def test_chat_sql(spark, duck):
    want = duck.sql(chat.OP5_SQL).df()
    got = chat.op5_chat(spark, "/root/testdata/sf0.001").toPandas()
    cols = sorted(want.columns)
    assert sorted(want[cols].itertuples(index=False, name=None)) == sorted(got[cols].itertuples(index=False, name=None))
