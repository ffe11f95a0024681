import hashlib
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugework.llm import _graph, fingerprints, langid, queries, simhash, tokenfile, tokens, warc
from test_ops_1_5 import ODD, frame

# ---- 6 ---------------------------------------------------------------------------------------


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_sketches_estimate_containment_and_merge():
    rng = random.Random(0)
    words = [f"w{i}" for i in range(3000)]
    a = " ".join(rng.choice(words) for _ in range(4000))
    b = a[: len(a) // 4]
    x, y = fingerprints.sketches([a.encode(), b.encode()])
    assert fingerprints.likeness(x, y) > 0.98 and abs(len(x) / 4000 - 1 / fingerprints.SCALED) < 0.05
    left, right, both = fingerprints.sketches([b"a b c d e f g", b"q r s t u v", b"x"])
    assert fingerprints.merged(left, left).tolist() == left.tolist()
    assert set(fingerprints.merged(x, both)) >= set(x)
    for s in (x, y, left, right):
        assert fingerprints.from_string(fingerprints.to_string(s)).tolist() == s.tolist()


def test_fingerprints_with_next(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 10**9), " ".join(rng.choice(["aa", "bé", "cc", "d"]) for _ in range(rng.randint(0, 60))), "s") for _ in range(150)] + [r for r in ODD if r[0] != 3 and r[0] != 6]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_with_next(frame(spark, rows).repartition(3)).collect()}
    order = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -1))
    assert len(got) == len(rows)
    for k, (i, t, _) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        a, b, c = fingerprints.sketches([t.encode(), new.encode(), following.encode()])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.to_string(a), fingerprints.to_string(b))
        assert r["near_edited"] == fingerprints.likeness(a, b) and r["near_next"] == fingerprints.likeness(a, c)


def test_fingerprints_of_odd_rows(spark):
    assert fingerprints.fingerprint_with_next(frame(spark, ODD)).count() == len(ODD)
    one = fingerprints.fingerprint_with_next(frame(spark, ODD[5:6])).first()
    assert one["near_next"] == 1.0
    assert fingerprints.fingerprint_with_next(frame(spark, [])).count() == 0
    assert fingerprints.fingerprint(frame(spark, ODD)).count() == len(ODD)


# ---- 7 ---------------------------------------------------------------------------------------


def test_codes_are_directly_addressable(tmp_path):
    rng = np.random.default_rng(0)
    ids = (rng.integers(0, 2**32, 6000, dtype=np.uint64) >> rng.integers(0, 32, 6000).astype(np.uint64)).astype(np.uint32)
    uri = str(tmp_path / "a.dac")
    tokenfile._files.write(uri, tokenfile.dump([5, None, 9], [ids[:3000], ids[3000:3000], ids[3000:]]))
    f = tokenfile.TokenFile(uri)
    assert [f[i] for i in range(0, 6000, 11)] == ids[::11].tolist()
    for lo, hi in ((0, 6000), (13, 14), (511, 1025), (7, 7)):
        assert f.slice(lo, hi).tolist() == ids[lo:hi].tolist()
    assert [(i, s, len(x)) for i, s, x in f.documents(1000)] == [(5, 0, 3000), (None, 3000, 0), (9, 3000, 3000)]
    with pytest.raises(IndexError):
        f[6000]
    with pytest.raises(ValueError):
        tokenfile._files.write(uri, [b"nope" * 10])
        tokenfile.TokenFile(uri)


def test_token_files_round_trip(spark, tmp_path):
    path = tokens.public_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = tokenfile.read_tokens(tokenfile.write_tokens(frame(spark, ODD), str(tmp_path / "t"), path, most_tokens=100)).orderBy("start").collect()
    want = sorted((-1 if i is None else i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t, _ in ODD)
    assert [(-1 if r["doc_id"] is None else r["doc_id"]) for r in got] == [i for i, _ in want]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], bytes(r["ids"])) for r in got) == want
    starts = np.cumsum([0, *[r["n_tokens"] for r in got]])
    assert [r["start"] for r in got] == starts[:-1].tolist()
    assert tokenfile.read_tokens(tokenfile.write_tokens(frame(spark, []), str(tmp_path / "u"), path)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    rng = random.Random(1)
    bits = ["a", "The", " ", " ", "  ", "\n", "\n\n", "\t", ".", ",", "...", "'s", "don't", "é", "ΑΣ", "İ", "1", "²", "_", "%%", "<|endoftext|>", "<|STARTOFTEXT|>", "'ll", "'", "'re", "x" * 70, "é" * 40, "aaaa", "Ÿ", "-", "!!", "\xa0", "\0", "\x1c", "é", "中", "👍🏽", " .", "\r\n", "a.b", "שׁ"]
    e, library = tokens.Encoder(tokens.public_path(name)), Tokenizer.from_file(tokens.public_path(name))
    plain = lambda t: np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(8000)]
    texts += ["".join(rng.choice(["a", "b", "The", "é", "1", "'s", "'ve", "'", " ", " ", "\n", ".", "!"]) for _ in range(rng.randint(0, 12))) for _ in range(8000)]
    for lo in range(0, len(texts), 100):
        for t, got in zip(texts[lo : lo + 100], e.encode_all([t.encode() for t in texts[lo : lo + 100]]), strict=True):
            assert got == plain(t), repr(t)
    # A long text is cut in segments; tables that are full begin anew.
    words = ["".join(rng.choice("abcdefgé,.'") for _ in range(rng.randint(1, 9))) for _ in range(500_000)]
    long = " ".join(words)
    assert len(tokens.segments(long.encode())) > 1 and e.encode(long) == plain(long)
    e.met = tokens.Words(1000)
    tokens_before, tokens.MOST_WORDS = tokens.MOST_WORDS, 1000
    try:
        assert e.encode(long[:30_000]) == plain(long[:30_000]) and e.encode(long[:9_000]) == plain(long[:9_000])
    finally:
        tokens.MOST_WORDS = tokens_before


# ---- 8 ---------------------------------------------------------------------------------------


def test_masks_cover_every_pair_within_the_radius():
    rng, masks = random.Random(0), simhash.masks()
    assert len(masks) == 15 and all(24 <= bin(m).count("1") <= 40 for m in masks)
    for _ in range(3000):
        x = 0
        for b in rng.sample(range(64), rng.randint(0, 3)):
            x |= 1 << b
        assert any(x & m == 0 for m in masks)


def brute(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 500)}" for _ in range(300)]
    texts = []
    for _ in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(300)] = f"v{rng.randint(0, 99)}"
        texts.append(" ".join(w))
    rows = [(100 + i, t, "a") for i, t in enumerate(texts)] + ODD
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fp = brute([t for _, t, _ in rows])
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fp[i] ^ fp[j]).count("1") <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    least = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    want = sorted((str(rows[i][0]), f"{fp[i]:016x}", str(least[label[i]])) for i in range(len(rows)))
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in got) == want
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert len(kept) == len(set(label)) and simhash.near_duplicates(frame(spark, [])).count() == 0


def test_large_buckets_are_cut_into_blocks_and_stay_exact(spark):
    rng = random.Random(6)
    fps = list({simhash.signed((0xABCDEF << 40) ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 6)))) for _ in range(300)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    parts = [{(r["node"], r["label"]) for r in _graph.components(simhash.link_edges(df, block=b)).collect()} for b in (10_000, 7)]
    assert parts[0] == parts[1]
    assert all(any(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for b in fps if b != a) == (a in {n for n, _ in parts[0]}) for a in fps)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in _graph.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


# ---- 9 ---------------------------------------------------------------------------------------


def test_code_lengths_against_a_plain_model():
    rng = random.Random(0)
    text = "".join(rng.choice(["ab", "ba", "c", "abc "]) for _ in range(300)).encode()
    model = langid.train({"x": [text]}, order=2)

    def cost(context, byte):
        bits = 0.0
        for m in range(len(context), -1, -1):
            c = context[len(context) - m :]
            padded = bytes([0]) * 0 + text
            seen = [padded[i] for i in range(m, len(padded)) if padded[i - m : i] == c]
            if not seen:
                continue
            kinds = len(set(seen))
            if byte in seen:
                return bits + np.log2((len(seen) + kinds) / seen.count(byte))
            bits += np.log2((len(seen) + kinds) / kinds)
        return bits + 8.0

    probe = b"abz cab"
    got = langid.code_lengths(model, [probe[:3]])[0, 0] - langid.code_lengths(model, [probe[:2]])[0, 0]
    assert got == pytest.approx(cost(b"ab", ord("z")), rel=0.02)
    got = langid.code_lengths(model, [probe])[0, 0] - langid.code_lengths(model, [probe[:6]])[0, 0]
    assert got == pytest.approx(cost(b"ca", ord("b")), rel=0.02)


def test_models_are_bounded(spark):
    rng = random.Random(0)
    noise = rng.randbytes(200_000)
    model = langid.train({"x": [noise], "y": [b"plain text " * 50]}, max_model=1 << 22)
    assert sum(s.nbytes for t in model.trees for s in [*t.steps, t.cost]) <= 1 << 22
    bits = langid.code_lengths(model, [b"plain text"])[0]
    assert bits[1] < bits[0] and np.isfinite(langid.code_lengths(model, [noise])).all()
    # Rows that share an id are sampled by their texts, rows alike count once.
    rows = [(1, f"text {i % 2000} is here", "a") for i in range(4000)]
    got = langid.sample(frame(spark, rows).withColumn("lang", F.lit("x")), max_docs=100)
    assert 50 <= len(got["x"]) == len(set(got["x"])) <= 100


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    out = got[[zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]]
    assert (out.lang == out.lang_pred).mean() >= 0.97
    odd = langid.predict(frame(spark, [*ODD, (9, "123 !?", "a")]), langid.fit(docs)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 9)} == {1: "und", 2: "und", 9: "und"}
    assert all(0 <= r["score"] <= 1 for r in odd) and len(odd) == len(ODD) + 1
    empty = frame(spark, [])
    assert langid.fit(empty) is None and langid.predict(empty, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(frame(spark, ODD), None).collect()} == {"und"}


def test_languages_that_were_not_learned_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    strange = {
        -1: "Zażółć gęślą jaźń, a potem idź do domu, bo już późno i pada deszcz na ulicy. " * 4,
        -2: "Быстрая коричневая лиса прыгает через ленивую собаку и бежит дальше по дороге. " * 4,
        -3: "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(500)),
        -4: "14",
        -5: None,
    }
    rows = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(i, t, None) for i, t in strange.items()], "doc_id long, text string, lang string"))
    got = {r[0] for r in langid.accepted(rows).select("doc_id").collect()}
    lettered = docs.where("text is not null and text rlike '[a-zA-Z]'").select("doc_id")
    assert not got & set(strange) and got == {r[0] for r in lettered.collect()}
    assert np.isinf(langid.limits({"x": [b"too few", b"texts"]})).all()
    assert langid.limits({"x": [b"the same text over and over again"] * 10})[0] == 8.0


# ---- 10 --------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string"


def test_packages_are_zip_files(tmp_path):
    rows = [(i if i else None, f"http://a/{i}\r\nX-Page-ID: 99" if i % 2 else None, b"z" * i, hashlib.sha1(b"z" * i).hexdigest(), 7 if i % 3 == 0 else None) for i in range(40)]
    for wide in (False, True):
        uri = str(tmp_path / f"{wide}.wacz")
        warc.write_package(uri, rows, wide)
        z = zipfile.ZipFile(uri)
        assert z.testzip() is None and all(i.compress_type == 0 for i in z.infolist())
        got = list(warc.read_package(uri))
        assert got == [(p, len(x), d, "response" if o is None else "revisit", o) for p, _, x, d, o in rows]
    raw = bytearray(open(uri, "rb").read())
    open(uri, "wb").write(bytes(raw) + b"tail")
    with pytest.raises(ValueError):
        list(warc.read_package(uri))


def test_archives_against_sql(spark, tmp_path):
    import duckdb

    long = "é" * 600
    rows = [(1, "u", long), (2, "u", long), (5, "u", long), (5, None, long), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", long), (8, "u", "x" * 1000), (9, "u", "x" * 999 + "y")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    got = warc.read_archives(warc.write_archives(df, str(tmp_path / "w"))).toPandas()
    pages = df.toPandas()  # noqa: F841
    c = duckdb.connect()
    pages["page_id"] = pages["page_id"].astype("Int64")
    c.register("pages", pages)
    want = c.sql(warc.OP10_SQL).df()
    cell = lambda x: None if pd.isna(x) else str(x).removesuffix(".0")
    key = lambda d: sorted(str([cell(x) for x in r]) for r in d[sorted(d.columns)].itertuples(index=False))
    assert key(got) == key(want)
    assert warc.read_archives(warc.write_archives(df.limit(0), str(tmp_path / "v"))).count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) and got.length.max() <= 2048 and set(got.doc_id) <= {r[0] for r in docs.select("doc_id").collect()}


def test_pipeline_stages_against_plain_code(spark, tmp_path):
    """Every stage's rows, from its own input, by plain Python."""
    import corpus_pipeline
    from test_ops_1_5 import removal

    rng = random.Random(8)
    words = lambda n: [rng.choice("the of and house river cloud stone green seven under light paper".split()) + str(rng.randint(0, 999)) for _ in range(n)]
    base, passage = words(120), " ".join(words(55))
    near = [*base[:60], "changed", *base[61:]]
    texts = [" ".join(base), " ".join(near), " ".join(words(40)), None, "", "12 34 !", passage + " " + " ".join(words(50)), " ".join(words(50)) + " " + passage]
    texts += [" ".join(words(rng.randint(5, 90))) for _ in range(30)] + ["short one", "short one"]
    docs = [(i, t, "en", "abc"[i % 3] if i % 11 else None, len(t or ""), i) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, _cut long").write.parquet(f"{tmp_path}/documents.parquet")
    now, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, now, str(tmp_path)).write.parquet(path)
        columns, now = now.columns, spark.read.parquet(path)
        assert name == "packing" or now.columns == columns
        steps[name] = now.collect()
    text = lambda rows: {r["doc_id"]: r["text"] for r in rows}
    first = text(steps["language_id"])
    assert first == {i: t for i, t in enumerate(texts) if t and any(map(str.isalpha, t))}
    sets, label = {i: shingle_set(t) for i, t in first.items()}, {i: i for i in first}
    for i in sets:
        for j in sets:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    second = text(steps["near_duplicates"])
    assert second == {i: first[i] for i in set(label.values())} and 1 not in second and 0 in second
    third, ids = text(steps["repeated_passages"]), sorted(second)
    want = {i: x[3] for i, x in zip(ids, removal([second[i] for i in ids], corpus_pipeline.PASSAGE), strict=True)}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in third.items()} == want
    assert passage not in third[6] and passage not in third[7] and all(third[i] == second[i] for i in second if i not in (6, 7))
    taken, source = Counter(), {i: docs[i][3] for i in third}
    for r in steps["mixture"]:
        taken[r["source"]] += len(r["text"].split())
        n = len(r["text"].split())
        assert third[r["doc_id"]].split()[:n] == r["text"].split() and r["_cut"] == r["doc_id"]
    size = Counter()
    for i, t in third.items():
        size[source[i]] += len(t.split())
    order, level = [*sorted(s for s in size if s is not None), *[s for s in size if s is None]], {}
    weight, open_, left = {s: k % 3 + 1 for k, s in enumerate(order)}, set(order), sum(size.values())
    while over := {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 3 * size[s]}:
        level |= {s: 3 * size[s] for s in over}
        left, open_ = left - sum(3 * size[s] for s in over), open_ - over
    level |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert all(abs(taken[s] - level[s]) <= 0.5 for s in order)
    library, n = Tokenizer.from_file(tokens.public_path("word_bpe_49k.json")), Counter()
    for r in steps["mixture"]:
        n[r["doc_id"]] += len(library.encode(r["text"], add_special_tokens=False).ids) + 1
    packed = Counter()
    for r in steps["packing"]:
        packed[r["doc_id"]] += r["length"]
    assert packed == n
