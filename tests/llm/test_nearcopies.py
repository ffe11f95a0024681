import random
import re

import numpy as np

import corpus_pipeline
from gaugework.llm import _graph, nearcopies
from test_ops_1_5 import ODD, frame


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def variants(seed, groups, copies):
    """Groups of texts with up to seven words of 150 replaced: likeness 0.6 to 1, simhashes mostly further than 3 bits."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randint(0, 2000)}" for _ in range(150)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(150)] = f"V{g}x{rng.randint(0, 99)}"
            rows.append((1000 + len(rows), " ".join(w), "a"))
    return rows


def labels(rows):
    s = [shingle_set(t) for _, t, _ in rows]
    label, changed = list(range(len(rows))), True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if label[j] < label[i] and near(s[i], s[j]):
                    label[i], changed = label[j], True
    return label


def test_the_stage_against_brute_force(spark):
    rows = variants(1, 12, 8) + ODD
    label = labels(rows)
    want = {}
    for (i, t, _), c in zip(rows, label, strict=True):
        want.setdefault(c, []).append(i)
    least = sorted(str(min((i for i in ids if i is not None), default=None)) for ids in want.values())
    kept = corpus_pipeline.near_duplicates(spark, frame(spark, rows).repartition(3), "").collect()
    assert sorted(str(r["doc_id"]) for r in kept) == least
    assert corpus_pipeline.near_duplicates(spark, frame(spark, []), "").count() == 0


def test_blocks_link_what_whole_buckets_link(spark):
    rows = variants(2, 2, 40)
    docs = frame(spark, rows)
    distinct = nearcopies.prints_of(docs).select("node", "size", "keys").distinct()
    parts = [{(r["node"], r["label"]) for r in _graph.components(nearcopies.link_edges(docs, distinct, most=m)).collect()} for m in (1000, 7)]
    s = [shingle_set(t) for t in sorted({t for _, t, _ in rows})]
    assert parts[0] == parts[1] and len(parts[0]) == sum(any(near(a, b) for j, b in enumerate(s) if j != i) for i, a in enumerate(s)) > 20


def test_likeness_of_exactly_the_limit_counts():
    h = np.array([1, 2, 3, 4, 5, 1, 2, 3, 4, 1, 2, 3], np.uint64)
    assert nearcopies.alike(h, np.array([5, 4, 3])) == [(0, 1)]


def test_texts_within_the_simhash_radius_are_candidates(spark):
    """Every pair whose op8 fingerprints differ in at most 3 bits agrees under a covering mask, beside the bands of minima."""
    from gaugework.llm import simhash

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        t = rng.choice(words, 300).tolist()
        rows += [(2 * i, " ".join(t), None), (2 * i + 1, " ".join([*t[:150], "other", *t[151:]]), None)]
    docs = frame(spark, rows)
    fp = simhash.simhash([t.encode() for _, t, _ in rows])
    got = {r["doc_id"]: np.array(r["keys"], np.int64).view(np.uint64)[nearcopies.BANDS :] for r in nearcopies.prints_of(docs.select("doc_id", "text")).collect()}
    close = [(i, j) for i in range(len(rows)) for j in range(i) if bin(int(fp[i] ^ fp[j])).count("1") <= simhash.RADIUS]
    assert close and all((got[i] == got[j]).any() for i, j in close)
    assert len(got[0]) == 2 ** (simhash.RADIUS + 1) - 1
