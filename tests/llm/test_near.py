import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Row

from keyloom.llm import near
from keyloom.llm.common import table


def bag(text, k=5):
    w = text.encode().split()
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def jaccard(a, b):
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low)


def brute(rows):
    """Least doc_id of each row's class, by comparing all pairs of different texts."""
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    keys = list(texts)
    bags = [bag(t) for t in keys]
    up = list(range(len(keys)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            a, b = sum(bags[i].values()), sum(bags[j].values())
            if a and b and min(a, b) >= 0.8 * max(a, b) and jaccard(bags[i], bags[j]) >= 0.8:
                up[root(i)] = root(j)
    least = {}
    for k, t in enumerate(keys):
        least[root(k)] = min(least.get(root(k), 1 << 60), min(texts[t]))
    return {i: least[root(k)] for k, t in enumerate(keys) for i in texts[t]}


def found(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def test_classes_equal_all_pairs(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    assert found(near.classes(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_signature_is_unbiased_for_multisets():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    base = " ".join(rng.choice(vocabulary) for _ in range(300)) + " same five words come again" * 9
    other = " ".join(base.split()[60:]) + " same five words come again" * 4
    text, shingle, count = near.bags(pa.array([base, other]))
    sig = near.signatures(2, text, shingle, count)
    estimates = [np.mean(sig[0] == sig[1])]
    for salt in range(40):
        s = near.signatures(2, text, shingle ^ np.uint64(salt * 7919 + 1), count)
        estimates.append(np.mean(s[0] == s[1]))
    truth = jaccard(bag(base), bag(other))
    assert abs(np.mean(estimates) - truth) < 4 * (truth * (1 - truth) / (near.M * len(estimates))) ** 0.5


def test_families_over_several_blocks(spark, monkeypatch):
    """Blocks of a few texts give the classes that one block gives."""
    monkeypatch.setattr(near, "BLOCK_TEXTS", 4)
    rng = random.Random(3)
    rows, n = [], 0
    for family in range(3):
        base = [f"f{family}x{rng.randrange(999)}" for _ in range(200)]
        for _ in range(17):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near.classes(docs)) == brute(rows)


def test_nulls_empties_ties_and_clashing_columns(spark):
    rows = [
        Row(doc_id=1, text=None, digest="x", bytes=1, root=5),
        Row(doc_id=2, text="", digest="x", bytes=1, root=5),
        Row(doc_id=3, text="  ", digest="x", bytes=1, root=5),
        Row(doc_id=4, text="a b c", digest="x", bytes=1, root=5),
        Row(doc_id=4, text="a b c", digest="x", bytes=1, root=5),
        Row(doc_id=5, text="a b c", digest="x", bytes=1, root=5),
        Row(doc_id=None, text="a b c", digest="x", bytes=1, root=5),
        Row(doc_id=None, text="only here", digest="x", bytes=1, root=5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, bytes int, root int")
    out = sorted(near.classes(docs).collect(), key=str)
    assert len(out) == len(rows)
    by = {(r.doc_id, r.class_id) for r in out}
    assert by == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (None, 4), (None, None)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near.classes(empty).count() == 0


def test_shared_and_missing_ids(spark):
    """A doc_id of several texts links nothing, and near copies without an id are copies."""
    import corpus_pipeline

    rng = random.Random(8)
    text = lambda: [f"u{rng.randrange(10**6)}" for _ in range(100)]
    edited = lambda w: [*w[:50], f"e{rng.randrange(10**6)}", *w[51:]]
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(7, a), (7, b), (7, c), (9, edited(c)), (7, c), (None, d), (None, edited(d)), (None, e), (None, edited(a)), (3, edited(b))]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "web", 1) for i, w in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = near.classes(docs).collect()
    assert len(got) == len(rows)
    named = {r.class_id: r.class_texts for r in got if r.class_id is not None}
    assert sorted(named.values()) == [2, 2, 2] and {3, 7} < set(named) and min(named) < 0
    assert sorted(r.class_texts for r in got if r.class_id is None) == [1, 2, 2]
    kept = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    firsts = {(i or 0, " ".join(w)) for i, w in rows}
    assert set(kept) <= firsts and [i for i, _ in kept] == [0, 0, 3, 7, 7]
    assert {t for i, t in kept if i == 7} == {" ".join(a), " ".join(c)} and (0, " ".join(e)) in kept
