"""The pipeline's stages against brute force on their own input, and on odd rows."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import leaks, near
from keyloom.llm.common import table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=""):
    full = [(i, t, "en", "web", len(t or "")) + (("clash", 1, 0.5, b"x") if extra else ()) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA + extra)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def shingles(text):
    words = text.split()
    grams = [" ".join(words[i : i + near.SHINGLE]) for i in range(len(words) - near.SHINGLE + 1)] or ([" ".join(words)] if words else [])
    return {g: grams.count(g) for g in set(grams)}


def similarity(a, b):
    low = sum(min(a[g], b.get(g, 0)) for g in a)
    return low / (sum(a.values()) + sum(b.values()) - low)


def test_near_copies_equal_all_pairs(spark):
    """One document of each class stays, classes being components of pairs of 0.8 or more among all pairs."""
    rng, rows = random.Random(11), []
    for family in range(12):
        base = [f"f{family}w{k}" for k in range(rng.randrange(40, 120))]
        for _ in range(rng.randrange(1, 6)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 61, " ".join(words)))
    bags = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= near.SIMILAR:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, row in enumerate(rows):
        least[root(i)] = min(least.get(root(i), row), row)
    assert texts(corpus_pipeline.drop_near_copies(spark, documents(spark, rows), SMALL)) == sorted(least.values(), key=str)


def test_leaks_equal_full_alignment(spark):
    """Documents that align with an item of the benchmark go, by a full alignment of every pair."""
    items = [r.text for r in table(spark, SMALL, "benchmark").collect()][:25]
    rng = random.Random(12)
    rows = []
    for i in range(80):
        body = [f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))]
        if i % 2:
            words = rng.choice(items).split()
            for _ in range(rng.randrange(0, max(1, len(words) // 2))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            body[3:3] = words[rng.randrange(0, 1 + len(words) // 3) :]
        rows.append((i, " ".join(body)))
    every = [r.text for r in table(spark, SMALL, "benchmark").collect()]

    def hashed(text):
        return np.array([hash(w) for w in leaks.folded(pa.array([text]))[0].as_py().split()], np.int64)

    own = [hashed(t) for t in every]

    def grams(words):
        return {tuple(words[i : i + leaks.SEED]) for i in range(len(words) - leaks.SEED + 1)}

    def held(text):
        """Accepted alignments; those that have no SEED words in a row unedited aren't promised."""
        words = hashed(text)
        for item in own:
            score = leaks.align(item, words)[0]
            if score >= leaks.LEAK * leaks.MATCH * len(item) and score >= leaks.MATCH * min(leaks.LEAST_WORDS, len(item)):
                yield bool(grams(item) & grams(words))

    promised, accepted = ({i for i, t in rows if f(held(t))} for f in (any, lambda h: len(list(h)) > 0))
    gone = set(range(80)) - {r.doc_id for r in corpus_pipeline.drop_leaks(spark, documents(spark, rows), SMALL).collect()}
    assert promised <= gone <= accepted and len(promised) > 20


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "word " * 30), (5, "word " * 30), (None, "x y z"), (None, None), (5, "another text of that id"), (8, "é ß 😀 " * 9), (9, "l " * 70_000)]
    docs = documents(spark, rows, ", class_id string, digest int, ids double, sig binary")
    out = stage(spark, docs, SMALL)
    if name == "tokens":
        assert out.columns == ["doc_id", "n_tokens", "ids", "text"]
        assert texts(out) == sorted(((i, t or "") for i, t in rows), key=str)
    else:
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        kept = texts(out)
        ids = {i for i, _ in kept}
        assert len(kept) <= len(rows) and {4, 8, 9} <= ids
        if name in ("toxicity", "leaks"):
            assert kept == sorted(rows, key=str)  # clean rows stay as they are, repeated and null ones too
        if name == "near_copies":
            # Null and empty texts are one text, blanks another; equal rows are one.
            assert kept == sorted((r for r in set(rows) if r not in ((2, ""), (None, None))), key=str)
    assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_run_over_a_table(spark):
    docs = table(spark, SMALL, "documents")
    out = corpus_pipeline.run(spark, SMALL)
    assert 0 < out.count() <= docs.count() and out.where(F.size("ids") != F.col("n_tokens")).count() == 0
