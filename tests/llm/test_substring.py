import random
import re

from pyspark.sql import Row

from keyloom.llm import substring
from keyloom.llm.common import table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k=20):
    """{(doc_id, text): (words, removed, kept)} by a dictionary of all windows."""
    first = {}
    split = [(i if i is not None else -(2**63), t, WORDS.findall(t or "")) for i, t in rows]
    for i, _, w in split:
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = {}
    for (given, t), (i, _, w) in zip(rows, split):
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < (i, s):
                gone[s : s + k] = [True] * k
        out[(given, t)] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, chunk="x", part=1) for i, t in rows], "doc_id long, text string, chunk string, part int")
    got = substring.remove_repeats(docs).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[(r.doc_id, r.text)], r.doc_id
        assert sum(s.words for s in r.spans) == r.n_removed


def test_equals_brute_force_on_tables(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = table(spark, f"/root/testdata/{sf}", "documents")
        want = brute([(r.doc_id, r.text) for r in docs.collect()])
        got = {(r.doc_id, r.text): (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs).collect()}
        assert got == want


def test_phases_overlaps_and_odd_rows(spark):
    rng = random.Random(1)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, rows = new(57), []
    for i in range(40):
        a = rng.randrange(0, 30)
        b = min(57, a + rng.choice([19, 20, 21, 27]))
        rows.append((rng.choice([i, i, i + 1000]), " ".join(new(rng.randrange(0, 25)) + passage[a:b] + new(rng.randrange(0, 9)))))
    loop = " ".join(new(7) * 12)
    rows += [(2000, loop), (2001, " ".join(new(30))), (2002, "a\x0bb\x0cc\td\re\n" * 9), (2003, None), (2004, ""), (2005, " \n"), (None, loop), (3, loop)]
    rows += [(2006, rows[0][1]), (2006, rows[0][1]), (2007, "x " * 100)]
    check(spark, rows)


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_id_over_many_chunks(spark, monkeypatch):
    """Rows of one id, and rows without any, are spread by their texts; results do not change."""
    monkeypatch.setattr(substring, "CHUNK_DOCS", 2)
    rng = random.Random(2)
    passage = [f"p{k}" for k in range(45)]
    rows = []
    for _ in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 20))]
        at = rng.randrange(0, 20)
        rows.append((rng.choice([None, 7, 7, 9]), " ".join(words + passage[at : at + rng.randrange(18, 26)])))
    check(spark, rows)
