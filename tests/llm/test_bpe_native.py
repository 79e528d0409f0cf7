import public_tokenizers

from keyloom.llm import bpe


def test_higher_order_fold_equals_merges(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    words = ["", "a", " the", " thanedble", "réeuxelle", "\n\n", " 😀", "aaaaaaaa", "12345", " Donaudampf", "\x00\x01"]
    df = spark.createDataFrame([(w,) for w in [*words, " the"]], "word string")
    got = {r.word: r.ids for r in bpe.encode_words(df, path).collect()}
    assert got == {w: (bpe.merge(w.encode(), ranks) if w else None) for w in words}


def test_blanks_split_texts_as_the_library_does(spark):
    import random

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(9)
    parts = [" ", " ", " ", "\n", "\t", "  ", "the", "a", "'s", "'", "12", "3", ".", ",,", "é", "😀", " ", " ", "\x1c", "\x85", "_", "ll", "I'll"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))) for i in range(3000)]
    out = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path, public_tokenizers.PATTERN), path).collect()
    text = dict(rows)
    for r in out:
        assert r.ids == library.encode_ordinary(text[r.doc_id]), repr(text[r.doc_id])
        assert bytes(r.decoded).decode() == text[r.doc_id]
