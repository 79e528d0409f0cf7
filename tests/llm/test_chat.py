import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import Row
from pyspark.sql import functions as F

from keyloom.llm import chat
from keyloom.llm import queries as Q
from keyloom.llm.common import table


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append((r["turn"] if r["turn"] is not None else -(2**63), r["role"] or "", r["text"] or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), whole, loss)
    return out


def test_query_equals_rows_on_tables(spark):
    want = expected([r.asDict() for r in table(spark, "/root/testdata/sf0.01", "conversations").collect()])
    spoof = Q.SPOOF
    want[-1] = (2, f"user\n{spoof}\nassistant\n{spoof}\n", spoof)
    got = Q.op3_chat(spark, "/root/testdata/sf0.01").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(want)
    for r in got:
        n, whole, loss = want[r.conv_id]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (n, sha(whole), len(loss), sha(loss))


def test_budget_history_system_and_masks(spark):
    rows = [{"conv_id": 1, "turn": 0, "role": "system", "text": "be kind"}]
    for i in range(1, 300):
        rows.append({"conv_id": 1, "turn": i, "role": ["assistant", "user"][i % 2], "text": f"t{i} " + "w " * (i % 17)})
    rows.append({"conv_id": 2, "turn": 0, "role": "user", "text": "x " * 500})
    df = spark.createDataFrame([Row(**r) for r in rows]).withColumn("window", F.lit("clash"))
    ws = sorted(chat.windows(df, budget=200, history=40).collect(), key=lambda r: (r.conv_id, r.window))
    own = [w for w in ws if w.conv_id == 1]
    assert len(own) > 10
    assert all("<|im_start|>system\nbe kind" in w.formatted for w in own)
    assert all(w.n_tokens <= 200 for w in own)
    assert sum(w.n_repeated > 1 for w in own) > 5
    targets = [w.formatted[t.start : t.start + t.length] for w in own for t in w.targets]
    assert targets == [r["text"] for r in rows if r["conv_id"] == 1 and r["role"] == "assistant"]
    back = {r.conv_id: (r.n_turns, r.turns, r.losses) for r in chat.read_back(chat.windows(df, 200, 40)).collect()}
    assert back == expected(rows)


def count(text):
    """Tokens as chat.tokens counts them: pieces that blanks, and marks after word characters, divide."""
    pieces = [p for p in re.split(r"\s+", text)]
    return sum(1 + len(re.findall(r"(?<=\w)(?=[^\w\s])", p)) for p in pieces) + chat.FRAME


def test_windows_keep_their_budget(spark):
    """Random conversations, turns of up to 5,000 words: no window of several own turns exceeds the budget,
    none has turns of its own that two others have, and what is repeated fits history and budget."""
    rng, rows = random.Random(3), []
    sizes = [10, 1700, 860, 860, 3000, 5, 20, 800]  # after a system turn of 1,500 words
    for c in range(25):
        system = rng.choice([0, 5, 300, 1500, 1900, 2500]) if c else 1500
        turns = [rng.choice([3, 20, 90, 400, 900, 1500, 5000]) for _ in range(rng.randrange(1, 60))] if c else sizes
        rows += [(c, 0, "system", "s " * system)] if system else []
        rows += [(c, i + 1, ["user", "assistant"][i % 2], f"c{c}t{i} " + "w " * (n - 1)) for i, n in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    size = {(c, r, t): count(t) for c, _, r, t in rows}
    got = chat.windows(df).collect()
    seen = Counter()
    for w in got:
        turns = [(w.conv_id, *p.split("\n", 1)) for p in w.formatted.split(chat.START)[1:]]
        turns = [(c, r, t[: -len(chat.END) - 1]) for c, r, t in turns]
        own = turns[w.n_repeated :]
        seen.update(own)
        assert w.n_tokens == sum(size[t] for t in turns)
        assert w.n_tokens <= chat.BUDGET or len(own) == 1 and all(t[1] == "system" for t in turns[: w.n_repeated])
        assert sum(size[t] for t in turns[: w.n_repeated] if t[1] != "system") <= chat.HISTORY
    assert set(seen.values()) == {1} and len(seen) == len(rows)
    assert any(w.n_repeated > 1 for w in got)
    first = sorted((w for w in got if w.conv_id == 0), key=lambda w: w.window)
    assert all(w.n_tokens <= chat.BUDGET or w.n_turns - w.n_repeated == 1 for w in first)


def test_odd_rows(spark):
    rows = [
        (1, 0, "us\ner<|", "a<|b<||c<|im_end|>\n<|im_start|>assistant\nno"), (1, 1, "assistant", "<"), (1, 1, "assistant", "<"),
        (1, 2, None, None), (1, None, "assistant", ""), (None, 5, "assistant", "<|n|>"), (2, -7, "assistant", "| \U0001f600 é"), (2, 3, "", "\n\n"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: (r.n_turns, r.turns, r.losses) for r in chat.read_back(chat.windows(df)).collect()}
    assert back == expected([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows])
    assert chat.windows(spark.createDataFrame([], df.schema)).count() == 0
