"""Toxicity of deobfuscated text.

1. A character model: counts of 4-grams over letters folded to a-z, one class for other letters and the
   word border, summed over the whole texts of all documents.
2. A noisy channel: a token with leetspeak, inner marks or repeated letters, or a run of spaced single
   letters, spans a lattice of letters each character may stand for, may be left out as, or may separate.
   A Viterbi search over character contexts finds the restorations likeliest under the model. A token
   of plain letters has one path and stands for itself.
3. A classifier of restored words: log-odds of words and word beginnings in labelled toxic against other
   documents, discounted to what their counts support; a document's evidence is that of its strongest
   distinct words, and a logistic curve fitted on other labelled documents turns it into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut, in_fold
from keyloom.llm.text import Memo, slices, task

#: Symbols of the character model: border, a to z, any other letter.
N = 28
ORDER = 4
#: Labelled rows that are used for fitting at most, and features that a model keeps at most.
MAX_LABELLED, MAX_FEATURES = 50_000, 50_000
#: Bytes of the memo of tokens that a task keeps at most, and features that it counts before it sends them.
MEMO, COUNTED = 24 << 20, 100_000
#: Restorations of a token that are scored.
BEST = 3
#: Characters of a lattice at most; a longer token is read in stretches that overlap by half.
STRETCH = 64
#: Least discounted log-odds of a feature: e ** LEAST times likelier in a toxic document, at the least.
LEAST = 2.5
#: Lengths of word beginnings, and how many times as many documents a beginning must be in as any one word of it.
PREFIXES, SPREAD = (4, 5, 6, 7, 8), 1.5
#: Strongest words whose evidence is summed.
TOP = 4

#: The letters that a character of leetspeak stands for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
MARKS = " .-_*~,'\"/\\:;#%&^"
#: Costs in nats of replacing a character, leaving out a mark, leaving out a repeated letter, splitting.
REPLACE, LEAVE, REPEAT, SPLIT = 1.0, 0.4, 0.7, 2.5

_SIGN = "[" + re.escape("".join(LEET)) + r"]"
_MARK = "[" + re.escape(MARKS) + r"\s]"
_LETTER = rf"(?:[^\W_]|{_SIGN})"
#: Three or more single letters or signs of leetspeak apart by any marks or white space.
_SPACED = re.compile(rf"(?<!\S){_LETTER}(?:{_MARK}+{_LETTER}){{2,}}(?![^\W_])")
_APART = re.compile(rf"{_MARK}+")
#: A sign of leetspeak anywhere, marks between letters or signs, or a repeated letter.
_ODD = re.compile(rf"{_SIGN}|[^\W_]{_MARK}+[^\W_]|([^\W\d_])\1")
_OUTER, _DIGITS = "".join(c for c in map(chr, range(33, 0x250)) if not c.isalnum() and c not in LEET), "0123456789"
_DOUBLE, _THRICE = re.compile(r"(.)\1+"), re.compile(r"(.)\1{2,}")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def _symbols() -> np.ndarray:
    out = np.zeros(0x3000, np.uint8)
    for c in range(len(out)):
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        out[c] = ord(base) - 96 if "a" <= base <= "z" else (N - 1) * unicodedata.category(chr(c)).startswith("L")
    return out


SYMBOL = _symbols()
_CLASS = SYMBOL.tobytes()  # for single characters


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(raw < len(SYMBOL), SYMBOL[np.minimum(raw, len(SYMBOL) - 1)], N - 1).astype(np.int64)


@task
def _count_grams(batches):
    total = np.zeros(N**ORDER, np.int64)
    for batch in slices(batches):
        text = "\n\n\n".join(t for t in batch.column("text").to_pylist() if t)
        c = _codes(f"\n\n\n{text}\n")
        index = c[3:] + N * (c[2:-1] + N * (c[1:-2] + N * c[:-3]))
        total += np.bincount(index, minlength=N**ORDER)
    some = np.flatnonzero(total)
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(symbol | three before) as an array of N ** ORDER values, from all texts of docs.

    Each task sends one count per 4-gram it has met; the sums have N ** ORDER rows at most."""
    grams = docs.select("text").mapInArrow(_count_grams, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = grams.toArrow()
    count = np.zeros(N**ORDER)
    count[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    p = np.full(N, 1.0 / N)
    for order in range(1, ORDER + 1):
        c = count.reshape(-1, N**order).sum(axis=0).reshape(-1, N)
        total, kinds = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        lower = np.tile(p.reshape(-1, N), (len(c) // max(1, len(p.reshape(-1, N))), 1))
        p = ((c + (kinds + 1) * lower) / (total + kinds + 1)).reshape(-1)
    return np.log(p).astype(np.float32)


def _normal(token: str) -> str:
    """Compatibility forms, lower case, and three of a repeated character at most."""
    return _THRICE.sub(r"\1\1\1", unicodedata.normalize("NFKC", token).lower())


def restore(token: str, model: np.ndarray, best: int = BEST) -> list[str]:
    """The likeliest readings of an obfuscated token, best first; borders in them are spaces.

    The search is exact: every context of three symbols that a path leads to is kept, with its best paths.
    Of a token of over STRETCH characters the readings of all its stretches are returned."""
    chars = _normal(token)
    if chars.isalpha() and len(twice := list(_DOUBLE.finditer(chars))) == 1 and len(twice[0][0]) == 2:
        return [chars, chars[: twice[0].start()] + chars[twice[0].start() + 1 :]]  # all that the lattice holds
    if len(chars) > STRETCH:
        half = STRETCH // 2
        found = (w for at in range(0, len(chars) - half, half) for w in _search(chars[at : at + STRETCH], model, best))
        return list(dict.fromkeys(found))
    return _search(chars, model, best)


def _search(chars: str, model: np.ndarray, best: int) -> list[str]:
    """Viterbi search with the best paths of each context; a context is a number of ORDER - 1 digits."""
    logp, keep = memoryview(model), N ** (ORDER - 2)
    states: dict[int, list[tuple[float, str]]] = {0: [(0.0, "")]}
    previous = ""
    for char in chars:
        code = ord(char)
        own = _CLASS[code] if code < len(_CLASS) else N - 1
        letters = [(ord(x) - 96, x, REPLACE) for x in LEET.get(char, "")]
        split = leave = None
        if own:
            letters.append((own, char, 0.0))
            if char == previous:
                leave = REPEAT
        elif not char.isdigit():
            leave = LEAVE + (char in LEET) if char in MARKS or char in LEET else SPLIT
            split = SPLIT if char in MARKS else SPLIT + 1
        elif not letters:
            leave = SPLIT
        previous = char
        new: dict[int, list[tuple[float, str]]] = {}
        for ctx, paths in states.items():
            for symbol, letter, cost in letters:
                gain, to = logp[ctx * N + symbol] - cost, ctx % keep * N + symbol
                moved = [(s + gain, w + letter) for s, w in paths]
                new[to] = new[to] + moved if to in new else moved
            if leave is not None:
                moved = [(s - leave, w) for s, w in paths]
                new[ctx] = new[ctx] + moved if ctx in new else moved
            if split is not None and ctx % N:
                gain, to = logp[ctx * N] - split, ctx % keep * N
                moved = [(s + gain, w + " ") for s, w in paths]
                new[to] = new[to] + moved if to in new else moved
        states = {k: v if len(v) == 1 else sorted(set(v), reverse=True)[:best] for k, v in new.items()}
    ends = []
    for ctx, paths in states.items():
        end = logp[ctx * N] if ctx % N else 0.0
        ends += [(s + end, w) for s, w in paths]
    out: list[str] = []
    for _, w in sorted(ends, reverse=True):
        if (w := w.strip()) and w not in out:
            out.append(w)
            if len(out) == best:
                break
    return out


def _features(word: str) -> list[str]:
    return [word] + [f"{word[:k]}*" for k in PREFIXES if len(word) > k]


def _forms(token: str) -> set[str]:
    """The character sequences a token's lattices are made of: without outer marks, with and without outer
    signs of leetspeak, and without outer digits, which may be read as letters or be none of the word."""
    inner, plain = token.strip(_OUTER), _EDGE.sub("", token)
    out = {inner, plain}
    if plain and (plain[0].isdigit() or plain[-1].isdigit()) and not plain.isdigit():
        out |= {plain.rstrip(_DIGITS), plain.lstrip(_DIGITS), plain.strip(_DIGITS)}
    return out


def readings(token: str, model: np.ndarray) -> list[str]:
    """The words a token stands for: itself without outer marks, and restored if its lattice has paths."""
    plain = _EDGE.sub("", token).lower()
    out = [plain] if plain else []
    if _ODD.search(token):
        for form in _forms(token):
            if len(form) > 2 and _ODD.search(form):
                out += [w for text in restore(form, model) for w in text.split()]
            elif form:
                out.append(form.lower())
    return list(dict.fromkeys(out))


def _begins(form: str, heads: set[str]) -> bool:
    """Whether a reading of a form may begin as one of heads, which hold the first PREFIXES[0] letters of
    words. A form that may be split or have signs left out may."""
    chars = _normal(form)
    begun, done, previous = {""}, set(), ""
    for char in chars:
        code = ord(char)
        own = _CLASS[code] if code < len(_CLASS) else N - 1
        letters = LEET.get(char, "")
        if not own and not (char.isdigit() and letters):
            return True
        letters = char + letters if own else letters
        new = begun.copy() if own and char == previous else set()
        for b in begun:
            for x in letters:
                (done if len(b) + 1 == PREFIXES[0] else new).add(b + x)
        if not new:
            break
        begun, previous = new, char
    else:
        done |= begun
    return not heads.isdisjoint(done)


def _tokens(text: str, model: np.ndarray) -> set[str]:
    tokens = set(text.split())
    for run in _SPACED.findall(text):
        run = _APART.sub(" ", run)
        if any(c.isalpha() for c in run):
            for form in {run, re.sub(r"(\S)(?: \1)+", r"\1", run), run.replace(" ", "")}:
                tokens |= {w for r in restore(form, model) for w in r.split()}
    return tokens


def _count_features(model):
    @task
    def run(batches):
        logp, memo = model.value, Memo(MEMO)
        seen: dict[str, int] = {}  # feature -> documents, the toxic ones in the high half
        for batch in slices(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = set()
                for token in _tokens(text or "", logp):
                    if (f := memo.get(token) or memo.old.get(token)) is None:
                        f = tuple(dict.fromkeys(x for w in readings(token, logp) for x in _features(w)))
                        memo.keep(token, f, 5 * len(token) + 70 * len(f))
                    found.update(f)
                one = 1 << 32 if toxic else 1
                for f in found:
                    seen[f] = seen.get(f, 0) + one
                if len(seen) >= COUNTED:
                    yield _counted(seen)
                    seen.clear()
        if seen:
            yield _counted(seen)

    return run


def _counted(seen: dict[str, int]) -> pa.RecordBatch:
    n = np.fromiter(seen.values(), np.int64, len(seen))
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(n >> 32), pa.array(n & 0xFFFFFFFF)], ["feature", "pos", "neg"])


NONE = (0.0, "")


class Scorer:
    """The fitted model: (character model, feature weights, curve), as broadcast to tasks."""

    def __init__(self, shared):
        self.shared, self.memo = shared, Memo(MEMO)
        self.heads = {f.rstrip("*")[: PREFIXES[0]] for f in shared[1]}
        #: Tokens without evidence, of MEMO bytes at most, roughly counted, in two ages.
        self.nothing, self.older, self.held = set(), set(), 0

    def evidence(self, text: str | None) -> tuple[float, int]:
        logp, weights, _ = self.shared
        found: dict[str, float] = {}
        for token in _tokens(text or "", logp).difference(self.nothing, self.older):
            e = self.memo.get(token) or self.memo.old.get(token)
            if e is None:
                plain = token.lower() if token.isalpha() else _EDGE.sub("", token).lower()
                e = NONE
                # Where no reading begins as a feature does, none has one.
                if plain[: PREFIXES[0]] in self.heads or _ODD.search(token) and any(_begins(f, self.heads) for f in _forms(token)):
                    for w in readings(token, logp):
                        e = max(e, (max(weights.get(f, 0.0) for f in _features(w)), w))
                if e[0] <= 0:
                    self._forget(token)
                    continue
                self.memo.keep(token, e, len(token))
            found[e[1]] = e[0]
        return sum(sorted(found.values(), reverse=True)[:TOP]), len(found)

    def _forget(self, token: str) -> None:
        self.held += len(token) + 130
        if self.held > MEMO // 2:
            self.nothing, self.older, self.held = set(), self.nothing, len(token) + 130
        self.nothing.add(token)

    def score(self, text: str | None) -> tuple[float, float, int]:
        z, n = self.evidence(text)
        a, b = self.shared[2]
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * z)))), z, n


def _scored(shared, extra):
    @task
    def run(batches):
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            scores, z, n = zip(*(scorer.score(t) for t in batch.column("text").to_pylist()))
            columns = [*(batch.column(c) for c in extra), pa.array(scores, pa.float64()), pa.array(z, pa.float64()), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*extra, "score", "evidence", "n_toxic_words"])

    return run


def _curve(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on z with a weak quadratic penalty, by Newton's method."""
    x, w, penalty = np.c_[np.ones(len(z)), z], np.array([-2.0, 1.0]), np.diag([1e-3, 1e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ (w - [0, 1])
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
    return float(w[0]), float(max(w[1], 0.05))


def fit(docs: DataFrame, labels: DataFrame):
    """A broadcast model from all texts and from labelled rows whose fold is not 0.

    MAX_LABELLED labelled rows at most are used, those of least hash of doc_id; fold 4 of them fits the
    curve and the others the words. Without toxic labels every score is that of no evidence."""
    spark = docs.sparkSession
    logp = character_model(docs)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (in_fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # MAX_LABELLED rows at most
    texts = cut(texts.select(in_fold(F.col("doc_id")).alias("fold"), "text", "toxic"))  # read three times
    shared = spark.sparkContext.broadcast(logp)
    sizes = {r.toxic: r.n for r in texts.where("fold != 4").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    counts = (
        texts.where("fold != 4").select("text", "toxic").mapInArrow(_count_features(shared), "feature string, pos long, neg long")
        .groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    low = F.log((F.col("pos") - 1.64 * F.sqrt("pos") + 0.5) / F.lit(positive + 1.0))
    high = F.log((F.col("neg") + 1.64 * F.sqrt("neg") + 0.5) / F.lit(negative + 1.0))
    strong = counts.where("pos >= 5").withColumn("weight", low - high).where(F.col("weight") > LEAST)
    rows = strong.orderBy(F.desc("weight"), "feature").limit(MAX_FEATURES).collect()
    most: dict[str, int] = defaultdict(int)
    for r in rows:
        if not r.feature.endswith("*"):
            for f in _features(r.feature)[1:]:
                most[f] = max(most[f], r.pos)
    # A beginning counts as a stem only if no single word accounts for it.
    weights = {r.feature: float(r.weight) for r in rows if r.pos >= SPREAD * most.get(r.feature, 0)}
    first = spark.sparkContext.broadcast((logp, weights, (-2.0, 1.0)))
    fitted = texts.where("fold = 4").select("text", "toxic").mapInArrow(_scored(first, ["toxic"]), "toxic int, score double, evidence double, n_toxic_words int")
    pairs = fitted.select("evidence", "toxic").toArrow()  # MAX_LABELLED rows at most
    z, y = pairs.column("evidence").to_numpy(), pairs.column("toxic").to_numpy().astype(float)
    return spark.sparkContext.broadcast((logp, weights, _curve(z, y) if len(y) else (-2.0, 1.0)))


def score(docs: DataFrame, model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, score, evidence and n_toxic_words per row of docs, of the whole text.

    Only the text is looked at. Null, empty and wordless texts have no evidence and get the curve's value
    there; equal texts get equal scores; an empty table gives no rows."""
    rows = docs.select(*dict.fromkeys((*keep, "text")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(_scored(model, list(keep)), f"{kinds}, score double, evidence double, n_toxic_words int")
