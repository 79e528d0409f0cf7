"""Byte-level BPE with public rank files.

Each match of the split pattern is encoded on its own: the adjacent pair of pieces with the lowest rank is
merged, the leftmost first among equals, until no pair has a rank. A task folds its distinct words many at a
time, as rows of numbers, and keeps results in a memo of bounded size; decoding concatenates the ids'
binary pieces.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.text import Memo, slices, task

#: Bytes of the memo of words that a task keeps at most; forgotten words are merged again, which costs time
#: but changes nothing. Words of more than LONG bytes are merged one by one and not remembered.
MEMO, LONG = 64 << 20, 64
#: Words that are merged at once at most.
ROWS = 16_384
#: Fixed value: the pattern by which a blank and the words up to the next blank split alike in any text, as
#: no match of it reaches over a blank that follows other characters. Other patterns split texts as wholes.
BLANK_APART = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A blank next to white space, where this does not hold.
_BLANKS = re.compile(r" \s|\s ")


def load_ranks(path: str) -> dict[bytes, int]:
    """piece -> rank of a rank file (base64 piece and rank on each line), read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG:
        return _merge_long(word, ranks)
    pieces = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(a + b) for a, b in zip(pieces, pieces[1:])]
    while True:
        best, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if at < 0:
            return [ranks[p] for p in pieces]
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(pieces[at - 1] + pieces[at])
        if at < len(pairs):
            pairs[at] = ranks.get(pieces[at] + pieces[at + 1])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge, in n log n: pairs wait in a heap by (rank, place), and one that has changed since is passed over."""
    n = len(word)
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        joined = pieces[i] + pieces[after[i]]
        if (r := ranks.get(joined)) is not None:
            heapq.heappush(heap, (r, i, len(joined)))

    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if pieces[i] is not None else n
        if j == n or len(pieces[i]) + len(pieces[j]) != size:
            continue
        pieces[i] += pieces[j]
        pieces[j] = None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[p] for p in pieces if p is not None]


class Merger:
    """A vocabulary in the form that merges many words at once.

    Words are rows of ids, and a table has the id of every two pieces that make a third. In each step every
    row merges its leftmost pair of the lowest rank; only the two pairs around it are looked up again."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        rows = ((ranks.get(t[:i]), ranks.get(t[i:]), r) for t, r in ranks.items() for i in range(1, len(t)))
        table = np.array([x for x in rows if x[0] is not None and x[1] is not None], np.int64).reshape(-1, 3)
        key = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(key)
        self.key, self.made = key[order], table[order, 2].astype(np.int32)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where it is no piece; -1 is no id."""
        key = a.astype(np.int64) << 32 | b
        if not len(self.key):
            return np.full(key.shape, self.NONE)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.made[at], self.NONE)

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes of 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(word) > LONG:
                out[i] = np.array(_merge_long(word, self.ranks), "<i4").tobytes()
            else:
                groups.setdefault(len(word).bit_length(), []).append(i)
        for places in groups.values():
            for part in range(0, len(places), ROWS):
                mine = places[part : part + ROWS]
                for i, ids in zip(mine, self._merged([words[i] for i in mine])):
                    out[i] = ids
        return out

    def _merged(self, words: list[bytes]) -> list[bytes]:
        size = np.array([len(w) for w in words])
        columns = np.arange(size.max())
        ids = np.full((len(words), len(columns) + 1), -1, np.int32)  # one more column, always empty
        ids[:, :-1][columns < size[:, None]] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full(ids.shape, self.NONE)
        rank[:, :-1] = self.pairs(ids[:, :-1], ids[:, 1:])
        done, todo = np.full(ids.shape, -1, np.int32), np.arange(len(words))
        columns = np.arange(ids.shape[1])
        while len(todo):
            at = rank.argmin(axis=1)  # the first of equal ones
            best = rank[np.arange(len(todo)), at]
            go = best < self.NONE
            done[todo[~go]] = ids[~go]
            todo, ids, rank, at, best = todo[go], ids[go], rank[go], at[go], best[go]
            rows = np.arange(len(todo))
            ids[rows, at] = best
            take = np.minimum(columns + (columns > at[:, None]), columns[-1])
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            rank[rows, at] = self.pairs(ids[rows, at], ids[rows, np.minimum(at + 1, columns[-1])])
            some = at > 0
            rank[rows[some], at[some] - 1] = self.pairs(ids[rows[some], at[some] - 1], ids[rows[some], at[some]])
        kept = done >= 0
        data, ends = done[kept].astype("<i4").tobytes(), 4 * np.cumsum(kept.sum(axis=1))
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) per row of docs; null and empty texts have no ids, and control strings
    are ordinary text. Equal rows give equal rows; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(Merger(load_ranks(rank_path)))  # a vocabulary, fixed in size
    apart = pattern == BLANK_APART

    @task
    def run(batches):
        import regex

        merger, find = shared.value, regex.compile(pattern).findall
        memo = Memo(MEMO)  # a word behind a blank -> its ids

        def encoded(texts: list[str | None]) -> list[bytes]:
            """The ids of each text. The distinct new words of all texts are merged together."""
            split = [t.split(" ") if t and apart and not _BLANKS.search(t) else None for t in texts]
            # Matches of texts that aren't split at blanks, and of the first words of those that are.
            plain = [find(s[0]) if s else find(t) if t else () for t, s in zip(texts, split)]
            known: dict[str, bytes | None] = dict.fromkeys(w for s in split if s for w in s[1:])
            spread: dict[str, list[str]] = {}
            for word in known:
                got = memo.get(word)
                if got is None and (got := memo.old.get(word)) is not None:
                    memo.keep(word, got, 2 * len(word) + len(got))
                if got is None:
                    spread[word] = find(f" {word}")
                known[word] = got
            new = dict.fromkeys(m for matches in (*plain, *spread.values()) for m in matches)
            ids = dict(zip(new, merger.words([m.encode() for m in new])))
            for word, matches in spread.items():
                known[word] = got = b"".join(map(ids.__getitem__, matches))
                if len(word) <= LONG:
                    memo.keep(word, got, 2 * len(word) + len(got))
            return [
                b"".join([*map(ids.__getitem__, first), *map(known.__getitem__, s[1:] if s else ())]) for first, s in zip(plain, split)
            ]

        for batch in slices(batches):
            parts = encoded(batch.column("text").to_pylist())
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in parts], out=offsets[1:])
            ids = pa.array(np.frombuffer(b"".join(parts), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), ids)], ["doc_id", "ids"])

    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_path: str) -> DataFrame:
    """(doc_id, ids, decoded binary) per row of (doc_id, ids); null ids decode to nothing."""
    by_id = {r: p for p, r in load_ranks(rank_path).items()}
    shared = encoded.sparkSession.sparkContext.broadcast([by_id.get(i) for i in range(max(by_id) + 1)])

    @task
    def run(batches):
        pieces = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            ids = batch.column("ids")
            lists = ids.fill_null([]) if ids.null_count else ids
            at = lists.offsets.to_numpy()
            # The taken pieces lie end to end; a row's text is the stretch of its ids.
            taken = pieces.take(lists.values[at[0] : at[-1]])
            ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
            rows = ends[at - at[0]]
            decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(rows.tobytes()), taken.buffers()[2] or pa.py_buffer(b"")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, decoded.cast(pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


#: Buckets of the literal rank map; a lookup hashes to one and searches its few entries.
BUCKETS = 1 << 16


def rank_literal(ranks: dict[bytes, int]):
    """The rank map as one literal: an array of small maps from a piece's hex digits to its rank."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def fold_word(word, literal):
    """array<int> of a word by higher-order functions alone: pieces are strings of hex digits, and each
    step of the fold merges the leftmost adjacent pair of the lowest rank."""
    digits = F.hex(word.cast("binary"))
    rank = lambda key: F.try_element_at(F.get(literal, F.crc32(key.cast("binary")) % BUCKETS), key)

    def step(pieces, _):
        pairs = F.transform(F.sequence(F.lit(0), F.size(pieces) - 2), lambda i: rank(F.concat(F.get(pieces, i), F.get(pieces, i + 1))))

        def merged(r):
            at = F.array_position(r, F.array_min(r)).cast("int")
            pair = F.concat(F.get(pieces, at - 1), F.get(pieces, at))
            joined = F.concat(F.slice(pieces, F.lit(1), at - 1), F.array(pair), F.slice(pieces, at + 2, F.size(pieces)))
            return F.when(F.array_min(r).isNull(), pieces).otherwise(joined)

        return F.when(F.size(pieces) > 1, F.get(F.transform(F.array(pairs), merged), F.lit(0))).otherwise(pieces)

    length = F.octet_length(word)
    single = F.transform(F.sequence(F.lit(1), length), lambda i: F.substring(digits, 2 * i - 1, F.lit(2)))
    pieces = F.when(rank(digits).isNotNull(), F.array(digits)).otherwise(F.aggregate(F.sequence(F.lit(1), length), single, step))
    return F.when(length > 0, F.transform(pieces, rank))


def encode_words(words: DataFrame, rank_path: str) -> DataFrame:
    """(word, ids) of distinct words by higher-order functions over a literal rank map, without Python."""
    literal = rank_literal(load_ranks(rank_path))
    return words.select("word").distinct().select("word", fold_word(F.col("word"), literal).alias("ids"))
