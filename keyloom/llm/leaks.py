"""Benchmark decontamination by n-gram seeds and Smith-Waterman alignment.

Test items are cut into n-grams of SEED words, and every one of them is a seed: common ones too, since an
edited copy of an item that leaked everywhere keeps just the n-grams that all its copies keep. Items whose
seeds a training text holds, and enough of whose words it holds for an accepted alignment, are aligned
with the surroundings of each cluster of seeds: edited, reordered in part or paraphrased copies lose a few
words of their alignment score, not the match. The surroundings have room for the longest accepted
alignment through a seed, so every accepted alignment that has SEED words in a row unedited is found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.text import slices, task, windows, word_hashes

SEED = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least alignment score as a share of the item's own, and least aligned score in words.
LEAK, LEAST_WORDS = 0.5, 8
#: Items, and bytes of their texts, that are broadcast at a time on average; more are searched in more passes.
ITEM_BLOCK, ITEM_BYTES = 20_000, 16 << 20

_FOLD = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def folded(texts: pa.Array) -> pa.Array:
    """Lower-case texts with ASCII punctuation as spaces."""
    return pa.array([(t or "").lower().encode().translate(_FOLD) for t in texts.to_pylist()], pa.large_binary())


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two arrays of word hashes, and the end of its part of text."""
    place = np.arange(len(text) + 1) * -GAP
    above, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        row = np.zeros(len(text) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(text == word, MATCH, MISMATCH), above[1:] + GAP)
        row = np.maximum(row, 0)
        above = np.maximum.accumulate(row + place) - place  # gaps in the item
        top = int(above.argmax())
        if above[top] > best:
            best, end = int(above[top]), top
    return best, end


class Items:
    """A block of items: hashes of their words, and for each n-gram the items that have it, each with the
    first and the last place where it does."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in rows]
        self.all, self.first = word_hashes(folded(pa.array([t for _, t in rows], pa.string())))
        self.words = [self.all[a:b] for a, b in zip(self.first, self.first[1:])]
        size = np.diff(self.first)
        #: Least matching words of an accepted alignment: its score is MATCH a word at most.
        self.need = np.maximum(np.ceil(LEAK * size), np.minimum(LEAST_WORDS, size)).astype(np.int64)
        grams, start = windows(self.all, self.first, SEED)
        item = np.searchsorted(self.first, start, "right") - 1
        order = np.lexsort((start, item, grams))
        grams, item, place = grams[order], item[order], (start - self.first[item])[order]
        new = np.flatnonzero(np.r_[True, (grams[1:] != grams[:-1]) | (item[1:] != item[:-1])]) if len(grams) else np.empty(0, np.int64)
        self.seed_item, self.seed_first = item[new], place[new]
        self.seed_last = place[np.r_[new[1:], len(grams)] - 1] if len(new) else place
        self.seeds, self.low = np.unique(grams[new], return_index=True)
        #: Items of fewer words than a seed: their words, and which they are.
        self.short: dict[bytes, list[int]] = {}
        for i in np.flatnonzero((size > 0) & (size < SEED)):
            self.short.setdefault(self.words[i].tobytes(), []).append(int(i))
        self.high = np.r_[self.low[1:], len(new)].astype(np.int64)

    def candidates(self, words: np.ndarray, grams: np.ndarray, start: np.ndarray):
        """(item, place in the text, first and last place in the item) of the seeds of one text, sorted, for
        the items of whose words it holds enough. Items are chosen by the text's distinct seeds, so a seed
        that a text repeats without end costs its places for the chosen items only."""
        near = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
        hit = np.flatnonzero(self.seeds[near] == grams)
        seed = near[hit]
        distinct = np.unique(seed)
        n = (self.high - self.low)[distinct]
        pair = _ranges(self.low[distinct], n)
        some = np.unique(self.seed_item[pair])
        if not len(some):
            return (np.empty(0, np.int64),) * 4
        size = self.first[some + 1] - self.first[some]
        held = np.isin(self.all[_ranges(self.first[some], size)], words)
        enough = some[np.add.reduceat(held, np.cumsum(size) - size, dtype=np.int64) >= self.need[some]]
        keep = np.isin(self.seed_item[pair], enough)
        pair, of = pair[keep], np.repeat(distinct, n)[keep]
        low, high = np.searchsorted(of, seed), np.searchsorted(of, seed, "right")
        k = pair[_ranges(low, high - low)]
        item, at = self.seed_item[k], np.repeat(start[hit], high - low)
        order = np.lexsort((at, item))
        return item[order], at[order], self.seed_first[k][order], self.seed_last[k][order]

    def search(self, words: np.ndarray, grams: np.ndarray, start: np.ndarray):
        """(item, score, share, first word, end) of every leak in one text."""
        items, at, early, late = self.candidates(words, grams, start)
        cuts = np.flatnonzero(np.r_[True, items[1:] != items[:-1]]) if len(items) else items
        for low, high in zip(cuts, np.r_[cuts[1:], len(items)]):
            item = int(items[low])
            own, need = self.words[item], self.need[item]
            # An accepted alignment has len(own) gaps at most: that far it strays from a seed's diagonal.
            begin = np.maximum(at[low:high] - late[low:high] - len(own), 0)
            end = np.minimum(at[low:high] - early[low:high] + 2 * len(own), len(words))
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], np.maximum.accumulate(end[order])
            split = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
            best = None
            for a, b in zip(begin[split], end[np.r_[split[1:], len(end)] - 1]):
                if np.isin(own, words[a:b]).sum() < need:
                    continue
                score, stop = align(own, words[a:b])
                if score >= LEAK * MATCH * len(own) and score >= MATCH * min(LEAST_WORDS, len(own)) and (not best or score > best[0]):
                    best = (score, int(a), int(a) + stop)
            if best:
                score, a, stop = best
                back, length = align(own[::-1], words[a:stop][::-1])
                yield item, score / (MATCH * len(own)), stop - length, stop


def _ranges(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low[0], low[0] + 1, ... n[0] of them, then those of low[1] and so on."""
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _hashed(batches):
    for batch in slices(batches):
        hashes, first = word_hashes(folded(batch.column("text")))
        yield batch, hashes, first


def _search(shared, key):
    @task
    def run(batches):
        items = shared.value
        for batch, hashes, first in _hashed(batches):
            h, start = windows(hashes, first, SEED)
            cuts = np.searchsorted(start, first)
            near = np.minimum(np.searchsorted(items.seeds, h), len(items.seeds) - 1) if len(items.seeds) else np.empty(0, np.int64)
            hit = np.flatnonzero(items.seeds[near] == h) if len(near) else near
            docs = np.unique(np.searchsorted(cuts, hit, "right") - 1)
            out: list[tuple] = []
            size = np.diff(first)
            for d in np.flatnonzero((size > 0) & (size < SEED)) if items.short else []:
                for item in items.short.get(hashes[first[d] : first[d + 1]].tobytes(), ()):
                    out.append((int(d), items.ids[item], 1.0, 0, int(size[d])))
            for d in docs:
                a, b = cuts[d], cuts[d + 1]
                words = hashes[first[d] : first[d + 1]]
                for item, share, low, high in items.search(words, h[a:b], start[a:b] - first[d]):
                    out.append((int(d), items.ids[item], float(share), int(low), int(high)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                rows, *columns = [pa.array(v, t) for v, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), *columns], [key, "item_id", "score", "first_word", "end_word"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item_id, score, first_word, end_word) per document and test item that it holds.

    score is the alignment's share of the item's own score, LEAK at least; the words are those of the
    folded text, of the item's best place in the document. Null and wordless texts hold nothing. An item of
    under SEED words says too little to be found within a text; a document that is nothing but it holds it.
    Equal rows give equal rows, and so do items of equal text. Of docs
    and benchmark only key, text and item_id, text are read. Items go to the tasks in blocks of about
    ITEM_BLOCK items and ITEM_BYTES bytes, one pass over the documents each, so no size of benchmark outgrows
    a task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias(key) if key == "doc_id" else key, "text")
    n, size = benchmark.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // ITEM_BLOCK), -(-size // ITEM_BYTES))
    found = None
    for k in range(blocks):
        mine = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text")
        seeds = spark.sparkContext.broadcast(Items(sorted(((r.item_id, r.text) for r in mine.collect()), key=str)))
        kind = rows.schema[key].dataType.simpleString()
        part = rows.mapInArrow(_search(seeds, key), f"{key} {kind}, item_id long, score double, first_word long, end_word long")
        found = part if found is None else found.unionByName(part)
    return found
