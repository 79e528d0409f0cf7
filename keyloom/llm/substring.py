"""Removal of word sequences that occurred before, by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of BLOCK words. Any WINDOW = 2 * BLOCK words of a
text hold one of its blocks whole, so a window that occurs elsewhere is found there by probing the block
index with every rolling window of BLOCK words. Index and probes meet as fingerprints: each chunk of
documents sends its sorted distinct fingerprints once, delta-coded, and is told which of its own are
blocks that occur twice. Around these anchors the chunk extends: each window of WINDOW words that holds an
anchor is keyed by 112 bits, the first occurrence of each key within the chunk is sent on, and where a key
has an earlier one in another chunk the window is repeated. Overlapping repeated windows merge into the
maximal repeats that are removed.

A chunk sends a fingerprint or key once, however often it holds it, so a passage in a third of all
documents weighs no more than one row per chunk; documents are shuffled once, by a hash of id and text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.text import as_binary, mix, rested, slices, windows, word_hashes

WINDOW, BLOCK = 20, 10
#: Documents, and bytes of text, of a chunk on average: a chunk is what one task holds.
CHUNK_DOCS, CHUNK_BYTES = 2000, 16 << 20
#: Stands for a null doc_id in the order of documents: before all others.
NULL_ID = -(2**63)

_BLOBS = "part int, chunk int, kind int, data binary"


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte integers as byte planes, which compress where values are small."""
    return b"".join(c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)


def _unpack(data: bytes, n_columns: int) -> list[np.ndarray]:
    n = len(data) // (8 * n_columns)
    raw = np.frombuffer(data, np.uint8).reshape(n_columns, 8, n)
    return [np.ascontiguousarray(raw[i].T).reshape(-1).view(np.uint64) for i in range(n_columns)]


def _blobs(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    part, chunk, kind, data = zip(*rows) if rows else ((), (), (), ())
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table({k: pa.array(v, t) for k, v, t in zip(("part", "chunk", "kind", "data"), (part, chunk, kind, data), kinds)})


def _parts(values: np.ndarray, bits: int, part_bits: int):
    """(part, slice) of sorted values of so many bits, by their leading bits."""
    part = (values >> np.uint64(bits - part_bits)).astype(np.int64) if part_bits else np.zeros(len(values), np.int64)
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    return [(int(part[a]), slice(a, b)) for a, b in zip(cuts, [*cuts[1:], len(part)])]


def _hashed(docs: pa.Table):
    """(batch, word hashes, first word of each text) by slices of the chunk."""
    for batch in slices(docs.to_batches()):
        hashes, first = word_hashes(as_binary(batch.column("text")))
        yield batch, hashes, first


def _shared_ids(docs: pa.Table) -> np.ndarray:
    """The ids that several rows of a chunk have. Tags tell rows of an id apart within a chunk, where they
    are made and used; between chunks an id and a place say all that matters."""
    ids, count = np.unique(docs.column("doc_id").fill_null(NULL_ID).to_numpy(), return_counts=True)
    return ids[count > 1]


def _tags(hashes: np.ndarray, first: np.ndarray, ids: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """A hash of each text's words where rows share an id, which tells them apart; else 0."""
    place = np.arange(len(hashes)) - np.repeat(first[:-1], np.diff(first))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + mix(place.astype(np.uint64))), out=total[1:])
    return np.where(np.isin(ids, shared), total[first[1:]] - total[first[:-1]], np.uint64(0))


def _ids(batch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)


class _Steps:
    """The functions that run on chunks and parts; bits of a fingerprint, and of its part."""

    def __init__(self, bits: int, part_bits: int, carry: tuple[str, ...] = ()):
        self.bits, self.part_bits, self.carry = bits, part_bits, carry

    def probes(self, docs: pa.Table) -> pa.Table:
        """Distinct fingerprints of a chunk's rolling windows; flags: 1 a block, 2 found twice here."""
        shift = np.uint64(64 - self.bits)
        rolling, blocks = [], []
        for _, hashes, first in _hashed(docs):
            h, start = windows(hashes, first, BLOCK)
            h >>= shift
            own = start - first[np.searchsorted(first, start, "right") - 1]
            rolling.append(h)
            blocks.append(h[own % BLOCK == 0])
        if not rolling:
            return _blobs([])
        values, count = np.unique(np.concatenate(rolling), return_counts=True)
        block = np.isin(values, np.unique(np.concatenate(blocks)), assume_unique=True)
        coded = (values << np.uint64(2)) | block.astype(np.uint64) | ((count > 1).astype(np.uint64) << np.uint64(1))
        chunk = docs.column("chunk")[0].as_py()
        return _blobs([(p, chunk, 0, _pack(np.diff(coded[s], prepend=np.uint64(0)))) for p, s in _parts(values, self.bits, self.part_bits)])

    def anchors(self, blobs: pa.Table) -> pa.Table:
        """Of one part: for each chunk, those of its fingerprints that are blocks and occur twice."""
        rows = [(c, np.cumsum(_unpack(d, 1)[0], dtype=np.uint64)) for c, d in zip(blobs.column("chunk").to_pylist(), blobs.column("data").to_pylist())]
        coded = np.concatenate([v for _, v in rows])
        values, at = np.unique(coded >> np.uint64(2), return_inverse=True)
        seen = np.bincount(at, weights=1 + ((coded >> np.uint64(1)) & np.uint64(1)).astype(np.float64), minlength=len(values))
        block = np.zeros(len(values), bool)
        block[at[(coded & np.uint64(1)) == 1]] = True
        good = (block & (seen > 1))[at]
        out, done = [], 0
        for chunk, v in rows:
            mine = v[good[done : done + len(v)]] >> np.uint64(2)
            done += len(v)
            if len(mine):
                out.append((0, chunk, 0, _pack(np.diff(mine, prepend=np.uint64(0)))))
        return _blobs(out)

    def extend(self, docs: pa.Table, anchors: pa.Table) -> pa.Table:
        """Keys of the chunk's windows around anchors: first occurrences (kind 0), by part of the key,
        and the windows that repeat an earlier one of this chunk (kind 1)."""
        if not docs.num_rows or not anchors.num_rows:
            return _blobs([])
        known = np.unique(np.concatenate([np.cumsum(_unpack(d, 1)[0], dtype=np.uint64) for d in anchors.column("data").to_pylist()]))
        shift = np.uint64(64 - self.bits)
        keys, more, ids, places, tags = [], [], [], [], []
        shared = _shared_ids(docs)
        for batch, hashes, first in _hashed(docs):
            h, start = windows(hashes, first, BLOCK)
            h >>= shift
            near = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hits = np.zeros(len(hashes) + 1, np.int64)
            hits[1:][start[known[near] == h]] = 1  # a window's first word
            hits = np.cumsum(hits)
            k1, at = windows(hashes, first, WINDOW)
            some = hits[at + BLOCK + 1] > hits[at]
            if not some.any():
                continue
            k2, _ = windows(hashes, first, WINDOW, second=True)
            at = at[some]
            doc = np.searchsorted(first, at, "right") - 1
            keys.append(k1[some])
            more.append(k2[some] >> np.uint64(16))  # with k1 112 bits
            own = _ids(batch)
            ids.append(own[doc])
            places.append(at - first[doc])
            tags.append(_tags(hashes, first, own, shared)[doc])
        if not keys:
            return _blobs([])
        k1, k2, doc, at, tag = map(np.concatenate, (keys, more, ids, places, tags))
        order = np.lexsort((at, doc, k2, k1))
        k1, k2, doc, at, tag = k1[order], k2[order], doc[order], at[order], tag[order]
        later = _later(k1, k2, doc, at)
        chunk = docs.column("chunk")[0].as_py()
        send = [x[~later] for x in (k1, k2, doc.view(np.uint64), at, tag)]
        out = []
        for p, s in _parts(send[0], 64, self.part_bits):
            mine = [x[s] for x in send]
            mine[0] = np.diff(mine[0], prepend=np.uint64(0))
            out.append((p, chunk, 0, _pack(*mine)))
        if later.any():
            out.append((chunk % (1 << self.part_bits), chunk, 1, _places(doc[later], at[later], tag[later])))
        return _blobs(out)

    def repeated(self, blobs: pa.Table) -> pa.Table:
        """Of one part: for each chunk, the windows whose key occurs earlier in another chunk; and what
        the chunks found themselves."""
        chunks, kinds, data = (blobs.column(c).to_pylist() for c in ("chunk", "kind", "data"))
        out = [(0, c, 0, d) for c, k, d in zip(chunks, kinds, data) if k == 1]
        own = [(c, _unpack(d, 5)) for c, k, d in zip(chunks, kinds, data) if k == 0]
        if own:
            chunk = np.concatenate([np.full(len(v[0]), c) for c, v in own])
            k1 = np.concatenate([np.cumsum(v[0], dtype=np.uint64) for _, v in own])
            k2, doc, at, tag = (np.concatenate([v[i] for _, v in own]) for i in range(1, 5))
            order = np.lexsort((at, doc.view(np.int64), k2, k1))
            later = order[_later(k1[order], k2[order], doc[order], at[order])]
            later = later[np.argsort(chunk[later], kind="stable")]
            cuts = np.searchsorted(chunk[later], np.unique(chunk[later]))
            for mine in np.split(later, cuts[1:]) if len(later) else []:
                out.append((0, int(chunk[mine[0]]), 0, _places(doc[mine], at[mine], tag[mine])))
        return _blobs(out)

    def remove(self, docs: pa.Table, found: pa.Table) -> pa.Table:
        """The chunk's documents without the words that repeated windows cover."""
        doc = at = np.empty(0, np.int64)
        tag = np.empty(0, np.uint64)
        if found.num_rows:
            doc, at, tag = map(np.concatenate, zip(*(_from_places(d) for d in found.column("data").to_pylist())))
            order = np.lexsort((at, doc))
            doc, at, tag = doc[order], at[order], tag[order]
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "spans": [], "text": [], "kept": []}
        carried: list[list] = [[] for _ in self.carry]
        shared = _shared_ids(docs)
        for batch, hashes, first in _hashed(docs):
            for values, name in zip(carried, self.carry):
                values.append(batch.column(f"carry_{name}"))
            ids = _ids(batch)
            own = _tags(hashes, first, ids, shared)
            low, high = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
            for i, text in enumerate(as_binary(batch.column("text")).to_pylist()):
                words = (text or b"").split()
                starts = at[low[i] : high[i]][tag[low[i] : high[i]] == own[i]]
                spans = _merge(starts)
                kept, done = [], 0
                for a, n in spans:
                    kept += words[done:a]
                    done = a + n
                kept = kept + words[done:] if spans else words
                out["doc_id"].append(batch.column("doc_id")[i].as_py())
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["spans"].append([{"first": int(a), "words": int(n)} for a, n in spans])
                out["text"].append(text)
                out["kept"].append(b" ".join(kept))
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "text": pa.binary(), "kept": pa.binary()}
        kinds["spans"] = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
        done_columns = {k: pa.array(v, kinds[k]) for k, v in out.items()}
        for name, values in zip(self.carry, carried):
            done_columns[f"carry_{name}"] = pa.chunked_array(values, docs.schema.field(f"carry_{name}").type)
        return pa.table(done_columns)


def _places(doc: np.ndarray, at: np.ndarray, tag: np.ndarray) -> bytes:
    """Windows in order of document and place, which makes their differences small."""
    order = np.lexsort((at, doc.view(np.int64)))
    return _pack(*(np.diff(x[order].view(np.uint64), prepend=np.uint64(0)) for x in (doc, at.astype(np.int64), tag)))


def _from_places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, at, tag = (np.cumsum(x, dtype=np.uint64) for x in _unpack(data, 3))
    return doc.view(np.int64), at.view(np.int64), tag


def _later(k1, k2, doc, at) -> np.ndarray:
    """Of occurrences sorted by key and place: which are at a later place than their key's first."""
    new = np.ones(len(k1), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (doc != doc[head]) | (at != at[head])


def _merge(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans (first word, words) that windows at these sorted starts cover."""
    spans: list[tuple[int, int]] = []
    if not len(starts):
        return spans
    cuts = np.flatnonzero(np.r_[True, np.diff(starts) > WINDOW])
    for a, b in zip(cuts, [*cuts[1:], len(starts)]):
        spans.append((int(starts[a]), int(starts[b - 1]) + WINDOW - int(starts[a])))
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, text, kept, and the columns to carry) per row of docs.

    Removed is each word covered by a window of WINDOW words whose sequence also starts earlier: in a
    document of smaller id (null is the least), or earlier in the same one, rows of one id being one document. Windows are judged on the
    input. spans are the maximal removed runs, kept joins the other words by one space, text is as it
    was. Null and empty texts have no words; texts under WINDOW words stay whole. Equal rows get equal
    results: neither starts earlier. Other columns are not read.
    """
    n_docs, n_bytes = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    chunks = max(8, -(-n_docs // CHUNK_DOCS), -(-n_bytes // CHUNK_BYTES))
    part_bits = max(1, (chunks - 1).bit_length())
    steps = _Steps(min(60, max(32, (400 * max(n_docs, 1)).bit_length() + 9, part_bits)), part_bits, tuple(carry))
    ids = F.col(id_col).cast("long")
    dealt = docs.select(
        ids.alias("doc_id"),
        F.col(text_col).cast("binary").alias("text"),
        # By id and text: rows that share an id, or have none, are spread like others.
        F.pmod(F.xxhash64(ids, text_col), F.lit(chunks)).cast("int").alias("chunk"),
        *(F.col(c).alias(f"carry_{c}") for c in carry),
    )
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name.startswith("carry_"))
    dealt = dealt.repartition(chunks, "chunk")

    probes = dealt.groupBy("chunk").applyInArrow(lambda t: rested(steps.probes(t)), _BLOBS)
    anchors = probes.groupBy("part").applyInArrow(lambda t: rested(steps.anchors(t)), _BLOBS)
    keyed = dealt.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(lambda a, b: rested(steps.extend(a, b)), _BLOBS)
    found = keyed.groupBy("part").applyInArrow(lambda t: rested(steps.repeated(t)), _BLOBS)
    out = dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(
        lambda a, b: rested(steps.remove(a, b)),
        "doc_id long, n_words long, n_removed long, spans array<struct<first: long, words: long>>, text binary, kept binary"
        + kinds,
    )
    return out.select(
        "doc_id", "n_words", "n_removed", "spans", *(F.col(c).cast("string").alias(c) for c in ("text", "kept")),
        *(F.col(f"carry_{c}").alias(c) for c in carry),
    )
