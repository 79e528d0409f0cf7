"""Near-duplicate classes by BagMinHash over multisets of word shingles.

A text is the multiset of its shingles of five consecutive words (a shorter text: one shingle of all its
words). BagMinHash draws, for every shingle and every dyadic interval (0,1], (1,2], (2,4], ... of weights
below its count, a Poisson process shared by all texts; a point has a time, one of M registers and a
weight level, and counts for a text if the level is within the shingle's count there. A register keeps its
least time, so two texts agree in a register with probability sum(min) / sum(max), the weighted Jaccard
similarity. Points come in order of time, and a process stops when its time passes the largest register.

Signatures are cut into BANDS bands of ROWS registers. Texts with an equal band are candidates; candidate
components are verified by exact multiset overlap, so bands only decide what is compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut
from keyloom.llm.graph import components
from keyloom.llm.text import as_binary, mix, rested, slices, task, windows, word_hashes

SHINGLE = 5
BANDS, ROWS = 25, 5
M = BANDS * ROWS
SIMILAR = 0.8
#: Most texts, and bytes of text, of a block that one task verifies.
BLOCK_TEXTS, BLOCK_BYTES = 1024, 8 << 20
#: Pairs below this share of agreeing registers are not compared exactly; 5.5 deviations below SIMILAR.
AGREE = 0.6

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, count) of all texts, sorted by text and shingle."""
    words, first = word_hashes(texts)
    hashes, start = windows(words, first, SHINGLE)
    text = np.searchsorted(first, start, "right") - 1
    n = np.diff(first)
    for i in np.flatnonzero((n > 0) & (n < SHINGLE)):
        places = np.arange(1, n[i] + 1, dtype=np.uint64) * _A
        value = mix(np.bitwise_xor.reduce(mix(words[first[i] : first[i + 1]] + places), keepdims=True))
        hashes, text = np.append(hashes, value), np.append(text, i)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    if not len(hashes):
        return text, hashes, np.empty(0, np.int64)
    new = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])
    return text[new], hashes[new], np.diff(np.r_[new, len(hashes)])


def signatures(n_texts: int, text: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The M registers of each text; infinite for a text without shingles."""
    sig = np.full((n_texts, M), np.inf)
    flat = sig.reshape(-1)
    levels = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    which = np.repeat(np.arange(len(count)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.where(level > 0, low, 1)  # of the interval (low, low + width]
    own, limit = text[which], count[which] - low
    seed = mix(shingle[which] + level.astype(np.uint64) * _B)
    time = np.zeros(len(which))
    step = np.zeros(1, np.uint64)
    while len(seed):
        step += np.uint64(1)
        r = mix(seed + step * _A)
        u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time -= np.log(u) / (M * width)
        r = mix(r ^ _B)
        register = (r % np.uint64(M)).astype(np.int64)
        at = ((r >> np.uint64(32)) % width.astype(np.uint64)).astype(np.int64)  # width is a power of two
        ok = at < limit
        np.minimum.at(flat, own[ok] * M + register[ok], time[ok])
        rows = np.unique(own)
        top = np.zeros(n_texts)
        top[rows] = sig[rows].max(axis=1)
        go = time < top[own]
        seed, own, time, width, limit = seed[go], own[go], time[go], width[go], limit[go]
    return sig


@task
def _sketch(batches):
    for batch in slices(batches):
        n = batch.num_rows
        texts = as_binary(batch.column("text"))
        text, shingle, count = bags(texts)
        sig = signatures(n, text, shingle, count)
        bits = sig.view(np.uint64).reshape(n, BANDS, ROWS)
        key = np.zeros((n, BANDS), np.uint64)
        for k in range(ROWS):
            key = mix((key + bits[:, :, k]) * _A + np.uint64(k + 1))
        key = mix(key + np.arange(BANDS, dtype=np.uint64) * _B).view(np.int64)
        some = np.isin(np.arange(n), text)
        short = mix(sig.view(np.uint64)).astype(np.uint16)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("digest"),
                batch.column("bytes"),
                pa.array([row if ok else None for row, ok in zip(key, some)], pa.list_(pa.int64())),
                pa.array([row.tobytes() for row in short], pa.binary()),
            ],
            ["doc_id", "digest", "bytes", "bands", "sig"],
        )


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            to = up[up]
            if np.array_equal(to, up):
                self.up = up
                return up
            up = to


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted shingles, counts)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum()) if len(common) else 0
    return low / (int(a[1].sum()) + int(b[1].sum()) - low)


def _bags_of(texts: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    array = pa.array(texts, pa.string())
    batch = pa.RecordBatch.from_arrays([array], ["text"])
    for part in slices([batch]):
        text, shingle, count = bags(part.column("text"))
        cut_at = np.searchsorted(text, np.arange(part.num_rows + 1))
        out += [(shingle[a:b], count[a:b]) for a, b in zip(cut_at, cut_at[1:])]
    return out


def _links(sig, bag, forest: _Forest, leaders, others) -> list[tuple[int, int]]:
    """Links found by comparing each leader with every other text that is not yet in its class.

    A leader is skipped when all others are in its class by then."""
    found = []
    for i in leaders:
        roots = forest.roots()
        rest = others[roots[others] != roots[i]]
        if not len(rest):
            continue
        agree = (sig[rest] == sig[i]).mean(axis=1)
        for j in rest[agree >= AGREE][np.argsort(-agree[agree >= AGREE], kind="stable")]:
            a, b = forest.root(i), forest.root(j)
            if a != b and overlap(bag[i], bag[j]) >= SIMILAR:
                forest.up[max(a, b)] = min(a, b)
                found.append((i, j))
    return found


def _matrix(sig: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sig), np.uint16).reshape(len(sig), M)


def _verify_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """All links between classes of one block: every text outside the largest class so far leads once."""
    pdf = pdf.sort_values("node", kind="stable").reset_index(drop=True)
    sig, bag, forest = _matrix(pdf["sig"]), _bags_of(pdf["text"]), _Forest(len(pdf))
    everyone = np.arange(len(pdf))
    led = np.zeros(len(pdf), bool)
    while True:
        roots = forest.roots()
        size = np.bincount(roots, minlength=len(pdf))
        todo = everyone[(roots != size.argmax()) & ~led]
        if not len(todo):
            break
        i = todo[0]
        led[i] = True
        _links(sig, bag, forest, [i], everyone)
    ids = pdf["node"].to_numpy()
    roots = forest.roots()
    return rested(pd.DataFrame({"a": ids, "b": ids[roots]}))


def _verify_across(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the outsiders and the members of one block that are in other classes."""
    out, all_ = pdf[pdf["outsider"]].reset_index(drop=True), pdf[~pdf["outsider"]].reset_index(drop=True)
    if not len(out) or not len(all_):
        return pd.DataFrame({"a": [], "b": []}).astype("int64")
    both = pd.concat([out, all_], ignore_index=True)
    sig, bag, forest = _matrix(both["sig"]), _bags_of(both["text"]), _Forest(len(both))
    first: dict[int, int] = {}
    for k, root in enumerate(both["root"]):
        forest.up[k] = first.setdefault(root, k)
    others = np.arange(len(out), len(both))
    found = []
    for i in range(len(out)):
        found += _links(sig, bag, forest, [i], others)
    ids = both["node"].to_numpy()
    return rested(pd.DataFrame({"a": [ids[i] for i, _ in found], "b": [ids[j] for _, j in found]}).astype("int64"))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and digest; id_key and no_id are doc_id in a form that joins nulls."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return _keyed(rows.withColumn("digest", digest(F.col("text"))), "doc_id")


def digest(text: Column) -> Column:
    """What identifies a text; a null one is the empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _keyed(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn("id_key", F.coalesce(name, F.lit(0))).withColumn("no_id", F.col(name).isNull())


def _classed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest) per row, and per text digest, rep (its least doc_id), root (its class), copies."""
    rows = _rows(docs)
    sketch = rows.withColumn("bytes", F.octet_length("text").cast("long")).select("doc_id", "text", "digest", "bytes")
    sketch = cut(sketch.mapInArrow(_sketch, "doc_id long, digest binary, bytes long, bands array<long>, sig binary"))

    texts = sketch.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands"), F.first("sig").alias("sig")
    )
    texts = cut(texts.withColumn("node", F.monotonically_increasing_id()))  # a text's number, fixed by the checkpoint
    keyed = texts.select("node", F.explode("bands").alias("key"))
    lead = keyed.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = keyed.join(lead, "key").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    candidates = components(stars)

    # Blocks of bounded size; a component of several blocks is verified in three steps.
    members = candidates.join(texts.select("node", "digest", "rep", "bytes", "sig"), "node")
    sizes = candidates.join(texts.select("node", "bytes"), "node").groupBy("root")
    sizes = sizes.agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_TEXTS)), F.ceil(F.sum("bytes") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks")
    )
    members = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = _keyed(members, "rep").select("digest", "id_key", "no_id", "node", F.col("root").alias("comp"), "block", "blocks", "sig")
    one = ["digest", "id_key", "no_id"]  # the row of a text's least id, once
    blocks = cut(rows.drop("doc_id").join(wanted, one).dropDuplicates(one).drop(*one))
    within = blocks.groupBy("comp", "block").applyInPandas(_verify_block, "a long, b long")
    large = blocks.where("blocks > 1")
    edges = within
    if not large.isEmpty():
        edges = cut(within)
        edges = edges.unionByName(_across(large, edges))
    final = components(edges)
    texts = texts.select("node", "digest", "rep", "copies").join(final, "node", "left")
    return sketch.select("doc_id", "digest"), texts.withColumn("root", F.coalesce("root", "node"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copies, class_texts) per row of docs: class_id is the least doc_id of its class.

    A class is a connected component of texts whose shingle multisets have a weighted Jaccard similarity
    of SIMILAR or more; equal texts are one text (copies counts their rows, class_texts the different
    texts of the class), so links are kept between different texts and copies only point to theirs. Null
    texts equal each other and the empty text; texts without a word are classes by their text. Rows with
    a null doc_id are judged like others and may share a class, which then goes by its least known id;
    classes without any known id have a null class_id, each with its own class_texts. A doc_id that stands
    for several texts links nothing: of classes with one least id that of the least digest has it as
    class_id, and the others have negative numbers made from their digests. Other columns are not read.
    """
    rows, texts = _classed(docs)
    per_class = texts.groupBy("root").agg(F.min("rep").alias("least"), F.min("digest").alias("first"), F.count(F.lit(1)).alias("class_texts"))
    owner = per_class.where("least is not null").groupBy("least").agg(F.min("first").alias("first")).withColumn("owns", F.lit(True))
    per_class = per_class.join(owner, ["least", "first"], "left").withColumn(
        "class_id", F.when(F.col("least").isNull() | F.col("owns"), F.col("least")).otherwise(-1 - F.shiftrightunsigned(F.xxhash64("first"), 1))
    )
    texts = texts.join(per_class.select("root", "class_id", "class_texts"), "root")
    return rows.join(texts.select("digest", "class_id", "copies", "class_texts"), "digest").drop("digest")


def one_per_class(docs: DataFrame) -> DataFrame:
    """One row of docs of each class of texts: of its least doc_id, and of that the least digest; a row
    without an id only where the whole class has none."""
    _, texts = _classed(docs)
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "digest")).alias("f"))
    one = ["digest", "id_key", "no_id"]
    keep = _keyed(first.select("f.rep", "f.digest"), "rep").select(one)
    rows = _keyed(docs.withColumn("digest", digest(F.col("text"))), "doc_id")
    return rows.join(keep, one).dropDuplicates(one).select(*docs.columns)


def _across(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Links between blocks of the components that have several.

    First one text of each class of each block is verified as if these were a component; that merges the
    blocks of a family. Then every text outside the component's largest class is compared with all blocks:
    of any two classes one is not the largest, so no link between classes is missed.
    """
    labelled = blocks.join(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "node")
    chosen = labelled.where("root = node")
    per = chosen.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_TEXTS)).cast("int").alias("parts"))
    chosen = chosen.join(per, "comp").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    merged = cut(chosen.groupBy("comp", "block").applyInPandas(_verify_block, "a long, b long"))
    mine = edges.join(blocks.select(F.col("node").alias("a")), "a", "left_semi").unionByName(merged)
    roots = components(mine).select("node", F.col("root").alias("top"))
    now = cut(labelled.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("top", "node")).drop("top"))
    counts = now.groupBy("comp", "root").agg(F.count(F.lit(1)).alias("n"))
    core = counts.groupBy("comp").agg(F.max_by("root", F.struct("n", "root")).alias("core"))
    outside = now.join(core, "comp").where("root != core")
    parts = outside.groupBy("comp").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_TEXTS)), F.ceil(F.sum(F.octet_length("text")) / F.lit(BLOCK_BYTES))).cast("int").alias("parts")
    )
    outside = outside.join(parts, "comp").withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int"))
    cols = ["comp", "block", "part", "node", "text", "sig", "root", "outsider"]
    left = outside.withColumn("outsider", F.lit(True)).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(cols)
    right = now.withColumn("outsider", F.lit(False)).join(parts, "comp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    links = left.unionByName(right.select(cols)).groupBy("comp", "block", "part").applyInPandas(_verify_across, "a long, b long")
    return merged.unionByName(links)
