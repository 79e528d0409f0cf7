"""Cosine top-k over vectors (ns, id, vec): exact by expressions or matrix blocks, or by an inverted file."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

#: Query vectors of a block, vectors of a block, and scores that are held at once.
QUERY_BLOCK, BLOCK_ROWS, SCORED = 512, 100_000, 4_000_000


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """The unit vector; null for a zero vector, which may not be stored."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: (x.cast("double") / length).cast("float")))


def search(vectors: DataFrame, query: list[float], k: int, ns: str | None = None) -> DataFrame:
    """(id, score) of the k likest vectors (all if k is 0), ties by id; another dimension is an error."""
    q = np.asarray(query, float)
    if not np.linalg.norm(q):
        raise ValueError("a zero vector has no direction")
    rows = vectors if ns is None else vectors.where(F.col("ns") == ns)
    unit = F.array(*(F.lit(float(x)) for x in q))
    checked = F.when(F.size("vec") == len(q), F.col("vec")).otherwise(F.raise_error(F.lit("another dimension")).cast("array<float>"))
    score = dot(checked, unit) / (norm(F.col("vec")) * F.lit(float(np.linalg.norm(q))))
    ranked = rows.select("id", score.alias("score")).orderBy(F.desc("score"), "id")
    return ranked.limit(k) if k > 0 else ranked


def _best(k: int):
    """The k likest vectors of a group's block for each query of its block."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        none = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]).empty_table()
        if not vectors.num_rows or not queries.num_rows:
            return none
        q, ids = _matrix(queries.column("vec")), queries.column("query_id").to_numpy()
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(q)
        for batch in vectors.to_batches(max_chunksize=SCORED // max(1, len(q)) + 1):
            m, own = _matrix(batch.column("vec")), batch.column("id").to_numpy()
            for j, scores in enumerate((m @ q.T).T):
                few = np.argpartition(-scores, k)[:k] if len(scores) > k else np.arange(len(scores))
                few = np.flatnonzero(scores >= scores[few].min()) if len(few) else few  # ties go by id
                s, i = np.r_[best[j][0], scores[few]], np.r_[best[j][1], own[few]]
                order = np.lexsort((i, -s))[:k]
                best[j] = s[order], i[order]
        return pa.table({
            "query_id": np.repeat(ids, [len(s) for s, _ in best]), "id": np.concatenate([i for _, i in best]).astype(np.int64),
            "score": np.concatenate([s for s, _ in best]),
        })

    return run


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = np.asarray(lists.flatten(), float).reshape(len(lists), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def batch_search(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, score, rank) of the k likest vectors for every query (query_id, vec), ties by id.

    Queries are dealt to blocks of about QUERY_BLOCK and vectors to blocks of block_rows; a task compares
    one block of each as a matrix product and sends k rows per query on. Nothing passes the driver but two
    counts. Zero vectors have no direction and are left out."""
    usable = vectors.where(norm(F.col("vec")) > 0).select(F.col("id").cast("long").alias("id"), "vec")
    asked = queries.where(norm(F.col("vec")) > 0).select(F.col("query_id").cast("long").alias("query_id"), "vec")
    query_blocks, blocks = (max(1, -(-df.count() // n)) for df, n in ((asked, QUERY_BLOCK), (usable, block_rows)))
    left = usable.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    left = left.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    key = ["block", "query_block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best(k), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


class InvertedFile:
    """An approximate index: unit vectors in cells around centroids that are fitted on a bounded sample.

    Every vector is indexed, and the index is a table written once, partitioned by cell, so a search reads
    the files of the probes likest cells. With all cells probed it is exact."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.rows = path.rstrip("/"), None
        centres = spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # as many rows as cells
        self.centres = np.array([r.vec for r in centres])
        self.rows = spark.read.parquet(f"{self.path}/vectors")

    @staticmethod
    def build(vectors: DataFrame, path: str, cells: int = 32, sample: int = 10_000, rounds: int = 8) -> InvertedFile:
        """Fit centroids on the sample vectors of least hash, deal all vectors to cells, and write both."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        rows = vectors.select(F.col("id").cast("long").alias("id"), "vec").where(norm(F.col("vec")) > 0)
        picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
        m = _matrix(picked.column("vec")) if picked.num_rows else np.empty((0, 1))
        centres = m[np.random.default_rng(7).choice(len(m), min(cells, len(m)), replace=False)]
        for _ in range(rounds):
            own = (m @ centres.T).argmax(axis=1) if len(m) else np.empty(0, int)
            for c in range(len(centres)):
                if (own == c).any():
                    v = m[own == c].mean(axis=0)
                    centres[c] = v / max(1e-12, np.linalg.norm(v))
        fitted = centres

        def assign(batches):
            for batch in batches:
                if batch.num_rows:
                    cell = pa.array((_matrix(batch.column("vec")) @ fitted.T).argmax(axis=1).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*batch.columns, cell], ["id", "vec", "cell"])

        fields = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
        spark.createDataFrame(fields, "cell int, vec array<double>").write.parquet(f"{path}/centres")
        rows.mapInArrow(assign, "id long, vec array<float>, cell int").write.partitionBy("cell").parquet(f"{path}/vectors")
        return InvertedFile(spark, path)

    def search(self, query: list[float], k: int, probes: int = 8) -> DataFrame:
        q = np.asarray(query, float)
        near = np.argsort(-(self.centres @ q), kind="stable")[:probes].tolist()
        return search(self.rows.where(F.col("cell").isin([int(c) for c in near])), query, k)


def stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("ns").agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("vec")).alias("dimension"))


def rag_join(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Search hits with their documents; hits without one stay."""
    return hits.join(docs, "id", "left").orderBy(F.desc("score"), "id")


@F.pandas_udf(BinaryType())
def encode(vec: pd.Series) -> pd.Series:
    return vec.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def decode(blob: pd.Series) -> pd.Series:
    return blob.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))
