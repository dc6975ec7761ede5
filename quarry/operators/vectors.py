"""Dense similarity search: one query as an expression, a query set as products of blocks of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, and queries of it that are scored at once: so many rows of scores are in memory.
BLOCK, SLICE = 4096, 256
#: Rows of a batch that Python gets at once where a row is a pair of blocks, some 4 MB.
PAIRS = 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null, empty or zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_of(a: Column, query: list[float]) -> Column:
    """Cosine similarity with one stated vector, whose length is a constant."""
    size = float(np.sqrt(np.dot(query, query)))
    literal = F.array(*(F.lit(float(x)) for x in query)) if query else F.array().cast("array<double>")
    return F.try_divide(dot(a, literal), F.sqrt(dot(a, a)) * F.lit(size))


def ranked(df: DataFrame, score: Column, tie: str, k: int, by: list[str] | None = None) -> DataFrame:
    """The k best rows, of each group if ``by`` is given, with their rank from 1.

    Spark keeps k rows of each task (TakeOrderedAndProject, or WindowGroupLimit for groups) before anything is shuffled.
    """
    scored = df.withColumn("score", score).where(F.col("score").isNotNull())
    if by:
        window = Window.partitionBy(*by).orderBy(F.desc("score"), tie)
        return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    top = scored.orderBy(F.desc("score"), tie).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), tie)))


def dense_topk(vectors: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """vec_id, score and rank of the k vectors most similar to the query vector; filters come before the similarity."""
    chosen = vectors if where is None else vectors.where(where)
    return ranked(chosen.select("vec_id", "embedding"), cosine_of(F.col("embedding"), query), "vec_id", k).drop("embedding")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of unit length: their ids, number of dimensions and doubles. Null, empty and zero vectors are in none."""
    for batch in batches:
        lists = batch.column("embedding")
        size = np.asarray(pc.list_value_length(lists).fill_null(0))
        for dim in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == dim)
            for at in range(0, len(own), BLOCK):
                rows = pa.array(own[at : at + BLOCK])
                matrix = lists.take(rows).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                norm = np.sqrt((matrix * matrix).sum(axis=1))
                fine = norm > 0  # false for nulls, which are nan
                ids = batch.column("vec_id").take(rows).filter(pa.array(fine))
                unit = (matrix[fine] / norm[fine][:, None]).astype("<f8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([dim], pa.int32()), pa.array([unit], pa.binary())], names=["ids", "dim", "unit"])


def few_rows(df: DataFrame) -> DataFrame:
    """``df``, whose rows hold blocks, with the session's batches for Python limited to the bytes of a few blocks."""
    conf, most = df.sparkSession.conf, PAIRS * 2 * BLOCK * 64 * 8
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name)
    if not (now.isdigit() and 0 < int(now) <= most):
        conf.set(name, str(most))
    return df


def topk_of_queries(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score and rank of the k vectors most similar to each query vector, exactly; ties by vec_id.

    Queries and vectors (vec_id long, embedding) are put into blocks, and each block of the stated query set is
    multiplied with each block of vectors, so what is paired are blocks; a pair of blocks gives k rows for each of its
    queries. Vectors of other dimensions than a query's, and null, empty and zero ones, are similar to nothing.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, ids = (batch.column(c)[i].values.to_numpy() for c in ("q_ids", "ids"))
                dim = batch.column("dim")[i].as_py()
                asked, unit = (np.frombuffer(batch.column(c)[i].as_buffer(), "<f8").reshape(-1, dim) for c in ("asked", "unit"))
                for at in range(0, len(q_ids), SLICE):
                    score = np.round(asked[at : at + SLICE] @ unit.T, 12)  # equal vectors, equal scores
                    found = []
                    for q, own in zip(q_ids[at : at + SLICE].tolist(), score, strict=True):
                        some = np.flatnonzero(own >= np.partition(own, -k)[-k]) if len(own) > k else np.arange(len(own))
                        top = some[np.lexsort((ids[some], -own[some]))[:k]]
                        found.append((np.full(len(top), q, np.int64), ids[top], own[top]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    pack = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_packed, "ids array<long>, dim int, unit binary")
    asked = pack(queries).select(F.col("ids").alias("q_ids"), F.col("dim").alias("q_dim"), F.col("unit").alias("asked"))
    pairs = pack(vectors).crossJoin(asked).where("dim = q_dim").drop("q_dim").transform(few_rows).mapInArrow(best, "query_id long, vec_id long, score double")
    return ranked(pairs, F.col("score"), "vec_id", k, ["query_id"])
