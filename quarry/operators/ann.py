"""Inverted-file index of vectors: cells of nearest centroids as folders, 8-bit codes of what is left, exact scores for the best.

Vectors are unit vectors here, so cosine similarity is a dot product. A vector is stored in the cell of its nearest centroid
with the difference as 8-bit integers and a scale, beside the vector itself and the payload columns. A search reads the
codes of a few cells, with payload filters pushed down to the scan, and scores what the codes find best exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.vectors import BLOCK, SLICE, cosine, dense_topk, few_rows, ranked, topk_of_queries

#: Centroids are about the root of the number of vectors, at most CELLS, and are fitted on a sample of about PER_CELL vectors each.
CELLS, PER_CELL = 16_384, 64
#: Cell of vectors that no query of the index's dimension is similar to: null, empty, zero, or of another dimension.
ASIDE = -1
#: Rows of the sample that an index keeps, queries of a set that are tried on it, and the share of their nearest that should be found.
SAMPLE, TRIED, SHARE = 65_536, 256, 0.96
#: A filter that leaves fewer rows of the sample than so many for each of the nearest makes a search read all cells.
LEAST = 5
#: Candidates by codes that are scored exactly, for each of the k wanted.
KEPT = 4


def unit(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold a vector of this dimension and some length, and these vectors made unit vectors."""
    fine = np.asarray(pc.list_value_length(lists).fill_null(0)) == dim
    rows = np.flatnonzero(fine)
    matrix = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((matrix * matrix).sum(axis=1))
    some = np.isfinite(norm) & (norm > 0)
    return rows[some], matrix[some] / norm[some][:, None]


def nearest(matrix: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n centroids nearest to each row, the nearest first."""
    away = (centroids * centroids).sum(axis=1)[None, :] / 2 - matrix @ centroids.T
    n = min(n, away.shape[1])
    part = np.argpartition(away, n - 1, axis=1)[:, :n]
    return np.take_along_axis(part, np.argsort(np.take_along_axis(away, part, axis=1), axis=1, kind="stable"), axis=1)


def fit(vectors: DataFrame, dim: int, cells: int | None = None) -> np.ndarray:
    """Centroids of unit vectors by k-means over a sample, chosen by a hash of the ids; one row each."""
    rows = vectors.where(F.size("embedding") == dim).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    fine = rows.withColumn("norm", norm).where("norm > 0")
    n = fine.count()
    if not n:
        return np.zeros((0, dim))
    k = max(1, min(cells or round(n**0.5), CELLS))
    share = min(1.0, PER_CELL * k / n)
    sample = fine.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select(array_to_vector(F.transform("v", lambda x: x / F.col("norm"))).alias("features"))
    return np.array(KMeans(k=k, seed=7, maxIter=10).fit(sample).clusterCenters())


def _coded(dim: int, centroids: np.ndarray):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cell, codes, scale = np.full(n, ASIDE, np.int32), [None] * n, np.zeros(n, np.float32)
            rows, matrix = unit(batch.column("embedding"), dim)
            if len(rows) and len(centroids):
                own = nearest(matrix, centroids, 1)[:, 0]
                rest = matrix - centroids[own]
                size = np.maximum(np.abs(rest).max(axis=1), 1e-30)
                small = np.rint(rest / size[:, None] * 127).astype(np.int8)
                cell[rows], scale[rows] = own, size / 127
                for r, c in zip(rows.tolist(), small, strict=True):
                    codes[r] = c.tobytes()
            columns = {"cell": pa.array(cell), "code": pa.array(codes, pa.binary()), "scale": pa.array(scale)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])

    return code


def write_index(vectors: DataFrame, path: str, payload: Sequence[str] = (), dim: int | None = None, cells: int | None = None) -> None:
    """The index of vectors (vec_id, embedding and payload columns) as files: centroids, and all rows by cell.

    ``dim`` is that of most vectors unless given. Files are cut by size, so a cell with very many vectors is in several,
    and sorted by id. Every row is indexed; those that no query can find lie in the cell ASIDE.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), *payload)
    if dim is None:
        sizes = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dim")).count()
        most = sizes.orderBy(F.desc("count"), "dim").first()
        dim = most["dim"] if most else 0
    centroids = fit(rows, dim, cells)
    listed = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
    spark.createDataFrame(listed, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    coded = rows.mapInArrow(_coded(dim, centroids), f"{kinds}, cell int, code binary, scale float")
    n = rows.count()
    share = min(1.0, SAMPLE / max(n, 1))
    spark.createDataFrame([(n, share)], "n long, share double").coalesce(1).write.parquet(f"{path}/size")
    coded.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20))).drop("code", "scale").coalesce(1).write.parquet(f"{path}/sample")
    spark.createDataFrame([], coded.schema).coalesce(1).write.parquet(f"{path}/kinds")  # without vectors there is no other file
    coded.hint("rebalance", "cell").sortWithinPartitions("cell", "vec_id").write.partitionBy("cell").parquet(f"{path}/vectors")


class Index(NamedTuple):
    """The indexed rows, the centroids (at most CELLS), a sample of about SAMPLE rows with their cells, and its share of the rows."""

    rows: DataFrame
    centroids: np.ndarray
    sample: DataFrame
    share: float

    def probed(self, asked: np.ndarray, k: int, where: Column | None) -> int:
        """Cells that hold SHARE of the k nearest rows that a filter lets through, as the sample tells for some queries (unit vectors).

        Filters may go with the cells, so it is told by what this filter leaves of the sample. Where that is little, all cells.
        """
        every = len(self.centroids)
        found = (self.sample if where is None else self.sample.where(where)).where(F.col("cell") != ASIDE).select("cell", "embedding").toArrow()
        depth = max(1, int(np.ceil(k * self.share)))
        if found.num_rows < LEAST * depth or not len(asked) or not every:
            return every
        rows, matrix = unit(found["embedding"].combine_chunks(), asked.shape[1])
        cell = found["cell"].to_numpy()[rows]
        order = nearest(asked, self.centroids, every)
        turn = np.empty_like(order)
        np.put_along_axis(turn, order, np.arange(every)[None, :], axis=1)
        score = asked @ matrix.T
        score[score > 1 - 1e-9] = -2  # itself
        near = np.argpartition(-score, depth - 1, axis=1)[:, :depth]
        return int(np.quantile(np.take_along_axis(turn, cell[near], axis=1), SHARE, method="higher")) + 1


def read_index(spark: SparkSession, path: str) -> Index:
    """An index that ``write_index`` wrote."""
    found = [r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()]
    kinds = spark.read.parquet(f"{path}/kinds").schema
    sample = spark.read.schema(kinds).parquet(f"{path}/sample").drop("code", "scale")
    return Index(spark.read.schema(kinds).parquet(f"{path}/vectors"), np.array(found, np.float64), sample, spark.read.parquet(f"{path}/size").first()["share"])


def topk(index: Index, query: Sequence[float], k: int, where: Column | None = None, n: int | None = None) -> DataFrame:
    """vec_id, score and rank of about the k vectors most similar to one query: folders of the probed cells alone are read."""
    q = np.asarray(query, np.float64)
    cells: list[int] = []
    if len(index.centroids) and q.shape == index.centroids.shape[1:] and np.any(q):
        own = (q / np.sqrt(q @ q))[None, :]
        cells = nearest(own, index.centroids, n or index.probed(own, k, where))[0].tolist()
    rows = index.rows.where(F.col("cell").isin(cells))
    return dense_topk(rows if where is None else rows.where(where), list(query), k)


def _asked(centroids: np.ndarray, n: int):
    """A row for each query and each cell that it probes."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, matrix = unit(batch.column("embedding"), centroids.shape[1] if len(centroids) else 0)
            if not len(rows) or not len(centroids):
                continue
            near = nearest(matrix, centroids, n)
            raw = pa.array([x.tobytes() for x in matrix], pa.binary())
            for own in near.T:
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column("query_id").take(pa.array(rows)), raw], names=["cell", "query_id", "asked"])

    return ask


def _blocks(columns: Sequence[str], ids: str):
    """Runs of rows of one cell as blocks: their ids and the other columns' bytes put together."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            for own in np.unique(cell):
                rows = np.flatnonzero(cell == own)
                for at in range(0, len(rows), BLOCK):
                    part = batch.take(pa.array(rows[at : at + BLOCK])).sort_by(ids)
                    raw = [b"".join(c.to_pylist()) if pa.types.is_binary(c.type) else c.to_numpy().astype("<f4").tobytes() for c in (part.column(x) for x in columns)]
                    key = part.column(ids)
                    lists = pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key)
                    yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), lists, *(pa.array([x], pa.binary()) for x in raw)], names=["cell", f"{ids}s", *columns])

    return block


def _scored(centroids: np.ndarray, most: int):
    """The best of each block of vectors for each query of a block, by codes."""
    dim = centroids.shape[1] if len(centroids) else 0

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = batch.column("cell")[i].as_py()
                asked_of, ids = (batch.column(c)[i].values.to_numpy() for c in ("query_ids", "vec_ids"))
                asked = np.frombuffer(batch.column("asked")[i].as_buffer(), "<f8").reshape(-1, dim)
                codes = np.frombuffer(batch.column("code")[i].as_buffer(), np.int8).reshape(-1, dim)
                scale = np.frombuffer(batch.column("scale")[i].as_buffer(), "<f4")
                n = min(most, len(ids))
                whole = codes.astype(np.float32).T
                for at in range(0, len(asked), SLICE):
                    some = asked[at : at + SLICE]
                    near = (some @ centroids[cell])[:, None] + (some.astype(np.float32) @ whole) * scale[None, :]
                    near = np.round(near, 5)  # equal vectors, equal scores; ids are in order
                    top = np.argsort(-near, axis=1, kind="stable")[:, :n]
                    columns = [np.repeat(asked_of[at : at + SLICE], n), np.full(n * len(some), cell, np.int32), ids[top].ravel(), np.take_along_axis(near, top, axis=1).ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "cell", "vec_id", "near"])

    return best


def topk_of_set(index: Index, queries: DataFrame, k: int, where: Column | None = None, n: int | None = None) -> DataFrame:
    """query_id, vec_id, score and rank of about the k vectors most similar to each query (vec_id, embedding) of a stated set.

    Blocks of queries meet blocks of vectors in the ``n`` cells that they probe (or as many as the sample tells for some of the
    queries and the filter), KEPT * k candidates of each query are scored exactly. Ties go by vec_id. Queries without a vector of the
    index's dimension have no rows.
    """
    spark = queries.sparkSession
    rows = index.rows.where(F.col("cell") != ASIDE)
    rows = rows if where is None else rows.where(where)
    named = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    if n is None:
        tried = named.orderBy(F.xxhash64("query_id")).limit(TRIED).toArrow()["embedding"].combine_chunks()
        n = index.probed(unit(tried, index.centroids.shape[1])[1] if len(index.centroids) and len(tried) else np.zeros((0, 0)), k, where)
    asked = named.mapInArrow(_asked(index.centroids, n), "cell int, query_id long, asked binary")
    # a cell's queries are dealt by their ids too, so that many that ask the same are in several tasks
    gathered = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", F.pmod(F.xxhash64("query_id"), F.lit(8))).sortWithinPartitions("cell")
    question = gathered.mapInArrow(_blocks(["asked"], "query_id"), "cell int, query_ids array<long>, asked binary")
    stored = rows.select("vec_id", "cell", "code", "scale").mapInArrow(_blocks(["code", "scale"], "vec_id"), "cell int, vec_ids array<long>, code binary, scale binary")
    met = few_rows(stored.join(question, "cell")).mapInArrow(_scored(index.centroids, KEPT * k), "query_id long, cell int, vec_id long, near double")
    found = ranked(met, F.col("near"), "vec_id", KEPT * k, ["query_id"]).select("query_id", "cell", "vec_id")
    exact = found.join(rows.select("cell", "vec_id", "embedding"), ["cell", "vec_id"]).join(named.withColumnRenamed("embedding", "own"), "query_id")
    return ranked(exact, F.round(cosine(F.col("embedding"), F.col("own")), 12), "vec_id", k, ["query_id"]).select("query_id", "vec_id", "score", "rank")


def exact_of_set(index: Index, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """The same exactly: all cells, all rows that the filter lets through."""
    return topk_of_queries(index.rows if where is None else index.rows.where(where), queries, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, wanted and hits: how many of each query's exact neighbours were found."""
    hit = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("hits"))
