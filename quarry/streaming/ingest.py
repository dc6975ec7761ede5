"""Incremental indexing, rate limits and event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.catalog import upsert

#: Requests of a client in an hour.
HOURLY = 30


def requests_per_hour(events: DataFrame, client: str = "user_id", at: str = "ts", limit: int = HOURLY) -> DataFrame:
    """Clients' hours with their requests and those over the limit. Streams need a watermark on ``at`` before."""
    counted = events.groupBy(F.window(at, "1 hour").alias("w"), client).agg(F.count("*").alias("requests"))
    return counted.select(client, F.col("w.start").alias("hour"), "requests", F.greatest(F.lit(0), F.col("requests") - limit).alias("refused"))


def stream_requests(spark: SparkSession, folder: str, schema: str, late: str = "10 minutes") -> DataFrame:
    """The same over events that arrive as files; hours close when the watermark has passed them."""
    events = spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return requests_per_hour(events)


def sliding_requests(events: DataFrame, client: str = "user_id", at: str = "ts", size: str = "1 hour", slide: str = "15 minutes", limit: int = HOURLY) -> DataFrame:
    """Requests of clients in each sliding window, and those over the limit. Streams need a watermark on ``at`` before."""
    counted = events.groupBy(F.window(at, size, slide).alias("w"), client).agg(F.count("*").alias("requests"))
    return counted.select(client, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", F.greatest(F.lit(0), F.col("requests") - limit).alias("refused"))


def stream_sliding(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, late: str = "10 minutes", limit: int = HOURLY) -> None:
    """Closed sliding windows of events that arrive as files, a file a batch, appended to the target; all files there are, then done.

    A window closes when the watermark, ``late`` before the latest event, has passed its end; what comes for it after that batch is
    left out.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source).withWatermark("ts", late)
    sliding_requests(events, limit=limit).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def late_requests(windows: DataFrame, arrived: DataFrame, client: str = "user_id", at: str = "ts", size: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Closed windows that some requests came too late for: the client, start, end and how many came too late."""
    every = sliding_requests(arrived, client, at, size, slide).select(client, "start", "end", F.col("requests").alias("all"))
    closed = windows.agg(F.max("end").alias("closed"))  # one row
    met = every.join(windows.select(client, "start", "requests"), [client, "start"], "left").join(F.broadcast(closed), F.col("end") <= F.col("closed"))
    return met.select(client, "start", "end", (F.col("all") - F.coalesce("requests", F.lit(0))).alias("late")).where("late > 0")


def client_of(forwarded: Column, peer: Column) -> Column:
    """First address that a request was forwarded for, else the peer's."""
    first = F.trim(F.get(F.split(forwarded, ","), 0))
    return F.coalesce(F.nullif(first, F.lit("")), peer)


def _children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in store.listStatus(path)] if store.exists(path) else []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _manifest(spark: SparkSession, table: str, before: int | None = None) -> dict[int, str]:
    """Folder of each bucket by the last whole manifest (of a batch before ``before``)."""
    whole = [int(n) for n in _children(spark, f"{table}/manifest") if (before is None or int(n) < before) and "_SUCCESS" in _children(spark, f"{table}/manifest/{n}")]
    return {r["bucket"]: r["path"] for r in spark.read.parquet(f"{table}/manifest/{max(whole):09d}").collect()} if whole else {}


def read_indexed(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows that an indexed table holds now."""
    paths = sorted(_manifest(spark, table).values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def index_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, buckets: int = 32, files_a_batch: int = 1000) -> None:
    """New files of rows (with ``seq``) put into a table by key, the row of highest seq winning whenever it comes; all files there are, then done.

    The table is bucketed by the key's hash. A batch rewrites the buckets that its keys fall into, beside the old ones,
    and then writes a manifest, one row per bucket, that names each bucket's folder. Readers follow the last whole
    manifest; a batch that is repeated starts from the one before its own, so it does no harm. Buckets that neither this
    batch's manifest nor the one before names are deleted.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")

    def put(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        known = _manifest(own, target, before=number)
        touched = [r["bucket"] for r in batch.select(place.alias("bucket")).distinct().collect()]
        if not touched:
            return
        old = [known[b] for b in touched if b in known]
        current = own.read.schema(batch.schema).parquet(*old) if old else batch.limit(0)
        folder = f"{target}/rows/batch={number}"
        none = own.createDataFrame([], batch.schema)
        rows = upsert(none, current.unionByName(batch), key).withColumn("bucket", place)
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        known |= {b: f"{folder}/bucket={b}" for b in touched}
        before, older = (_manifest(own, target, before=n) for n in (number, number - 1))
        own.createDataFrame(sorted(known.items()), "bucket int, path string").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/{number:09d}")
        for path in set(older.values()) - set(before.values()):  # readers follow this manifest or the one before
            _delete(own, path)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def parse_events(chunks: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """Events of a server-sent stream: its chunks joined in order, split at blank lines, and the JSON after 'data: ' read.

    A tail without a blank line is an event that isn't complete, and is left out. A stream is one answer.
    """
    joined = chunks.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("raw"))
    frames = F.split("raw", "\n\n")
    whole = F.slice(frames, 1, F.size(frames) - 1)
    rows = joined.select(by, F.posexplode(F.filter(whole, lambda x: x.startswith("data: "))).alias("place", "frame"))
    event = F.from_json(F.substring("frame", 7, 1_000_000), "type string, data string")
    return rows.select(by, "place", event.alias("event")).select(by, "place", "event.type", "event.data")


def fold_tokens(events: DataFrame, by: str) -> DataFrame:
    """Each stream's message: its tokens put together."""
    tokens = events.where(F.col("type") == "token").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", "data"))).alias("t"))
    return tokens.select(by, F.array_join(F.transform("t", lambda x: x["data"]), "").alias("message"))
