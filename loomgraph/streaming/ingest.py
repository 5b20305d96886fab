"""Incremental growth: streams of mentions into graph snapshots, first contents, live activity counts.

Every sink knows a batch by its number: one that runs again does nothing or writes the same files over its own, so each counts
once. State is bounded by watermarks: windows and contents that no row can reach any more are put out and forgotten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import merge
from loomgraph.streaming.buckets import Store


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run_to_end(stream: DataFrame, folder: str, each, mode: str = "append"):
    """Runs a stream to its present end, each(batch, number) for every batch; the ended query."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
    return q


def ingest_mentions(stream: DataFrame, folder: str, merge_rows=merge.merge_nodes, keys: list[str] = merge.NODE_KEY, buckets: int = 64) -> DataFrame:
    """Runs the stream of mentions to its present end and returns the last snapshot. A batch writes the buckets of its keys."""
    store = Store(stream.sparkSession, f"{folder}/nodes", keys, merge_rows, buckets)
    run_to_end(stream, folder, lambda df, i: store.merge(df, i))
    return store.read()


def first_contents(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Seen contents (content, doc_id) and the batch's that are new, one row each."""
    new = batch.groupBy("content").agg(F.min("doc_id").alias("doc_id"))
    return new if old is None else old.unionByName(new.join(old, "content", "left_anti"))


def new_contents(stream: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each content hash; a content is forgotten when the watermark has passed it, so one that comes again
    later than that counts as new."""
    return stream.withColumn("content", F.sha2("text", 256)).withWatermark(time, late).dropDuplicatesWithinWatermark(["content"])


def activity_counts(stream: DataFrame, time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by time window and event type, for late rows up to the watermark."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("started"), "event_type", "n", "total")


def _batch(folder: str, batch_id: int) -> str:
    return f"{folder}/batch={batch_id:08d}"


def append(result: DataFrame, folder: str) -> DataFrame:
    """Runs a stream to its present end in append mode; all that it has put out, from files. A batch's rows are in a folder of its
    number: one that runs again replaces them."""
    spark = result.sparkSession
    out = f"{folder}/result"
    run_to_end(result, folder, lambda df, i: df.write.mode("overwrite").parquet(_batch(out, i)))
    return spark.read.schema(result.schema).option("recursiveFileLookup", "true").parquet(out) if _exists(spark, out) else spark.createDataFrame([], result.schema)


def rejects(stream: DataFrame, folder: str, time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Runs a stream to its present end; the rows that activity_counts, on the same batches, does not count: their window had ended
    when the watermark of the batches before was taken. `reason` says by how much they were late.

    The watermark is kept beside the rows, a number a batch, written before the rows are."""
    spark = stream.sparkSession
    out, marks = f"{folder}/rejects", f"{folder}/watermarks"

    def each(df: DataFrame, i: int) -> None:
        before = spark.read.schema("i long, t timestamp").json(marks).where(F.col("i") < i).agg(F.max("t")).first()[0] if _exists(spark, marks) else None
        most = df.agg(F.max(time).alias("t")).select(F.lit(i).cast("long").alias("i"), "t")
        most.write.mode("overwrite").json(_batch(marks, i))
        held = F.lit(before).cast("timestamp") - F.expr(f"interval {late}")
        gone = df.where(F.window(time, width)["end"] <= held) if before is not None else df.limit(0)
        gone.withColumn("reason", F.concat(F.lit("late by "), (held - F.col(time)).cast("string"))).write.mode("overwrite").parquet(_batch(out, i))

    run_to_end(stream, folder, each)
    return spark.read.option("recursiveFileLookup", "true").parquet(out)
