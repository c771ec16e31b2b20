"""Streaming additions bound to the test tables: files of a table drive a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import cut
from ..sources.files import scratch
from ..streaming import append, region
from .candidates import campaign_steps
from .registry import TWINS, query


@query("x1_streaming_append", "SELECT p_partkey AS id, p_size::DOUBLE AS score FROM part WHERE p_size BETWEEN 0 AND 9")
def _(t):
    base = scratch(t.spark, "stream")
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"))
    rows.repartition(3, "id").write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    append.append_stream(stream, f"{base}/accepted", f"{base}/quarantine", f"{base}/state", ["id"], "score").awaitTermination()
    return append.read_batches(t.spark, f"{base}/accepted")


@query("x1_streaming_quarantine", "SELECT 'score is out of range' AS reason, count(*) AS n FROM part WHERE p_size NOT BETWEEN 0 AND 9")
def _(t):
    base = scratch(t.spark, "stream")
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"))
    rows.write.parquet(f"{base}/in")
    stream = t.spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    append.append_stream(stream, f"{base}/accepted", f"{base}/quarantine", f"{base}/state", ["id"], "score").awaitTermination()
    return append.count_by_reason(append.read_batches(t.spark, f"{base}/quarantine"))


@query("x2_streaming_region", f"SELECT o_custkey AS campaign, length, successes, failures, best, n_updates FROM ({TWINS['c7_trust_region']})")
def _(t):
    base = scratch(t.spark, "region")
    steps = campaign_steps(t).select(F.col("o_custkey").alias("campaign"), F.col("at").alias("step"), F.col("y").alias("score"))
    steps = cut(steps)
    # a campaign's steps arrive in four parts, one after another: its state lasts from one run of the stream to the next
    cuts = steps.select(F.percentile_approx("step", [0.25, 0.5, 0.75])).first()[0]
    part = sum((F.col("step") > c).cast("int") for c in cuts)

    for k in range(4):
        steps.filter(part == k).repartition("campaign").write.mode("append").parquet(f"{base}/in")
        stream = t.spark.readStream.schema(steps.schema).parquet(f"{base}/in")
        write = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")
        region.region_stream(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    last = t.spark.read.parquet(f"{base}/out").groupBy("campaign").agg(F.max_by(F.struct("length", "successes", "failures", "best", "n_updates"), "batch").alias("s"))
    return last.select("campaign", "s.*")
