"""Incremental hub KPIs over a stream of milestone files (Structured Streaming).

The batch operator ``kpis.hub_kpis`` re-expressed for files that keep
arriving: the mergeable KPIs (count, mean, sample std, max of the delay) are
kept in the streaming aggregation state per hub; each trigger rewrites the
KPI table (``foreachBatch`` overwrite), adding the dense delay rank on the
hub-sized result. The exact median needs every value and is left to the
batch operator. Restart-safe through the query checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.functions.columns import NO_HUB, non_empty

MILESTONE_SCHEMA = ("leg_id string, planned_mins bigint, effective_mins bigint, hub_id string, "
                    "milestone string, stage_group string, leg_type string, delay_mins bigint, "
                    "seq bigint")


def milestone_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Streaming read of milestone parquet files with a fixed schema."""
    return (spark.readStream.schema(MILESTONE_SCHEMA)
            .option("maxFilesPerTrigger", max_files).parquet(path))


def running_hub_kpis(stream: DataFrame) -> DataFrame:
    """Per-hub running count, mean, sample std and max of the delay."""
    s = stream.filter(F.col("delay_mins").isNotNull() & (F.col("hub_id") != NO_HUB) & non_empty())
    return s.groupBy("hub_id").agg(
        F.count("leg_id").alias("total_outgoing_flow"),
        F.avg("delay_mins").alias("avg_segment_delay"),
        F.stddev_samp("delay_mins").alias("std_delay"),
        F.max("delay_mins").alias("max_delay"))


def start_monitor(stream: DataFrame, out_path: str, checkpoint: str,
                  available_now: bool = False):
    """Start the query: every trigger overwrites ``out_path`` with the
    current KPI table plus its dense delay rank."""
    def publish(batch: DataFrame, _batch_id: int) -> None:
        from hubflow.functions.ranking import dense_rank
        ranked = dense_rank(batch, F.desc("avg_segment_delay"), "avg_segment_delay",
                            "delay_rank")
        ranked.write.mode("overwrite").parquet(out_path)

    w = (running_hub_kpis(stream).writeStream.outputMode("complete")
         .option("checkpointLocation", checkpoint).foreachBatch(publish))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
