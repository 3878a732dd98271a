"""Delay cost (F1) and scenario ROI (F2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def cost_rows(t_cost: DataFrame, cost_per_minute: float = 5.0,
              cost_per_shipment: float = 100.0, penalty_rate: float = 0.02) -> DataFrame:
    """Per transport movement: signed delay cost (early arrivals earn credit,
    quirk Q8) and a penalty for every hour beyond the first, clipped at 0."""
    d = F.col("delay_mins").cast("double")
    pen_h = F.greatest(F.lit(0.0), (d - 60) / 60)
    return (t_cost
            .withColumn("delay_cost", d * cost_per_minute)
            .withColumn("penalty_cost", pen_h * penalty_rate * cost_per_shipment)
            .withColumn("total_cost", F.col("delay_cost") + F.col("penalty_cost")))


def hub_costs(rows: DataFrame, kpis: DataFrame) -> DataFrame:
    """A7 + J6: per source hub total cost, shipments, mean delay, its flow
    (left join to the KPI table) and cost per shipment, costliest first."""
    h = rows.groupBy("src").agg(
        F.sum("total_cost").alias("total_cost"),
        F.count("leg_id").alias("shipments"),
        F.avg("delay_mins").alias("avg_delay"))
    k = kpis.select(F.col("hub_id").alias("src"), "total_outgoing_flow")
    return (h.join(k, "src", "left")
            .withColumn("cost_per_shipment", F.col("total_cost") / F.col("shipments"))
            .withColumnRenamed("src", "hub_id")
            .orderBy(F.desc("total_cost"), "hub_id"))


def network_totals(rows: DataFrame) -> DataFrame:
    """One row of network totals, plus the late-only delay cost."""
    return rows.agg(
        F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum("delay_cost"), F.lit(0.0)).alias("total_delay_cost"),
        F.coalesce(F.sum("penalty_cost"), F.lit(0.0)).alias("total_penalty_cost"),
        F.avg("total_cost").alias("avg_cost_per_shipment"),
        F.coalesce(F.sum(F.when(F.col("delay_cost") > 0, F.col("delay_cost"))), F.lit(0.0))
         .alias("late_delay_cost"),
        F.count("*").alias("movements"))


def scenarios_frame(spark: SparkSession, scenarios: list[tuple[str, float, float]]) -> DataFrame:
    """Scenario table ``(name, delay_reduction_pct, implementation_cost)``."""
    return spark.createDataFrame(
        scenarios, "name string, delay_reduction_pct double, implementation_cost double")


def scenario_roi(totals: DataFrame, scenarios: DataFrame) -> DataFrame:
    """annual savings, implementation cost floored at 1, payback months
    (Infinity without savings) and 3-year ROI %, best ROI first. The current
    total cost enters as a scalar subquery of the one-row totals."""
    current = totals.select("total_cost").scalar()
    savings = current * F.col("delay_reduction_pct") / 100
    impl = F.greatest(F.lit(1.0), F.col("implementation_cost"))
    out = scenarios.select(
        F.col("name").alias("scenario"),
        savings.alias("annual_savings"),
        impl.alias("implementation_cost"))
    out = out.withColumn(
        "payback_months",
        F.when(F.col("annual_savings") > 0,
               F.col("implementation_cost") / (F.col("annual_savings") / 12))
         .otherwise(F.lit(float("inf"))))
    out = out.withColumn(
        "roi_3year_pct",
        (F.col("annual_savings") * 3 - F.col("implementation_cost"))
        / F.col("implementation_cost") * 100)
    return out.orderBy(F.desc("roi_3year_pct"), "scenario")
