"""The flagship query: ticks to hourly bars, log returns, trailing volatility, by hour of the day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import table


def hourly_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.struct("ts", "event_id")
    bars = (
        table(spark, sf_dir, "events")
        .groupBy("event_type", F.date_trunc("hour", "ts").alias("bar"))
        .agg(F.max_by("value", seq).alias("close"))
    )
    # A series has one row an hour here, so its window grows with the calendar and not with the ticks.
    w = W.partitionBy("event_type").orderBy("bar")
    r = bars.withColumn("r", F.ln(F.try_divide("close", F.lag("close").over(w))))
    back = w.rowsBetween(-11, 0)
    vol = r.withColumn("vol", F.when(F.count("r").over(back) == 12, F.stddev_samp("r").over(back)))
    return vol.groupBy(F.hour("bar").cast("long").alias("hour")).agg(
        F.count("r").alias("n"),
        F.round(F.avg("r"), 9).alias("mean_return"),
        F.round(F.avg("vol"), 9).alias("mean_volatility"),
    )


HOURLY_VOLATILITY_SQL = """
WITH bars AS (
  SELECT event_type, date_trunc('hour', ts) AS bar, arg_max(value, row(ts, event_id)) AS close FROM events GROUP BY 1, 2
), r AS (
  SELECT *, ln(close / lag(close) OVER (PARTITION BY event_type ORDER BY bar)) AS r FROM bars
), v AS (
  SELECT *, CASE WHEN count(r) OVER b = 12 THEN stddev_samp(r) OVER b END AS vol FROM r
  WINDOW b AS (PARTITION BY event_type ORDER BY bar ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
)
SELECT hour(bar)::BIGINT AS hour, count(r) AS n, round(avg(r), 9) AS mean_return, round(avg(vol), 9) AS mean_volatility
FROM v GROUP BY 1
"""
