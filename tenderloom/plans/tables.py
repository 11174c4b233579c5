"""The driver's star schema in the roles of tenders, profiles, matches and schedules (same rules as in the SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time at which all bound queries run.
NOW = "1998-01-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def code(name: str):
    return F.upper(F.substring(name, 1, 2))


def tenders(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    deadline = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 60).cast("int")))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])  # nation: 25 rows at any scale
    return rows.select(
        F.col("o_orderkey").alias("tender_id"), F.concat(F.lit("src"), (F.col("o_orderkey") % 5).cast("string")).alias("source"), F.col("c_name").alias("buyer"), code("n_name").alias("country"), F.col("c_mktsegment").alias("sector"),
        F.floor(F.col("o_totalprice") * 0.8 + 0.5).cast("int").alias("budget_min"), F.floor(F.col("o_totalprice") + 0.5).cast("int").alias("budget_max"), F.col("o_orderdate").alias("published_at"), deadline.alias("deadline_at"),
    )


TENDERS_SQL = """t AS (
  SELECT o_orderkey AS tender_id, 'src' || (o_orderkey % 5) AS source, c_name AS buyer, upper(left(n_name, 2)) AS country, c_mktsegment AS sector,
         CAST(floor(o_totalprice * 0.8 + 0.5) AS INT) AS budget_min, CAST(floor(o_totalprice + 0.5) AS INT) AS budget_max, o_orderdate AS published_at,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 60 AS INT)) END AS deadline_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Tenders without their buyers, where only the deadline counts."""
    deadline = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 60).cast("int")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("tender_id"), deadline.alias("deadline_at"))


def matches(spark: SparkSession, d: str) -> DataFrame:
    """One match per supplier and order: score, time and chance are maxima over their lines."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("tenant_id"), F.col("l_orderkey").alias("tender_id"))
    win = {"R": "high", "N": "medium", "A": "low"}
    found = rows.agg(F.max((F.col("l_quantity") * 2).cast("int")).alias("fit_score"), F.max("l_shipdate").alias("created_at"), F.max("l_returnflag").alias("_f"), F.max("l_discount").alias("_d"))
    chance = F.when(F.col("_f") == "R", win["R"]).when(F.col("_f") == "N", win["N"]).otherwise(win["A"])
    return found.select("tenant_id", "tender_id", "fit_score", "created_at", chance.alias("win_probability"), (F.col("_d") >= 0.05).alias("interested"))


MATCHES_SQL = """m AS (
  SELECT l_suppkey AS tenant_id, l_orderkey AS tender_id, max(CAST(l_quantity * 2 AS INT)) AS fit_score, max(l_shipdate) AS created_at,
         CASE max(l_returnflag) WHEN 'R' THEN 'high' WHEN 'N' THEN 'medium' ELSE 'low' END AS win_probability, max(l_discount) >= 0.05 AS interested
  FROM lineitem GROUP BY 1, 2)"""


def profiles(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    r = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"])
    k = F.col("s_suppkey")
    low = F.greatest(F.lit(0), F.floor(F.col("s_acctbal") * 10).cast("int"))
    industries = F.when(k % 3 == 0, F.array(F.lit("Building and Machinery"))).when(k % 3 == 1, F.array(F.lit("auto"), F.lit("FURNITURE"))).otherwise(F.array().cast("array<string>"))
    return r.select(
        k.alias("tenant_id"), F.col("s_name").alias("company_name"), F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(code("n_name"))).alias("geographies"), (k % 10 == 0).alias("ignore_location"),
        low.alias("profile_min"), (low + 200000).alias("profile_max"), (k % 40).cast("int").alias("team_size"), industries.alias("industries"), F.array(F.when(k % 4 == 0, "household").otherwise("it")).alias("project_sectors"),
    )


def schedules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda options, by: F.element_at(F.array(*[F.lit(x) for x in options]), (by % len(options) + 1).cast("int"))
    sent = F.when(k % 3 != 0, F.lit("1998-01-07 10:00:00").cast("timestamp") - F.make_dt_interval(hours=(k % 900).cast("int")))
    return table(spark, d, "customer").select(
        k.alias("tenant_id"), pick(["daily", "weekdays", "every_n_days", "weekly", "monthly"], k).alias("frequency"), (k % 6 + 1).cast("int").alias("interval_days"), (k % 12).cast("int").alias("hour_local"), (k % 12 + 6).cast("int").alias("hour_local_end"),
        F.when(k % 13 != 0, (k % 7).cast("int")).alias("day_of_week"), F.when(k % 17 != 0, (k % 31 + 1).cast("int")).alias("day_of_month"), pick(["UTC", "", "Asia/Karachi", "America/New_York", "Mars/Base"], F.floor(k / 5)).alias("timezone"), (k % 19 != 0).alias("enabled"), sent.alias("last_sent_at"),
    )
