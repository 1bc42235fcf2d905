"""Lives made of the order tables, and readers of lives in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from survista.functions.clicks import CLICKS, clicks_of_date
from survista.sources.data import ExpData, as_times, exp_data

PERIOD = (1996, 2001)


def read_lives(spark: SparkSession, path: str, instants: list[str] = ("birth", "E2R_start", "E2R_end"), format: str = "parquet", **options) -> DataFrame:
    """Lives from files; dates become instants, whole numbers are taken as clicks."""
    df = spark.read.format(format).options(**options).load(path)
    kinds = dict(df.dtypes)
    df = df.withColumns({c: clicks_of_date(F.col(c)) for c in instants if c in kinds and kinds[c] in ("date", "timestamp")})
    return as_times(df, [c for c in instants if c in kinds])


def order_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A life per order: observed from the order to its last shipment, dead if a last shipment was returned."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_shipdate", "l_returnflag")
    last = lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("last_back"))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    birth = (F.lit(1925) + F.col("o_custkey") % 40) * F.lit(CLICKS) + (F.col("o_orderkey") % 12) * F.lit(CLICKS // 12)
    df = orders.join(last, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    df = df.select(
        F.col("o_orderkey").cast("long").alias("uid"), birth.cast("long").alias("birth"), clicks_of_date(F.col("o_orderdate")).alias("E2R_start"), clicks_of_date(F.col("last")).alias("E2R_end"),
        F.coalesce(F.col("last") == F.col("last_back"), F.lit(False)).alias("E2R_died"), F.col("o_totalprice").cast("double").alias("pension"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"),
    )
    return as_times(df.where("E2R_end > E2R_start"), ["birth", "E2R_start", "E2R_end"])


def order_experience(spark: SparkSession, sf_dir: str, verify: bool = False) -> ExpData:
    return exp_data(order_lives(spark, sf_dir), *PERIOD, verify=verify)
