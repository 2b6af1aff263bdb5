"""Sequence tables over a star schema: customers are persons, their orders are observed life events
and the line items of those orders are replicates of what a model might generate. One day between
orders stands for a week of life."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.units import years_to_days

#: Jump-offs of the generated sequences, in years.
JUMPOFFS = (25, 30, 35)
BIRTH, MARRIAGE, DIVORCE = "F", "O", "P"


def _age(date: str):
    return (7 * F.datediff(F.col(date).cast("date"), F.lit("1995-01-01").cast("date"))).cast("int")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(F.col("c_custkey").alias("person_id"), (1950 + F.col("c_custkey") % 41).cast("int").alias("birth_year"), F.col("c_mktsegment").alias("segment"))


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(F.col("o_custkey").alias("person_id"), _age("o_orderdate").alias("age"), F.col("o_orderstatus").alias("event"))


def windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, years_to_days(y)) for y in JUMPOFFS], "age_start int, age_stop int")


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_linenumber").cast("int").alias("seed"), _age("l_shipdate").alias("age"), F.when(F.col("l_returnflag") == "R", BIRTH).when(F.col("l_returnflag") == "A", MARRIAGE).otherwise(DIVORCE).alias("event"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("person_id"))
    runs = items.where(F.col("age") > years_to_days(min(JUMPOFFS))).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return runs.join(F.broadcast(windows(spark)), F.col("age") > F.col("age_stop")).select("person_id", "seed", "age_start", "age_stop", "age", "event")
