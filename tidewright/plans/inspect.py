"""A first look at the tables of an experiment and at the results of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.plans.report import published
from tidewright.plans.specs import PERSON
from tidewright.sources.loaders import Bundle
from tidewright.units import DAYS_PER_YEAR


def overview(bundle: Bundle) -> dict[str, dict]:
    """Columns, rows and people of each table."""
    out = {}
    for name in ("observed", "generated", "persons"):
        df = getattr(bundle, name)
        if df is not None:
            rows, people = df.agg(F.count(F.lit(1)), F.count_distinct("person_id")).first()
            out[name] = {"columns": dict(df.dtypes), "rows": rows, "people": people}
    return out


def sample_sequences(df: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    """The events of n people, by age in years. Who is shown depends on seed alone."""
    who = df.select("person_id").distinct().orderBy(F.xxhash64("person_id", F.lit(seed)), "person_id").limit(n)
    return df.join(F.broadcast(who), "person_id").withColumn("years", F.round(F.col("age") / DAYS_PER_YEAR, 2)).orderBy(*PERSON, "age")


def distributions(df: DataFrame, event: str, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(count, n) of an event over sequences, (event, n), and (years, n) of ages."""
    counts = df.groupBy(*keys).agg(F.count_if(F.col("event") == event).alias("count")).groupBy("count").agg(F.count(F.lit(1)).alias("n"))
    ages = df.groupBy(F.floor(F.col("age") / DAYS_PER_YEAR).alias("years")).agg(F.count(F.lit(1)).alias("n"))
    return counts, df.groupBy("event").agg(F.count(F.lit(1)).alias("n")), ages


def result_tables(directory: str) -> list[str]:
    return [f"{arm}/{name}" for arm, tables in published(directory).items() for name in tables]
