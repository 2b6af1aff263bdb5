"""A cohort of six people whose results are known by hand, and frames for single questions."""

from tidewright.plans.specs import GENERATED, PERSON  # noqa: F401
from tidewright.units import years_to_days

A = years_to_days
B, M, D, N = "birth", "marriage", "divorce", "no_event"
PEOPLE = [(0, 1970), (1, 1970), (2, 1975), (3, 1975), (4, 1980), (5, 1980)]
EVENTS = [(0, N, 28), (1, B, 25), (2, B, 24), (2, B, 29), (3, B, 22), (3, B, 26), (3, B, 31), (4, B, 30), (5, B, 27), (5, B, 33)]


def persons(spark):
    return spark.createDataFrame(PEOPLE, "person_id bigint, birth_year smallint")


def observed(spark, rows=None):
    return spark.createDataFrame([(p, A(y), e) for p, e, y in (EVENTS if rows is None else rows)], "person_id bigint, age int, event string")


def as_generated(df, seed=0, start=0, stop=0):
    from pyspark.sql import functions as F

    return df.select("person_id", F.lit(seed).alias("seed"), F.lit(start).alias("age_start"), F.lit(stop).alias("age_stop"), "age", "event")


def rows(df, *columns):
    columns = columns or df.columns
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))
