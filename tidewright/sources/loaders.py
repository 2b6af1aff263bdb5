"""Reading the tables of an experiment."""

from __future__ import annotations

import dataclasses
import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.plans.specs import WINDOW
from tidewright.sources.schema import SchemaError, require, validate
from tidewright.units import DAYS_PER_YEAR, years_to_days, years_to_days_col

logger = logging.getLogger(__name__)


def in_days(df: DataFrame, columns: Sequence[str], unit: str, artifact: str) -> DataFrame:
    """Ages as integer days; in days they must be whole already."""
    if unit not in ("days", "years"):
        raise ValueError(f"age_unit is days or years, not {unit!r}")
    if unit == "years":
        return df.withColumns({c: years_to_days_col(F.col(c)) for c in columns})
    types = dict(df.dtypes)
    loose = [c for c in columns if types[c] in ("double", "float") or types[c].startswith("decimal")]
    if loose:
        broken = df.agg(*(F.count_if(F.col(c) != F.rint(c)).alias(c) for c in loose)).first()
        if any(broken):
            raise SchemaError(f"{artifact}: ages in days must be whole; set age_unit to years if they are years")
    return df.withColumns({c: F.col(c).cast("int") for c in columns})


def load_observed(spark: SparkSession, path: str, age_unit: str = "days", columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    require(df.columns, ["person_id", "age", "event"], "observed")
    return validate(in_days(df.select(*columns) if columns else df, ["age"], age_unit, "observed"), "observed")


def load_generated(spark: SparkSession, path: str, age_unit: str = "days", windows: Sequence[tuple[int, int]] | None = None, seeds: Sequence[int] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """windows in days. A range of the raw columns, whatever their type, reaches the scan; what it
    lets through is filtered exactly after conversion."""
    df = spark.read.parquet(path)
    require(df.columns, ["person_id", "seed", *WINDOW, "age", "event"], "generated")
    df = df.select(*columns) if columns else df
    if seeds is not None:
        df = df.where(F.col("seed").isin(*seeds))
    if windows:
        unit = DAYS_PER_YEAR if age_unit == "years" else 1
        whole = {f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")}
        for k, c in enumerate(WINDOW):
            ends = [w[k] for w in windows]
            lo, hi = (min(ends) - 1) / unit, (max(ends) + 1) / unit
            # Of the column's own kind, so that no cast keeps the filter from the scan.
            df = df.where(F.col(c).between(int(lo // 1), int(-(-hi // 1))) if c in whole else F.col(c).between(lo, hi))
    df = in_days(df, [*WINDOW, "age"], age_unit, "generated")
    if windows is not None:
        df = df.where(reduce(lambda a, b: a | b, ((F.col("age_start") == a) & (F.col("age_stop") == b) for a, b in windows), F.lit(False)))
    return validate(df, "generated")


def load_persons(spark: SparkSession, path: str, covariates: Sequence[str] = ()) -> DataFrame:
    """person_id, birth_year, sex if there is one, and the declared covariates."""
    df = spark.read.parquet(path)
    require(df.columns, ["person_id", "birth_year", *covariates], "persons")
    keep = ["person_id", "birth_year", *(["sex"] if "sex" in df.columns else []), *(c for c in covariates if c != "sex")]
    return validate(df.select(*keep), "persons")


def load_event_definitions(spark: SparkSession, path: str) -> DataFrame:
    return validate(spark.read.csv(path, header=True, inferSchema=False), "event_definitions")


def drop_unknown(df: DataFrame, persons: DataFrame, artifact: str = "generated") -> DataFrame:
    """Rows of people that persons has; others are counted in a warning."""
    unknown = df.join(persons, "person_id", "left_anti").agg(F.count(F.lit(1)), F.count_distinct("person_id")).first()
    if unknown[0]:
        logger.warning("%s: dropped %d rows of %d people that persons lacks", artifact, *unknown)
    return df.join(persons.select("person_id"), "person_id", "left_semi")


def persons_from_sequences(observed: DataFrame, pattern: str = r"YEAR_(\d{4})", tokens: Mapping[str, int] | None = None, allow_missing: bool = False) -> DataFrame:
    """(person_id, birth_year) from each person's earliest token that matches the pattern or is in
    tokens. People without one are an error, or left out."""
    if tokens is not None:
        table = observed.sparkSession.createDataFrame([(str(k), int(v)) for k, v in tokens.items()], "event string, y int")
        found = observed.join(F.broadcast(table), "event", "left")
    else:
        found = observed.withColumn("y", F.expr("try_cast(nullif(regexp_extract(event, '{}', 1), '') as int)".format(pattern.replace("\\", "\\\\").replace("'", "\\'"))))
    out = observed.select("person_id").distinct().join(found.where("y is not null").groupBy("person_id").agg(F.min_by("y", "age").alias("birth_year")), "person_id", "left")
    missing = out.where("birth_year is null").count()
    if missing and not allow_missing:
        raise SchemaError(f"{missing} people have no birth-year token")
    return out.where("birth_year is not null").withColumn("birth_year", F.col("birth_year").cast("smallint"))


@dataclasses.dataclass(frozen=True)
class Bundle:
    """The tables of an experiment and what its events are called."""

    observed: DataFrame
    generated: DataFrame | None
    persons: DataFrame | None
    labels: Mapping[str, str]
    events: Mapping[str, str]

    def token(self, alias: str) -> str:
        if alias not in self.events:
            raise KeyError(f"no event {alias!r}; there are {sorted(self.events)}")
        return self.events[alias]

    def label(self, token: object) -> str:
        return self.labels.get(str(token), str(token))

    def windows(self) -> DataFrame:
        """(age_start, age_stop, n_seeds, n_persons)."""
        source = self.generated if self.generated is not None else self.observed.sparkSession.createDataFrame([], "person_id string, seed int, age_start int, age_stop int")
        return source.groupBy(*WINDOW).agg(F.count_distinct("seed").alias("n_seeds"), F.count_distinct("person_id").alias("n_persons"))

    def population(self) -> dict:
        if self.persons is None:
            return {"n_persons": self.observed.agg(F.count_distinct("person_id")).first()[0], "sex": None, "birth_years": None}
        n, lo, hi = self.persons.agg(F.count_distinct("person_id"), F.min("birth_year"), F.max("birth_year")).first()
        sex = {str(r["sex"]): r["count"] for r in self.persons.groupBy("sex").count().collect()} if "sex" in self.persons.columns else None
        return {"n_persons": n, "sex": sex, "birth_years": (lo, hi)}


def wanted_windows(config) -> list[tuple[int, int]] | None:
    """The windows, in days, that the configured arms name; None if one of them takes all."""
    arms = [a for a in (config.arms.backtesting, config.arms.forecasting) if a is not None]
    if not arms or any(a.windows == "all" for a in arms):
        return None
    return sorted({(years_to_days(lo), years_to_days(hi)) for a in arms for lo, hi in a.windows})


def load_all(spark: SparkSession, config) -> Bundle:
    """Everything that a configuration names, checked and cross-checked. Of the generated sequences only
    the windows that some arm reads are scanned."""
    data = config.data
    observed = load_observed(spark, data.observed, data.age_unit)
    generated = load_generated(spark, data.generated, data.age_unit, wanted_windows(config)) if data.generated else None
    persons = load_persons(spark, data.persons, config.persons.covariates) if data.persons else None
    labels = {r["model_representation"]: r["event_definition"] for r in load_event_definitions(spark, data.event_definitions).collect()} if data.event_definitions else {}
    if persons is not None:
        observed = drop_unknown(observed, persons, "observed")
        generated = drop_unknown(generated, persons) if generated is not None else None
    events = {alias: str(token) for alias, token in config.events.items()}
    seen = {r[0] for r in observed.select("event").distinct().collect()}
    for alias, token in events.items():
        if token not in seen:
            logger.warning("event %s (%s) is not among the observed events", alias, token)
    return Bundle(observed, generated, persons, labels, events)
