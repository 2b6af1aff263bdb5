"""Filters, bins and labels over long event tables. keys: the columns that name a sequence."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.plans.specs import Condition
from tidewright.units import DAYS_PER_YEAR, years_to_days


def need(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no columns {missing} among {df.columns}")


def truncate(df: DataFrame, max_age: int) -> DataFrame:
    return df.where(F.col("age") <= max_age)


def restrict_window(df: DataFrame, lo: int, hi: int) -> DataFrame:
    return df.where((F.col("age") >= lo) & (F.col("age") < hi))


def attach_persons(df: DataFrame, persons: DataFrame, columns: Sequence[str] = ("birth_year",)) -> DataFrame:
    """df with columns of persons. A person that persons lacks is an error that names some."""
    need(persons, ["person_id", *columns])
    missing = [str(r[0]) for r in df.select("person_id").distinct().join(persons, "person_id", "left_anti").limit(20).collect()]
    if missing:
        raise ValueError(f"persons lacks person_id {', '.join(missing)}")
    return df.join(persons.select("person_id", *columns), "person_id", "left")


def cohort_anchor(persons: DataFrame) -> int | None:
    """The smallest birth year, at which cohorts begin."""
    return persons.agg(F.min("birth_year")).first()[0]


def cohort_col(birth_year: Column, width: int, anchor: int) -> Column:
    return (F.floor((birth_year.cast("int") - anchor) / width) * width + anchor).cast("int")


def cohorts(persons: DataFrame, width: int = 1, anchor: int | None = None) -> DataFrame:
    """(person_id, cohort): the first year of each person's band of width years."""
    anchor = cohort_anchor(persons) if anchor is None else anchor
    return persons.select("person_id", cohort_col(F.col("birth_year"), width, anchor or 0).alias("cohort"))


@dataclasses.dataclass(frozen=True)
class AgeBins:
    """Bins [edge, next edge) in days, labelled by their lower edges in years."""

    edges: tuple[int, ...]
    labels: tuple[float, ...]

    @classmethod
    def years(cls, lo: float, hi: float, width: float = 1.0) -> AgeBins:
        labels = [lo + k * width for k in range(round((hi - lo) / width) + 1)]
        return cls(tuple(map(years_to_days, labels)), tuple(float(x) for x in labels[:-1]))

    def table(self, like: DataFrame) -> DataFrame:
        """(age_bin, lo, hi), one row a bin."""
        rows = list(zip(self.labels, self.edges, self.edges[1:], strict=False))
        return like.sparkSession.createDataFrame(rows, "age_bin double, lo int, hi int")

    def of(self, age: Column) -> Column:
        """The label of an age's bin; null outside all bins."""
        found = F.lit(None).cast("double")
        # A search tree of comparisons: its depth is the logarithm of the number of bins.
        def tree(lo: int, hi: int) -> Column:
            if hi - lo == 1:
                return F.lit(self.labels[lo])
            mid = (lo + hi) // 2
            return F.when(age < self.edges[mid], tree(lo, mid)).otherwise(tree(mid, hi))

        return F.when((age >= self.edges[0]) & (age < self.edges[-1]), tree(0, len(self.labels))).otherwise(found) if self.labels else found


def calendar_year(df: DataFrame) -> DataFrame:
    """df with year: the birth year plus completed years of age."""
    need(df, ["birth_year", "age"])
    return df.withColumn("year", (F.col("birth_year").cast("int") + F.floor(F.col("age") / DAYS_PER_YEAR)).cast("int"))


def condition_on_count(df: DataFrame, keys: Sequence[str], condition: Condition, jumpoff: Column | int | None = None) -> DataFrame:
    """All rows of the sequences that satisfy the condition. jumpoff: an age or a column."""
    need(df, keys)
    anchor = condition.before_age if condition.before_age is not None else jumpoff
    if anchor is None:
        raise ValueError("a condition without before_age needs a jump-off")
    hit = (F.col("event") == condition.event) & (F.col("age") <= anchor)
    n = F.sum(F.when(hit, 1).otherwise(0))
    fits = F.col("_n") >= condition.min_count
    if condition.max_count is not None:
        fits &= F.col("_n") <= condition.max_count
    kept = df.groupBy(*keys).agg(n.alias("_n")).where(fits).select(*keys)
    return df.join(kept, list(keys), "left_semi")


def align_jumpoff(observed: DataFrame, event: str, occurrence: int = 1) -> DataFrame:
    """(person_id, jumpoff): each person's age at that occurrence."""
    order = F.row_number().over(W.partitionBy("person_id").orderBy("age"))
    return observed.where(F.col("event") == event).withColumn("_o", order).where(F.col("_o") == occurrence).select("person_id", F.col("age").alias("jumpoff"))


def restrict_cohorts(persons: DataFrame, observed: DataFrame, max_year: int) -> tuple[DataFrame, DataFrame]:
    """People born up to max_year, and their events."""
    kept = persons.where(F.col("birth_year") <= max_year)
    return kept, observed.join(kept.select("person_id"), "person_id", "left_semi")


def common_windows(runs: DataFrame) -> DataFrame:
    """Rows of people who are in every window. runs has one row a person and window."""
    n = runs.select("age_start", "age_stop").distinct().agg(F.count(F.lit(1)).alias("_all"))
    own = runs.groupBy("person_id").agg(F.count(F.lit(1)).alias("_own")).crossJoin(F.broadcast(n)).where("_own = _all")
    return runs.join(own.select("person_id"), "person_id", "left_semi")


def strata(persons: DataFrame, by: Sequence[str], width: int = 1, anchor: int | None = None) -> DataFrame:
    """(person_id, *by): cohort is computed, other columns are copied."""
    out = persons
    if "cohort" in by:
        anchor = cohort_anchor(persons) if anchor is None else anchor
        out = out.withColumn("cohort", cohort_col(F.col("birth_year"), width, anchor or 0))
    need(out, by)
    return out.select("person_id", *by)
