"""From sequences to outcomes: occurrences, spans, exposure, timing and yes-no questions.

Everything that a question needs of a sequence, its end, the age of a given occurrence, a count,
comes from one grouping of the events, so each question costs one shuffle. A sequence's events of
one token are few (a person's life), so sorting their ages inside the group is cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.operators.slicing import AgeBins, need
from tidewright.plans.specs import GENERATED, WINDOW, Condition, Counted, Framed, Timing
from tidewright.units import DAYS_PER_YEAR


def nth_age(event: str, n: int) -> Column:
    """Aggregate: the age of the n-th event of a kind, null where there are fewer."""
    ages = F.sort_array(F.collect_list(F.when(F.col("event") == event, F.col("age"))))
    return F.when(F.size(ages) >= n, F.element_at(ages, n)) if n > 1 else F.min(F.when(F.col("event") == event, F.col("age")))


def nth_occurrence(df: DataFrame, keys: Sequence[str], event: str, n: int) -> DataFrame:
    """(*keys, age) of the n-th event of a kind; sequences with fewer are absent."""
    need(df, keys)
    return df.where(F.col("event") == event).groupBy(*keys).agg(nth_age(event, n).alias("age")).where("age is not null")


def births(df: DataFrame, keys: Sequence[str], event: str) -> DataFrame:
    """(*keys, order, age): events of a kind, numbered by age."""
    need(df, keys)
    order = F.row_number().over(W.partitionBy(*keys).orderBy("age")).cast("long")
    return df.where(F.col("event") == event).select(*keys, order.alias("order"), "age")


def _start(keys: Sequence[str]) -> Column:
    return (F.col("age_stop") if "age_stop" in keys else F.lit(0)).cast("int")


def spans(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, start_age, end_age): from the jump-off, or birth, to the last event."""
    need(df, keys)
    return df.groupBy(*keys).agg(F.max("age").cast("int").alias("end_age")).select(*keys, _start(keys).alias("start_age"), "end_age")


def _overlap(lo: Column, hi: Column) -> Column:
    days = F.least(F.col("end_age"), hi) - F.greatest(F.col("start_age"), lo)
    return F.greatest(days, F.lit(0)).cast("long")


def exposure(span: DataFrame, bins: AgeBins) -> DataFrame:
    """(keys, age_bin, person_days) for every bin, zeros included. The bins are a fixed small table."""
    keys = [c for c in span.columns if c not in ("start_age", "end_age")]
    return span.crossJoin(F.broadcast(bins.table(span))).select(*keys, "age_bin", _overlap(F.col("lo"), F.col("hi")).alias("person_days"))


def exposure_by_year(span: DataFrame, bins: AgeBins, persons: DataFrame) -> DataFrame:
    """(keys, age_bin, year, person_days) of cells with exposure. A calendar year begins at whole
    years of age, so bins and years share one cutting of the age axis, and only labels shift."""
    keys = [c for c in span.columns if c not in ("start_age", "end_age")]
    first, last = bins.edges[0], bins.edges[-1]
    years = [k for k in range(int(last / DAYS_PER_YEAR) + 2)]
    cuts = sorted({*bins.edges, *(x for k in years if first < (x := -int(-k * DAYS_PER_YEAR // 1)) < last)})
    label = lambda x: next(v for v, e in zip(reversed(bins.labels), reversed(bins.edges[:-1]), strict=True) if e <= x)
    rows = [(label(a), a, b, int(a // DAYS_PER_YEAR)) for a, b in zip(cuts, cuts[1:], strict=False)]
    cells = F.broadcast(span.sparkSession.createDataFrame(rows, "age_bin double, lo int, hi int, k int"))
    born = persons.select("person_id", "birth_year")
    hit = (F.col("end_age") > F.col("lo")) & (F.col("start_age") < F.col("hi"))
    found = span.join(born, "person_id").join(cells, hit)
    return found.select(*keys, "age_bin", (F.col("birth_year").cast("int") + F.col("k")).alias("year"), _overlap(F.col("lo"), F.col("hi")).alias("person_days")).groupBy(*keys, "age_bin", "year").agg(F.sum("person_days").alias("person_days"))


def profile(df: DataFrame, keys: Sequence[str], timing: Timing) -> DataFrame:
    """(*keys, end_age, target_age, origin_age): one grouping for span, target and origin."""
    need(df, keys)
    origin = nth_age(timing.origin.target, timing.origin.occurrence) if timing.origin else F.lit(0)
    out = df.groupBy(*keys).agg(F.max("age").alias("end_age"), nth_age(timing.target, timing.occurrence).alias("target_age"), *([origin.alias("origin_age")] if timing.origin else []))
    return out.where("origin_age is not null") if timing.origin else out.withColumn("origin_age", F.lit(0))


def time_to_event(df: DataFrame, keys: Sequence[str], timing: Timing) -> DataFrame:
    """(*keys, duration, observed). Sequences without the origin are left out; those without the
    target are censored at their end."""
    until = F.coalesce("target_age", "end_age") - F.col("origin_age")
    return profile(df, keys, timing).select(*keys, until.cast("long").alias("duration"), F.col("target_age").isNotNull().alias("observed"))


def _days(x: Column | int | None) -> Column | None:
    return None if x is None else x if isinstance(x, Column) else F.lit(x)


def evaluate_framed(df: DataFrame, keys: Sequence[str], outcome: Framed, jumpoff: Column | int | None = None) -> DataFrame:
    """(*keys, occurred, evaluable). Not evaluable: what the jump-off has settled already, and a
    negative whose span ends inside the frame. jumpoff: an age, or one of keys as a column."""
    kind, value = outcome.frame.kind, outcome.frame.value
    jump = _days(jumpoff)
    if kind == "within" and jump is None:
        raise ValueError("within needs a jump-off")
    target = F.col("target_age")
    lower = {"by_age": F.lit(-1), "within": jump, "within_origin": F.col("origin_age")}[kind]
    upper = F.lit(value) if kind == "by_age" else lower + value
    occurred = F.coalesce((target > lower) & (target <= upper), F.lit(False))
    settled = F.lit(False) if jump is None else (upper <= jump) | F.coalesce(target <= jump, F.lit(False))
    return profile(df, keys, outcome.timing).select(*keys, occurred.alias("occurred"), (~settled & (occurred | (F.col("end_age") >= upper))).alias("evaluable"))


def evaluate_count(df: DataFrame, keys: Sequence[str], query: Counted, jumpoff: Column | int) -> DataFrame:
    """(*keys, occurred, evaluable): events after the jump-off and up to the frame's end."""
    need(df, keys)
    jump = _days(jumpoff)
    upper = F.lit(query.frame.value) if query.frame.kind == "by_age" else jump + query.frame.value
    hit = (F.col("event") == query.event) & (F.col("age") > jump) & (F.col("age") <= upper)
    found = df.groupBy(*keys).agg(F.count_if(hit).alias("_n"), F.max("age").alias("_end"))
    occurred = F.col("_n") >= query.min_events
    return found.select(*keys, occurred.alias("occurred"), (occurred | (F.col("_end") >= upper)).alias("evaluable"))


def life_course(observed: DataFrame, generated: DataFrame) -> DataFrame:
    """Generated sequences with their prompts, all windows at once: every person of a window gets
    the observed past up to the jump-off under every seed of that window."""
    people = generated.select("person_id", *WINDOW).distinct()
    seeds = F.broadcast(generated.select("seed", *WINDOW).distinct())  # replicates a window: a handful
    past = observed.select("person_id", "age", "event").join(people, "person_id").where(F.col("age") <= F.col("age_stop"))
    columns = [*GENERATED, "age", "event"]
    return past.join(seeds, WINDOW).select(*columns).unionByName(generated.select(*columns))


def pooled(df: DataFrame) -> DataFrame:
    """df with unit: each person and seed is a member of the synthetic population of its window."""
    return df.withColumn("unit", F.struct("person_id", "seed"))


def counts_per_run(generated: DataFrame, event: str) -> DataFrame:
    """(*GENERATED, count), zeros included."""
    return generated.groupBy(*GENERATED).agg(F.count_if(F.col("event") == event).alias("count"))


def settled_persons(observed: DataFrame, outcome: Framed, jumpoff: int) -> DataFrame:
    """(person_id) of people whose target occurs and is known at the jump-off."""
    if outcome.frame.kind == "by_age":
        upper = F.lit(outcome.frame.value)
    elif outcome.frame.kind == "within":
        upper = F.lit(jumpoff + outcome.frame.value)
    else:
        upper = F.col("origin_age") + outcome.frame.value
    known = F.col("target_age").isNotNull() & ((upper <= jumpoff) | (F.col("target_age") <= jumpoff))
    return profile(observed, ["person_id"], outcome.timing).where(known).select("person_id")


def condition_persons(observed: DataFrame, condition: Condition, jumpoff: int) -> DataFrame:
    """(person_id) of people whose observed past satisfies the condition."""
    anchor = condition.before_age if condition.before_age is not None else jumpoff
    n = F.count_if((F.col("event") == condition.event) & (F.col("age") <= anchor))
    fits = (F.col("_n") >= condition.min_count) & (F.lit(True) if condition.max_count is None else F.col("_n") <= condition.max_count)
    return observed.groupBy("person_id").agg(n.alias("_n")).where(fits).select("person_id")
