"""Rules for impossible and implausible sequences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.operators.outcomes import nth_age
from tidewright.operators.slicing import need
from tidewright.plans.specs import Rule


def check_rules(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """(*keys, age, event, rule, severity): a row for each event that a rule flags.

    Anchors of all rules come from one grouping; order and gap of each token from one window, shared
    by all rules. An event breaks not_before also where the anchor never happens.
    """
    need(df, keys)
    anchors = {(t, o) for r in rules for t, o in ((r.not_after, r.not_after_occurrence), (r.not_before, r.not_before_occurrence)) if t is not None}
    names = {a: f"_a{k}" for k, a in enumerate(sorted(anchors))}
    base = df.select(*keys, "age", "event").where(F.col("event").isin(*{r.event for r in rules}))
    own = W.partitionBy(*keys, "event").orderBy("age")
    seen = base.withColumns({"_o": F.row_number().over(own), "_gap": F.col("age") - F.lag("age").over(own)})
    if names:
        found = df.groupBy(*keys).agg(*(nth_age(t, o).alias(name) for (t, o), name in names.items()))
        seen = seen.join(found, list(keys), "left")

    def broken(r: Rule) -> Column:
        hits = [F.lit(False)]
        if r.min_age is not None:
            hits.append(F.col("age") < r.min_age)
        if r.max_age is not None:
            hits.append(F.col("age") > r.max_age)
        if r.min_spacing is not None:
            hits.append(F.coalesce(F.col("_gap") < r.min_spacing, F.lit(False)))
        if r.not_after is not None:
            hits.append(F.coalesce(F.col("age") > F.col(names[r.not_after, r.not_after_occurrence]), F.lit(False)))
        if r.not_before is not None:
            hits.append(F.coalesce(F.col("age") < F.col(names[r.not_before, r.not_before_occurrence]), F.lit(True)))
        if r.max_count is not None:
            hits.append(F.col("_o") > r.max_count)
        mine = F.col("event") == r.event
        if r.occurrence is not None:
            mine &= F.col("_o") == r.occurrence
        return mine & reduce(lambda a, b: a | b, hits)

    flags = F.array_compact(F.array(*(F.when(broken(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules)))
    return seen.select(*keys, "age", "event", F.explode(flags).alias("_x")).select(*keys, "age", "event", "_x.rule", "_x.severity")


def violation_rates(violations: DataFrame, df: DataFrame, rules: Sequence[Rule], by: Sequence[str]) -> DataFrame:
    """(*by, rule, severity, n_violations, n_events, rate_per_event, n_persons): for every cell of by and
    every rule that was broken anywhere; n_events are all events of the rule's token."""
    known = df.sparkSession.createDataFrame([(r.name, r.severity, r.event) for r in rules], "rule string, severity string, event string")
    used = known.join(violations.select("rule").distinct(), "rule", "left_semi")
    cells = df.groupBy(*by).agg(F.count_distinct("person_id").alias("n_persons")) if by else df.agg(F.count_distinct("person_id").alias("n_persons"))
    broken = violations.groupBy(*by, "rule").agg(F.count(F.lit(1)).alias("n_violations"))
    events = df.groupBy(*by, "event").agg(F.count(F.lit(1)).alias("n_events"))
    out = cells.crossJoin(F.broadcast(used)).join(broken, [*by, "rule"], "left").join(events, [*by, "event"], "left").fillna(0, ["n_violations", "n_events"])
    return out.select(*by, "rule", "severity", "n_violations", "n_events", F.try_divide("n_violations", "n_events").alias("rate_per_event"), "n_persons")
