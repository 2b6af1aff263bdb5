"""Age profiles and frequencies of tokens."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.disclosure import MIN_CELL, suppress
from tidewright.operators.outcomes import exposure
from tidewright.operators.slicing import AgeBins
from tidewright.units import DAYS_PER_YEAR


def bins_for(frames: Sequence[DataFrame], width: float = 1.0) -> AgeBins:
    """Bins from the youngest age's whole year to past the oldest."""
    ends = [f.agg(F.min("age"), F.max("age")).first() for f in frames]
    ends = [(a, b) for a, b in ends if a is not None]
    if not ends:
        return AgeBins((), ())
    lo, hi = math.floor(min(a for a, _ in ends) / DAYS_PER_YEAR), math.ceil(max(b for _, b in ends) / DAYS_PER_YEAR) + 1
    return AgeBins.years(lo, lo + math.ceil((hi - lo) / width) * width, width)


def _tokens(df: DataFrame, tokens: Mapping[str, str]) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(a, str(t)) for a, t in tokens.items()], "alias string, token string"))


def event_age_distribution(events: DataFrame, spans: DataFrame, tokens: Mapping[str, str], bins: AgeBins, unit: Sequence[str] = ("person_id",), by: Sequence[str] = (), min_cell: int = MIN_CELL) -> DataFrame:
    """(*by, alias, token, age_bin, n_events, person_years, rate, share, n_units, n_source_persons,
    n_events_total, suppressed). Every token has every bin, and all tokens of a bin the same exposure."""
    named = _tokens(events, tokens)
    lived = exposure(spans, bins).groupBy(*by, "age_bin").agg((F.sum("person_days") / DAYS_PER_YEAR).alias("person_years"))
    own = events.withColumn("age_bin", bins.of(F.col("age"))).where("age_bin is not null").join(named, events["event"] == named["token"])
    cells = own.groupBy(*by, "alias", "age_bin").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct(F.struct(*unit)).alias("n_units"), F.count_distinct("person_id").alias("n_source_persons"))
    totals = cells.groupBy(*by, "alias").agg(F.sum("n_events").alias("n_events_total"))
    grid = lived.crossJoin(named)
    out = grid.join(cells, [*by, "alias", "age_bin"], "left").join(totals, [*by, "alias"], "left").fillna(0, ["n_events", "n_units", "n_source_persons", "n_events_total"])
    out = out.withColumns({"rate": F.when(F.col("person_years") > 0, F.try_divide("n_events", "person_years")), "share": F.try_divide("n_events", "n_events_total")})
    out = suppress(out, ["n_events", "n_source_persons", "n_events_total"], by=[*by, "alias"], min_cell=min_cell, also=["n_units", "person_years", "rate", "share"], order=["age_bin"])
    return out.select(*by, "alias", "token", "age_bin", "n_events", "person_years", "rate", "share", "n_units", "n_source_persons", "n_events_total", "suppressed")


def token_frequency(events: DataFrame, units: DataFrame, tokens: Mapping[str, str], unit: Sequence[str], by: Sequence[str] = (), min_cell: int = MIN_CELL) -> DataFrame:
    """(*by, alias, token, n_events, n_units, n_units_with_any, share_with_any, n_source_persons,
    n_persons_with_any, mean_person_share, suppressed). units: all sequences, those without events too;
    mean_person_share gives each person one vote, however many sequences they have."""
    named = _tokens(events, tokens)
    keys = list(dict.fromkeys([*by, *unit]))
    held = events.join(named, events["event"] == named["token"]).groupBy(*keys, "alias").agg(F.count(F.lit(1)).alias("_c"))
    every = units.select(*keys).distinct().crossJoin(named).join(held, [*keys, "alias"], "left").fillna(0, ["_c"])
    people = every.groupBy(*by, "alias", "token", "person_id").agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_u"), F.count_if(F.col("_c") > 0).alias("_any"))
    out = people.groupBy(*by, "alias", "token").agg(F.sum("_c").alias("n_events"), F.sum("_u").alias("n_units"), F.sum("_any").alias("n_units_with_any"), (F.sum("_any") / F.sum("_u")).alias("share_with_any"), F.count(F.lit(1)).alias("n_source_persons"), F.count_if(F.col("_any") > 0).alias("n_persons_with_any"), F.avg(F.col("_any") / F.col("_u")).alias("mean_person_share"))
    out = suppress(out, ["n_events", "n_units_with_any", "n_persons_with_any", "n_source_persons"], min_cell=min_cell, also=["n_units", "share_with_any", "mean_person_share"], complement=False)
    return out.select(*by, "alias", "token", "n_events", "n_units", "n_units_with_any", "share_with_any", "n_source_persons", "n_persons_with_any", "mean_person_share", "suppressed")
