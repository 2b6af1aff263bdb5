"""A synthetic experiment with a perfect model: futures are drawn from the hazards that made the past,
so probabilities are calibrated by construction. People are made in parallel, each from their own seed."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession

from tidewright.units import years_to_days

FERTILE = (15, 50)
MOST = 6

# Births a year by age band of five years from 15 on, and by how many there are already.
BANDS = (0.02, 0.09, 0.13, 0.11, 0.05, 0.012, 0.001)
PARITY = (1.0, 1.35, 0.6, 0.4, 0.3, 0.25)


def hazard(age_years: float, parity: int) -> float:
    """Births a year."""
    band = int((age_years - FERTILE[0]) // 5)
    return BANDS[band] * PARITY[parity] if 0 <= band < len(BANDS) and parity < MOST else 0.0


def live(rng: np.random.Generator, start: float, stop: float, parity: int) -> list[float]:
    """Ages at births between two ages, with nine months between births at least. Within a band the
    hazard is constant, so waits are exponential."""
    out: list[float] = []
    age = max(start, FERTILE[0])
    while age < min(stop, FERTILE[1]) and parity + len(out) < MOST:
        rate, edge = hazard(age, parity + len(out)), FERTILE[0] + 5 * (int((age - FERTILE[0]) // 5) + 1)
        wait = rng.exponential(1 / rate) if rate else np.inf
        if age + wait >= min(edge, stop):
            age = min(edge, stop)
            continue
        age += wait
        out.append(age)
        age += 0.75
    return out


def make(spark: SparkSession, people: int = 1000, seeds: int = 10, jumpoffs: tuple[int, ...] = (25, 30, 35), seed: int = 42, tasks: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(observed, generated, persons)."""

    def own(ids: int) -> tuple[np.random.Generator, int, float]:
        rng = np.random.default_rng([seed, ids])
        return rng, int(rng.integers(1960, 1991)), float(rng.uniform(35, 50))

    def past(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k in b["id"]:
                rng, _, end = own(k)
                rows += [(k, years_to_days(a), "birth") for a in live(rng, 0, end, 0)] + [(k, years_to_days(end), "no_event")]
            yield pd.DataFrame(rows, columns=["person_id", "age", "event"])

    def future(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k in b["id"]:
                rng, _, end = own(k)
                had = live(rng, 0, end, 0)
                for j in jumpoffs:
                    if end <= j:
                        continue
                    before = [a for a in had if years_to_days(a) <= years_to_days(j)]
                    begin = max(float(j), before[-1] + 0.75 if before else 0.0)
                    for s in range(seeds):
                        draw = np.random.default_rng([seed, int(k), j, s])
                        ages = [years_to_days(a) for a in live(draw, begin, FERTILE[1], len(before))]
                        rows += [(k, s, 0, years_to_days(j), a, "birth") for a in ages if a > years_to_days(j)] + [(k, s, 0, years_to_days(j), years_to_days(FERTILE[1]), "no_event")]
            yield pd.DataFrame(rows, columns=["person_id", "seed", "age_start", "age_stop", "age", "event"])

    def who(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k in b["id"]:
                _, year, _ = own(k)
                rows.append((k, year, "F", ("low", "high")[k % 2], ("A", "B")[k // 2 % 2]))
            yield pd.DataFrame(rows, columns=["person_id", "birth_year", "sex", "education", "region"])

    ids = spark.range(0, people, numPartitions=tasks)
    return (
        ids.mapInPandas(past, "person_id bigint, age int, event string"),
        ids.mapInPandas(future, "person_id bigint, seed int, age_start int, age_stop int, age int, event string"),
        ids.mapInPandas(who, "person_id bigint, birth_year smallint, sex string, education string, region string"),
    )


def write(spark: SparkSession, directory: str, **how) -> str:
    """Writes the tables and a configuration; returns its path."""
    os.makedirs(directory, exist_ok=True)
    for name, df in zip(("observed", "generated", "persons"), make(spark, **how), strict=True):
        df.write.mode("overwrite").parquet(os.path.join(directory, f"{name}.parquet"))
    with open(os.path.join(directory, "events.csv"), "w") as f:
        f.write("model_representation,event_definition\nbirth,birth of a child\nno_event,end of observation\n")
    config = {
        "model": {"name": "demo"}, "data": {"observed": "observed.parquet", "generated": "generated.parquet", "persons": "persons.parquet", "event_definitions": "events.csv"},
        "events": {"birth": "birth"}, "persons": {"covariates": ["education", "region"]},
        "outcomes": {"first_birth": {"event": "birth"}, "second_birth": {"event": "birth", "n": 2, "origin": "first_birth"}},
        "arms": {
            "descriptives": {"kaplan_meier": ["first_birth", "second_birth"], "fertility": {"ccf": True, "asfr": ["cohort"]}, "stratify_by": ["cohort"]},
            "backtesting": {"conditions": [{"name": "p0", "event": "birth", "max_count": 0}], "probability_outcomes": [{"outcome": "first_birth", "by_age": 40, "given": "p0"}, {"event": "birth", "min_events": 1, "within": 5}], "aggregate_targets": ["ccf", "ppr", "km:first_birth"]},
            "forecasting": {"lexis": {"outcome": "first_birth", "ages": [15, 50], "years": [1975, 2040]}, "illegal_moves": [{"event": "birth", "max_age": 50}, {"event": "birth", "min_spacing": 0.6, "severity": "warn"}], "replicate_variance": {"individual": True, "aggregate": ["ccf"]}, "sequence_descriptives": True},
        },
        "output": {"dir": "results"},
    }
    path = os.path.join(directory, "demo.yaml")
    with open(path, "w") as f:
        yaml.safe_dump(config, f, sort_keys=False)
    return path
