"""Checks of input tables: one pass for all rules of a table, one error for all violations."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.units import years_to_days

MAX_AGE = years_to_days(110)


class SchemaError(ValueError):
    """An input table breaks its rules."""


@dataclasses.dataclass(frozen=True)
class Table:
    """columns: name to type; rules: what no row may break; unique: columns that name a row once."""

    columns: dict[str, str]
    rules: dict[str, Column]
    unique: tuple[str, ...] = ()
    optional: dict[str, str] = dataclasses.field(default_factory=dict)
    strict: bool = False


def _known(*names: str) -> dict[str, Column]:
    return {f"{n} is null": F.col(n).isNull() for n in names}


def tables() -> dict[str, Table]:
    """The rules of each artifact. (Columns need a running session, so this is a function.)"""
    outside = {"age is outside 0 to 110 years": ~F.col("age").between(0, MAX_AGE)}
    return {
        "observed": Table({"person_id": "", "age": "int", "event": "string"}, _known("person_id", "age", "event") | outside),
        "generated": Table(
            {"person_id": "", "seed": "int", "age_start": "int", "age_stop": "int", "age": "int", "event": "string"},
            _known("person_id", "seed", "age_start", "age_stop", "age", "event") | outside
            | {"age_start is negative": F.col("age_start") < 0, "age_start is after age_stop": F.col("age_start") > F.col("age_stop"), "age is not after age_stop": F.col("age") <= F.col("age_stop")},
        ),
        "persons": Table({"person_id": "", "birth_year": "smallint"}, _known("person_id", "birth_year") | {"birth_year is outside 1850 to 2100": ~F.col("birth_year").between(1850, 2100)}, ("person_id",), {"sex": "string"}),
        "event_definitions": Table({"model_representation": "string", "event_definition": "string"}, _known("model_representation"), ("model_representation",), strict=True),
    }


def validate(df: DataFrame, artifact: str, hint: str = "") -> DataFrame:
    """df with its columns cast. All broken rules are told in one SchemaError, with how many rows
    break each."""
    table = tables()[artifact]
    problems = [f"column {c} is missing" for c in table.columns if c not in df.columns]
    if table.strict and (extra := sorted(set(df.columns) - set(table.columns))):
        problems.append(f"columns {extra} are not allowed")
    if not problems:
        types = table.columns | {c: t for c, t in table.optional.items() if c in df.columns}
        bad_cast = {f"{c} is no {t}": F.col(c).isNotNull() & F.col(c).try_cast(t).isNull() for c, t in types.items() if t}
        cast = df.withColumns({f"_{c}": F.col(c).try_cast(t) for c, t in types.items() if t})
        checks = list((bad_cast | table.rules).items())
        seen = cast.agg(*(F.count_if(rule).alias(f"c{k}") for k, (_, rule) in enumerate(checks))).first() if checks else ()
        problems += [f"{name}: {n} rows" for (name, _), n in zip(checks, seen, strict=True) if n]
        if table.unique:
            repeats = df.groupBy(*table.unique).count().where("count > 1").agg(F.count(F.lit(1))).first()[0]
            if repeats:
                problems.append(f"{', '.join(table.unique)} repeats: {repeats} values")
        if not problems:
            return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if t})
    raise SchemaError(f"{artifact}: " + "; ".join(problems) + (f" ({hint})" if hint else ""))


def require(columns: Sequence[str], wanted: Sequence[str], artifact: str) -> None:
    if missing := [c for c in wanted if c not in columns]:
        raise SchemaError(f"{artifact} lacks {missing}; it has {sorted(columns)}")
