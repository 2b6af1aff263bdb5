"""Every registered query with SQL against DuckDB over the same tables, and the driver's contract."""

import importlib
import math
import pathlib

import duckdb
import pytest

import __spark_entry__
from tidewright.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def agree(got, want) -> bool:
    """Equal rows in any order; doubles may differ by one in the sixth place, where both sides round."""
    order = lambda r: ([repr(v) for v in r if not isinstance(v, float)], [v for v in r if isinstance(v, float)])
    clean = lambda rows: sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=order)
    same = lambda x, y: abs(x - y) < 1.5e-6 if isinstance(x, float) and isinstance(y, float) else x == y
    got, want = clean(got), clean(want)
    return len(got) == len(want) and all(same(x, y) for r, s in zip(got, want, strict=True) for x, y in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    assert agree((tuple(r[c] for c in columns) for r in got.collect()), want.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_have_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns[:3] == ["age_start", "age_stop", "bin"] and out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_training_data_operators(monkeypatch):
    """Nothing outside imports that subpackage; the entry leaves its queries out if it is gone."""
    real = importlib.import_module

    def gone(name, *args):
        if name in ("tidewright.llm.queries", "corpus_pipeline"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *args)

    monkeypatch.setattr(importlib, "import_module", gone)
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(SQL)


def test_nothing_outside_imports_them():
    root = pathlib.Path(__spark_entry__.__file__).parent
    for path in [*root.glob("tidewright/**/*.py"), root / "bench.py"]:
        if "llm" not in path.relative_to(root).parts:
            assert "tidewright.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path


def test_broken_modules_are_not_hidden(monkeypatch):
    def broken(name, *args):
        raise ModuleNotFoundError("No module named 'xyz'", name="xyz")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__._optional("tidewright.llm.queries")


def test_null_band_runs_all_simulations(spark, sf):
    from tidewright.plans.catalog import QUERIES

    assert {r["n_sims"] for r in QUERIES["null_band"](spark, sf).collect()} == {200}
