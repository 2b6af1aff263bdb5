"""Loading, configuration, runs and reports."""

import copy
import hashlib
import json
import os

import pandas as pd
import pytest
import yaml
from helpers import A

from tidewright import cli
from tidewright.operators.disclosure import policy_for
from tidewright.plans import config as settings
from tidewright.plans.report import build_report, redraw
from tidewright.sources import loaders, star
from tidewright.sources.schema import SchemaError, validate

CONFIG = {
    "model": {"name": "demo"},
    "data": {"observed": "observed.parquet", "generated": "generated.parquet", "persons": "persons.parquet", "event_definitions": "events.csv"},
    "events": {"birth": "F", "marriage": "O", "divorce": "P"},
    "persons": {"covariates": ["segment"], "cohort_width": 10},
    "replicates": {"min_replicates": 3},
    "outcomes": {"first_birth": {"event": "birth"}, "second_birth": {"event": "birth", "n": 2, "origin": "first_birth"}},
    "arms": {
        "descriptives": {"kaplan_meier": ["first_birth", "second_birth"], "fertility": {"ccf": True, "asfr": ["cohort"], "ppr": {"max_parity": 4}}, "stratify_by": ["cohort"]},
        "backtesting": {
            "windows": [[0, 25], [0, 30]], "conditions": [{"name": "p0", "event": "birth", "max_count": 0}],
            "probability_outcomes": [{"outcome": "first_birth", "by_age": 40, "given": "p0"}, {"outcome": "second_birth", "within_origin": 5}, {"event": "birth", "min_events": 1, "within": 5}],
            "aggregate_targets": ["ccf", "ppr", "km:first_birth"],
        },
        "forecasting": {
            "lexis": {"outcome": "first_birth", "ages": [15, 45], "years": [1960, 2035], "subgroup_by": ["segment"]},
            "illegal_moves": [{"event": "birth", "max_age": 45}, {"event": "birth", "min_spacing": 0.6, "severity": "warn"}, {"outcome": "second_birth", "not_before": "marriage"}],
            "replicate_variance": {"individual": True, "aggregate": ["ccf"], "subgroup_by": ["segment"]}, "sequence_descriptives": True,
        },
    },
    "output": {"dir": "out"},
}


@pytest.fixture(scope="module")
def home(spark, sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("demo")
    star.observed(spark, sf).where("age >= 0").write.parquet(f"{at}/observed.parquet")
    star.generated(spark, sf).write.parquet(f"{at}/generated.parquet")
    star.persons(spark, sf).selectExpr("person_id", "cast(birth_year as smallint) as birth_year", "segment").write.parquet(f"{at}/persons.parquet")
    (at / "events.csv").write_text("model_representation,event_definition\nF,a birth\nO,a marriage\n")
    (at / "demo.yaml").write_text(yaml.safe_dump(CONFIG))
    return at


@pytest.fixture(scope="module")
def done(spark, home):
    assert cli.run(f"{home}/demo.yaml", spark=spark) == 0, json.loads((home / "out/manifest.json").read_text())["arms"]
    return home / "out"


def tables(out):
    return {f"{arm}/{x[:-8]}": pd.read_parquet(out / arm / x) for arm in os.listdir(out) if (out / arm).is_dir() for x in os.listdir(out / arm) if x.endswith(".parquet")}


def test_a_run_publishes_its_tables(done):
    found = tables(done)
    want = "descriptives/km_first_birth descriptives/ccf descriptives/asfr_cohort descriptives/parity_distribution backtesting/calibration backtesting/scores backtesting/coverage backtesting/p_hat_distribution"
    want += " backtesting/timing_error backtesting/timing_error_by_seed backtesting/aggregate_error backtesting/ccf_variance backtesting/km_by_seed backtesting/km_pooled backtesting/km_observed backtesting/ppr_by_seed"
    want += " backtesting/ppr_pooled forecasting/lexis_cohort_forecast forecasting/lexis_cohort_pooled forecasting/lexis_cohort_combined forecasting/violation_rates forecasting/event_age_distribution"
    want += " forecasting/token_frequency forecasting/replicate_variance_aggregate_first_birth forecasting/within_seed_variance_distribution_first_birth forecasting/within_seed_quantile_summary_first_birth_by_segment"
    assert set(want.split()) <= set(found)
    assert all((df["model"] == "demo").all() for df in found.values())
    metrics = set(found["backtesting/scores"]["metric"])
    assert {"ece", "roc_auc", "auc_grid_resolution", "brier_raw", "brier_corrected", "mse", "r2", "timing_coverage"} <= metrics
    assert set(found["backtesting/coverage"]["age_stop"]) == {A(25), A(30)}


def test_nothing_small_or_personal_is_published(done):
    for name, df in tables(done).items():
        assert "person_id" not in df.columns, name
        policy = policy_for(name.split("/")[1])
        for c in policy.counts if policy else ():
            if c in df.columns:
                assert not df[c].between(1, 3).any(), (name, c)
    about = json.loads((done / "manifest.json").read_text())
    withheld = {a["arm"]: a["withheld"] for a in about["arms"]}
    assert withheld["backtesting"] == ["probabilities"] and "violations" in withheld["forecasting"]


def test_every_policy_names_columns_of_its_tables(done):
    """A policy whose columns aren't there would govern nothing."""
    known = set()
    for name, df in tables(done).items():
        name = name.split("/")[1]
        if policy := policy_for(name):
            known.add(name)
            assert set(policy.counts) & set(df.columns), name
            if name.startswith(("within_seed", "p_hat", "lexis_cohort_combined", "km_", "ppr", "coverage")):
                assert set(policy.counts) <= set(df.columns), (name, set(policy.counts) - set(df.columns))
    assert len(known) > 20


def test_nothing_is_on_disk_of_a_table_that_fails(spark, tmp_path, monkeypatch):
    from tidewright.operators.disclosure import DisclosureError
    from tidewright.sources.publish import Writer

    monkeypatch.setattr(Writer, "suppressed", lambda self, name, df: df)
    out = Writer("a", str(tmp_path), "m", 3)
    with pytest.raises(DisclosureError, match="n_events"):
        out.table("km_x", spark.createDataFrame([(1, 2, 9)], "time bigint, n_events bigint, n_persons bigint"))
    assert not os.path.exists(tmp_path / "a" / "km_x.parquet") and out.written == []


def test_only_wanted_windows_are_scanned(spark, home, tmp_path):
    raw = copy.deepcopy(CONFIG)
    raw["arms"]["forecasting"]["windows"] = [[0, 25]]
    raw["arms"]["backtesting"]["windows"] = [[0, 25]]
    raw["data"] = {k: f"{home}/{v}" for k, v in raw["data"].items()}
    (tmp_path / "w.yaml").write_text(yaml.safe_dump(raw))
    config = settings.load_config(str(tmp_path / "w.yaml"))
    assert loaders.wanted_windows(config) == [(0, A(25))] and loaders.wanted_windows(settings.load_config(f"{home}/demo.yaml")) is None
    bundle = loaders.load_all(spark, config)
    assert {(r["age_start"], r["age_stop"]) for r in bundle.windows().collect()} == {(0, A(25))}
    plan = loaders.load_generated(spark, config.data.generated, windows=[(0, A(25))])._jdf.queryExecution().toString()
    assert f"EqualTo(age_stop,{A(25)})" in plan.split("PushedFilters")[1]


def test_manifest_and_report(done, home):
    about = json.loads((done / "manifest.json").read_text())
    assert about["config_hash"] == settings.load_config(f"{home}/demo.yaml").hash()
    assert about["inputs"]["observed"]["rows"] > 0 and len(about["inputs"]["event_definitions"]["sha256"]) == 64
    for arm in about["arms"]:
        assert arm["status"] == "ok" and all(os.path.exists(done / x) for x in arm["outputs"])
    page = (done / "report.html").read_text()
    assert "<svg" in page and "n_uncovered" in page and "person_id" not in page
    for says in ("Calibration", "Timing", "What is known and what differs", "Rates by cohort and age", "P(1st birth by age 40 | p0) from the jump-off, from age 25", "roc_auc"):
        assert says in page, says


def test_figures_compare(done):
    """Observed curves in black over generated ones, ridges, fans, spikes and the frontier."""
    found = {x.removesuffix(".svg") for arm in ("descriptives", "backtesting", "forecasting") for x in os.listdir(done / arm) if x.endswith(".svg")}
    for start in ("km_overlay_first_birth_25", "km_overlay_first_birth_all", "ccf_overlay_all", "ccf_overlay_25", "ppr_overlay_all", "ccf_inference_vs_outcome", "reliability_", "timing_error_", "within_seed_quantile_fan"):
        assert any(x.startswith(start) for x in found), (start, sorted(found))
    km = (done / "backtesting" / "km_overlay_first_birth_25.svg").read_text()
    assert "observed" in km and 'stroke="#111"' in km and "generated" in km


def test_titles_of_questions():
    from tidewright.plans.figures import question_title
    from tidewright.plans.specs import Counted, Frame, Framed, Timing

    first, label = Timing("F"), {"F": "birth"}.get
    assert question_title(Framed("x", first, Frame("by_age", A(40)), "p0"), A(25), label) == "P(1st birth by age 40 | p0) from age 25"
    assert question_title(Framed("x", Timing("F", 2, first), Frame("within_origin", A(3))), None, label) == "P(2nd birth within 3y of its origin) from the jump-off"
    assert question_title(Counted("x", "F", 1, Frame("within", A(5))), A(30), label) == "P(≥1 birth within 5y after age 30)"


def test_figures_are_redrawn_the_same(done):
    digest = lambda: {x: hashlib.sha256((done / arm / x).read_bytes()).hexdigest() for arm in ("descriptives", "backtesting", "forecasting") for x in os.listdir(done / arm) if x.endswith(".svg")}
    before = digest()
    assert before and redraw(str(done)) and digest() == before
    assert build_report(str(done)).endswith("report.html")


def test_results_are_not_overwritten(spark, home, done, capsys):
    assert cli.run(f"{home}/demo.yaml", spark=spark) == 2
    assert cli.validate(f"{home}/demo.yaml", spark) == 0 and "window 0 to" in capsys.readouterr().out


def test_a_failing_arm_leaves_the_others(spark, home, monkeypatch):
    raw = copy.deepcopy(CONFIG)
    raw["output"]["dir"] = "out2"
    raw["arms"] = {"descriptives": raw["arms"]["descriptives"], "backtesting": raw["arms"]["backtesting"]}
    (home / "two.yaml").write_text(yaml.safe_dump(raw))

    def broken(*_):
        raise RuntimeError("no luck")

    monkeypatch.setitem(cli.plans.ARMS, "descriptives", broken)
    monkeypatch.setitem(cli.plans.ARMS, "backtesting", lambda study, out: None)
    assert cli.run(f"{home}/two.yaml", spark=spark, report=False) == 1
    states = json.loads((home / "out2/manifest.json").read_text())["arms"]
    assert [s["status"] for s in states] == ["failed", "ok"]


BROKEN = [
    (("model", "nme"), 1, "nme"), (("events",), {}, "birth"), (("outcomes", "second_birth", "origin"), "nothing", "origin"), (("outcomes", "first_birth", "origin"), "second_birth", "origin"),
    (("arms", "descriptives", "kaplan_meier"), ["x"], "kaplan_meier"), (("arms", "descriptives", "stratify_by"), ["sex"], "stratify_by"), (("arms", "backtesting", "aggregate_targets"), ["asfr_period"], "aggregate_targets"),
    (("arms", "backtesting", "probability_outcomes"), [{"outcome": "first_birth", "within_origin": 5}], "within_origin"), (("arms", "backtesting", "probability_outcomes"), [{"outcome": "first_birth"}], "by_age"),
    (("arms", "backtesting", "probability_outcomes"), [{"event": "birth", "within": 5}], "min_events"), (("arms", "backtesting", "conditions"), [{"name": "p", "event": "birth"}], "min_count"),
    (("arms", "backtesting", "calibration_bins"), 1, "calibration_bins"), (("arms", "forecasting", "illegal_moves"), [{"event": "birth", "outcome": "first_birth", "max_age": 3}], "event or an outcome"),
    (("arms", "forecasting", "illegal_moves"), [{"outcome": "first_birth", "max_count": 3}], "max_count"), (("arms", "forecasting", "lexis", "outcome"), "x", "lexis"), (("data", "generated"), None, "generated"),
    (("arms", "forecasting", "replicate_variance"), [{"name": "a"}, {"name": "a"}], "replicate_variance"), (("output", "min_cell"), -1, "min_cell"),
]


@pytest.mark.parametrize("place,value,says", BROKEN)
def test_broken_configurations_are_told(tmp_path, place, value, says):
    raw = copy.deepcopy(CONFIG)
    at = raw
    for key in place[:-1]:
        at = at[key]
    at[place[-1]] = value
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(raw))
    with pytest.raises(settings.ConfigError, match=says):
        settings.load_config(str(tmp_path / "c.yaml"))
    assert cli.main(["validate", str(tmp_path / "c.yaml")]) == 2


def test_resolving(home):
    config = settings.load_config(f"{home}/demo.yaml")
    names = [q.name for q in settings.questions(config)]
    assert names == ["first_birth_by_age_40y_given_p0", "second_birth_within_origin_5y", "birth_ge1_within_5y"]
    rules = settings.rules(config)
    assert [r.name for r in rules] == ["birth_rule_0", "birth_rule_1", "second_birth_rule_2"] and rules[2].occurrence == 2 and rules[1].min_spacing == A(0.6)
    told = []
    assert settings.chosen_windows([(0, 25), (0, 99)], [(0, A(25)), (0, A(30))], told.append) == [(0, A(25))] and len(told) == 1


def test_loading(spark, tmp_path, caplog):
    years = spark.createDataFrame([(1, 22.0, "x"), (2, 30.5, "x")], "person_id bigint, age double, event string")
    years.write.parquet(f"{tmp_path}/y.parquet")
    assert sorted(r["age"] for r in loaders.load_observed(spark, f"{tmp_path}/y.parquet", "years").collect()) == [8036, 11140]
    with pytest.raises(SchemaError, match="whole"):
        loaders.load_observed(spark, f"{tmp_path}/y.parquet")
    gen = spark.createDataFrame([(1, 0, 0.0, 25.0, 26.0, "x"), (1, 1, 0.0, 30.0, 31.0, "x")], "person_id bigint, seed int, age_start double, age_stop double, age double, event string")
    gen.write.parquet(f"{tmp_path}/g.parquet")
    assert loaders.load_generated(spark, f"{tmp_path}/g.parquet", "years", windows=[(0, A(25))]).count() == 1
    assert loaders.load_generated(spark, f"{tmp_path}/g.parquet", "years", seeds=[1]).count() == 1
    people = spark.createDataFrame([(1, 1970), (1, 1971), (2, 1700)], "person_id bigint, birth_year int")
    with pytest.raises(SchemaError) as told:
        validate(people, "persons")
    assert "1850" in str(told.value) and "repeats" in str(told.value)
    people.write.parquet(f"{tmp_path}/p.parquet")
    with pytest.raises(SchemaError, match="education"):
        loaders.load_persons(spark, f"{tmp_path}/p.parquet", ["education"])
    bad = spark.createDataFrame([(1, 0, 5, 3, 2, None)], "person_id bigint, seed int, age_start int, age_stop int, age int, event string")
    with pytest.raises(SchemaError, match="event is null.*after age_stop.*not after"):
        validate(bad, "generated")
    kept = loaders.drop_unknown(years, people.where("person_id = 1"), "observed")
    assert kept.count() == 1
    tokens = spark.createDataFrame([(1, 0, "YEAR_1980"), (1, 9, "YEAR_1990"), (2, 3, "x")], "person_id bigint, age int, event string")
    assert [tuple(r) for r in loaders.persons_from_sequences(tokens, allow_missing=True).collect()] == [(1, 1980)]
    with pytest.raises(SchemaError):
        loaders.persons_from_sequences(tokens)
    assert [tuple(r) for r in loaders.persons_from_sequences(tokens, tokens={"x": 1955}, allow_missing=True).collect()] == [(2, 1955)]
