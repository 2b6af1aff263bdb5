"""The perfect model: what it foretells comes true as often as it says."""

import pytest
from helpers import A
from pyspark.sql import functions as F

from tidewright import cli
from tidewright.operators import outcomes, replicates, scoring
from tidewright.plans import config as settings
from tidewright.plans import inspect
from tidewright.plans.specs import GENERATED, RUN, Counted, Frame
from tidewright.sources import demo, loaders


@pytest.fixture(scope="module")
def tables(spark):
    return [df.cache() for df in demo.make(spark, people=1500, seeds=20, jumpoffs=(28,))]


def test_a_perfect_model_is_calibrated(spark, tables):
    observed, generated, _ = tables
    q = Counted("c", "birth", 1, Frame("within", A(7)))
    seen = observed.crossJoin(generated.select("age_start", "age_stop").distinct())
    p = replicates.probability(replicates.summary(outcomes.evaluate_count(generated, GENERATED, q, F.col("age_stop"))))
    scored = scoring.join_truth(p, outcomes.evaluate_count(seen, RUN, q, F.col("age_stop")), RUN).cache()
    table = scoring.calibration(scored, 5).collect()
    assert sum(r["n"] for r in table) > 1300
    for r in table:
        assert abs(r["p_mean"] - r["y_rate"]) < 4 * (r["p_mean"] * (1 - r["p_mean"]) / r["n"]) ** 0.5 + 0.02
    assert scoring.roc_auc(scored).first()[0] > 0.55


def test_counts_and_frames_agree_on_one_question(spark, tables):
    """A first birth within some years, of the childless, is one birth or more in them."""
    from tidewright.plans.specs import Framed, Timing

    observed, generated, _ = tables
    life = outcomes.life_course(observed, generated)
    childless = life.groupBy(*GENERATED).agg(F.count_if((F.col("event") == "birth") & (F.col("age") <= F.col("age_stop"))).alias("n")).where("n = 0").select(*GENERATED)
    framed = outcomes.evaluate_framed(life, GENERATED, Framed("f", Timing("birth"), Frame("within", A(5))), F.col("age_stop")).join(childless, GENERATED, "left_semi")
    counted = outcomes.evaluate_count(generated, GENERATED, Counted("c", "birth", 1, Frame("within", A(5))), F.col("age_stop"))
    assert framed.join(counted, [*GENERATED, "occurred", "evaluable"], "left_anti").count() == 0


def test_demo_runs(spark, tmp_path):
    path = demo.write(spark, str(tmp_path), people=150, seeds=4, jumpoffs=(25, 30))
    bundle = loaders.load_all(spark, settings.load_config(path))
    assert inspect.overview(bundle)["observed"]["people"] == 150 and inspect.sample_sequences(bundle.observed, 3).select("person_id").distinct().count() == 3
    assert inspect.distributions(bundle.observed, "birth", ["person_id"])[0].agg(F.sum("n")).first()[0] == 150
    assert cli.run(path, spark=spark) == 0
    assert "backtesting/scores" in inspect.result_tables(str(tmp_path / "results"))
