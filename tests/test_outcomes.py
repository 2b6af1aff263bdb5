import pytest
from helpers import GENERATED, PERSON, A, B, D, M, N, as_generated, observed, persons, rows
from pyspark.sql import functions as F

from tidewright.operators import outcomes, slicing
from tidewright.plans.specs import RUN, Condition, Counted, Frame, Framed, Timing
from tidewright.units import completed_years, days_to_years, years_to_days, years_to_days_col

FIRST, SECOND = Timing(B), Timing(B, 2, Timing(B))


def test_units_round_half_even(spark):
    assert [years_to_days(y) for y in (2, 22, 26)] == [730, 8036, 9496]
    assert rows(spark.createDataFrame([(2.0,), (22.0,), (26.0,)], "y double").select(years_to_days_col(F.col("y")).alias("d"))) == [(730,), (8036,), (9496,)]
    assert completed_years(365) == 0 and completed_years(366) == 1 and days_to_years(1461) == 4


def test_births_and_spans(spark):
    df = observed(spark)
    assert rows(outcomes.births(df, PERSON, B).where("person_id = 3")) == [(3, 1, A(22)), (3, 2, A(26)), (3, 3, A(31))]
    assert rows(outcomes.spans(df, PERSON))[0] == (0, 0, A(28)) and outcomes.spans(df, PERSON).count() == 6
    assert rows(outcomes.nth_occurrence(df, PERSON, B, 2)) == [(2, A(29)), (3, A(26)), (5, A(33))]
    with pytest.raises(ValueError, match="seed"):
        outcomes.births(df, GENERATED, B)


def test_ties_have_different_ordinals(spark):
    df = observed(spark, [(1, B, 25), (1, B, 25)])
    assert rows(outcomes.births(df, PERSON, B), "order") == [(1,), (2,)]
    assert rows(outcomes.nth_occurrence(df, PERSON, B, 2)) == [(1, A(25))]


def test_person_days_are_conserved(spark):
    spans = outcomes.spans(observed(spark), PERSON)
    bins = slicing.AgeBins.years(0, 40)
    assert outcomes.exposure(spans, bins).agg(F.sum("person_days")).first()[0] == sum(A(y) for y in (28, 25, 29, 31, 30, 33))
    by_year = outcomes.exposure_by_year(spans, bins, persons(spark))
    assert by_year.agg(F.sum("person_days")).first()[0] == sum(A(y) for y in (28, 25, 29, 31, 30, 33))
    inside = outcomes.exposure(spans, slicing.AgeBins((A(25), A(30)), (25.0,)))
    assert inside.agg(F.sum("person_days")).first()[0] == 8038 and inside.count() == 6


def test_time_to_event(spark):
    df = observed(spark)
    assert rows(outcomes.time_to_event(df, PERSON, FIRST))[:2] == [(0, A(28), False), (1, A(25), True)]
    assert rows(outcomes.time_to_event(df, PERSON, SECOND)) == [(1, 0, False), (2, A(29) - A(24), True), (3, A(26) - A(22), True), (4, 0, False), (5, A(33) - A(27), True)]
    with pytest.raises(ValueError):
        Timing(B, 1, SECOND)


def test_zero_windows_are_the_observed(spark):
    df = observed(spark)
    gen = as_generated(df)
    assert rows(outcomes.time_to_event(gen, GENERATED, FIRST).select("person_id", "duration", "observed")) == rows(outcomes.time_to_event(df, PERSON, FIRST))
    assert rows(outcomes.births(gen, GENERATED, B).select("person_id", "order", "age")) == rows(outcomes.births(df, PERSON, B))


CASES = [(1, B, 27), (1, B, 33), (1, N, 40), (2, B, 22), (2, B, 25), (2, N, 40), (3, N, 40), (4, N, 27)]


def test_framed_outcomes(spark):
    df = observed(spark, CASES)
    by35 = Framed("second", SECOND, Frame("by_age", A(35)))
    assert rows(outcomes.evaluate_framed(df.where("person_id < 3"), PERSON, by35, A(30))) == [(1, True, True), (2, True, False)]
    first28 = Framed("first", FIRST, Frame("by_age", A(28)))
    assert rows(outcomes.evaluate_framed(df.where("person_id = 3"), PERSON, first28, A(30))) == [(3, False, False)]  # settled
    first35 = Framed("first", FIRST, Frame("by_age", A(35)))
    assert rows(outcomes.evaluate_framed(df.where("person_id = 4"), PERSON, first35, A(20))) == [(4, False, False)]  # censored
    within = Framed("second", SECOND, Frame("within_origin", A(5)))
    mixed = observed(spark, [(1, B, 25), (1, B, 28), (1, N, 40), (2, N, 40)])
    assert rows(outcomes.evaluate_framed(mixed, PERSON, within, A(20))) == [(1, True, True)]
    with pytest.raises(ValueError):
        outcomes.evaluate_framed(df, PERSON, Framed("x", FIRST, Frame("within", A(5))))
    with pytest.raises(ValueError):
        Framed("x", FIRST, Frame("within_origin", A(5)))


def test_counts(spark):
    df = observed(spark, CASES)
    five = Counted("c", B, 1, Frame("within", A(5)))
    assert rows(outcomes.evaluate_count(df, PERSON, five, A(30))) == [(1, True, True), (2, False, True), (3, False, True), (4, False, False)]
    with pytest.raises(ValueError):
        Counted("c", B, 1, Frame("within_origin", 5))


def test_windows_as_columns_equal_windows_one_by_one(spark):
    df = observed(spark)
    jumps = [(0, A(24)), (0, A(27))]
    fused = df.crossJoin(spark.createDataFrame(jumps, "age_start int, age_stop int"))
    q = Framed("first", FIRST, Frame("within", A(3)))
    got = rows(outcomes.evaluate_framed(fused, RUN, q, F.col("age_stop")), "age_stop", "person_id", "occurred", "evaluable")
    want = [(b, *r) for _, b in jumps for r in rows(outcomes.evaluate_framed(df, PERSON, q, b))]
    assert got == sorted(want)


def test_life_course_crosses_people_and_seeds(spark):
    df = observed(spark)
    gen = spark.createDataFrame([(1, 0, 0, A(26), A(30), B), (2, 1, 0, A(26), A(31), B)], "person_id bigint, seed int, age_start int, age_stop int, age int, event string")
    life = outcomes.life_course(df, gen)
    got = {(p, s) for p, s in rows(life, "person_id", "seed")}
    assert got == {(1, 0), (1, 1), (2, 0), (2, 1)}  # also pairs that were never generated
    assert rows(life.where("person_id = 1 and seed = 0"), "age") == [(A(25),), (A(30),)]


def test_conditions_and_settled(spark):
    df = observed(spark)
    p0 = Condition("p0", B, 0, 0)
    assert {r[0] for r in rows(slicing.condition_on_count(df, PERSON, p0, A(26)), "person_id")} == {0, 4, 5}
    assert rows(outcomes.condition_persons(df, p0, A(26))) == [(0,), (4,), (5,)]
    early = Condition("early", B, 1, None, A(23))
    assert {r[0] for r in rows(slicing.condition_on_count(df, PERSON, early), "person_id")} == {3}
    with pytest.raises(ValueError):
        slicing.condition_on_count(df, PERSON, p0)
    q = Framed("first", FIRST, Frame("by_age", A(40)))
    assert rows(outcomes.settled_persons(df, q, A(26))) == [(1,), (2,), (3,)]


def test_slicing(spark):
    df = observed(spark)
    assert slicing.truncate(df, A(25)).count() == 3
    assert rows(slicing.restrict_window(df, A(25), A(27)), "person_id") == [(1,), (3,)]
    assert rows(slicing.cohorts(persons(spark), 5)) == [(0, 1970), (1, 1970), (2, 1975), (3, 1975), (4, 1980), (5, 1980)]
    odd = spark.createDataFrame([(1, 1953), (2, 1957), (3, 1958)], "person_id bigint, birth_year smallint")
    assert rows(slicing.cohorts(odd, 5)) == [(1, 1953), (2, 1953), (3, 1958)]  # from the smallest year on
    bins = slicing.AgeBins.years(20, 30)
    got = rows(df.select("age", bins.of(F.col("age")).alias("b")))
    assert (A(22), 22.0) in got and (A(30), None) in got and bins.edges[2] == A(22)
    assert rows(slicing.calendar_year(slicing.attach_persons(df, persons(spark))).where("person_id = 1"), "year") == [(1970 + completed_years(A(25)),)]
    assert rows(slicing.align_jumpoff(df, B, 2), "person_id") == [(2,), (3,), (5,)]
    with pytest.raises(ValueError, match="5"):
        slicing.attach_persons(df, persons(spark).where("person_id < 5"))
    kept, events = slicing.restrict_cohorts(persons(spark), df, 1970)
    assert kept.count() == 2 and rows(events.select("person_id").distinct()) == [(0,), (1,)]
    assert D and M
