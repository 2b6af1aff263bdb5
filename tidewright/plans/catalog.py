"""Every operator as a query over the star schema, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import dispersion, fertility, outcomes, plausibility, pooling, replicates, scoring, sequences, slicing, survival
from tidewright.operators.disclosure import apply_policy, assert_publishable, suppress
from tidewright.plans.specs import GENERATED, PERSON, RUN, WINDOW, Condition, Counted, Frame, Framed, Replicates, Rule, Timing
from tidewright.sources import loaders, star
from tidewright.units import years_to_days

BINS = slicing.AgeBins.years(15, 50, 1.0)
WIDTH = 5
B, M, D = star.BIRTH, star.MARRIAGE, star.DIVORCE
FIRST = Timing(B)
SECOND = Timing(B, 2, Timing(B))
BY40 = Framed("first_by_40", FIRST, Frame("by_age", years_to_days(40)))
IN5 = Framed("first_within_5", FIRST, Frame("within", years_to_days(5)))
AFTER3 = Framed("second_within_3_of_first", SECOND, Frame("within_origin", years_to_days(3)))
COUNT5 = Counted("birth_within_5", B, 1, Frame("within", years_to_days(5)))
COUNT40 = Counted("two_by_40", B, 2, Frame("by_age", years_to_days(40)))
CHILDLESS = Condition("childless", B, 0, 0)
RULES = {
    "rules_min_max_age": [Rule("young", B, min_age=years_to_days(12)), Rule("old", B, max_age=years_to_days(40), severity="warn")],
    "rules_spacing": [Rule("spacing", B, min_spacing=years_to_days(1))],
    "rules_not_after": [Rule("not_after", B, not_after=D)],
    "rules_not_before": [Rule("not_before", D, not_before=M)],
    "rules_max_count": [Rule("max_count", B, max_count=4)],
    "rules_occurrence": [Rule("second_before_marriage", B, occurrence=2, not_before=M, not_before_occurrence=2)],
}
TOKENS = {"birth": B, "marriage": M, "divorce": D}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_CTES = f"""
persons as (select c_custkey as person_id, (1950 + c_custkey % 41)::int as birth_year, c_mktsegment as segment from customer),
observed as (select o_custkey as person_id, (7 * date_diff('day', date '1995-01-01', o_orderdate::date))::int as age, o_orderstatus as event from orders),
windows as (select 0 as age_start, unnest([9131, 10958, 12784])::int as age_stop),
generated as (
    select o_custkey as person_id, l_linenumber::int as seed, age_start, age_stop, (7 * date_diff('day', date '1995-01-01', l_shipdate::date))::int as age,
        case l_returnflag when 'R' then 'F' when 'A' then 'O' else 'P' end as event
    from lineitem join orders on l_orderkey = o_orderkey join windows on 7 * date_diff('day', date '1995-01-01', l_shipdate::date) > age_stop),
bins as (select (15 + i)::double as age_bin, round_even(((15 + i) * 365.25)::double, 0)::int as lo, round_even(((16 + i) * 365.25)::double, 0)::int as hi from range(35) t(i)),
cohorts as (select person_id, ((select min(birth_year) from persons) + floor((birth_year - (select min(birth_year) from persons)) / {WIDTH}.0) * {WIDTH})::int as cohort from persons),
births as (select person_id, row_number() over (partition by person_id order by age) as "order", age from observed where event = 'F'),
spans as (select person_id, 0 as start_age, max(age) as end_age from observed group by person_id),
people as (select distinct person_id, age_start, age_stop from generated),
seeds as (select distinct seed, age_start, age_stop from generated),
life as (
    select o.person_id, s.seed, p.age_start, p.age_stop, o.age, o.event
    from observed o join people p on o.person_id = p.person_id and o.age <= p.age_stop join seeds s on s.age_start = p.age_start and s.age_stop = p.age_stop
    union all select person_id, seed, age_start, age_stop, age, event from generated),
life_spans as (select person_id, seed, age_start, age_stop, age_stop as start_age, max(age) as end_age from life group by all),
life_births as (select person_id, seed, age_start, age_stop, row_number() over (partition by person_id, seed, age_start, age_stop order by age) as "order", age from life where event = 'F'),
evaluated as (
    select person_id, seed, age_start, age_stop, count(*) filter (event = 'F' and age > age_stop and age <= age_stop + 1826) >= 1 as occurred,
        count(*) filter (event = 'F' and age > age_stop and age <= age_stop + 1826) >= 1 or max(age) >= age_stop + 1826 as evaluable
    from generated group by person_id, seed, age_start, age_stop),
truth as (
    select person_id, age_start, age_stop, count(*) filter (event = 'F' and age > age_stop and age <= age_stop + 1826) >= 1 as occurred,
        count(*) filter (event = 'F' and age > age_stop and age <= age_stop + 1826) >= 1 or max(age) >= age_stop + 1826 as evaluable
    from observed, windows group by person_id, age_start, age_stop),
counted as (select person_id, age_start, age_stop, count(*) filter (occurred) as k, count(*) as n from evaluated where evaluable group by person_id, age_start, age_stop),
scored as (select c.*, k / n as p_hat, t.occurred::int as y_true from counted c join truth t using (person_id, age_start, age_stop) where t.evaluable),
run_counts as (select person_id, seed, age_start, age_stop, count(*) filter (event = 'F') as count from generated group by person_id, seed, age_start, age_stop),
moments as (select person_id, age_start, age_stop, avg(count) as mean, var_pop(count) as var, count(*) as k from run_counts group by person_id, age_start, age_stop),
first_birth as (
    select person_id, coalesce(min(age) filter (event = 'F'), max(age)) as duration, count(*) filter (event = 'F') > 0 as observed from observed group by person_id),
life_first as (
    select person_id, seed, age_start, age_stop, coalesce(min(age) filter (event = 'F'), max(age)) as duration, count(*) filter (event = 'F') > 0 as observed
    from life group by person_id, seed, age_start, age_stop)
"""


def _sql(body: str, doubles: tuple[str, ...] = ()) -> str:
    extra, _, main = body.rpartition(";;")
    rounded = f"replace ({', '.join(f'round({d}, 6) as {d}' for d in doubles)})" if doubles else ""
    return f"with {_CTES.strip()}{', ' + extra if extra else ''} select * {rounded} from ({main})"


def _tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places."""
    return df.select(*(F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def _query(name: str, sql: str | None = None, doubles: tuple[str, ...] = ()):
    def wrap(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _tidy(build(Tables(spark, sf_dir)))
        QUERIES[name].__doc__ = build.__doc__
        if sql:
            SQL[name] = _sql(sql, doubles)
        return build

    return wrap


class Tables:
    """The tables of one directory, and what many questions share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.persons, self.observed = star.persons(spark, sf_dir), star.observed(spark, sf_dir)
        self.generated, self.windows = star.generated(spark, sf_dir), star.windows(spark)
        self._raw = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    @property
    def cohorts(self) -> DataFrame:
        return slicing.cohorts(self.persons, WIDTH)

    @property
    def births(self) -> DataFrame:
        return outcomes.births(self.observed, PERSON, B)

    @property
    def spans(self) -> DataFrame:
        return outcomes.spans(self.observed, PERSON)

    @property
    def life(self) -> DataFrame:
        return outcomes.life_course(self.observed, self.generated)

    @property
    def in_windows(self) -> DataFrame:
        return self.observed.crossJoin(F.broadcast(self.windows))  # a handful of windows

    @property
    def evaluated(self) -> DataFrame:
        return outcomes.evaluate_count(self.generated, GENERATED, COUNT5, F.col("age_stop"))

    @property
    def truth(self) -> DataFrame:
        return outcomes.evaluate_count(self.in_windows, RUN, COUNT5, F.col("age_stop"))

    @property
    def probabilities(self) -> DataFrame:
        return replicates.probability(replicates.summary(self.evaluated), Replicates("wilson"))

    @property
    def scored(self) -> DataFrame:
        return scoring.join_truth(self.probabilities, self.truth, RUN)

    @property
    def run_counts(self) -> DataFrame:
        return outcomes.counts_per_run(self.generated, B)

    def timed(self, df: DataFrame, keys: list[str], timing: Timing = FIRST) -> DataFrame:
        return outcomes.time_to_event(df, keys, timing)


# -- slicing --------------------------------------------------------------------------------------


@_query("truncate", "select person_id, age, event from observed where age <= 10958")
def _(t):
    return slicing.truncate(t.observed, years_to_days(30))


@_query("restrict_window", "select person_id, age, event from observed where age >= 7305 and age < 10958")
def _(t):
    return slicing.restrict_window(t.observed, years_to_days(20), years_to_days(30))


@_query("attach_persons", "select o.person_id, age, event, birth_year, segment from observed o left join persons using (person_id)")
def _(t):
    return slicing.attach_persons(t.observed, t.persons, ["birth_year", "segment"])


@_query("cohort_bins", "select person_id, cohort from cohorts")
def _(t):
    return t.cohorts


@_query("age_bins", "select person_id, age, event, age_bin from observed left join bins on age >= lo and age < hi", ("age_bin",))
def _(t):
    return t.observed.withColumn("age_bin", BINS.of(F.col("age")))


@_query("calendar_year", "select person_id, age, event, birth_year, (birth_year + floor(age / 365.25))::int as year from observed join persons using (person_id)")
def _(t):
    return slicing.calendar_year(slicing.attach_persons(t.observed, t.persons))


@_query("condition_p0", "select o.person_id, age_start, age_stop, age, event from observed o, windows where o.person_id not in (select x.person_id from observed x where x.event = 'F' and x.age <= age_stop)")
def _(t):
    return slicing.condition_on_count(t.in_windows, RUN, CHILDLESS, F.col("age_stop")).select("person_id", "age_start", "age_stop", "age", "event")


@_query("align_jumpoff", 'select person_id, age as jumpoff from births where "order" = 2')
def _(t):
    return slicing.align_jumpoff(t.observed, B, 2)


@_query("max_cohort", "select o.person_id, age, event from observed o join persons using (person_id) where birth_year <= 1970")
def _(t):
    return slicing.restrict_cohorts(t.persons, t.observed, 1970)[1]


@_query("common_windows", "select person_id, age_start, age_stop, mean, var, k from moments where person_id in (select person_id from people group by 1 having count(*) = 3)", ("mean", "var"))
def _(t):
    return slicing.common_windows(replicates.count_moments(t.run_counts))


@_query("strata", "select person_id, cohort, segment from cohorts join persons using (person_id)")
def _(t):
    return slicing.strata(t.persons, ["cohort", "segment"], WIDTH)


@_query("window_catalogue", "select age_start, age_stop, count(distinct seed) as n_seeds, count(distinct person_id) as n_persons from generated group by 1, 2")
def _(t):
    return t.generated.groupBy(*WINDOW).agg(F.count_distinct("seed").alias("n_seeds"), F.count_distinct("person_id").alias("n_persons"))


@_query("population_summary", "select segment, count(distinct person_id) as n_persons, min(birth_year) as first_year, max(birth_year) as last_year from persons group by segment")
def _(t):
    return t.persons.groupBy("segment").agg(F.count_distinct("person_id").alias("n_persons"), F.min("birth_year").alias("first_year"), F.max("birth_year").alias("last_year"))


# -- outcomes -------------------------------------------------------------------------------------


@_query("nth_occurrence", 'select person_id, age from births where "order" = 3')
def _(t):
    return outcomes.nth_occurrence(t.observed, PERSON, B, 3)


@_query("births", 'select person_id, "order", age from births')
def _(t):
    return t.births


@_query("spans", "select person_id, start_age, end_age from spans")
def _(t):
    return t.spans


@_query("exposure_age", "select person_id, age_bin, greatest(least(end_age, hi) - greatest(start_age, lo), 0)::bigint as person_days from spans, bins", ("age_bin",))
def _(t):
    return outcomes.exposure(t.spans, BINS)


@_query("exposure_year", """
    edges as (select lo as x from bins union select hi from bins union select ceil(k * 365.25)::int from range(16, 50) y(k)),
    cells as (select x as lo, lead(x) over (order by x) as hi from edges qualify hi is not null) ;;
    select s.person_id, age_bin, (birth_year + floor(c.lo / 365.25))::int as year, sum(least(end_age, c.hi) - greatest(start_age, c.lo))::bigint as person_days
    from spans s join persons p using (person_id) join cells c on end_age > c.lo and start_age < c.hi join bins b on c.lo >= b.lo and c.lo < b.hi group by 1, 2, 3""", ("age_bin",))
def _(t):
    return outcomes.exposure_by_year(t.spans, BINS, t.persons)


@_query("tte_first", "select person_id, duration::bigint as duration, observed from first_birth")
def _(t):
    return t.timed(t.observed, PERSON)


@_query("tte_second_from_first", """
    select s.person_id, (coalesce(b2.age, end_age) - b1.age)::bigint as duration, b2.age is not null as observed
    from spans s join births b1 on b1.person_id = s.person_id and b1."order" = 1 left join births b2 on b2.person_id = s.person_id and b2."order" = 2""")
def _(t):
    return t.timed(t.observed, PERSON, SECOND)


@_query("framed_by_age", """
    f as (select person_id, seed, age_start, age_stop, min(age) filter (event = 'F') as a, max(age) as e from life group by 1, 2, 3, 4) ;;
    select person_id, seed, age_start, age_stop, coalesce(a <= 14610 and a > -1, false) as occurred,
        not (14610 <= age_stop or coalesce(a <= age_stop, false)) and (coalesce(a <= 14610 and a > -1, false) or e >= 14610) as evaluable from f""")
def _(t):
    return outcomes.evaluate_framed(t.life, GENERATED, BY40, F.col("age_stop"))


@_query("framed_within", """
    f as (select person_id, seed, age_start, age_stop, min(age) filter (event = 'F') as a, max(age) as e from life group by 1, 2, 3, 4) ;;
    select person_id, seed, age_start, age_stop, coalesce(a > age_stop and a <= age_stop + 1826, false) as occurred,
        not coalesce(a <= age_stop, false) and (coalesce(a > age_stop and a <= age_stop + 1826, false) or e >= age_stop + 1826) as evaluable from f""")
def _(t):
    return outcomes.evaluate_framed(t.life, GENERATED, IN5, F.col("age_stop"))


@_query("framed_within_origin", """
    f as (select person_id, age_start, age_stop, list_sort(list(age) filter (event = 'F')) as b, max(age) as e from observed, windows group by 1, 2, 3),
    g as (select *, b[1] as o, b[2] as a from f where len(b) >= 1) ;;
    select person_id, age_start, age_stop, coalesce(a > o and a <= o + 1096, false) as occurred,
        not (o + 1096 <= age_stop or coalesce(a <= age_stop, false)) and (coalesce(a > o and a <= o + 1096, false) or e >= o + 1096) as evaluable from g""")
def _(t):
    return outcomes.evaluate_framed(t.in_windows, RUN, AFTER3, F.col("age_stop"))


@_query("count_within", "select * from evaluated")
def _(t):
    return t.evaluated


@_query("count_by_age", """
    select person_id, seed, age_start, age_stop, count(*) filter (event = 'F' and age > age_stop and age <= 14610) >= 2 as occurred,
        count(*) filter (event = 'F' and age > age_stop and age <= 14610) >= 2 or max(age) >= 14610 as evaluable from generated group by 1, 2, 3, 4""")
def _(t):
    return outcomes.evaluate_count(t.generated, GENERATED, COUNT40, F.col("age_stop"))


@_query("life_course", "select person_id, seed, age_start, age_stop, age, event from life")
def _(t):
    return t.life


@_query("pooled_units", "select age_start, age_stop, count(distinct (person_id, seed)) as n_units, count(distinct person_id) as n_source_persons from life group by 1, 2")
def _(t):
    return outcomes.pooled(t.life).groupBy(*WINDOW).agg(F.count_distinct("unit").alias("n_units"), F.count_distinct("person_id").alias("n_source_persons"))


@_query("counts_per_run", "select * from run_counts")
def _(t):
    return t.run_counts


@_query("settled_persons", "select person_id from spans join births using (person_id) where \"order\" = 1 and age <= 10958")
def _(t):
    return outcomes.settled_persons(t.observed, IN5, years_to_days(30))


# -- replicates -----------------------------------------------------------------------------------


@_query("replicate_summary", "select * from counted")
def _(t):
    return replicates.summary(t.evaluated)


@_query("probability_wilson", """
    w as (select *, k / n as p, 1.959963984540054::double as z from counted) ;;
    select person_id, age_start, age_stop, k, n, p as p_hat, ln((k + 0.5::double) / (n - k + 0.5::double)) as logit_emp, 1 / (k + 0.5::double) + 1 / (n - k + 0.5::double) as var_logit,
        greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 0) as ci_lo,
        least((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 1) as ci_hi from w""", ("p_hat", "logit_emp", "var_logit", "ci_lo", "ci_hi"))
def _(t):
    return t.probabilities


@_query("probability_jeffreys")
def _(t):
    return replicates.probability(replicates.summary(t.evaluated))


@_query("timing_distribution", """
    c as (select *, observed and duration <= 18262 as hit, case when observed and duration <= 18262 then duration else 18262 end::double as d from life_first) ;;
    select person_id, age_start, age_stop, quantile_cont(d, 0.1) as q10, quantile_cont(d, 0.25) as q25, quantile_cont(d, 0.5) as q50, quantile_cont(d, 0.75) as q75, quantile_cont(d, 0.9) as q90,
        count(*) filter (hit) / count(*) as p_within_horizon, count(*) filter (hit) as n_occurred, count(*) as n from c group by 1, 2, 3""", ("q10", "q25", "q50", "q75", "q90", "p_within_horizon"))
def _(t):
    return replicates.timing_distribution(t.timed(t.life, GENERATED), years_to_days(50))


@_query("count_distribution", "select person_id, age_start, age_stop, count, count(*) as n, count(*) / sum(count(*)) over (partition by person_id, age_start, age_stop) as share from run_counts group by 1, 2, 3, 4", ("share",))
def _(t):
    return replicates.count_distribution(t.run_counts)


@_query("count_moments", "select * from moments", ("mean", "var"))
def _(t):
    return replicates.count_moments(t.run_counts)


@_query("count_quantiles", """
    select person_id, age_start, age_stop, quantile_cont(count::double, 0) as q0, quantile_cont(count::double, 0.25) as q25, quantile_cont(count::double, 0.5) as q50,
        quantile_cont(count::double, 0.75) as q75, quantile_cont(count::double, 1) as q100, count(*) as k from run_counts group by 1, 2, 3""", ("q0", "q25", "q50", "q75", "q100"))
def _(t):
    return replicates.count_quantiles(t.run_counts)


@_query("variance_components", """
    select age_start, age_stop, avg(mean) as mean, sum(var / k) / (count(*) * count(*)) as within_var, greatest(var_samp(mean) / count(*) - sum(var / k) / (count(*) * count(*)), 0) as between_var,
        var_samp(mean) / count(*) as total_var, count(*) as n from moments group by 1, 2""", ("mean", "within_var", "between_var", "total_var"))
def _(t):
    return replicates.variance_components(replicates.count_moments(t.run_counts), WINDOW)


@_query("brier_correction", "select avg(k / n * (1 - k / n) / (n - 1)) as correction from counted where n >= 2", ("correction",))
def _(t):
    return replicates.noise_correction(replicates.summary(t.evaluated))


@_query("null_band")
def _(t):
    return replicates.null_band(replicates.summary(t.evaluated))


# -- survival -------------------------------------------------------------------------------------


def _km_sql(source: str, by: str) -> str:
    part = f"partition by {by}" if by else ""
    lead, using = (f"{by}, ", f"join sizes using ({by})") if by else ("", "cross join sizes")
    return f"""
    c as (select {lead}duration as time, count(*) as a, count(*) filter (observed) as n_events from {source} group by all),
    sizes as (select {lead}count(distinct person_id) as n_persons from {source} {'group by ' + by if by else ''}),
    r as (select *, sum(a) over ({part} order by time desc rows unbounded preceding)::bigint as n_at_risk from c),
    s as (select *, product(1 - n_events / n_at_risk) over ({part} order by time rows unbounded preceding) as survival,
        sum(case when n_at_risk > n_events then n_events / (n_at_risk * (n_at_risk - n_events)) else 0 end) over ({part} order by time rows unbounded preceding) as g from r where n_events > 0),
    x as (select *, case when survival > 0 and survival < 1 then 1.959963984540054::double * sqrt(g) / ln(survival) end as bend from s) ;;
    select {lead}time::bigint as time, n_at_risk, n_events, survival, survival * survival * g as greenwood_var, least(pow(survival, exp(bend)), pow(survival, exp(-bend))) as ci_lo,
        greatest(pow(survival, exp(bend)), pow(survival, exp(-bend))) as ci_hi, n_persons from x {using}"""


_KM = ("survival", "greenwood_var", "ci_lo", "ci_hi")


@_query("km", _km_sql("first_birth", ""), _KM)
def _(t):
    return survival.kaplan_meier(t.timed(t.observed, PERSON))


@_query("km_stratified", _km_sql("(select * from first_birth join persons using (person_id))", "segment"), _KM)
def _(t):
    return survival.kaplan_meier(t.timed(t.observed, PERSON).join(t.persons.select("person_id", "segment"), "person_id"), ["segment"])


@_query("km_by_seed", _km_sql("life_first", "age_start, age_stop, seed"), _KM)
def _(t):
    return survival.kaplan_meier(t.timed(t.life, GENERATED), [*WINDOW, "seed"])


@_query("median_survival", _km_sql("(select * from first_birth join persons using (person_id))", "segment").replace("select segment, time::bigint", "select segment, min(time) filter (survival <= 0.5 + 1e-12::double)::bigint as median from (select segment, time::bigint") + ") group by segment")
def _(t):
    curve = survival.kaplan_meier(t.timed(t.observed, PERSON).join(t.persons.select("person_id", "segment"), "person_id"), ["segment"])
    return survival.median_survival(curve, ["segment"])


@_query("km_grid_asof", """
    c as (select duration as time, count(*) as a, count(*) filter (observed) as n_events from first_birth group by all),
    r as (select *, sum(a) over (order by time desc rows unbounded preceding)::bigint as n_at_risk from c),
    s as (select time, product(1 - n_events / n_at_risk) over (order by time rows unbounded preceding) as survival from r where n_events > 0),
    grid as (select round_even((y * 365.25)::double, 0)::bigint as time from range(16, 46, 2) q(y)) ;;
    select g.time, coalesce(s.survival, 1) as survival from grid g asof left join s on g.time >= s.time""", ("survival",))
def _(t):
    return survival.on_grid(t.timed(t.observed, PERSON), [])


# -- fertility ------------------------------------------------------------------------------------


@_query("ccf", """
    select cohort, coalesce(sum(n), 0) / count(*) as ccf, max(end_age) >= 18262 as complete, count(*) as n_persons
    from spans join cohorts using (person_id) left join (select person_id, count(*) as n from births group by 1) using (person_id) group by 1""", ("ccf",))
def _(t):
    return fertility.ccf(t.births, t.spans, t.cohorts)


@_query("ccf_by_seed", """
    select age_start, age_stop, seed, cohort, coalesce(sum(n), 0) / count(*) as ccf, max(end_age) >= 18262 as complete, count(*) as n_persons
    from life_spans join cohorts using (person_id) left join (select person_id, seed, age_start, age_stop, count(*) as n from life_births group by 1, 2, 3, 4) using (person_id, seed, age_start, age_stop)
    group by 1, 2, 3, 4""", ("ccf",))
def _(t):
    life = t.life
    return fertility.ccf(outcomes.births(life, GENERATED, B), outcomes.spans(life, GENERATED), t.cohorts, [*WINDOW, "seed"])


@_query("ccf_variance", """
    c as (select s.person_id, s.seed, s.age_start, s.age_stop, count(b.age) as count from life_spans s left join life_births b using (person_id, seed, age_start, age_stop) group by 1, 2, 3, 4),
    m as (select person_id, age_start, age_stop, avg(count) as mean, var_pop(count) as var, count(*) as k from c group by 1, 2, 3) ;;
    select age_start, age_stop, cohort, avg(mean) as ccf, sum(var / k) / (count(*) * count(*)) as within_var,
        case when count(*) > 1 then greatest(var_samp(mean) / count(*) - sum(var / k) / (count(*) * count(*)), 0) end as between_var,
        case when count(*) > 1 then var_samp(mean) / count(*) end as total_var, count(*) as n_persons from m join cohorts using (person_id) group by 1, 2, 3""", ("ccf", "within_var", "between_var", "total_var"))
def _(t):
    life = t.life
    return fertility.ccf_variance(outcomes.births(life, GENERATED, B), outcomes.spans(life, GENERATED), t.cohorts, WINDOW)


@_query("parity_distribution", """
    c as (select s.person_id, cohort, least(count(b.age), 4) as parity from spans s join cohorts using (person_id) left join births b using (person_id) group by 1, 2),
    t as (select cohort, count(*) as n_women_total, count(*) as n_replicates_total from c group by 1),
    g as (select t.*, p as parity from t, range(5) r(p)),
    f as (select g.cohort, g.parity, count(c.person_id) as n, n_women_total, n_replicates_total from g left join c using (cohort, parity) group by all),
    h as (select *, n between 1 and 3 or n_women_total between 1 and 3 as h from f),
    i as (select *, sum(h::int) over (partition by cohort) as hs, row_number() over (partition by cohort order by case when not h and n > 0 then 0 else 1 end, n, parity) as r from h),
    j as (select *, h or (hs = 1 and not h and n > 0 and r = 1) as gone from i) ;;
    select cohort, parity, case when not gone then n end as n_replicates, case when not gone then n_replicates_total end as n_replicates_total, case when not gone then n::double end as n_women_equiv,
        case when not gone then n / n_women_total end as share, case when not gone then n_women_total end as n_women_total, case when not gone then n end as n_persons, gone as suppressed from j""", ("n_women_equiv", "share"))
def _(t):
    return fertility.parity_distribution(t.births, t.spans, t.cohorts)


@_query("asfr", """
    e as (select cohort, age_bin, sum(greatest(least(end_age, hi) - greatest(start_age, lo), 0)) as d, count(*) as n_persons from spans join cohorts using (person_id), bins group by 1, 2),
    b as (select cohort, age_bin, count(*) as births from births join cohorts using (person_id) join bins on age >= lo and age < hi group by 1, 2) ;;
    select cohort, age_bin, coalesce(births, 0) as births, d / 365.25::double as person_years, case when d > 0 then coalesce(births, 0) / (d / 365.25::double) end as asfr,
        case when d > 0 then coalesce(births, 0) / pow(d / 365.25::double, 2) end as asfr_var, n_persons from e left join b using (cohort, age_bin)""", ("age_bin", "person_years", "asfr", "asfr_var"))
def _(t):
    return fertility.asfr(t.births, t.spans, t.cohorts, BINS)


@_query("ppr", """
    c as (select s.person_id, count(b.age) as n from spans s left join births b using (person_id) group by 1),
    p as (select k as parity_from, count(*) filter (n >= k) as n_at_risk, count(*) filter (n > k) as n_progressed, count(*) filter (n >= k) as n_persons from c, range(6) r(k) group by 1) ;;
    select parity_from, parity_from + 1 as parity_to, n_at_risk, n_progressed, n_persons, case when n_at_risk > 0 then n_progressed / n_at_risk end as ppr,
        case when n_at_risk > 0 then n_progressed / n_at_risk * (1 - n_progressed / n_at_risk) / n_at_risk end as ppr_var from p""", ("ppr", "ppr_var"))
def _(t):
    return fertility.ppr(t.births, t.spans, 6)


_LEXIS = ("age_bin", "rate", "rate_var", "person_years")


@_query("lexis_cohort", """
    e as (select cohort, age_bin, sum(greatest(least(end_age, hi) - greatest(start_age, lo), 0)) as d, count(*) filter (least(end_age, hi) > greatest(start_age, lo)) as n_persons from spans join cohorts using (person_id), bins group by 1, 2),
    b as (select cohort, age_bin, count(*) as n from births join cohorts using (person_id) join bins on age >= lo and age < hi where "order" = 1 group by 1, 2) ;;
    select cohort, age_bin, coalesce(n, 0) / (d / 365.25::double) as rate, coalesce(n, 0) / pow(d / 365.25::double, 2) as rate_var, coalesce(n, 0) as n_events, d / 365.25::double as person_years, n_persons
    from e left join b using (cohort, age_bin) where d > 0""", _LEXIS)
def _(t):
    return fertility.lexis(t.births, t.spans, 1, BINS, cohorts=t.cohorts)


@_query("lexis_period", """
    edges as (select lo as x from bins union select hi from bins union select ceil(k * 365.25)::int from range(16, 50) y(k)),
    cells as (select x as lo, lead(x) over (order by x) as hi from edges qualify hi is not null),
    e as (select (birth_year + floor(c.lo / 365.25))::int as year, age_bin, sum(least(end_age, c.hi) - greatest(start_age, c.lo)) as d, count(distinct s.person_id) as n_persons
        from spans s join persons p using (person_id) join cells c on end_age > c.lo and start_age < c.hi join bins b on c.lo >= b.lo and c.lo < b.hi group by 1, 2),
    b as (select (birth_year + floor(age / 365.25))::int as year, age_bin, count(*) as n from births join persons using (person_id) join bins on age >= lo and age < hi where "order" = 1 group by 1, 2) ;;
    select year, age_bin, coalesce(n, 0) / (d / 365.25::double) as rate, coalesce(n, 0) / pow(d / 365.25::double, 2) as rate_var, coalesce(n, 0) as n_events, d / 365.25::double as person_years, n_persons
    from e left join b using (year, age_bin) where year between 1980 and 2010""", _LEXIS)
def _(t):
    return fertility.lexis(t.births, t.spans, 1, BINS, persons=t.persons, years=(1980, 2010))


@_query("lexis_completion", """
    o as (select s.person_id, cohort, s.start_age, least(s.end_age, 9131) as end_age from spans s join cohorts using (person_id)),
    oe as (select cohort, age_bin, sum(greatest(least(end_age, hi) - greatest(start_age, lo), 0)) as d from o, bins group by 1, 2),
    ob as (select cohort, age_bin, count(*) as n from births join cohorts using (person_id) join bins on age >= lo and age < hi where "order" = 1 and age <= 9131 group by 1, 2),
    ge as (select cohort, age_bin, sum(greatest(least(end_age, hi) - greatest(start_age, lo), 0)) as d from life_spans join cohorts using (person_id), bins where age_stop = 9131 group by 1, 2),
    gb as (select cohort, age_bin, count(*) as n from life_births join cohorts using (person_id) join bins on age >= lo and age < hi where "order" = 1 and age_stop = 9131 group by 1, 2) ;;
    select cohort, age_bin, coalesce(n, 0) / (d / 365.25::double) as rate, 'observed' as source from oe left join ob using (cohort, age_bin) where d > 0
    union all select cohort, age_bin, coalesce(n, 0) / (d / 365.25::double), 'forecast' from ge left join gb using (cohort, age_bin)
    where d > 0 and (cohort, age_bin) not in (select (cohort, age_bin) from oe where d > 0)""", ("age_bin", "rate"))
def _(t):
    jump = years_to_days(25)
    seen = t.spans.withColumn("end_age", F.least("end_age", F.lit(jump)))
    past = fertility.lexis(t.births.where(F.col("age") <= jump), seen, 1, BINS, cohorts=t.cohorts)
    life = t.life.where(F.col("age_stop") == jump)
    ahead = fertility.lexis(outcomes.births(life, GENERATED, B), outcomes.spans(life, GENERATED), 1, BINS, cohorts=t.cohorts)
    return fertility.complete_surface(past, ahead).select("cohort", "age_bin", "rate", "source")


@_query("majority_complete", """
    c as (select age_start, age_stop, seed, cohort, max(end_age) >= 12000 as complete from life_spans join cohorts using (person_id) group by 1, 2, 3, 4) ;;
    select age_start, age_stop, cohort from c group by 1, 2, 3 having avg(complete::int) > 0.5""")
def _(t):
    life = t.life
    table = fertility.ccf(outcomes.births(life, GENERATED, B), outcomes.spans(life, GENERATED), t.cohorts, [*WINDOW, "seed"], fertile_upper=12000)
    return fertility.majority_complete(table, [*WINDOW, "cohort"])


# -- scoring --------------------------------------------------------------------------------------


@_query("join_truth", "select person_id, age_start, age_stop, k, n, p_hat, y_true from scored", ("p_hat",))
def _(t):
    return t.scored.select(*RUN, "k", "n", "p_hat", "y_true")


@_query("calibration_uniform", """
    select age_start, age_stop, least(floor(p_hat * 10 + 1e-12)::bigint, 9) as bin, least(floor(p_hat * 10 + 1e-12), 9) / 10 as bin_left, (least(floor(p_hat * 10 + 1e-12), 9) + 1) / 10 as bin_right,
        avg(p_hat) as p_mean, avg(y_true) as y_rate, count(*) as n, count(distinct person_id) as n_persons from scored group by 1, 2, 3, 4, 5""", ("bin_left", "bin_right", "p_mean", "y_rate"))
def _(t):
    return scoring.calibration(t.scored, 10, "uniform", WINDOW)


_QUANTILE_BINS = """
    q as (select age_start, age_stop, list_sort(list_distinct(quantile_cont(p_hat, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e from scored group by 1, 2),
    w as (select age_start, age_stop, list_concat(list_concat([0.0::double], case when len(e) > 2 then e[2:len(e) - 1] else []::double[] end), [1.0::double]) as e from q),
    b as (select s.*, e, least(len(list_filter(e, lambda x: x <= p_hat)) - 1, len(e) - 2)::bigint as bin from scored s join w using (age_start, age_stop)),
    cal as (select age_start, age_stop, bin, e[bin + 1] as bin_left, e[bin + 2] as bin_right, avg(p_hat) as p_mean, avg(y_true) as y_rate, count(*) as n, count(distinct person_id) as n_persons from b group by 1, 2, 3, 4, 5)"""


@_query("calibration_quantile", _QUANTILE_BINS + " ;; select * from cal", ("bin_left", "bin_right", "p_mean", "y_rate"))
def _(t):
    return scoring.calibration(t.scored, by=WINDOW)


@_query("ece", _QUANTILE_BINS + " ;; select age_start, age_stop, sum(n * abs(p_mean - y_rate)) / sum(n) as ece from cal group by 1, 2", ("ece",))
def _(t):
    return scoring.ece(scoring.calibration(t.scored, by=WINDOW), WINDOW)


_AUC = """
    a as (select age_start, age_stop, p_hat, sum(y_true) as pos, count(*) - sum(y_true) as neg from scored group by 1, 2, 3),
    c as (select *, coalesce(sum(pos) over (partition by age_stop order by p_hat rows between unbounded preceding and 1 preceding), 0) as pb,
        coalesce(sum(neg) over (partition by age_stop order by p_hat rows between unbounded preceding and 1 preceding), 0) as nb, sum(pos) over (partition by age_stop) as p, sum(neg) over (partition by age_stop) as n from a),
    v as (select *, (nb + neg / 2) / n as v10, 1 - (pb + pos / 2) / p as v01 from c),
    auc as (select age_start, age_stop, sum(pos * v10) / max(p) as roc_auc,
        (sum(pos * v10 * v10) - pow(sum(pos * v10), 2) / max(p)) / (max(p) - 1) / max(p) + (sum(neg * v01 * v01) - pow(sum(neg * v01), 2) / max(n)) / (max(n) - 1) / max(n) as auc_var from v group by 1, 2)"""


@_query("roc_auc", _AUC + " ;; select age_start, age_stop, roc_auc from auc", ("roc_auc",))
def _(t):
    return scoring.roc_auc(t.scored, WINDOW)


@_query("auc_variance", _AUC + " ;; select age_start, age_stop, auc_var from auc", ("auc_var",))
def _(t):
    return scoring.auc_variance(t.scored, WINDOW)


@_query("brier", """
    select age_start, age_stop, avg(pow(p_hat - y_true, 2)) as brier_raw, avg(pow(p_hat - y_true, 2)) - coalesce(avg(case when n >= 2 then p_hat * (1 - p_hat) / (n - 1) end), 0) as brier_corrected
    from scored group by 1, 2""", ("brier_raw", "brier_corrected"))
def _(t):
    return scoring.brier(t.scored, WINDOW)


@_query("mse_r2", "select age_start, age_stop, avg(pow(p_hat - y_true, 2)) as mse, 1 - avg(pow(p_hat - y_true, 2)) / var_pop(y_true) as r2 from scored group by 1, 2", ("mse", "r2"))
def _(t):
    return scoring.mse_r2(t.scored, WINDOW)


@_query("log_loss", """
    x as (select *, least(greatest(p_hat, 1e-12::double), 1 - 1e-12::double) as p from scored) ;;
    select age_start, age_stop, -avg(case when y_true = 1 then ln(p) else ln(1 - p) end) as log_loss from x group by 1, 2""", ("log_loss",))
def _(t):
    return scoring.log_loss(t.scored, WINDOW)


@_query("score_cis", _AUC + """,
    l as (select *, pow(p_hat - y_true, 2) as l, pow(p_hat - y_true, 2) - case when n >= 2 then p_hat * (1 - p_hat) / (n - 1) else 0 end as cl from scored),
    f as (select age_start, age_stop, count(*) as m, avg(l) as a, stddev_samp(l) as sl, avg(cl) as ac, stddev_samp(cl) as sc, avg(y_true) as y, var_pop(y_true) as b from l group by 1, 2),
    s as (select age_start, age_stop, stddev_samp((l - a / b * pow(y_true - y, 2)) / b) as sr from l join f using (age_start, age_stop) group by 1, 2),
    r as (select age_start, age_stop, unnest([{'metric': 'mse', 'v': a, 's': sl / sqrt(m)}, {'metric': 'brier_raw', 'v': a, 's': sl / sqrt(m)}, {'metric': 'brier_corrected', 'v': ac, 's': sc / sqrt(m)},
        {'metric': 'r2', 'v': 1 - a / b, 's': sr / sqrt(m)}, {'metric': 'roc_auc', 'v': roc_auc, 's': sqrt(auc_var)}]) as x from f join s using (age_start, age_stop) join auc using (age_start, age_stop)) ;;
    select age_start, age_stop, x.metric as metric, case when x.metric = 'roc_auc' then greatest(least(x.v - 1.959963984540054::double * x.s, 1), 0) else x.v - 1.959963984540054::double * x.s end as ci_lo,
        case when x.metric = 'roc_auc' then greatest(least(x.v + 1.959963984540054::double * x.s, 1), 0) else x.v + 1.959963984540054::double * x.s end as ci_hi from r""", ("ci_lo", "ci_hi"))
def _(t):
    return scoring.score_cis(t.scored, WINDOW)


@_query("p_hat_distribution", """
    z as (select age_start, age_stop, floor(quantile_cont(n::double, 0.5))::bigint as m, count(*) as n_total from scored group by 1, 2),
    g as (select z.*, unnest(range(m + 1)) as kk from z),
    c as (select age_start, age_stop, k * m // n as kk, count(*) as c from scored join z using (age_start, age_stop) where k * m % n = 0 group by 1, 2, 3),
    f as (select age_start, age_stop, round(kk / m, 12) as p_hat, coalesce(c, 0) as n, n_total from g left join c using (age_start, age_stop, kk)),
    h as (select *, n between 1 and 3 or n_total between 1 and 3 as h from f),
    i as (select *, sum(h::int) over (partition by age_stop) as hs, row_number() over (partition by age_stop order by case when not h and n > 0 then 0 else 1 end, n, p_hat) as r from h),
    j as (select *, h or (hs = 1 and not h and n > 0 and r = 1) as gone from i) ;;
    select age_start, age_stop, p_hat, case when not gone then n end as n_persons, case when not gone then n_total end as n_total, gone as suppressed from j""", ("p_hat",))
def _(t):
    return scoring.p_hat_distribution(t.scored, WINDOW)


@_query("timing_coverage", """
    c as (select *, case when observed and duration <= 18262 then duration else 18262 end::double as d from life_first),
    q as (select person_id, age_start, age_stop, quantile_cont(d, 0.1) as q10, quantile_cont(d, 0.9) as q90 from c group by 1, 2, 3) ;;
    select age_start, age_stop, avg((f.duration between q10 and q90)::int) as coverage from q join first_birth f using (person_id) where f.observed group by 1, 2""", ("coverage",))
def _(t):
    q = replicates.timing_distribution(t.timed(t.life, GENERATED), years_to_days(50))
    return scoring.timing_coverage(q, t.timed(t.observed, PERSON), by=WINDOW)


_PAIRS = """
    pairs as (select l.person_id, l.seed, l.age_start, l.age_stop, case when l.observed and l.duration <= 14610 then l.duration end as pred, f.duration as obs, l.observed and l.duration <= 14610 as predicted
        from life_first l join first_birth f using (person_id) where f.observed and f.duration <= 14610 and f.duration > l.age_stop)"""


def _pairs(t):
    truth = t.timed(t.observed, PERSON)
    alive = truth.where("observed").crossJoin(F.broadcast(t.windows)).where("duration > age_stop").select("person_id", *WINDOW)
    return scoring.timing_pairs(t.timed(t.life, GENERATED), truth, years_to_days(40), alive)


@_query("timing_pairs", _PAIRS + " ;; select person_id, seed, age_start, age_stop, pred::bigint as pred, obs::bigint as obs, predicted from pairs")
def _(t):
    return _pairs(t)


@_query("timing_error", _PAIRS + """,
    z as (select age_start, age_stop, count(*) as nt, count(*) filter (not predicted) as nx from pairs group by 1, 2),
    k as (select *, floor(pred / 730.0)::bigint as pb, floor((obs - pred) / 365.0)::bigint as eb from pairs where predicted),
    m as (select age_start, age_stop, min(eb) as lo, ceil(max(obs - pred) / 365.0)::bigint as hi from k group by 1, 2),
    s as (select age_start, age_stop, pb, quantile_cont(pred::double, 0.5) as pm, count(*) as np from k group by 1, 2, 3),
    g as (select s.*, unnest(range(lo, hi + 1)) as eb from s join m using (age_start, age_stop)),
    c as (select age_start, age_stop, pb, eb, count(*) as c from k group by 1, 2, 3, 4),
    f as (select age_start, age_stop, pb, pm, np, eb, coalesce(c, 0) as n, nt, nx from g left join c using (age_start, age_stop, pb, eb) join z using (age_start, age_stop)),
    h as (select *, n between 1 and 3 or np between 1 and 3 or nt between 1 and 3 or nx between 1 and 3 as h from f),
    i as (select *, sum(h::int) over (partition by age_stop, pb) as hs, row_number() over (partition by age_stop, pb order by case when not h and n > 0 then 0 else 1 end, n, eb) as r from h),
    j as (select *, h or (hs = 1 and not h and n > 0 and r = 1) as gone from i) ;;
    select age_start, age_stop, pb as pred_bin, (pb * 730)::double as pred_lo, ((pb + 1) * 730)::double as pred_hi, pm as pred_median, case when not gone then np end as n_pred_bin, (eb * 365)::double as error_lo,
        ((eb + 1) * 365)::double as error_hi, case when not gone then n end as n_persons, case when not gone then nt end as n_trajectories, case when not gone then nx end as n_excluded, gone as suppressed from j""", ("pred_lo", "pred_hi", "pred_median", "error_lo", "error_hi"))
def _(t):
    return scoring.timing_error(_pairs(t), WINDOW)


@_query("subgroup_rates", """
    g as (select segment, avg(occurred::int) as pred_rate, count(*) as n_pred from evaluated join persons using (person_id) where evaluable group by 1),
    o as (select segment, avg(occurred::int) as obs_rate, count(*) as n_obs from truth join persons using (person_id) where evaluable group by 1) ;;
    select coalesce(g.segment, o.segment) as segment, pred_rate, n_pred, obs_rate, n_obs from g full join o on g.segment = o.segment""", ("pred_rate", "obs_rate"))
def _(t):
    side = t.persons.select("person_id", "segment")
    return scoring.subgroup_rates(t.evaluated.join(side, "person_id"), t.truth.join(side, "person_id"), ["segment"])


@_query("aggregate_error", """
    s as (select age_start, age_stop, seed, cohort, coalesce(sum(n), 0) / count(*) as v
        from life_spans join cohorts using (person_id) left join (select person_id, seed, age_start, age_stop, count(*) as n from life_births group by 1, 2, 3, 4) using (person_id, seed, age_start, age_stop) group by 1, 2, 3, 4),
    o as (select cohort, coalesce(sum(n), 0) / count(*) as w, count(*) as c from spans join cohorts using (person_id) left join (select person_id, count(*) as n from births group by 1) using (person_id) group by 1) ;;
    select age_start, age_stop, cohort, max(w) as obs, avg(v) as gen_mean, stddev_samp(v) as gen_sd_over_seeds, avg(v - w) as bias, avg(abs(v - w)) as mae, sqrt(avg(pow(v - w, 2))) as rmse, max(c) as n_persons
    from s join o using (cohort) group by 1, 2, 3""", ("obs", "gen_mean", "gen_sd_over_seeds", "bias", "mae", "rmse"))
def _(t):
    life = t.life
    mine = fertility.ccf(outcomes.births(life, GENERATED, B), outcomes.spans(life, GENERATED), t.cohorts, [*WINDOW, "seed"])
    return scoring.aggregate_error(mine, fertility.ccf(t.births, t.spans, t.cohorts), "ccf", ["cohort"])


@_query("coverage", """
    c as (select age_start, age_stop, person_id from observed, windows group by 1, 2, 3 having count(*) filter (event = 'F' and age <= age_stop) = 0),
    x as (select age_start, age_stop, count(*) as n_condition from c group by 1, 2),
    r as (select age_start, age_stop, min(n) as lo, quantile_cont(n::double, 0.5) as mid, max(n) as hi from counted join c using (age_start, age_stop, person_id) group by 1, 2),
    s as (select age_start, age_stop, count(*) as n_evaluable from scored join c using (age_start, age_stop, person_id) group by 1, 2),
    d as (select w.age_start, w.age_stop, count(*) filter ((w.age_start, w.age_stop, person_id) in (select (age_start, age_stop, person_id) from c)) as n_settled from births, windows w where "order" = 1 and age <= w.age_stop group by 1, 2) ;;
    select age_start, age_stop, n_condition, n_evaluable, (select count(*) from spans) - n_condition as n_excluded_condition, n_settled, greatest(n_condition - n_evaluable - n_settled, 0) as n_uncovered,
        lo as n_seed_min, mid as n_seed_median, hi as n_seed_max from x join r using (age_start, age_stop) join s using (age_start, age_stop) join d using (age_start, age_stop)""", ("n_seed_median",))
def _(t):
    runs, scored, everyone, out = replicates.summary(t.evaluated), t.scored, t.observed.select("person_id").distinct(), None
    for years in star.JUMPOFFS:
        jump = years_to_days(years)
        who = outcomes.condition_persons(t.observed, CHILDLESS, jump)
        inside = lambda df, jump=jump, who=who: df.where(F.col("age_stop") == jump).join(who, "person_id", "left_semi")
        row = scoring.coverage(inside(runs), inside(scored), who, outcomes.settled_persons(t.observed, IN5, jump), everyone)
        row = row.select(F.lit(0).alias("age_start"), F.lit(jump).alias("age_stop"), *row.columns)
        out = row if out is None else out.unionByName(row)
    return out


# -- pooling --------------------------------------------------------------------------------------


def _pooled_ppr(t):
    life = t.life
    born, lived = outcomes.births(life, GENERATED, B), outcomes.spans(life, GENERATED)
    return fertility.ppr(born, lived, 6, WINDOW), fertility.ppr(born, lived, 6, [*WINDOW, "seed"])


_SEED_PPR = """
    c as (select s.person_id, s.seed, s.age_start, s.age_stop, count(b.age) as n from life_spans s left join life_births b using (person_id, seed, age_start, age_stop) group by 1, 2, 3, 4),
    p0 as (select age_start, age_stop, k as parity_from, count(*) filter (n >= k) as r, count(*) filter (n > k) as g, count(distinct person_id) filter (n >= k) as u from c, range(6) x(k) group by 1, 2, 3),
    ps as (select age_start, age_stop, seed, k as parity_from, count(*) filter (n >= k) as r, count(*) filter (n > k) as g, count(distinct person_id) filter (n >= k) as u from c, range(6) x(k) group by 1, 2, 3, 4),
    s as (select *, case when r > 0 then g / r end as ppr, case when r > 0 then g / r * (1 - g / r) / r end as v from ps),
    m as (select age_start, age_stop, parity_from, count(*) as k_seeds, avg(v) as mean_var, var_samp(ppr) as between_var from s group by 1, 2, 3),
    p as (select *, case when r > 0 then g / r end as ppr, case when r > 0 then g / r * (1 - g / r) / r end as ppr_var from p0)"""


@_query("ppr_by_seed", _SEED_PPR + " ;; select age_start, age_stop, seed, parity_from, parity_from + 1 as parity_to, r as n_at_risk, g as n_progressed, u as n_persons, ppr, v as ppr_var from s", ("ppr", "ppr_var"))
def _(t):
    return _pooled_ppr(t)[1]


@_query("pooled_ci_ppr", _SEED_PPR + """ ;;
    select age_start, age_stop, parity_from, parity_from + 1 as parity_to, r as n_at_risk, g as n_progressed, u as n_persons, ppr, ppr_var, k_seeds, mean_var, between_var, ppr_var as pooled_var, sqrt(ppr_var) as se,
        greatest(ppr - 1.959963984540054::double * sqrt(ppr_var), case when ppr is not null then 0 end) as ci_lo, least(ppr + 1.959963984540054::double * sqrt(ppr_var), case when ppr is not null then 1 end) as ci_hi
    from p left join m using (age_start, age_stop, parity_from)""", ("ppr", "ppr_var", "mean_var", "between_var", "pooled_var", "se", "ci_lo", "ci_hi"))
def _(t):
    whole, seeds = _pooled_ppr(t)
    return pooling.attach_pooled_ci(whole, seeds, "ppr", "ppr_var", [*WINDOW, "parity_from"], clip=(0.0, 1.0))


@_query("pooled_ci_asfr", """
    e as (select age_start, age_stop, seed, cohort, age_bin, sum(greatest(least(end_age, hi) - greatest(start_age, lo), 0)) as d from life_spans join cohorts using (person_id), bins group by 1, 2, 3, 4, 5),
    b as (select age_start, age_stop, seed, cohort, age_bin, count(*) as n from life_births join cohorts using (person_id) join bins on age >= lo and age < hi group by 1, 2, 3, 4, 5),
    s as (select e.*, coalesce(n, 0) as n, case when d > 0 then coalesce(n, 0) / (d / 365.25::double) end as r, case when d > 0 then coalesce(n, 0) / pow(d / 365.25::double, 2) end as v from e left join b using (age_start, age_stop, seed, cohort, age_bin)),
    m as (select age_start, age_stop, cohort, age_bin, count(*) as k_seeds, avg(v) as mean_var, var_samp(r) as between_var, sum(n)::bigint as births, sum(d) / 365.25::double as person_years from s group by 1, 2, 3, 4),
    x as (select *, case when person_years > 0 then births / person_years end as asfr, case when person_years > 0 then births / pow(person_years, 2) end as asfr_var from m) ;;
    select age_start, age_stop, cohort, age_bin, births, person_years, asfr, asfr_var, k_seeds, mean_var, between_var, asfr_var as pooled_var, sqrt(asfr_var) as se,
        greatest(asfr - 1.959963984540054::double * sqrt(asfr_var), case when asfr is not null then 0 end) as ci_lo, asfr + 1.959963984540054::double * sqrt(asfr_var) as ci_hi from x""",
    ("age_bin", "person_years", "asfr", "asfr_var", "mean_var", "between_var", "pooled_var", "se", "ci_lo", "ci_hi"))
def _(t):
    life = t.life
    born, lived = outcomes.births(life, GENERATED, B), outcomes.spans(life, GENERATED)
    whole, seeds = (fertility.asfr(born, lived, t.cohorts, BINS, by) for by in (WINDOW, [*WINDOW, "seed"]))
    return pooling.attach_pooled_ci(whole, seeds, "asfr", "asfr_var", [*WINDOW, "cohort", "age_bin"], clip=(0.0, None)).drop("n_persons")


def _km_cte(name: str, source: str, by: str) -> str:
    inner, _, main = _km_sql(source, by).rpartition(";;")
    return f"{name} as (with {inner} {main})"


@_query("pooled_ci_km", f"""
    {_km_cte("whole", "life_first", "age_start, age_stop")}, {_km_cte("curves", "life_first", "age_start, age_stop, seed")},
    asked as (select age_start, age_stop, time, seed from whole join (select distinct age_start, age_stop, seed from curves) using (age_start, age_stop)),
    read as (select a.age_start, a.age_stop, a.time, coalesce(c.survival, 1) as s, coalesce(c.greenwood_var, 0) as v from asked a
        asof left join curves c on a.age_start = c.age_start and a.age_stop = c.age_stop and a.seed = c.seed and a.time >= c.time),
    cells as (select age_start, age_stop, time, count(*) as k_seeds, avg(v) as mean_var, var_samp(s) as between_var from read group by 1, 2, 3) ;;
    select whole.*, k_seeds, mean_var, between_var, greenwood_var as pooled_var, sqrt(greenwood_var) as se from whole left join cells using (age_start, age_stop, time)""", (*_KM, "mean_var", "between_var", "pooled_var", "se"))
def _(t):
    timed = t.timed(t.life, GENERATED)
    return survival.attach_pooled(survival.kaplan_meier(timed, WINDOW), survival.kaplan_meier(timed, [*WINDOW, "seed"]), WINDOW)


@_query("design_effect", _SEED_PPR + """ ;;
    select age_start, age_stop, parity_from, k_seeds, least(greatest(mean_var - (k_seeds - 1) / k_seeds * between_var, mean_var / k_seeds), mean_var) as variance from m where mean_var is not null and between_var is not null""", ("variance",))
def _(t):
    parts = pooling.seed_components(_pooled_ppr(t)[1], "ppr", "ppr_var", [*WINDOW, "parity_from"]).where("mean_var is not null and between_var is not null")
    return parts.select(*WINDOW, "parity_from", "k_seeds", pooling.design_effect(F.col("mean_var"), F.col("between_var"), F.col("k_seeds")).alias("variance"))


# -- dispersion, sequences, plausibility, disclosure ----------------------------------------------


@_query("dispersion", """
    c as (select * from moments where person_id in (select person_id from people group by 1 having count(*) = 3)),
    z as (select min(var) as lo, (max(var) - min(var)) / 20 as w from c),
    b as (select age_stop, least(floor((var - lo) / w + 1e-9::double)::bigint, 19) as bin from c, z),
    s as (select age_stop, count(*) as n_group from c group by 1),
    g as (select s.*, x as bin from s, range(20) y(x)),
    f as (select g.age_stop, g.bin, count(b.bin) as n, n_group from g left join b on g.age_stop = b.age_stop and g.bin = b.bin group by all),
    h as (select *, n between 1 and 3 or n_group between 1 and 3 as h from f),
    i as (select *, sum(h::int) over (partition by age_stop) as hs, row_number() over (partition by age_stop order by case when not h and n > 0 then 0 else 1 end, n, bin) as r from h),
    j as (select *, h or (hs = 1 and not h and n > 0 and r = 1) as gone from i) ;;
    select age_stop, bin, lo + w * bin as bin_lo, lo + w * (bin + 1) as bin_hi, case when not gone then n end as n_persons, case when not gone then n_group end as n_group, gone as suppressed from j, z""", ("bin_lo", "bin_hi"))
def _(t):
    return dispersion.distribution(dispersion.individual(t.generated, B), "within_seed_var", ["age_stop"])


@_query("quantile_summary", """
    q as (select person_id, age_start, age_stop, quantile_cont(count::double, [0, 0.25, 0.5, 0.75, 1.0]) as q, count(*) as k from run_counts group by 1, 2, 3),
    s as (select age_stop, count(*) as n, avg(k) as mean_k, avg(q[1]) as q0, avg(q[2]) as q25, avg(q[3]) as q50, avg(q[4]) as q75, avg(q[5]) as q100 from q
        where person_id in (select person_id from people group by 1 having count(*) = 3) group by 1) ;;
    select age_stop, n as n_persons, mean_k, q0 as mean_q0, q25 as mean_q25, q50 as mean_q50, q75 as mean_q75, q100 as mean_q100, false as suppressed from s""", ("mean_k", "mean_q0", "mean_q25", "mean_q50", "mean_q75", "mean_q100"))
def _(t):
    return dispersion.quantile_summary(dispersion.individual(t.generated, B), ["age_stop"])


@_query("replicate_variance_individual", """
    q as (select person_id, age_start, age_stop, quantile_cont(count::double, [0, 0.25, 0.5, 0.75, 1.0]) as q from run_counts group by 1, 2, 3) ;;
    select person_id, age_start, age_stop, mean as expected_count, var as within_seed_var, case when mean > 0 then sqrt(var) / mean end as cv, q[1] as q0, q[2] as q25, q[3] as q50, q[4] as q75, q[5] as q100, k
    from moments join q using (person_id, age_start, age_stop) where person_id in (select person_id from people group by 1 having count(*) = 3)""", ("expected_count", "within_seed_var", "cv", "q0", "q25", "q50", "q75", "q100"))
def _(t):
    return dispersion.individual(t.generated, B)


@_query("replicate_occurrence", """
    c as (select *, observed and duration <= 18262 as hit, case when observed and duration <= 18262 then duration else 18262 end::double as d from life_first),
    s as (select person_id, age_start, age_stop, count(*) filter (hit) as k, count(*) as n, quantile_cont(d, 0.9) - quantile_cont(d, 0.1) as timing_spread from c group by 1, 2, 3),
    w as (select *, k / n as p, 1.959963984540054::double as z from s) ;;
    select person_id, age_start, age_stop, k, n, p as p_hat, greatest((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 0) as ci_lo,
        least((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 1) as ci_hi, timing_spread from w""", ("p_hat", "ci_lo", "ci_hi", "timing_spread"))
def _(t):
    return dispersion.occurrence(t.timed(t.life, GENERATED), years_to_days(50))


@_query("replicate_variance_aggregate", """
    c as (select person_id, seed, age_start, age_stop, count(*) filter (event = 'F') as count from life group by 1, 2, 3, 4),
    m as (select person_id, age_start, age_stop, avg(count) as mean, var_pop(count) as var, count(*) as k from c group by 1, 2, 3),
    f as (select m.*, coalesce(moments.mean, 0) as future, cohort from m left join moments using (person_id, age_start, age_stop) join cohorts using (person_id)),
    g as (select age_start, age_stop, cohort, avg(mean) as ccf, sum(var / k) / (count(*) * count(*)) as within_var, var_samp(mean) / count(*) as total_var, avg(future) as fu, count(*) as n_persons
        from f group by grouping sets ((age_start, age_stop), (age_start, age_stop, cohort))) ;;
    select age_start, age_stop, cohort, ccf, within_var, greatest(total_var - within_var, 0) as between_var, total_var, sqrt(total_var) as se_total, ccf - 1.959963984540054::double * sqrt(total_var) as ci_total_lo,
        ccf + 1.959963984540054::double * sqrt(total_var) as ci_total_hi, fu / ccf as forecast_share, n_persons from g""", ("ccf", "within_var", "between_var", "total_var", "se_total", "ci_total_lo", "ci_total_hi", "forecast_share"))
def _(t):
    return dispersion.aggregate(t.generated, t.life, B, t.cohorts)


@_query("event_age_distribution", """
    tok as (select * from (values ('birth', 'F'), ('marriage', 'O'), ('divorce', 'P')) v(alias, token)),
    e as (select age_bin, sum(greatest(least(end_age, hi) - greatest(start_age, lo), 0)) / 365.25::double as person_years from spans, bins group by 1),
    c as (select alias, age_bin, count(*) as n, count(distinct person_id) as u from observed join tok on event = token join bins on age >= lo and age < hi group by 1, 2),
    f as (select alias, token, age_bin, coalesce(n, 0) as n, coalesce(u, 0) as u, person_years, sum(coalesce(n, 0)) over (partition by alias)::bigint as total from (select * from tok, e) left join c using (alias, age_bin)),
    h as (select *, n between 1 and 3 or u between 1 and 3 or total between 1 and 3 as h from f),
    i as (select *, sum(h::int) over (partition by alias) as hs, row_number() over (partition by alias order by case when not h and n > 0 then 0 else 1 end, n, age_bin) as r from h),
    j as (select *, h or (hs = 1 and not h and n > 0 and r = 1) as gone from i) ;;
    select alias, token, age_bin, case when not gone then n end as n_events, case when not gone then person_years end as person_years, case when not gone and person_years > 0 then n / person_years end as rate,
        case when not gone and total > 0 then n / total end as share, case when not gone then u end as n_units, case when not gone then u end as n_source_persons, case when not gone then total end as n_events_total, gone as suppressed from j""",
    ("age_bin", "person_years", "rate", "share"))
def _(t):
    return sequences.event_age_distribution(t.observed, t.spans, TOKENS, BINS)


@_query("token_frequency", """
    tok as (select * from (values ('birth', 'F'), ('marriage', 'O'), ('divorce', 'P')) v(alias, token)),
    u as (select distinct age_start, age_stop, person_id, seed from generated),
    h as (select u.*, alias, token, count(g.age) as c from u cross join tok left join generated g on g.person_id = u.person_id and g.seed = u.seed and g.age_stop = u.age_stop and g.event = token group by all),
    p as (select age_start, age_stop, alias, token, person_id, sum(c) as c, count(*) as n, count(*) filter (c > 0) as a from h group by 1, 2, 3, 4, 5) ;;
    select age_start, age_stop, alias, token, sum(c)::bigint as n_events, sum(n)::bigint as n_units, sum(a)::bigint as n_units_with_any, sum(a) / sum(n) as share_with_any, count(*) as n_source_persons,
        count(*) filter (a > 0) as n_persons_with_any, avg(a / n) as mean_person_share, false as suppressed from p group by 1, 2, 3, 4""", ("share_with_any", "mean_person_share"))
def _(t):
    return sequences.token_frequency(t.generated, t.generated, TOKENS, ["person_id", "seed"], WINDOW)


_O = "o as (select *, row_number() over (partition by person_id, event order by age) as r, age - lag(age) over (partition by person_id, event order by age) as gap from observed), a as (select person_id, min(age) filter (event = 'P') as d, list_sort(list(age) filter (event = 'O')) as m from observed group by 1)"


def _rule_sql(name: str, severity: str, where: str) -> str:
    return f"select o.person_id, age, event, '{name}' as rule, '{severity}' as severity from o join a using (person_id) where {where}"


_RULE_SQL = {
    "rules_min_max_age": _rule_sql("young", "illegal", "event = 'F' and age < 4383") + " union all " + _rule_sql("old", "warn", "event = 'F' and age > 14610"),
    "rules_spacing": _rule_sql("spacing", "illegal", "event = 'F' and gap < 365"),
    "rules_not_after": _rule_sql("not_after", "illegal", "event = 'F' and age > d"),
    "rules_not_before": _rule_sql("not_before", "illegal", "event = 'P' and (m is null or age < m[1])"),
    "rules_max_count": _rule_sql("max_count", "illegal", "event = 'F' and r > 4"),
    "rules_occurrence": _rule_sql("second_before_marriage", "illegal", "event = 'F' and r = 2 and (coalesce(len(m), 0) < 2 or age < m[2])"),
}
for _name, _rules in RULES.items():
    _query(_name, f"{_O} ;; {_RULE_SQL[_name]}")(lambda t, rules=_rules: plausibility.check_rules(t.observed, PERSON, rules))


@_query("violation_rates", """
    v as (select seed, age_start, age_stop, count(*) filter (gap < 365) as s, count(*) filter (r > 4) as m, count(*) as e from (
        select *, age - lag(age) over w as gap, row_number() over w as r from life where event = 'F' window w as (partition by person_id, seed, age_start, age_stop order by age)) group by 1, 2, 3),
    c as (select seed, age_start, age_stop, count(distinct person_id) as n from life group by 1, 2, 3) ;;
    select seed, age_start, age_stop, rule, severity, case rule when 'spacing' then s else m end as n_violations, e as n_events, case rule when 'spacing' then s else m end / e as rate_per_event, n as n_persons
    from c join v using (seed, age_start, age_stop), (values ('spacing', 'illegal'), ('max_count', 'illegal')) x(rule, severity)""", ("rate_per_event",))
def _(t):
    rules = RULES["rules_spacing"] + RULES["rules_max_count"]
    life = t.life
    return plausibility.violation_rates(plausibility.check_rules(life, GENERATED, rules), life, rules, ["seed", *WINDOW])


@_query("suppress_small_cells", """
    f as (select birth_year, segment, count(*) as n from persons group by 1, 2),
    h as (select *, n between 1 and 3 as h from f),
    i as (select *, sum(h::int) over (partition by birth_year) as hs, row_number() over (partition by birth_year order by case when not h and n > 0 then 0 else 1 end, n, segment) as r from h),
    j as (select *, h or (hs = 1 and not h and n > 0 and r = 1) as gone from i) ;;
    select birth_year, segment, case when not gone then n end as n, gone as suppressed from j""")
def _(t):
    cells = t.persons.groupBy("birth_year", "segment").agg(F.count(F.lit(1)).alias("n"))
    return suppress(cells, ["n"], by=["birth_year"], order=["segment"])


# -- labels, score rows, policies ------------------------------------------------------------------


def _nested(name: str) -> str:
    return f"({SQL[name]})"


_ROWS = " union all ".join(
    f"select age_start, age_stop, '{metric}' as metric, {metric} as value from {_nested(query)}" for query, metric in (("ece", "ece"), ("roc_auc", "roc_auc"), ("brier", "brier_raw"), ("brier", "brier_corrected"), ("mse_r2", "mse"), ("mse_r2", "r2"))
)


@_query("score_rows", f"""
    v as ({_ROWS} union all select age_start, age_stop, 'auc_grid_resolution', 1 / quantile_cont(n::double, 0.5) from scored group by 1, 2),
    m as (select age_start, age_stop, count(distinct person_id) as n_persons from scored group by 1, 2) ;;
    select age_start, age_stop, metric, value, ci_lo, ci_hi, n_persons from v join m using (age_start, age_stop) left join {_nested("score_cis")} using (age_start, age_stop, metric)""", ("value", "ci_lo", "ci_hi"))
def _(t):
    scored = t.scored
    return scoring.scores(scored, scoring.calibration(scored, by=WINDOW), WINDOW)


@_query("labelled_counts", "select age_start, age_stop, age_start / 365.25::double as age_start_years, age_stop / 365.25::double as age_stop_years, 'first_within_5' as outcome, '-' as condition, person_id, k, n from counted".replace("age_start / 365.25::double", "round(age_start / 365.25::double, 2)").replace("age_stop / 365.25::double", "round(age_stop / 365.25::double, 2)"))
def _(t):
    from tidewright.plans.arms import labelled

    return labelled(replicates.summary(t.evaluated), "first_within_5", None)


@_query("horizons", "select age_start, age_stop, 14610 as by_age, age_stop + 1826 as within, 1096 as within_origin from windows")
def _(t):
    from tidewright.plans.arms import horizon

    jump = F.col("age_stop")
    return t.windows.select(*WINDOW, horizon(BY40, jump).alias("by_age"), horizon(IN5, jump).alias("within"), horizon(AFTER3, jump).alias("within_origin"))


@_query("pooled_source_persons", _SEED_PPR + """ ;;
    select age_start, age_stop, parity_from, parity_from + 1 as parity_to, r as n_at_risk, g as n_progressed, u as n_units, ppr, ppr_var, (select count(distinct person_id) from generated) as n_source_persons from p""", ("ppr", "ppr_var"))
def _(t):
    return pooling.relabel(_pooled_ppr(t)[0], t.generated.agg(F.count_distinct("person_id")).first()[0])


@_query("bins_for_data", "select x::double as age_bin, round_even((x * 365.25)::double, 0)::int as lo, round_even(((x + 1) * 365.25)::double, 0)::int as hi from (select unnest(range(floor(min(age) / 365.25)::bigint, ceil(max(age) / 365.25)::bigint + 1)) as x from (select age from observed union all select age from generated))", ("age_bin",))
def _(t):
    return sequences.bins_for([t.observed, t.generated]).table(t.observed)


@_query("illegal_moves", """
    o as (select *, age - lag(age) over w as gap, row_number() over w as r from life where event = 'F' window w as (partition by person_id, seed, age_start, age_stop order by age)) ;;
    select person_id, seed, age_start, age_stop, age, event, 'spacing' as rule, 'illegal' as severity from o where gap < 365 and age > age_stop
    union all select person_id, seed, age_start, age_stop, age, event, 'max_count', 'illegal' from o where r > 4 and age > age_stop""")
def _(t):
    return plausibility.check_rules(t.life, GENERATED, RULES["rules_spacing"] + RULES["rules_max_count"]).where(F.col("age") > F.col("age_stop"))


_HIDDEN = "(n_events between 1 and 3 or n_persons between 1 and 3)"


@_query("policy_km", "select segment, time, " + ", ".join(f"case when not {_HIDDEN} then {c} end as {c}" for c in ("n_at_risk", "n_events", *_KM, "n_persons")) + f", {_HIDDEN} as suppressed from {_nested('km_stratified')}", _KM)
def _(t):
    curve = survival.kaplan_meier(t.timed(t.observed, PERSON).join(t.persons.select("person_id", "segment"), "person_id"), ["segment"])
    shown = apply_policy("km_first_birth", curve)
    assert_publishable("km_first_birth", shown)
    return shown


@_query("persons_from_tokens", "select person_id, 1980::smallint as birth_year from observed where event = 'O' group by 1")
def _(t):
    return loaders.persons_from_sequences(t.observed, tokens={M: 1980}, allow_missing=True)


@_query("ages_in_days", "select person_id, round_even(round(age / 365.25::double, 4) * 365.25::double, 0)::int as age, event from observed")
def _(t):
    years = t.observed.withColumn("age", F.round(F.col("age") / 365.25, 4))
    return loaders.in_days(years, ["age"], "years", "observed")


@_query("known_people", "select * from observed where person_id in (select person_id from persons where birth_year < 1970)")
def _(t):
    return loaders.drop_unknown(t.observed, t.persons.where("birth_year < 1970"), "observed")


@_query("flagship", _QUANTILE_BINS.replace("from scored", "from kept").replace("scored s", "kept s").replace("\n    q as", """
    kept as (select * from scored s where s.person_id not in (select o.person_id from observed o where o.event = 'F' and o.age <= s.age_stop)),
    q as""", 1) + " ;; select age_start, age_stop, bin, bin_left, bin_right, p_mean, y_rate, n, n_persons from cal", ("bin_left", "bin_right", "p_mean", "y_rate"))
def flagship(t):
    """How well do replicate frequencies foretell a first birth within five years, among people who
    are childless at the jump-off?"""
    childless = slicing.condition_on_count(t.in_windows, RUN, CHILDLESS, F.col("age_stop")).select(*RUN).distinct()
    return scoring.calibration(t.scored.join(childless, RUN, "left_semi"), by=WINDOW)
