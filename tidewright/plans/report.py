"""Figures and an HTML report from the published files of a run, and from nothing else."""

from __future__ import annotations

import html
import os

import pandas as pd

from tidewright.plans import config as settings
from tidewright.plans.figures import figures_between, figures_of, question_title
from tidewright.sources.publish import read_manifest
from tidewright.units import days_to_years

ROWS, PEEK = 50, 5
SECTIONS = {"descriptives": "What was observed", "backtesting": "Generated against observed", "forecasting": "Forecasts"}
#: Parts of an arm's section: a heading, what the figures show, and the names that figures and tables
#: of the part begin with. What no part names comes at the end.
PARTS = {
    "descriptives": (
        ("Time to events", "Share of people without the event by age, with log-log limits.", ("km_",)),
        ("Fertility", "Cohort means with their sampling interval beside how far people differ; rates by age; who goes on to another birth.", ("ccf", "parity_distribution", "asfr", "ppr")),
    ),
    "backtesting": (
        ("Calibration", "Bins of predicted probability against the share in which the event came. Bars below count people on each probability; hatched bins are withheld.", ("calibration", "reliability", "p_hat_distribution")),
        ("Aggregates, generated and observed", "Bands are the pooled population's own sampling interval. Black is what was observed. White dots are cohorts whose lives are partly ahead.", ("km_overlay", "ccf_overlay", "ppr_overlay", "asfr_cohort_overlay", "km_", "aggregate_error", "asfr", "ppr")),
        ("What is known and what differs", "The interval of a mean says how well the mean is known, not how alike people are.", ("ccf", "parity_distribution")),
        ("Timing", "How much later events came than predicted, by predicted age; ticks are medians.", ("timing_error",)),
    ),
    "forecasting": (
        ("Rates by cohort and age", "Observed cells are filled up by forecasts beyond the frontier. Colours are full at the 98th percentile.", ("lexis",)),
        ("Spread over replicates", "How far replicates of one person differ, over people.", ("within_seed", "replicate_")),
        ("Sequences", "Rates and frequencies of events by age, and rules that sequences break.", ("event_age", "token_frequency", "violation")),
    ),
}


def published(directory: str) -> dict[str, dict[str, str]]:
    """arm -> table -> path."""
    out: dict[str, dict[str, str]] = {}
    for arm in SECTIONS:
        at = os.path.join(directory, arm)
        if os.path.isdir(at):
            out[arm] = {x.removesuffix(".parquet"): os.path.join(at, x) for x in sorted(os.listdir(at)) if x.endswith(".parquet")}
    return out


def drawings(about: dict, tables: dict[str, str]) -> dict[str, tuple[str, object]]:
    """figure -> (the table it belongs to, a function that draws it), of one arm's tables."""
    read = {name: pd.read_parquet(path) for name, path in tables.items()}
    width = about["config"]["persons"]["cohort_width"]
    out = {figure: (name, draw) for name, df in read.items() for figure, draw in figures_of(name, df, width).items()}
    for figure, draw in figures_between(read, about["config"]["replicates"]["level"], _titles(about)).items():
        source = max((n for n in read if figure.startswith(n)), key=len, default="")
        out[figure] = (source, draw)
    return out


def _titles(about: dict) -> dict[tuple[str, str], str]:
    """(outcome, condition) -> what it asks, in words."""
    config = settings.Config.model_validate(about["config"])
    names = {str(token): alias for alias, token in config.events.items()}
    return {(q.name, q.given or "-"): question_title(q, label=lambda t: names.get(str(t), str(t))) for q in settings.questions(config)}


def redraw(directory: str) -> list[str]:
    """Draws every figure of a run from its tables; returns the files."""
    out = []
    about = read_manifest(directory)
    for arm, tables in published(directory).items():
        for figure, (_, draw) in drawings(about, tables).items():
            target = os.path.join(directory, arm, f"{figure}.svg")
            with open(target, "w") as f:
                f.write(draw())
            out.append(target)
    return out


def _table(df: pd.DataFrame, rows: int = ROWS) -> str:
    df = df.drop(columns=[c for c in ("model",) if c in df.columns])
    for c in ("time", "pred_lo", "pred_hi", "pred_median", "error_lo", "error_hi"):
        if c in df.columns:
            df = df.assign(**{c: df[c].map(lambda v: v if pd.isna(v) else round(days_to_years(v), 2))})
    more = f"<p>{len(df) - rows} more rows are in the file.</p>" if len(df) > rows else ""
    return df.head(rows).to_html(index=False, na_rep="", float_format=lambda v: f"{v:.4g}", border=0) + more


def _scores(tables: dict[str, str]) -> str:
    """The scores of each question and jump-off with their intervals, beside how many people they
    rest on and how many were left out."""
    df = pd.read_parquet(tables["scores"])
    keys = [c for c in ("outcome", "condition", "age_stop_years") if c in df.columns]

    def shown(r) -> str:
        if pd.isna(r["value"]):
            return ""
        return f"{r['value']:.3g}" + (f" ({r['ci_lo']:.3g}, {r['ci_hi']:.3g})" if pd.notna(r.get("ci_lo")) else "")

    wide = df.assign(shown=df.apply(shown, axis=1)).pivot_table(index=keys, columns="metric", values="shown", aggfunc="first", dropna=False).dropna(how="all").reset_index()
    if "coverage" in tables:
        seen = pd.read_parquet(tables["coverage"])
        wide = wide.merge(seen[[*keys, "n_condition", "n_evaluable", "n_settled", "n_uncovered"]], on=keys, how="left")
    return _table(wide.fillna(""))


def _summary(directory: str, about: dict) -> str:
    """What ran on what: population, windows, inputs, arms, and who could be judged at all."""
    people = about["coverage"]["population"]
    years = people.get("birth_years")
    facts = [f"{people['n_persons']:,} people" + (f", born {years[0]} to {years[1]}" if years else "")]
    facts += [f"{arm['arm']}: {arm['status']}, {len(arm['outputs'])} files in {arm['duration_s']} s" + (f" ({html.escape(arm['error'])})" if arm.get("error") else "") for arm in about["arms"]]
    parts = ["<h2>Summary</h2><ul>" + "".join(f"<li>{x}</li>" for x in facts) + "</ul>"]
    windows = pd.DataFrame(about["coverage"]["windows"])
    if len(windows):
        parts.append("<h3>Windows</h3>" + _table(windows.assign(**{c: windows[c].map(lambda d: round(days_to_years(d), 2)) for c in ("age_start", "age_stop")})))
    parts.append("<h3>Inputs</h3>" + _table(pd.DataFrame([{"input": k, **v} for k, v in about["inputs"].items()])))
    return "".join(parts)


def _within(name: str, starts: tuple[str, ...]) -> int:
    """How many letters of a part's names a name begins with: the longest wins."""
    return max((len(x) for x in starts if name.startswith(x)), default=0)


def _arm(directory: str, arm: str, tables: dict[str, str], about: dict) -> str:
    drawn = {x.removesuffix(".svg") for x in os.listdir(os.path.join(directory, arm)) if x.endswith(".svg")}
    source = {f: t for f, (t, _) in drawings(about, tables).items() if f in drawn}
    heads = [*PARTS[arm], ("Other tables", "", ())]

    def part_of(name: str) -> int:
        best = max(range(len(heads)), key=lambda k: (_within(name, heads[k][2]), -k))
        return best if _within(name, heads[best][2]) else len(heads) - 1

    parts = []
    for k, (head, says, _) in enumerate(heads):
        figures = sorted(f for f in source if part_of(f) == k)
        own = [t for t in tables if part_of(t) == k and t not in ("scores", "coverage")]
        if not figures and not own:
            continue
        parts.append(f'<h3 id="{arm}-{k}">{head}</h3>' + (f"<p>{says}</p>" if says else ""))
        for f in figures:
            with open(os.path.join(directory, arm, f"{f}.svg")) as file:
                parts.append(f'<figure>{file.read()}<figcaption>{html.escape(f)}' + (f', drawn from <a href="{arm}/{source[f]}.parquet">{source[f]}</a>' if source[f] else "") + "</figcaption></figure>")
        shown = {source[f] for f in figures}
        for name in own:
            parts.append(f'<details{"" if name in shown else " open"}><summary><a href="{arm}/{name}.parquet">{html.escape(name)}</a></summary>{_table(pd.read_parquet(tables[name]), PEEK if name in shown else ROWS)}</details>')
    return "".join(parts)


def build_report(directory: str) -> str:
    """Writes report.html; returns its path."""
    about = read_manifest(directory)
    parts = [f"<h1>{html.escape(about['model'])}</h1><p>Run {html.escape(about['created'])}, configuration {about['config_hash'][:12]}. Counts of {about['min_cell']} or fewer are withheld.</p>", _summary(directory, about)]
    state = {a["arm"]: a for a in about["arms"]}
    for arm, tables in published(directory).items():
        parts.append(f'<h2 id="{arm}">{SECTIONS[arm]}</h2>')
        run = state.get(arm, {})
        if run.get("withheld"):
            parts.append(f"<p>Withheld, as they are about single people: {html.escape(', '.join(run['withheld']))}.</p>")
        if "scores" in tables:
            parts.append("<h3>Scores</h3><p>Values with their intervals, and the people who meet the condition, can be judged, were settled before, or are not covered.</p>" + _scores(tables))
        parts.append(_arm(directory, arm, tables, about))
    if about["warnings"]:
        parts.append("<h2>Warnings</h2><ul>" + "".join(f"<li>{html.escape(w)}</li>" for w in about["warnings"]) + "</ul>")
    style = "body{font-family:sans-serif;margin:2em;max-width:70em}table{border-collapse:collapse;font-size:12px}td,th{padding:2px 8px;text-align:right;border-bottom:1px solid #ddd}figure{display:inline-block;margin:4px}figcaption{font-size:11px;color:#666}"
    path = os.path.join(directory, "report.html")
    with open(path, "w") as f:
        f.write(f"<!doctype html><meta charset='utf-8'><title>{html.escape(about['model'])}</title><style>{style}</style>{''.join(parts)}")
    return path
