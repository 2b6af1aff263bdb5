"""Figures as SVG, drawn from published tables alone, so that a run's figures can be drawn again from
its files. Withheld cells have no value and leave gaps."""

from __future__ import annotations

import html
import math
from collections.abc import Callable, Sequence

import pandas as pd

from tidewright.functions.special import z_of
from tidewright.operators.disclosure import MIN_CELL
from tidewright.plans.specs import Counted, Framed
from tidewright.units import DAYS_PER_YEAR

WIDTH, HEIGHT, LEFT, RIGHT, TOP, BOTTOM = 520, 340, 60, 130, 36, 46
COLOURS = ("#1f5fa8", "#c8502a", "#3a8f4d", "#8a4fa3", "#b08a1e", "#3c9aa5", "#a33b5c", "#66708a")


def ordinal(n: int) -> str:
    return f"{n}{'th' if 10 <= n % 100 <= 20 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"


def question_title(q: Framed | Counted, jumpoff: int | None = None, label: Callable[[object], str] = str) -> str:
    """What a question asks, as a probability in words. The jump-off is always told: one question
    at two jump-offs is two figures."""
    years = lambda days: f"{days / DAYS_PER_YEAR:.0f}"
    start = "the jump-off" if jumpoff is None else f"age {years(jumpoff)}"
    given = f" | {q.given}" if q.given else ""
    span = years(q.frame.value)
    if isinstance(q, Counted):
        what = f"≥{q.min_events} {label(q.event)}"
        return f"P({what} within {span}y after {start}{given})" if q.frame.kind == "within" else f"P({what} after {start}, by age {span}{given})"
    what = f"{ordinal(q.timing.occurrence)} {label(q.timing.target)}"
    return {
        "within": f"P({what} within {span}y after {start}{given})", "by_age": f"P({what} by age {span}{given}) from {start}", "within_origin": f"P({what} within {span}y of its origin{given}) from {start}",
    }[q.frame.kind]


def _ticks(lo: float, hi: float, n: int = 5) -> list[float]:
    if not math.isfinite(lo) or not math.isfinite(hi) or hi <= lo:
        return [lo]
    raw = (hi - lo) / n
    step = 10 ** math.floor(math.log10(raw))
    step *= next(m for m in (1, 2, 5, 10) if m * step >= raw)
    first = math.ceil(lo / step)
    return [k * step for k in range(first, math.floor(hi / step) + 1)]


class Plot:
    """A plane with axes and a legend."""

    def __init__(self, title: str, x: str, y: str, xs: Sequence[float], ys: Sequence[float]):
        ok = lambda v: [float(a) for a in v if a is not None and math.isfinite(a)] or [0.0, 1.0]
        xs, ys = ok(xs), ok(ys)
        pad = lambda lo, hi: (lo, hi) if hi > lo else (lo - 0.5, hi + 0.5)
        (self.x0, self.x1), (self.y0, self.y1) = pad(min(xs), max(xs)), pad(min(ys), max(ys))
        self.parts, self.legend = [], []
        self.parts.append(f'<text x="{LEFT}" y="20" font-size="14">{html.escape(title)}</text>')
        for t in _ticks(self.x0, self.x1):
            self.parts.append(f'<line x1="{self.px(t):.1f}" y1="{TOP}" x2="{self.px(t):.1f}" y2="{HEIGHT - BOTTOM}" stroke="#e4e4e4"/><text x="{self.px(t):.1f}" y="{HEIGHT - BOTTOM + 15}" text-anchor="middle">{t:g}</text>')
        for t in _ticks(self.y0, self.y1):
            self.parts.append(f'<line x1="{LEFT}" y1="{self.py(t):.1f}" x2="{WIDTH - RIGHT}" y2="{self.py(t):.1f}" stroke="#e4e4e4"/><text x="{LEFT - 6}" y="{self.py(t) + 4:.1f}" text-anchor="end">{t:g}</text>')
        self.parts.append(f'<text x="{(LEFT + WIDTH - RIGHT) / 2}" y="{HEIGHT - 10}" text-anchor="middle">{html.escape(x)}</text><text x="14" y="{HEIGHT / 2}" transform="rotate(-90 14 {HEIGHT / 2})" text-anchor="middle">{html.escape(y)}</text>')

    def px(self, x: float) -> float:
        return LEFT + (x - self.x0) / (self.x1 - self.x0) * (WIDTH - LEFT - RIGHT)

    def py(self, y: float) -> float:
        return HEIGHT - BOTTOM - (y - self.y0) / (self.y1 - self.y0) * (HEIGHT - TOP - BOTTOM)

    def line(self, xs, ys, colour: str, name: str = "", step: bool = False, dash: bool = False) -> None:
        path, pen = [], False
        last = None
        for x, y in zip(xs, ys, strict=True):
            if x is None or y is None or not (math.isfinite(x) and math.isfinite(y)):
                pen = False
                continue
            if pen and step:
                path.append(f"L{self.px(x):.1f} {last:.1f}")
            last = self.py(y)
            path.append(f"{'L' if pen else 'M'}{self.px(x):.1f} {last:.1f}")
            pen = True
        self.parts.append(f'<path d="{" ".join(path)}" fill="none" stroke="{colour}" stroke-width="1.5"{" stroke-dasharray=\'4 3\'" if dash else ""}/>')
        if name:
            self.legend.append((name, colour))

    def band(self, xs, lo, hi, colour: str) -> None:
        pts = [(x, a, b) for x, a, b in zip(xs, lo, hi, strict=True) if all(v is not None and math.isfinite(v) for v in (x, a, b))]
        if pts:
            ring = [f"{self.px(x):.1f},{self.py(b):.1f}" for x, _, b in pts] + [f"{self.px(x):.1f},{self.py(a):.1f}" for x, a, _ in reversed(pts)]
            self.parts.append(f'<polygon points="{" ".join(ring)}" fill="{colour}" opacity="0.15"/>')

    def dots(self, xs, ys, colour: str, name: str = "") -> None:
        self.parts += [f'<circle cx="{self.px(x):.1f}" cy="{self.py(y):.1f}" r="3" fill="{colour}"/>' for x, y in zip(xs, ys, strict=True) if x is not None and y is not None and math.isfinite(x) and math.isfinite(y)]
        if name:
            self.legend.append((name, colour))

    def cell(self, x: float, y: float, w: float, h: float, colour: str, opacity: float = 1.0) -> None:
        self.parts.append(f'<rect x="{self.px(x):.1f}" y="{self.py(y + h):.1f}" width="{max(0.5, self.px(x + w) - self.px(x)):.1f}" height="{max(0.5, self.py(y) - self.py(y + h)):.1f}" fill="{colour}" opacity="{opacity:.3f}"/>')

    def hatched(self, x: float, y: float, w: float, h: float) -> None:
        """A withheld stretch."""
        x0, x1, y0, y1 = self.px(x), self.px(x + w), self.py(y + h), self.py(y)
        self.parts.append(f'<rect x="{x0:.1f}" y="{y0:.1f}" width="{max(0.5, x1 - x0):.1f}" height="{y1 - y0:.1f}" fill="#999" opacity="0.12"/>')
        marks = " ".join(f"M{x0 + d:.1f} {y1:.1f}L{min(x1, x0 + d + 8):.1f} {y0:.1f}" for d in range(0, max(1, int(x1 - x0)), 8))
        self.parts.append(f'<path d="{marks}" stroke="#999" stroke-width="0.5"/>')

    def note(self, text: str) -> None:
        self.parts.append(f'<text x="{LEFT}" y="{TOP - 4}" fill="#666">{html.escape(text)}</text>')

    def svg(self) -> str:
        keys = "".join(f'<rect x="{WIDTH - RIGHT + 12}" y="{TOP + 18 * k}" width="10" height="10" fill="{c}"/><text x="{WIDTH - RIGHT + 28}" y="{TOP + 9 + 18 * k}">{html.escape(n[:16])}</text>' for k, (n, c) in enumerate(self.legend[:14]))
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="11" fill="#222"><rect width="100%" height="100%" fill="#fff"/>{"".join(self.parts)}{keys}</svg>'


def _groups(df: pd.DataFrame, by: list[str]):
    by = [c for c in by if c in df.columns]
    if not by:
        yield "all", df
        return
    for key, part in df.groupby(by, dropna=False):
        yield ", ".join(f"{k:g}" if isinstance(k, float) else str(k) for k in (key if isinstance(key, tuple) else (key,))), part


def curves(df: pd.DataFrame, title: str, x: str, y: str, by: list[str], xlabel: str, ylabel: str, scale: float = 1.0, step: bool = False) -> str:
    """A line for each group, with its interval where the table has one."""
    df = df.sort_values(x)
    plot = Plot(title, xlabel, ylabel, df[x] / scale, [*df[y].dropna(), 0.0])
    for k, (name, part) in enumerate(_groups(df, by)):
        colour = COLOURS[k % len(COLOURS)]
        if {"ci_lo", "ci_hi"} <= set(df.columns):
            plot.band(part[x] / scale, part["ci_lo"], part["ci_hi"], colour)
        plot.line(part[x] / scale, part[y], colour, name, step)
    return plot.svg()


def reliability(df: pd.DataFrame, title: str, spikes: pd.DataFrame | None = None) -> str:
    """Bins as dots; below them how many people lie on each probability, withheld cells in grey."""
    plot = Plot(title, "predicted probability", "observed share", [0, 1], [0, 1])
    plot.line([0, 1], [0, 1], "#999", dash=True)
    if spikes is not None and spikes["n_persons"].notna().any():
        top = spikes["n_persons"].max()
        for x, n in zip(spikes["p_hat"], spikes["n_persons"], strict=True):
            if pd.isna(n):
                plot.cell(x - 0.003, 0, 0.006, 0.2 * min(1.0, MIN_CELL / top) if top else 0, "#999", 0.5)
            elif n:
                plot.cell(x - 0.003, 0, 0.006, 0.2 * n / top, COLOURS[0], 0.35)
    for k, (name, part) in enumerate(_groups(df, ["age_stop_years"])):
        part = part.sort_values("p_mean")
        plot.line(part["p_mean"], part["y_rate"], COLOURS[k % len(COLOURS)])
        plot.dots(part["p_mean"], part["y_rate"], COLOURS[k % len(COLOURS)], name)
        for lo, hi, v in zip(part["bin_left"], part["bin_right"], part["y_rate"], strict=True):
            if pd.isna(v):
                plot.hatched(lo, 0, hi - lo, 1)
    return plot.svg()


def overlay(mine: pd.DataFrame, truth: pd.DataFrame, title: str, x: str, y: str, seen: str, by: list[str], xlabel: str, ylabel: str, scale: float = 1.0, step: bool = False) -> str:
    """What was generated, by group with its interval, and over it what was observed, in black."""
    mine, truth = mine.sort_values(x), truth.sort_values(x)
    plot = Plot(title, xlabel, ylabel, [*(mine[x] / scale), *(truth[x] / scale)], [0.0, *mine[y].dropna(), *truth[seen].dropna()])
    for k, (name, part) in enumerate(_groups(mine, by)):
        colour = COLOURS[(k + 1) % len(COLOURS)]
        if {"ci_lo", "ci_hi"} <= set(mine.columns):
            plot.band(part[x] / scale, part["ci_lo"], part["ci_hi"], colour)
        plot.line(part[x] / scale, part[y], colour, f"generated {name}".replace(" all", ""), step)
        if "complete" in part.columns:  # cohorts whose lives are partly ahead
            open_ = part[~part["complete"].fillna(False).astype(bool)]
            plot.dots(open_[x] / scale, open_[y], "#fff")
    plot.line(truth[x] / scale, truth[seen], "#111", "observed", step)
    if not step:
        plot.dots(truth[x] / scale, truth[seen], "#111")
    return plot.svg()


def ridges(df: pd.DataFrame, title: str, xlabel: str) -> str:
    """A ridge of shares for each predicted bin, from early below to late above, with a tick at its
    median and a line at no error. Withheld cells leave gaps."""
    bins = sorted(df["pred_bin"].dropna().unique())
    plot = Plot(title, xlabel, "predicted age", [*(df["error_lo"] / DAYS_PER_YEAR), *(df["error_hi"] / DAYS_PER_YEAR)], [0, len(bins) + 0.5])
    for k, name in enumerate(bins):
        part = df[df["pred_bin"] == name].sort_values("error_lo")
        total = part["n_persons"].sum()
        if not total:
            continue
        share = part["n_persons"] / total
        height = 0.9 / max(share.max(), 1e-9)
        colour = COLOURS[k % len(COLOURS)]
        for a, b, v in zip(part["error_lo"], part["error_hi"], share, strict=True):
            if pd.notna(v):
                plot.cell(a / DAYS_PER_YEAR, k, (b - a) / DAYS_PER_YEAR, v * height, colour, 0.6)
        middle = part[share.fillna(0).cumsum() >= 0.5].iloc[0]
        at = (middle["error_lo"] + middle["error_hi"]) / 2 / DAYS_PER_YEAR
        plot.line([at, at], [k, k + 0.9], "#111")
        low = part["pred_lo"].iloc[0] / DAYS_PER_YEAR
        plot.legend.append((f"{low:.0f}-{part['pred_hi'].iloc[0] / DAYS_PER_YEAR:.0f}y, n={total:.0f}", colour))
    plot.line([0, 0], [0, len(bins) + 0.5], "#999", dash=True)
    gone, whole = df["n_excluded"].max(), df["n_trajectories"].max()
    if pd.notna(gone) and gone:
        plot.note(f"{gone:.0f} of {whole:.0f} trajectories have no event in the frame")
    return plot.svg()


def fan(df: pd.DataFrame, title: str, by: list[str]) -> str:
    """Mean quantiles of people's counts over jump-offs: outer and inner range, and the middle."""
    names = ["mean_q0", "mean_q25", "mean_q50", "mean_q75", "mean_q100"]
    df = df.assign(_x=df["age_stop"] / DAYS_PER_YEAR).sort_values("_x")
    plot = Plot(title, "jump-off age", "events ahead", df["_x"], [0.0, *df[names].to_numpy().ravel()])
    for k, (name, part) in enumerate(_groups(df, by)):
        colour = COLOURS[k % len(COLOURS)]
        plot.band(part["_x"], part["mean_q0"], part["mean_q100"], colour)
        plot.band(part["_x"], part["mean_q25"], part["mean_q75"], colour)
        plot.line(part["_x"], part["mean_q50"], colour, name)
        plot.dots(part["_x"], part["mean_q50"], colour)
    return plot.svg()


def inference_and_outcome(ccf: pd.DataFrame, parity: pd.DataFrame, title: str, level: float) -> str:
    """How well a cohort's mean is known, beside how far its people differ: the mean with its interval,
    and the shares of people by number of births as bars across."""
    z = z_of(level)
    ccf = ccf.dropna(subset=["ccf"]).sort_values("cohort")
    half = z * ccf["total_var"] ** 0.5
    gap = min((b - a for a, b in zip(sorted(ccf["cohort"]), sorted(ccf["cohort"])[1:], strict=False)), default=5)
    parity = parity[parity["cohort"].isin(set(ccf["cohort"]))].dropna(subset=["share"])
    plot = Plot(title, "cohort", "births", [*ccf["cohort"], *(ccf["cohort"] + gap)], [0.0, *(ccf["ccf"] + half).dropna(), *(parity["parity"] + 0.5)])
    for c, n, share in zip(parity["cohort"], parity["parity"], parity["share"], strict=True):
        plot.cell(c + 0.1 * gap, n - 0.4, 0.8 * gap * share, 0.8, "#999", 0.5)
    for c, m, h in zip(ccf["cohort"], ccf["ccf"], half, strict=True):
        if pd.notna(h):
            plot.line([c + gap / 2] * 2, [m - h, m + h], COLOURS[1])
        plot.dots([c + gap / 2], [m], COLOURS[1])
    plot.legend += [("mean, interval", COLOURS[1]), ("people", "#999")]
    spreads = []
    for _, part in parity.groupby("cohort"):
        w = part["share"] / part["share"].sum()
        mean = (w * part["parity"]).sum()
        spreads.append(((w * (part["parity"] - mean) ** 2).sum()) ** 0.5)
    if spreads and half.notna().any() and pd.Series(spreads).median():
        plot.note(f"half-width {half.median():.2g}, spread of people {pd.Series(spreads).median():.2g}: 1 to {pd.Series(spreads).median() / max(half.median(), 1e-12):.0f}")
    return plot.svg()


def columns(df: pd.DataFrame, title: str, x: str, y: str, width: float, xlabel: str, ylabel: str, scale: float = 1.0) -> str:
    df = df.dropna(subset=[x])
    plot = Plot(title, xlabel, ylabel, [*(df[x] / scale), *((df[x] / scale) + width)], [0.0, *df[y].dropna()])
    for a, b in zip(df[x] / scale, df[y], strict=True):
        if pd.notna(b):
            plot.cell(a, 0, width, b, COLOURS[0], 0.85)
        else:  # withheld: up to the largest count that is withheld
            plot.cell(a, 0, width, MIN_CELL if y.startswith("n_") else 0, "#999", 0.4)
    return plot.svg()


def heat(df: pd.DataFrame, title: str, x: str, y: str, value: str, w: float, h: float) -> str:
    top = df[value].quantile(0.98) if df[value].notna().any() else 1.0
    plot = Plot(title, x, y, [*df[x], *(df[x] + w)], [*df[y], *(df[y] + h)])
    for a, b, v, source in zip(df[x], df[y], df[value], df.get("source", pd.Series("observed", df.index)), strict=True):
        if pd.notna(v):
            plot.cell(a, b, w, h, COLOURS[0] if source == "observed" else COLOURS[1], min(1.0, 0.05 + 0.95 * v / top if top else 0.05))
    # The frontier: where a cell that was observed meets one that is forecast.
    known = {(a, b): s for a, b, s, v in zip(df[x], df[y], df.get("source", pd.Series("observed", df.index)), df[value], strict=True) if pd.notna(v)}
    for (a, b), s in known.items():
        if s == "observed" and known.get((a, b + h), s) != s:
            plot.line([a, a + w], [b + h, b + h], "#111")
        if s == "observed" and known.get((a + w, b), s) != s:
            plot.line([a + w, a + w], [b, b + h], "#111")
    plot.legend += [("observed", COLOURS[0]), ("forecast", COLOURS[1]), ("frontier", "#111"), (f"full: {top:.3g}", "#fff")]
    return plot.svg()


def figures_of(name: str, df: pd.DataFrame, cohort_width: int = 5) -> dict[str, Callable[[], str]]:
    """The figures of a published table by name; none for tables that have none."""
    out: dict[str, Callable[[], str]] = {}
    each = lambda by: ((key, part) for key, part in _groups(df, by))
    slug = lambda *parts: "_".join(str(p).replace(".", "p").replace(", ", "_").replace(" ", "") for p in parts if p)
    if df.empty:
        return out
    if name in ("km_pooled", "km_by_seed"):
        for key, part in each(["outcome"]):
            out[slug(name, key)] = lambda part=part, key=key: curves(part, f"Survival: {key}", "time", "survival", ["age_stop_years", "seed"] if name == "km_by_seed" else ["age_stop_years"], "years", "share without event", DAYS_PER_YEAR, True)
    elif name.startswith("km_"):
        by = [c for c in df.columns if c not in ("model", "time", "n_at_risk", "n_events", "survival", "greenwood_var", "ci_lo", "ci_hi", "n_persons", "suppressed")]
        out[name] = lambda: curves(df, f"Survival: {name[3:]}", "time", "survival", by, "years", "share without event", DAYS_PER_YEAR, True)
    elif name in ("asfr_cohort", "asfr_pooled"):
        for key, part in each(["age_stop_years"] if name == "asfr_pooled" else []):
            out[slug(name, key)] = lambda part=part: curves(part, "Age-specific rates by cohort", "age_bin", "asfr", ["cohort"], "age", "births a person-year")
    elif name in ("ccf", "ccf_variance"):
        out[name] = lambda: curves(df.assign(ci_lo=df["ccf"] - 1.96 * df["total_var"] ** 0.5, ci_hi=df["ccf"] + 1.96 * df["total_var"] ** 0.5), "Completed cohort fertility", "cohort", "ccf", ["age_stop_years"], "cohort", "births a person")
    elif name == "parity_distribution":
        for key, part in each(["age_stop_years", "cohort"]):
            out[slug(name, key)] = lambda part=part, key=key: columns(part, f"Parity: {key}", "parity", "share", 0.8, "births", "share of people")
    elif name in ("ppr", "ppr_pooled"):
        out[name] = lambda: curves(df, "Parity progression", "parity_from", "ppr", ["age_stop_years"], "births so far", "share that has another")
    elif name == "p_hat_distribution":
        for key, part in each(["outcome", "condition", "age_stop_years"]):
            out[slug(name, key)] = lambda part=part, key=key: columns(part, f"Probabilities: {key}", "p_hat", "n_persons", 0.02, "probability", "people")
    elif name == "timing_error":
        for key, part in each(["outcome", "condition", "age_stop_years"]):
            out[slug(name, key)] = lambda part=part, key=key: ridges(part, f"Timing error: {key}", "years later than predicted")
    elif name.startswith("within_seed_quantile_summary"):
        by = [c for c in df.columns if c not in ("model", "age_stop", "n_persons", "mean_k", "suppressed") and not c.startswith("mean_q")]
        out[name.replace("summary", "fan")] = lambda: fan(df, "Counts over replicates", by)
    elif name == "lexis_cohort_combined":
        out[name] = lambda: heat(df, "Rates by cohort and age", "cohort", "age_bin", "rate", cohort_width, 1.0)
    elif name.startswith("within_seed_variance_distribution"):
        for key, part in each([c for c in df.columns if c not in ("model", "bin", "bin_lo", "bin_hi", "n_persons", "n_group", "suppressed")]):
            width = float((part["bin_hi"] - part["bin_lo"]).iloc[0])
            out[slug(name, key)] = lambda part=part, key=key, width=width: columns(part, f"Variance over replicates: {key}", "bin_lo", "n_persons", width, "variance", "people")
    elif name == "event_age_distribution":
        for key, part in each(["alias"]):
            whole = part[part["cohort"].isna()] if "cohort" in part.columns else part
            out[slug(name, key)] = lambda part=whole, key=key: curves(part, f"Rate by age: {key}", "age_bin", "rate", ["source", "age_stop"], "age", "events a person-year")
    elif name == "token_frequency":
        whole = df[df["cohort"].isna()].reset_index(drop=True) if "cohort" in df.columns else df
        out[name] = lambda: columns(whole.assign(_x=range(len(whole))), "Sequences with a token", "_x", "share_with_any", 0.8, ", ".join(dict.fromkeys(whole["alias"]))[:60], "share")
    return out


def figures_between(tables: dict[str, pd.DataFrame], level: float = 0.95, titles: dict[tuple[str, str], str] | None = None) -> dict[str, Callable[[], str]]:
    """The figures that need several tables of an arm: what was generated against what was observed.
    titles: what an (outcome, condition) asks, in words."""
    out: dict[str, Callable[[], str]] = {}
    has = lambda *names: all(n in tables and not tables[n].empty for n in names)
    slug = lambda *parts: "_".join(f"{p:g}" if isinstance(p, float) else str(p) for p in parts if p not in ("", "-")).replace(".", "p").replace(" ", "")
    windows = lambda df: df.groupby("age_stop_years") if "age_stop_years" in df.columns else ()
    if has("calibration"):
        spikes = tables.get("p_hat_distribution")
        for (outcome, condition), part in tables["calibration"].groupby(["outcome", "condition"]):
            title = (titles or {}).get((outcome, condition), f"{outcome} {condition}".removesuffix(" -"))
            for age, one in windows(part):
                own = spikes[(spikes["outcome"] == outcome) & (spikes["condition"] == condition) & (spikes["age_stop_years"] == age)] if spikes is not None else None
                out[slug("reliability", outcome, condition, age)] = lambda one=one, own=own, t=title, age=age: reliability(one, f"{t}, from age {age:g}", own)
            out[slug("calibration", outcome, condition)] = lambda part=part, t=title: reliability(part, t)
    if has("km_observed", "km_pooled"):
        for outcome, mine in tables["km_pooled"].groupby("outcome"):
            truth = tables["km_observed"][tables["km_observed"]["outcome"] == outcome]
            draw = lambda mine, truth, title: overlay(mine, truth, title, "time", "survival", "survival", ["age_stop_years"], "years", "share without event", DAYS_PER_YEAR, True)
            out[slug("km_overlay", outcome, "all")] = lambda mine=mine, truth=truth, o=outcome, draw=draw: draw(mine, truth, f"Survival, all jump-offs: {o}")
            for age, one in windows(mine):
                out[slug("km_overlay", outcome, age)] = lambda one=one, truth=truth, o=outcome, age=age, draw=draw: draw(one, truth, f"Survival: {o}, from age {age:g}")
    errors = tables.get("aggregate_error")
    if errors is not None and not errors.empty:
        z = z_of(level)
        for target, table, x, y in (("ccf", "ccf_variance", "cohort", "ccf"), ("ppr", "ppr_pooled", "parity_from", "ppr"), ("asfr_cohort", "asfr_pooled", "age_bin", "asfr")):
            if not has(table):
                continue
            seen = errors[errors["target"] == target]
            mine = tables[table]
            if target == "ccf":  # a withheld variance has no band, and none is made up for it
                half = z * mine["total_var"] ** 0.5
                mine = mine.assign(ci_lo=mine["ccf"] - half, ci_hi=mine["ccf"] + half)
            label = {"ccf": ("cohort", "births a person"), "ppr": ("births so far", "share that has another"), "asfr_cohort": ("age", "births a person-year")}[target]
            parts = [("", mine, seen)] if target != "asfr_cohort" else [(f"{c:g}" if isinstance(c, float) else c, mine[mine["cohort"] == c], seen[seen["cohort"] == c]) for c in sorted(mine["cohort"].dropna().unique())]
            for key, own, truth in parts:
                once = truth.drop_duplicates(x)
                name = f"{target} {key}".strip()
                out[slug(f"{target}_overlay", key, "all")] = lambda own=own, once=once, n=name, a=(x, y), l=label: overlay(own, once, f"Generated and observed: {n}", *a, "obs", ["age_stop_years"], *l)
                for age, one in windows(own):
                    out[slug(f"{target}_overlay", key, age)] = lambda one=one, once=once, n=name, age=age, a=(x, y), l=label: overlay(one, once, f"Generated and observed: {n}, from age {age:g}", *a, "obs", [], *l)
    if has("ccf_variance", "parity_distribution"):
        for age, one in windows(tables["ccf_variance"]):
            parity = tables["parity_distribution"]
            own = parity[parity["age_stop_years"] == age]
            out[slug("ccf_inference_vs_outcome", age)] = lambda one=one, own=own, age=age: inference_and_outcome(one, own, f"Cohort means and people, from age {age:g}", level)
    elif has("ccf", "parity_distribution"):
        out["ccf_inference_vs_outcome"] = lambda: inference_and_outcome(tables["ccf"], tables["parity_distribution"], "Cohort means and people", level)
    return out
