"""Markdown reports over small result tables. A table is collected only up to its row limit."""
from __future__ import annotations

from pyspark.sql import DataFrame

MAX_ROWS = 200


def cell(v) -> str:
    if v is None:
        return "-"
    if isinstance(v, bool):
        return "yes" if v else "no"
    if isinstance(v, float):
        return f"{v:.4f}"
    return str(v).replace("|", "\\|").replace("\n", " ")


def table(df: DataFrame, limit: int = MAX_ROWS) -> str:
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |"
    return "\n".join([head, "|" + " --- |" * len(df.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)])


def percent(k: float, n: float) -> str:
    return f"{k}/{n} = {100 * k / n:.1f}%" if n else "0/0"


def report(title: str, sections: list[tuple[str, DataFrame]], limit: int = MAX_ROWS) -> str:
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{table(df, limit)}" for name, df in sections)]) + "\n"


def evaluation(summary: DataFrame) -> str:
    """A line for each proportion of evaluate()'s row, with its interval."""
    r = summary.first().asDict()
    names = [k.removesuffix("_rate") for k in r if k.endswith("_rate")]
    lines = [f"- {n.replace('_', ' ')}: {100 * r[n + '_rate']:.1f}% [{100 * r[n + '_low']:.1f}, {100 * r[n + '_high']:.1f}]" for n in names]
    return "\n".join(["# Selection", "", f"Problems: {r['problems']}; accepted {r['accepted']}, abstained {r['abstained']}.", "", *lines]) + "\n"


def comparison(paired: DataFrame, a: str, b: str) -> str:
    r = paired.first()
    return f"# {a} and {b}\n\nBoth correct {r['both_correct']}, only {a} {r['a_only']}, only {b} {r['b_only']}, neither {r['neither']}; difference {100 * r['b_minus_a']:+.1f} points, exact sign test p = {r['p_value']:.6g}.\n"


def ab_metrics(metrics: DataFrame, a: str, b: str) -> str:
    """The A/B report over evaluation.ab_metrics(): one table row for each method, and the difference."""
    r = metrics.first()
    num = lambda x, form="{:.1f}": "-" if x is None else form.format(x)
    lines = [f"# {a} and {b}", "", f"{r['problems']} problems, {r['with_any']} with a correct candidate; {r['total_pairs']} pairs of candidates, {num(r['candidates_per_problem'])} candidates a problem.", "",
             "| method | selected correct (%) | given any correct (%) | seconds |", "|-|-|-|-|"]
    for side, name in (("a", a), ("b", b)):
        lines.append(f"| {name} | {num(r[f'{side}_pct'])} | {num(r[f'{side}_given_any_pct'])} | {num(r[f'{side}_seconds'], '{:.3f}')} |")
    lines += ["", "| difference | points |", "|-|-|", f"| {b} minus {a}, selected correct | {r['b_minus_a_pct']:+.1f} |", f"| {b} minus {a}, given any | {r['b_minus_a_given_any_pct']:+.1f} |"]
    return "\n".join(lines) + "\n"


def results(metrics: DataFrame, wins: dict[tuple[str, str], DataFrame], title: str = "Results") -> str:
    """The results report: (method, problems, n_correct, n_any, n_correct_any) rows against the oracle's ceiling, and paired wins."""
    rows = metrics.orderBy("method").collect()
    lines = [f"# {title}", ""]
    if rows:
        r = rows[0]
        lines += [f"Oracle ceiling (any correct): {100 * r['n_any'] / max(1, r['problems']):.1f}% ({r['n_any']}/{r['problems']})", ""]
    lines += ["| method | selected correct (%) | given any correct (%) | problems |", "|-|-|-|-|"]
    lines += [f"| {r['method']} | {100 * r['n_correct'] / max(1, r['problems']):.1f} | {100 * r['n_correct_any'] / max(1, r['n_any']):.1f} | {r['problems']} |" for r in rows]
    for (x, y), df in wins.items():
        w = df.first()
        lines += ["", f"Paired wins: {x} against {y} = {w['wins']}/{w['losses']}/{w['ties']} (n={w['wins'] + w['losses'] + w['ties']})"]
    return "\n".join(lines) + "\n"


def leaderboard(summary: DataFrame, frontier: DataFrame, matrix: DataFrame, cases: DataFrame) -> str:
    return report("Leaderboard", [("Methods", summary.orderBy("place")), ("Coverage and accuracy frontier", frontier.orderBy("coverage")), ("Pairs", matrix.orderBy("a", "b")), ("Disagreements", cases.orderBy("method", "place"))])


def diagnostics(metrics: DataFrame, buckets: DataFrame, misses: DataFrame) -> str:
    return report("Ranking", [("Metrics", metrics), ("Rank of the best correct candidate where missed", buckets), ("Largest gaps", misses.orderBy("gap", ascending=False).limit(15))])


def calibration(losses: DataFrame, reliability: DataFrame, thresholds: DataFrame) -> str:
    return report("Calibration", [("Losses", losses), ("Reliability", reliability.orderBy("bin")), ("Thresholds", thresholds)])


def selective(coverage: DataFrame, best: DataFrame, errors: DataFrame) -> str:
    return report("Risk and coverage", [("Coverage", coverage.orderBy("target")), ("Best prefix", best), ("Confident errors", errors)])


def thresholds(recommendations: DataFrame) -> str:
    return report("Certified thresholds", [("Targets", recommendations.orderBy("target"))])


def stability(summary: DataFrame, folds: DataFrame) -> str:
    return report("Leave-one-out stability", [("Summary", summary), ("Folds", folds.orderBy("loo_threshold", "omitted").limit(15))])


def confidence_audit(signals: DataFrame, best: DataFrame) -> str:
    return report("Confidence signals", [("Ranking quality", signals), ("Best signal by coverage", best.orderBy("target"))])


def abstention(applied: DataFrame) -> str:
    return report("Abstention", [("Policy", applied)])


def casebook(cases: DataFrame) -> str:
    from pyspark.sql import functions as F

    return report("Cases", [("Kinds", cases.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy("kind")), ("Nearest to the threshold", cases.orderBy(F.abs("distance"), "problem_id").select("problem_id", "kind", "confidence", "distance").limit(15))])
