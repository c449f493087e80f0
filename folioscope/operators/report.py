"""Reports from small result tables."""

from __future__ import annotations

from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from folioscope.operators import evals

#: Characters of a label, runs in the chart.
LABEL, RUNS = 55, 18


def short_label(text: str) -> str:
    return text if len(text) <= LABEL else text[:LABEL] + "..."


def bar_chart(title: str, bars: Iterable[tuple[str, float]], width: int = 640) -> str:
    """Horizontal bars from 0 to 1 as SVG."""
    rows = list(bars)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{40 + 24 * len(rows)}">', f'<text x="8" y="20">{escape(title)}</text>']
    for i, (label, value) in enumerate(rows):
        size = min(1.0, max(0.0, value)) * (width - 420)
        y = 32 + 24 * i
        out += [f'<text x="8" y="{y + 14}">{escape(short_label(label))}</text>', f'<rect x="360" y="{y}" width="{size:.1f}" height="16"/>', f'<text x="{366 + size:.1f}" y="{y + 14}">{value:.4f}</text>']
    return "\n".join([*out, "</svg>"])


def mean_chart(runs: DataFrame) -> str:
    """The last runs' means; the rows are bounded by the top-k."""
    return bar_chart("Mean score", [(f"{r['run_id']} {r['kind']}", r["mean_blended"] or 0.0) for r in evals.recent(runs, RUNS).collect()])


def delta_table(deltas: DataFrame) -> str:
    """A Markdown table of (doc_name, old, new, delta, pos) with the mean."""
    rows = deltas.orderBy("pos").collect()  # a run's documents
    if not rows:
        return "No documents in both runs."
    lines = ["| Document | Old | New | Delta |", "| --- | ---: | ---: | ---: |"]
    lines += [f"| {r['doc_name']} | {r['old']:.4f} | {r['new']:.4f} | {r['delta']:+.4f} |" for r in rows]
    return "\n".join([*lines, f"| **Mean** | | | {sum(r['delta'] for r in rows) / len(rows):+.4f} |"])


def markdown(runs: DataFrame, scores: DataFrame) -> str:
    """The report: how many runs there are, the latest of each kind and its gain over the latest and
    the best standard runs."""
    latest = {r["kind"]: r["run_id"] for r in evals.latest_run(runs, ["kind"]).collect()}  # three kinds
    pick = lambda kind: scores.where((scores["run_id"] == latest[kind]) & (scores["kind"] == kind))
    parts = ["# Evaluation report", f"{runs.count()} runs."]
    for kind in sorted(latest):
        parts.append(f"## Latest {kind} run: {latest[kind]}")
        if kind != "standard" and "standard" in latest:
            parts += ["Against the latest standard run:", delta_table(evals.paired_deltas(pick("standard"), pick(kind))), "Against the best standard runs:", delta_table(evals.against_best(pick(kind), scores))]
    return "\n\n".join(parts)
