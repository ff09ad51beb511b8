"""Reports of a run: a JSON summary and an HTML page, from metrics that Spark has aggregated."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare, metrics
from .records import write_text

# Names of the outcomes in a report.
LABELS = {
    "correct_answer": "Correct", "partial_too_little": "Partial: too little", "partial_too_much": "Partial: too much", "unrelated_answer": "Unrelated", "misleading_hallucination": "Misleading",
    "correct_abstention": "Rightly declined", "incorrect_abstention": "Wrongly declined", "should_have_abstained": "Should have declined", "correct_clarification": "Rightly asked back",
    "missing_clarification": "Should have asked back", "chatbot_error": "Chatbot error", "judge_error": "Judge error",
}


def percent(x: float | None) -> str:
    return "not available" if x is None else f"{100 * x:.1f} %"


def build_report(current: DataFrame, previous: DataFrame | None = None) -> dict:
    """Everything a report shows; only aggregates come to the driver."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    out = {
        "summary": rows(metrics.run_summary(current).orderBy("entry")),
        "claims": rows(metrics.claim_metrics(current).orderBy("metric")),
        "topics": rows(metrics.topic_breakdown(current).orderBy(F.desc("total"), "topic")),
        "outcomes": rows(metrics.outcome_histogram(current).orderBy("scope", "outcome")),
        "forms": rows(metrics.by_form(current).orderBy("question_form")),
    }
    if previous is not None:
        out["comparison"] = rows(compare.comparison_metrics(previous, current).orderBy("metric"))
        out["transitions"] = rows(compare.state_transitions(previous, current).orderBy("transition"))
    return out


def _table(rows: list[dict]) -> str:
    if not rows:
        return "<p>No rows.</p>"
    show = lambda k, v: percent(v) if k.endswith("rate") or k in ("low", "high") else LABELS.get(v, v) if isinstance(v, str) else "" if v is None else v
    head = "".join(f"<th>{html.escape(k)}</th>" for k in rows[0])
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(show(k, v)))}</td>" for k, v in r.items()) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def report_html(report: dict, title: str = "Evaluation", direction: str = "ltr") -> str:
    parts = "".join(f"<section><h2>{html.escape(k.capitalize())}</h2>{_table(v)}</section>" for k, v in report.items())
    search = "<input id=q placeholder=filter oninput=\"for(const r of document.querySelectorAll('tbody tr'))r.hidden=!r.textContent.toLowerCase().includes(this.value.toLowerCase())\">"
    return f"<!doctype html><html dir={direction}><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{search}{parts}</html>"


def write_report(folder: str, current: DataFrame, previous: DataFrame | None = None, title: str = "Evaluation", direction: str = "ltr") -> dict:
    report = build_report(current, previous)
    write_text(f"{folder}/summary.json", json.dumps(report, ensure_ascii=False, indent=2, default=str))
    write_text(f"{folder}/report.html", report_html(report, title, direction))
    return report
