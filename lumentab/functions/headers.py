"""Header names of saved-answer files and the fields they stand for."""

from __future__ import annotations

import re

# The accepted header names of each field, compared without case, with _ as a blank.
ALIASES: dict[str, list[str]] = {
    "question": ["question", "prompt", "query", "user prompt", "שאלה"],
    "expected_answer": ["expected answer", "reference answer", "gold answer", "expected", "תשובה צפויה"],
    "answer": ["answer", "response", "chatbot answer", "model answer", "bot response", "תשובה מהמודל"],
    "source": ["source", "sources", "evidence", "context", "retrieved context", "retrieved chunks", "מקור"],
    "id": ["id", "question id", "external id", "messageid", "message id"],
    "topic": ["topic", "category", "נושא"],
    "answerable": ["answerable", "is answerable"],
    "error": ["error", "exception", "failure"],
    "expected_behavior": ["expected behavior", "target behavior"],
    "question_form": ["question form", "form"],
    "parent_question_id": ["parent question id", "parent id", "source question id"],
    "question_type": ["question type", "type", "kind"],
    "difficulty": ["difficulty", "complexity"],
    "reference_claims": ["reference claims", "gold claims", "required claims"],
    "supporting_quotes": ["supporting quotes", "evidence quotes"],
    "reference_sources": ["reference sources", "reference sources json", "gold sources", "gold evidence", "sources json"],
}
FIELDS = list(ALIASES)
REQUIRED = ("question", "expected_answer", "answer")
_FIELD_OF = {name: field for field, names in ALIASES.items() for name in names}


def normalize_header(name: str) -> str:
    return re.sub(r"\s+", " ", name.replace("_", " ").strip().casefold())


def field_of(name: str) -> str | None:
    return _FIELD_OF.get(normalize_header(name))


def resolve_headers(names: list[str], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """field -> column for the columns of a file.

    Blank or repeated headers, two columns for one field and a missing required field are errors.
    """
    keys = [normalize_header(n or "") for n in names]
    if not keys or "" in keys:
        raise ValueError("blank column header")
    if len(set(keys)) < len(keys):
        raise ValueError("repeated column header")
    found: dict[str, str] = {}
    for field, column in (overrides or {}).items():
        if column not in names:
            raise ValueError(f"no column {column!r}")
        found[field] = column
    for name in names:
        field = field_of(name)
        if field is None or field in (overrides or {}):
            continue
        if field in found:
            raise ValueError(f"columns {found[field]!r} and {name!r} both stand for {field}")
        found[field] = name
    if lacking := [f for f in REQUIRED if f not in found]:
        raise ValueError(f"no column for {', '.join(lacking)}")
    return found
