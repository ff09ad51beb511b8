"""Settings of a run from TOML, all faults told at once."""

from __future__ import annotations

import dataclasses
import tomllib
from pathlib import Path


@dataclasses.dataclass(frozen=True)
class Options:
    chunk_chars: int = 1200
    overlap_chars: int = 150
    min_shared_entities: int = 2
    keyphrase_threshold: float = 0.5
    max_topics: int = 30
    max_cluster_size: int = 40
    coverage: float = 0.35
    max_coverage: float = 0.8
    claims_per_question: float = 3.2
    margin: float = 0.2
    dedup_threshold: float = 0.78
    top_k: int = 10
    seed: int = 7
    canonical_scoring: str = "exclude"
    second_vote: str = "harsher"


# What each number may be: least and most.
RANGES = {
    "chunk_chars": (100, 100_000), "overlap_chars": (0, 50_000), "min_shared_entities": (1, 100), "keyphrase_threshold": (0, 1), "max_topics": (1, 1000), "max_cluster_size": (1, 10_000),
    "coverage": (0, 1), "max_coverage": (0, 1), "claims_per_question": (0.1, 100), "margin": (0, 1), "dedup_threshold": (0, 1), "top_k": (1, 10_000),
}
CHOICES = {"canonical_scoring": ("exclude", "include"), "second_vote": ("off", "harsher", "lenient")}


def faults(o: Options) -> list[str]:
    out = [f"{k} must be from {a} to {b}" for k, (a, b) in RANGES.items() if not a <= getattr(o, k) <= b]
    out += [f"{k} must be one of {', '.join(c)}" for k, c in CHOICES.items() if getattr(o, k) not in c]
    if o.overlap_chars >= o.chunk_chars:
        out.append("overlap_chars must be below chunk_chars")
    if o.coverage > o.max_coverage:
        out.append("coverage must not be above max_coverage")
    return out


def load_options(path: str | None = None, **overrides) -> Options:
    data = tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    flat = {k: v for section in data.values() if isinstance(section, dict) for k, v in section.items()} | {k: v for k, v in data.items() if not isinstance(v, dict)} | overrides
    known = {f.name: f.type for f in dataclasses.fields(Options)}
    wrong = [f"unknown setting {k}" for k in flat if k not in known]
    made = {}
    for k, v in flat.items():
        if k in known:
            kind = {"int": int, "float": (int, float), "str": str}[known[k]]
            if isinstance(v, bool) or not isinstance(v, kind):
                wrong.append(f"{k} must be {known[k]}")
            else:
                made[k] = v
    o = Options(**made)
    if wrong := wrong + faults(o):
        raise ValueError("; ".join(wrong))
    return o
