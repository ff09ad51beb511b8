"""Personas: covering arrays over condition values, constraint repair, pair coverage."""

from __future__ import annotations

import hashlib
import itertools
import json
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covering_rows(dimensions: dict[str, list], strength: int = 2, seed: int = 1, most: int = 200) -> list[dict]:
    """Rows that hold every combination of values of any `strength` dimensions, greedily, seeded; at most `most` of them.

    The schema's condition dimensions are few, and the search is sequential by nature, so that it runs on the driver.
    """
    names = list(dimensions)
    rng = random.Random(seed)
    strength = min(strength, len(names))
    todo = {tuple(zip(c, vs)) for c in itertools.combinations(names, strength) for vs in itertools.product(*[dimensions[n] for n in c])}
    out: list[dict] = []
    while todo and len(out) < most:
        best, gain = None, -1
        for start in rng.sample(sorted(todo, key=repr), min(12, len(todo))):
            row = dict(start)
            for n in rng.sample(names, len(names)):
                if n not in row:
                    row[n] = max(dimensions[n], key=lambda v, n=n, row=row: sum(all((row | {n: v}).get(k) == x for k, x in t) for t in todo if any(k == n for k, _ in t)))
            covered = sum(all(row.get(k) == x for k, x in t) for t in todo)
            if covered > gain:
                best, gain = row, covered
        out.append({n: best[n] for n in names})
        todo = {t for t in todo if not all(best.get(k) == x for k, x in t)}
    return out


def persona_id(profile: dict) -> str:
    return "P" + hashlib.sha256(json.dumps(profile, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:10]


def repair(profile: dict, counts: list[tuple[str, str]] = (), gaps: list[tuple[str, str, int]] = (), pinned: set[str] = frozenset()) -> dict:
    """A profile with its constraints met: a count equals the entries of a list (the pinned side decides), and a later date is
    at least so many days after an earlier one."""
    import datetime

    p = dict(profile)
    for count, entries in counts:
        if count not in p or entries not in p:
            continue
        if count in pinned and entries not in pinned:
            have = list(p[entries])[: int(p[count])]
            p[entries] = have + [f"{entries} {i + 1}" for i in range(len(have), int(p[count]))]
        else:
            p[count] = len(p[entries])
    for early, late, days in gaps:
        if early in p and late in p:
            a, b = (datetime.date.fromisoformat(str(p[k])) for k in (early, late))
            if (b - a).days < days:
                if late in pinned and early not in pinned:
                    p[early] = (b - datetime.timedelta(days)).isoformat()
                else:
                    p[late] = (a + datetime.timedelta(days)).isoformat()
    return p


def pair_coverage(facts: DataFrame, domain: DataFrame) -> DataFrame:
    """(pairs, covered): value pairs of different dimensions, and those some persona holds; facts is (person, key, value), domain
    (key, value). The domain is the schema's, bounded; the facts meet it by an aggregate of their own pairs."""
    a, b = domain.toDF("ka", "va"), domain.toDF("kb", "vb")
    pairs = a.join(b, F.col("ka") < F.col("kb"))
    one = facts.groupBy("person").agg(F.array_sort(F.collect_set(F.struct("key", "value"))).alias("l"))
    mine = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.struct(x["key"].alias("ka"), x["value"].alias("va"), y["key"].alias("kb"), y["value"].alias("vb")))))
    seen = one.select(F.explode(mine).alias("x")).select("x.*").distinct().withColumn("hit", F.lit(True))
    return pairs.join(seen, ["ka", "va", "kb", "vb"], "left").agg(F.count("*").alias("pairs"), F.count("hit").alias("covered"))


def rule_personas(predicates: list[tuple[str, str, str, list]], base: dict, domain: dict[str, list]) -> list[tuple[str, dict]]:
    """(role, profile) that satisfy, violate, miss and border one rule; predicates are (key, kind, op, values)."""
    out = []
    good = dict(base)
    for key, kind, op, values in predicates:
        v = values[0]
        if kind == "number":
            good[key] = {"eq": v, "lte": v, "gte": v, "lt": v - 1, "gt": v + 1, "ne": v + 1}[op]
        elif op in ("eq", "in"):
            good[key] = v
        else:
            good[key] = next((x for x in domain.get(key, []) if x not in values), None)
    out.append(("satisfy", good))
    for key, kind, op, values in predicates:
        bad = dict(good)
        if kind == "number":
            v = values[0]
            bad[key] = {"eq": v + 1, "lte": v + 1, "gte": v - 1, "lt": v, "gt": v, "ne": v}[op]
            out.append(("boundary", bad))
        else:
            bad[key] = next((x for x in domain.get(key, []) if (x in values) == (op in ("ne", "not_in"))), None)
            out.append(("violate", bad))
        out.append(("missing", {k: x for k, x in good.items() if k != key}))
    return out
