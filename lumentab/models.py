"""Model calls: one function behind a protocol, a deterministic stub as the default, retries, batches and caches."""

from __future__ import annotations

import hashlib
import datetime
import json
import math
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from email.utils import parsedate_to_datetime
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class StructuredModel(Protocol):
    def generate(self, prompt: str, schema: dict) -> dict: ...


class StubModel:
    """Answers from a hash of the prompt: the same on every run and machine."""

    def generate(self, prompt: str, schema: dict) -> dict:
        h = hashlib.sha256(prompt.encode()).digest()

        def value(kind: str, i: int):
            if kind == "boolean":
                return h[i % 32] % 2 == 0
            if kind == "integer":
                return h[i % 32] % 5
            if kind == "number":
                return h[i % 32] / 255
            if kind == "array":
                return []
            return f"{kind}-{h[:4].hex()}"

        return {k: value(v.get("type", "string"), i) for i, (k, v) in enumerate(schema.get("properties", {}).items())}


# What a status means for a retry.
CATEGORIES = ((400, "bad_request"), (401, "unauthorized"), (403, "forbidden"), (404, "not_found"), (408, "timeout"), (429, "rate_limited"))


def status_category(status: int) -> str:
    for code, name in CATEGORIES:
        if status == code:
            return name
    return "server_error" if status >= 500 else "client_error" if status >= 400 else "ok"


def may_retry(status: int) -> bool:
    return status in (408, 409, 425, 429) or status >= 500


def retry_delay(attempt: int, retry_after: str | None = None, base: float = 1.0, cap: float = 60.0, jitter: Callable[[], float] = random.random) -> float:
    """What the server asks for, in seconds or as a date, where that is a finite time to come; else base doubled with each
    attempt and up to a quarter more. Never above cap."""
    asked = math.nan
    if retry_after is not None:
        try:
            asked = float(retry_after)
        except (TypeError, ValueError):
            try:
                at = parsedate_to_datetime(retry_after)
                asked = (at if at.tzinfo else at.replace(tzinfo=datetime.timezone.utc)).timestamp() - time.time()
            except (TypeError, ValueError, OverflowError):
                pass
    if math.isfinite(asked) and asked >= 0:
        return min(cap, asked)
    wait = min(cap, base * 2 ** min(attempt, 100))
    return min(cap, wait * (1 + 0.25 * jitter()))


class HttpModel:
    """An OpenAI-compatible endpoint, built in each worker; the key is read there and never travels."""

    def __init__(self, url: str, model: str, key: Callable[[], str], attempts: int = 4, timeout: float = 60.0):
        self.url, self.model, self.key, self.attempts, self.timeout = url.rstrip("/"), model, key, attempts, timeout

    def post(self, path: str, body: dict) -> dict:
        data = json.dumps(body).encode()
        for attempt in range(self.attempts):
            try:
                request = urllib.request.Request(f"{self.url}{path}", data, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key()}"})
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return json.loads(r.read())
            except urllib.error.HTTPError as e:
                if not may_retry(e.code) or attempt + 1 == self.attempts:
                    raise RuntimeError(status_category(e.code)) from e
                time.sleep(retry_delay(attempt, e.headers.get("Retry-After")))
            except OSError as e:
                if attempt + 1 == self.attempts:
                    raise RuntimeError("connection") from e
                time.sleep(retry_delay(attempt))
        raise RuntimeError("no attempt")

    def generate(self, prompt: str, schema: dict, required: dict[str, int] | None = None) -> dict:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "response_format": {"type": "json_schema", "json_schema": {"name": "answer", "schema": with_required(schema, required)}}}
        text = self.post("/chat/completions", body)["choices"][0]["message"]["content"].strip()
        return json.loads(text.removeprefix("```json").removeprefix("```").removesuffix("```"))


def with_required(schema: dict, fields: dict[str, int] | None) -> dict:
    """The schema with these of its properties required, arrays among them with so many items at least; the given one stays."""
    if not fields:
        return schema
    known = {f: n for f, n in fields.items() if f in schema.get("properties", {})}
    properties = {k: v | {"minItems": max(known[k], v.get("minItems", 0))} if known.get(k, 0) > 0 and v.get("type") == "array" else v for k, v in schema.get("properties", {}).items()}
    before = list(schema.get("required", []))
    return schema | {"properties": properties, "required": before + [f for f in known if f not in before]}


def structured_calls(df: DataFrame, key: str, prompt: str, schema: dict, build: Callable[[], StructuredModel] = StubModel) -> DataFrame:
    """(key, response, error): one call for each row, the client built once in each task; a failed call is a row with its error."""
    kind = dict(df.dtypes)[key]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = build()
        for b in batches:
            out = []
            for k, p in zip(b[key], b["_prompt"]):
                try:
                    out.append((k, json.dumps(model.generate(p, schema), ensure_ascii=False, sort_keys=True), None))
                except Exception as e:  # told in the row
                    out.append((k, None, f"{type(e).__name__}: {e}"[:240]))
            yield pd.DataFrame(out, columns=[key, "response", "error"])

    return df.select(key, F.col(prompt).alias("_prompt")).mapInPandas(call, f"`{key}` {kind}, response string, error string")


def cached_calls(df: DataFrame, key: str, prompt: str, schema: dict, cache: DataFrame, build: Callable[[], StructuredModel] = StubModel) -> tuple[DataFrame, DataFrame]:
    """(rows with responses, new cache entries): each distinct prompt that isn't cached is asked once; errors aren't cached."""
    keyed = df.withColumn("digest", F.sha2(F.concat_ws("\0", F.col(prompt), F.lit(json.dumps(schema, sort_keys=True))), 256))
    asked = keyed.select("digest", prompt).dropDuplicates(["digest"]).join(cache.select("digest"), "digest", "left_anti")
    fresh = structured_calls(asked, "digest", prompt, schema, build)
    new = fresh.where("error IS NULL").select("digest", "response")
    return keyed.join(cache.select("digest", "response").unionByName(new), "digest", "left").select(key, "response"), new


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """A deterministic stand-in: signed hashes of words."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big")
                out[i, h % self.size] += 1 if h >> 63 else -1
        return out.round(6).tolist()


def embed_in_batches(embedder: Embedder, texts: list[str], batch: int = 100) -> list[list[float]]:
    """Batches; where an endpoint gives fewer vectors than texts, one text at a time from then on."""
    out: list[list[float]] = []
    single = False
    for i in range(0, len(texts), batch):
        part = texts[i : i + batch]
        got = None if single else embedder.embed(part)
        if got is None or len(got) != len(part):
            single = True
            got = [embedder.embed([t])[0] for t in part]
        out += got
    return out


def embed_missing(texts: DataFrame, text: str, cache: DataFrame, build: Callable[[], Embedder] = HashEmbedder) -> DataFrame:
    """(digest, vector) of the distinct texts that aren't in the cache (digest, vector)."""
    todo = texts.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("digest"), F.col(text).alias("t")).dropDuplicates(["digest"]).join(cache.select("digest"), "digest", "left_anti")

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = build()
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "vector": embed_in_batches(e, b["t"].tolist())})

    return todo.mapInPandas(embed, "digest string, vector array<double>")


def ask_chatbot(questions: DataFrame, key: str, question: str, ask: Callable[[str], dict]) -> DataFrame:
    """(key, answer, retrieved_context, latency_ms, error) from a chatbot; ask runs in the workers and may raise."""
    kind = dict(questions.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, q in zip(b[key], b["_q"]):
                began = time.monotonic()
                try:
                    r = ask(q)
                    out.append((k, r.get("answer"), r.get("context"), (time.monotonic() - began) * 1000, None))
                except Exception as e:  # told in the row
                    out.append((k, None, None, None, f"{type(e).__name__}: {e}"[:240]))
            yield pd.DataFrame(out, columns=[key, "answer", "retrieved_context", "latency_ms", "error"])

    return questions.select(key, F.col(question).alias("_q")).mapInPandas(run, f"`{key}` {kind}, answer string, retrieved_context string, latency_ms double, error string")
