"""Sizes of texts in tokens of a public tokenizer; the vocabulary's path is a parameter."""

from __future__ import annotations

import base64
import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that cuts text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(4)
def encoder(path: str = VOCABULARY):
    """Read once in each worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("lumentab", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Tokens of each text, 0 for a null."""

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    return count(text)


_PROMPT_END = re.compile(r"(?:[.!?…。؟！？][\"'”’»)\]]*(?=\s)|(?=[\r\n]))(?=\s*\S)")


def prompt_count(text: Column, path: str = VOCABULARY) -> Column:
    """(n_tokens, prompt_tokens) of each text: all of its tokens, and those of its first sentence or line; 1 where nothing
    follows that."""

    @F.pandas_udf("n_tokens int, prompt_tokens int")
    def count(texts: pd.Series) -> pd.DataFrame:
        encode = encoder(path).encode_ordinary
        out = []
        for t in texts:
            n = len(encode(t)) if t else 0
            m = _PROMPT_END.search(t, len(t) - len(t.lstrip())) if t else None
            out.append((n, min(n, len(encode(t[: m.end()]))) if m else min(n, 1)))
        return pd.DataFrame(out, columns=["n_tokens", "prompt_tokens"], dtype="int32")

    return count(text)
