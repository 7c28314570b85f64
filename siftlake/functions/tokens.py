"""Bytes for each token of a public tokenizer: words of a language need few tokens, random values need many."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: A tokenizer file may be this large, so that it can be sent to every executor.
MAX_FILE_BYTES = 64 << 20
#: Bytes for each token from which on a value counts as made of words.
WORD_LIKE = 3.2


@lru_cache(maxsize=2)
def _tokenizer(definition: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


def token_counter(spark: SparkSession, path: str | None = None) -> Callable[[Column], Column]:
    """A column function that counts a value's tokens. ``path``: the tokenizer's JSON file, a public one if it isn't given; it is sent to the executors."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    text = Path(path).read_text(encoding="utf-8")
    if len(text) > MAX_FILE_BYTES:
        raise ValueError(f"{path} has over {MAX_FILE_BYTES} bytes")
    sent = spark.sparkContext.broadcast(text)

    @F.pandas_udf("int")
    def count(values: pd.Series) -> pd.Series:
        tokenizer = _tokenizer(sent.value)
        texts = values.fillna("").tolist()
        return pd.Series([len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    return count


def word_like(value: Column, n_tokens: Column, limit: float = WORD_LIKE) -> Column:
    """So few tokens that the value is made of words: no credential."""
    return F.octet_length(value) >= limit * F.greatest(n_tokens, F.lit(1))
