"""Token counts of whole texts, by a byte-pair tokenizer of the tokenizers library."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from doctables.llm.wordcache import WordCache, encode_words, portions, word_parts

MODEL = "word_bpe_49k.json"


def tokenizer(path: str) -> Tokenizer:
    """The library's tokenizer without truncation and padding."""
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=4)
def _lengths(path: str) -> WordCache:
    model = tokenizer(path)
    return WordCache(lambda words: [len(ids) // 4 for ids in encode_words(model, words)], word_parts)


def token_lengths(text: Column, model: str = MODEL) -> Column:
    """Number of tokens (long) of each whole text, without special tokens added; NULL counts as empty.

    ASCII white space is a safe boundary of this tokenizer: it is dropped, and no
    piece, contraction or special string spans it. So texts are split there, however
    long they are, the distinct words are encoded in batches balanced by bytes, and
    only lengths come back.
    """

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = _lengths(public_tokenizers.path(model))
        for texts in batches:
            plain = [t or "" for t in texts]
            counts: list[int] = []
            for first, last in portions(map(len, plain)):
                split = [t.encode().split() for t in plain[first:last]]
                counts += map(sum, cache.lists(split))
            yield pd.Series(counts, dtype="int64")

    return run(text)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, model: str = MODEL) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    NULL text counts as empty: no bytes, no tokens. Repeated rows and rows without id
    are counted like any other; an empty table gives an empty result.
    """
    return docs.select(
        id_col,
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        token_lengths(F.col(text_col), model).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
