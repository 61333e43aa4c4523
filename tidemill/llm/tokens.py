"""Token counts of texts by a public tokenizer's ranks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks file of a byte-level BPE; only its path is known here, the file is never copied.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Largest ranks file that is broadcast.
MAX_RANKS_BYTES = 16 * 1024 * 1024


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), ranks: str = RANKS) -> DataFrame:
    """(doc_id, *keep, n_tokens bigint) of whole texts; null and empty texts have no tokens."""
    content = Path(ranks).read_bytes()
    if len(content) > MAX_RANKS_BYTES:
        raise ValueError(f"{ranks} is larger than {MAX_RANKS_BYTES} bytes")
    shipped = documents.sparkSession.sparkContext.broadcast(content)
    pattern = PATTERN

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shipped.value.splitlines())}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return documents.select(F.col(key).alias("doc_id"), *keep, count(F.col(text)).alias("n_tokens"))
