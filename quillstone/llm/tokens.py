"""Sizes of texts in tokens of a public tokenizer; the vocabulary file's path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A rank file in the folder of public tokenizers.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of such rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file; read once in each worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens; a null text has none."""

    def count(texts: pa.Array) -> pa.Array:
        encode = encoding(path).encode_ordinary
        return pa.array([len(encode(x)) if x else 0 for x in texts.to_pylist()], pa.int64())

    # Not deterministic, to the optimizer: else a filter on the count makes it count twice.
    return F.arrow_udf(count, T.LongType()).asNondeterministic()(text)
