"""Sizes of texts in tokens of a public tokenizer, read from a file that every executor has."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encodings: dict[str, object] = {}


def encoding(path: str):
    """The byte-level tokenizer of a rank file, loaded once per process."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_sizes(df: DataFrame, keep: list[str], text: str, path: str = DEFAULT_RANKS) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row whose text is not null; an empty text has 0 tokens."""
    slim = df.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(x)) for x in batch.column("__text").to_pylist()]
            yield batch.select(keep).append_column("n_tokens", pa.array(sizes, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "__text")
    return slim.mapInArrow(run, f"{fields}, n_tokens bigint")
