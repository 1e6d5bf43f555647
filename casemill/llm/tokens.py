"""Token counts with a public tokenizer. The vocabulary file is a parameter; it has to be at that path on every executor."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = os.environ.get("CASEMILL_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that goes with the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def encoding(path: str):  # noqa: ANN201
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, id_col: str, text_col: str, keep: list[str], path: str = DEFAULT_RANKS) -> DataFrame:
    """(id, *keep, n_tokens): whole texts are encoded; a null or empty text has no tokens. The texts don't leave their partition."""
    lean = df.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lean.schema.fields[:-1]) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    return lean.mapInArrow(run, schema)
