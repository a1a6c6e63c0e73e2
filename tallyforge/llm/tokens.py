"""Token counts of a public tokenizer, computed in Arrow batches on the workers."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Vocabulary file (tiktoken ranks); a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed pattern of that vocabulary: what is split before its merges; a parameter too.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Blanks in a row that the tokenizer's matcher isn't asked to take.
ENDLESS = 50_000


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str = PATTERN):
    """The vocabulary file is looked for at ``path``, then among the files shipped with the job (SparkContext.addFile)."""
    import tiktoken
    from pyspark import SparkFiles

    name = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
    with open(name, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = TOKENIZER, pattern: str = PATTERN) -> int:
    """Tokens of the whole text; 0 for null and empty texts.

    The tokenizer's own matcher has no stack for endless blanks; texts with such are split by the same pattern here, with the same pieces.
    """
    if not text:
        return 0
    enc, text = encoding(path, pattern), text.encode("utf-8", "replace").decode()
    if len(text) > ENDLESS and re.search(rf"\s{{{ENDLESS}}}", text):
        import regex

        return sum(len(enc._encode_single_piece(m[0])) for m in regex.finditer(pattern, text))
    return len(enc.encode_ordinary(text))


def with_tokens(df: DataFrame, text: str, out: str = "n_tokens", path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """``df`` without its text column and with a token count; no shuffle."""
    keep = [f for f in df.schema.fields if f.name != text]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = pa.array([count(t, path, pattern) for t in b.column(b.schema.get_field_index(text)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [counts], names=[*names, out])

    return df.mapInArrow(run, StructType([*keep, *StructType.fromDDL(f"{out} bigint").fields]))
