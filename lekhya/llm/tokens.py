"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the public tokenizers' vocabulary files, and the one texts are sized by; both are parameters.
FOLDER = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"

_loaded: dict[str, object] = {}


def _processor(path: str):
    if path not in _loaded:
        import sentencepiece

        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _loaded[path]


#: Characters of the texts whose token lists are in memory at once; a longer text is alone.
HELD_CHARS = 1 << 17


def _held(texts: Iterable[str | None]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        t = t or ""
        if part and size + len(t) > HELD_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def with_tokens(rows: DataFrame, text: str, folder: str = FOLDER, model: str = MODEL, name: str = "tokens") -> DataFrame:
    """``rows`` with the number of tokens of ``text`` in ``name`` (bigint): 0 for null and empty texts."""
    path = os.path.join(folder, model)

    @F.pandas_udf(T.LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        processor = _processor(path)
        for texts in batches:
            yield pd.Series([len(ids) for held in _held(texts) for ids in processor.encode(held, num_threads=1)], dtype="int64")

    return rows.withColumn(name, counted(F.col(text)))
