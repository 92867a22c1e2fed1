"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: The vocabulary file; any file of byte-pair ranks, one ``base64 rank`` a line, will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The splitting pattern these byte-level vocabularies were made with (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of a batch that are sized together; bounds a worker's memory with long texts.
BATCH_ROWS = 256


def _encoding(path: str):
    """The encoding of a vocabulary file, kept in the worker's process, for tasks bring this module along anew."""
    import tiktoken

    kept = sys.modules.setdefault("graphloom_kept", types.ModuleType("graphloom_kept")).__dict__
    if path in kept:
        return kept[path]
    here = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
    with open(here, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    kept[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores; one that has them, or comes from a shuffle, is left alone."""
    execution = df._jdf.queryExecution()
    if execution.executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if execution.toRdd().getNumPartitions() < cores else df


def count_tokens(df: DataFrame, text: str, tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and ``n_tokens BIGINT``, the size of the whole ``text`` (null for null, 0 for '').

    The vocabulary is read from ``tokenizer`` once per worker; executors that don't have that file get it from the driver.
    Strings that look like special tokens are ordinary text.
    """
    df.sparkSession.sparkContext.addFile(tokenizer)
    schema = df.select(*keep).schema.add("n_tokens", "long")
    kept = [field.name for field in schema.fields[:-1]]

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                sizes = [None if t is None else len(encode(t)) for t in part.column(len(kept)).to_pylist()]
                columns = [part.column(k) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], names=[*kept, "n_tokens"])

    return spread(df.select(*keep, df[text].alias("text_to_size"))).mapInArrow(size, schema)
