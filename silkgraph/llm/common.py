"""Helpers shared by the pipeline operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silkgraph.sources.shared import materialize, shared_dir

__all__ = ["ascii_lower", "broadcast_if_small", "materialize", "norm_words", "shared_dir", "small_enough", "table", "text_blocks", "unused", "word_codes"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words of lower-cased text: runs of digits, a-z and everything beyond ASCII.
NORM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words as runs of anything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(col, UPPER, LOWER)


def norm_words(col: Column) -> Column:
    """Normalised words of a text, an empty array for null."""
    words = F.regexp_extract_all(ascii_lower(col), F.lit(NORM_WORD), F.lit(0))
    return F.coalesce(words, F.array().cast("array<string>"))


def small_enough(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` behind a row count; beyond it Spark shuffles instead."""
    return F.broadcast(df) if small_enough(df, rows) else df


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


#: Bytes of text (one document at least) that are split into words together.
BLOCK_BYTES = 8 << 20


def text_blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``most`` bytes in all, or one text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, most + (size[at - 1] if at else 0), side="right")))
        yield at, end
        at = end


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words between ASCII white space, the code of each word of all texts, and where each text's begin (and the last one's end).

    Null texts have no words.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = split.flatten().dictionary_encode()
    begin = split.offsets.to_numpy().astype(np.int64)
    begin = begin - begin[0]
    codes = coded.indices.to_numpy()
    blank = pc.index(coded.dictionary, "").as_py()
    if blank >= 0:  # white space at an end of a text
        real = codes != blank
        begin = np.concatenate([[0], np.cumsum(real)])[begin]
        codes = codes[real]
    return coded.dictionary, codes, begin
