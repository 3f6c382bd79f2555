"""What the operators of this subpackage share: reading, written intermediates, names, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dropped, shared_dir, table, written

__all__ = ["WS", "blocks", "dropped", "fresh", "n_words_of", "shared_dir", "table", "text_or_empty", "trimmed", "words_of", "written"]

#: White space of every contract: space and the control characters from tab to carriage return.
WS = r"[\x20\x09-\x0D]+"
_WS_CHARS = " \t\n\x0b\f\r"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def trimmed(text: Column) -> Column:
    """A text without white space at its ends. A pattern bound to the end would look at an inner run from each of its
    characters; this takes time in proportion to the text."""
    return F.btrim(text, F.lit(_WS_CHARS))


def words_of(text: Column) -> Column:
    """Words of a text as an array; null if it has none."""
    bare = trimmed(text)
    return F.when(F.length(bare) > 0, F.split(bare, WS))


def n_words_of(text: Column) -> Column:
    """Number of words, counted without making them."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def blocks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int, max_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a block holds max_bytes of text at most, or a single longer row."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, held = 0, 0
        for i, n in enumerate(sizes):
            if i > at and (held + n > max_bytes or i - at >= max_rows):
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += int(n)
        yield batch.slice(at)
