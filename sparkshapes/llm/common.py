"""Helpers the corpus operators share: shared-folder tables, text expressions, skew-safe lookups, word caches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..plans.tables import discard, stored, with_groups

__all__ = ["SPACES", "WordTable", "discard", "free_name", "id_key", "learn_remainder", "read_table", "released", "row_key", "stored", "text_batches", "text_of", "with_groups"]

#: The characters that separate words: \x20 and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def id_key(docs: DataFrame, id_col: str) -> Column:
    """Bytes, never null, that sort as the id does, null first."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        own = F.unhex(F.lpad(F.hex(F.col(id_col).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    else:
        own = F.concat(F.col(id_col).cast("string").cast("binary"), F.unhex(F.lit("00")))
    return F.coalesce(F.concat(F.unhex(F.lit("01")), own), F.unhex(F.lit("00")))


def free_name(docs: DataFrame, name: str) -> str:
    """name, or with as many marks in front as it takes to be none of docs' columns."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(docs: DataFrame, id_col: str, *more: Column) -> Column:
    """Never null; sorts as the id does, null first, and tells rows apart that share an id but not the further columns."""
    parts = [x for c in more for x in (F.coalesce(c.cast("binary"), F.lit(b"")), F.when(c.isNull(), F.lit(b"\0")).otherwise(F.lit(b"\1")))]
    return F.concat(id_key(docs, id_col), F.unhex(F.md5(F.concat(*parts))))


def learn_remainder(id_col: str, n: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def released() -> None:
    """Gives the memory that this process has freed back to the system, where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class WordTable(dict):
    """What is computed for a distinct word, kept over the batches of a task and emptied when it has limit words."""

    def __init__(self, compute, limit: int = 400_000):
        self.compute, self.limit = compute, limit

    def __missing__(self, word: str):
        found = self[word] = self.compute(word)
        return found

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


def text_batches(batches: Iterator, column: int = 1, size: int = 4_000_000) -> Iterator:
    """(part of a record batch, its texts, null as empty); a part has about size bytes of text, or one row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // size
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), batch.num_rows)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            rows = batch.slice(a, b - a)
            yield rows, [x or "" for x in rows.column(column).to_pylist()]
