"""What the text operators share: Arrow blocks of bounded size and word splitting.

Texts are handled as UTF-8 bytes. ``bytes.split()`` cuts exactly at 0x20 and 0x09-0x0D, and
``bytes.lower()`` changes exactly A-Z, which is how words are defined throughout this subpackage.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.plans.storage import released, written

__all__ = ["ARRAY_BYTES", "BLOCK_BYTES", "WORD", "as_bytes", "blocks", "bounded", "column", "documents", "free", "live", "released", "texts_of", "written"]

#: One word, as a Java and Python regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are worked on in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Arrays made of a block take some forty times its bytes.
ARRAY_BYTES = 1 << 20
BATCH_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bounded(df: DataFrame) -> DataFrame:
    """``df``, for whose texts the session makes Arrow batches of at most BATCH_BYTES; two of them are in memory for each task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text alone, so that no other column can clash; a null text counts as empty."""
    return bounded(docs).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def give_back() -> None:
    """Memory that a finished task has freed goes back to the system, for the next tasks' and other processes' use."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


_LIVE: dict = {}


def live(key, make):
    """What a worker keeps between tasks, such as an engine with its caches: made once, and dropped when another one is asked for."""
    if key not in _LIVE:
        _LIVE.clear()
        _LIVE[key] = make()
    return _LIVE[key]


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts take about ``limit`` bytes together. At the end unused memory goes back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    give_back()


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.fill_null(column.cast(kind), b"").to_pylist()


def free(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name in taken:
        name += "_"
    return name


def column(name: str, docs: DataFrame, source: str = "doc_id") -> str:
    """``name type`` for a schema string, the type that of ``source``."""
    return f"{name} {docs.schema[source].dataType.simpleString()}"
