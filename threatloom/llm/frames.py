"""Small helpers that the operators share: names, scratch tables, Arrow batches cut by bytes."""

import ctypes
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatloom.session import scratch_dir

#: Text bytes that a Python task works on at a time.
SLICE_BYTES = 8 << 20
#: Numbers of the C library's settings (malloc.h).
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3
_POOLS = (pa.default_memory_pool(), pa.system_memory_pool())


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names built on `names` that `frame` does not have yet, whatever its columns are called."""
    taken = {name.lower() for name in frame.columns}
    while any(name.lower() in taken for name in names):
        names = tuple(f"{name}_" for name in names)
    return list(names)


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept_in_table(frame: DataFrame, label: str) -> DataFrame:
    """Write `frame` to the shared scratch folder and read it back: lineage ends, lost executors cost nothing."""
    path = scratch_dir(frame.sparkSession, f"{label}-{uuid.uuid4().hex[:8]}")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each begins and ends (n + 1 offsets). A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of about `limit` text bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_buffers(batch.column(text))[1]
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


@lru_cache(maxsize=1)
def lean() -> None:
    """From now on blocks of 1 MB or more that this worker frees leave it at once, the last batch of a task included.

    Arrow's own pool and the C library's growing threshold would keep them while the worker waits for its next task.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option is not None:
        option(_MMAP_THRESHOLD, 1 << 20)
        option(_TRIM_THRESHOLD, 1 << 20)


def give_back() -> None:
    """Memory that a task of this worker has freed goes back to the system: an idle worker counts against its executor."""
    for pool in _POOLS:
        pool.release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
