"""Arrow batches in, Arrow batches out: the frame that the Python operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are handled at once; a single longer text is handled alone.
CHUNK_BYTES = 2 << 20
#: Rows that are handled at once.
CHUNK_ROWS = 4096


def texts(column: pa.Array) -> pa.Array:
    """The column with null as the empty text."""
    return pc.fill_null(column, "")


def release() -> None:
    """Give freed memory back to the system at the end of a task: Python workers are kept for later
    tasks, and what each holds back adds up beside the executor's heap."""
    from tidemark.llm import textbytes

    textbytes.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def chunks(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many text bytes and rows each, whole rows only."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > most or i - start >= rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def map_chunks(df, one: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", begin: Callable | None = None, rows: int = CHUNK_ROWS, done: Callable | None = None):
    """mapInArrow of one over the chunks of each batch. begin() runs once for each task; what it
    returns is passed to one as second argument. done() runs when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = begin() if begin else None
        try:
            for batch in batches:
                for part in chunks(batch, text, rows=rows):
                    out = one(part, state) if begin else one(part)
                    if out is not None:
                        yield out
        finally:
            state = None
            if done:
                done()
            release()

    return df.mapInArrow(run, schema)
