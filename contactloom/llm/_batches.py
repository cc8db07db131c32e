"""Running a numpy worker over Arrow batches of a DataFrame, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that a worker handles at a time; bounds its temporary arrays.
SLICE_BYTES = 2 << 20


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `limit` bytes of text each; a longer text stands alone."""
    if not batch.num_rows:
        return
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column from its bytes and n+1 byte offsets."""
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())]
    )


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows flat[starts[i] : starts[i] + counts[i]] one after another, and their n+1 offsets."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return flat[np.repeat(starts - offsets[:-1], counts) + np.arange(offsets[-1])], offsets


def append_columns(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable], replace: tuple[str, ...] = ()) -> DataFrame:
    """`df` with computed columns added.

    make() gives, once a task, a function from a record batch to one Arrow array for each field.  Input columns whose
    names equal (whatever their case) that of a new field are left out, save those in `replace`, which keep their place.
    """
    new = {f.name.lower(): f for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new or f.name in replace or f.name == text]
    order = [new.get(f.name.lower(), f) if f.name in replace else f for f in keep] + [f for f in fields if f.name not in replace]
    at = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                made = dict(zip(at, work(part), strict=True))
                arrays = [made[f.name] if f.name in made else part.column(part.schema.get_field_index(f.name)) for f in order]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in order])

    return df.select(*[df[f"`{f.name}`"] for f in keep]).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in order]))
