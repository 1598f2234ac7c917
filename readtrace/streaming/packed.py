"""Rows of a stream in packs of Arrow data, by buckets of keys.

A call of a stateful processor, its state and its timers cost the same for one row as for
thousands.  So keys are hashed to a fixed number of buckets, and the rows that a task reads
for a bucket travel as one binary value: the processor is called per bucket, and state is
read and written a bucket at a time.  The number of buckets is part of a checkpoint.

Rows that wait are kept as packs too, twice (by the task and in the checkpoint), so packs are
small: rows of a key lie together, whole numbers are differences, and a pack is compressed as one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BUCKETS = 1024
#: A task gathers so many rows, or bytes, before it cuts them into packs.
PACK_ROWS, PACK_BYTES = 1_000_000, 64 << 20


def packed(rows: DataFrame, keys: Sequence[str], event_time: str) -> DataFrame:
    """bucket, event time of the pack's last row (with the stream's watermark), first (ms of its first row), rows."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), rows.schema[event_time],
                           T.StructField("first", T.LongType()), T.StructField("rows", T.BinaryType())])
    arrow, at = to_arrow_schema(schema), rows.columns.index(event_time)
    # A column of null arrays would make Spark's Arrow writer go over all rows of a batch for each row.
    arrays = [i for i, f in enumerate(rows.schema) if isinstance(f.dataType, T.ArrayType)]

    def packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        for i in arrays:
            table = table.set_column(i, table.column_names[i], _unwrapped(table.column(i).combine_chunks()))
        key = table.column(table.num_columns - 1).to_numpy()
        bucket = key % BUCKETS
        order = np.argsort((bucket << 52) | (key & (1 << 52) - 1), kind="stable")
        table, bucket = table.drop_columns(["_key"]).take(order).combine_chunks(), bucket[order]
        times = micros(table, at)
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends = np.append(starts[1:], len(bucket))
        small = _Small(table, starts)
        return pa.RecordBatch.from_arrays([
            pa.array(bucket[starts], pa.int32()),
            pa.array(np.maximum.reduceat(times, starts)).cast(arrow[1].type),
            pa.array(np.minimum.reduceat(times, starts) // 1000),
            pa.array([small.pack(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], arrow[3].type)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held, n, size = [*held, batch], n + batch.num_rows, size + batch.nbytes
            if n >= PACK_ROWS or size >= PACK_BYTES:
                yield packs(held)
                held, n, size = [], 0, 0
        if held:
            yield packs(held)

    wrapped = {rows.columns[i]: F.when(F.col(rows.columns[i]).isNull(), F.array()).otherwise(F.array(rows.columns[i])) for i in arrays}
    return rows.withColumn("_key", F.xxhash64(*keys)).withColumns(wrapped).mapInArrow(run, schema)


def _unwrapped(column: pa.ListArray | pa.ChunkedArray) -> pa.Array:
    """The only element of each list, null where there is none."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    offsets = column.offsets.to_numpy()
    return column.values.take(pa.array(offsets[:-1], mask=offsets[1:] == offsets[:-1]))


def unpacked(packs: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of the packs in the only column."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.column(0):
                yield from loaded(pack.as_py()).cast(arrow).to_batches(max_chunksize=20_000)

    return packs.mapInArrow(run, schema)


def micros(table: pa.Table, column: int) -> np.ndarray:
    return table.column(column).cast(pa.int64()).to_numpy()


class _Small:
    """Columns of rows in little space: whole numbers and times as differences in the least width, texts as lengths and letters."""

    def __init__(self, table: pa.Table, starts: np.ndarray):
        self.kinds, self.firsts, self.texts = [], {}, {}
        columns, names = [], []
        for i, column in enumerate(table.columns):
            column, kind = column.combine_chunks() if column.num_chunks else pa.array([], column.type), column.type
            if isinstance(column, pa.ChunkedArray):
                column = pa.concat_arrays(column.chunks)
            if pa.types.is_string(kind):
                offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
                self.texts[i] = column.buffers()[2] or pa.py_buffer(b""), offsets
                self.kinds.append(["text", bool(column.null_count)])
                if column.null_count:
                    columns.append(column.is_valid())
                column = pa.array(_narrow(np.diff(offsets)))
            elif (pa.types.is_signed_integer(kind) or pa.types.is_timestamp(kind)) and not column.null_count:
                numbers = column.cast(pa.int64()).to_numpy()
                steps = np.diff(numbers, prepend=0)
                steps[starts] = 0
                by = int(np.gcd.reduce(steps)) or 1 if len(steps) else 1
                self.firsts[i] = numbers
                self.kinds.append(["steps", by, kind.bit_width, *([kind.unit, kind.tz] if pa.types.is_timestamp(kind) else [])])
                column = pa.array(_narrow(steps // by))
            else:
                self.kinds.append(["plain"])
            columns.append(column)
        self.names = table.column_names
        self.table = pa.table(columns, names=[str(i) for i in range(len(columns))])

    def pack(self, a: int, b: int) -> bytes:
        """The rows from a to b; differences begin anew at a."""
        letters = [(data.slice(int(at[a]), int(at[b] - at[a]))) for data, at in self.texts.values()]
        head = json.dumps([self.names, self.kinds, [int(v[a]) if b > a else 0 for v in self.firsts.values()], [x.size for x in letters]]).encode()
        sink = pa.BufferOutputStream()
        sink.write(len(head).to_bytes(4, "little"))
        sink.write(head)
        for x in letters:
            sink.write(x)
        with pa.ipc.new_stream(sink, self.table.schema) as out:
            out.write_table(self.table.slice(a, b - a))
        data = sink.getvalue()
        return data.size.to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


_CODEC = pa.Codec("zstd", compression_level=3)


def _narrow(numbers: np.ndarray) -> np.ndarray:
    low, high = (int(numbers.min()), int(numbers.max())) if len(numbers) else (0, 0)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return numbers.astype(kind)


def dumped(table: pa.Table) -> bytes:
    return _Small(table, np.zeros(min(1, table.num_rows), np.int64)).pack(0, table.num_rows)


def loaded(data: bytes) -> pa.Table:
    whole = _CODEC.decompress(pa.py_buffer(data).slice(8), int.from_bytes(data[:8], "little"))
    size = int.from_bytes(whole.slice(0, 4).to_pybytes(), "little")
    names, kinds, firsts, letters = json.loads(whole.slice(4, size).to_pybytes())
    begin = 4 + size
    texts = []
    for n in letters:
        texts.append(whole.slice(begin, n))
        begin += n
    table = pa.ipc.open_stream(whole.slice(begin)).read_all().combine_chunks()
    held = iter([pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in table.columns])
    firsts, texts, columns = iter(firsts), iter(texts), []
    for kind, *more in kinds:
        column = next(held)
        if kind == "text":
            valid, column = (column.buffers()[1], next(held)) if more[0] else (None, column)
            ends = np.concatenate(([0], np.cumsum(column.to_numpy(), dtype=np.int64))).astype(np.int32)
            column = pa.Array.from_buffers(pa.string(), len(column), [valid, pa.py_buffer(ends), next(texts)])
        elif kind == "steps":
            by, width, *unit = more
            column = pa.array(next(firsts) + by * np.cumsum(column.to_numpy(), dtype=np.int64))
            column = column.cast(pa.timestamp(*unit) if unit else f"int{width}")
        columns.append(column)
    return pa.table(columns, names=names)


def split(data: bytes, at: int, mark: int) -> tuple[pa.Table | None, bytes | None, int | None]:
    """Rows of a pack up to ``mark`` (ms), the others as a pack, and when these begin (ms)."""
    table = loaded(data)
    times = micros(table, at) // 1000
    due = times <= mark
    if due.all():
        return table, None, None
    if not due.any():
        return None, data, int(times.min())
    return table.filter(pa.array(due)), dumped(table.filter(pa.array(~due))), int(times[~due].min())


def codes(columns: Sequence[pa.Array]) -> np.ndarray:
    """A number for each row, the same for rows with the same values; nulls are values."""
    found = None
    for column in columns:
        own = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        own = own.dictionary_encode(null_encoding="encode")
        number = own.indices.to_numpy().astype(np.int64)
        found = number if found is None else np.unique(found * len(own.dictionary) + number, return_inverse=True)[1]
    return found
