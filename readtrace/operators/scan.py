"""A stateful pass over the ordered rows of each key, for path-dependent rules.

Some rules cannot be written as windows because every decision depends on all
decisions before it (greedy matching, segmentation that restarts after each
break, state machines).  :func:`ordered_scan` lets Spark partition and sort the
rows and streams each partition through a small Python step in Arrow batches;
no group is ever built in memory.

A hot key is cut into chunks (see ``ordered.cut_points``) that run in parallel.
A chunk needs the state its predecessor ends with.  Where the rule has a
*transfer* (the effect of a chunk on any state before it, as a small object),
one pass finds all transfers, they are composed in order, and a second pass
gives the output: two passes, however many chunks there are.  Without one, the
scan is repeated for the chunks whose assumed start state proved wrong until
none is left; in the worst case, as with the aligners, that is once per chunk.
The answer equals the sequential one in every case.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from readtrace.operators.ordered import CHUNK, TARGET_ROWS, WHOLE, with_chunks

SEED = "_seed"
END = "_end_state"


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    init: Callable[[], object],
    step: Callable[[object, tuple], Sequence[tuple]],
    output: T.StructType,
    inputs: Sequence[str] | None = None,
    target_rows: int = TARGET_ROWS,
    transfer: Callable[[], object] | None = None,
    measure: DataFrame | None = None,
) -> DataFrame:
    """Run ``step`` over the rows of every key in ``order``.

    ``init()`` makes the start state; ``step(state, row)`` updates it in place
    and returns output tuples (without keys), where ``row`` holds the ``inputs``
    columns (default: all columns but the keys).  The result has the key
    columns followed by ``output``.  The state must pickle and stay small.
    ``transfer()`` has ``add(row)`` and ``result()``; the result pickles, and its
    ``after(state)`` is the state after the chunk.  ``measure`` is as in ``OrderedFrame``.
    """
    keys, order = list(keys), list(order)
    inputs = list(inputs) if inputs is not None else [c for c in df.columns if c not in keys]
    needed = list(dict.fromkeys(keys + order + inputs))
    df, split = with_chunks(df.select(*needed), keys, order, target_rows, measure)
    key_fields = [df.schema[k] for k in keys]
    out_schema = T.StructType(key_fields + list(output.fields))

    if not split:
        source = df.drop(CHUNK).repartition(*keys)
        runner = _runner(keys, inputs, init, step, out_schema, chunked=False)
        return source.sortWithinPartitions(*keys, *order).mapInArrow(runner, out_schema)

    seeds = _composed(df, keys, order, inputs, init, transfer) if transfer else _settle(df, keys, order, inputs, init, step)
    runner = _runner(keys, inputs, init, step, out_schema, chunked=True, emit_end=False)
    return _seeded(df, seeds, keys, order).mapInArrow(runner, out_schema)


def _seeded(df: DataFrame, seeds: DataFrame | None, keys, order) -> DataFrame:
    """Put the start state of each chunk in front of its rows."""
    rows = df.withColumn(SEED, F.lit(None).cast("binary"))
    if seeds is not None:
        rows = rows.unionByName(seeds, allowMissingColumns=True)
    return (rows.repartition(*keys, CHUNK)
            .sortWithinPartitions(*keys, CHUNK, F.col(SEED).isNull(), *order))


def _seed_schema(df: DataFrame, keys: Sequence[str], name: str) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + [T.StructField(CHUNK, T.IntegerType()), T.StructField(name, T.BinaryType())])


def _composed(df, keys, order, inputs, init, transfer) -> DataFrame:
    """Start states of all chunks of hot keys, from one pass that finds their transfers."""
    schema = _seed_schema(df, keys, END)
    arrow = to_arrow_schema(schema)
    group = [*keys, CHUNK]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, now = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip((*current, pickle.dumps(now.result())), arrow)], schema=arrow)

        for batch in batches:
            groups = zip(*[batch.column(c).to_pylist() for c in group])
            for at, row in zip(groups, zip(*[batch.column(c).to_pylist() for c in inputs])):
                if at != current:
                    if current is not None:
                        yield told()
                    current, now = at, transfer()
                now.add(row)
        if current is not None:
            yield told()

    hot = _seeded(df.filter(F.col(CHUNK) != WHOLE), None, keys, order)
    # One small object per chunk, and chunks are bounded by MAX_CHUNKS.
    found = sorted(((tuple(r)[:-1], bytes(r[END])) for r in hot.mapInArrow(run, schema).collect()), key=lambda f: (repr(f[0][:-1]), f[0][-1]))
    starts, key, state = [], None, None
    for at, effect in found:
        if at[:-1] != key:
            key, state = at[:-1], init()
        starts.append((*at, bytearray(pickle.dumps(state))))
        state = pickle.loads(effect).after(state)
    return df.sparkSession.createDataFrame(starts, _seed_schema(df, keys, SEED))


def _settle(df, keys, order, inputs, init, step) -> DataFrame:
    """Start states of all chunks of hot keys, found by repetition."""
    spark = df.sparkSession
    end_schema, seed_schema = _seed_schema(df, keys, END), _seed_schema(df, keys, SEED)
    runner = _runner(keys, inputs, init, step, end_schema, chunked=True, emit_end=True)
    hot = df.filter(F.col(CHUNK) != WHOLE)

    first = pickle.dumps(init())
    starts: dict[tuple, bytes] = {}
    ends: dict[tuple, bytes] = {}
    todo: DataFrame = hot
    seeds: DataFrame | None = None
    while True:
        # One small state per chunk, and chunks are bounded by MAX_CHUNKS.
        for r in _seeded(todo, seeds, keys, order).mapInArrow(runner, end_schema).collect():
            at = tuple(r)[:-1]
            ends[at] = bytes(r[END])
            starts.setdefault(at, first)
        wrong = {}
        before_key, before_end = None, None
        for at in sorted(ends, key=lambda a: (repr(a[:-1]), a[-1])):
            start = before_end if at[:-1] == before_key else first
            if start != starts[at]:
                wrong[at] = start
            before_key, before_end = at[:-1], ends[at]
        if not wrong:
            break
        starts.update(wrong)
        seeds = spark.createDataFrame([(*a, bytearray(s)) for a, s in wrong.items()], seed_schema)
        todo = hot.join(F.broadcast(seeds.drop(SEED)), keys + [CHUNK], "left_semi")
    return spark.createDataFrame([(*a, bytearray(s)) for a, s in starts.items()], seed_schema)


def values(column: pa.Array | pa.ChunkedArray) -> list:
    """As ``to_pylist``, but numbers and texts are converted at once, and nothing is done for nulls."""
    kind = column.type
    if pa.types.is_string(kind) or not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        if isinstance(column, pa.ChunkedArray):
            return column.to_numpy().tolist()
        return column.to_numpy(zero_copy_only=False).tolist()
    if not column.null_count:
        return column.to_pylist()
    out: list = [None] * len(column)
    for i, v in zip(np.flatnonzero(column.is_valid().to_numpy(**({} if isinstance(column, pa.ChunkedArray) else {"zero_copy_only": False}))).tolist(),
                    column.drop_null().to_pylist(), strict=True):
        out[i] = v
    return out


def _runner(keys, inputs, init, step, schema: T.StructType, chunked: bool, emit_end: bool = False):
    arrow = to_arrow_schema(schema)
    group = list(keys) + ([CHUNK] if chunked else [])

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            groups = zip(*[values(batch.column(c)) for c in group])
            rows = zip(*[values(batch.column(c)) for c in inputs])
            seeds = batch.column(SEED).to_pylist() if chunked else None
            out: list[tuple] = []
            for i, (at, row) in enumerate(zip(groups, rows)):
                if at != current:
                    if emit_end and current is not None:
                        out.append((*current, pickle.dumps(state)))
                    current, state = at, init()
                if seeds is not None and seeds[i] is not None:
                    state = pickle.loads(seeds[i])
                    continue
                produced = step(state, row)
                if produced and not emit_end:
                    out.extend((*at[:len(keys)], *p) for p in produced)
            if out:
                yield to_batch(out)
        if emit_end and current is not None:
            yield to_batch([(*current, pickle.dumps(state))])

    return run
