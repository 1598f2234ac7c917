"""Helpers shared by the operators on text corpora."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from readtrace.session import scratch_dir, tune

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch; texts are long, so batches stay small.
_ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}


def prepared(spark: SparkSession) -> SparkSession:
    """The library's settings with batches sized for texts."""
    tune(spark)
    for key, value in _ARROW.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: str, modulus: int) -> Column:
    """Whether a document is held out from learning; a null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == 2, F.lit(False))


def stash(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Give back the space of a stash that nothing reads any more; the empty table stays."""
    spark, path = df.sparkSession, df.inputFiles()
    if path:
        spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(path[0].rpartition("/")[0])


#: Keys that a removal broadcasts as they are, and 64-bit lanes of the map that stands for more of them.
_KEYS_HELD, _LANES = 500_000, 1 << 20


def without(df: DataFrame, key: str, gone: DataFrame, held: int = _KEYS_HELD) -> DataFrame:
    """The rows of ``df`` whose key is not among ``gone``, a column of the same name; rows with a null key stay.

    The texts are not shuffled for it: up to ``held`` keys are broadcast. Of more, a map of 64
    million bits is, and only rows whose bit is set meet the keys themselves.
    """
    gone = stash(gone.select(key).where(F.col(key).isNotNull()).distinct(), "removed-keys")
    if gone.count() <= held:
        return df.join(F.broadcast(gone), key, "left_anti").select(df.columns)
    def placed(column: str) -> tuple[Column, Column]:
        place = F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(_LANES * 64))
        return F.shiftright(place, 6).alias("lane"), (place % 64).cast("int").alias("bit")

    lanes = gone.select(*placed(key)).groupBy("lane").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    lanes = F.broadcast(stash(lanes, "removed-map"))  # _LANES rows at most
    rows = df.select(F.struct(*df.columns).alias("row")).select("row", *placed(f"row.{key}")).join(lanes, "lane", "left")
    hit = F.coalesce(F.expr("shiftright(bits, bit) & 1"), F.lit(0)) == 1
    return rows.where(~hit).select("row.*").unionByName(rows.where(hit).select("row.*").join(gone, key, "left_anti").select(df.columns))


def sampled(df: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows at most, picked by a hash of the key; all where there are fewer."""
    rows = df.count()
    if rows <= bound:
        return df
    share = int((1 << 30) * bound / rows)
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(7)), F.lit(1 << 30)) < share)


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """``fn`` gets a dict of column lists per Arrow batch and yields tuples of column lists."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
                   for batch in batches)
        for out in fn(columns):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def bitmap(hashes: DataFrame, bits: int) -> bytes:
    """A map of ``bits`` bits (a power of two, 4096 at least) with one bit set for every value of the column ``hash``."""
    def run(batches: Iterator[dict]) -> Iterator[tuple]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            order = np.sort(np.array(batch["hash"], np.int32))
            blocks, starts = np.unique(order >> 12, return_index=True)
            for block, part in zip(blocks.tolist(), np.split(order & 4095, starts[1:]), strict=True):
                seen.setdefault(block, np.zeros(4096, bool))[part] = True
        if seen:
            yield list(seen), [np.packbits(v, bitorder="little").tobytes() for v in seen.values()]

    # Only the bits in use travel, as an int: a map has 2 ** 31 bits at most.
    place = hashes.select(F.col("hash").bitwiseAND(F.lit(bits - 1)).cast("int").alias("hash"))
    out = np.zeros(bits // 8, np.uint8)
    parts = map_rows(place.repartition(F.shiftright("hash", 12)), run, struct(("block", LONG), ("bits", BYTES)))
    for row in parts.collect():  # bits / 8 bytes in all
        at = row.block * 512
        out[at:at + 512] |= np.frombuffer(row.bits, np.uint8)
    return out.tobytes()


def in_bitmap(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash (uint64) is set."""
    b = hashes & np.uint64(len(held) * 8 - 1)
    return (held[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def filter_rows(df: DataFrame, column: str, keep: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """Rows, with all their columns, for which ``keep()`` says true of a list of one column's values."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = keep()
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


LONG, DOUBLE, STRING, BOOL, BYTES = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.BinaryType()
