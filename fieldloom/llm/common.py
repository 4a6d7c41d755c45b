"""Helpers shared by the operators for training-data pipelines."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.staging import materialize

__all__ = ["Memo", "ascii_lower", "id_type", "let", "map_rows", "materialize", "slices", "spotted", "table"]

#: ASCII white space (0x20 and 0x09-0x0D), the word separator of every text operator.
WS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value, body):
    """Evaluate ``value`` once and bind it inside a higher-order expression."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(col):
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(col, UPPER, LOWER)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds few texts as Python objects at a time."""
    for b in batches:
        for at in range(0, max(b.num_rows, 1), rows):
            yield b.slice(at, rows)


def map_rows(df: DataFrame, fn: Callable[[Iterator[list[list]]], Iterable[list[list]]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over lists: ``fn`` takes an iterator of batches and yields batches, each a list of columns.

    Nulls arrive as None and integers stay integers.
    """
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn([c.to_pylist() for c in part.columns] for part in slices(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kinds)


def id_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


#: Bits of the maps that keep most rows without a partner out of a shuffle.
MAP_BITS = 1 << 24


def spotted(df: DataFrame, key: str, keys: DataFrame, column: str = "_spotted") -> DataFrame:
    """Add whether ``key`` may be one of ``keys`` (one column, same type): true for all that are, seldom for others.

    The map of hashed keys has a fixed size (``MAP_BITS`` / 64 rows at most) and is therefore
    broadcast. What it lets through needs an exact join; with very many keys it only saves less.
    """
    name = keys.columns[0]
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    bit = lambda c: (spot(c) % 64).cast("int")
    known = keys.where(F.col(name).isNotNull()).select(F.floor(spot(name) / 64).alias("_word"), bit(name).alias("_at"))
    words = known.groupBy("_word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_at"))).alias("_map"))
    met = df.withColumn("_word", F.floor(spot(key) / 64)).join(F.broadcast(words), "_word", "left")
    hit = F.call_function("shiftright", F.col("_map"), bit(key)).bitwiseAND(F.lit(1)) == 1
    return met.withColumn(column, F.coalesce(hit, F.lit(False))).drop("_word", "_map")


class Memo(dict):
    """Results of ``fn`` by key, within a bound of bytes: short keys only, in two generations, so that frequent keys stay."""

    def __init__(self, fn: Callable, most_bytes: int = 32 << 20, longest: int = 96):
        super().__init__()
        self.fn, self.most, self.longest = fn, most_bytes, longest
        self.old: dict = {}
        self.held = 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if (n := len(key)) <= self.longest:
            self[key] = value
            self.held += 160 + n + len(value)
            if self.held > self.most:
                self.old, self.held = dict(self), 0
                self.clear()
        return value
