"""Filters by a table of ids: left-semi joins whose small side is measured, with a bitmap of hashed ids in front of the shuffle where it is large."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brasstally.errors import InputError
from brasstally.functions import text
from brasstally.plans import shared

#: Ids that are sent to every task as they are. Beyond, bits for each id, and bits in all at most (32 MB).
MOST_BROADCAST, BITS_FOR_ID, MOST_BITS = 1_000_000, 16, 1 << 28


def _bit(c: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(bits))


def bitmap(ids: DataFrame, column: str, bits: int) -> DataFrame:
    """Rows (bucket, bitmap) with a bit for each id's hash, at most ``bits`` in all: a filter without false negatives, of a size that doesn't grow with the ids."""
    at = ids.select(_bit(F.col(column), bits).alias("_bit"))
    return at.groupBy(F.bitmap_bucket_number("_bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("bitmap"))


def may_be_among(df: DataFrame, column: str, marks: DataFrame, bits: int) -> DataFrame:
    """The rows whose hashed value has its bit set."""
    place = F.bitmap_bit_position(_bit(F.col(column), bits))
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = df.join(F.broadcast(marks), F.bitmap_bucket_number(_bit(F.col(column), bits)) == F.col("bucket"))
    return marked.where(F.call_function("getbit", byte, F.pmod(place, F.lit(8)).cast("int")) == 1).select(*df.columns)


def within(df: DataFrame, tables: Mapping[str, DataFrame] | None, error: type[InputError] = InputError) -> DataFrame:
    """The rows of ``df`` whose columns have a value in the tables given for them, each of one column of names.

    Names are stripped, blank ones ignored, like those of requests; but an empty table leaves no rows, as it asks for nothing. The table of ids is computed once
    and counted: up to MOST_BROADCAST ids go to every task; more meet the rows in a shuffle, which only rows reach whose hashed value is marked in a bitmap of bounded size.
    """
    for column, ids in (tables or {}).items():
        if column not in df.columns or len(ids.columns) != 1:
            raise error(f"a table of one column is needed for a column of {sorted(df.columns)}: {column} and {ids.columns}")
        name = text.strip(F.col(ids.columns[0]).cast("string"))
        asked = shared.kept(ids.select(name.alias(column)).where(F.col(column) != "").distinct())
        n = asked.count()
        if n <= MOST_BROADCAST:
            df = df.join(F.broadcast(asked), column, "left_semi")
        else:
            bits = min(MOST_BITS, 1 << (n * BITS_FOR_ID - 1).bit_length())
            # ids are distinct, so an inner join keeps the rows of a semi join, which would be moved below the bitmap
            df = may_be_among(df, column, bitmap(asked, column, bits), bits).join(asked.hint("shuffle_hash"), column).select(*df.columns)
    return df
