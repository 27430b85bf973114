"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

#: Rows whose crc32(doc_id as text) mod 4 equals this are never learned from.
HELD_OUT = 2


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TOP_ROWS = "spark.sql.optimizer.windowGroupLimitThreshold"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the length of a block, as it was (set or not) afterwards."""
    before = spark.conf.get(key, None) if key in spark.conf.getAll else None
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def first_rows(spark: SparkSession, n: int):
    """A block in which ``row_number() <= n`` keeps at most n rows of a group in each task before they are shuffled."""
    return setting(spark, _TOP_ROWS, str(n))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a written table in the shared folder; the shuffle files
    behind it are not needed any more and go with the write."""
    with setting(df.sparkSession, _CLEAN, "true"):
        return store.materialize(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the decimal id; a null id is hashed as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Identity of a document row: its id and 128 bits of its text.

    Rows that agree in both are copies of one row and share every decision;
    one id with two texts stays two documents.  The struct has no null
    field, so it can be an ordinary join key."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return F.struct(F.coalesce(F.col(id_col), F.lit(-(2 ** 63))).cast("long").alias("id"),
                    F.xxhash64(t).alias("h1"), F.xxhash64(F.lit("b"), t).alias("h2"))


def _perhaps(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, slot_bits: int) -> DataFrame:
    """``df`` with ``__perhaps``: whether the key's bit is set in the bit map of the wanted keys."""
    def slot(c):
        return F.pmod(F.xxhash64(c), F.lit(1 << slot_bits)) + 1
    maps = (wanted.select(slot(wanted_key).alias("s"))
            .groupBy(F.bitmap_bucket_number("s").alias("__bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("__map")))
    columns = df.columns
    at = F.bitmap_bit_position("__slot")
    byte = F.conv(F.hex(F.substring(F.col("__map"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    return (df.withColumn("__slot", slot(key)).withColumn("__bucket", F.bitmap_bucket_number("__slot"))
            .join(F.broadcast(maps), "__bucket", "left")
            .select(*[F.col(f"`{c}`") for c in columns], F.coalesce(bit, F.lit(False)).alias("__perhaps")))


def perhaps_among(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, slot_bits: int = 24) -> DataFrame:
    """Rows of ``df`` whose key may occur in ``wanted``, before an exact join.

    A bit map of fixed size (2 MB by default, whatever the input) is broadcast,
    so that texts without a partner stay where they are.  With more keys than
    it can tell apart it lets more rows through, never fewer."""
    return _perhaps(df, key, wanted, wanted_key, slot_bits).where("__perhaps").drop("__perhaps")


def surely_not_among(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, slot_bits: int = 24) -> DataFrame:
    """The rows that `perhaps_among` leaves out: none of their keys occurs in ``wanted``."""
    return _perhaps(df, key, wanted, wanted_key, slot_bits).where("not __perhaps").drop("__perhaps")
