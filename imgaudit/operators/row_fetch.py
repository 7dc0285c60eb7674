"""Rows of files picked by their positions, without moving a payload.

What is picked is decided on narrow columns: the file and the row number within it. Each 64
rows of a file are one word of bits, so even a dense choice is a small table. That table goes to
the readers, and wide rows are kept or dropped where they are read: no shuffle carries them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imgaudit.session import shared_dir, stored

#: Bytes of picked words that are sent to all readers at a time.
LIMIT = 128 << 20
ROW_BYTES = 64  # of a word in a hash table, besides the file's name


def _word(row: Column) -> Column:
    return F.shiftright(row.cast("long"), 6)


def _bit(row: Column) -> Column:
    return F.pmod(row.cast("long"), F.lit(64)).cast("int")


def picked_words(picked: DataFrame, file: str, row: str, tags: Sequence[str] = ()) -> DataFrame:
    """One row per file, run of 64 rows and tags: ``_word``, and the picked ones as ``_bits``."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col(row)))
    return picked.groupBy(F.col(file).alias("_file"), _word(F.col(row)).alias("_word"), *tags).agg(
        F.bit_or(one).alias("_bits"))


def fetch(rows: DataFrame, picked: DataFrame, address: tuple[str, str] = ("file", "row_index"),
          limit: int = LIMIT) -> DataFrame:
    """The wide rows at the picked addresses, with the other columns of ``picked`` added.

    ``rows`` must be read from files, one row per address, as ``scan_shards`` gives them. The
    picked words are stored and their size is taken first: up to ``limit`` they are broadcast
    as a whole. Beyond, files are dealt into so many rounds that each round's words stay within
    it on average, every round reads only its own files, and its rows are written to the shared
    folder before the next one starts. A row of ``picked`` whose file or number is null, or
    that names no row, gives nothing; one that occurs twice counts once.
    """
    spark = rows.sparkSession
    file, row = address
    tags = [c for c in picked.columns if c not in address]
    known = picked.filter(F.col(file).isNotNull() & F.col(row).isNotNull())
    words = stored(picked_words(known, file, row, tags), "picked")
    size = words.agg(F.sum(F.octet_length("_file") + ROW_BYTES)).first()[0] or 0
    rounds = max(1, -(-size // limit))

    def kept(side: DataFrame, part: DataFrame) -> DataFrame:
        there = ((F.col(file) == F.col("_file")) & (_word(F.col(row)) == F.col("_word"))
                 & (F.call_function("getbit", F.col("_bits"), _bit(F.col(row))) == 1))
        return side.join(F.broadcast(part), there).select(*side.columns, *tags)

    if rounds == 1:
        return kept(rows, words)
    path = shared_dir(spark, "fetched")
    for r in range(rounds):
        own = [F.pmod(F.xxhash64(c), F.lit(rounds)) == r for c in (file, "_file")]
        part = kept(rows.filter(own[0]), words.filter(own[1]))
        part.write.mode("append").parquet(path)
    return spark.read.schema(part.schema).parquet(path)
