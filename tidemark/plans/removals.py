"""Removed rows as bit words: one row for up to 64 neighbouring row ids of a batch, with a bit for each that is gone.

Row ids count up within the task that wrote them, so a mass delete comes to a sixty-fourth of its rows. A word may be
listed more than once; reads test the bit, so nothing needs to be merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_KEY = ["_added_in", "_row_id"]
SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("_gone_in", "_gone_word", "_gone_mask")])


def words_of(keys: DataFrame) -> DataFrame:
    """The words that list these row keys; partial words are made before the shuffle."""
    bit = F.expr("shiftleft(1L, cast(_row_id & 63 as int))")
    return keys.groupBy(F.col("_added_in").alias("_gone_in"), F.shiftright("_row_id", 6).alias("_gone_word")).agg(
        F.bit_or(bit).alias("_gone_mask"))


def _hit():
    return (
        (F.col("_added_in") == F.col("_gone_in")) & (F.shiftright("_row_id", 6) == F.col("_gone_word"))
        & (F.expr("getbit(_gone_mask, cast(_row_id & 63 as int))") == 1)
    )


#: The same condition in SQL, between rows `r` and words `g`.
HIT_SQL = (
    "r._added_in = g._gone_in AND shiftright(r._row_id, 6) = g._gone_word "
    "AND getbit(g._gone_mask, CAST(r._row_id & 63 AS INT)) = 1"
)


def without(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Rows that no word lists."""
    return rows.join(words, _hit(), "left_anti")


def listed_in(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Rows that some word lists."""
    return rows.join(words, _hit(), "left_semi")


def keys_of(words: DataFrame) -> DataFrame:
    """The row keys that words list."""
    bits = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_bit")
    return words.select("*", bits).where("getbit(_gone_mask, _bit) = 1").select(
        F.col("_gone_in").alias("_added_in"), (F.col("_gone_word") * 64 + F.col("_bit")).alias("_row_id"))


def counted(words: DataFrame) -> tuple[dict[int, int], int]:
    """(rows listed by `_added_in`, number of words): one small line per snapshot that wrote any of them."""
    found = words.groupBy("_gone_in").agg(
        F.sum(F.bit_count("_gone_mask")).alias("n"), F.count("*").alias("words")).collect()
    return {r["_gone_in"]: r["n"] for r in found}, sum(r["words"] for r in found)
