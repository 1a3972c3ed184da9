"""Exact dedup by progressive refinement, with DataFrame operations only.

Three passes. Rows are parted by byte length; the prefix of those that share their length is hashed; the full
content of those that share length and prefix hash is hashed, and only these are grouped. Texts are equal when
identical after lower-casing A-Z.

Lengths are told apart modulo LENGTHS, so the table that says which are shared has a proven bound and is always
sent to all tasks. The table of shared prefixes grows with the duplicates: it is sent to all tasks while it is
small, else rows meet it by a shuffle, in which only texts that share their length travel. Each row's
way through the passes is the same in both.

Defined results: a null text counts as empty; of equal texts the row with the largest id stays (a
null id is the smallest), of rows that repeat id and text one stays; an empty table gives an empty
result; texts of any length are read whole; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.shared import ascii_lower, broadcast_if_small, require_columns, settle, settle_narrow, skew_safe_left_join, text_key

#: Characters of the prefix that the second step hashes.
PREFIX = 256
#: Byte lengths are told apart modulo this.
LENGTHS = 1 << 20


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """A row for each document: id, keep_id, group_size, kept, text_sha256, _text_key.

    ``text_sha256`` is null for rows that lengths or prefixes already set apart, unless ``hash_all``.
    Groups are counted before the shuffle, and hot groups come back to their rows by a broadcast of
    at most a thousand rows.
    """
    require_columns(docs, [id_col, text_col])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).alias("_n"))
    rows = rows.withColumn("_length", F.col("_n") % LENGTHS)
    lengths = settle_narrow(rows.groupBy("_length").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_length", F.lit(True).alias("_shared")))
    rows = rows.join(F.broadcast(lengths), "_length", "left").withColumn("_shared", F.coalesce("_shared", F.lit(False)))  # at most LENGTHS rows
    prefix = F.xxhash64(ascii_lower(F.substring("_text", 1, PREFIX)))
    open_ = rows.where("_shared").select("_n", prefix.alias("_ph")).groupBy("_n", "_ph").agg(F.count(F.lit(1)).alias("_c"))
    open_ = settle_narrow(open_.where("_c > 1").select("_n", "_ph", F.lit(True).alias("_open")))
    small = broadcast_if_small(open_)
    digest = F.sha2(ascii_lower(F.col("_text")), 256)
    key = F.xxhash64("_text")
    # Rows that lengths set apart get keys that meet nothing and spread evenly; their texts stay behind.
    parted = rows.select(
        "_id",
        F.when(F.col("_shared"), F.col("_n")).otherwise(F.lit(-1)).alias("_n"),
        F.when(F.col("_shared"), prefix).otherwise(key).alias("_ph"),
        key.alias("_text_key"),
        (digest if hash_all else F.when(F.col("_shared"), F.col("_text"))).alias("_content"),
    )
    met = parted.join(open_ if small is None else small, ["_n", "_ph"], "left").withColumn("_open", F.coalesce("_open", F.lit(False)))
    full = F.col("_content") if hash_all else F.when(F.col("_open"), F.sha2(ascii_lower(F.col("_content")), 256))
    hashed = settle(met.select("_id", "_open", "_text_key", full.alias("text_sha256"), F.monotonically_increasing_id().alias("_row")))
    groups = (
        hashed.where("_open")
        .groupBy("text_sha256")
        .agg(F.max(F.struct("_id", "_row")).alias("_best"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    met = skew_safe_left_join(hashed, groups, "text_sha256", "group_size", hashed.count())
    alone = F.col("_best").isNull()
    return met.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("_best._id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_best._row") == F.col("_row"))).alias("kept"),
        "text_sha256",
        "_text_key",
    )


__all__ = ["exact_dedup", "text_key"]
