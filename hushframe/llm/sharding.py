"""Proportional stratified interleaving of documents into shards (DataFrame functions only).

Rows are shuffled by a seeded hash within each source; a row's fractional rank is its place in that order over
the source's count; the order of all rows by fractional rank is cut into shards of equal counts, so each
shard has every source in the corpus's proportion.

Ranks are counted in two steps, so that neither a source nor the whole table meets in one task: small buckets
in rank order are counted, the counts are summed up to each bucket, and rows are numbered within their bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Rows that one bucket holds at most, about.
BUCKET_ROWS = 4_000


#: Buckets that are summed up in one task at most, about.
SUMMED = 4_096


def _placed(rows: DataFrame, group: list[str], bucket: str, order: list, name: str, label: str, coarse: Column) -> DataFrame:
    """rows with `name`: the place from 0 within the group, whose buckets follow each other and are each ordered by `order`.

    coarse: of a bucket, growing with it, the same for up to SUMMED of a group's buckets: sums go over those first and then over coarse ones.
    """
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("__n")).withColumn("__coarse", coarse)
    whole_group = group or [F.lit(0)]
    parts = counts.groupBy(*group, "__coarse").agg(F.sum("__n").alias("__sum"))
    ahead = Window.partitionBy(*whole_group).orderBy("__coarse").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(k).alias(f"__p_{k}") for k in group), F.col("__coarse").alias("__p"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"), F.sum("__sum").over(Window.partitionBy(*whole_group)).alias("__total"))
    before = Window.partitionBy(*group, "__coarse").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumn("__local", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"__p_{k}")) for k in group] + [F.col("__coarse") == F.col("__p")]
    starts, _ = shared.write_table(local.join(parts, same).select(*group, bucket, (F.col("__ahead") + F.col("__local")).alias("__before"), "__total"), label)
    within = Window.partitionBy(*group, bucket).orderBy(*order)
    keys = [*group, bucket]
    starts = starts.select(*(F.col(k).alias(f"__s_{k}") for k in keys), "__before", "__total")
    numbered = rows.withColumn("__row", F.row_number().over(within))
    return numbered.join(shared.small(starts), [F.col(k).eqNullSafe(F.col(f"__s_{k}")) for k in keys]).withColumn(name, F.col("__before") + F.col("__row") - 1).drop("__row", "__before", *(f"__s_{k}" for k in keys))


def interleave(docs: DataFrame, shards: int = 40, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each row of docs: doc_id, source, size, text_crc32, shard and slot (from 0, without gaps in a shard).

    Shards' row counts differ by one at most, and each source's count in a shard from its share by one and the source's part of
    all rows times the number of sources at most, as places are shared by sources of equal fractional rank.
    A null source is a source of its own; a null text counts as empty; an empty table gives an empty table.
    Equal rows are interchangeable. Only the columns named are read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        (F.octet_length(whole) + 16).cast("long").alias("size"),
        F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.crc32(F.encode(whole, "UTF-8")).cast("string"))).cast("binary")).alias("__key"),
    )
    rows, path = shared.write_table(rows, "sharding")
    total = rows.count()
    if not total:
        return rows.select("doc_id", "source", "size", "text_crc32", F.lit(0).cast("int").alias("shard"), F.lit(0).cast("long").alias("slot"))
    digits = max(0, math.ceil(math.log(total / BUCKET_ROWS, 16)))
    ranked = _placed(rows.withColumn("__bucket", F.substring("__key", 1, digits)), ["source"], "__bucket", ["__key", "doc_id", "text_crc32", "size"], "__rank", "ranks", F.substring("__bucket", 1, max(0, digits - 3)))
    ranked = ranked.withColumn("__share", (F.col("__rank") + 0.5) / F.col("__total"))
    buckets = max(1, total // BUCKET_ROWS)
    ranked, _ = shared.write_table(ranked.withColumn("__bucket", F.floor(F.col("__share") * buckets)).drop("__total", "__rank"), "ranked")
    placed = _placed(ranked, [], "__bucket", ["__share", "__key", "source", "doc_id", "text_crc32", "size"], "__place", "places", F.floor(F.col("__bucket") / SUMMED))
    # exact long division, not doubles
    shard = F.expr(f"cast((__place * {shards}L) div {total}L as int)")
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("__place") - first).select("doc_id", "source", "size", "text_crc32", "shard", "slot")
