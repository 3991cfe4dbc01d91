"""Type-two history of entity attributes from periodic snapshots or updates.

`scd2_merge` compares the attribute digest of every observation with the version current at its time,
closes a version where the digest changes and opens a new one. A whole log is the merge into an empty
dimension; a later batch merges into the versions already kept, with the same result. Kept versions do not
tell when they were seen between their borders, so a key with a row at or before the last time it was seen is
rebuilt from the log of earlier observations; without that log such a batch is refused.

The work is spread so that no task holds the whole timeline of a key. Keys with more than HOT_ROWS
observations, of which there can be at most rows/HOT_ROWS, are cut into time blocks, and blocks that still hold
more into as many shorter ones as they hold that number, four times over; all other keys are one block. Changes are found within each block, a summary row per block carries the last digest, the running
version number and the next start across block borders, and is joined back to the block's versions.

Defined cases: rows with a null key or time are left out; a null attribute is a value of its own; rows of
equal time follow the tie column, then the digest; repeated rows change nothing; an empty table gives no
rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnworks.operators.snapshot_diff import normalised_hash
from cairnworks.runtime import cut

HOT_ROWS = 100_000
HOT_BLOCK_US = 6 * 3600 * 1_000_000
OPEN = -1


def _blocked(rows: DataFrame) -> DataFrame:
    """rows with their block, by the time it begins; keys of few rows have one. Only rows of hot keys are counted by block."""
    hot = cut(rows.groupBy("key").count().filter(F.col("count") > HOT_ROWS).select("key", F.lit(True).alias("hot")))
    if hot.isEmpty():
        return rows.withColumn("block", F.lit(0).cast("long"))
    start = F.floor(F.col("at_us") / F.lit(HOT_BLOCK_US)) * F.lit(HOT_BLOCK_US)
    coarse = rows.join(hot, "key", "left").withColumn("coarse", F.when(F.col("hot"), start).otherwise(F.lit(0)).cast("long"))
    parts = F.ceil(F.col("count") / F.lit(HOT_ROWS)) * 4
    dense = rows.join(hot, "key", "left_semi").groupBy("key", start.cast("long").alias("coarse")).count().filter(F.col("count") > HOT_ROWS)
    width = dense.select("key", "coarse", F.greatest(F.floor(F.lit(HOT_BLOCK_US) / parts), F.lit(1)).cast("long").alias("width"))
    fine = F.col("coarse") + F.floor((F.col("at_us") - F.col("coarse")) / F.col("width")) * F.col("width")
    return coarse.join(width, ["key", "coarse"], "left").withColumn("block", F.when(F.col("width").isNotNull(), fine).otherwise(F.col("coarse")).cast("long")).drop("hot", "coarse", "width")


def _versions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Heads: the first row of each run of equal digests within a block. Summary: one row per block with what crosses its borders."""
    inside = Window.partitionBy("key", "block").orderBy("at_us", "tie", "digest")
    heads = (
        rows.withColumn("seen_us", F.max("seen_us").over(Window.partitionBy("key", "block")))
        .withColumn("before", F.lag("digest").over(inside))
        .filter("before IS NULL OR before <> digest")
        .withColumn("n", F.row_number().over(inside))
        .withColumn("next_us", F.lead("at_us").over(inside))
        .select("key", "block", "at_us", "digest", "n", "next_us", "seen_us")
    )
    blocks = heads.groupBy("key", "block").agg(
        F.min_by("digest", "n").alias("first_digest"), F.max_by("digest", "n").alias("last_digest"), F.max("n").alias("heads"),
        F.min("at_us").alias("first_us"), F.min_by("next_us", "n").alias("second_us"),
        F.max("seen_us").alias("seen_us"),
    )
    by_time = Window.partitionBy("key").orderBy("block")
    blocks = (
        blocks.withColumn("drop_first", F.coalesce(F.lag("last_digest").over(by_time) == F.col("first_digest"), F.lit(False)))
        .withColumn("opens_us", F.when(F.col("drop_first"), F.col("second_us")).otherwise(F.col("first_us")))
        .withColumn("kept", F.col("heads") - F.col("drop_first").cast("int"))
        .withColumn("offset", F.coalesce(F.sum("kept").over(by_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("after_us", F.first("opens_us", ignorenulls=True).over(by_time.rowsBetween(1, Window.unboundedFollowing)))
        .withColumn("seen_us", F.max("seen_us").over(Window.partitionBy("key")))
        .select("key", "block", "drop_first", "offset", "heads", "after_us", "seen_us")
    )
    return heads.drop("seen_us"), blocks


def scd2_merge(observations: DataFrame, *, key: str, attributes: Column, at_us: Column, tie: Column, entities: DataFrame | None = None, current: DataFrame | None = None, log: DataFrame | None = None) -> DataFrame:
    """Versions (key, version_no, valid_from_us, valid_to_us, digest, seen_us); valid_to_us is OPEN for the open version.

    seen_us is the last observed time of the key.
    current: versions kept from earlier merges, same columns; its rows take part as observations at their start.
    log: the observations of earlier merges, columns as in observations; read for keys with rows that arrive late only.
    entities: optional (key, opened_us, closed_us), unique by key: an earlier start of version 1 and the end of the last.
    """
    def observed(df: DataFrame) -> DataFrame:
        return df.select(F.col(key).alias("key"), at_us.alias("at_us"), tie.alias("tie"), F.xxhash64(attributes).alias("digest"), at_us.alias("seen_us"))

    rows = observed(observations)
    if current is not None:
        seen = current.groupBy("key").agg(F.max("seen_us").alias("kept_us"))
        late = rows.join(seen, "key").filter("at_us <= kept_us").select("key").distinct()
        if log is not None:
            rows = rows.unionByName(observed(log).join(late, "key", "left_semi"))
            current = current.join(late, "key", "left_anti")
        elif not late.isEmpty():
            raise ValueError("rows at or before the last time their key was seen need the log of earlier observations")
        rows = rows.unionByName(current.select("key", F.col("valid_from_us").alias("at_us"), (F.col("version_no") - F.lit(1 << 40)).alias("tie"), "digest", "seen_us"))
    heads, blocks = _versions(_blocked(rows.filter("key IS NOT NULL AND at_us IS NOT NULL")))
    if entities is None:
        blocks = blocks.withColumns({"opened_us": F.lit(None).cast("long"), "closed_us": F.lit(None).cast("long")})
    else:
        blocks = blocks.join(entities.select("key", "opened_us", "closed_us"), "key", "left")
    version_no = (F.col("n") - F.col("drop_first").cast("int") + F.col("offset")).cast("int")
    return (
        heads.join(blocks, ["key", "block"])
        .filter("NOT (drop_first AND n = 1)")
        .select(
            "key", version_no.alias("version_no"),
            F.when(version_no == 1, F.least("at_us", "opened_us")).otherwise(F.col("at_us")).alias("valid_from_us"),
            F.coalesce("next_us", "after_us", "closed_us", F.lit(OPEN).cast("long")).alias("valid_to_us"),
            "digest", "seen_us",
        )
    )


def offer_history(snapshots: DataFrame, offers: DataFrame) -> DataFrame:
    """Every version of every offer; the last one ends when the offer was last seen, if it is gone."""
    gone = F.col("last_seen_status").isin("missing", "unavailable")
    entities = offers.select(
        F.col("url").alias("key"), F.unix_micros("first_seen_at").alias("opened_us"), F.when(gone, F.unix_micros("last_seen_at")).alias("closed_us")
    )
    return scd2_merge(
        snapshots, key="offer_url", attributes=normalised_hash(F.col("content_hash")), at_us=F.unix_micros("fetched_at"), tie=F.col("id"), entities=entities
    ).select(F.col("key").alias("offer_url"), "version_no", "valid_from_us", "valid_to_us")
