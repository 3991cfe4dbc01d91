"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time t from 0 to 1, its target share times
1 + ramp * (2t - 1); the ramps cancel, so the shares sum to one at any time. Integrated, the schedule is the
source's cumulative token demand. Documents of a source lie in the order of a digest of their id, use after
use, on the line of its tokens; the place of a use on that line, put into the inverse of the cumulative
demand, is its training position. Sorting all uses by position by ranges gives the training order.

The total size is the largest at which every share is met without using a document more often than its
source allows. Running token sums are taken in digest buckets of at most BUCKET_ROWS documents on average,
so that a source that holds most rows is spread over many tasks.

Defined cases: source names compare trimmed and in lower case; null sources, null ids and null or empty texts
are left out; repeated rows of a document are one; targets of zero or null weight and targets without
documents get no share and are reported with 0; sources without target are not used; of several targets of
one source in a mixture the weights add and the least cap holds; a null cap means none, and if no source has a cap
the total is that of all tokens; an empty table gives no rows; texts are counted whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnworks.runtime import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BUCKET_ROWS = 50_000
STEEPEST = 0.8


def vocabulary(path: str) -> tuple[str, bytes]:
    """The pattern and the merges of a tokenizer, read on the driver alone; a few MB, whatever the corpus."""
    import public_tokenizers

    with open(path, "rb") as f:
        return public_tokenizers.PATTERN, f.read()


@lru_cache(maxsize=2)
def tokenizer(pattern: str, merges: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, merges.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens), one row per document. path: a vocabulary on the driver's machine; it is sent to the executors."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(*shared.value)
        for batch in batches:
            counts = pa.array([len(encoding.encode_ordinary(t)) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=["doc_id", "source", "tokens"])

    docs = documents.select("doc_id", F.lower(F.trim("source")).alias("source"), "text").filter("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL AND text <> ''")
    counted = spread(docs).mapInArrow(run, "doc_id long, source string, tokens long")
    return counted.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("x")).select("doc_id", "x.source", "x.tokens").filter("tokens > 0")


def _plan(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per mixture and target source: share, ramp, tokens to use. Its size is that of the targets."""
    held = counts.groupBy("source").agg(F.sum("tokens").alias("held"), F.avg("tokens").alias("mean"), F.count("*").alias("documents"))
    wanted = (
        targets.select("mix_name", F.lower(F.trim("source")).alias("source"), F.coalesce("target_weight", F.lit(0.0)).alias("weight"), "max_repeats")
        .groupBy("mix_name", "source").agg(F.sum("weight").alias("weight"), F.min("max_repeats").alias("cap"))
        .join(held, "source", "left").withColumn("held", F.coalesce("held", F.lit(0)))
        .withColumn("live", F.when((F.col("held") > 0) & (F.col("weight") > 0) & (F.coalesce("cap", F.lit(1)) > 0), F.col("weight")).otherwise(0.0))
    )
    mix = Window.partitionBy("mix_name")
    share = F.coalesce(F.col("live") / F.nullif(F.sum("live").over(mix), F.lit(0.0)), F.lit(0.0))
    all_weight = F.coalesce(F.col("weight") / F.nullif(F.sum("weight").over(mix), F.lit(0.0)), F.lit(0.0))
    rank = F.percent_rank().over(mix.orderBy(F.coalesce("mean", F.lit(0.0)), "source"))  # short documents early, long ones late
    planned = (
        wanted.withColumns({"share": share, "target_share": all_weight, "rank": rank})
        .withColumn("total", F.min(F.when((F.col("share") > 0) & F.col("cap").isNotNull(), F.col("held") * F.col("cap") / F.col("share"))).over(mix))
        .withColumn("total", F.coalesce("total", F.sum(F.when(F.col("share") > 0, F.col("held"))).over(mix)))
        .withColumn("lean", F.col("rank") - F.sum(F.col("share") * F.col("rank")).over(mix))
        .withColumn("ramp", F.coalesce(F.lit(STEEPEST) * F.col("lean") / F.nullif(F.max(F.when(F.col("share") > 0, F.abs("lean"))).over(mix), F.lit(0.0)), F.lit(0.0)))
    )
    return planned.withColumn("demand", F.coalesce(F.floor(F.col("share") * F.col("total")), F.lit(0).cast("long")))


def _placed(counts: DataFrame) -> DataFrame:
    """Each document with the tokens of its source that lie before it."""
    order = F.xxhash64("doc_id")
    buckets = max(1, -(-counts.count() // BUCKET_ROWS))
    rows = counts.withColumn("order", order).withColumn("bucket", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * buckets))
    sums = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum"))
    before = sums.withColumn("base", F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("local", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(before, ["source", "bucket"]).select("doc_id", "source", "tokens", (F.col("base") + F.col("local")).alias("start"))


def _uses(counts: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    plan = cut(_plan(counts, targets))
    live = plan.filter("demand > 0").select("mix_name", "source", "demand", "held", "ramp", "cap")
    last = F.floor((F.col("demand") - F.col("start") - 1) / F.col("held"))
    used = (
        _placed(counts).join(live, "source").withColumn("last", F.when(F.col("start") < F.col("demand"), F.least(last, F.coalesce(F.col("cap").cast("long") - 1, last))))
        .filter("last >= 0").withColumn("use_no", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    )
    c = (F.col("start") + F.col("use_no") * F.col("held") + F.col("tokens") / 2) / F.col("demand")
    c = F.least(c, F.lit(1.0))
    slope = 1 - F.col("ramp")
    # the root of ramp * t^2 + (1 - ramp) * t = c in [0, 1], in the form that is also good for a ramp of 0
    position = 2 * c / (slope + F.sqrt(slope * slope + 4 * F.col("ramp") * c))
    return plan, used.select("mix_name", "doc_id", "source", "tokens", (F.col("use_no") + 1).cast("int").alias("use_no"), position.alias("position"))


def training_order(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(mix_name, doc_id, source, tokens, use_no, position), sorted by mixture and position over all partitions."""
    _, used = _uses(cut(token_counts(documents, path)), targets)
    return used.orderBy("mix_name", "position", "doc_id", "use_no")


def reached_shares(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Per mixture and source: target and actual share, documents, uses, most uses of a document."""
    plan, used = _uses(cut(token_counts(documents, path)), targets)
    per_doc = used.groupBy("mix_name", "source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"))
    got = per_doc.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.sum("uses").alias("uses"), F.count("*").alias("used_documents"), F.max("uses").alias("most_uses"))
    zero = F.lit(0).cast("long")
    whole = F.sum(F.coalesce("tokens", zero)).over(Window.partitionBy("mix_name"))
    return plan.join(got, ["mix_name", "source"], "left").select(
        "mix_name", "source", "target_share", F.coalesce(F.coalesce("tokens", zero) / F.nullif(whole, zero), F.lit(0.0)).alias("actual_share"), F.col("cap").alias("max_repeats"),
        F.coalesce("tokens", zero).alias("tokens"), F.coalesce("used_documents", zero).alias("used_documents"), F.coalesce("uses", zero).alias("uses"), F.coalesce("most_uses", zero).alias("most_uses"),
    )
