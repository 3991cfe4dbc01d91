"""What changed between consecutive full deliveries, by subtracting invertible Bloom lookup tables.

Each delivery is reduced to one entry per key. Entries go to hash buckets of the key, one exchange brings the entries
of a bucket in all deliveries together, and everything else happens there, bucket by bucket, in arrays:

1. An odd sketch of 64 parities per pair of neighbouring deliveries estimates how many entries differ; unchanged
   ones cancel in it. The tables of the pair get cells for that many differences, not for all entries.
2. Every bucket of a delivery is an invertible Bloom lookup table (IBLT) of three sub-tables whose cells hold a
   count and the XOR of key digests, value digest and entry digest. The tables of both deliveries are subtracted, so
   unchanged entries cancel, and peeled: a cell of one entry whose digest is that of its keys and value gives it up.
3. A bucket whose cells are not all zero after peeling, or whose recovered entries do not have the digest and the
   number in which its two deliveries differ, is built again with four times the cells and another hash.

Recovered keys that occur with both signs are `changed`, with + only `added`, with - only `removed`. The result
is right up to collisions of 64-bit hashes.

Defined cases: a null key or delivery is not an entry and is left out; a null value is a value of its own;
equal order values are settled by the greater tie column, then the greater value digest; repeated rows
count once; an empty table, or a source with fewer than two deliveries, gives no rows; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUBTABLES = 3
LEAST_CELLS = 8  # of one sub-table; a power of two
BUCKET_ROWS = 64  # entries of one delivery aimed at in a bucket
AT_ONCE = 100_000  # entries of whole buckets that are searched together
CHANGES = "pair long, kd long, kd2 long, change_type string"
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def normalised_hash(c: Column) -> Column:
    """Content hashes compare trimmed, in lower case and without a leading `sha256:`."""
    return F.regexp_replace(F.lower(F.trim(c)), "^sha256:", "")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def entry_digests(kd: np.ndarray, kd2: np.ndarray, vd: np.ndarray, seed: int) -> np.ndarray:
    start = np.uint64((seed + 1) * int(_STEPS[0]) & 0xFFFFFFFFFFFFFFFF)
    return _mixed(_mixed(_mixed(kd + start) ^ kd2) ^ vd)


def _places(digests: np.ndarray, cells: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
    """The cell of each digest in every sub-table of its table. cells: of a sub-table, a power of two; base: its first cell."""
    shift = np.uint64(64) - np.log2(cells).astype(np.uint64)
    return [base + i * cells + ((digests * step) >> shift).astype(np.int64) for i, step in enumerate(_STEPS)]


def estimated_differences(table: np.ndarray, digests: np.ndarray, tables: int) -> np.ndarray:
    """By odd sketch: each table has 64 parities, in which entries of both sides cancel."""
    sketch = np.zeros(tables, np.uint64)
    np.bitwise_xor.at(sketch, table, np.uint64(1) << (digests >> np.uint64(58)))
    odd = np.minimum(np.bitwise_count(sketch), 31)  # half of the parities says no more than that there are many
    return np.ceil(-32 * np.log(1 - odd / 32)).astype(np.int64)


def recovered(table: np.ndarray, sign: np.ndarray, kd: np.ndarray, kd2: np.ndarray, vd: np.ndarray, tables: int, seed: int = 0, cells: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(table, sign, kd, kd2, vd) of the entries in which the two sides of each table differ. sign: 1 or -1, the side of an entry."""
    digests = entry_digests(kd, kd2, vd, seed)
    if cells is None:
        wanted = estimated_differences(table, digests, tables)
        cells = np.maximum(LEAST_CELLS, 1 << np.ceil(np.log2(np.maximum(wanted, 1))).astype(np.int64))
    base = np.append(0, np.cumsum(SUBTABLES * cells))
    count = np.zeros(base[-1], np.int64)
    sums = [np.zeros(base[-1], np.uint64) for _ in range(4)]

    def put(t: np.ndarray, s: np.ndarray, parts: tuple[np.ndarray, ...]) -> None:
        for at in _places(parts[3], cells[t], base[t]):
            np.add.at(count, at, s)
            for total, x in zip(sums, parts):
                np.bitwise_xor.at(total, at, x)

    put(table, sign, (kd, kd2, vd, digests))
    of_cell = np.repeat(np.arange(tables), SUBTABLES * cells)
    found = []
    todo = np.flatnonzero(np.abs(count) == 1)
    while len(todo):
        k, k2, v, e = (x[todo] for x in sums)
        t = of_cell[todo]
        pure = (np.abs(count[todo]) == 1) & (entry_digests(k, k2, v, seed) == e) & np.any([p == todo for p in _places(e, cells[t], base[t])], 0)
        _, first = np.unique(np.stack([t[pure].astype(np.uint64), e[pure]], 1), axis=0, return_index=True)
        t, s, parts = t[pure][first], count[todo][pure][first], tuple(x[pure][first] for x in (k, k2, v, e))
        if not len(t):
            break
        found.append((t, s, *parts))
        put(t, -s, parts)
        todo = np.unique(np.concatenate(_places(parts[3], cells[t], base[t])))
        todo = todo[np.abs(count[todo]) == 1]
    out = tuple(np.concatenate(x) for x in zip(*found)) if found else (table[:0], sign[:0], kd[:0], kd2[:0], vd[:0], digests[:0])
    # the digest and number in which the sides differ must be those of what was recovered
    left, number = np.zeros(tables, np.uint64), np.zeros(tables, np.int64)
    for t, s, e in ((table, sign, digests), (out[0], -out[1], out[5])):
        np.bitwise_xor.at(left, t, e)
        np.add.at(number, t, s)
    whole = (left == 0) & (number == 0)
    rest = (count != 0) | np.any([x != 0 for x in sums], 0)
    whole[of_cell[rest]] = False
    if whole.all():
        return out[:5]
    again = ~whole[table]
    more = recovered(table[again], sign[again], kd[again], kd2[again], vd[again], tables, seed + 1, np.where(whole, LEAST_CELLS, cells * 4))
    good = whole[out[0]]
    return tuple(np.concatenate([x[good], y]) for x, y in zip(out[:5], more))


def _bucket_batches(log: list[tuple[int, int]]):
    """Rows (bucket, delivery, kd, kd2, vd) sorted by bucket: the entries in which a delivery differs from the one before. log: (delivery, before)."""
    after: dict[int, list[int]] = {}
    for delivery, before in log:
        after.setdefault(before, []).append(delivery)
    number = {delivery: i for i, (delivery, _) in enumerate(log)}
    names = np.array([d for d, _ in log] or [0], np.int64)

    def searched(rows: list[np.ndarray]) -> pa.RecordBatch:
        bucket, delivery, *parts = rows
        known, which = np.unique(delivery, return_inverse=True)
        sides = [(1, np.array([number.get(int(d), -1) for d in known], np.int64))]
        most = max([0, *(len(after.get(int(d), ())) for d in known)])
        sides += [(-1, np.array([(number[after[int(d)][i]] if i < len(after.get(int(d), ())) else -1) for d in known], np.int64)) for i in range(most)]
        place, take, sign = [], [], []
        _, b = np.unique(bucket, return_inverse=True)
        for s, pair_of in sides:
            p = pair_of[which]
            held = np.flatnonzero(p >= 0)
            place.append(b[held] * len(names) + p[held])
            take.append(held)
            sign.append(np.full(len(held), s, np.int64))
        place, take = np.concatenate(place), np.concatenate(take)
        used, table = np.unique(place, return_inverse=True)
        t, s, kd, kd2, _ = recovered(table, np.concatenate(sign), *(x[take].view(np.uint64) for x in parts), len(used))
        # both entries of a key are in the table of its bucket, so its change is known here
        keys, of = np.unique(np.stack([t.astype(np.uint64), kd, kd2], 1), axis=0, return_inverse=True)
        newest, oldest = np.full(len(keys), -1), np.full(len(keys), 1)
        np.maximum.at(newest, of.reshape(-1), s)
        np.minimum.at(oldest, of.reshape(-1), s)
        kinds = np.where(newest == -1, "removed", np.where(oldest == 1, "added", "changed"))
        pairs = names[used[keys[:, 0].astype(np.int64)] % len(names)] if len(keys) else names[:0]
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(keys[:, 1].view(np.int64)), pa.array(keys[:, 2].view(np.int64)), pa.array(kinds.tolist(), pa.string())], names=["pair", "kd", "kd2", "change_type"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            if len(held[0]) < AT_ONCE:
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))  # the last bucket may go on
            if last:
                yield searched([x[:last] for x in held])
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield searched(held)

    return run


def snapshot_changes(rows: DataFrame, deliveries: DataFrame, *, key: str, value: Column, delivery: str, at: str, tie: str) -> DataFrame:
    """(pair, key, change_type) of each delivery against the one just before it in its series.

    rows: one row per observation; of the rows of a key in a delivery the one with the greatest (at, tie) counts.
    deliveries: (series, delivery, position), the complete deliveries only, by whole numbers. It is read to the driver: a row per run of a source.
    """
    order = Window.partitionBy("series").orderBy("position", "delivery")
    log = [tuple(r) for r in deliveries.select("delivery", F.lag("delivery").over(order).alias("before")).filter("before IS NOT NULL").collect()]
    seen = rows.select(
        F.col(key).alias("key"), value.alias("value"), F.col(delivery).alias("delivery"), F.col(at).alias("at"), F.col(tie).alias("tie")
    ).filter("key IS NOT NULL AND delivery IS NOT NULL")
    most = seen.groupBy("delivery").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-most // BUCKET_ROWS))
    entries = (
        seen.join(deliveries.select("delivery").distinct(), "delivery", "left_semi")
        .select(F.col("delivery").cast("long").alias("delivery"), "at", "tie", F.xxhash64("key").alias("kd"), F.xxhash64(F.lit("second"), "key").alias("kd2"), F.xxhash64("value").alias("vd"))
        .groupBy("delivery", "kd", "kd2")  # map-side combining first: a hot key shrinks to one row per task
        .agg(F.max(F.struct("at", "tie", "vd")).alias("last"))
        .select(F.pmod("kd", F.lit(buckets).cast("long")).alias("bucket"), "delivery", "kd", "kd2", F.col("last.vd").alias("vd"))
        .repartition("bucket").sortWithinPartitions("bucket")
    )
    changed = entries.mapInArrow(_bucket_batches(log), CHANGES)
    # a name for each digest: combined on the map side, and brought together by the digests that the join needs anyway
    named = seen.groupBy(F.xxhash64("key").alias("kd"), F.xxhash64(F.lit("second"), "key").alias("kd2")).agg(F.min("key").alias("key"))
    return changed.join(named, ["kd", "kd2"]).select("pair", "key", "change_type")


def complete_runs(runs: DataFrame) -> DataFrame:
    """(series, delivery, position) of the runs that finished with status ok."""
    ok = F.col("finished_at").isNotNull() & (F.lower(F.trim("status_message")) == "ok")
    return runs.filter(ok).select(F.col("source").alias("series"), F.col("id").alias("delivery"), F.col("started_at").alias("position"))


def offer_changes(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Added, removed and changed offers of every complete run against the one before it of its source."""
    return snapshot_changes(
        snapshots, complete_runs(runs), key="offer_url", value=normalised_hash(F.col("content_hash")), delivery="run_id", at="fetched_at", tie="id"
    ).select(F.col("pair").alias("run_id"), F.col("key").alias("offer_url"), "change_type")
