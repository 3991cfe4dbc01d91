"""Near-duplicate records: a MinHash LSH forest whose prefixes are shortened until the target recall, then an exact check.

A text is the set of its sequences of n consecutive words. Rows with the same text are one class; the forest
holds one representative of each. A tree of the forest is a sorted prefix trie: a number per representative
made of its min-hashes in the order of the tree, sorted, so that the members of a trie node stand in a row.
Two texts meet in a node of depth d with a chance of similarity ** d. The prefix is shortened until a pair of
just the wanted similarity meets in some tree with the target chance; every more similar pair then meets
with a greater one, so no average over the pairs enters.

How short that is depends on the number of trees (`levels`): few trees need short prefixes, whose nodes may
be crowded; more trees reach the same chance with longer ones. Each representative takes the first level at
which all its nodes hold at most CROWD members. A pair with at least one representative that is not crowded
at a level is found there, as all nodes of that one are searched whole; pairs of crowded ones are sought
among the crowded at the next level. Nodes of the last level are searched whole whatever their size, in
blocks of CROWD members, each pair of blocks by itself.

Within a node, pairs pass a test of 2-bit min-hashes before they leave the task, then one of further bits;
both thresholds lie 4.5 standard deviations below the wanted similarity. The texts of what is left are
compared word by word. The trees are taken in blocks, and the shuffle files of a block are removed when its
pairs are kept, so disk holds one block at a time.

Defined cases: rows with a null key or a null text never take part; a text of fewer than n words is one
sequence; a text without words takes no part; equal texts are pairs; repeated rows of a key give no pair of
the key with itself; an empty table gives no rows; other columns are ignored; texts are read whole, however
long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnworks.llm.textforms import canonical, words
from cairnworks.runtime import cut, cut_freed

TARGET_RECALL = 0.9995
FEW_TREES, MOST_TREES = 64, 512  # of the first and of the last level
CROWD = 2048  # members of a node
BLOCK_TREES = 19  # of the forest on disk at once
PREFIX_BITS = 54  # of a node's number; the tree has those above
NEAR, FAR = 192, 384  # min-hashes of the first sketch, two bits of each, and of the second, one bit of each
MANY_IN_A_BATCH = 8  # rows of a node in one batch, from which its total is counted before the shuffle


@lru_cache(maxsize=4)
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240607)
    both = draw.integers(0, 1 << 32, (count, 2), dtype=np.uint32)
    return both[:, 0] | np.uint32(1), both[:, 1].copy()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct sequences of n words of a text, as sorted 64-bit digests."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = words(canonical(text))
        if not found:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > 500_000:
            known.clear()
        codes = np.fromiter((known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w) | 1) for w in found), np.uint64, len(found))
        n = min(self.n, len(codes))
        total = np.full(len(codes) - n + 1, n, np.uint64)
        for i in range(n):
            total = _mixed(total ^ codes[i : len(codes) - n + 1 + i])
        return np.unique(total)


def min_hashes(shingles: np.ndarray, count: int) -> np.ndarray:
    a, b = _functions(count)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), 64):
        np.minimum(least, (x[i : i + 64, None] * a + b).min(0), out=least)
    return least


def chance(similarity: float, depth: int, trees: int) -> float:
    """Of a pair to meet in at least one tree."""
    return 1 - (1 - similarity**depth) ** trees


def trees_needed(threshold: float, depth: int, target: float) -> int:
    """The fewest trees in which a pair of just this similarity meets at this depth with the target chance."""
    return 1 if threshold >= 1 else math.ceil(math.log(1 - target) / math.log(1 - threshold**depth))


def levels(threshold: float, target: float) -> list[tuple[int, int]]:
    """(depth, trees): the longest prefix that FEW_TREES allow, then one longer at a time up to MOST_TREES."""
    found = [(d, trees_needed(threshold, d, target)) for d in range(1, PREFIX_BITS // 9 + 1)]
    first = max((d for d, t in found if t <= FEW_TREES), default=None)
    if first is None:
        raise ValueError(f"{FEW_TREES} trees cannot find pairs at a similarity of {threshold} with a chance of {target}")
    return [(d, t) for d, t in found if d >= first and t <= MOST_TREES]


def node_numbers(hashes: np.ndarray, depth: int, trees: int) -> np.ndarray:
    """Per row of min-hashes the node of every tree at this depth: the tree, then a few bits of each min-hash in order."""
    bits = PREFIX_BITS // depth
    numbers = np.arange(trees, dtype=np.int64) << np.int64(PREFIX_BITS)
    for i in range(depth):
        part = (hashes[:, i * trees : (i + 1) * trees] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
        numbers = numbers | (part.astype(np.int64) << np.int64(bits * (depth - 1 - i)))
    return numbers


def sketches(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first sketch as two planes of bits, and the second."""
    def packed(x: np.ndarray, bit: int) -> np.ndarray:
        return np.packbits((x >> np.uint32(bit)).astype(np.uint8) & 1, axis=1).view(np.int64)

    near, far = hashes[:, :NEAR], hashes[:, NEAR : NEAR + FAR]
    return np.concatenate([packed(near, 7), packed(near, 11)], 1), packed(far, 7)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def _signature_batches(n: int, depth: int, trees: int):
    count = max(NEAR + FAR, depth * trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(n)
        for batch in batches:
            sets = [of(t) for t in batch.column(1).to_pylist()]
            keep = [i for i, s in enumerate(sets) if len(s)]
            hashes = np.array([min_hashes(sets[i], count) for i in keep]) if keep else np.empty((0, count), np.uint32)
            near, far = sketches(hashes)
            rows = pa.array(keep, pa.int64())
            sizes = pa.array([len(sets[i]) for i in keep], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(rows) for i in (0, *range(2, batch.num_columns))), sizes, _lists(node_numbers(hashes, depth, trees)), _lists(near), _lists(far)],
                names=["key", *batch.schema.names[2:], "n", "nodes", "near", "far"],
            )

    return run


def _largest_difference(threshold: float, values: int, bits: int) -> float:
    """Of values of so many bits that all but one in 300,000 pairs of this similarity keep within."""
    p = threshold + (1 - threshold) / 2**bits
    return values * (1 - p) + 4.5 * (values * p * (1 - p)) ** 0.5


def _near_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the first sketches of the pairs are near enough. a, b: pairs x longs."""
    half, off = a.shape[1] // 2, 0
    for i in range(half):
        differing = (a[:, i] ^ b[:, i]) | (a[:, i + half] ^ b[:, i + half])
        off = off + np.bitwise_count(differing.view(np.uint64)).astype(np.int16)  # of signed numbers it counts the absolute value
    return off <= _largest_difference(threshold, NEAR, 2)


def _all_pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i before j, of all pairs within each run, about a million at a time."""
    first = np.repeat(starts, sizes) + _counted(sizes)
    left = np.repeat(sizes, sizes) - _counted(sizes) - 1
    at = 0
    ends = np.cumsum(left)
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 1_000_000)))
        i = np.repeat(first[at:to], left[at:to])
        yield i, i + 1 + _counted(left[at:to])
        at = to


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0 ... size - 1 of each size, in a row."""
    total = np.cumsum(sizes)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - sizes, sizes)


def _pair_batch(ids: np.ndarray, x: list[np.ndarray], y: list[np.ndarray], crowded: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct pairs of ids with the smaller one first; the ids of crowded nodes stand beside a null."""
    none = np.empty(0, np.int64)
    a, b = np.concatenate([none, *x]), np.concatenate([none, *y])
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    alone = np.unique(np.concatenate([none, *crowded]))
    second = pa.concat_arrays([pa.array(both[:, 1]), pa.nulls(len(alone), pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([both[:, 0], alone])), second], names=["a", "b"])


def _node_batches(threshold: float, crowd: int):
    """Rows (node, id, first sketch) sorted by node: the near pairs of each node, or all its members if it is crowded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None  # the rows of the last node, which may go on
        over = None  # the node known to be crowded
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes, ids, sketch = batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.stack([batch.column(i).to_numpy() for i in range(2, batch.num_columns)], 1)
            crowded = []
            if over is not None:
                same = int(np.searchsorted(nodes, over, side="right"))
                crowded.append(ids[:same])
                nodes, ids, sketch = nodes[same:], ids[same:], sketch[same:]
                over = over if not len(nodes) else None
            if held is not None:
                nodes, ids, sketch = np.append(held[0], nodes), np.append(held[1], ids), np.concatenate([held[2], sketch])
                held = None
            if len(nodes):
                last = int(np.searchsorted(nodes, nodes[-1]))
                if len(nodes) - last > crowd:
                    over = nodes[-1]
                    crowded.append(ids[last:])
                else:
                    held = nodes[last:], ids[last:], sketch[last:]
                nodes, ids, sketch = nodes[:last], ids[:last], sketch[:last]
            yield _searched(nodes, ids, sketch, threshold, crowd, crowded)
        if held is not None:
            yield _searched(*held, threshold, crowd, [])

    return run


def _searched(nodes: np.ndarray, ids: np.ndarray, sketch: np.ndarray, threshold: float, crowd: int, crowded: list[np.ndarray]) -> pa.RecordBatch:
    x, y = [], []
    if len(nodes):
        starts = np.flatnonzero(np.append(True, nodes[1:] != nodes[:-1]))
        sizes = np.diff(np.append(starts, len(nodes)))
        for s, n in zip(starts[sizes > crowd], sizes[sizes > crowd]):
            crowded.append(ids[s : s + n])
        some = (sizes > 1) & (sizes <= crowd)
        for i, j in _all_pairs(starts[some], sizes[some]):
            near = _near_pairs(sketch[i], sketch[j], threshold)
            x.append(ids[i[near]])
            y.append(ids[j[near]])
    return _pair_batch(ids, x, y, crowded)


def _many_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that many rows of one batch share, with their number."""
    for batch in batches:
        nodes, counts = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        many = counts >= MANY_IN_A_BATCH
        yield pa.RecordBatch.from_arrays([pa.array(nodes[many]), pa.array(counts[many])], names=["node", "n"])


def _spread(reps: DataFrame, trees: range) -> DataFrame:
    """(node, id, sketch) of these trees."""
    own = F.slice("nodes", trees[0] + 1, len(trees))
    return reps.select(F.explode(own).alias("node"), "id", *[F.col("near")[i].alias(f"s{i}") for i in range(NEAR // 32)])


def _in_nodes(rows: DataFrame) -> DataFrame:
    """The rows of nodes of two members and more, sorted by node, all of a node in one task.

    A window asks for that, which no plan may undo. repartition does not: behind a join by node it is dropped, and the
    join's own exchange may then be read by mapper, or a skewed part of it in pieces, which tears nodes apart.
    """
    return rows.withColumn("members", F.count("*").over(Window.partitionBy("node"))).filter("members > 1").drop("members")


def _level_pairs(reps: DataFrame, trees: int, threshold: float, crowd: int) -> DataFrame:
    """(a, b) near pairs of nodes that are not crowded; (id, null) the members of those that are."""
    # nodes that are sure to be crowded never reach one task: rows of a batch are counted first, so at most rows * trees / MANY_IN_A_BATCH of these move
    hot = cut(reps.select("nodes").mapInArrow(_many_batches, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).filter(F.col("n") > crowd).select("node"))
    some_hot, found = not hot.isEmpty(), []
    for block in [range(i, min(i + BLOCK_TREES, trees)) for i in range(0, trees, BLOCK_TREES)]:
        rows = _spread(reps, block)
        others = rows.join(hot, "node", "left_anti") if some_hot else rows
        pairs = _in_nodes(others).mapInArrow(_node_batches(threshold, crowd), "a long, b long")
        if some_hot:
            pairs = pairs.unionByName(rows.join(hot, "node").select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b")))
        found.append(cut_freed(pairs.distinct()))
    return reduce(DataFrame.unionByName, found)


def _block_batches(threshold: float):
    """Rows (node, id, sketch, block, first block, second block) sorted by the pair of blocks: near pairs between the two, or within the one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = NEAR // 32
        kept = np.empty((0, width + 5), np.int64)

        def searched(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            group = rows[:, [0, width + 3, width + 4]]
            starts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(1))) if len(rows) else []
            for s, e in zip(starts, np.append(starts[1:], len(rows)) if len(starts) else []):
                own = rows[s:e]
                left = own[own[:, width + 2] == own[0, width + 3]]
                right = own[own[:, width + 2] == own[0, width + 4]]
                x, y = [], []
                for r in left:
                    ahead = right[right[:, 1] > r[1]] if own[0, width + 3] == own[0, width + 4] else right
                    near = ahead[_near_pairs(np.broadcast_to(r[2 : width + 2], (len(ahead), width)), ahead[:, 2 : width + 2], threshold)] if len(ahead) else ahead
                    x.append(np.full(len(near), r[1]))
                    y.append(near[:, 1])
                yield _pair_batch(own[:, 1], x, y, [])

        for batch in batches:
            rows = np.concatenate([kept, np.stack([batch.column(i).to_numpy() for i in range(width + 5)], 1)])
            if not len(rows):
                continue
            others = np.flatnonzero((rows[:, [0, width + 3, width + 4]] != rows[-1, [0, width + 3, width + 4]]).any(1))
            last = int(others[-1]) + 1 if len(others) else 0  # the last pair of blocks may go on
            yield from searched(rows[:last])
            kept = rows[last:]
        yield from searched(kept)

    return run


def _last_pairs(reps: DataFrame, trees: int, threshold: float, crowd: int) -> DataFrame:
    """(a, b) of all nodes; a node of more than `crowd` members is cut into blocks, and every pair of blocks is a task of its own."""
    found = []
    for block in [range(i, min(i + BLOCK_TREES, trees)) for i in range(0, trees, BLOCK_TREES)]:
        rows = _spread(reps, block)
        large = cut(rows.groupBy("node").count().filter(F.col("count") > crowd).select("node", F.ceil(F.col("count") / (crowd // 2)).cast("long").alias("blocks")))
        small = _in_nodes(rows.join(large, "node", "left_anti"))
        halved = rows.join(large, "node").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        sent = halved.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        order = [F.col("node"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
        paired = sent.select("node", "id", *[f"s{i}" for i in range(NEAR // 32)], "block", *order[1:]).repartition("node", "lo", "hi").sortWithinPartitions("node", "lo", "hi")
        both = small.mapInArrow(_node_batches(threshold, crowd), "a long, b long").unionByName(paired.mapInArrow(_block_batches(threshold), "a long, b long"))
        found.append(cut_freed(both.distinct()))
    return reduce(DataFrame.unionByName, found)


def _compare_batches(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(maxsize=2000)(Shingler(n))
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = of(x), of(y)
                common = len(np.intersect1d(p, q, assume_unique=True))
                near.append(common / max(len(p) + len(q) - common, 1))
            keep = pa.array(np.array(near, float) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(near, pa.float64()).filter(keep)], names=["a", "b", "jaccard"])

    return run


def _sketched(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ka, kb, ca, cb) of the pairs whose sizes and second sketches allow the similarity."""
    sides = reps.select("id", "key", "class", "n", "far")
    off = sum((F.bit_count(F.col("fa")[i].bitwiseXOR(F.col("fb")[i])) for i in range(FAR // 64)), F.lit(0))
    near = (F.col("na") >= F.lit(threshold) * F.col("nb")) & (F.col("nb") >= F.lit(threshold) * F.col("na"))
    return (
        pairs.join(sides.toDF("a", "ka", "ca", "na", "fa"), "a").join(sides.toDF("b", "kb", "cb", "nb", "fb"), "b")
        .filter(near & (off <= _largest_difference(threshold, FAR, 1))).select("a", "b", "ka", "kb", "ca", "cb")
    )


def _verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs whose texts are at least that similar."""
    held = pairs.join(texts.toDF("ka", "ca", "xa"), ["ka", "ca"]).join(texts.toDF("kb", "cb", "xb"), ["kb", "cb"]).select("a", "b", "xa", "xb")
    return held.mapInArrow(_compare_batches(n, threshold), "a long, b long, jaccard double").distinct()


SIGNED = "n int, nodes array<long>, near array<long>, far array<long>"


def near_duplicates(
    rows: DataFrame, key: str, text: Column, *, n: int = 5, threshold: float = 0.8, target: float = TARGET_RECALL, crowd: int = CROWD
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership (key, class); representatives (class, id); links (a, b, jaccard) between their ids."""
    of_class = F.unhex(F.concat(F.lpad(F.hex(F.xxhash64("text")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), "text")), 16, "0")))
    texts = rows.select(F.col(key).alias("key"), text.alias("text")).filter("key IS NOT NULL AND text IS NOT NULL").select("key", of_class.alias("class"), "text")
    leaders = texts.groupBy("class").agg(F.min(F.struct("key", "text")).alias("x")).select("x.key", "x.text", "class")
    steps = levels(threshold, target)
    signed = leaders.mapInArrow(_signature_batches(n, *steps[0]), f"key string, class binary, {SIGNED}")
    reps = all_reps = cut_freed(signed.withColumn("id", F.monotonically_increasing_id()))
    passed = []
    for at, (depth, trees) in enumerate(steps):
        if at:
            ahead = reps.join(texts, ["key", "class"]).groupBy("id").agg(F.first("key").alias("key"), F.first("class").alias("class"), F.first("text").alias("text")).select("key", "text", "class", "id")
            reps = cut_freed(ahead.mapInArrow(_signature_batches(n, depth, trees), f"key string, class binary, id long, {SIGNED}"))
        if at == len(steps) - 1:
            passed.append(_last_pairs(reps, trees, threshold, crowd))
            break
        found = _level_pairs(reps, trees, threshold, crowd)
        passed.append(found.filter("b IS NOT NULL"))
        crowded = found.filter("b IS NULL").select(F.col("a").alias("id")).distinct()
        if crowded.isEmpty():
            break
        reps = reps.join(crowded, "id", "left_semi").select("id", "key", "class")
    pairs = reduce(DataFrame.unionByName, passed).distinct()
    links = cut_freed(_verified(_sketched(pairs, all_reps, threshold), texts, n, threshold))
    return texts.select("key", "class").distinct(), all_reps.select("class", "id"), links


def near_duplicate_pairs(rows: DataFrame, key: str, text: Column, **settings) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of all rows that are near-duplicates, copies included."""
    members, reps, links = near_duplicates(rows, key, text, **settings)
    holders = members.join(reps, "class").select("key", "id")
    across = (
        links.select("a", "b").join(holders.toDF("ka", "a"), "a").join(holders.toDF("kb", "b"), "b")
        .select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b"))
    )
    copied = holders.groupBy("id").count().filter("count > 1").select("id")
    copies = holders.join(copied, "id", "left_semi").select("key", "id")
    within = copies.toDF("key_a", "id").join(copies.toDF("key_b", "id"), "id").filter("key_a < key_b").select("key_a", "key_b")
    return across.unionByName(within).filter("key_a <> key_b").distinct()


def connected(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, root): the least id that links (a, b) lead to. Each round every id takes the least root of its neighbours, then the root of its root."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")))
    for _ in range(most_rounds):
        heard = both.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("heard"))
        closer = roots.join(heard, "id").select("id", F.col("root").alias("before"), F.least("root", "heard").alias("root"))
        jumped = closer.join(closer.select(F.col("id").alias("root"), F.col("root").alias("further")), "root", "left")
        after = cut_freed(jumped.select("id", "before", F.least("root", F.coalesce("further", "root")).alias("root")))
        roots = after.select("id", "root")
        if after.filter("root <> before").isEmpty():
            return roots
    raise RuntimeError("the links are longer than the rounds reach")


def near_duplicate_classes(rows: DataFrame, key: str, text: Column, **settings) -> DataFrame:
    """One row per record: (key, class_id, group_id, copies, links).

    class_id: the least key of the records of one text; group_id: that of the classes that links lead to from each
    other; copies: records of the class; links: those of its class to other classes.
    """
    members, reps, links = near_duplicates(rows, key, text, **settings)
    both = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("links"))
    sizes = members.groupBy("class").agg(F.count("*").alias("copies"), F.min("key").alias("class_id"))
    grouped = reps.join(sizes, "class").join(connected(links), "id", "left").select("class", "id", "copies", "class_id", F.coalesce("root", "id").alias("root"))
    names = grouped.groupBy("root").agg(F.min("class_id").alias("group_id"))
    return (
        members.join(grouped.join(names, "root"), "class").join(both, "id", "left")
        .select("key", "class_id", "group_id", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    )
