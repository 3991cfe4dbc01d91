"""Evaluation passages inside a corpus, by pigeonhole edit matching.

A passage is a window of `span` words of a test item. With a budget of k edited words it is cut into k + 1
pieces; a text within the budget holds at least one piece unchanged. Piece digests of all passages are
looked up in rolling digests of the corpus text; around each hit Myers' bit-parallel distance over words
gives the fewest edits of the passage. The corpus is read once per block of test items and nothing is shuffled.

The test items are split into blocks of about BLOCK_WORDS words, so the index of pieces, built once per block and sent to
the executors, is bounded; the corpus is read once per block.

Defined cases: null keys and null or empty texts are left out; items of fewer than `span` words never leak;
repeated documents or items give one row each; an empty table gives no rows; other columns are ignored;
texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.llm.textforms import words
from cairnworks.runtime import spread

SPAN = 13
BLOCK_WORDS = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def fewest_edits(patterns: np.ndarray, texts: np.ndarray, budget: int) -> np.ndarray:
    """Myers' algorithm for many pairs at once: the least edit distance of each pattern to any stretch of its text, budget + 1 at most.

    patterns: pairs x m word codes, m under 64; texts: pairs x length.
    """
    m = patterns.shape[1]
    one = np.uint64(1)
    bit = one << np.arange(m, dtype=np.uint64)
    full, high = np.uint64((1 << m) - 1), np.uint64(1 << (m - 1))
    pv, mv = np.full(len(patterns), full, np.uint64), np.zeros(len(patterns), np.uint64)
    score, best = np.full(len(patterns), m), np.full(len(patterns), budget + 1)
    for j in range(texts.shape[1]):
        eq = ((patterns == texts[:, j, None]) * bit).sum(1, dtype=np.uint64)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        score = score + ((ph & high) != 0) - ((mh & high) != 0)
        ph, mh = (ph << one) & full, (mh << one) & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        best = np.minimum(best, score)
    return best


def _cuts(span: int, pieces: int) -> list[tuple[int, int]]:
    edges = [span * i // pieces for i in range(pieces + 1)]
    return list(zip(edges, edges[1:]))


def _rolled(codes: np.ndarray, n: int) -> np.ndarray:
    """A digest of every n consecutive codes."""
    if len(codes) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ codes[i : len(codes) - n + 1 + i].astype(np.uint64)) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def _expanded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i] ... starts[i] + counts[i] - 1 of all i, in a row."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - counts, counts) + np.repeat(starts, counts)


class PassageIndex:
    """The pieces of every distinct passage of a block of items."""

    def __init__(self, items: list[tuple[int, list[str]]], span: int, budget: int):
        self.span, self.budget, self.ids = span, budget, {}
        numbers: dict[tuple[int, ...], int] = {}
        owners = set()
        for item, text in items:
            codes = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in text)
            owners |= {(numbers.setdefault(codes[i : i + span], len(numbers)), item) for i in range(len(codes) - span + 1)}
        self.passages = np.array(list(numbers) or np.empty((0, span)), np.int64)
        owned = np.array(sorted(owners) or np.empty((0, 2)), np.int64)
        self.owner = owned[:, 1]
        self.owner_at = np.searchsorted(owned[:, 0], np.arange(len(numbers) + 1))
        self.pieces = []
        for lo, hi in _cuts(span, budget + 1) if numbers else []:
            digests = np.array([_rolled(p[lo:hi], hi - lo)[0] for p in self.passages])
            order = np.argsort(digests, kind="stable")
            known, first = np.unique(digests[order], return_index=True)
            self.pieces.append((lo, hi - lo, known, np.append(first, len(order)), order))

    def leaks(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, item, fewest edits) of all passages found."""
        gap, ids = self.span + 2 * self.budget, self.ids
        codes = [-1] * gap
        starts = []
        for t in texts:
            starts.append(len(codes))
            codes += [ids.get(w, 0) for w in t]
            codes += [-1] * gap
        flat = np.array(codes, np.int64)
        hits = []
        for lo, n, known, first, order in self.pieces:
            rolled = _rolled(flat, n)
            at = np.minimum(np.searchsorted(known, rolled), len(known) - 1)
            places = np.flatnonzero(known[at] == rolled)
            counts = first[at[places] + 1] - first[at[places]]
            hits.append(np.stack([np.repeat(places - lo, counts), order[_expanded(first[at[places]], counts)]], 1))
        none = np.empty(0, np.int64)
        if not hits or not (found := np.unique(np.concatenate(hits), axis=0)).size:
            return none, none, none
        edits = np.empty(len(found), np.int64)
        for i in range(0, len(found), 50_000):
            place, passage = found[i : i + 50_000].T
            around = flat[np.clip(place[:, None] + np.arange(-self.budget, self.span + self.budget), 0, len(flat) - 1)]
            edits[i : i + 50_000] = fewest_edits(self.passages[passage], around, self.budget)
        found, edits = found[edits <= self.budget], edits[edits <= self.budget]
        text = np.searchsorted(starts, found[:, 0] + self.budget, side="right") - 1
        counts = self.owner_at[found[:, 1] + 1] - self.owner_at[found[:, 1]]
        rows = np.stack([np.repeat(text, counts), self.owner[_expanded(self.owner_at[found[:, 1]], counts)], np.repeat(edits, counts)], 1)
        rows = np.unique(rows, axis=0)  # sorted: the fewest edits of a text and item come first
        lead = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1)) if len(rows) else np.empty(0, bool)
        return tuple(rows[lead].T)


def _leak_batches(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                docs = batch.column(0).to_numpy(zero_copy_only=False)
                text, item, edits = index.leaks([words(t) for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (docs[text], item, edits)], names=["doc_id", "item_id", "edits"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame, *, span: int = SPAN, budget: int = 1) -> DataFrame:
    """(doc_id, item_id, edits): every document that holds a passage of an item with at most `budget` words edited."""
    items = items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    sized = items.groupBy("item_id").agg(F.max("text").alias("text"))
    length = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-length // (4 * BLOCK_WORDS)))
    docs = documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''")
    docs = spread(docs)
    parts = []
    for b in range(blocks):
        held = [(r["item_id"], words(r["text"])) for r in sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toLocalIterator()]
        shared = documents.sparkSession.sparkContext.broadcast(PassageIndex(held, span, budget))  # of at most about BLOCK_WORDS words
        parts.append(docs.mapInArrow(_leak_batches(shared), "doc_id long, item_id long, edits long"))
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
