"""Reading level of each document from n-gram surprisal and isotonic regression.

For each level an interpolated trigram model is trained on labelled documents. Every sentence of a document
gets its surprisal under each model, hence an expected level; the distribution over all sentences of the
whole document is summed up by the middle of its weighted mean and weighted median, so that a few sentences
of another level move it little. An isotonic regression maps this score monotonically to the graded levels.

Labels hold errors. Documents are scored by models of the other fold first; those whose score disagrees with
their label by a level or more are left out of the final models and of the regression.

The models are fitted on every labelled document. Spark counts the sequences of words per level and fold, scores the
labelled documents and counts again; the driver gets the distinct sequences with their numbers, and two numbers per
labelled document, never a text.

Defined cases: null ids or texts and documents under MIN_WORDS words give no row; null labels are left out
and several ratings of one document are averaged; repeated rows of a document are scored as one; without any
label of two different levels all documents get the level of the labels, or level 2; an empty table gives no
rows; other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.runtime import cut, spread

MIN_WORDS = 40
WEIGHTS = (0.1, 0.4, 0.5)  # of one, two and three words
EVEN_WEIGHT = 20  # words up to about which the weight of a sentence grows with its words; further ones add ever less
SHARPNESS = 8  # words after which more of a sentence adds no certainty
START = np.uint64(1)  # stands for the word before a sentence

_SENTENCE = re.compile(r"(?<=[.!?;:])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+|\d+")


def sentences(text: str) -> list[list[str]]:
    found = ([w.casefold() if w[0].isalpha() else "#" for w in _WORD.findall(s)] for s in _SENTENCE.split(text))
    return [s for s in found if len(s) > 1]


class Coder:
    """Texts as digests of their words in a row, two START before each sentence; with the place of each sentence's text and its words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, texts: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        flat, owner, sizes = [], [], []
        for i, text in enumerate(texts):
            for s in text:
                flat += [1, 1]
                flat += [known.get(w) or known.setdefault(w, xxhash.xxh64_intdigest(w) | 2) for w in s]
                owner.append(i)
                sizes.append(len(s))
        return np.array(flat, np.uint64), np.array(owner, np.int64), np.array(sizes, np.int64)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0xD1B54A32D192ED03))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sequences(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word, and the digests of the two and three words up to it, of every place from the third."""
    pairs = _joined(flat[:-1], flat[1:])
    return flat[2:], pairs[1:], _joined(pairs[:-1], flat[2:])


def _counted(flat: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words of a sequence, digests, numbers); of START only the number of sentences, and nothing that ends in it."""
    ends = flat[2:] != START
    for order, found in enumerate(_sequences(flat), 1):
        yield order, *np.unique(found[ends], return_counts=True)
    yield 1, np.array([START]), np.array([(flat == START).sum() // 2])


@dataclass
class Reader:
    """Sequences of one, two and three words as sorted digests, each with its numbers per grade."""

    grades: list[int]
    known: list[tuple[np.ndarray, np.ndarray]]
    totals: np.ndarray  # words per grade
    size: int  # different words, with the unknown and START

    @classmethod
    def fitted(cls, level: np.ndarray, order: np.ndarray, sequence: np.ndarray, n: np.ndarray) -> "Reader":
        """From rows of numbers, which may repeat a sequence."""
        grades = np.unique(level)
        known = []
        for o in (1, 2, 3):
            own = order == o
            keys, at = np.unique(sequence[own], return_inverse=True)
            counts = np.zeros((len(grades), len(keys)), np.uint32)
            np.add.at(counts, (np.searchsorted(grades, level[own]), at), n[own].astype(np.uint32))
            known.append((keys, counts))
        words = known[0][0] != START
        return cls(grades.tolist(), known, known[0][1][:, words].sum(1, dtype=np.float64), int(words.sum()) + 2)

    def _numbers(self, order: int, sequences: np.ndarray) -> np.ndarray:
        keys, counts = self.known[order - 1]
        if not len(keys):
            return np.zeros((len(self.grades), len(sequences)))
        at = np.minimum(np.searchsorted(keys, sequences), len(keys) - 1)
        return np.where(keys[at] == sequences, counts[:, at], 0).astype(np.float64)

    def surprisal(self, flat: np.ndarray) -> np.ndarray:
        """Bits of every word under each model; 0 for START."""
        ones = self._numbers(1, flat)
        _, pairs, triples = _sequences(flat)
        both = np.concatenate([np.zeros((len(self.grades), 1)), self._numbers(2, pairs)], 1)
        first = flat[1:-1] == START
        p1 = (ones[:, 2:] + 0.5) / (self.totals[:, None] + 0.5 * self.size)
        p2 = both[:, 1:] / np.maximum(ones[:, 1:-1], 1)
        p3 = self._numbers(3, triples) / np.maximum(np.where(first, ones[:, 1:-1], both[:, :-1]), 1)
        p = WEIGHTS[0] * p1 + WEIGHTS[1] * np.minimum(p2, 1) + WEIGHTS[2] * np.minimum(p3, 1)
        out = np.zeros(ones.shape)
        out[:, 2:] = np.where(flat[2:] == START, 0, -np.log2(p))
        return out

    def scores(self, texts: list[list[list[str]]], coder: Coder) -> np.ndarray:
        """The score of each text; nan where it has no sentence."""
        codes, owners, sizes = coder(texts)
        out = np.full(len(texts), np.nan)
        if not len(owners):
            return out
        starts = np.cumsum(sizes + 2) - (sizes + 2)
        bits = np.add.reduceat(self.surprisal(codes), starts, axis=1) / sizes
        odds = np.exp2(-(bits - bits.min(0)) * np.minimum(sizes, SHARPNESS))
        expected = (odds * np.array(self.grades)[:, None]).sum(0) / odds.sum(0)
        weight = EVEN_WEIGHT * (1 - np.exp(-sizes / EVEN_WEIGHT))
        total = np.bincount(owners, weight, len(texts))
        mean = np.bincount(owners, weight * expected, len(texts)) / np.maximum(total, 1)
        order = np.lexsort((expected, owners))
        run = np.cumsum(weight[order])
        ends = np.cumsum(total)
        middle = np.searchsorted(run, ends - total / 2)
        has = total > 0
        out[has] = (mean[has] + expected[order][middle[has]]) / 2
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the first and last x of each block, with its mean; values between are to be interpolated."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, _, end = blocks.pop()
            m, k, start, _ = blocks[-1]
            blocks[-1] = [(m * k + v * n) / (k + n), k + n, start, end]
    return np.array([e for b in blocks for e in b[2:]]), np.array([b[0] for b in blocks for _ in range(2)])


@dataclass
class Grader:
    reader: Reader | None
    edges: np.ndarray
    values: np.ndarray

    def levels(self, texts: list[list[list[str]]], coder: Coder | None = None) -> np.ndarray:
        if self.reader is None:
            return np.full(len(texts), int(self.values[0]))
        scores = self.reader.scores(texts, coder or Coder())
        grades = self.reader.grades
        graded = np.interp(np.nan_to_num(scores, nan=(grades[0] + grades[-1]) / 2), self.edges, self.values)
        return np.clip(np.floor(graded + 0.5), grades[0], grades[-1]).astype(int)


def _grades(level: np.ndarray) -> np.ndarray:
    return np.floor(level + 0.5).astype(np.int32)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (text, level, fold): the sequences of words with their numbers, per grade and fold."""
    coder = Coder()
    for batch in batches:
        grades, folds = _grades(batch.column(1).to_numpy()), batch.column(2).to_numpy()
        parts = [sentences(t) for t in batch.column(0).to_pylist()]
        for grade, fold in sorted(set(zip(grades.tolist(), folds.tolist()))):
            flat, owner, _ = coder([parts[i] for i in np.flatnonzero((grades == grade) & (folds == fold))])
            for order, found, n in _counted(flat) if len(owner) else ():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), v, np.int32)) for v in (grade, fold, order)] + [pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))],
                    names=["grade", "fold", "order", "sequence", "n"],
                )


COUNTS = "grade int, fold int, order int, sequence long, n long"


def _reader(counts: pa.Table, fold: int | None = None) -> Reader:
    """Fitted on the numbers of this fold, or on all where there is none."""
    grade, folds, order, sequence, n = (counts.column(i).to_numpy() for i in range(5))
    own = folds == fold if fold is not None and (folds == fold).any() else np.full(len(folds), True)
    return Reader.fitted(grade[own], order[own], sequence[own].view(np.uint64), n[own])


def _score_rows(readers):
    """Rows (text, level, fold) with their score by the reader of the other fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, both = Coder(), readers()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                parts, folds = [sentences(t) for t in batch.column(0).to_pylist()], batch.column(2).to_numpy()
                scores = np.full(len(parts), np.nan)
                for fold in (0, 1):
                    own = np.flatnonzero(folds == fold)
                    scores[own] = both[fold].scores([parts[i] for i in own], coder)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=["text", "level", "fold", "score"])

    return run


def _reach(scored: pa.Table, grades: list[int]) -> float:
    """How near the score of a kept document is to its label: within a level, or any score will do if a grade would have none."""
    level, score = scored.column("level").to_numpy(), scored.column("score").to_numpy()
    return 1.0 if set(_grades(level[np.abs(score - level) < 1]).tolist()) >= set(grades) else np.inf


def _kept(scored: pa.Table, reach: float) -> pa.Table:
    return scored.filter(pa.array(np.abs(scored.column("score").to_numpy() - scored.column("level").to_numpy()) < reach))


def _grader(counts: pa.Table, kept: pa.Table) -> Grader:
    """Of the numbers and the rows (level, score) of the kept documents."""
    level, score = kept.column("level").to_numpy(), kept.column("score").to_numpy()
    order = np.lexsort((level, score))
    return Grader(_reader(counts), *isotonic(score[order], level[order]))


def trained_grader(texts: list[str], labels: list[float]) -> Grader:
    """Models and regression from labelled texts at hand, with disagreeing labels left out; `fitted_grader` does it with Spark."""
    rows = pa.record_batch({"text": pa.array(texts, pa.string()), "level": pa.array(labels, pa.float64()), "fold": pa.array([i % 2 for i in range(len(texts))], pa.int32())})
    counts = pa.Table.from_batches([*_count_rows(iter([rows]))], pa.schema([(c, pa.int64() if c in ("sequence", "n") else pa.int32()) for c in ("grade", "fold", "order", "sequence", "n")]))
    grades = sorted(set(counts.column("grade").to_pylist()))
    if len(grades) < 2:
        return Grader(None, np.array([2.0]), np.array([*grades, *_grades(np.array(labels, float)), 2][:1]))
    scored = pa.Table.from_batches([*_score_rows(lambda: [_reader(counts, 1), _reader(counts, 0)])(iter([rows]))])
    kept = _kept(scored, _reach(scored, grades))
    return _grader(pa.Table.from_batches([*_count_rows(iter(kept.select(["text", "level", "fold"]).combine_chunks().to_batches()))]), kept)


def labelled_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, level, fold) of every labelled document."""
    rated = labels.filter("doc_id IS NOT NULL AND reading_level IS NOT NULL").groupBy("doc_id").agg(F.avg("reading_level").alias("level"))
    texts = documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL").join(rated, "doc_id").distinct()
    return texts.select("text", "level", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold"))


def fitted_grader(documents: DataFrame, labels: DataFrame) -> Grader:
    """Models and regression from all labelled documents, with disagreeing labels left out."""
    context = documents.sparkSession.sparkContext
    rows = cut(labelled_documents(documents, labels))

    def counted(own: DataFrame) -> pa.Table:
        return spread(own).mapInArrow(_count_rows, COUNTS).groupBy("grade", "fold", "order", "sequence").agg(F.sum("n").alias("n")).toArrow()

    counts = counted(rows)
    grades = sorted(set(counts.column("grade").unique().to_pylist()))
    if len(grades) < 2:
        rest = [r["grade"] for r in rows.select(F.floor(F.col("level") + 0.5).cast("int").alias("grade")).distinct().orderBy("grade").collect()]
        return Grader(None, np.array([2.0]), np.array([*grades, *rest, 2][:1]))
    readers = context.broadcast([_reader(counts, 1), _reader(counts, 0)])
    scored = cut(spread(rows).mapInArrow(_score_rows(lambda: readers.value), "text string, level double, fold int, score double"))
    pairs = scored.select("level", "score").toArrow()
    reach = _reach(pairs, grades)
    own = scored.filter(F.abs(F.col("score") - F.col("level")) < reach).select("text", "level", "fold")
    return _grader(counted(own), _kept(pairs, reach))


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, reading_level) of every document of at least MIN_WORDS words."""
    shared = documents.sparkSession.sparkContext.broadcast(fitted_grader(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grader, coder = shared.value, Coder()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                pairs = [(d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if len(t.split()) >= MIN_WORDS]
                levels = grader.levels([sentences(t) for _, t in pairs], coder)
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in pairs], pa.int64()), pa.array(levels, pa.int32())], names=["doc_id", "reading_level"])

    docs = documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return spread(docs).mapInArrow(run, "doc_id long, reading_level int").groupBy("doc_id").agg(F.max("reading_level").alias("reading_level"))
