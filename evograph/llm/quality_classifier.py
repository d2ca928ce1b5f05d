"""Quality by ordinal cumulative-link regression on graded ratings.

``P(grade > j) = sigmoid(w . x - theta_j)``: all grades share one weight vector over
hashed text features, and the ordered thresholds cut its scale. A document gets its
expected grade and the tail probability of reaching the grade that selection asks for.

Features are the signs of a text that hash into ``DIM`` slots: its words (with their
case), and coarse statistics of the whole text (share of capitals, of symbols, of
distinct words, of distinct lines; lengths). Each distinct sign counts with
``1 + log(count)``, and a text's vector has length one.

The regression is fitted on all signs of at most ``MAX_RATED`` rated documents (by hash
order), whose vectors (at most ``DIM`` entries each) alone reach the driver, one partition at a
time and into an unnamed file; every document is scored. Rows of the held-out fold
(crc32 of the doc_id as text mod 3 is 1) are never fitted on.

Defined results: null and empty texts have only their statistics; repeated rows score
each; of several ratings of a document the lowest counts; grades that nobody gave have no
threshold of their own; without ratings of two grades every document has an even chance;
extra columns are ignored.
"""

from __future__ import annotations

import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evograph.llm.toxicity import fold
from evograph.session import materialize

DIM = 1 << 16
MAX_RATED = 8_000
SELECT_GRADE = 1
_ROUNDS, _BATCH, _RATE, _RIDGE = 12, 256, 0.3, 1e-6
_WORDS = re.compile(r"[^ \t-\r]+")


class _Slots(dict):
    def __missing__(self, sign: str) -> int:
        from xxhash import xxh64_intdigest
        got = xxh64_intdigest(sign.encode(), 42) & (DIM - 1)
        if len(self) >= 400_000:
            self.clear()
        if len(sign) < 64:
            self[sign] = got
        return got


def _step(x: float) -> int:
    return int(min(20, x * 20))


def signs(text: str | None, slots: _Slots) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the text's unit vector."""
    text = text or ""
    words = _WORDS.findall(text)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(str.isalpha, text))
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    marks = len(re.findall(r"[#*$%&|<>!?=_~^\\{}\[\]]", text))
    n = max(1, len(words))
    stats = [f"\x01capitals {_step(upper / max(1, letters))}", f"\x01marks {_step(marks / n)}",
             f"\x01distinct {_step(len(set(words)) / n)}", f"\x01lines {_step(len(set(lines)) / max(1, len(lines)))}",
             f"\x01words {int(np.log2(n))}", f"\x01length {min(30, sum(map(len, words)) // n)}",
             f"\x01distinct {_step(len(set(words)) / n)} of {int(np.log2(n))}"]
    counts = Counter(words)
    at = np.fromiter(map(slots.__getitem__, counts), np.int64, len(counts))
    value = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
    s = np.fromiter(map(slots.__getitem__, stats), np.int64, len(stats))
    # words and statistics weigh the same, however long the text is
    value = np.concatenate((value / max(1e-9, np.sqrt((value ** 2).sum())), np.full(len(s), 1 / np.sqrt(len(s)))))
    return np.concatenate((at, s)), value / np.sqrt(2)


def _rated(ratings: DataFrame) -> DataFrame:
    one = (ratings.where(fold(F.col("doc_id")) != 1).groupBy(F.col("doc_id").alias("__id"))
           .agg(F.min("grade").cast("int").alias("__grade")))
    return one.where("__grade IS NOT NULL AND __id IS NOT NULL").orderBy(F.xxhash64("__id"), "__id").limit(MAX_RATED)


_ENTRY = np.dtype([("at", "<u2"), ("value", "<f4")])


class _Vectors:
    """Entries of the rated rows by their number, in an unnamed file of the driver."""

    def __init__(self) -> None:
        self.file, self.parts = tempfile.TemporaryFile(), {}

    def add(self, row: int, entries: bytes) -> None:
        self.parts[row] = self.file.tell(), len(entries)
        self.file.write(entries)

    def of(self, row: int) -> np.ndarray:
        start, size = self.parts[row]
        self.file.seek(start)
        return np.frombuffer(self.file.read(size), _ENTRY)


def _vectors(docs: DataFrame, ratings: DataFrame) -> tuple[np.ndarray, np.ndarray, _Vectors]:
    """Numbers and grades of the rated rows, in order of their hash, and their whole vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for b in batches:
            for i, text in enumerate(b.column(0)):  # a row at a time: vectors of long texts are large
                at, v = signs(text.as_py(), slots)
                every = np.bincount(at, v, DIM)
                entries = np.empty(np.count_nonzero(every), _ENTRY)
                entries["at"] = np.flatnonzero(every)
                entries["value"] = every[entries["at"]]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, 1), b.column(2).slice(i, 1),
                                                  pa.array([entries.tobytes()], pa.binary())], ["grade", "hash", "entries"])
    rated = docs.select("doc_id", "text").join(F.broadcast(_rated(ratings)), F.col("doc_id") == F.col("__id"))
    rows = materialize(rated.select("text", F.col("__grade").alias("grade"), F.xxhash64("doc_id", "text").alias("hash"))
                       .mapInArrow(run, "grade int, hash long, entries binary")
                       .withColumn("row", F.monotonically_increasing_id()), "rated")
    # repeated documents could pass the bound on rated rows
    kept = rows.select("hash", "row", "grade").orderBy("hash", "row").limit(MAX_RATED).toPandas()
    held = rows.join(F.broadcast(docs.sparkSession.createDataFrame(kept[["row"]], "row long")), "row") if len(kept) else rows
    vectors = _Vectors()
    for r in held.select("row", "entries").toLocalIterator():
        vectors.add(r["row"], bytes(r["entries"]))
    return kept["row"].to_numpy(), kept["grade"].to_numpy(), vectors


def fit(docs: DataFrame, ratings: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, ordered thresholds, grades."""
    rows, given, vectors = _vectors(docs, ratings)
    grades = np.unique(given) if len(given) else np.array([0])
    w, theta = np.zeros(DIM), np.zeros(max(0, len(grades) - 1))
    if len(grades) < 2:
        return w, theta, grades
    y = np.searchsorted(grades, given)
    theta = np.array([-np.log(max(1e-3, (y > j).mean()) / max(1e-3, (y <= j).mean())) for j in range(len(grades) - 1)])
    weight = (len(y) / len(grades) / np.bincount(y, minlength=len(grades)))[y] ** 0.5  # rare grades weigh more
    squares, theta_squares = np.full(DIM, 1e-8), np.full(len(theta), 1e-8)
    order = np.random.default_rng(0)
    for _ in range(_ROUNDS):
        mixed = order.permutation(len(y))
        for part in np.array_split(mixed, max(1, len(y) // _BATCH)):
            got = [vectors.of(i) for i in rows[part]]
            every = np.concatenate(got)
            a, v = every["at"], every["value"].astype(float)
            row = np.repeat(np.arange(len(part)), [len(x) for x in got])
            z = np.bincount(row, w[a] * v, len(part))[:, None] - theta[None, :]
            # each threshold is a binary question with the shared weights
            miss = (y[part][:, None] > np.arange(len(theta))) - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            miss *= weight[part][:, None] / len(part)
            g = np.bincount(a, miss.sum(axis=1)[row] * v, DIM) - _RIDGE * w
            squares += g * g
            w += _RATE * g / np.sqrt(squares)
            t = -miss.sum(axis=0)
            theta_squares += t * t
            theta = np.sort(theta + _RATE * t / np.sqrt(theta_squares))
    return w, theta, grades


def score(docs: DataFrame, ratings: DataFrame, select_grade: int = SELECT_GRADE) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability (of ``select_grade`` or better) and selected."""
    w, theta, grades = fit(docs, ratings)
    model = docs.sparkSession.sparkContext.broadcast((w.astype(np.float32), theta, grades))  # DIM weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts, marks = model.value
        slots = _Slots()
        tail_at = int((marks < select_grade).sum()) - 1  # P(grade >= select) is one of the cumulative links
        for b in batches:
            z = np.array([(weights[a] * v).sum() for a, v in (signs(t.as_py(), slots) for t in b.column(1))])
            above = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -30, 30)))
            expected = marks[0] + (above * np.diff(marks)[None, :]).sum(axis=1)
            tail = np.full(len(z), 0.5)
            if len(cuts):
                tail = np.ones(len(z)) if tail_at < 0 else above[:, tail_at] if tail_at < len(cuts) else np.zeros(len(z))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(expected.astype(float)), pa.array(tail)],
                                             ["doc_id", "expected_grade", "tail_probability"])
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, expected_grade double, tail_probability double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "expected_grade", "tail_probability",
                      (F.col("tail_probability") >= 0.5).alias("selected"))
