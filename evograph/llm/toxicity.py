"""Toxicity by class-conditional Kneser-Ney character models.

Words of all whole texts are counted once per document: in toxic and in ordinary labelled
documents, and in the whole corpus. The counted words give character 5-grams. The top order
is class-conditional; every lower order is one shared model of continuation counts over the
whole corpus, so an expression that a class has hardly seen falls back to the same
probability in both and says nothing, while a rare spelling of a toxic stem is still carried by
the 5-grams of the stem. A word scores the difference of its log-likelihoods under the two
models; a document is compared by its length-normalised difference over the whole text and by
its two most toxic words, each normalised by its length as well. A logistic curve over these,
fitted on training documents that gave no counts, turns them into a score from 0 to 1.

The text only is ever scored. At most ``MAX_LABELLED`` labelled rows (by hash order) are
used for the class counts and as many for the curve; this bounds what is broadcast. The
fitted model is a table of all n-grams of the labelled documents' words, under exact keys: no
two n-grams share one. Corpus counts cover all rows.

Defined results: null, empty and word-less texts score like a document without evidence;
repeated rows count and score each; a document labelled more than once is toxic if any label
says so; without labels of both classes every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from evograph.session import materialize

ORDER, DISCOUNT = 5, 0.75
MAX_LABELLED = 200_000
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")
_TABLE_ROWS = 400_000
FEATURES = ["mean_llr", "top_word", "second_word", "top_rate"]


def fold(doc_id: Column) -> Column:
    """crc32 of the doc_id as text, mod 3; 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _bounded(labels: DataFrame, at: int) -> DataFrame:
    """__id, toxic of at most MAX_LABELLED labelled documents of a fold, by hash order."""
    one = labels.where(fold(F.col("doc_id")) == at).groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic"))
    return one.where("toxic IS NOT NULL AND __id IS NOT NULL").orderBy(F.xxhash64("__id"), "__id").limit(MAX_LABELLED)


def word_counts(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """word, toxic, ordinary, every: numbers of documents with the word."""
    known = docs.select("doc_id", "text").join(F.broadcast(labelled), F.col("doc_id") == F.col("__id"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = list(counts[2])
            cols = [pa.array(words), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, ["word", "toxic", "ordinary", "every"])
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist()):
                words = set(_words(text.as_py()))
                counts[2].update(words)
                if toxic is not None:
                    counts[0 if toxic else 1].update(words)
                if len(counts[2]) > _TABLE_ROWS:
                    yield out()
        if counts[2]:
            yield out()
    part = known.select("text", F.col("toxic").cast("int")).mapInArrow(run, "word string, toxic long, ordinary long, every long")
    return part.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("toxic", "ordinary", "every")])


def gram_counts(words: DataFrame) -> DataFrame:
    """gram, toxic, ordinary: the character 5-grams of the words with their begin and end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = list(counts.items())
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in rows]), *(pa.array([c[i] for _, c in rows], pa.int64()) for i in (0, 1))],
                ["gram", "toxic", "ordinary"])
        for b in batches:
            for word, t, o in zip(*(c.to_pylist() for c in b.columns)):
                padded = "^" * (ORDER - 1) + word + "$"
                for i in range(len(padded) - ORDER + 1):
                    c = counts.setdefault(padded[i:i + ORDER], [0, 0])
                    c[0] += t
                    c[1] += o
                if len(counts) > _TABLE_ROWS:
                    yield out()
        if counts:
            yield out()
    part = words.select("word", "toxic", "ordinary").mapInArrow(run, "gram string, toxic long, ordinary long")
    return part.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def ratios(grams: DataFrame) -> DataFrame:
    """key (n-gram, or its context with a blank), llr: the log ratio of the two conditional probabilities."""
    d = F.lit(DISCOUNT)
    shared = None
    lower = [grams.select("gram")]
    for n in range(ORDER - 1, 0, -1):  # continuation counts: in how many longer n-grams it ends
        lower.append(lower[-1].groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c")))
    for n in range(1, ORDER):
        t = lower[ORDER - n]
        if n == 1:
            shared = t.crossJoin(t.agg(F.sum("c").alias("all"))).select("gram", (F.col("c") / F.col("all")).alias("p"))
            continue
        w = Window.partitionBy(F.substring("gram", 1, n - 1))  # as many rows as there are characters
        t = t.select("gram", F.substring("gram", 2, n - 1).alias("rest"), "c", F.sum("c").over(w).alias("all"),
                     F.count("*").over(w).alias("kinds"))
        shared = t.join(shared.select(F.col("gram").alias("rest"), "p"), "rest").select(
            "gram", (F.greatest(F.col("c") - d, F.lit(0.0)) / F.col("all") + d * F.col("kinds") / F.col("all") * F.col("p")).alias("p"))
    w = Window.partitionBy(F.substring("gram", 1, ORDER - 1))
    top = grams.select("gram", F.substring("gram", 2, ORDER - 1).alias("rest"), "toxic", "ordinary", *[
        x for c in ("toxic", "ordinary") for x in (
            F.sum(c).over(w).alias(f"{c}_all"), F.sum((F.col(c) > 0).cast("int")).over(w).alias(f"{c}_kinds"))])

    def weight(c: str) -> Column:
        return F.when(F.col(f"{c}_all") > 0, d * F.col(f"{c}_kinds") / F.col(f"{c}_all")).otherwise(F.lit(1.0))

    def p(c: str) -> Column:
        own = F.when(F.col(f"{c}_all") > 0, F.greatest(F.col(c) - d, F.lit(0.0)) / F.col(f"{c}_all")).otherwise(F.lit(0.0))
        return own + weight(c) * F.col("p")
    top = top.join(shared.select(F.col("gram").alias("rest"), "p"), "rest")
    seen = top.where("toxic + ordinary > 0").select("gram", F.log(p("toxic") / p("ordinary")).alias("llr"))
    contexts = (top.where("toxic_all + ordinary_all > 0")
                .groupBy(F.concat(F.substring("gram", 1, ORDER - 1), F.lit(" ")).alias("gram"))
                .agg(F.first(F.log(weight("toxic") / weight("ordinary"))).alias("llr")))
    return seen.unionByName(contexts)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _packed(codes: list[np.ndarray]) -> np.ndarray:
    """Up to three code points of 21 bits as one number."""
    out = np.zeros(len(codes[0]), np.int64)
    for c in codes:
        out = out << 21 | c
    return out


def _coded(table: DataFrame) -> DataFrame:
    """head (the first three characters), tail (the last two), llr; all n-grams have ORDER characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = list(_codes("".join(b.column(0).to_pylist())).reshape(-1, ORDER).T)
                yield pa.RecordBatch.from_arrays([pa.array(_packed(codes[:3])), pa.array(_packed(codes[3:])), b.column(1)],
                                                 ["head", "tail", "llr"])
    return table.select("gram", F.col("llr").cast("float")).mapInArrow(run, "head long, tail long, llr float")


Model = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def model(table: DataFrame) -> Model:
    """Heads, tails, keys and log ratios of a table (gram, llr). The key of an n-gram is made of the places of its head
    and its tail among the heads and tails, each in order."""
    got = _coded(table).toArrow()
    heads, head = np.unique(got["head"].to_numpy(), return_inverse=True)
    tails, tail = np.unique(got["tail"].to_numpy(), return_inverse=True)
    keys = head.astype(np.int64) << 32 | tail
    order = np.argsort(keys)
    return heads, tails, keys[order], got["llr"].to_numpy()[order]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The exact model. The n-grams and contexts of the labelled documents' distinct words reach the driver."""
    words = materialize(word_counts(docs, _bounded(labels, 0)), "toxic_words")
    return model(ratios(materialize(gram_counts(words), "toxic_grams")))


def _place(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether ``sorted_`` holds each of ``x``, and where."""
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x, at


class _Scorer:
    """Log-likelihood differences of words; those of a whole chunk of text are worked out together."""

    def __init__(self, heads: np.ndarray, tails: np.ndarray, keys: np.ndarray, llr: np.ndarray) -> None:
        self.heads, self.tails, self.keys, self.llr, self.known = heads, tails, keys, llr, {}

    def _find(self, codes: list[np.ndarray]) -> np.ndarray:
        """The ratios of n-grams given as one array of code points for each place, else of their contexts, else 0."""
        value = np.zeros(len(codes[0]))
        held, head = _place(self.heads, _packed(codes[:3]))
        todo = np.flatnonzero(held)
        for last in (codes[4], np.full(len(codes[0]), ord(" "), "<u4")):
            if not len(todo):
                break
            held, tail = _place(self.tails, _packed([codes[3][todo], last[todo]]))
            seen, at = _place(self.keys, head[todo].astype(np.int64) << 32 | tail)
            seen &= held
            value[todo[seen]] = self.llr[at[seen]]
            todo = todo[~seen]
        return value

    def learn(self, words: set[str]) -> None:
        if len(self.known) >= _TABLE_ROWS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if not new:
            return
        if not len(self.keys):
            self.known.update(dict.fromkeys(new, 0.0))
            return
        pad = "^" * (ORDER - 1)
        codes = _codes("".join([f"{pad}{w}$" for w in new]))
        n = np.fromiter(map(len, new), np.int64, len(new)) + ORDER
        begin = np.cumsum(n) - n
        inside = np.ones(len(codes), bool)  # the last characters of a word begin no n-gram
        for d in range(1, ORDER):
            inside[begin + n - d] = False
        at = np.flatnonzero(inside)
        value = self._find([codes[at + d] for d in range(ORDER)])
        grams = n - ORDER + 1
        self.known.update(zip(new, np.add.reduceat(value, np.cumsum(grams) - grams).tolist()))


def _described(words: list[str], known: dict[str, float]) -> tuple[float, ...]:
    """FEATURES of a text."""
    if not words:
        return 0.0, 0.0, 0.0, 0.0
    s = np.fromiter(map(known.__getitem__, words), float, len(words))
    n = np.fromiter(map(len, words), float, len(words)) + 1
    top = np.sort(np.partition(s, -2)[-2:] if len(s) > 2 else s)[::-1]
    return s.sum() / n.sum(), top[0], top[1] if len(top) > 1 else 0.0, (s / n).max()


def features(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and FEATURES of every whole text."""
    model_ = docs.sparkSession.sparkContext.broadcast(model)  # 12 bytes an n-gram, 8 a head or tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(*model_.value)
        for b in batches:
            rows, chunk, size = [], [], 0

            def flush() -> None:
                scorer.learn(set().union(*chunk))
                rows.extend(_described(words, scorer.known) for words in chunk)
            for text in b.column(1):
                chunk.append(_words(text.as_py()))
                size += len(chunk[-1])
                if size > 1 << 17:
                    flush()
                    chunk, size = [], 0
            if chunk:
                flush()
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.float64()) for c in cols)], ["doc_id", *FEATURES])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Newton steps; the classes weigh the same. The last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty * len(y),
                               x.T @ (weight * (y - p)) - penalty @ w * len(y))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and FEATURES of every document."""
    f = materialize(features(docs, fit(docs, labels)), "toxic_features")
    rest = (f.join(F.broadcast(_bounded(labels, 2)), F.col("doc_id") == F.col("__id"))
            .select("toxic", *FEATURES).limit(2 * MAX_LABELLED).toPandas())
    y = rest["toxic"].to_numpy(float)
    told = F.lit(0.5)
    if 0 < y.sum() < len(y):
        x = rest[FEATURES].to_numpy(float)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        w = _logistic((x - mean) / scale, y)
        z = F.lit(float(w[-1] - (w[:-1] * mean / scale).sum()))
        for name, v in zip(FEATURES, w[:-1] / scale):
            z = z + F.col(name) * F.lit(float(v))
        told = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return (f.withColumn("score", told).withColumn("held_out", fold(F.col("doc_id")) == 1)
            .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
            .select("doc_id", "held_out", "score", "predicted", *FEATURES))
