"""Vector codes and fill-in-middle against brute force."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evograph.llm import fill_in_middle as fim, vector_codes as codes

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


# ---------------------------------------------------------------- fill in middle

def slow_fim(doc_id, text):
    text = text or ""
    n = len(text)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(5)
    alphabet = "ab <>PSM\n\té€😀́"
    out = [None, "", " ", "x", "<", "<P", "P>", "a<P>b", "<S>", "<M", "😀", "\x00", "é", "<P​>"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    return out + ["é" * 70_000 + "x" * 66_000, "<" * 200_001, "y" * (2 * fim._SLICE)]


def test_fill_in_middle_equals_slices(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (-3, "negative"), (7, "x"), (7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(
        "*", F.lit(1).alias("n"), F.lit("a").alias("form"), F.lit("b").alias("output"))  # names of the result
    got = fim.restore(fim.transform(docs)).collect()
    assert sorted(map(str, got)) == sorted(map(str, fim.round_trip(docs).collect()))
    want = [(d, *slow_fim(d, t), (t or "").encode()) for d, t in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    have = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], bytes(r["output"]).decode(),
             bytes(r["restored"])) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert {r[2] for r in have} == {"plain", "psm", "spm"}
    assert fim.restore(fim.transform(docs.limit(0))).count() == 0


@pytest.mark.parametrize("lo,mid,hi", [(0, 0, 0), (0, 0, 5), (0, 5, 5), (1, 2, 9), (0, 3, 10), (2, 70_000, 200_000)])
def test_rotate(lo, mid, hi):
    data = bytes(random.Random(hi).randbytes(max(hi, 10)))
    b = bytearray(data)
    fim.rotate(b, lo, mid, hi)
    assert bytes(b) == data[:lo] + data[mid:hi] + data[lo:mid] + data[hi:]


def test_broken_output_is_told():
    with pytest.raises(ValueError):
        fim.backward("psm", b"<S>x<P>y<M>z")


# ---------------------------------------------------------------- vector codes

def slow_codes(rows, parts, entries, rounds):
    """Plain integers, one vector at a time."""
    from math import floor
    v = {i: [floor(256 * float(x)) for x in e] for i, e, _ in rows}
    width = len(next(iter(v.values()))) // parts
    cut = lambda x, p: x[p * width:(p + 1) * width]
    books = [[cut(v[i], p) for i in sorted(v)[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            took = {}
            for x in v.values():
                took.setdefault(near(cut(x, p), book)[1], []).append(cut(x, p))
            books[p] = [[sum(c) // len(took[j]) for c in zip(*took[j])] if j in took else e for j, e in enumerate(book)]
    told = {i: [near(cut(x, p), books[p]) for p in range(parts)] for i, x in v.items()}
    labels = {i: label for i, _, label in rows}
    error = {i: sum(e for e, _ in t) for i, t in told.items()}
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    return {(i, "".join(f"{j:02x}" for _, j in t), error[i], sum(e for k, e in error.items() if labels[k] == labels[i]),
             hashlib.sha256(text.encode()).hexdigest()) for i, t in told.items()}


def vectors(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    e = (rng.standard_normal((n, dim)) * spread).astype(np.float32)
    return [(int(i), [float(x) for x in e[k]], [None, 1, 2][k % 3] if k % 4 else 1)
            for k, i in enumerate(rng.permutation(n) * 7 - 20)]


@pytest.mark.parametrize("n,dim,parts,entries,rounds", [(300, 32, 16, 64, 2), (40, 8, 4, 64, 2), (200, 6, 3, 5, 3), (9, 4, 1, 4, 0)])
def test_codes_equal_brute_force(spark, monkeypatch, n, dim, parts, entries, rounds):
    monkeypatch.setattr(codes, "BLOCK", 64)
    rows = vectors(n, dim, n, 0.05)  # narrow: dictionaries hold few integers, ties are common
    d = spark.createDataFrame(rows, EMBEDDINGS).repartition(3)
    got = {tuple(r) for r in codes.digests(d, parts=parts, entries=entries, rounds=rounds).collect()}
    assert got == slow_codes(rows, parts, entries, rounds)


def test_codes_of_odd_rows(spark):
    good = vectors(90, 32, 3)
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None, 1), (1001, [nan] * 32, 1), (1002, [inf] + [0.0] * 31, 1), (1003, [None] + [0.0] * 31, 1),
           (1004, [], 1), (1005, [0.5] * 31, 1), (1006, [0.5] * 64, 1)]
    rows = spark.createDataFrame(good + odd, EMBEDDINGS).select("*", F.lit("x").alias("code"), F.lit(0).alias("error"))
    got = {tuple(r) for r in codes.digests(rows).collect()}
    assert got == slow_codes(good, 16, 64, 2)
    twice = spark.createDataFrame(good + good[:1] + [(None, good[5][1], None)], EMBEDDINGS)
    coded, book = codes.compress(twice)
    assert coded.count() == 92 and coded.where("vec_id is null").count() == 1
    assert book.shape == (64, 32)
    assert codes.digests(spark.createDataFrame([], EMBEDDINGS)).count() == 0
    only_null = codes.digests(spark.createDataFrame([(None, [0.5] * 16, 1)], EMBEDDINGS)).collect()
    assert [tuple(r)[:3] for r in only_null] == [(None, "00" * 16, 0)]  # the entry of zeros moved to it
    with pytest.raises(ValueError, match="64 bits"):
        codes.compress(spark.createDataFrame([(1, [1e30] * 16, 1)], EMBEDDINGS))
