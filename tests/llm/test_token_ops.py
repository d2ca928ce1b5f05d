"""Packing, BPE, WARC and top-k against brute force and round trips."""
import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evograph.llm import bpe, packing, topk, warc

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", "a" * 3000, "ab" * 2000, " " * 500 + "x", "é" * 700, "💥" * 300, "<|endoftext|> hi", "0123456789" * 200, "\r\n\t \n",
       "'s're'LL'll", "http" * 300, "\x1c\x85᠎​ a", "Ünïcödé wörds 漢字 かな"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_bpe_equals_the_library(reference):
    encoder, decoder = bpe.codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(1)
    made = ["".join(rng.choice("abcdefghinotresz '\n1é漢") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    for text in ODD + made:
        ids = list(encoder.encode(text))
        assert ids == reference(text), text[:40]
        assert b"".join(decoder.decode(ids)) == text.encode()


def test_bpe_emits_early_and_survives_full_tables(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_LIMIT", 50)
    encoder, decoder = bpe.Encoder({bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257}, public_tokenizers.PATTERN), None
    long = "ab" * 400
    first = next(iter(encoder.transducer.ids(long.encode())))
    assert first == 257 and list(encoder.encode(long)) == [257] * 200
    octets = encoder.transducer.octets
    parts = list(bpe.Decoder(octets).decode("é".encode() + b"\xff" + "漢".encode()[:2]))
    assert b"".join(parts) == "é".encode() + b"\xff" + "漢".encode()[:2] and parts[0] == "é".encode()


def test_digests(spark):
    rows = [(i, t, 1) for i, t in enumerate([*ODD, None, ODD[1]])]
    encoder, _ = bpe.codec(RANKS, public_tokenizers.PATTERN)
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    for r in bpe.digests(d, RANKS, public_tokenizers.PATTERN).collect():
        text = rows[r["doc_id"]][1] or ""
        ids = list(encoder.encode(text))
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    ids = bpe.encode(d, RANKS, public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()}
    assert all(back[i] == (t or "").encode() for i, t, _ in rows)


@pytest.mark.parametrize("range_rows", [32768, 150, 40])
def test_rounds_pack_well(spark, range_rows):
    rng = random.Random(range_rows)
    sizes = [rng.choice([1, 700, rng.randint(1, 900), rng.randint(1, 2047)]) for _ in range(600)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
    got = packing.assign(items, 2048, range_rows).collect()
    assert sorted(r["item"] for r in got) == list(range(600))
    used = {}
    for r in got:
        used[r["seq"]] = used.get(r["seq"], 0) + sizes[r["item"]]
    assert max(used.values()) <= 2048
    gaps = []  # best-fit decreasing in one place
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(2048 - s)
    assert len(used) <= len(gaps) * 1.02 + 1
    assert packing.assign(items.limit(0), 2048).count() == 0


@pytest.fixture(scope="module")
def contract():
    """The plain call: added tokens in a text are themselves."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_a_text(contract):
    encode = packing._encoder(JSON)
    assert encode("one <|endoftext|> two").tolist() == [505, 220, 50256, 734]
    for text in [*ODD, "<|endoftext|>", "<|endoftext|><|endoftext|>", "a<|endoftext|>b", "<|endoftext|", " <|endoftext|>\n<|endoftext|> x "]:
        assert encode(text).tolist() == contract(text)


@pytest.mark.parametrize("range_rows", [packing.RANGE_ROWS, 300])
def test_pack(spark, contract, range_rows):
    """With ranges of 300 rows the rounds run, not the last sweep alone."""
    rng = random.Random(range_rows)
    texts = [*ODD, None, "word " * 9000, "same text", "same text"]
    if range_rows == 300:
        texts += ["w " * rng.randrange(1, 1500) for _ in range(900)]
    d = spark.createDataFrame([(i if i != 3 else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, item int")
    rows = packing.pack(d, JSON, keep_ids=True, range_rows=range_rows).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = [*contract(t or ""), 0]
        ps = sorted(by_doc[i if i != 3 else None], key=lambda r: r["piece"])
        assert [x for p in ps for x in p["ids"]] == ids and [p["piece"] for p in ps] == list(range(len(ps)))
        assert all(p["length"] == 2048 for p in ps[1:])
        at = 0
        for p in ps:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(ids[at:at + p["length"]], "<u4").tobytes())
            at += p["length"]
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(d.limit(0), JSON).count() == 0


def test_warc_round_trip(spark, tmpdir_path):
    rng = random.Random(2)
    rows = [(i, f"http://x/{i}\r\nX: y", rng.choice(["<p>same</p>", "", None, "é" * rng.randint(1, 400)])) for i in range(120)]
    rows += [(500, None, "<p>other</p>"), (500, "u", "<p>other</p>"), (None, "u", "<p>same</p>"), (None, "u", "alone"), (None, "u", "alone"), (501, "u", "x" * 300000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit("z"))
    root = "file://" + tmpdir_path + "/w"
    manifest = warc.write(d, root, roll_bytes=2000).collect()
    assert len({r["file"] for r in manifest}) > 3
    got = warc.read(spark, root).collect()
    assert len(got) == len(rows)
    low = {}
    for i, _, h in rows:
        low[h or ""] = max(low.get(h or "", -1), i if i is not None else -1)
    digest = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): h for h in low}
    seen = {}
    for r in got:
        h = digest[r["payload_digest"]]
        assert r["payload_bytes"] == len(h.encode())
        if r["record_type"] == "response":
            assert r["refers_to"] is None
            seen[h] = seen.get(h, 0) + 1
            assert r["page_id"] == low[h] or (low[h] == -1 and r["page_id"] is None)
        else:
            assert r["refers_to"] == low[h]
    assert all(n == (2 if h == "alone" else 1) for h, n in seen.items()) and set(seen) == set(low)
    again = "file://" + tmpdir_path + "/w2"
    assert sorted(map(tuple, warc.write(d, again, roll_bytes=2000).collect())) == sorted(map(tuple, manifest))
    sized = warc.round_trip(d, min_bytes=5).where("payload_bytes < 5")
    assert sized.where("record_type = 'revisit'").count() == 0
    assert warc.round_trip(d.limit(0)).count() == 0


def best(rows, k):
    good = [(i, np.floor(np.array(v, float) * 64).astype(np.int64)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 20 == 0:
            found = sorted((-int(q @ c), j) for j, c in good if j != i and len(c) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "BINS", 8)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 3)]) for i in range(120)]  # many ties
    rows += [(200, None), (220, [1.0, None, 2.0]), (240, [float("nan")] * 3), (260, [1e5, -3e4, 7.0]), (280, []), (281, []),
             (300, [5.0]), (301, [1.0]), (None, [1.0, 1.0, 1.0]), (7, [1.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    assert sorted(map(tuple, topk.search(d, F.col("vec_id") % 20 == 0, 5).collect())) == best(rows, 5)
    assert topk.search(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0
