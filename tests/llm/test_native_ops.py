"""Quality rules and PII against brute force on odd texts."""
import collections
import math
import random
import re

from pyspark.sql import functions as F

from evograph.llm import pii, quality_rules

SCHEMA = "doc_id long, text string, lang string, base string, kept int"
ODD = [None, "", " \n ", "a b c", "x " * 40, "one two three four five six seven eight " * 3, "a\nb\na\n\nb\n a", "é" * 300,
       "#*$%&|<> & word", "same line here\n" * 12, "w" * 20000, "1 2 " * 3000]


def frame(spark, texts):
    """Repeated rows and columns whose names clash with the operators' own."""
    rows = [(i, t, None if i % 3 == 0 else "en", "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (None, "null id", None, None, None)], SCHEMA)


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    seen = collections.Counter(windows)
    covered = {j for i, k in enumerate(windows) if seen[k] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures(spark):
    d = frame(spark, ODD)
    got = quality_rules.measure(d).select("text", "__m.*").collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert tuple(r[c] for c in quality_rules.METRICS[:5]) == counts(r["text"]), r["text"][:40] if r["text"] else None
        n, rep = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n)


def test_binomial_tail(spark):
    rows = [(k, n) for n in (1, 30, 800, 5000) for k in (0, 1, 5, 40) if k <= n]
    d = spark.createDataFrame(rows, "k long, n long").withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01))
    for k, n, p in d.collect():
        want = sum(math.comb(n, j) * 0.01 ** j * 0.99 ** (n - j) for j in range(k + 1)) if k < n * 0.01 else 1.0
        assert abs(p - want) < 1e-9 * max(1, want)


def test_cutoffs_limit_false_rejection(spark):
    """1000 good documents: a cutoff may reject few of them, and a stratum of 30 gets none."""
    base = {m: 0.0 for m in quality_rules.METRICS} | {"mean_word_chars": 5.0, "n_words": 100.0, "base_failed": False}
    rows = [base | {"doc_id": i, "stratum": "big", "symbol_ratio": 0.6 if i < 3 else 0.0} for i in range(1000)]
    rows += [base | {"doc_id": 5000 + i, "stratum": "small"} for i in range(30)]
    cols = ["doc_id", "stratum", *quality_rules.METRICS]
    m = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], "doc_id long, stratum string, " + ", ".join(
        f"{c} {'boolean' if c == 'base_failed' else 'double'}" for c in quality_rules.METRICS))
    labels = spark.createDataFrame([(r["doc_id"], 1) for r in rows], "doc_id long, quality int")
    got = {(r["stratum"], r["rule"]): r for r in quality_rules.cutoffs(m, labels).collect()}
    assert {s for s, _ in got} == {"big"}
    assert got["big", "symbols"]["n_rejected"] <= 3 and got["big", "dup_lines"]["cutoff"] == 0.2


def test_keep_good(spark):
    d = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int")
    kept = quality_rules.keep_good(d, none)
    assert kept.columns == d.columns
    want = sorted(t or "" for t in [*ODD, ODD[-1]] if not (counts(t)[0] < 20 or 100 * counts(t)[4] > 30 * counts(t)[0]))
    assert sorted(r["text"] for r in kept.collect()) == want
    assert quality_rules.judge(d.limit(0), none).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    q = [int(c) for c in s[::-1]]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(q)) % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")))
                    or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)):
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


PRIVATE = ["a@b.c-x_y@d.e @x.y a@b z@q.r.s. 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 +1 (555) 123-4567 é 💥 x@y.zz",
           "", None, "no", "+1+12345678901", "a" * 30000 + " b@c.d", "1" * 30000, "1.1.1.1 " * 700, "4111-1111-1111-1111-"]


def test_base_spans_and_redaction(spark):
    d = frame(spark, PRIVATE)
    got = pii.base_spans(d.select("doc_id", "text")).select("text", pii._told(F.col("__base")).alias("told")).collect()
    for r in got:
        assert r["told"] == plain_spans(r["text"])
    red = pii.redact(d)
    assert red.columns == d.columns
    texts = {r["doc_id"]: r["text"] for r in red.collect()}
    assert texts[0].startswith("<EMAIL><EMAIL> @x.y a@b <EMAIL>. <IP>.<IP> 300.1.1.1 4111 1111 1111 1111 <PHONE> é 💥")  # the card begins at the 1
    assert texts[2] is None and texts[1] == "" and texts[3] == "no"
    assert all(plain_spans(t) == "" for t in texts.values())


def test_bootstrapped_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"word {i} dial hotline +1 (555) 123-{4000 + i} today") for i in range(20)]
    rows += [(100, "other words dial hotline 555-990-1234 today"), (101, "number 555-990-77712 of the parcel")]
    out = {r["doc_id"]: r for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    start = rows[20][1].index("555")
    assert out[100]["spans"] == f"phone:{start}:{start + 12}" and out[100]["base"] == "" and out[100]["n_phone"] == 0
    assert out[101]["spans"] == "" and out[0]["spans"] == out[0]["base"] and out[0]["n_phone"] == 1


def test_bootstrap_goes_on_to_the_second_generation(spark):
    """A pattern without any base seed is trusted through found instances, once their scores have settled."""
    rows = [(i, f"word {i} dial hotline +1 (555) 123-{4000 + i} today") for i in range(500)]
    first, second = [f"555-200-{3000 + i}" for i in range(50)], [f"555-300-{3000 + i}" for i in range(5)]
    rows += [(1000 + i, f"x dial hotline {v} today") for i, v in enumerate(first)]
    rows += [(2000 + i, f"y ring alder {v} tomorrow") for i, v in enumerate(first + second)]
    out = {r["doc_id"]: r["spans"] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, v in enumerate(first + second):
        assert out[2000 + i] == f"phone:13:{13 + len(v)}"


def test_secrets_are_seeds_of_their_own(spark):
    """Long keys after a credential word are told and redacted; hashes and words elsewhere stay."""
    rng = random.Random(3)
    key = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    one, two, three = key(), key(), key(32)
    rows = [(1, f'x token = "{one}" and a@b.cd end'), (2, f"API_KEY: {two}"), (3, f"commit {three} is fine"), (4, "token = " + "a" * 40),
            (5, "the token = short1"), (6, None), (7, f"password='{three}',é token={one}"), (8, f"tokens = {two}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.spans(d).collect()}
    assert out[1]["spans"] == "email:57:63,secret:11:51" and out[1]["base"] == "email:57:63"
    assert out[2]["spans"] == "secret:9:49" and out[2]["base"] == ""
    assert out[7]["spans"] == "secret:10:42,secret:52:92"
    assert all(out[i]["spans"] == "" for i in (4, 5, 6, 8))
    red = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert red[1] == 'x token = "<SECRET>" and <EMAIL> end' and red[7] == "password='<SECRET>',é token=<SECRET>"
    assert red[5] == "the token = short1" and red[6] is None
