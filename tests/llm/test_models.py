"""Toxicity and quality models: held-out accuracy on the tables, defined results on odd input; registration."""
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from evograph.llm import quality_classifier, toxicity
from evograph.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_held_out(tables):
    docs, labels = tables
    got = toxicity.score(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    held = got[got.held_out]
    assert ((held.score >= 0) & (held.score <= 1)).all()
    assert held[held.toxic == 1].predicted.mean() >= 0.7
    assert held[held.toxic == 0].predicted.mean() <= 0.05


def test_kneser_ney_sums_to_one(spark):
    """Over all next characters of a context both conditional models are distributions."""
    words = spark.createDataFrame([("abc", 3, 1, 4), ("abd", 1, 5, 6), ("xbd", 0, 2, 2), ("abz", 0, 0, 1)],
                                  "word string, toxic long, ordinary long, every long")
    table = {r["gram"]: r["llr"] for r in toxicity.ratios(toxicity.gram_counts(words)).collect()}
    assert table["^^abc"] > 0 > table["^^abd"] and "^^abz" not in table
    assert "^^ab " in table and "^^^x " in table


def test_ngrams_are_never_merged(spark):
    """More n-grams than the old table had slots: each keeps its ratio, and n-grams that are not held have none."""
    n = (1 << 22) + 200_000
    digits = [F.char(F.lit(97) + F.floor(F.col("id") / 26 ** k) % 26) for k in range(5)]
    grams = spark.range(n).select(F.concat(*digits).alias("gram"), (F.col("id") + 1).cast("double").alias("llr"))
    scorer = toxicity._Scorer(*toxicity.model(grams))

    def gram(i):
        return "".join(chr(97 + i // 26 ** k % 26) for k in range(5))
    at = [*range(0, n, 1009), n - 1, *range(n, 26 ** 5, 1009)]
    got = scorer._find([toxicity._codes("".join(gram(i)[d] for i in at)) for d in range(5)])
    assert got.tolist() == [i + 1 if i < n else 0 for i in at]


def test_context_stands_in_for_its_ngrams(spark):
    t = spark.createDataFrame([("ab漢de", 2.0), ("ab漢d ", -1.0), ("zzzz$", 4.0)], "gram string, llr double")
    scorer = toxicity._Scorer(*toxicity.model(t))
    asked = ["ab漢de", "ab漢dx", "ab漢xe", "zzzze", "qq漢de"]
    got = scorer._find([toxicity._codes("".join(c)) for c in zip(*asked)])
    assert got.tolist() == [2.0, -1.0, 0.0, 0.0, 0.0]


def test_odd_texts_and_no_labels(spark):
    rows = [(1, None), (2, ""), (3, "12 34"), (4, "w" * 3000), (4, "w" * 3000), (None, "word")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(d, none).collect()
    assert len(got) == 6 and {r["score"] for r in got} == {0.5} and {r["predicted"] for r in got} == {0}
    graded = quality_classifier.score(d, none.select("doc_id", F.col("quality").alias("grade"))).collect()
    assert len(graded) == 6 and {r["tail_probability"] for r in graded} == {0.5}
    assert toxicity.score(d.limit(0), none).count() == 0


def test_ordinal_grades_held_out(tables):
    docs, labels = tables
    grade = F.when(F.col("quality") == 0, 0).otherwise(2 - F.col("toxic"))
    got = quality_classifier.score(docs, labels.select("doc_id", grade.alias("grade"))).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert held[held.quality == 1].selected.mean() >= 0.9
    assert held[held.quality == 1].expected_grade.mean() > held[held.quality == 0].expected_grade.mean() + 0.3
    assert got.expected_grade.between(0, 2).all()


def test_fit_sees_the_end_of_long_texts(spark):
    """What tells the grades apart stands after more distinct words than the fit once kept."""
    head = " ".join(f"w{k}" for k in range(3000))
    rows = [(i, f"{head} {' '.join(f'{chr(97 + i % 2)}{k}' for k in range(300))}") for i in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    r = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, grade int")
    numbers, given, vectors = quality_classifier._vectors(d, r)
    slots = quality_classifier._Slots()
    texts = {i % 2: t for i, t in rows}
    assert len(given) == len(vectors.parts) > 50
    for row, grade in zip(numbers, given):
        at, v = quality_classifier.signs(texts[grade], slots)
        got = vectors.of(row)
        assert set(got["at"].tolist()) == set(at.tolist()) and abs(got["value"].sum() - v.sum()) < 1e-3
    held = quality_classifier.score(d, r).where("held_out").toPandas()
    assert (held.expected_grade[held.doc_id % 2 == 1].min() > held.expected_grade[held.doc_id % 2 == 0].max())


def test_letters_count_alike_at_every_length():
    """Half of the letters are capitals, a third of all signs are digits, below and above 65,536 characters."""
    slots = quality_classifier._Slots()
    for n in (60, (1 << 16) - 10, (1 << 16) + 8, 1 << 18):
        at, _ = quality_classifier.signs("Aa1 Bb2 #5 7  " * (n // 14), slots)
        assert slots["\x01capitals 10"] in at[-7:].tolist()


def test_repeated_rows_keep_the_bound(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "MAX_RATED", 7)
    d = spark.createDataFrame([(i % 4, f"t {i % 4}") for i in range(40)], "doc_id long, text string")
    r = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, grade int")
    rows, given, vectors = quality_classifier._vectors(d, r)
    assert len(rows) == len(given) == len(vectors.parts) == 7


def test_thresholds_are_ordered(spark):
    rows = [(i, f"{'good' if i % 3 == 2 else 'fair' if i % 3 else 'bad'} text {i}") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    r = spark.createDataFrame([(i, [1, 4, 9][i % 3]) for i in range(300)], "doc_id long, grade int")
    w, theta, grades = quality_classifier.fit(d, r)
    assert list(grades) == [1, 4, 9] and theta[0] < theta[1]
    got = quality_classifier.score(d, r, 4).toPandas()
    means = [got[got.doc_id % 3 == k].expected_grade.mean() for k in range(3)]
    assert means[0] < means[1] < means[2]


def test_every_operator_has_a_query():
    assert sorted(QUERIES, key=lambda k: int(k[2:].split("_")[0])) == list(QUERIES)
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 11)]


def test_pipeline_stages(spark):
    import corpus_pipeline
    from evograph.session import materialize
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF001), name)
        if name != "best_fit_packing":
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before
