"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import html, linededup, mixing, neardup, packing, pii, quality, secrets, tokens, topk, toxicity
from lodestar.llm.queries import VOCABULARY
from tests.llm.test_operators import WORD, brute_classes, brute_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, class_id long, bands string, key string, line int, k1 long, first long, rank int, node long, a long, b long, version long, stream long, position double, taken long, __none string"
LONG = " ".join(f"w{k % 977}" for k in range(60_000)) + "\n" + "x" * 50_000
ROWS = [(1, "the same text of seven words here", "en", "s1"), (1, "the same text of seven words here", "en", "s1"), (2, None, "en", None), (None, "the same text of seven words here", None, "s2"), (3, "", "de", "s2"), (4, "  \n\t\n ", None, None), (5, LONG, "en", "s1"), (6, "the same text of seven words here", "en", "s3"), (7, "short", "fr", "s3"), (8, LONG, "en", "s2")]


def frame(spark, rows):
    df = spark.createDataFrame([(*r, *[None] * 18) for r in rows], SCHEMA)
    return df.drop("__none")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 1), (None, 1, 1), (7, None, None), (8, 0, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "secrets": lambda d, labels: secrets.scan(d, VOCABULARY),
    "pii": lambda d, labels: pii.detect(d),
    "mixing": lambda d, labels: mixing.mix(d),
    "quality": lambda d, labels: quality.judge(d),
    "toxicity": toxicity.detect,
    "linededup": lambda d, labels: linededup.report(d),
    "neardup": lambda d, labels: neardup.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, labels, name):
    found = OPERATORS[name](frame(spark, ROWS), labels)
    ids = sorted((r.doc_id for r in found.select("doc_id").collect()), key=lambda x: (x is None, x))
    assert ids == [1, 1, 2, 3, 4, 5, 6, 7, 8, None]


@pytest.mark.parametrize("name", [*OPERATORS, "packing"])
def test_empty_table(spark, labels, name):
    operator = OPERATORS.get(name, lambda d, labels: packing.pack(d, VOCABULARY))
    assert operator(frame(spark, []), labels.limit(0)).count() == 0


def test_defined_results(spark, labels):
    docs = frame(spark, ROWS)
    same = {(r.doc_id, r.class_id, r.kept) for r in neardup.near_duplicates(docs).collect()}
    assert {(1, 1, True), (6, 1, False), (8, 5, False), (5, 5, True), (None, None, True), (3, 3, True)} <= same
    assert sorted(r.doc_id or 0 for r in neardup.without_near_duplicates(docs).collect()) == [0, 1, 2, 3, 4, 5, 7]
    lines = {(r.doc_id, r.n_removed) for r in linededup.report(docs).collect()}
    assert {(6, 1), (8, 2), (1, 0), (2, 0), (None, 0)} <= lines
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert judged[2].n_words == 0 and judged[2].base_failed and judged[5].n_words == 60_001 and judged[5].n_repeat_words == 60_000
    packed = packing.pack(docs, VOCABULARY).toPandas()
    assert packed[packed.doc_id == 3].length.tolist() == [1] and packed.length.max() == 2048
    scored = {r.doc_id: r.score for r in toxicity.detect(docs, labels).collect()}
    assert all(0 <= s <= 1 for s in scored.values())
    none = toxicity.detect(docs, labels.limit(0)).agg(F.max("score")).first()[0]
    assert none == 0


def test_pages(spark):
    rows = [(1, None, None), (1, "u", ""), (None, "u", "<p>one two</p>" * 20_000), (2, "u", "<<< a > b <p class='"), (2, "u", "<script>never closed <p>x"), (3, "u", "<div><form>never closed but full of words")]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))).collect()
    assert len(found) == 6 and max(r.n_chars for r in found) == 8 * 20_000 - 1
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_vectors(spark):
    nan = float("nan")
    rows = [(0, [0.5, 0.5]), (0, [0.5, 0.5]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [nan, 0.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 2.0, 3.0]), (6, [-0.01, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1))
    found = [tuple(r)[:4] for r in topk.top(df).orderBy("query_id", "rank").select("query_id", "rank", "vec_id", "score").collect()]
    assert found[:3] == [(0, 1, 1, 2048), (0, 2, 20, 2048), (0, 3, 6, -32)]
    assert [f[2] for f in found[3:]] == [0, 0, 1, 6]
    assert topk.top(df.limit(0)).count() == 0


def test_stages_keep_columns(spark, labels, tmp_path):
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = frame(spark, ROWS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, f"file://{tmp_path}")
        assert found.columns == docs.columns and found.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), f"file://{tmp_path}").count() == 0


def cut(text, words):
    return text[: [m.end() for m in WORD.finditer(text)][words - 1]]


def test_pipeline(spark, small):
    """The pieces of run() against the stages by brute force, from the verdicts of the toxicity model on."""
    documents = spark.read.parquet(f"{small}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.detect(documents, spark.read.parquet(f"{small}/labels.parquet")).where("predicted = 1").collect()}
    rows = sorted((r.doc_id, r.text or "", r.source) for r in documents.collect() if r.doc_id not in toxic)
    gone = brute_lines([r[:2] for r in rows])
    texts = {k: "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone) for k, t, _ in rows}
    least = brute_classes(texts)
    texts = {k: t for k, t in texts.items() if least.get(k, k) == k}
    kept = spark.createDataFrame([(k, texts[k], source) for k, _, source in rows if k in texts], "doc_id long, text string, source string")
    encode, want = tokens.encoder(VOCABULARY), collections.Counter()
    for r in mixing.mix(kept).where("taken > 0").collect():
        for taken in range(0, r.taken, r.size):
            words = min(r.size, r.taken - taken)
            ids = encode(texts[r.doc_id] if words == r.size else cut(texts[r.doc_id], words)) + bytes(4)
            n = len(ids) // 4
            starts = [0, *range((n - 1) % 2048 + 1, n, 2048)]
            want.update((r.doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])))
    found = corpus_pipeline.run(spark, small).toPandas()
    assert collections.Counter(zip(found.doc_id, found.piece, found.start, found.length, found.ids_crc32)) == want
    ordered = found.sort_values(["sequence_id", "offset"])
    ends = ordered.groupby("sequence_id").length.cumsum()
    assert (ends - ordered.length == ordered.offset).all() and ends.max() <= 2048
