"""The pipeline's stages on a small corpus, each against a brute-force version on its own input."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)
    make = lambda k: " ".join(f"v{rnd.randint(0, 4000)}" for _ in range(k))
    bench = [(i, f"{make(30)}. {make(10)}.") for i in range(5)]
    rows = [(i, make(80), "en", f"src{i % 3}", 0) for i in range(40)]
    rows += [(40 + i, rows[i][1] + " tail", "en", "s", 0) for i in range(10)]  # near copies of 0..9
    rows += [(60, make(20) + " " + bench[2][1] + " " + make(20), "en", "s", 0), (61, "12 34 !!", "en", "s", 0), (62, None, None, None, None), (63, make(9) + " 10.1.2.3", "fr", "s", 4)]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), {r[0]: r[1] for r in rows}


def test_stages(spark, corpus):
    d, texts = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r.doc_id for r in docs.collect()}
    assert kept["language"] == set(texts) - {61, 62}
    assert kept["near_dup"] == kept["language"] - set(range(40, 50))
    assert kept["decontaminate"] == kept["near_dup"] - {60}
    assert kept["pii"] == kept["decontaminate"]
    by = {r.doc_id: r for r in docs.collect()}
    assert "10.1.2.3" not in by[63].text and by[63].n_chars == len(by[63].text) and by[0].text == texts[0]


def test_near_dup_of_repeated_and_missing_ids(spark):
    rnd = random.Random(12)
    a, b, c, d, e = (" ".join(f"v{rnd.randint(0, 4000)}" for _ in range(80)) for _ in range(5))
    rows = [(1, a), (1, a), (2, a), (2, a), (3, b), (3, c), (None, d), (None, d), (None, d + " tail"), (None, c), (None, None), (None, None), (4, e), (5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    left = [tuple(r) for r in corpus_pipeline.near_dup(spark, docs, "").collect()]
    assert sorted(x for x in left if x[0] is not None and x[0] != 3) == [(1, a), (4, e), (5, None)]
    assert left.count((3, b)) == 1 and sum(t == c for _, t in left) == 1
    assert sum((t or "").startswith(d) for _, t in left) == 1 and left.count((None, None)) == 2
    assert len(left) == 8


def test_run(spark, corpus):
    d, _ = corpus
    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in got} == {*range(40), 63}
    assert all(r.length > 0 for r in got)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_tables(spark, corpus, name):
    """No row, repeated rows, nulls in every column, a very long text, and extra columns with clashing names."""
    d, _ = corpus
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, block int, id string, sequence_id string"
    empty = stage(spark, spark.createDataFrame([], schema), d)
    assert empty.count() == 0
    rnd = random.Random(31)
    make = lambda k: " ".join(f"v{rnd.randint(0, 4000)}" for _ in range(k))
    rows = [(i, make(60), "en", "s", 9, "x", 1, "y", "z") for i in range(30)]
    rows += [rows[0]] * 3 + [(100, make(60_000), None, None, None, None, None, None, None), (101, "", "en", None, 0, None, 1, None, None), (None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, d)
    got = out.collect()
    if name == "packing":
        assert sum(r.start == 0 for r in got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
        return
    assert out.columns == docs.columns
    left = {"language": len(rows) - 2, "near_dup": len(rows) - 3}.get(name, len(rows))
    assert len(got) == left and {r.doc_id for r in got} >= {*range(30), 100}
    if name != "pii":
        assert set(map(tuple, got)) <= set(rows)
