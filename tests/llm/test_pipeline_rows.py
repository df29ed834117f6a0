"""The pipeline's stages decide row by row and keep columns of any name."""

import corpus_pipeline

A, B = "kamu lomi ranka kiki mura " * 12, "schung einlod merung odsch ein " * 12


def test_null_and_repeated_ids(spark):
    rows = [(i, A if i % 2 else B, "aa" if i % 2 else "bb") for i in range(200)]
    rows += [(None, A, "aa"), (500, A, "aa"), (500, "12 !! 34", "aa"), (None, "12", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in corpus_pipeline.language_id(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted(rows[:202], key=str)


def test_column_named_chunk(spark):
    rows = [(1, A, "x", len(A)), (2, "front matter " + A, "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string, n_chars long")
    out = corpus_pipeline.suffix_array_dedup(spark, docs, "")
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and got[1].chunk == "x" and got[2].chunk == "y" and got[2].n_chars == len(got[2].text) < 20
