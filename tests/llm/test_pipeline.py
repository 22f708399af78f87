"""The pipeline's stages keep what they should, on the smallest tables."""

import corpus_pipeline
from tracery.llm.decontam import contamination
from tracery.llm.nearcopies import without_near_copies
from tracery.llm.pii import pseudonymise, session_key
from tracery.llm.quality import classify
from tracery.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    want = ids(classify(docs, labels).where("predicted = 1"))
    (_, quality), (_, near), (_, clean), (_, private), (_, mix) = corpus_pipeline.STAGES
    out = quality(spark, docs, DIR)
    assert out.columns == docs.columns and ids(out) == want
    want = ids(without_near_copies(out))
    out2 = near(spark, out, DIR)
    assert out2.columns == docs.columns and ids(out2) == want
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    want = ids(contamination(out2, items).where("not contaminated"))
    out3 = clean(spark, out2, DIR)
    assert out3.columns == docs.columns and ids(out3) == want
    out4 = private(spark, out3, DIR)
    assert out4.columns == docs.columns and ids(out4) == want
    assert {r.text for r in out4.collect()} == {r.text for r in pseudonymise(out3, session_key(spark)).collect()}
    out5 = mix(spark, out4, DIR)
    rows = out5.collect()
    assert {r.doc_id for r in rows} <= want and all(0 < r.taken <= 2 * r.size for r in rows)
    assert abs(sum(r.taken for r in rows) / sum(r.size for r in mix(spark, out4, DIR).collect()) - 1.5) < 0.3
    assert {r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()} == {r.doc_id for r in rows}


def test_every_query_runs(spark):
    for name, query in QUERIES.items():
        assert query(spark, DIR).count() > 0, name


CLASH = "doc_id long, text string, lang string, source string, n_chars long, n_found int, n_replaced int, _pii int, _i int, _t int, tie int, h int, row int, id int, size int, taken string, target double"


def odd_documents(spark):
    """Nulls in all columns, empty and very long texts, ties, repeated rows and ids, and columns that clash with names used inside."""
    long = " ".join(f"w{i % 1013}" for i in range(60_000))
    texts = [("a calm sea " * 9 + str(i), "s") for i in range(30)] + [(None, None), ("", "s"), (long, "t"), (long, "t"), ("card 4111111111111111 x", "t")]
    rows = [(i, t, "en", s, 7, 55, 56, 57, 58, 59, 60, 61, 62, 63, 64, "took", 6.5) for i, (t, s) in enumerate(texts)]
    rows += [rows[3], rows[3], (3, "another text with the id of one above", "en", "s", *rows[0][4:]), (None, "no id", None, None, *[None] * 13), (None,) * 17]
    return spark.createDataFrame(rows, CLASH).repartition(3)


def test_stages_on_odd_tables(spark, tmp_path):
    docs = odd_documents(spark)
    base = str(tmp_path)
    spark.createDataFrame([(i, i % 2) for i in range(30)] + [(0, None), (None, 1)], "doc_id long, quality int").coalesce(1).write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (2, None), (3, "")], "item_id long, text string").coalesce(1).write.parquet(f"{base}/benchmark.parquet")
    rest = lambda r: tuple(r)[4:]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, base)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert {rest(r) for r in rows} <= {rest(r) for r in docs.collect()}, name
        assert stage(spark, docs.limit(0), base).count() == 0, name
    kept = corpus_pipeline.near_duplicates(spark, docs, base).collect()
    # equal rows are one, a repeated id with another text and rows without an id stay
    assert sum(r.doc_id == 3 for r in kept) <= 2 and any(r.text == "another text with the id of one above" for r in kept) and sum(r.doc_id is None for r in kept) == 2
    assert not any((r.text or "").startswith("w0 w1 ") for r in corpus_pipeline.decontamination(spark, docs, base).collect())
    private = corpus_pipeline.private_data(spark, docs, base).collect()
    assert len(private) == docs.count() and not any("4111111111111111" in (r.text or "") for r in private) and {r.n_found for r in private} == {55, None}
    mix = corpus_pipeline.mixing(spark, docs, base)
    assert mix.columns[:5] == ["doc_id", "mix_size", "source_size", "mix_target", "mix_taken"] and set(docs.columns) <= set(mix.columns)
    rows = mix.collect()
    assert rows and all(0 < r.mix_taken <= 2 * r.mix_size and r.taken in ("took", None) and r.size in (64, None) for r in rows)
    assert corpus_pipeline.mixing(spark, docs.limit(0), base).count() == 0
