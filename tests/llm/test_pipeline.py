import corpus_pipeline
from aeroledger.llm.secret_scan import automaton, spans_of


def test_stages_act(spark, documents, sentences, tmp_path):
    en, items = sentences(60, 40), sentences(3, 30, seed=4)
    junk = [(900, "12 34 56", "en", "a"), (901, None, "en", "a"), (902, "", None, "b")]
    docs = [(i, t, "en", ("a", "b")[i % 2]) for i, t in enumerate(en)]
    docs += [(100, en[0], "en", "a"), (101, en[1] + " more", "en", "a"), (102, f"{en[2]} {items[0]} {en[3]}", "en", "b")]
    docs += [(103, f"{sentences(1, 40, seed=7)[0]} token = abcdef0123456789", "en", "b"), (None, sentences(1, 40, seed=8)[0], "en", None)]
    table = documents(*docs, *junk)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if n < 4:
            assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{n}")
        now = spark.read.parquet(f"{tmp_path}/{n}")
        left.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert {i for i, *_ in docs} == left[0]
    assert left[0] - left[1] == {100, 101}
    assert left[1] - left[2] == {102}
    assert left[2] == left[3] == left[4]
    texts = [r["text"] for r in spark.read.parquet(f"{tmp_path}/3").collect()]
    assert not any(spans_of(t, automaton()) for t in texts)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(left[4])


def test_empty_tables(spark, documents, tmp_path):
    documents().write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
