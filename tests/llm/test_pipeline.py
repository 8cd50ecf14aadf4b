import corpus_pipeline
import public_tokenizers

from premia.llm import jaccard, secrets, sentencepiece, toxicity

SF_DIR = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / str(number)))
        after = spark.read.parquet(str(tmp_path / str(number)))
        rows = after.collect()
        if number < 4:
            assert after.columns == columns
        ids = [r.doc_id for r in rows]
        if number == 0:
            gone = set(before) - set(ids)
            rejected = model.rejects([before[k].text for k in sorted(before)])
            assert gone == {k for k, r in zip(sorted(before), rejected) if r}
            assert len(ids) == len(set(ids))
        if number == 1:
            classes = {r.doc_id: r.class_id for r in jaccard.classes(docs).collect()}
            assert sorted(ids) == sorted(set(classes.values()))
        if number == 2:
            automaton = secrets.compile_rules()
            found = dict(zip(before, secrets.scan_texts([r.text for r in before.values()], automaton)))
            assert sorted(ids) == sorted(before)
            for row in rows:
                assert bool(found[row.doc_id]) == (row.text != before[row.doc_id].text)
                assert row.n_chars == len(row.text)
        if number == 3:
            assert set(ids) <= set(before)
            assert all(before[r.doc_id] == r for r in rows)
            assert max(ids.count(k) for k in ids) == 2
        if number == 4:
            pieces = sentencepiece.loaded(public_tokenizers.path("piece_bpe_32k.model"))
            assert len(rows) == docs.count()
            assert all(pieces.decode(r.ids) == before[r.doc_id].text for r in rows)
        docs = after


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0


def test_run_is_registered(spark):
    from __spark_entry__ import oracle_sql, queries
    assert "pipeline" in queries() and "pipeline" not in oracle_sql()
    assert corpus_pipeline.run(spark, SF_DIR).columns == ["doc_id", "ids"]
