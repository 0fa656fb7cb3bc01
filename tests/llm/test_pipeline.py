import corpus_pipeline


def test_stages_keep_columns_and_run(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        docs = docs.cache()
        assert docs.count() > 0
    assert set(corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
