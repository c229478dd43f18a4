import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_work_on_their_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert counts[0] >= counts[1] > counts[2] >= counts[3] > 100
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_stages_follow_one_another_without_being_written(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
