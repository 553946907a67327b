"""The stages on a small table with odd rows."""

import random

import pytest

import corpus_pipeline


def test_stages_keep_clean_documents_and_pack_them(spark, tmp_path):
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    rows = [(i, prose(120), "en", rng.choice(["a", "b", None]), 1) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " more", "en", "a", 1) for i in range(5)]
    rows += [(None, None, None, None, None), (200, "", "en", "a", 0), (201, "too short", "en", "a", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS), name
        if k == 2:
            assert sorted(r.doc_id for r in docs.collect()) == list(range(40))
    packed = docs.toPandas()
    assert (packed.groupby("sequence_id")["length"].sum() <= 2048).all()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
    one, two = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))
    corpus_pipeline.close(corpus_pipeline.run(spark, str(tmp_path)))
    # each result owns its tables, whatever ran since
    rows = sorted(map(str, one.collect()))
    assert rows == sorted(map(str, two.where("length > 0").collect())) and len(rows) == len(packed)
    corpus_pipeline.close(one)
    assert two.count() == len(packed)
    with pytest.raises(Exception, match="FILE_NOT_EXIST"):
        one.count()
