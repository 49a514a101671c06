"""The pipeline and the contracts' columns, on the smallest tables."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_stage_keeps_the_columns_and_only_drops(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.6 * len(ids)
        ids = left
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.where("not round_trip").count() == 0


CONTRACTS = {
    "op2_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op3_": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op4_": ["page_id", "host", "path", "rule", "verdict"],
    "op6_": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op7_": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op8_": ["doc_id", "held_out", "score", "predicted"],
    "op10_": ["doc_id", "n_shingles", "component_id"],
}


@pytest.mark.parametrize("start", [f"op{n}_" for n in range(1, 11)])
def test_contracts(spark, start):
    import __spark_entry__

    (name,) = [q for q in __spark_entry__.queries() if q.startswith(start)]
    df = __spark_entry__.queries()[name](spark, FOLDER)
    assert {*CONTRACTS.get(start, [])} <= {*df.columns}
    rows = df.count()
    table = spark.read.parquet(f"{FOLDER}/{'pages' if start == 'op4_' else 'documents'}.parquet").count()
    assert rows == table if start != "op5_" else 0 < rows < table
