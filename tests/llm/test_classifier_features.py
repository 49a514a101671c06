"""The classifier's training on huge texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from basalt.llm import quality_classifier


def test_a_huge_text_teaches_with_all_its_features(spark, monkeypatch):
    class Taken(Exception):
        pass

    def taken(self, function, schema):
        raise Taken(function)

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", taken)
    with pytest.raises(Taken) as seen:
        quality_classifier.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    (counted,) = seen.value.args
    rng = random.Random(1)
    text = " ".join(f"{rng.randrange(1 << 60):x}" for _ in range(40_000))
    (found,) = counted([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text], "label": [1]})])
    own = np.unique(np.concatenate([b for _, _, b, _ in quality_classifier.features(pa.array([text]))]))
    assert len(own) > 1 << 16
    assert np.array_equal(found.column("buckets")[0].values, own)
