"""The quality classifier learns from every training label, however many there are."""

import pytest
from pyspark.sql import functions as F

from remitlens.llm import quality_classifier as quality
from remitlens.llm.common import train_labels


@pytest.fixture(scope="module")
def labelled(spark):
    good = "the river runs past the old mill and the road turns north by the bridge"
    bad = "buy ### cheap $$$ now now now click %%% here here win ### free"
    rows = [(i, f"{good if i % 2 else bad} w{i % 23}", i % 2) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    return table.select("doc_id", "text"), table.select("doc_id", "quality")


def test_every_training_label_is_learnt_from(labelled, monkeypatch):
    docs, labels = labelled
    seen = []
    averaged = quality._averaged

    def watched(rows):
        seen.append((rows.count(), rows.select("shard").distinct().count()))
        return averaged(rows)

    monkeypatch.setattr(quality, "_averaged", watched)
    machine = quality.fit_quality(docs, labels, 60)
    known = train_labels(labels, "quality").count()
    assert seen == [(known, -(-known // 60))] and known > 200
    scored = quality.score_quality(docs, machine).join(labels, "doc_id")
    wrong = scored.where((F.col("quality_score") >= 0.5).cast("int") != F.col("quality"))
    assert wrong.count() == 0
    again = quality.fit_quality(docs.repartition(7), labels, 60)
    assert (again.weight == machine.weight).all() and (again.factor == machine.factor).all()


def test_labels_of_no_document(labelled):
    docs, labels = labelled
    machine = quality.fit_quality(docs.where("doc_id < 0"), labels, 60)
    scored = quality.score_quality(docs.limit(3), machine).collect()
    assert [r.quality_score for r in scored] == [0.5] * 3
