"""SimHash links of the near-dedup stage."""

import corpus_pipeline
from remitlens.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, n_chars long"


def test_fingerprints_link_copies_that_no_bucket_joins(spark, monkeypatch):
    shared = near_copies._shared
    monkeypatch.setattr(near_copies, "_shared", lambda members: shared(members).where("false"))
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words), " ".join([*words[:1000], "new", *words[1001:]]), "other words", "", " "]
    prints = [simhash.fingerprint(t.encode()) for t in texts]
    assert 0 <= (prints[0] ^ prints[1]).bit_count() <= simhash.MAX_BITS
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_equal_fingerprints_are_compared_by_their_shingles(spark):
    # the same 3-word shingles in another order: one fingerprint, other 5-word shingles
    rows = [(0, "a b c a b d a b c a b", 1), (1, "a b d a b c a b c a b", 1), (2, "A b c  a b d a b c a b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1]
