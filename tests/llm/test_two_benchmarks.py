"""Two benchmarks in one session, though the broadcast objects get the same id."""

from remitlens.llm import decontaminate


def test_a_second_benchmark_has_its_own_automaton(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "id", lambda _: 7, raising=False)
    docs = spark.createDataFrame([(1, "one two"), (2, "three four")], "doc_id long, text string").coalesce(1)
    for text, left in (("one two", [2]), ("three four", [1])):
        items = spark.createDataFrame([(1, text)], "item_id long, text string")
        kept = decontaminate.decontaminated(docs, items).collect()
        assert [r.doc_id for r in kept] == left
