"""Toxic passages: every occurrence scores."""

import numpy as np

from remitlens.llm import toxicity
from remitlens.llm.features import hashed_words

CLEAN = " ".join(f"plain{i}" for i in range(60))
BAD = "vile wicked"


def lexicon(words):
    raw = np.frombuffer(words.encode(), np.uint8)
    key = np.sort(toxicity.slots(hashed_words(raw, np.array([0, len(raw)]), stems=True))[0])
    return toxicity.Lexicon(key, np.full(len(key), 5.0), np.full(len(key), 9.0), 1.0)


def test_a_repeated_passage_is_found_again(spark):
    text = f"{BAD} {CLEAN} {BAD} {CLEAN}"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = toxicity.score_segments(docs, lexicon(BAD)).first()
    assert [(s.first, s.last) for s in row.segments] == [(0, 2), (62, 64)]
    assert [text[s.start : s.stop] for s in row.segments] == [BAD, BAD]
    assert len(row.fresh) == 1


def test_a_passage_of_one_repeated_word_has_its_whole_score(spark):
    docs = spark.createDataFrame([(1, "vile " * 4)], "doc_id long, text string")
    row = toxicity.score_segments(docs, lexicon(BAD)).first()
    assert len(row.segments) == 1 and abs(row.segments[0].score - 4 * (5.0 - toxicity.TOLL)) < 1e-9
    assert len(row.fresh) == 1 and abs(row.fresh[0] - (5.0 - toxicity.TOLL)) < 1e-9
