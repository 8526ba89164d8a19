"""New words reach the tokenizer library many at a time; ids are those of whole texts."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from remitlens.llm.tokens import WORDS_A_CALL, WordTokenizer

WORD = public_tokenizers.path("word_bpe_49k.json")


def test_many_new_words_are_one_text_of_the_library(monkeypatch):
    tokenizer, sent = WordTokenizer(WORD), []
    plain = tokenizer._ids_of
    monkeypatch.setattr(tokenizer, "_ids_of", lambda texts: sent.extend(texts) or plain(texts))
    texts = [f"word{i}x thing{i}&&& other{i}***" for i in range(1000)]
    got = tokenizer.encode([t.encode() + b"\n" for t in texts], 0)
    library = Tokenizer.from_file(WORD)
    assert [g.tolist() for g in got] == [library.encode(t).ids + [0] for t in texts]
    assert len(tokenizer._memo) == 3002  # the two runs of signs are words once
    assert len(sent) <= 2 + 3002 // WORDS_A_CALL


def test_ids_of_odd_texts_are_those_of_the_library():
    parts = list("abz09'.,!<|>$_ \n\t\x01\x1c\x85é̸́ÀŤ中´٣İ") + ["'s", "'LL ", "<|endoftext|>"]
    rng = random.Random(3)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)]
    library = Tokenizer.from_file(WORD)
    tokenizer = WordTokenizer(WORD, memo_words=500)
    for i in range(0, len(texts), 20):
        got = tokenizer.encode([t.encode() for t in texts[i : i + 20]])
        for t, ids in zip(texts[i : i + 20], got, strict=True):
            assert library.encode(t, add_special_tokens=False).ids == ids.tolist()
