"""Tables that fill, formats that run out, columns that clash."""

import random
import re
import string

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from remitlens.llm import pii, token_count
from remitlens.llm.transducer import Merges, Transducer

BYTE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def merges():
    return Merges(BYTE)


def random_letters(n, seed=1):
    draw = random.Random(seed)
    return "".join(draw.choice(string.ascii_letters) for _ in range(n))


@pytest.mark.parametrize("bits", [7, 12, 18])
def test_a_full_table_is_cleared_in_between(merges, bits):
    machine = Transducer(merges, table_bits=bits)
    library = Tokenizer.from_file(BYTE)
    words = [random_letters(n, n) for n in (1, 5, 40, 300, 2047, 2049, 9000)] + ["ab" * 4000, "a" * 30_000]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    got = machine.counts(data, end - [len(w) for w in words], end)
    assert got.tolist() == [len(library.encode(w, add_special_tokens=False).ids) for w in words]


def test_one_long_word(spark):
    text = random_letters(100_000) + " and " + "é" * 50_000
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    library = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(docs, BYTE).collect()}
    assert got == {1: len(library.encode(text, add_special_tokens=False).ids), 2: 0}


def check(drawn, names):
    found = [(r.type, r.drawn.lower()) for r in drawn]
    assert len(set(found)) == len(found) == len(names)
    assert not set(found) & set(names)


def test_tiny_formats_widen(spark):
    names = [("email", f"{a}@{b}.co") for a in string.ascii_lowercase for b in string.ascii_lowercase]
    names += [("ssn", f"{i:09d}") for i in range(50)] + [("phone", f"{i:03d}") for i in range(1000)]
    table = spark.createDataFrame(names, "type string, name string")
    check(pii.distinct_surrogates(table).collect(), names)


def test_many_single_names(spark):
    names = spark.range(100_000).select(
        F.lit("man").alias("type"), F.translate(F.col("id").cast("string"), string.digits, "abcdefghij").alias("name")
    )
    drawn = pii.distinct_surrogates(names).select("type", "drawn")
    counted = drawn.agg(F.count("*"), F.countDistinct(F.lower("drawn"))).first()
    assert tuple(counted) == (100_000, 100_000)


def test_widened_forms_are_written_whole(spark):
    texts = [(i, f"mail {a}@{b}.co now") for i, (a, b) in enumerate((a, b) for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz")]
    made = pii.replace_personal_data(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    mails = [re.fullmatch(r"mail (\S+@\S+\.co) now", r.text)[1] for r in made]
    assert len(set(mails)) == len(texts) and not set(mails) & {t.split()[1] for _, t in texts}


def test_clashing_columns(spark):
    rows = [(1, "to a@b.co", "r", 5, 7), (2, "nothing", "s", 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, _new int, n_replaced int")
    made = pii.replace_personal_data(docs)
    assert made.columns == ["doc_id", "text", "_row", "_new", "n_replaced"]
    got = sorted(tuple(r) for r in made.collect())
    assert [g[2:] for g in got] == [("r", 5, 1), ("s", 6, 0)]
    assert got[0][1] != "to a@b.co" and got[1][1] == "nothing"
