"""The audit against filters applied one after the other."""

import re
from itertools import permutations

from remitlens.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, source string, n string"
MANY = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (5, MANY, "en", "a", "x"), (1, MANY, "de", "a", "x"), (1, MANY, "en", "a", "x"), (9, MANY, None, "a", "x"),
    (None, MANY, "en", "a", "x"), (2, None, "en", None, None), (3, "", "", None, "x"), (4, "", "en", "b", "x"),
    (6, MANY.upper(), "en", "a", "x"), (7, MANY + " #", "en", "a", "x"), (8, "same word " * 90, "de", "a", "x"),
    (10, "A | b", None, "a", "x"), (11, "é" * 300_000 + " $ " + MANY, "en", "a", "x"), (12, MANY.upper() + " |", "de", "a", "x"),
]
LABELS = [(1, 1, 0), (1, 0, None), (5, 1, 1), (6, None, 1), (8, 1, 0), (None, 1, 1), (10, 0, 1), (99, 1, 1)]


def failing(row, rows):
    text = row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
        "E": row[0] is not None
        and any(r[0] is not None and r[0] < row[0] and (r[1] or "") == text for r in rows),
    }


def brute_force(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    out = []
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], failing(r, rows)) for r in rows if (r[2] or "") == part]
        lines = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                fails = [r for r in mine if r[1][f]]
                lines.append((
                    f, part, "".join(order), step, len(left), len(gone), len(fails) - len(gone),
                    sum(sum(r[1].values()) == 1 for r in fails),
                    sum(r[0] in good for r in gone if r[0] is not None),
                    sum(r[0] in toxic for r in gone if r[0] is not None),
                ))
        for line in lines:
            out.append((*line[1:], sum(x[5] for x in lines if x[0] == line[0])))
    return sorted(out)


def test_all_orders(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, filter_audit.audit(docs, labels).collect())) == brute_force(ROWS, LABELS)


def test_hot_copies(spark):
    rows = [(i, "copy", "en", "a", "x") for i in range(3000)] + [(i, f"t{i}", "en", "a", "x") for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = filter_audit.audit(docs, labels).where("filter_order = 'EABCD' and step = 1").first()
    assert (made.kept, made.removed, made.good_lost) == (51, 2999, 0)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).collect() == []
