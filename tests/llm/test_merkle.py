"""The manifest against digests computed row by row."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from remitlens.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encode(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars, _ = row
    return sha("".join(map(encode, (doc_id, source, lang, n_chars, text))))


def climb(nodes):
    """The root, and for every node its siblings per level, left and right."""
    paths = [[] for _ in nodes]
    members = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 16, len(nodes))) for i in range(0, len(nodes), 16)]
        for run in runs:
            for i in run:
                left = "".join(nodes[k] for k in run if k < i)
                right = "".join(nodes[k] for k in run if k > i)
                for m in members[i]:
                    paths[m].append((left, right))
        members = [[m for i in run for m in members[i]] for run in runs]
        nodes = [sha("".join(nodes[i] for i in run)) for run in runs]
    return nodes[0], paths


def brute_force(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        found = groups[source]
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[source] = (found, *climb([leaf_of(r, r[1]) for r in found]))
    root, above = climb([trees[s][1] for s in order])
    out = []
    for source, up in zip(order, above):
        found, subroot, paths = trees[source]
        for row, path in zip(found, paths):
            path = path + up
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = leaf_of(row, lower(row[1]) if tampered else row[1])
            for left, right in path:
                node = sha(left + node + right)
            proof = sha("".join(a + b for a, b in path))
            out.append((row[0], leaf_of(row, row[1]), subroot, root, proof, node, node == root))
    return sorted(out, key=str)


def found(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    made = merkle.manifest(merkle.leaves(docs))
    folded = merkle.fold(F.coalesce("altered", "leaf"), F.col("path"))
    made = made.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), folded,
        folded == F.col("root"),
    )
    return sorted((tuple(r) for r in made.collect()), key=str)


def test_levels_runs_and_sources(spark):
    rows = [(i, f"Text {i}", "en", "hot", i, "x") for i in range(16 * 16 + 1)]
    rows += [(i, f"Text {i}", "en", f"s{i % 40}é", None, "x") for i in range(300, 420)]
    rows += [(i, "a", None, None, 1, None) for i in range(17)]
    rows += [(500, "Alone", "de", "", 1, "x")]
    assert found(spark, rows) == brute_force(rows)


def test_nulls_ties_and_long_texts(spark):
    rows = [
        (1, None, None, None, None, None), (1, "", "", "", 0, "x"), (2, "Same", "en", "a", 4, "x"),
        (2, "Same", "en", "a", 4, "x"), (2, "Other", "en", "a", 4, "x"), (None, "No Id", "en", "a", 4, "x"),
        (None, None, "en", "a", None, "x"), (3, "LONG Wört " * 200_000, "en", "a", 9, "x"),
        (-4, "Minus", "en", "A", 4, "x"),
    ]
    assert found(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("rows", [[(7, "One", "en", "a", 3, "x")], [(i, "T", "en", "a", 1, "x") for i in range(3)]])
def test_one_source(spark, rows):
    assert found(spark, rows) == brute_force(rows)


def test_changes_are_seen(spark):
    rows = [(i, f"Text {i}", "en", f"s{i % 3}", i, "x") for i in range(200)]
    for row in found(spark, rows):
        assert row[-1] == (zlib.crc32(str(row[0]).encode()) % 5 != 0)


def test_empty(spark):
    assert found(spark, []) == []
