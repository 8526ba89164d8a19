"""The near-dedup stage against brute force over whole shingle sets."""

import random
import re

import corpus_pipeline
from remitlens.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_kept(rows):
    sets = [brute_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append((doc is None, doc or 0))
    return sorted(min(ids) for ids in least.values())


def edited_copies():
    draw = random.Random(7)
    texts = [None, "", " \n", "two words", "Two  words", "one two three four five"]
    for size in (12, 64, 200, 900):
        for _ in range(6):
            base = [f"w{draw.randrange(5000)}" for _ in range(size)]
            texts.append(" ".join(base))
            for edits in (1, 2, 4, 8, 16):
                copy = list(base)
                for _ in range(edits):
                    copy[draw.randrange(size)] = f"new{draw.randrange(5000)}"
                texts.append(" ".join(copy))
    # a chain of copies of copies, and a family round one template
    chain = [f"c{i}" for i in range(100)]
    for step in range(12):
        texts.append(" ".join(chain))
        chain[step * 8] = f"d{step}"
    family = [f"f{i}" for i in range(300)]
    texts += [" ".join([*family[:150], f"slot{i}", *family[150:]]) for i in range(80)]
    draw.shuffle(texts)
    return list(enumerate(texts))


def kept_of(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    return sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())


def test_edited_copies_against_brute_force(spark):
    rows = [*edited_copies(), (None, "two words")]
    want = brute_kept(rows)
    assert len(want) < len(rows) - 100
    assert kept_of(spark, rows) == want


def test_stage_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    kept = [i for _, i in kept_of(spark, rows)]
    assert [(False, i) for i in kept] == brute_kept(rows)
    assert not {2, 56} <= set(kept)  # one word of 64 was changed


def test_bands_reach_the_stated_chance():
    assert (1 - 0.8**near_copies.BAND_ROWS) ** near_copies.band_count(0.8) < near_copies.MISS


def far_family(n, words=240, changed=27, seed=5):
    """Texts that each change some words of one template: most pairs are less alike than 0.8."""
    draw = random.Random(seed)
    base = [f"t{i}" for i in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for k in range(changed):
            text[draw.randrange(words)] = f"x{i}_{k}"
        rows.append((i, " ".join(text)))
    # some of them copied with one word changed
    rows += [(n + i, t.replace("t100 ", "y ").replace("t7 ", "z ")) for i, t in rows[: n // 10]]
    return rows


def test_a_family_below_the_similarity(spark):
    rows = far_family(500)
    assert kept_of(spark, rows) == brute_kept(rows)


def torn_family(n=160, words=120, seed=11):
    """A family that crowds its buckets, mostly below the similarity, with pairs just above it."""
    draw = random.Random(seed)
    base = [f"t{i}" for i in range(words)]

    def changed(text, at, mark):
        return [f"{mark}_{k}" if k in at else w for k, w in enumerate(text)]

    first = [changed(base, {60 * k + draw.randrange(55) for k in range(2)}, f"x{i}") for i in range(n)]
    pairs = [changed(t, {60 * k + draw.randrange(55) for k in range(2)}, f"y{i}") for i, t in enumerate(first[: n // 2])]
    return list(enumerate(" ".join(t) for t in first + pairs))


def test_pairs_that_division_tears_apart_are_joined(spark, monkeypatch):
    """Pairs of a crowded bucket do not depend on the draws of its pivot and its parts."""
    monkeypatch.setattr(near_copies, "DIVISIONS", 0)
    monkeypatch.setattr(near_copies, "FIRST_BANDS", 0)
    rows = torn_family()
    want = brute_kept(rows)
    assert 1 < len(want) < len(rows) - 60
    assert kept_of(spark, rows) == want


def test_blocks_meet_whatever_the_size_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    monkeypatch.setattr(near_copies, "COLUMNS", 16)
    rows = edited_copies()
    texts = spark.createDataFrame([(i, t) for i, t in rows if brute_shingles(t)], "node long, text string")
    members = texts.selectExpr("1 as key", "node", "node % 40 as root").unionByName(
        texts.selectExpr("2 as key", "node", "0 as root")
    )
    found = near_copies._across(members, texts, 5, 0.8).collect()
    sets = {i: brute_shingles(t) for i, t in rows}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert found and all(near(r.a, r.b) and r.a % 40 != r.b % 40 for r in found)

    def groups(edges):
        at = {k: k for k in range(40)}
        for a, b in edges:
            x, y = at[a % 40], at[b % 40]
            at = {k: min(x, y) if v in (x, y) else v for k, v in at.items()}
        return at

    held = [i for i in sets if sets[i]]
    whole = [(a, b) for a in held for b in held if a % 40 != b % 40 and near(a, b)]
    assert groups(found_pairs := [(r.a, r.b) for r in found]) == groups(whole)
    assert len(found_pairs) < len(whole)


def test_crowded_buckets_make_no_pairs_of_all(spark):
    docs = spark.createDataFrame(
        [(i, t, "en", "a", 1) for i, t in far_family(600, changed=12)], SCHEMA
    )
    signed = near_copies._signed(docs, 5, near_copies.band_count(0.8))
    members = signed.selectExpr("node", "posexplode(bands) as (band, key)", "node as root")
    sized = near_copies._contested(members)
    sized.persist()
    pairs = near_copies._meetings(sized, signed).count()
    assert sized.count() > 600 * 5
    assert pairs < 660 * 660 / 2 * 0.75
    sized.unpersist()


def test_clashing_columns_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "a", 1), (2, text.upper(), "b", 2), (None, text, "c", 3), (3, None, "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, node string, `bands` int")
    docs = docs.withColumn("given", near_copies.F.lit("g")).withColumn("words", near_copies.F.lit(1))
    kept = near_copies.one_of_each(docs)
    assert kept.dtypes == docs.dtypes
    assert sorted(tuple(r)[:4] for r in kept.collect()) == [(1, text, "a", 1), (3, None, "d", 4)]
    assert near_copies.one_of_each(docs.limit(0)).collect() == []
