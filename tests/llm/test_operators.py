"""Each corpus operator against brute force, on awkward rows, and on empty tables."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import corpus_pipeline
from remitlens.llm import (
    decontaminate,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    repeats,
    simhash,
    token_count,
    token_output,
    toxicity,
)
from remitlens.llm.queries import QUERIES
from remitlens.llm.tokens import WordTokenizer

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
LINE = " ".join(f"word{i}" for i in range(60))
AWKWARD = [
    (1, LINE, "en", "a", 10, "x"),
    (2, LINE, "en", "a", 10, "x"),
    (2, LINE, "en", "a", 10, "x"),
    (3, None, None, None, None, None),
    (4, "", "en", None, 0, "x"),
    (None, "no id " + LINE, None, "a", 5, None),
    (5, " \n\t", "de", "b", 3, "x"),
    (6, "a" * 9000, "de", "b", 9000, "x"),
    (7, "é 'll 's don't\n\n x  <|endoftext|>1234 ½ 中文 " * 40, "fr", "b", 1, "x"),
    (8, "Mr. John Smith a@b.co +1 (269) 555-5822 " + LINE.upper(), "en", "a", 1, "x"),
    (9, "ab " * 4000, "en", "a", 1, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 2), int(i % 3 == 0)) for i in range(10)] + [(1, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(10, LINE[20:200]), (9, "Müller 12!"), (8, None), (7, "..."), (None, LINE)]
    return spark.createDataFrame(items, "item_id long, text string")


def texts():
    return [(r[0], r[1] or "") for r in AWKWARD]


def key(row):
    return tuple((v is None, v) for v in row)


def test_token_counts(docs):
    library = Tokenizer.from_file(BYTE)
    want = [(i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts()]
    got = token_count.count_tokens(docs, BYTE).collect()
    assert sorted((tuple(r)[:3] for r in got), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)


def test_word_tokenizer_with_a_small_memo():
    library = Tokenizer.from_file(WORD)
    words = WordTokenizer(WORD, memo_words=20)
    for _, t in texts() * 2:
        want = library.encode(t, add_special_tokens=False).ids + [0]
        assert words.encode([t.encode()], 0)[0].tolist() == want


def test_packing(docs):
    library = Tokenizer.from_file(WORD)
    got = packing.best_fit_pack(docs, WORD, capacity=64, shard_pieces=100).collect()
    want = []
    for i, t in texts():
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for n, a in enumerate(range(0, len(ids), 64)):
            part = ids[a : a + 64]
            want.append((i, n, a, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 64


def test_local_search_empties_bins():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(200, 900, 60)
        first = packing.best_fit_decreasing(lengths, 2048)
        better = packing.local_search([list(b) for b in first], lengths, 2048)
        assert sorted(i for b in better for i in b) == list(range(60))
        assert all(lengths[b].sum() <= 2048 for b in better) and len(better) <= len(first)
    spread = np.array([1000, 1000, 40, 8, 1000, 1000, 48])
    assert len(packing.local_search([[0, 2, 3], [1, 4], [5, 6]], spread, 2048)) == 2


def test_token_matrices(docs):
    library = Tokenizer.from_file(WORD)
    rows = token_output.packed_matrices(docs, WORD, capacity=128, shard_docs=4).collect()
    found = []
    for r in rows:
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 128 and r.cu_seqlens[-1] == r.n_tokens
        for k, (d, start) in enumerate(zip(r.doc_ids, r.starts)):
            a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert places[a:b].tolist() == list(range(b - a))
            found.append((d, start, tuple(ids[a:b].tolist())))
    want = []
    for i, t in texts():
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        want += [(i, a, tuple(ids[a : a + 128])) for a in range(0, len(ids), 128)]
    assert sorted(found, key=key) == sorted(want, key=key)


def test_capacity_tree():
    tree = token_output.CapacityTree(100)
    for room in (3, 50, 100):
        tree.add(room, 1)
    assert [tree.least(n) for n in (1, 3, 4, 50, 51, 100)] == [3, 3, 50, 50, 100, 100]
    tree.add(100, -1)
    assert tree.least(51) == -1


def brute_repeats(rows, length):
    seen, out = set(), []
    for i, text in rows:
        raw = text.encode()
        covered = np.zeros(len(raw), bool)
        for at in range(len(raw) - length + 1):
            part = raw[at : at + length]
            if part in seen:
                covered[at : at + length] = True
            seen.add(part)
        kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
        spans = int((covered & ~np.append(False, covered[:-1])).sum()) if len(raw) else 0
        out.append((i, len(raw), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [0, 20_000])
def test_repeats(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = [tuple(r)[:5] for r in repeats.remove_repeats(docs).collect()]
    in_order = sorted(texts(), key=lambda r: (r[0] is None, r[0] or 0))
    assert sorted(got, key=key) == sorted(brute_repeats(in_order, 100), key=key)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    n = max(len(words) - 2, 1)
    h = [xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def brute_components(prints):
    ids = [i for i, _ in prints]
    root = list(range(len(prints)))
    for _ in prints:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    known = {r: [i for i, q in zip(ids, root) if q == r and i is not None] for r in root}
    return [min(known[r], default=None) for r in root]


def test_simhash(docs):
    prints = [(i, brute_fingerprint(t)) for i, t in texts()]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints))]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("crowded", [2, 64])
def test_links_of_near_prints(spark, crowded):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 20, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (20, 15, 3)).astype(np.uint64)
    prints = np.unique(np.concatenate([base, (base[:, None, None] ^ flips).min(axis=2).ravel()]))
    frame = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fp long")
    edges = {tuple(r) for r in simhash.links(frame, crowded).collect()}
    from remitlens.llm.graph import components

    found = spark.createDataFrame(list(edges) or [(0, 0)], "a long, b long")
    roots = {r.node: r.root for r in components(found).collect()}
    group = {int(p): roots.get(int(p), int(p)) for p in prints.view(np.int64)}
    pairs = list(enumerate(prints))
    want = brute_components([(int(p.view(np.int64)), int(p)) for _, p in pairs])
    assert len(set(group.values())) == len(set(want))


def test_decontamination(docs, benchmark):
    found = decontaminate.digest(decontaminate.find_contamination(docs, benchmark))
    by = {(r.doc_id, r.n_words): r for r in found.collect()}
    item, line = LINE[20:200].split(), LINE.split()
    places = [i for i in range(51) if any(line[i : i + 10] == item[k : k + 10] for k in range(len(item) - 9))]
    assert by[1, 60].n_hit == len({i + k for i in places for k in range(10)}) > 0
    assert by[1, 60].items_sha256 == hashlib.sha256(b"10").hexdigest()
    assert by[3, 0].n_hit == 0 and by[3, 0].items_sha256 == hashlib.sha256(b"").hexdigest()
    blocks = decontaminate.find_contamination(docs, benchmark, block_words=3)
    assert sorted(map(tuple, decontaminate.digest(blocks).collect()), key=key) == sorted(
        map(tuple, found.collect()), key=key
    )


def test_spans_lead_back_to_the_text(spark, benchmark):
    row = spark.createDataFrame([(1, "Ünter, MÜLLER: Müller-12, end")], "doc_id long, text string")
    found = decontaminate.find_contamination(row, benchmark).first()
    assert [row.first().text[s.start : s.stop] for s in found.contamination.spans] == ["Müller-12"]


def test_rules_on_awkward_rows(docs):
    got = quality_rules.apply_rules(docs).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r for r in got}
    assert by[3].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[9].n_repeat_words == 4000 and by[9].base_failed
    assert by[1].kept and not by[1].base_failed


def test_repeated_words():
    assert quality_rules.repeated_words(b"a b c d a b c".split()) == 6
    assert quality_rules.repeated_words(b"a a a a".split()) == 4
    assert quality_rules.repeated_words(b"a b c".split()) == 0


def brute_segments(scores):
    """The heaviest segment first, then the same to its left and right."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    right = [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]
    return [*brute_segments(scores[:a]), (a, b, best[0]), *right]


def test_maximal_segments():
    rng = np.random.default_rng(1)
    for _ in range(100):
        scores = [int(x) for x in rng.integers(-97, 60, 14)]
        got = [(a, b, round(s)) for a, b, s in toxicity.maximal_segments([float(x) for x in scores])]
        assert sorted(got) == sorted(brute_segments(scores))


def test_scores_on_awkward_rows(docs, labels):
    for got in (
        toxicity.score_toxicity(docs, labels),
        quality_classifier.score_quality(docs, quality_classifier.fit_quality(docs, labels)).withColumnRenamed("score", "other").withColumnRenamed("quality_score", "score"),
    ):
        rows = got.collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)


def auc(score, label):
    rank = score.rank().to_numpy()
    ones = int(label.sum())
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


@pytest.mark.parametrize("name, label, least", [("op1_toxicity", "toxic", 0.85), ("op8_quality_classifier", "quality", 0.97)])
def test_held_out_ranking(spark, name, label, least):
    folder = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{folder}/labels.parquet")
    got = QUERIES[name](spark, folder).join(known, "doc_id").where("held_out").toPandas()
    assert auc(got["score"], got[label].to_numpy()) > least


def test_factorised_pairs_equal_the_double_sum():
    rng = np.random.default_rng(2)
    size = (1 << quality_classifier.WORD_BITS) + len(quality_classifier.STATS)
    machine = quality_classifier.Machine(0.1, rng.normal(0, 1, size), rng.normal(0, 0.3, (size, 3)), 0.0, 1.0)
    raw = b"some words and some words"
    f = quality_classifier.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    slots = [*f.slot, *range(1 << quality_classifier.WORD_BITS, size)]
    x = np.array([*f.value, *f.stats[0]])
    total = 0.1 + sum(machine.weight[s] * v for s, v in zip(slots, x))
    for i in range(len(slots)):
        for j in range(i):
            total += machine.factor[slots[i]] @ machine.factor[slots[j]] * x[i] * x[j]
    assert machine.score(f)[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_surrogates(spark, docs):
    rows = [
        (1, "Mr. John Smith met Mrs. Anna Lee, mr nobody. Call +1 (269) 555-5822 or +12695555822."),
        (2, "Mr. John Smith: 4111 1111 1111 1111, 4111111111111112 a@b.co A@B.CO Госпожа Мария Иванова"),
        (3, None), (4, ""), (4, ""), (None, "10.0.0.1 10.0.0.1"),
    ]
    got = {r.doc_id: r for r in pii.replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one, two = got[1].text, got[2].text
    assert got[3].text is None and got[4].n_replaced == 0
    man = re.search(r"Mr\. (\w+ \w+)", one)[1]
    assert man != "John Smith" and f"Mr. {man}:" in two  # one person, one surrogate
    assert man.split()[0] in pii.GIVEN["man", "latin"]
    assert re.search(r"Mrs\. (\w+)", one)[1] in pii.GIVEN["woman", "latin"] and "mr nobody" in one
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one)[0]
    assert "+" + re.sub(r"\D", "", phone) + "." in one and "555-5822" not in one
    cards = re.search(r"((?:\d{4} ){3}\d{4}), (\d{16})", two)
    luhn = lambda s: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(s))) % 10
    assert luhn(cards[1].replace(" ", "")) == 0 and luhn(cards[2]) != 0
    assert re.search(r"Госпожа [А-Яа-я]+ [А-Яа-я]+", two)
    mails = re.findall(r"\S+@\S+", two)
    assert mails[0].upper() == mails[1]
    first, second = got[None].text.split()
    assert first == second != "10.0.0.1"
    assert pii.replace_personal_data(docs).count() == len(AWKWARD)


def test_surrogates_stay_distinct(spark):
    rows = [("ip", f"{a}.{b}.1.2") for a in range(1, 10) for b in range(1, 10)]
    drawn = pii.distinct_surrogates(spark.createDataFrame(rows, "type string, name string")).collect()
    assert len({r.drawn for r in drawn}) == len(rows)
    assert not {r.drawn for r in drawn} & {n for _, n in rows}


def test_empty_tables(spark, empty, labels, benchmark):
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert quality_rules.apply_rules(empty).count() == 0
    assert token_output.packed_matrices(empty, WORD).count() == 0
    assert packing.best_fit_pack(empty, WORD).count() == 0
    assert repeats.remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert token_count.count_tokens(empty, BYTE).count() == 0
    assert quality_classifier.good_documents(empty, labels).count() == 0
    assert decontaminate.decontaminated(empty, benchmark).count() == 0
    assert pii.replace_personal_data(empty).count() == 0


def test_no_labels_and_no_items(docs, labels, benchmark):
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert decontaminate.decontaminated(docs, benchmark.limit(0)).count() == len(AWKWARD)


def test_pipeline_keeps_the_columns(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, folder)
        assert out.columns == docs.columns
    last = corpus_pipeline.run(spark, folder)
    assert 0 < last.select("doc_id").distinct().count() <= docs.count()
    assert last.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()
