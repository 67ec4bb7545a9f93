"""Near duplicates and shared spans against brute force."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows

from webrank.llm import hashing, neardup, spans

WORDS = [f"w{i}" for i in range(400)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice([[], [rng.choice(WORDS)], [words[i], rng.choice(WORDS)]])
    return words


def shingle_set(text, size):
    words = [w for w in re.split("[ \t\r\n]+", text) if w]
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def jaccard_pairs(texts, size, least, shingle=shingle_set):
    sets = {i: shingle(t, size) for i, t in texts.items() if t is not None}
    return {
        (a, b)
        for a, b in itertools.combinations(sorted(sets), 2)
        if sets[a] | sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9
    }


def test_word_shingles_equal_python():
    texts = ["a b  c\td\r\ne", "", None, "one", "x y z é ü", "a b c"]
    h, r = hashing.distinct_per_row(*hashing.word_shingles(pa.array(texts), 3))
    assert np.bincount(r, minlength=6).tolist() == [len(shingle_set(t or "", 3)) for t in texts]
    assert len(np.unique(h)) == len(set().union(*(shingle_set(t or "", 3) for t in texts)))


def test_pairs_equal_brute_force_with_nulls_copies_and_clashing_columns(spark):
    rng = random.Random(3)
    texts, n = {}, 0
    for _ in range(60):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(8, 300))]
        for _ in range(rng.randrange(1, 4)):
            n += 1
            texts[n] = " ".join(edited(rng, base, rng.randrange(0, max(1, len(base) // 12))))
    texts |= {900: None, 901: "", 902: "too short", 903: "too short", 904: texts[1], 905: texts[1], 906: "w1 " * 20_000}
    table = [(i, t, "x", 0, 1) for i, t in texts.items()] + [(None, "a b c d", "x", 0, 1), (1, texts[1], "x", 0, 1)]
    df = spark.createDataFrame(table, "doc long, body string, fp string, id int, text int")
    plan = neardup.Plan(size=3, similarity=0.6, width=4, partitions=72)
    pairs, members = neardup.representative_pairs(df, "doc", "body", plan)
    got = {(r.id_a, r.id_b) for r in neardup.all_pairs(pairs, members).collect()}
    want = jaccard_pairs(texts, 3, 0.6)
    assert want <= got and got - want == {(902, 903)}  # equal texts without shingles are one class
    groups = {r.id: (r.class_id, r.n_links) for r in neardup.near_duplicates(df, "doc", "body", plan).collect()}
    assert set(groups) == {i for i, t in texts.items() if t is not None}
    parent = {i: i for i in groups}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in sorted(got):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: g for i, (g, _) in groups.items()} == {i: root(i) for i in groups}


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_frequent_values_lose_no_pair(spark, monkeypatch, share):
    monkeypatch.setattr(neardup, "FREQUENT_SHARE", share)
    shared = " ".join(f"menu{i}" for i in range(40))
    texts = {i: f"{shared} " + " ".join(f"u{i}x{j}" for j in range(30)) for i in range(40)}
    texts |= {100 + i: texts[i] + " one more" for i in range(5)}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    plan = neardup.Plan(size=3, similarity=0.6, width=4, partitions=72)
    pairs, members = neardup.representative_pairs(df, "id", "text", plan)
    assert {(r.id_a, r.id_b) for r in neardup.all_pairs(pairs, members).collect()} == jaccard_pairs(texts, 3, 0.6)


def outcome(cells, ends):
    rows = sum(r for g, b, r, _ in cells if (1 << b) > ends[g])
    return rows, sum(c for g, b, _, c in cells if (1 << b) <= ends[g])


def test_unequal_thresholds_beat_the_best_equal_ones_on_skewed_partitions():
    rng = random.Random(6)
    for _ in range(30):
        cells = []
        for g in range(6):
            for b in range(1, 12):
                values = rng.choice([0, 0, 1, 3, 20]) if g % 2 or b < 4 else 0
                if values:
                    n = int(1.4 * 2**b)
                    cells.append((g, b, values * n, values * n * (n - 1) // 2))
        room = 0.2 * sum(r for _, _, r, _ in cells)
        ends = neardup.thresholds(cells, 6, 0.2)
        rows_, cost = outcome(cells, ends)
        assert rows_ <= room
        # no equal threshold within the room does better, nor any one partition's move
        for end in range(1, 13):
            r, c = outcome(cells, [(1 << end) - 1] * 6)
            assert r > room or c >= cost
        if len({*ends}) > 1:
            break
    else:
        raise AssertionError("thresholds were always equal")
    best = min(c for e in itertools.product(range(1, 13), repeat=2) for r, c in [outcome([x for x in cells if x[0] in (1, 3)], {1: (1 << e[0]) - 1, 3: (1 << e[1]) - 1})] if r <= 500)
    two = [(g // 2, b, r, c) for g, b, r, c in cells if g in (1, 3)]
    share = 500 / sum(r for _, _, r, _ in two)
    assert best <= outcome(two, neardup.thresholds(two, 2, share))[1] <= 1.02 * best
    assert neardup.thresholds([], 3, 0.2) == [1, 1, 1] and outcome(cells, neardup.thresholds(cells, 6, 0.0))[0] == 0


def test_char_pairs_and_empty_table(spark):
    texts = {1: "https://a.example/x/long-path-1", 2: "https://a.example/x/long-path-2", 3: "ftp", 4: "ftp", 5: "other words"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    plan = neardup.Plan(kind="char", size=4, similarity=0.7, width=5, partitions=64)
    assert rows(neardup.all_pairs(*neardup.representative_pairs(df, "id", "text", plan))) == [(1, 2), (3, 4)]
    assert rows(neardup.all_pairs(*neardup.representative_pairs(df.where("false"), "id", "text", plan))) == []


def test_plans_miss_less_than_a_thousandth():
    for plan in (neardup.Plan(), neardup.Plan(similarity=0.6, width=4, partitions=72), neardup.Plan(similarity=0.7, width=5, partitions=64)):
        assert neardup.miss_probability(plan) < 1e-3


def brute_spans(texts, length):
    where = {}
    for i, t in texts.items():
        for s in range(len(t or "") - length + 1):
            where.setdefault(t[s : s + length], set()).add(i)
    pairs = {p for ids in where.values() for p in itertools.combinations(sorted(ids), 2)}
    covered = {}
    for i, t in texts.items():
        if t is not None:
            hit = set()
            for s in range(len(t) - length + 1):
                if len(where[t[s : s + length]]) > 1:
                    hit.update(range(s, s + length))
            covered[i] = len(hit)
    return pairs, covered


@pytest.mark.parametrize("length", [8, 40, 201])
def test_spans_equal_brute_force(spark, length):
    rng = random.Random(length)

    def noise(n):
        return "".join(rng.choice("abcdefé \n漢") for _ in range(n))

    passages = [noise(length + d) for d in (-1, 0, 1, 30)]
    texts = {i: noise(rng.randrange(0, 300)) + rng.choice(passages) + noise(rng.randrange(0, 200)) for i in range(40)}
    texts |= {50: None, 51: "", 52: "a" * 900, 53: "a" * 900, 54: texts[0], 55: passages[1], 56: noise(length) * 2}
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in texts.items()], "doc long, body string, key string, start int")
    windows, members = spans.shared_windows(df, "doc", "body", length)
    pairs, covered = brute_spans(texts, length)
    assert {(r.doc_a, r.doc_b) for r in spans.shared_pairs(spans.representative_pairs(windows, df, "doc", "body", length), members, length).collect()} == pairs
    assert {r.doc_id: r.shared_chars for r in spans.shared_share(windows, members, length).collect()} == covered


def test_windows_of_equal_hash_but_other_text_make_no_pair(spark):
    texts = spark.createDataFrame([(1, "a" * 30 + "b"), (2, "c" * 40), (3, "x" + "a" * 30)], "doc long, body string")
    windows = spark.createDataFrame([(7, 1, 0), (7, 2, 3), (7, 3, 1)], "key long, id long, start int")
    assert rows(spans.representative_pairs(windows, texts, "doc", "body", 20)) == [(1, 3)]


def test_spans_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc long, body string")
    windows, members = spans.shared_windows(df, "doc", "body", 20)
    assert rows(spans.shared_pairs(spans.representative_pairs(windows, df, "doc", "body", 20), members, 20)) == [] == rows(spans.shared_share(windows, members, 20))
    with pytest.raises(ValueError):
        spans.shared_windows(df, "doc", "body", 3)
