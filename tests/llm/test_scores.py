"""Ranking, residuals, packing and mixing."""

import math
import os
import random

import pytest
from conftest import SF, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webrank.llm import mixing, packing, ranking, residuals


def brute_borda(items, weights):
    points = {}
    for k, weight in enumerate(weights):
        known = sorted(v[k] for v in items.values() if v[k] is not None and not math.isnan(v[k]))
        for i, v in items.items():
            x = v[k]
            if x is None or math.isnan(x):
                rank = (len(known) + 1) / 2 if known else 0.0
            else:
                rank = sum(y < x for y in known) + (known.count(x) + 1) / 2
            points[i] = points.get(i, 0) + weight * rank
    return {i: round(p, 6) for i, p in points.items()}


def test_borda_ties_missing_scores_repeats_and_clashing_names(spark):
    rng = random.Random(1)
    items = {f"i{k:02}": (rng.choice([1.0, 2.0, 3.0, None]), rng.choice([float("nan"), 10.0, rng.random()])) for k in range(40)}
    table = [("g", i, *v, "x", 1) for i, v in items.items()] * 2 + [(None, "i", 1.0, 1.0, "x", 1), ("g", None, 1.0, 1.0, "x", 1), ("h", "only", None, None, "x", 1)]
    df = spark.createDataFrame(table, "word string, url string, a double, b double, g string, k int")
    points = ranking.borda(df, "word", "url", {"a": 1.0, "b": 0.5})
    got = {(r.word, r.url): r.points for r in points.collect()}
    assert got == {("g", i): p for i, p in brute_borda(items, (1.0, 0.5)).items()} | {("h", "only"): 0.0}
    placed = ranking.positions(points, "word", "url").where("word = 'g'").orderBy("position").collect()
    want = sorted(items, key=lambda i: (-got["g", i], i))
    assert [r.url for r in placed] == want and [r.position for r in placed] == list(range(1, 41))
    assert {r.url for r in ranking.top(points, "word", "url", 5).collect() if r.word == "g"} == set(want[:5])
    assert ranking.borda(df.where("false"), "word", "url", {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        ranking.borda(df, "word", "url", {})


def test_residuals_against_plain_arithmetic(spark):
    cells = {("u1", "a"): 3, ("u1", "b"): 1, ("u2", "a"): 2, ("u3", "c"): 4}
    table = [(u, w, n, 7) for (u, w), n in cells.items()] * 2 + [("u1", None, 1, 7), (None, "a", 1, 7), ("u1", "z", 0, 7), ("u1", "y", None, 7)]
    df = spark.createDataFrame(table, "url string, word string, tf int, expected int")
    out = residuals.adjusted_residuals(df, "url", "word", "tf")
    total = sum(cells.values())
    for r in out.collect():
        rt = sum(n for (u, _), n in cells.items() if u == r.url)
        tt = sum(n for (_, w), n in cells.items() if w == r.word)
        e = rt * tt / total
        assert r.expected == pytest.approx(e) and r.n_records == 3
        assert r.residual == pytest.approx((r.observed - e) / math.sqrt(e * (1 - rt / total) * (1 - tt / total)))
    assert out.count() == 4
    assert residuals.adjusted_residuals(df.where("false"), "url", "word", "tf").count() == 0
    assert residuals.adjusted_residuals(df.where("word = 'c'"), "url", "word", "tf").first().residual is None


def test_characteristic_rows_are_those_of_enough_residual(spark):
    rng = random.Random(4)
    table = [(f"u{rng.randrange(40)}", f"w{int(rng.paretovariate(0.8))}", rng.randrange(1, 9)) for _ in range(900)]
    df = spark.createDataFrame(table, "url string, word string, tf int")
    scored = residuals.adjusted_residuals(df, "url", "word", "tf")
    for share in (0.02, 0.06, 0.3):
        got = residuals.characteristic(scored, F.col("record_total") * share)
        want = scored.where(F.col("observed") / F.col("record_total") >= share)
        assert rows(got, "url", "word") == rows(want, "url", "word") != []
    from webrank.llm import catalogue

    if os.path.isdir(SF):
        assert "SQRT" in catalogue.p7_found(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(0, 60))
def test_fill_reaches_the_best_sum(sizes, room):
    counts = {s: sizes.count(s) for s in sizes}
    used = packing.fill(counts, sorted(counts), room)
    sums = {0}
    for s in sizes:
        sums |= {x + s for x in sums if x + s <= room}
    assert sum(k * n for k, n in used.items()) == max(sums) and all(n <= counts[k] for k, n in used.items())


def test_packing_keeps_every_token_once(spark):
    rng = random.Random(5)
    sizes = {i: rng.choice([0, 1, 7, 64, 100, rng.randrange(1, 500)]) for i in range(300)}
    table = [(i, n, "x", 1) for i, n in sizes.items()] + [(3, sizes[3], "x", 1), (None, 5, "x", 1), (999, None, "x", 1)]
    df = spark.createDataFrame(table, "doc long, n long, container string, id int")
    out = packing.pack_containers(df, "doc", "n", {"s": 64, "l": 256}, block_items=100).collect()
    for name, capacity in (("s", 64), ("l", 256)):
        mine = [r for r in out if r.container == name]
        pieces = {}
        for r in mine:
            pieces.setdefault(r.doc, []).append((r.start_token, r.n_tokens))
        assert set(pieces) == set(sizes)
        for i, parts in pieces.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at
                at += n
            assert at == sizes[i] and (len(parts) == 1 or sizes[i] > capacity)
        bins = {}
        for r in mine:
            bins[r.bin] = bins.get(r.bin, 0) + r.n_tokens
        assert max(bins.values()) <= capacity
        assert len(bins) <= 1.1 * sum(sizes.values()) / capacity + 4  # many items above half of the capacity leave room
    assert packing.pack_containers(df.where("false"), "doc", "n", {"s": 64}).count() == 0
    with pytest.raises(ValueError):
        packing.pack_containers(df, "doc", "n", {"s": 0})


def test_budgets_pass_shortages_to_siblings_before_others():
    leaves = [(("web", "en"), 0.25, 10.0), (("web", "en"), 0.25, 1000.0), (("web", "de"), 0.25, 1000.0), (("books", "en"), 0.25, 1000.0)]
    got = mixing.budgets(leaves, 100.0)
    assert got == pytest.approx([10, 40, 25, 25])
    leaves[1] = (("web", "en"), 0.25, 20.0)
    assert mixing.budgets(leaves, 100.0) == pytest.approx([10, 20, 45, 25])
    leaves[2] = (("web", "de"), 0.25, 5.0)
    assert mixing.budgets(leaves, 100.0) == pytest.approx([10, 20, 5, 65])
    assert sum(mixing.budgets(leaves, 1e6)) == pytest.approx(1035)
    assert mixing.water_fill(10, [0, 0], [5, 5]) == [0, 0]


def test_mix_respects_caps_and_reports_shares(spark):
    table = [(i, "a.x" if i % 3 else "b.x", "en", 10 + i % 7, "z") for i in range(300)] + [(1, "a.x", "en", 11, "z"), (None, "a.x", "en", 5, "z"), (400, None, "en", 5, "z"), (401, "other", "en", 5, "z"), (402, "a.x", None, None, "z")]
    docs = spark.createDataFrame(table, "doc_id long, source string, lang string, n_tokens long, bucket string")
    targets = spark.createDataFrame([("a.x", 0.3, 1), ("b.x", 0.6, 2), ("c.x", 0.1, 5), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    choice, shares = mixing.mix_sources(docs, targets, total=3000.0)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"a.x", "b.x", "c.x"} and got["c.x"].tokens == 0
    assert got["b.x"].tokens == pytest.approx(got["b.x"].budget, abs=16) and got["a.x"].tokens == pytest.approx(got["a.x"].budget, abs=16)
    assert got["a.x"].share + got["b.x"].share == pytest.approx(1, abs=1e-5)
    used = choice.groupBy("source").agg(F.max("repeats").alias("m"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("t"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"))
    for r in used.collect():
        assert r.m <= {"a.x": 1, "b.x": 2}[r.source] and r.t == got[r.source].tokens and r.n == r.d
    again, _ = mixing.mix_sources(docs, targets, total=3000.0)
    assert rows(again) == rows(choice)
    nothing, none = mixing.mix_sources(docs.where("false"), targets)
    assert nothing.count() == 0 and none.count() == 3


def test_containers_of_one_name_and_too_many(spark, tmp_path):
    from webrank.llm import catalogue

    def write(n):
        spark.createDataFrame([("a", 64), ("a", 256), *((f"c{i}", 8) for i in range(n - 2))], "container string, capacity long").write.mode("overwrite").parquet(str(tmp_path / "containers.parquet"))
        return str(tmp_path)

    assert catalogue._containers(spark, write(3)) == [("a", 64), ("a", 256), ("c0", 8)]
    sizes = spark.createDataFrame([(i, 30) for i in range(20)], "doc long, n long")
    out = packing.pack_containers(sizes, "doc", "n", [("a", 64), ("a", 256)]).collect()
    assert {(r.container, r.capacity) for r in out} == {("a", 64), ("a", 256)} and len(out) == 40
    assert len(catalogue._containers(spark, write(1000))) == 1000
    with pytest.raises(ValueError):
        catalogue._containers(spark, write(1001))
