import os
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from webrank.functions import htmltext, text, urls
from webrank.operators import collection as c
from webrank.operators import crawl, index, pagerank, search
from webrank.operators.skew import counted_join
from webrank.operators.treeagg import hot_values, tree_aggregate
from webrank.sources import rowformat, store


def value(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


def pairs(spark, *items):
    return spark.createDataFrame(list(items), "key string, value string")


# tree aggregation ---------------------------------------------------------------------------------------------------


def test_tree_aggregate_equals_group_by_for_any_fan_in(spark):
    df = spark.range(5000, numPartitions=7).select((F.col("id") % 3 == 0).alias("k"), F.col("id").alias("v"))
    want = rows(df.groupBy("k").agg(F.sum("v"), F.count("v"), F.min("v"), F.max("v")))
    states = {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "a": ("min", F.col("v")), "b": ("max", F.col("v"))}
    for fan_in, chunk in ((2, 10), (64, 1 << 16)):
        assert rows(tree_aggregate(df, ["k"], states, fan_in, chunk)) == want


def test_tree_aggregate_nulls_empty_ties_and_clashing_names(spark):
    df = spark.createDataFrame([(None, None, 1), (None, 2.0, 1), ("a", None, 1), ("a", None, 1), ("", 1.0, 1)], "k string, v double, __tree_node int")
    out = tree_aggregate(df, ["k"], {"s": ("sum", F.col("v")), "n": ("count", F.col("v"))})
    assert rows(out) == sorted([(None, 2.0, 1), ("a", None, 0), ("", 1.0, 1)], key=repr)
    assert rows(tree_aggregate(df.where("false"), ["k"], {"n": ("count", F.lit(1))})) == []
    with pytest.raises(ValueError):
        tree_aggregate(df, ["k"], {}, fan_in=1)


def test_hot_values_counts_rows_as_stored(spark):
    df = spark.createDataFrame([("x",)] * 6 + [(None,)] * 90 + [("y",)] * 4, "v string")
    assert rows(hot_values(df, "v", 0.05), "v") == [("x",)]
    assert rows(hot_values(df, "v", 0.04), "v") == [("x",), ("y",)]


# collections --------------------------------------------------------------------------------------------------------


def test_folds(spark):
    df = c.parallelize(spark, ["b", "a"])
    assert rows(c.fold(df, "0", lambda acc, x: F.concat(acc, x))) == [("0ab",)]
    numbers = spark.createDataFrame([(1,), (5,)], "value bigint")
    assert rows(c.fold(numbers, 10, "sum")) == [(16,)]
    assert rows(c.fold(numbers.where("false"), 7, "sum")) == [(7,)]
    assert rows(c.fold(numbers.where("false"), 7, "max")) == [(7,)]
    with pytest.raises(ValueError):
        c.fold(numbers, 0, "mean")
    assert rows(c.fold_by_key(pairs(spark, ("k", "2"), ("k", "1")), ">", lambda a, x: F.concat(a, x))) == [("k", ">12")]
    skip = c.fold_by_key(pairs(spark, ("k", "2"), ("k", "1"), ("k", "3"), ("j", "3")), ">", lambda a, x: F.when(x != "3", F.concat(a, x)))
    assert rows(skip) == [("j", ">"), ("k", ">12")]


def test_cogroup_join_and_group_by(spark):
    a = pairs(spark, ("tree", "oak"), ("tree", "elm"), ("x", "1"))
    b = pairs(spark, ("tree", "7"), ("tree", "9"), ("tree", "8"), ("y", "2"))
    assert rows(c.cogroup(a, b)) == [("tree", "[elm,oak],[7,8,9]"), ("x", "[1],[]"), ("y", "[],[2]")]
    assert len(rows(c.join(a, b))) == 6 and ("tree", "elm,9") in rows(c.join(a, b))
    assert rows(c.group_by(c.parallelize(spark, ["ab", "a", "b"]), F.substring("value", 1, 1))) == [("a", "a,ab"), ("b", "b")]


def test_maps_drop_nulls_and_keep_duplicates(spark):
    df = spark.createDataFrame([("a b a",), (None,), ("",)], "value string")
    assert rows(c.flat_map(df, F.split("value", " "))) == [("",), ("a",), ("a",), ("b",)]
    assert rows(c.flat_map_py(df, lambda x: x.split() if x else None)) == [("a",), ("a",), ("b",)]
    assert rows(c.map_to_pair_py(df, lambda x: (x, "1") if x else None)) == [("a b a", "1")]
    assert rows(c.filter_py(df, lambda x: bool(x))) == [("a b a",)]
    assert rows(c.pair_flat_map_py(pairs(spark, ("k", "v")), lambda k, v: [(v, k)] * 2)) == [("v", "k"), ("v", "k")]
    assert rows(c.map_to_pair(df, F.nullif("value", F.lit("")), F.lit(1))) == [("a b a", 1)]


def test_set_operations(spark):
    a, b = c.parallelize(spark, ["x", "x", "y"]), c.parallelize(spark, ["x", "z"])
    assert rows(c.intersection(a, b)) == [("x",)]
    assert rows(c.subtract(a, b)) == [("y",)]
    assert len(rows(c.union(a, b))) == 5 and rows(c.distinct(a)) == [("x",), ("y",)]
    assert rows(c.take(a, 1, "value")) == [("x",)]
    assert rows(c.hash_sample(a, F.col("value"), 1, 1)) == rows(a)


# table store --------------------------------------------------------------------------------------------------------


def test_row_format_round_trip_with_any_bytes(spark, tmp_path):
    cells = {"c1": b"with space\nand line", "c2": b"", "c3": bytes(range(256))}
    data = rowformat.encode_row("key", cells) + rowformat.encode_row("k2", {})
    assert list(rowformat.decode_rows(data)) == [("key", cells), ("k2", {})]
    assert list(rowformat.decode_rows(data[:-2])) == [("key", cells)]
    with pytest.raises(ValueError):
        rowformat.encode_row("no good", {})
    (tmp_path / "t.table").write_bytes(rowformat.encode_row("a", {"x": b"1"}) + rowformat.encode_row("a", {"x": b"2"}))
    assert rows(rowformat.read_tables(spark, str(tmp_path)).select("table", "key", "column", F.col("value").cast("string"))) == [("t", "a", "x", "2")]


def test_puts(spark):
    puts = spark.createDataFrame([("r", "c", "old", 1), ("r", "c", "new", 2), ("s", "d", None, 1)], "k string, c string, v string, o int")
    assert rows(store.latest_cells(puts, "k", "c", "v", "o")) == [("r", "c", "new"), ("s", "d", None)]
    table = spark.createDataFrame([("r", {"a": "1", "b": "2"})], "key string, cols map<string,string>")
    cells = spark.createDataFrame([("r", "b", "9"), ("q", "z", "0")], "key string, column string, value string")
    assert {r.key: r.cols for r in store.put_cells(table, cells).collect()} == {"r": {"a": "1", "b": "9"}, "q": {"z": "0"}}
    t = spark.createDataFrame([(1, "P"), (2, None), (3, "F")], "k int, s string")
    assert rows(store.put_if(t, "s", F.lit("P"), F.lit("F")).select("k", "s", "ok")) == [(1, "F", True), (2, None, False), (3, "F", False)]
    assert rows(store.put_rows(t, spark.createDataFrame([(2, "N"), (9, "N")], "k int, s string"), "k")) == [(1, "P"), (2, "N"), (3, "F"), (9, "N")]


def test_paged_view(spark):
    t = spark.range(25).withColumnRenamed("id", "k")
    page = store.view_page(t, "k", 3, 10).collect()
    assert [r.k for r in page] == list(range(3, 13)) and {r.next_key for r in page} == {13} and [r.row_id for r in page] == list(range(10))
    assert {r.next_key for r in store.view_page(t, "k", 20, 10).collect()} == {None}
    assert store.view_page(t, "k", 99).count() == 0


def test_catalog_verbs(spark):
    store.persist(spark.range(3), "webrank_t1")
    with pytest.raises(Exception):
        store.persist(spark.range(3), "webrank_t1")
    store.rename(spark, "webrank_t1", "webrank_t2")
    assert spark.table("webrank_t2").count() == 3 and not spark.catalog.tableExists("webrank_t1")
    assert store.main(["count", "webrank_t2"]) == 0 and store.main(["nonsense"]) == 2
    assert store.main(["put", "webrank_t2", "id", "9", "id", "9"]) == 0 and store.main(["list"]) == 0
    assert rows(spark.table("webrank_t2")) == [(0,), (1,), (2,), (9,)]
    assert ("webrank_t2", 4, True) in rows(store.catalog_tables(spark))
    store.delete(spark, "webrank_t2")
    assert not spark.catalog.tableExists("webrank_t2")


def test_materialized_files_go_when_released(spark):
    from webrank.plans.session import materialize, release

    df = materialize(spark.range(3).toDF("x"))
    assert df.count() == 3
    release(df)
    assert not os.path.exists(df.webrank_path.removeprefix("file:"))
    release(df)


def test_counted_join_with_hot_and_cold_keys(spark):
    big = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2), ("z", 3)], "k string, v int")
    small = spark.createDataFrame([("a", 50, "x"), ("b", 1, "y"), ("c", 1, None)], "k string, n long, w string")
    want = rows(big.join(small, "k", "left").select("k", "v", "n", "w"))
    for hot in (1, 2, 10_000):
        assert rows(counted_join(big, small, ["k"], "n", hot).select("k", "v", "n", "w")) == want
    assert counted_join(big.where("false"), small.where("false"), ["k"], "n").count() == 0


# text, URLs, HTML ---------------------------------------------------------------------------------------------------


def test_tokens(spark):
    assert value(spark, text.tokens(F.lit("<b>The</b> cat's\r\ncafé, (x2) -- A_B"))) == ["the", "cat", "s", "x2"]
    assert value(spark, text.tokens(F.lit(""))) == []
    assert value(spark, text.query_words(F.lit("  Old, old  castle! "))) == ["old", "castle"]
    assert value(spark, text.replace_last_word(F.lit("old ca"), F.lit("castle"))) == "old castle"
    parts = value(spark, text.posting_parts(F.lit("http://h:80/x:3 14")))
    assert parts["url"] == "http://h:80/x" and parts["positions"] == [3, 14]


@pytest.mark.parametrize(
    "link,want",
    [
        ("#top", None),
        ("mailto:x@y", None),
        ("/a/../b#f", "https://h.example:443/b"),
        ("../../../x", "https://h.example:443/x"),
        ("page", "https://h.example:443/dir/page"),
        ("http://Other.example", "http://other.example:80/"),
        ("https://o.example/p", "https://o.example:443/p"),
        ("https://o.example:8443/p", "https://o.example:8443/p"),
        ("/pic.JPG", None),
        ("/pic.jpg?x=1", None),
        ("/null", None),
        ("//c.example/z", "https://c.example:443/z"),
        ("javascript:void(0)", None),
    ],
)
def test_strict_normalise(spark, link, want):
    assert value(spark, urls.normalise(F.lit(link), F.lit("https://h.example:443/dir/base.html"), strict=True)) == want


@pytest.mark.parametrize(
    ("link", "want"),
    [
        ("#top", None),
        ("mailto:x@y", "https://h.example:443/dir/mailto:x@y"),
        ("/a/../b#f", "https://h.example:443/a/../b"),
        ("../../../x/", "https://h.example:443/x"),
        ("page", "https://h.example:443/dir/page"),
        ("./p#a#b", "https://h.example:443/dir/./p#a"),
        ("http://Other.example", "http://Other.example:80/"),
        ("HTTPS://o.example:8443/p", "HTTPS://o.example:8443/p"),
        ("ftp://o.example/p", None),
        ("/pic.JPG", None),
        ("/pic.jpg?x=1", "https://h.example:443/pic.jpg?x=1"),
        ("/null", None),
        ("//c.example/z", "https://h.example:443//c.example/z"),
        ("", "https://h.example:443/dir"),
    ],
)
def test_normalise(spark, link, want):
    assert value(spark, urls.normalise(F.lit(link), F.lit("https://h.example:443/dir/base.html"))) == want


def test_other_url_functions(spark):
    base = F.lit("http://h:80/d/p")
    assert value(spark, urls.normalise(F.lit("#x"), base, fragment_is_self=True)) == "http://h:80/d/p"
    assert value(spark, urls.seed(F.lit("Example.com#f"))) == "http://example.com:80/"
    assert value(spark, urls.seed(F.lit("https://e.com/a"))) == "https://e.com:443/a"
    assert value(spark, urls.redirect(F.lit("/new"), base)) == "http://h:80/new"
    p = value(spark, urls.parts(F.lit("no-slashes")))
    assert tuple(p) == (None, None, None, "no-slashes")
    assert len(value(spark, urls.row_key(F.lit("u")))) == 40


def test_html_functions(spark):
    html = '<html><style>x\ny</style><NAV>n</NAV><nav id=1>menu</nav><p>First <b>one</b><p class="z">the museum of art</p><a class="k" href="/u">go</a></html>'
    assert "menu" not in value(spark, htmltext.remove_elements(F.lit(html))) and "<NAV>" in value(spark, htmltext.remove_elements(F.lit(html)))
    assert value(spark, htmltext.hrefs(F.lit(html))) == ["/u"]
    assert value(spark, htmltext.strip_tags(F.lit("<b>x</b> <a href=1>y</a> <article>"))) == "x <a href=1>y <article>"
    assert value(spark, htmltext.collapse(F.lit(" a\r\nb  \n c "))) == "a b c"
    assert value(spark, htmltext.collapse(F.lit("\na\nb\x0b\x0bc\t"))) == "a\nb c"
    words = F.array(F.lit("museum"), F.lit("art"), F.lit("first"))
    assert value(spark, htmltext.description(F.lit(html), words)) == "the museum of art"
    assert value(spark, htmltext.description(F.lit("nothing"), words)) == ""
    assert value(spark, htmltext.description(F.lit('<meta name="description" content="said">'), words)) == "said"
    assert value(spark, htmltext.title(F.lit("<title> Café </title>"), F.lit("http://h:80/p"))) == "Caf"
    assert value(spark, htmltext.title(F.lit("none"), F.lit("http://h:80/p"))) == "h/p"
    kept = htmltext.plausible_links(F.array(F.lit("http://h.example:80/x"), F.lit("http://a"), F.lit("http://h/http://g.example")))
    assert value(spark, kept) == ["http://h.example:80/x"]
    assert value(spark, htmltext.line_links(F.lit("<a href='/a'>\n<a href=\"/a\"> href='/b'\n href='../c'"))) == ["/a"]
    assert value(spark, htmltext.drop_dotted_anchors(F.lit("<a..>x"))) == "x"


# index, ranks, search, crawl ----------------------------------------------------------------------------------------


def test_index(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "id int, text string")
    posts = index.postings(index.tokenize(docs, "id", "text"), "id")
    assert rows(posts.select("word", "id", "tf", "positions")) == [("a", 1, 2, [0, 2]), ("b", 1, 1, [1]), ("b", 2, 1, [0])]
    assert rows(index.posting_lists(posts, "id")) == [("a", "1:0 2"), ("b", "1:1,2:0")]
    assert [r.df for r in index.idf(posts, 3).orderBy("word").collect()] == [1, 2]


def test_pagerank_closed_forms(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "out"), ("b", "a"), (None, "a")], "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("alone",)], "url string")
    ranks = {r.url: r["rank"] for r in pagerank.pagerank(edges, nodes, rounds=1).collect()}
    assert ranks == {"a": pytest.approx(0.15 + 0.85), "b": pytest.approx(0.15 + 0.85 / 2)}
    settled = {r.url: r["rank"] for r in pagerank.pagerank(edges, nodes, tolerance=1e-9).collect()}
    a = (0.15 + 0.85 * 0.15) / (1 - 0.85 * 0.425)
    assert settled["a"] == pytest.approx(a, abs=1e-6) and min(settled.values()) >= 0.15
    signed = pagerank.pagerank(edges, nodes, metric="signed").count()
    assert signed == 2
    assert pagerank.pagerank(edges.where("false"), rounds=2).count() == 0
    with pytest.raises(ValueError):
        pagerank.pagerank(edges, metric="other")


def test_search_pages_do_not_overlap(spark):
    counts = spark.createDataFrame([(f"u{i:02}", "w", 1 + i % 3) for i in range(25)] + [("u00", "v", 5)], "url string, word string, tf int")
    scored = search.scores(counts, index.idf(counts, 50), None, ["w", "v", "absent"])
    pages = [search.page(scored, n).collect() for n in (1, 2, 3)]
    assert [len(p) for p in pages] == [10, 10, 5] and len({r.url for p in pages for r in p}) == 25
    assert pages[0][0].url == "u00" and [r.position for r in pages[1]] == list(range(11, 21))
    assert search.url_list(search.page(scored, 9)).count() == 0
    found = search.suggest(index.idf(counts, 50), "old w", 50)
    assert [r.suggestion for r in found.collect()] == ["old w"]


def test_robots(spark):
    robots = "User-agent: *\r\nDisallow: /a\nAllow: /b # c\nCrawl-delay: 2\n\nUser-agent: WebRank\nAllow: /a/ok\nDisallow: /a\nDisallow:\nCrawl-delay: x"
    hosts = spark.createDataFrame([("h", robots), ("n", None)], "host string, robots string")
    rules = crawl.robots_rules(hosts)
    pages = spark.createDataFrame([("h", "/a/ok/1"), ("h", "/a/2"), ("h", "/z"), ("n", "/a")], "host string, path string")
    assert {(r.host, r.path): r.allowed for r in crawl.robots_allowed(pages, rules, "webrank").collect()} == {("h", "/a/ok/1"): True, ("h", "/a/2"): False, ("h", "/z"): True, ("n", "/a"): True}
    assert {(r.host, r.path): r.allowed for r in crawl.robots_allowed(pages, rules, "webrank", strict=False).collect()}[("h", "/z")] is False
    assert {r.path: r.allowed for r in crawl.robots_allowed(pages.where("host = 'h'"), rules, "other").collect()} == {"/a/ok/1": False, "/a/2": False, "/z": True}
    assert rows(crawl.crawl_delay(rules)) == [("h", 2.0)]


def test_frontier_cap_and_back_pressure(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 6)] + [(i, i + 10) for i in range(1, 6)] + [(11, 0)], "src bigint, dst bigint")
    seeds = spark.createDataFrame([(0,), (0,), (None,)], "url bigint")
    assert {r.url: r.depth for r in crawl.frontier(seeds, edges, 5).collect()} == {0: 0, **{i: 1 for i in range(1, 6)}, **{i + 10: 2 for i in range(1, 6)}}
    assert crawl.frontier(seeds, edges, 5, cap=3).count() == 6
    assert crawl.frontier(seeds, edges, 5, back_pressure=4).count() == 6


def test_whole_index_takes_documents_of_every_language(spark, tmp_path):
    from webrank.plans import catalogue

    docs = [(1, "The <b>old</b> Museum, the OLD", "en"), (2, "Été à l'Île\nété", "fr"), (3, "Музей. музей!", None), (4, "Tea (hot)", "EN"), (5, "tea-pot", "en-GB"), (6, None, "fr"), (7, "", "de")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for i, text, _ in docs:
        for line in (text or "").split("\n"):
            line = re.sub("<.*?>", " ", line).lower()
            want |= {(i, w) for w in re.sub("[.,:;!?'\"()-]+", " ", line).split()}
    got = rows(catalogue.queries()["idx2_simple_index"](spark, str(tmp_path)))
    assert got == sorted(want, key=repr) and {i for i, _ in got} == {1, 2, 3, 4, 5}
