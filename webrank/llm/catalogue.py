"""Queries of the operators on text and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webrank.llm import mixing, mojibake, neardup, packing, pages, ranking, residuals, spans, tokens
from webrank.plans.session import load, materialize

Query = Callable[[SparkSession, str], DataFrame]

PAGE_PLAN = neardup.Plan(kind="word", size=3, similarity=0.6, width=4, partitions=72, agree=2)
URL_PLAN = neardup.Plan(kind="char", size=4, similarity=0.7, width=5, partitions=64, agree=2)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the main body of each stored page and of each HTML page; spam pages have none."""
    return pages.main_lines(load(spark, sf, "crawl"), load(spark, sf, "raw_pages"), load(spark, sf, "documents"))


def p1_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """The main body of each stored page, its lines joined."""
    read = pages.read_pages(load(spark, sf, "crawl"), load(spark, sf, "raw_pages"), load(spark, sf, "documents"), text=True)
    return read.pages.where("not spam").select("crawl_id", "main_text", F.size("main").alias("n_lines"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose body is keywords, links or tags rather than sentences."""
    read = pages.read_pages(load(spark, sf, "crawl"), load(spark, sf, "raw_pages"), load(spark, sf, "documents"))
    return read.pages.where("spam").select("crawl_id")


def p4_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Share of prose, perplexity and number of tokens of the body of each page."""
    read = pages.read_pages(load(spark, sf, "crawl"), load(spark, sf, "raw_pages"), load(spark, sf, "documents"))
    return read.pages.select("crawl_id", F.round("prose_share", 6).alias("prose_share"), F.round("perplexity", 4).alias("perplexity"), "n_tokens")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of fetches with nearly the same page and pairs of result lines with nearly the same URL."""
    crawl = load(spark, sf, "crawl").select("crawl_id", "page")
    pairs, members = neardup.representative_pairs(crawl, "crawl_id", "page", PAGE_PLAN)
    long_enough = load(spark, sf, "crawl").where(F.size(F.split(F.trim(F.regexp_replace("page", "[ \t\r\n]+", " ")), " ")) >= 3)
    members = members.join(long_enough.select(F.col("crawl_id").alias("id")), "id", "left_semi")
    page = neardup.all_pairs(pairs, members)
    results = load(spark, sf, "results").select("result_id", "url")
    url = neardup.all_pairs(*neardup.representative_pairs(results, "result_id", "url", URL_PLAN))
    return page.select(F.lit("page").alias("field"), "id_a", "id_b").unionByName(url.select(F.lit("url").alias("field"), "id_a", "id_b"))


def p2_representatives(spark: SparkSession, sf: str) -> DataFrame:
    """The form without copies: pairs of different pages and of different URLs, each named by the least id that has it."""
    pages_, _ = neardup.representative_pairs(load(spark, sf, "crawl"), "crawl_id", "page", PAGE_PLAN)
    urls, _ = neardup.representative_pairs(load(spark, sf, "results"), "result_id", "url", URL_PLAN)
    return pages_.select(F.lit("page").alias("field"), "id_a", "id_b").unionByName(urls.select(F.lit("url").alias("field"), "id_a", "id_b"))


def p2_members(spark: SparkSession, sf: str) -> DataFrame:
    """The name of each page's and URL's text, by which :func:`p2_representatives` has it."""
    pages_ = neardup.members(neardup.records(load(spark, sf, "crawl"), "crawl_id", "page"))
    urls = neardup.members(neardup.records(load(spark, sf, "results"), "result_id", "url"))
    return pages_.select(F.lit("page").alias("field"), "id", "rep").unionByName(urls.select(F.lit("url").alias("field"), "id", "rep"))


def p2_page_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Group and number of links of every fetch with a page."""
    return neardup.near_duplicates(load(spark, sf, "crawl"), "crawl_id", "page", PAGE_PLAN)


def _garbled(spark: SparkSession, sf: str, restore: bool) -> DataFrame:
    pages = load(spark, sf, "crawl").select(F.lit("page").alias("field"), F.col("crawl_id").alias("id"), F.col("page").alias("value"))
    titles = load(spark, sf, "results").select(F.lit("title").alias("field"), F.col("result_id").alias("id"), F.col("title").alias("value"))
    both = pages.unionByName(titles)
    model = mojibake.train(both, ["value"])
    return mojibake.find_garbled(both, ["field", "id"], "value", model, restore).dropDuplicates(["field", "id"])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and titles of which at least a part was decoded wrongly."""
    return _garbled(spark, sf, False).select("field", "id")


def p3_restored(spark: SparkSession, sf: str) -> DataFrame:
    """The same records with the original text wherever it can be restored."""
    return _garbled(spark, sf, True)


SCORES = {"tf": 1.0, "rank": 1.0, "inlinks": 1.0, "visits": 1.0}
SPAN = 200
MAX_CONTAINERS = 1000


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """``(word, url, tf, rank, inlinks, visits)``: the URLs that hold a wanted word, with their scores."""
    words = load(spark, sf, "queries").select("word").distinct()
    tf = load(spark, sf, "tf").select("url", "word", "tf").distinct().join(words, "word")
    ranks = load(spark, sf, "pageranks").select("url", "rank", "inlinks", "visits").distinct()
    return tf.join(ranks, "url", "left")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The five best URLs of each wanted word by Borda count over four scores."""
    points = ranking.borda(_candidates(spark, sf), "word", "url", SCORES)
    return ranking.top(points, "word", "url", 5).select("word", "url")


def p6_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """The whole ranking of each wanted word."""
    return ranking.positions(ranking.borda(_candidates(spark, sf), "word", "url", SCORES), "word", "url")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Characteristic words: residuals of at least that of the least share asked for at the word's rarity, then the exact condition.

    The share tf / T must reach 0.06 / rarity, so the count must reach T times that, and with the margins as they are the
    residual must reach the residual of that count.
    """
    scored = residuals.adjusted_residuals(load(spark, sf, "tf"), "url", "word", "tf")
    rarity = F.log(F.col("n_records") / F.col("term_records")) / F.nullif(F.log(F.col("n_records").cast("double")), F.lit(0.0))
    found = residuals.characteristic(scored, F.col("record_total") * 0.06 / F.nullif(rarity, F.lit(0.0)))
    return found.where((F.col("term_records") >= 3) & (F.col("observed") / F.col("record_total") * rarity >= 0.06)).select("url", "word")


def p7_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """The adjusted residual of every URL and word."""
    scored = residuals.adjusted_residuals(load(spark, sf, "tf"), "url", "word", "tf")
    return scored.select("url", "word", "observed", F.round("residual", 5).alias("residual"))


def _containers(spark: SparkSession, sf: str) -> list[tuple[str, int]]:
    named = load(spark, sf, "containers").where("container is not null and capacity > 0").select("container", "capacity").distinct()
    rows = named.limit(MAX_CONTAINERS + 1).collect()
    if len(rows) > MAX_CONTAINERS:
        raise ValueError(f"more than {MAX_CONTAINERS} containers")
    return sorted((r.container, r.capacity) for r in rows)


def p8_packing(spark: SparkSession, sf: str) -> DataFrame:
    """The contents of every container of each capacity."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    sizes = materialize(tokens.token_sizes(docs, ["doc_id"], "text"))
    return packing.pack_containers(sizes, "doc_id", "n_tokens", _containers(spark, sf))


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """For each container: tokens laid in, texts, texts without a gap or overlap, the fullest bin's room and texts split without need."""
    packed = materialize(p8_packing(spark, sf))
    kinds = ["container", "capacity"]
    order = Window.partitionBy(*kinds, "doc_id").orderBy("piece")
    pieces = packed.withColumn("after", F.coalesce(F.lag(F.col("start_token") + F.col("n_tokens")).over(order), F.lit(0)))
    each = pieces.groupBy(*kinds, "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.min(F.col("after") == F.col("start_token")).alias("whole"))
    texts = each.groupBy(*kinds).agg(
        F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("whole").cast("bigint")).alias("n_whole"),
        F.sum(((F.col("k") > 1) & (F.col("n") <= F.col("capacity"))).cast("bigint")).alias("n_split_without_need"),
    )
    bins = packed.groupBy(*kinds, "bin").agg(F.sum("n_tokens").alias("n")).groupBy(*kinds).agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum((F.col("n") > F.col("capacity")).cast("bigint")).alias("n_overfull"), F.sum("n").alias("filled")
    )
    fill = F.round(F.col("filled") / (F.col("n_bins") * F.col("capacity")), 4)
    return texts.join(bins, kinds).select(*kinds, "n_tokens", "n_texts", "n_whole", "n_split_without_need", "n_bins", "n_overfull", fill.alias("fill"))


def p9_checks(spark: SparkSession, sf: str) -> DataFrame:
    """For each source: whether its records are used at most as often as allowed, its budget is met to within its greatest
    record, and the greatest difference of its share from the target where it has the tokens for it."""
    choice, shares = _mix(spark, sf)
    used = choice.groupBy("source").agg(F.max("repeats").alias("most"), F.max("n_tokens").alias("greatest"), F.count(F.lit(1)).alias("n_records"))
    off = F.abs(F.col("tokens") - F.col("budget")) <= F.coalesce("greatest", F.lit(0))
    return shares.join(used, "source", "left").select(
        "source", F.coalesce("n_records", F.lit(0)).alias("n_records"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"),
        off.alias("budget_met"), F.round(F.abs(F.col("share") - F.col("target_share")), 4).alias("off_target"),
    )


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = load(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    return mixing.mix_sources(tokens.token_sizes(docs, ["doc_id", "source", "lang"], "text"), load(spark, sf, "mix_targets"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The records chosen and how often each is used."""
    return _mix(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Budget, tokens and share reached of each source."""
    return _mix(spark, sf)[1]


def _spans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    windows, members = spans.shared_windows(docs, "doc_id", "text", SPAN)
    return spans.representative_pairs(windows, docs, "doc_id", "text", SPAN), members


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents that share a passage of at least 200 characters."""
    return spans.shared_pairs(*_spans(spark, sf), SPAN)


def p10_representatives(spark: SparkSession, sf: str) -> DataFrame:
    """The form without copies: pairs of different texts, each named by the least id that has it."""
    return _spans(spark, sf)[0]


def p10_members(spark: SparkSession, sf: str) -> DataFrame:
    """The name of each document's text, by which :func:`p10_representatives` has it."""
    return spans.classes(load(spark, sf, "documents"), "doc_id", "text")[1].select("id", "rep")


def p10_shares(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each document lies in passages that also occur in another."""
    windows, members = spans.shared_windows(load(spark, sf, "documents"), "doc_id", "text", SPAN)
    return spans.shared_share(windows, members, SPAN)


_SCORED = """
    WITH c AS (SELECT DISTINCT t.word, t.url, t.tf, p.rank, p.inlinks, p.visits
               FROM (SELECT DISTINCT url, word, tf FROM tf) t JOIN (SELECT DISTINCT word FROM queries) q USING (word)
               LEFT JOIN (SELECT DISTINCT url, rank, inlinks, visits FROM pageranks) p USING (url)),
    l AS (SELECT word, url, unnest(['tf','rank','inlinks','visits']) AS k,
                 unnest([CAST(tf AS DOUBLE), rank, CAST(inlinks AS DOUBLE), CAST(visits AS DOUBLE)]) AS v FROM c),
    r AS (SELECT word, url, CASE WHEN v IS NULL THEN (count(v) OVER (PARTITION BY word, k) + 1) / 2.0
                 ELSE rank() OVER (PARTITION BY word, k ORDER BY v NULLS LAST)
                      + (count(*) OVER (PARTITION BY word, k, v) - 1) / 2.0 END AS r FROM l),
    s AS (SELECT word, url, round(sum(r), 6) AS points FROM r GROUP BY word, url),
    o AS (SELECT word, url, points, row_number() OVER (PARTITION BY word ORDER BY points DESC, url) AS position FROM s)
"""
_MARGINS = """
    WITH d AS (SELECT url, word, sum(tf) AS o FROM (SELECT DISTINCT url, word, tf FROM tf
               WHERE url IS NOT NULL AND word IS NOT NULL AND tf > 0) GROUP BY url, word),
    u AS (SELECT url, sum(o) AS rt FROM d GROUP BY url), w AS (SELECT word, sum(o) AS tt, count(*) AS tn FROM d GROUP BY word),
    g AS (SELECT CAST(sum(rt) AS DOUBLE) AS g, count(*) AS n FROM u),
    m AS (SELECT url, word, o, rt, tt, tn, n, g, rt * tt / g AS e FROM d JOIN u USING (url) JOIN w USING (word), g)
"""
SQL = {
    "p2_members": """
        SELECT 'page' AS field, crawl_id AS id, min(crawl_id) OVER (PARTITION BY md5(page)) AS rep FROM (SELECT DISTINCT crawl_id, page FROM crawl WHERE crawl_id IS NOT NULL AND page IS NOT NULL)
        UNION ALL
        SELECT 'url', result_id, min(result_id) OVER (PARTITION BY md5(url)) FROM (SELECT DISTINCT result_id, url FROM results WHERE result_id IS NOT NULL AND url IS NOT NULL)""",
    "p10_members": "SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY md5(text)) AS rep FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)",
    "p6_found": _SCORED + "SELECT word, url FROM o WHERE position <= 5",
    "p6_ranking": _SCORED + "SELECT word, url, points, position FROM o",
    "p7_found": _MARGINS + "SELECT url, word FROM m WHERE tn >= 3 AND o / rt * (ln(n / tn) / ln(n)) >= 0.06",
    "p7_residuals": _MARGINS
    + """SELECT url, word, CAST(o AS BIGINT) AS observed,
                round(CASE WHEN e * (1 - rt / g) * (1 - tt / g) > 0 THEN (o - e) / sqrt(e * (1 - rt / g) * (1 - tt / g)) END, 5) AS residual FROM m""",
}


def queries() -> dict[str, Query]:
    """All queries of the subpackage by name."""
    functions = [p1_found, p1_main_text, p2_found, p2_page_groups, p2_representatives, p2_members, p3_found, p3_restored, p4_found, p4_scores, p6_found, p6_ranking, p7_found, p7_residuals, p8_packing, p8_checks, p9_mix, p9_shares, p9_checks, p10_found, p10_representatives, p10_members, p10_shares]
    return {f.__name__: f for f in functions}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return dict(SQL)
