"""Queries of text, HTML, URLs, the index, ranks, search and crawling, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrank.functions import htmltext as h
from webrank.functions import text as txt
from webrank.functions import urls
from webrank.operators import crawl, index, pagerank, search
from webrank.plans.collections_catalogue import TOKENS_SQL
from webrank.plans.registry import Registry
from webrank.plans.session import load, materialize

R = Registry()
WORDS = ["the", "and", "of", "museum"]
WORD_LIST = ", ".join(f"'{w}'" for w in WORDS)


@R.add(f"SELECT doc_id, word, CAST(count(*) AS INTEGER) AS tf FROM ({TOKENS_SQL}) GROUP BY doc_id, word")
def txt6_tokens(spark, sf):
    return index.term_counts(load(spark, sf, "documents"), "doc_id", "text")


@R.add(r"SELECT result_id, regexp_replace(title, '[^\x00-\x7F]', '', 'g') AS title FROM results")
def txt9_ascii(spark, sf):
    return load(spark, sf, "results").select("result_id", txt.ascii_only(F.col("title")).alias("title"))


@R.add(r"""
    SELECT result_id, array_to_string(list_distinct(l), ' ') AS words FROM (SELECT result_id,
      list_sort(list_filter(string_split(regexp_replace(lower(search_text), '[[:punct:]]', ' ', 'g'), ' '), lambda x: x <> '')) AS l FROM results WHERE search_text IS NOT NULL) WHERE len(l) = 1
    UNION ALL
    SELECT result_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') FROM (SELECT result_id,
      list_filter(string_split(regexp_replace(regexp_replace(lower(search_text), '[[:punct:]]', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS l FROM results WHERE search_text IS NOT NULL) WHERE len(l) <> 1""")
def txt11_query_words(spark, sf):
    return load(spark, sf, "results").where("search_text is not null").select("result_id", F.array_join(txt.query_words(F.col("search_text")), " ").alias("words"))


@R.add(f"""
    SELECT word, doc_id, CAST(count(*) AS INTEGER) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS positions
    FROM ({TOKENS_SQL}) GROUP BY word, doc_id""")
def idx1_postings(spark, sf):
    posts = index.postings(index.tokenize(load(spark, sf, "documents"), "doc_id", "text"), "doc_id")
    return posts.select("word", "doc_id", "tf", F.array_join("positions", " ").alias("positions"))


@R.add(f"""
    WITH p AS (SELECT word, doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ' ' ORDER BY pos) AS t FROM ({TOKENS_SQL}) GROUP BY word, doc_id)
    SELECT word, string_agg(CAST(doc_id AS VARCHAR) || ':' || t, ',' ORDER BY tf DESC, CAST(doc_id AS VARCHAR)) AS postings FROM p GROUP BY word""")
def idx1_compat_string(spark, sf):
    posts = index.postings(index.tokenize(load(spark, sf, "documents"), "doc_id", "text"), "doc_id")
    return index.posting_lists(posts, "doc_id")


@R.add(r"""
    SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(regexp_replace(text, '<.*?>', ' ', 'g')),
      '[\r\n\t]+', ' ', 'g'), '[.,:;!?''"()-]+', ' ', 'g'), '\s+'), lambda x: x <> '')) AS word FROM documents WHERE text IS NOT NULL""")
def idx2_simple_index(spark, sf):
    return index.simple_index(load(spark, sf, "documents"), "doc_id", "text").select("doc_id", "word")


@R.add(f"""
    SELECT word, count(DISTINCT doc_id) AS df, round(ln((SELECT count(*) FROM documents) / CAST(count(DISTINCT doc_id) AS DOUBLE)), 6) AS idf
    FROM ({TOKENS_SQL}) GROUP BY word""")
def idx3_idf(spark, sf):
    docs = load(spark, sf, "documents")
    found = index.idf_of(index.term_counts(docs, "doc_id", "text"), docs.agg(F.count(F.lit(1)).alias("n")))
    return found.select("word", "df", F.round("idf", 6).alias("idf"))


_TF = """
    t AS (SELECT DISTINCT url, word, tf FROM tf WHERE url IS NOT NULL AND word IS NOT NULL),
    n AS (SELECT count(DISTINCT url) AS n FROM t),
    i AS (SELECT word, count(*) AS df, ln((SELECT n FROM n) / CAST(count(*) AS DOUBLE)) AS idf FROM t GROUP BY word)"""
_SEARCH = f"""
    WITH {_TF},
    c AS (SELECT url, word, tf, max(tf) OVER (PARTITION BY url) AS m FROM t WHERE word IN ({WORD_LIST})),
    s AS (SELECT url, sum((0.5 + 0.5 * tf / m) * idf) AS text FROM c JOIN i USING (word) GROUP BY url),
    r AS (SELECT url, max(rank) AS rank FROM pageranks GROUP BY url),
    f AS (SELECT url, round(text + {{prior}}, 6) AS score FROM s LEFT JOIN r USING (url)),
    o AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, url) AS INTEGER) AS position, url, score FROM f)
"""


def _tf(spark, sf):
    counts = load(spark, sf, "tf").select("url", "word", "tf").where("url is not null and word is not null").distinct()
    ranks = load(spark, sf, "pageranks").groupBy("url").agg(F.max("rank").alias("rank"))
    return counts, index.idf_of(counts, counts.agg(F.countDistinct("url").alias("n"))), ranks


@R.add(_SEARCH.format(prior="sqrt(1 + coalesce(rank, 0))") + "SELECT position, url, score FROM o WHERE position <= 10")
def srh1_search_top10(spark, sf):
    return search.page(search.scores(*_tf(spark, sf), WORDS))


@R.add(_SEARCH.format(prior="sqrt(1 + coalesce(rank, 0))") + "SELECT position, url, score FROM o WHERE position BETWEEN 11 AND 20")
def srh1_search_page2(spark, sf):
    return search.page(search.scores(*_tf(spark, sf), WORDS), 2)


@R.add(_SEARCH.format(prior="coalesce(rank, 0)") + "SELECT string_agg(url, ',' ORDER BY position) AS urls FROM o WHERE position <= 10")
def srh2_linear_prior(spark, sf):
    return search.url_list(search.page(search.scores(*_tf(spark, sf), WORDS, prior="linear")))


@R.add(f"""
    WITH {_TF} SELECT 'old ' || word AS suggestion, round(df * log10((SELECT n FROM n) / CAST(df AS DOUBLE)), 6) AS weight FROM i
    WHERE starts_with(word, 'th') ORDER BY weight DESC, word LIMIT 10""")
def sug1_suggest(spark, sf):
    _, idf, _ = _tf(spark, sf)
    return search.suggest(idf, "old th")


@R.add(f"""
    WITH {_TF}, b AS (SELECT word, round(df * log10((SELECT n FROM n) / CAST(df AS DOUBLE)), 6) AS w FROM i WHERE starts_with(word, 'ca') ORDER BY w DESC, word LIMIT 10)
    SELECT '{{"suggestions":[' || string_agg('"' || word || '"', ',' ORDER BY w DESC, word) || ']}}' AS json FROM b""")
def jsn1_suggestions_json(spark, sf):
    _, idf, _ = _tf(spark, sf)
    return search.suggestions_json(search.suggest(idf, "ca"))


@R.add(f"""
    WITH {_TF}, n2 AS (SELECT count(DISTINCT url) AS n FROM crawl WHERE url IS NOT NULL),
    b AS (SELECT word, round(df * log10((SELECT n FROM n2) / CAST(df AS DOUBLE)), 6) AS w FROM i WHERE starts_with(word, 'ca') ORDER BY w DESC, word LIMIT 10)
    SELECT string_agg('an old ' || word, ',' ORDER BY w DESC, word) AS suggestions FROM b HAVING count(*) > 0""")
def sug2_stored_suggestions(spark, sf):
    _, idf, _ = _tf(spark, sf)
    return search.suggest_stored(idf, load(spark, sf, "crawl").agg(F.countDistinct("url").alias("n")), "an old ca")


@R.add(f"""
    SELECT word, CAST(doc_id AS VARCHAR) AS url, CAST(count(*) AS INTEGER) AS n_positions, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last FROM ({TOKENS_SQL}) GROUP BY word, doc_id""")
def txt7_posting_parts(spark, sf):
    posts = index.postings(index.tokenize(load(spark, sf, "documents"), "doc_id", "text"), "doc_id")
    texts = posts.select("word", txt.posting_text(F.col("doc_id").cast("string"), F.col("positions")).alias("posting"))
    parts = texts.select("word", txt.posting_parts(F.col("posting")).alias("p"))
    return parts.select("word", "p.url", F.size("p.positions").alias("n_positions"), F.array_min("p.positions").alias("first"), F.array_max("p.positions").alias("last"))


_PAGES = "p AS (SELECT crawl_id, c.url, r.html FROM (SELECT crawl_id, max(html) AS html FROM raw_pages WHERE html IS NOT NULL GROUP BY crawl_id) r JOIN (SELECT crawl_id, max(url) AS url FROM crawl GROUP BY crawl_id) c USING (crawl_id))"


def _pages(spark, sf):
    raw = load(spark, sf, "raw_pages").where("html is not null").groupBy("crawl_id").agg(F.max("html").alias("html"))
    return raw.join(load(spark, sf, "crawl").groupBy("crawl_id").agg(F.max("url").alias("url")), "crawl_id")


_ELEMENTS = "regexp_replace(regexp_replace(regexp_replace({x}, '(?s)<style[^>]*>.*?</style>', '', 'g'), '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<footer[^>]*>.*?</footer>', '', 'g')"
_FINAL = "regexp_replace(" + _ELEMENTS + ", '(?s)<nav[^>]*>.*?</nav>', '', 'g')"
_STRIP = "regexp_replace({x}, '<[^a]([^>]*)>', '', 'g')"
_COLLAPSE = r"regexp_replace(regexp_replace(regexp_replace({x}, '[\r\n]', chr(10), 'g'), '[ \t\n\x0B\f\r]{{2,}}', ' ', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"


@R.add(f"WITH {_PAGES} SELECT crawl_id, md5({_FINAL.format(x='html')}) AS digest FROM p")
def htm1_remove_elements(spark, sf):
    return _pages(spark, sf).select("crawl_id", F.md5(h.remove_elements(F.col("html"))).alias("digest"))


@R.add(rf"""WITH {_PAGES} SELECT crawl_id, unnest(regexp_extract_all(html, '(?i)<a\s+[^>]*href\s*=\s*"([^"]*)"[^>]*>', 1)) AS href FROM p""")
def htm2_hrefs(spark, sf):
    return _pages(spark, sf).select("crawl_id", F.explode(h.hrefs(F.col("html"))).alias("href"))


@R.add(f"WITH {_PAGES} SELECT crawl_id, md5({_STRIP.format(x='html')}) AS digest FROM p")
def htm5_strip_tags(spark, sf):
    return _pages(spark, sf).select("crawl_id", F.md5(h.strip_tags(F.col("html"))).alias("digest"))


@R.add(f"""WITH {_PAGES} SELECT crawl_id, contains(html, 'lang="en') AS anywhere, contains(lower(left(html, 1000)), 'lang="en') AS near_start,
    contains(lower(left(html, 1000)), 'charset="utf-8"') AS utf8, length(html) >= 1000 AS long_enough FROM p""")
def htm8_language_filter(spark, sf):
    html = F.col("html")
    return _pages(spark, sf).select("crawl_id", h.is_english(html, True).alias("anywhere"), h.is_english(html).alias("near_start"), h.is_utf8(html).alias("utf8"), h.long_enough(html).alias("long_enough"))


@R.add("SELECT crawl_id, content_type FROM crawl WHERE starts_with(content_type, 'text/html')")
def htm11_content_type(spark, sf):
    return load(spark, sf, "crawl").where(h.is_html(F.col("content_type"))).select("crawl_id", "content_type")


@R.add(rf"""WITH {_PAGES} SELECT crawl_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[^\x00-\x7F]', '', 'g')), ''),
    regexp_replace(url, '^[a-z]+://([^/:]+)(:[0-9]+)?', '\1')) AS title FROM p""")
def htm12_title(spark, sf):
    return _pages(spark, sf).select("crawl_id", h.title(F.col("html"), F.col("url")).alias("title"))


@R.add(r"""
    SELECT crawl_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS links FROM (
      SELECT crawl_id, list_filter(list_transform(string_split(page, chr(10)), lambda x: regexp_extract(x, 'href=["'']([^"'' ]*)["'']', 1)), lambda x: x <> '' AND NOT contains(x, '..')) AS l
      FROM (SELECT crawl_id, max(page) AS page FROM crawl WHERE page IS NOT NULL GROUP BY crawl_id))""")
def htm14_line_links(spark, sf):
    pages = load(spark, sf, "crawl").where("page is not null").groupBy("crawl_id").agg(F.max("page").alias("page"))
    return pages.select("crawl_id", F.array_join(h.line_links(F.col("page")), " ").alias("links"))


@R.add(f"""WITH {_PAGES}, b AS (SELECT crawl_id, url, html, {_FINAL.format(x='html')} AS body FROM p), c AS (SELECT crawl_id, left({_COLLAPSE.format(x=_STRIP.format(x='body'))}, 40000) AS page FROM b
    WHERE contains(lower(left(html, 1000)), 'lang="en') AND contains(lower(left(html, 1000)), 'charset="utf-8"') AND length(body) >= 1000)
    SELECT crawl_id, md5(page) AS digest, CAST(length(page) AS INTEGER) AS cache_length FROM c""")
def crw7_clean_page(spark, sf):
    pages = _pages(spark, sf)
    cleaned = crawl.clean_page(pages.select(F.col("crawl_id").alias("url"), "html"))
    return cleaned.select(F.col("url").alias("crawl_id"), F.md5("page").alias("digest"), "cache_length")


@R.add(f"""WITH {_PAGES}, c AS (SELECT crawl_id, {_COLLAPSE.format(x=_STRIP.format(x=_ELEMENTS.format(x='html')))} AS page FROM p WHERE contains(html, 'lang="en'))
    SELECT crawl_id, md5(page) AS digest, CAST(length(page) AS INTEGER) AS cache_length FROM c""")
def crw7_clean_page_jobs(spark, sf):
    cleaned = crawl.clean_page(_pages(spark, sf).select(F.col("crawl_id").alias("url"), "html"), "jobs")
    return cleaned.select(F.col("url").alias("crawl_id"), F.md5("page").alias("digest"), "cache_length")


_DISTINCT_PAGES = "b AS (SELECT url, page FROM (SELECT crawl_id, arg_max(url, md5(page)) AS url, arg_max(page, md5(page)) AS page FROM crawl WHERE page IS NOT NULL AND url IS NOT NULL GROUP BY crawl_id))"
_HREFS = r"h AS (SELECT url AS src, unnest(regexp_extract_all(page, '(?i)<a\s+[^>]*href\s*=\s*\"([^\"]*)\"[^>]*>', 1)) AS href FROM b)".replace('\\"', '"')


def _parts_sql(x: str, p: str) -> str:
    """Scheme, host, port and path of the URL ``x`` as columns that begin with ``p``."""
    has = f"(contains({x}, '//') AND NOT starts_with({x}, '//'))"
    after = f"regexp_extract({x}, '(?s)^.*?.//(.*)$', 1)"
    authority = f"regexp_extract({after}, '^([^/]*)', 1)"
    return f"""CASE WHEN {has} THEN regexp_extract({x}, '(?s)^(.*?).//', 1) END AS {p}scheme,
        CASE WHEN {has} THEN CASE WHEN regexp_matches({authority}, '^[^:]+:') THEN split_part({authority}, ':', 1) ELSE {authority} END END AS {p}host,
        CASE WHEN {has} AND regexp_matches({authority}, '^[^:]+:') THEN regexp_extract({authority}, '^[^:]+:(.*)$', 1) END AS {p}port,
        CASE WHEN NOT {has} THEN {x} WHEN contains({after}, '/') THEN regexp_extract({after}, '(?s)^[^/]*(/.*)$', 1) ELSE '/' END AS {p}path"""


def _normalised_sql(source: str, own_fragment: str = "NULL") -> str:
    """CTEs that end in ``links(src, dst)``: the links of ``source(src, href)`` by the reference form."""
    return rf"""
    q1 AS (SELECT src, href, {_parts_sql('href', 'o')}, {_parts_sql('src', 'r')} FROM {source}),
    q2 AS (SELECT *, regexp_replace(opath, '(?s)#[^#]*$', '') AS p FROM q1),
    q3 AS (SELECT *, list_filter(string_split(regexp_replace(rpath, '/+$', ''), '/')[:-2], lambda x: x <> '') AS base, list_filter(string_split(p, '/'), lambda x: x <> '') AS segs FROM q2),
    q4 AS (SELECT *, CASE WHEN starts_with(p, '/') THEN p ELSE list_reduce(segs, lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '') ELSE acc || '/' || x END,
             list_aggregate(list_prepend('', base), 'string_agg', '/')) END AS path FROM q3),
    q5 AS (SELECT *, CASE WHEN oscheme IS NULL THEN rscheme || '://' || rhost || ':' || rport || path
             WHEN lower(oscheme) IN ('http', 'https') THEN oscheme || '://' || ohost || ':' || coalesce(oport, CASE WHEN lower(oscheme) = 'https' THEN '443' ELSE '80' END) || path END AS d FROM q4),
    q6 AS (SELECT src, href, CASE WHEN starts_with(opath, '#') THEN {own_fragment}
             WHEN NOT lower(regexp_extract(p, '(?s)[.]([^.]*)$', 1)) IN ('jpg', 'jpeg', 'gif', 'png', 'txt') AND NOT contains(d, 'null') THEN d END AS dst FROM q5),
    links AS (SELECT src, dst FROM q6 WHERE dst IS NOT NULL)"""


_LINKS = f"{_DISTINCT_PAGES}, {_HREFS}, {_normalised_sql('h')}"
_STRICT_LINKS = r"""
    l AS (SELECT url AS src, regexp_replace(unnest(regexp_extract_all(page, '(?i)<a\s+[^>]*href\s*=\s*"([^"]*)"[^>]*>', 1)), '#.*$', '') AS href FROM b),
    u AS (SELECT src, CASE
            WHEN regexp_matches(href, '^https?://[^/:]+:[0-9]+/') THEN href
            WHEN regexp_matches(href, '^https?://[^/:]+/') THEN regexp_replace(href, '^(https?)://([^/]+)', '\1://\2:') ELSE regexp_extract(src, '^[a-z]+://[^/]+') || href END AS dst0, href FROM l WHERE href <> ''),
    links AS (SELECT src, CASE WHEN regexp_matches(href, '^https?://[^/:]+/') THEN regexp_replace(dst0, '^(https?://[^/:]+:)', '\1' || CASE WHEN starts_with(href, 'https') THEN '443' ELSE '80' END) ELSE dst0 END AS dst
              FROM u WHERE (starts_with(href, '/') OR regexp_matches(href, '^https?://')) AND NOT contains(dst0, 'null')
              AND NOT regexp_matches(lower(regexp_replace(dst0, '[?].*$', '')), '[.](jpg|jpeg|gif|png|txt)$'))"""


def _stored(spark, sf):
    """``(crawl_id, url, page)``: each fetch with a page once, whatever copies of it there are; ids are grouped, not texts."""
    pages = load(spark, sf, "crawl").where("page is not null and url is not null and crawl_id is not null")
    return pages.groupBy("crawl_id").agg(F.max_by("url", F.md5("page")).alias("url"), F.max_by("page", F.md5("page")).alias("page"))


def _links(spark, sf, **options):
    return h.link_rows(_stored(spark, sf), "page", "url", **options)


@R.add(f"WITH {_LINKS} SELECT src, dst FROM links")
def url2_normalised_links(spark, sf):
    return _links(spark, sf)


@R.add(f"WITH {_DISTINCT_PAGES}, {_STRICT_LINKS} SELECT src, dst FROM links")
def url2_strict_links(spark, sf):
    return _links(spark, sf, strict=True)


LINK_CASES = [
    "/a/b.html", "c.html", "../up/d.html", "../../../far.html", "./e/./f", "g/", "//other.example/x", "mailto:someone@here.example", "javascript:open()",
    "http://o.example/p", "https://o.example", "HTTPS://o.example/q#part", "ftp://o.example/r", "http://o.example:8080/a/../b", "#top", "s.html#one#two", "pic.JPG", "/t.txt?x=1.2", "/null/x", "",
]
CASE_BASES = ["https://h.example:443/dir/sub/base.html", "http://h.example:80/", "http://bare.example/dir/"]
_CASES = "h AS (SELECT b AS src, l AS href FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in CASE_BASES) + "]) AS b), (SELECT unnest([" + ", ".join(f"'{x}'" for x in LINK_CASES) + "]) AS l))"


def _cases(spark, fragment_is_self=False):
    table = spark.createDataFrame([(b, x) for b in CASE_BASES for x in LINK_CASES], "src string, href string")
    return table.select("src", "href", urls.normalise(F.col("href"), F.col("src"), fragment_is_self).alias("dst"))


@R.add(f"WITH {_CASES}, {_normalised_sql('h')} SELECT src, href, dst FROM q6")
def url2_link_cases(spark, sf):
    return _cases(spark)


@R.add(f"WITH {_CASES}, {_normalised_sql('h', 'src')} SELECT src, href, dst FROM q6")
def url4_link_cases(spark, sf):
    return _cases(spark, True)


@R.add(f"WITH {_DISTINCT_PAGES}, {_HREFS}, {_normalised_sql('h', 'src')} SELECT src, dst FROM links")
def url4_self_links(spark, sf):
    return _links(spark, sf, fragment_is_self=True)


@R.add(r"""WITH b AS (SELECT DISTINCT url, regexp_replace(url, '#.*$', '') AS u FROM results WHERE regexp_matches(url, '^[a-zA-Z]+://')),
    p AS (SELECT url, lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) AS s, lower(regexp_extract(u, '^[a-zA-Z]+://([^/:]*)', 1)) AS h,
          regexp_extract(u, '^[a-zA-Z]+://[^/:]*:([0-9]+)', 1) AS port, regexp_extract(u, '^[a-zA-Z]+://[^/]*(/.*)$', 1) AS path FROM b)
    SELECT url, s || '://' || h || ':' || CASE WHEN port <> '' THEN port WHEN s = 'https' THEN '443' ELSE '80' END || CASE WHEN path = '' THEN '/' ELSE path END AS target,
           'http://from.example:80' || CASE WHEN path = '' THEN '/' ELSE path END AS moved FROM p""")
def url5_redirects(spark, sf):
    rows = load(spark, sf, "results").where("url rlike '^[a-zA-Z]+://'").select("url").distinct()
    base = F.lit("http://from.example:80/old/page.html")
    path = F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace("url", "#.*$", ""), "^[a-zA-Z]+://[^/]*(/.*)$", 1), F.lit("")), F.lit("/"))
    return rows.select("url", urls.redirect(F.col("url"), base).alias("target"), urls.redirect(path, base).alias("moved"))


@R.add(f"""WITH {_LINKS} SELECT src, dst FROM links WHERE length(dst) > 13 AND length(dst) < 150 AND NOT contains(dst, '..')
    AND starts_with(dst, 'http') AND length(dst) - length(replace(dst, 'http', '')) = 4""")
def htm3_plausible_links(spark, sf):
    links = _links(spark, sf)
    return links.where(F.size(h.plausible_links(F.array("dst"))) == 1)


@R.add(r"""SELECT x, regexp_replace(regexp_replace(regexp_replace(x, '[\r\n]', chr(10), 'g'), '[ \t\n\x0B\f\r]{2,}', ' ', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS collapsed
    FROM (SELECT unnest(['a' || chr(13) || chr(10) || 'b', chr(10) || 'a', chr(9) || ' a ', 'a' || chr(10) || 'b', 'a' || chr(11) || chr(11) || 'b', '  ', '', 'a' || chr(13) || 'b' || chr(1)]) AS x)""")
def htm6_cases(spark, sf):
    texts = spark.createDataFrame([("a\r\nb",), ("\na",), ("\t a ",), ("a\nb",), ("a\x0b\x0bb",), ("  ",), ("",), ("a\rb\x01",)], "x string")
    return texts.select("x", h.collapse(F.col("x")).alias("collapsed"))


@R.add(f"WITH {_PAGES} SELECT crawl_id, md5(regexp_replace(html, '<a[.]*[.]+[.]+[.]*>', '', 'g')) AS digest FROM p")
def htm4_dotted_anchors(spark, sf):
    return _pages(spark, sf).select("crawl_id", F.md5(h.drop_dotted_anchors(F.col("html"))).alias("digest"))


@R.add(f"WITH {_PAGES} SELECT crawl_id, md5({_COLLAPSE.format(x='html')}) AS digest FROM p")
def htm6_collapse(spark, sf):
    return _pages(spark, sf).select("crawl_id", F.md5(h.collapse(F.col("html"))).alias("digest"))


@R.add("SELECT crawl_id, CAST(length(left(page, 40000)) AS INTEGER) AS cache_length, md5(left(page, 40000)) AS digest FROM (SELECT crawl_id, max(page) AS page FROM crawl WHERE page IS NOT NULL GROUP BY crawl_id)")
def htm7_truncate(spark, sf):
    pages = load(spark, sf, "crawl").where("page is not null").groupBy("crawl_id").agg(F.max("page").alias("page")).select("crawl_id", h.truncate(F.col("page")).alias("page"))
    return pages.select("crawl_id", F.length("page").alias("cache_length"), F.md5("page").alias("digest"))


@R.add(r"""SELECT DISTINCT url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:]*)', 1) AS host,
    nullif(regexp_extract(url, '^[a-z]+://[^/:]*:([0-9]+)', 1), '') AS port, nullif(regexp_extract(url, '^[a-z]+://[^/]*(/.*)?$', 1), '') AS path FROM crawl WHERE url IS NOT NULL""")
def url1_parse(spark, sf):
    p = urls.parts(F.col("url"))
    return load(spark, sf, "crawl").where("url is not null").select("url", p["scheme"].alias("scheme"), p["host"].alias("host"), p["port"].alias("port"), p["path"].alias("path")).distinct()


@R.add(r"""WITH b AS (SELECT DISTINCT result_id, trim(regexp_replace(url, '#.*$', '')) AS w FROM results WHERE url IS NOT NULL),
    f AS (SELECT result_id, CASE WHEN regexp_matches(w, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN w ELSE 'http://' || w END AS u FROM b),
    p AS (SELECT result_id, lower(regexp_extract(u, '^([^:/?#]+)://', 1)) AS s, lower(regexp_extract(u, '^[^:/?#]+://([^/:]*)', 1)) AS h,
          regexp_extract(u, '^[^:/?#]+://[^/:]*:([0-9]+)', 1) AS port, regexp_extract(u, '^[^:/?#]+://[^/:]*(:[0-9]*)?(.*)$', 2) AS path FROM f)
    SELECT result_id, s || '://' || h || ':' || CASE WHEN port <> '' THEN port WHEN s = 'https' THEN '443' ELSE '80' END || CASE WHEN path = '' THEN '/' ELSE path END AS url FROM p""")
def url3_seed(spark, sf):
    rows = load(spark, sf, "results").where("url is not null").select("result_id", "url").distinct()
    return rows.select("result_id", urls.seed(F.col("url")).alias("url"))


@R.add("SELECT DISTINCT result_id, search_text FROM results WHERE search_text IS NOT NULL")
def url6_encode_decode(spark, sf):
    rows = load(spark, sf, "results").where("search_text is not null").select("result_id", "search_text").distinct()
    return rows.select("result_id", urls.decode(urls.encode(F.col("search_text"))).alias("search_text"))


@R.add("SELECT crawl_id, sha1(reverse(url)) AS key FROM crawl WHERE url IS NOT NULL")
def hsh1_row_key(spark, sf):
    return load(spark, sf, "crawl").where("url is not null").select("crawl_id", urls.row_key(F.col("url")).alias("key"))


_GRAPH = """
    e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"""
_MEMBERS = """,
    o AS (SELECT src, count(*) AS n FROM e GROUP BY src), i AS (SELECT e.src, e.dst FROM e WHERE e.dst IN (SELECT src FROM o)),
    m AS (SELECT src AS url FROM o), r0 AS (SELECT url, CAST(1.0 AS DOUBLE) AS r FROM m)"""


def _ROUND(k: int) -> str:
    return f""",
    s{k} AS (SELECT i.dst AS url, sum(0.85 / n * r) AS s FROM i JOIN r{k - 1} ON i.src = r{k - 1}.url JOIN o ON o.src = i.src GROUP BY i.dst),
    r{k} AS (SELECT m.url, coalesce(s, 0) + 0.15 AS r FROM m LEFT JOIN s{k} USING (url))"""


def _purchases(spark, sf):
    items = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    a, b = items.withColumnRenamed("l_partkey", "src"), items.withColumnRenamed("l_partkey", "dst")
    return a.join(b, "l_orderkey").where("src < dst").select("src", "dst").distinct()


@R.add(f"WITH {_GRAPH}{_MEMBERS}{''.join(map(_ROUND, (1, 2, 3)))} SELECT url, round(r, 6) AS rank FROM r3")
def prk1_rank_k3(spark, sf):
    return pagerank.pagerank(_purchases(spark, sf), rounds=3).select("url", F.round("rank", 6).alias("rank"))


@R.add()
def prk1_converged(spark, sf):
    return pagerank.pagerank(_purchases(spark, sf), tolerance=1e-3).select("url", F.round("rank", 4).alias("rank"))


@R.add(f"""WITH {_LINKS}, e AS (SELECT DISTINCT src, dst FROM links), o AS (SELECT src, count(*) AS n FROM e GROUP BY src),
    w AS (SELECT DISTINCT url FROM crawl WHERE url IS NOT NULL), i AS (SELECT src, dst FROM e WHERE dst IN (SELECT url FROM w)),
    m AS (SELECT src AS url FROM o UNION SELECT dst FROM i), r0 AS (SELECT url, CAST(1.0 AS DOUBLE) AS r FROM m)
    {''.join(map(_ROUND, (1, 2)))} SELECT url, round(r, 6) AS rank FROM r2""")
def prk1_pages_rank(spark, sf):
    nodes = load(spark, sf, "crawl").select("url").where("url is not null").distinct()
    return pagerank.pagerank(_links(spark, sf), nodes, rounds=2).select("url", F.round("rank", 6).alias("rank"))


def _decorated(spark, sf):
    found = search.page(search.scores(*_tf(spark, sf), WORDS))
    newest = _pages(spark, sf).groupBy("url").agg(F.max_by("html", "crawl_id").alias("html"))
    return search.decorate(found, newest, " ".join(WORDS))


_PARAGRAPHS = r"""list_transform(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g')))"""
_TITLE = r"""coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[^\x00-\x7F]', '', 'g')), ''), regexp_replace(url, '^[a-z]+://([^/:]+)(:[0-9]+)?', '\1'))"""
_DECORATED = _SEARCH.format(prior="sqrt(1 + coalesce(rank, 0))") + rf""", {_PAGES},
    w AS (SELECT url, arg_max(html, crawl_id) AS html FROM p GROUP BY url),
    d AS (SELECT position, o.url, score, coalesce(html, '') AS body, {_TITLE.replace("url,", "o.url,").replace("(html", "(html")} AS title FROM o LEFT JOIN w USING (url) WHERE position <= 10),
    y AS (SELECT *, {_PARAGRAPHS.replace("html", "body")} AS t FROM d),
    v AS (SELECT *, list_transform([{WORD_LIST}], lambda w: list_position(list_transform(t, lambda x: contains(lower(x), w)), true)) AS v FROM y),
    k AS (SELECT *, list_transform(range(1, greatest(len(t), 1) + 1), lambda i: len(list_filter(v, lambda x: x = i))) AS n FROM v),
    res AS (SELECT position, url, score, title, regexp_replace(coalesce(t[list_position(n, list_max(n))], ''), '[^\x00-\x7F]', '', 'g') AS description FROM k)"""


@R.add(_DECORATED + " SELECT position, url, score, title, description FROM res")
def res1_results(spark, sf):
    return _decorated(spark, sf)


@R.add(_DECORATED + """ SELECT '{"results":[' || coalesce(string_agg('{"url":' || to_json(url) || ',"title":' || to_json(title) || ',"description":' || to_json(description) || '}', ',' ORDER BY position), '') || ']}' AS json FROM res""")
def jsn1_results_json(spark, sf):
    return search.results_json(_decorated(spark, sf))


@R.add(f"WITH {_GRAPH}, m AS (SELECT src AS url FROM e) SELECT count(DISTINCT url) AS n_ranked, true AS settled FROM m")
def prk1_fixed_point(spark, sf):
    """Whether the converged ranks stay as they are, within the tolerance, for one more round on the whole graph."""
    edges = materialize(_purchases(spark, sf))
    ranks = materialize(pagerank.pagerank(edges, tolerance=1e-4))
    fan_out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("links"))
    given = edges.join(fan_out, "src").join(ranks.withColumnRenamed("url", "src"), "src").groupBy("dst").agg(F.sum(0.85 * F.col("rank") / F.col("links")).alias("s"))
    both = ranks.join(given.withColumnRenamed("dst", "url"), "url", "left")
    change = F.max(F.abs(F.coalesce("s", F.lit(0.0)) + 0.15 - F.col("rank")))
    return both.agg(F.count(F.lit(1)).alias("n_ranked"), (change < 1e-4).alias("settled"))


@R.add(rf"""WITH {_PAGES}, t AS (SELECT crawl_id, {_PARAGRAPHS} AS t FROM p),
    v AS (SELECT crawl_id, t, list_transform([{WORD_LIST}], lambda w: list_position(list_transform(t, lambda x: contains(lower(x), w)), true)) AS v FROM t),
    k AS (SELECT crawl_id, t, list_transform(range(1, greatest(len(t), 1) + 1), lambda i: len(list_filter(v, lambda x: x = i))) AS n FROM v)
    SELECT crawl_id, regexp_replace(coalesce(t[list_position(n, list_max(n))], ''), '[^\x00-\x7F]', '', 'g') AS description FROM k""")
def htm13_description(spark, sf):
    words = F.array(*[F.lit(w) for w in WORDS])
    return _pages(spark, sf).select("crawl_id", h.description(F.col("html"), words).alias("description"))


_LATEST_HOSTS = "lh AS (SELECT host, arg_max(robots, row(coalesce(epoch_us(last_access), 0), robots)) AS robots FROM hosts WHERE host IS NOT NULL AND robots IS NOT NULL GROUP BY host)"


def _rules(spark, sf):
    known = load(spark, sf, "hosts").where("host is not null and robots is not null")
    time = F.coalesce(F.unix_micros(F.col("last_access").cast("timestamp")), F.lit(0))
    latest = known.groupBy("host").agg(F.max_by("robots", F.struct(time, "robots")).alias("robots"))
    return crawl.robots_rules(latest)


_RULES = rf"""
    {_LATEST_HOSTS},
    n AS (SELECT host, unnest(range(len(l))) AS pos, trim(regexp_replace(unnest(l), '#.*$', '')) AS l FROM (SELECT host, string_split(replace(replace(robots, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM lh)),
    f AS (SELECT host, CAST(pos AS INTEGER) AS pos, lower(trim(split_part(l, ':', 1))) AS kind, trim(substr(l, instr(l, ':') + 1)) AS value FROM n WHERE contains(l, ':')),
    a AS (SELECT host, pos, kind, value, last_value(CASE WHEN kind = 'user-agent' THEN lower(value) END IGNORE NULLS) OVER (PARTITION BY host ORDER BY pos ROWS UNBOUNDED PRECEDING) AS agent FROM f),
    rules AS (SELECT host, pos, agent, kind, value FROM a WHERE kind IN ('allow', 'disallow', 'crawl-delay'))"""


@R.add(f"WITH {_RULES} SELECT host, pos, agent, kind, value FROM rules")
def crw3_rules(spark, sf):
    return _rules(spark, sf)


@R.add(rf"""WITH {_RULES}, u AS (SELECT DISTINCT host, regexp_extract(url, '^[a-z]+://[^/]*(/.*)$', 1) AS path FROM crawl WHERE host IS NOT NULL AND url IS NOT NULL),
    d AS (SELECT u.host, u.path, arg_min(kind, pos + CASE WHEN agent = '*' THEN 1000000 ELSE 0 END) AS kind FROM u JOIN rules r ON u.host = r.host AND r.kind <> 'crawl-delay' AND r.agent IN ('webrank', '*') AND r.value <> '' AND starts_with(u.path, r.value) GROUP BY u.host, u.path)
    SELECT u.host, u.path, coalesce(d.kind <> 'disallow', true) AS allowed FROM u LEFT JOIN d ON u.host = d.host AND u.path = d.path""")
def crw3_robots(spark, sf):
    pages = load(spark, sf, "crawl").where("host is not null and url is not null").select("host", F.regexp_extract("url", "^[a-z]+://[^/]*(/.*)$", 1).alias("path")).distinct()
    return crawl.robots_allowed(pages, _rules(spark, sf), "webrank")


@R.add(f"WITH {_RULES} SELECT host, arg_max(try_cast(value AS DOUBLE), pos) FILTER (try_cast(value AS DOUBLE) IS NOT NULL) AS delay FROM rules WHERE kind = 'crawl-delay' GROUP BY host HAVING delay IS NOT NULL")
def crw4_delay(spark, sf):
    return crawl.crawl_delay(_rules(spark, sf))


@R.add("""
    WITH u AS (SELECT DISTINCT host, url FROM crawl WHERE host IS NOT NULL AND url IS NOT NULL),
    lh AS (SELECT host, arg_max(crawl_delay, last_access) AS delay, max(last_access) AS last FROM hosts WHERE host IS NOT NULL AND last_access IS NOT NULL AND crawl_delay IS NOT NULL GROUP BY host),
    n AS (SELECT host, url, row_number() OVER (PARTITION BY host ORDER BY url) - 1 AS n FROM u)
    SELECT host, url, CAST(greatest(1700000000000000, coalesce(CAST(round(epoch_us(last) + delay * 1000000) AS BIGINT), 0)) + CAST(round(n * coalesce(delay, 1.0) * 1000000) AS BIGINT) AS BIGINT) AS due_us
    FROM n LEFT JOIN lh USING (host)""")
def crw5_rate_schedule(spark, sf):
    pages = load(spark, sf, "crawl").where("host is not null and url is not null").select("host", "url").distinct()
    known = load(spark, sf, "hosts").where("host is not null and last_access is not null and crawl_delay is not null")
    known = known.groupBy("host").agg(F.max_by("crawl_delay", "last_access").alias("delay"), F.max("last_access").alias("last_access"))
    due = crawl.rate_schedule(pages, known, "url", F.timestamp_micros(F.lit(1_700_000_000_000_000)))
    return due.select("host", "url", F.unix_micros("due").alias("due_us"))


def _capped(k: int) -> str:
    return f""",
    g{k} AS (SELECT (SELECT count(*) FROM v{k - 1}) <= 500 AND (SELECT count(*) FROM l{k - 1}) <= 1000 AS go),
    l{k} AS (SELECT DISTINCT e.dst AS url, {k} AS depth FROM l{k - 1} JOIN e ON e.src = l{k - 1}.url, g{k} WHERE go AND e.dst NOT IN (SELECT url FROM v{k - 1})),
    v{k} AS (SELECT * FROM v{k - 1} UNION ALL SELECT * FROM l{k})"""


@R.add(f"WITH {_GRAPH}, l0 AS (SELECT min(src) AS url, 0 AS depth FROM e), v0 AS (SELECT * FROM l0){''.join(map(_capped, range(1, 6)))} SELECT url, CAST(depth AS INTEGER) AS depth FROM v5")
def crw2_frontier_cap(spark, sf):
    edges = materialize(_purchases(spark, sf))
    return crawl.frontier(edges.agg(F.min("src").alias("url")), edges, 5, cap=500, back_pressure=1000)


@R.add(f"""WITH RECURSIVE {_GRAPH}, f(url, depth) AS (SELECT min(src), 0 FROM e UNION SELECT e.dst, f.depth + 1 FROM f JOIN e ON e.src = f.url WHERE f.depth < 2)
    SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM f GROUP BY url""")
def crw1_frontier(spark, sf):
    edges = materialize(_purchases(spark, sf))
    return crawl.frontier(edges.agg(F.min("src").alias("url")), edges, 2)
