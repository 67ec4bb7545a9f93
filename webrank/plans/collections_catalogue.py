"""Queries of collections, pairs, the table store and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webrank.functions import text as txt
from webrank.operators import collection as c
from webrank.plans.registry import Registry
from webrank.plans.session import load, materialize, scratch
from webrank.sources import rowformat, store

R = Registry()
STORE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "crawl", "hosts")


def _pairs(spark: SparkSession, sf: str, table: str, key: str, value: str) -> DataFrame:
    return c.map_to_pair(load(spark, sf, table), F.col(key).cast("string"), F.col(value).cast("string"))


@R.add("SELECT unnest(['banana', 'apple', 'cherry', 'apple']) AS value")
def src1_parallelize(spark, sf):
    return c.parallelize(spark, ["banana", "apple", "cherry", "apple"])


@R.add("SELECT o_orderkey || ',' || o_orderstatus AS value FROM orders WHERE o_orderstatus <> 'O'")
def src2_from_table(spark, sf):
    value = F.when(F.col("o_orderstatus") != "O", F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus"))
    return c.from_rows(load(spark, sf, "orders"), value)


@R.add("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def src3_scan(spark, sf):
    return store.scan(load(spark, sf, "supplier"), "s_name")


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000300'")
def src4_range_scan(spark, sf):
    return store.scan(load(spark, sf, "customer"), "c_name", "Customer#000000100", "Customer#000000300").select("c_custkey", "c_name")


@R.add("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey = 42")
def src5_get_row(spark, sf):
    return store.get_row(load(spark, sf, "customer"), "c_custkey", 42).select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@R.add("SELECT c_mktsegment AS value FROM customer WHERE c_custkey = 42 AND c_mktsegment IS NOT NULL")
def src6_get_cell(spark, sf):
    return store.get_cell(load(spark, sf, "customer"), "c_custkey", 42, "c_mktsegment")


@R.add("SELECT c_custkey AS o_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS \"exists\" FROM customer")
def src7_exists_row(spark, sf):
    return store.exists(load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")), load(spark, sf, "orders"), "o_custkey")


@R.add("SELECT count(*) AS n FROM lineitem")
def src8_count(spark, sf):
    return store.count(load(spark, sf, "lineitem"))


@R.add("""
    SELECT CAST(c_custkey AS VARCHAR) AS key, 'c_name' AS "column", c_name AS value FROM customer WHERE c_name IS NOT NULL
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'c_mktsegment', c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL""")
def src9_row_format(spark, sf):
    rows = rowformat.encode(load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    return rowformat.decode(rows).select("key", "column", F.col("value").cast("string").alias("value"))


@R.add("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def snk1_save_and_read(spark, sf):
    return materialize(load(spark, sf, "nation"))


@R.add("""SELECT 'before' AS step, n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 'after', n_nationkey, n_name, n_regionkey FROM nation""")
def snk5_persist_rename_delete(spark, sf):
    """A table saved under a name (SNK1, SNK5), renamed (SNK6), its old name gone, then deleted (SNK7); both readings come out."""
    old, new = (f"webrank_{uuid.uuid4().hex}" for _ in range(2))
    store.persist(load(spark, sf, "nation"), old)
    before = materialize(spark.table(old).select(F.lit("before").alias("step"), "*"))
    store.rename(spark, old, new)
    if spark.catalog.tableExists(old):
        raise RuntimeError("the old name is still there")
    after = materialize(spark.table(new).select(F.lit("after").alias("step"), "*"))
    store.delete(spark, new)
    if spark.catalog.tableExists(new):
        raise RuntimeError("the table is still there")
    return before.unionByName(after)


@R.add("""
    SELECT 'customer' AS "table", CAST(c_custkey AS VARCHAR) AS key, 'c_name' AS "column", c_name AS value FROM customer WHERE c_name IS NOT NULL
    UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'c_mktsegment', c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL
    UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), 'n_name', n_name FROM nation WHERE n_name IS NOT NULL""")
def src9_read_tables(spark, sf):
    """Tables written as files of the row format into one folder, and all read back."""
    folder = scratch(spark)
    rowformat.write_table(load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey", folder, "customer")
    rowformat.write_table(load(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", folder, "nation")
    return rowformat.read_tables(spark, folder).select("table", "key", "column", F.col("value").cast("string").alias("value"))


@R.add("SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def snk2_upsert_cells(spark, sf):
    return store.latest_cells(load(spark, sf, "events"), "user_id", "event_type", "value", "event_id")


@R.add("""
    WITH c AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY user_id, event_type)
    SELECT CAST(user_id AS VARCHAR) AS key, string_agg(event_type, ',' ORDER BY event_type) AS columns FROM c GROUP BY user_id""")
def snk2_merge_rows(spark, sf):
    cells = store.latest_cells(load(spark, sf, "events"), "user_id", "event_type", "value", "event_id")
    cells = cells.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("column"), F.col("value").cast("string").alias("value"))
    first = cells.where("column < 'm'").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("cols"))
    merged = store.put_cells(first, cells)
    return merged.select("key", F.array_join(F.sort_array(F.map_keys("cols")), ",").alias("columns"))


@R.add("""
    SELECT o_orderkey, o_orderstatus = 'P' AS ok, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus
    FROM orders""")
def snk3_conditional_put(spark, sf):
    return store.put_if(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", F.lit("P"), F.lit("F"))


@R.add("""
    SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 'PATCHED' ELSE c_name END AS c_name FROM customer""")
def snk4_put_row(spark, sf):
    customers = load(spark, sf, "customer")
    patch = customers.where("c_nationkey = 7").select("c_custkey", F.lit("PATCHED").alias("c_name"))
    return store.put_rows(customers.select("c_custkey", "c_name"), patch, "c_custkey")


@R.add("SELECT string_agg(r_name, ';' ORDER BY r_name) AS output FROM region")
def snk8_output(spark, sf):
    names = load(spark, sf, "region").agg(F.sort_array(F.collect_list("r_name")).alias("names"))
    return names.select(F.array_join("names", ";").alias("output"))


@R.add(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in STORE_TABLES))
def snk11_list_tables(spark, sf):
    return store.list_tables({t: load(spark, sf, t) for t in STORE_TABLES})


@R.add("""
    SELECT p_partkey, p_name, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS row_id,
           (SELECT p_partkey FROM part WHERE p_partkey >= 25 ORDER BY p_partkey OFFSET 10 LIMIT 1) AS next_key
    FROM part WHERE p_partkey >= 25 ORDER BY p_partkey LIMIT 10""")
def snk12_view_page(spark, sf):
    return store.view_page(load(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", 25)


_TOKENS = r"""
    SELECT {key}, unnest(range(len(t))) AS pos, unnest(t) AS word FROM (
      SELECT {key}, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(regexp_replace({text}, '<.*?>', ' ', 'g')),
             '[\r\n\t]+', ' ', 'g'), '[.,:;!?''"()-]+', ' ', 'g'), '\s+'), lambda x: regexp_full_match(x, '[a-zA-Z0-9]+')) AS t
      FROM {table} WHERE {text} IS NOT NULL)"""
TOKENS_SQL = _TOKENS.format(key="doc_id", text="text", table="documents")


@R.add(f"SELECT word AS value FROM ({TOKENS_SQL})")
def map1_flat_map(spark, sf):
    return c.flat_map(load(spark, sf, "documents"), txt.tokens(F.col("text")))


@R.add(f"SELECT word AS key, CAST(doc_id AS VARCHAR) AS value FROM ({TOKENS_SQL})")
def map2_flat_map_to_pair(spark, sf):
    pairs = F.transform(txt.tokens(F.col("text")), lambda w: F.struct(w.alias("key"), F.col("doc_id").cast("string").alias("value")))
    return c.flat_map_to_pair(load(spark, sf, "documents"), pairs)


@R.add("SELECT o_orderpriority AS key, CAST(o_orderkey AS VARCHAR) AS value FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL")
def map3_map_to_pair(spark, sf):
    key = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    return c.map_to_pair(load(spark, sf, "orders"), key, F.col("o_orderkey").cast("string"))


@R.add(r"""
    SELECT source || '/' || unnest(list_filter(string_split(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' '), lambda x: x <> '')) AS value
    FROM documents WHERE source IS NOT NULL AND text IS NOT NULL""")
def map4_pair_flat_map(spark, sf):
    pairs = _pairs(spark, sf, "documents", "source", "text")
    words = F.filter(F.split(F.regexp_replace("value", "[ \\t\\r\\n]+", " "), " "), lambda w: w != "")
    return c.flat_map(pairs, F.transform(words, lambda w: F.concat("key", F.lit("/"), w)))


@R.add(r"""
    SELECT search_text AS key, unnest(string_split(url, '/')) AS value FROM results WHERE search_text IS NOT NULL AND url IS NOT NULL""")
def map5_pair_flat_map_to_pair(spark, sf):
    pairs = _pairs(spark, sf, "results", "search_text", "url")
    return c.flat_map_to_pair(pairs, F.transform(F.split("value", "/"), lambda x: F.struct(F.col("key").alias("key"), x.alias("value"))))


@R.add("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def map6_map_partitions(spark, sf):
    def net(batches):
        for b in batches:
            yield b[["l_orderkey", "l_linenumber"]].assign(net=b["l_extendedprice"] * (1 - b["l_discount"]))

    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return c.map_partitions_py(rows, net, "l_orderkey bigint, l_linenumber int, net double")


@R.add("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def fil1_filter(spark, sf):
    rows = load(spark, sf, "lineitem")
    return c.filter_(rows, (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_partkey", "l_quantity")


@R.add()
def fil2_sample(spark, sf):
    return c.sample(load(spark, sf, "orders"), 0.1, 7)


@R.add("SELECT o_orderkey, o_totalprice FROM orders WHERE ('0x' || left(md5(CAST(o_orderkey AS VARCHAR)), 8))::BIGINT % 10 < 3")
def fil2_hash_sample(spark, sf):
    return c.hash_sample(load(spark, sf, "orders"), F.col("o_orderkey"), 3, 10).select("o_orderkey", "o_totalprice")


@R.add("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def fil4_prefix(spark, sf):
    return c.filter_(load(spark, sf, "customer"), F.col("c_name").startswith("Customer#0000001")).select("c_custkey", "c_name")


@R.add("SELECT upper(n_name) AS value FROM nation WHERE length(n_name) > 5 UNION ALL SELECT n_name FROM nation WHERE length(n_name) > 5")
def udf1_flat_map_callable(spark, sf):
    names = load(spark, sf, "nation").select(F.col("n_name").alias("value"))
    return c.flat_map_py(c.filter_py(names, lambda x: len(x) > 5), lambda x: [x.upper(), x])


@R.add("SELECT left(r_name, 1) AS key, r_name || '!' AS value FROM region UNION ALL SELECT left(r_name, 1), r_name || '?' FROM region")
def udf2_pair_callable(spark, sf):
    pairs = c.map_to_pair_py(load(spark, sf, "region").select(F.col("r_name").alias("value")), lambda x: (x[:1], x))
    return c.pair_flat_map_py(pairs, lambda k, v: [(k, v + "!"), (k, v + "?")])


@R.add("""
    SELECT CAST(c_custkey AS VARCHAR) AS key, c_name || ',' || CAST(o_orderkey AS VARCHAR) AS value
    FROM customer JOIN orders ON c_custkey = o_custkey""")
def joi1_join(spark, sf):
    return c.join(_pairs(spark, sf, "customer", "c_custkey", "c_name"), _pairs(spark, sf, "orders", "o_custkey", "o_orderkey"))


@R.add("""
    WITH a AS (SELECT c_nationkey AS k, string_agg(c_name, ',' ORDER BY c_name) AS v FROM customer GROUP BY 1),
         b AS (SELECT s_nationkey AS k, string_agg(s_name, ',' ORDER BY s_name) AS v FROM supplier GROUP BY 1)
    SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS key, '[' || coalesce(a.v, '') || '],[' || coalesce(b.v, '') || ']' AS value
    FROM a FULL JOIN b ON a.k = b.k""")
def joi2_cogroup(spark, sf):
    return c.cogroup(_pairs(spark, sf, "customer", "c_nationkey", "c_name"), _pairs(spark, sf, "supplier", "s_nationkey", "s_name"))


@R.add("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def joi5_visited_anti(spark, sf):
    return c.subtract(load(spark, sf, "customer").select("c_custkey"), load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")))


@R.add("""
    SELECT t.url, t.word, t.tf, coalesce(p.rank, 0) AS rank FROM (SELECT DISTINCT url, word, tf FROM tf) t
    LEFT JOIN (SELECT DISTINCT url, rank FROM pageranks) p USING (url) JOIN (SELECT DISTINCT word FROM queries) q USING (word)""")
def joi4_lookup(spark, sf):
    words = load(spark, sf, "queries").select("word").distinct()
    ranks = load(spark, sf, "pageranks").select("url", "rank").distinct()
    held = load(spark, sf, "tf").select("url", "word", "tf").distinct().join(words, "word", "left_semi")
    return held.join(ranks, "url", "left").select("url", "word", "tf", F.coalesce("rank", F.lit(0.0)).alias("rank"))


@R.add("SELECT CAST(10 + sum(l_linenumber) AS BIGINT) AS value FROM lineitem")
def agg2_fold_sum(spark, sf):
    return c.fold(load(spark, sf, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("value")), 10, "sum")


@R.add("SELECT greatest(max(l_extendedprice), 0.0) AS value FROM lineitem")
def agg7_fold_max(spark, sf):
    return c.fold(load(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("value")), 0.0, "max")


@R.add("SELECT 5 AS value")
def agg2_fold_empty(spark, sf):
    return c.fold(load(spark, sf, "lineitem").where("l_quantity < 0").select(F.col("l_linenumber").alias("value")), 5, "sum").select(F.col("value").cast("int"))


@R.add("SELECT '>' || string_agg(r_name, '' ORDER BY r_name) AS value FROM region")
def agg2_fold_concat(spark, sf):
    return c.fold(load(spark, sf, "region").select(F.col("r_name").alias("value")), ">", lambda acc, x: F.concat(acc, x))


@R.add("SELECT l_returnflag AS key, CAST(sum(l_linenumber) AS BIGINT) AS value FROM lineitem GROUP BY 1")
def agg3_fold_by_key(spark, sf):
    pairs = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_linenumber").cast("bigint").alias("value"))
    return c.fold_by_key(pairs, 0, "sum")


@R.add("SELECT CAST(n_regionkey AS VARCHAR) AS key, coalesce(string_agg(n_name, '' ORDER BY n_name) FILTER (n_name < 'J'), '') AS value FROM nation GROUP BY n_regionkey")
def agg3_null_steps(spark, sf):
    """A fold whose step gives null for names from J on: those leave what there is."""
    return c.fold_by_key(_pairs(spark, sf, "nation", "n_regionkey", "n_name"), "", lambda acc, x: F.when(x < "J", F.concat(acc, x)))


@R.add("SELECT CAST(n_regionkey AS VARCHAR) AS key, string_agg(n_name, ',' ORDER BY n_name) AS value FROM nation GROUP BY n_regionkey")
def agg4_group_by(spark, sf):
    return c.group_by(load(spark, sf, "nation").withColumn("value", F.col("n_name")), F.col("n_regionkey").cast("string"))


@R.add("SELECT DISTINCT event_type, user_id FROM events")
def agg5_distinct(spark, sf):
    return c.distinct(load(spark, sf, "events").select("event_type", "user_id"))


@R.add("SELECT p_brand AS key, string_agg(p_name, '|' ORDER BY p_name) AS value FROM part GROUP BY p_brand")
def agg8_concat_by_key(spark, sf):
    return c.concat_by_key(_pairs(spark, sf, "part", "p_brand", "p_name"), "|")


@R.add("SELECT url, CAST(sum(tf) AS BIGINT) AS total, max(tf) AS greatest FROM (SELECT DISTINCT url, word, tf FROM tf) GROUP BY url")
def agg12_row_totals(spark, sf):
    rows = load(spark, sf, "tf").distinct().groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("word", "tf"))).alias("cols"))
    cells = F.map_values("cols")
    return rows.select("url", F.aggregate(cells, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_max(cells).alias("greatest"))


@R.add("SELECT c_nationkey AS value FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set1_intersection(spark, sf):
    return c.intersection(load(spark, sf, "customer").select(F.col("c_nationkey").alias("value")), load(spark, sf, "supplier").select(F.col("s_nationkey").alias("value")))


@R.add("SELECT c_nationkey AS value FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set3_union(spark, sf):
    return c.union(load(spark, sf, "customer").select(F.col("c_nationkey").alias("value")), load(spark, sf, "supplier").select(F.col("s_nationkey").alias("value")))


@R.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def top1_take(spark, sf):
    return c.take(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 25, "o_orderkey")


@R.add("SELECT key, value FROM (SELECT o_orderpriority AS key, CAST(o_orderkey AS VARCHAR) AS value FROM orders) ORDER BY key, value LIMIT 20")
def top6_pair_order(spark, sf):
    return c.take(_pairs(spark, sf, "orders", "o_orderpriority", "o_orderkey"), 20, "key", "value")


@R.add("SELECT '(' || r_name || ',' || CAST(r_regionkey AS VARCHAR) || ')' AS value FROM region")
def fmt1_pair_text(spark, sf):
    return c.pair_text(_pairs(spark, sf, "region", "r_name", "r_regionkey"))


@R.add("""
    SELECT n_nationkey || ' { ' || concat_ws(', ', 'n_name: ' || n_name, 'n_regionkey: ' || CAST(n_regionkey AS VARCHAR)) || ' }' AS value FROM nation""")
def fmt1_row_text(spark, sf):
    return store.row_text(load(spark, sf, "nation"), "n_nationkey")


@R.add("SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL")
def stream_visited(spark, sf):
    from webrank.streaming import crawlstream as s

    stream = s.read_stream(spark, f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return s.run_available(s.visited(stream, "user_id", "ts"), scratch(spark), "append")


@R.add("SELECT host, count(*) AS fetches, epoch_us(max(fetched_at)) AS last_us FROM crawl WHERE host IS NOT NULL GROUP BY host")
def stream_host_state(spark, sf):
    from webrank.streaming import crawlstream as s

    stream = s.read_stream(spark, f"{sf}/crawl.parquet").select("host", F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    rows = s.run_available(s.host_state(stream, "host", "fetched_at"), scratch(spark), "update")
    last = rows.groupBy("host").agg(F.max_by(F.struct("fetches", "last_access"), "batch").alias("x"))
    return last.select("host", "x.fetches", F.unix_micros("x.last_access").alias("last_us"))


@R.add("SELECT epoch_us(date_trunc('day', fetched_at)) AS start_us, count(*) AS fetches FROM crawl WHERE fetched_at IS NOT NULL GROUP BY 1")
def stream_fetch_windows(spark, sf):
    from webrank.streaming import crawlstream as s

    stream = s.read_stream(spark, f"{sf}/crawl.parquet").select(F.col("fetched_at").cast("timestamp").alias("fetched_at")).where("fetched_at is not null")
    rows = s.run_available(s.fetch_windows(stream, "fetched_at", "1 day", "1000 days"), scratch(spark), "update")
    last = rows.groupBy("start").agg(F.max_by("fetches", "batch").alias("fetches"))
    return last.select(F.unix_micros("start").alias("start_us"), "fetches")
