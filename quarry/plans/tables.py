"""Queries that apply the generic operators to the relational, event, document and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import graph, joins, rank, search, text
from quarry.plans.catalog import register
from quarry.session import table
from quarry.streaming import windows

#: Marker words in order of precedence, with their kinds.
MARKERS = [("the", "article"), ("der", "article"), ("que", "relative"), ("and", "conjunction"), ("und", "conjunction")]
#: Order priorities with their rank and weight.
PRIORITIES = [("1-URGENT", 0, 10), ("2-HIGH", 1, 5), ("3-MEDIUM", 2, 3), ("4-NOT SPECIFIED", 3, 1), ("5-LOW", 4, 0)]


def _literal(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])))


@register("line_scan", "SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (trim(line) <> '')::BIGINT AS n_filled FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def line_scan(spark: SparkSession, d: str) -> DataFrame:
    return text.lines(table(spark, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.trim("line") != "").alias("n_filled"))


@register("line_range", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS part FROM documents")
def line_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.line_range("text", 2, 4).alias("part"))


@register("debt_markers", "SELECT kind, count(*)::BIGINT AS n FROM (SELECT CASE WHEN contains(line, 'the') THEN 'article' WHEN contains(line, 'der') THEN 'article' WHEN contains(line, 'que') THEN 'relative' WHEN contains(line, 'and') THEN 'conjunction' WHEN contains(line, 'und') THEN 'conjunction' END AS kind FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE kind IS NOT NULL GROUP BY kind")
def debt_markers(spark: SparkSession, d: str) -> DataFrame:
    found = text.lines(table(spark, d, "documents"), "doc_id", "text").select(text.first_match(F.col("line"), MARKERS).alias("kind"))
    return found.filter("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


@register("carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS purchase FROM events")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", rank.carried(F.when(F.col("event_type") == "purchase", F.col("event_id")), ["user_id"], ["ts", "event_id"]).alias("purchase"))


@register("section_bounds", """SELECT conv_id, turn AS start, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, key_end) AS "end" FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user') JOIN (SELECT conv_id, max(turn) AS key_end FROM conversations GROUP BY conv_id) USING (conv_id)""")
def section_bounds(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.bool_or(F.col("role") == "user").alias("opens"))
    return rank.sections(c, "conv_id", "turn", F.col("opens"))


@register("classify_first_match", "SELECT class, count(*)::BIGINT AS n FROM (SELECT CASE WHEN contains(url, 'utm_') THEN 'tracked' WHEN contains(url, '#') THEN 'fragment' WHEN contains(url, '?') THEN 'query' WHEN contains(url, '.html') THEN 'file' ELSE 'plain' END AS class FROM pages) GROUP BY class")
def classify_first_match(spark: SparkSession, d: str) -> DataFrame:
    rules = [("utm_", "tracked"), ("#", "fragment"), ("?", "query"), (".html", "file")]
    return table(spark, d, "pages").groupBy(text.first_match(F.col("url"), rules, "plain").alias("class")).agg(F.count("*").alias("n"))


@register("smell_counts", "SELECT event_type, user_id, count(*)::BIGINT AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())")
def smell_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupingSets([["event_type"], ["user_id"], []], "event_type", "user_id").agg(F.count("*").alias("n"))


@register("severity_join", "SELECT p AS priority, r AS rank, count(*)::BIGINT AS n, (count(*) * w)::BIGINT AS weight FROM orders JOIN (VALUES ('1-URGENT', 0, 10), ('2-HIGH', 1, 5), ('3-MEDIUM', 2, 3), ('4-NOT SPECIFIED', 3, 1), ('5-LOW', 4, 0)) v(p, r, w) ON o_orderpriority = p GROUP BY p, r, w")
def severity_join(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return n.join(_literal(spark, PRIORITIES, "priority", "rank", "w"), "priority").select("priority", "rank", "n", (F.col("n") * F.col("w")).alias("weight"))


@register("magic_numbers", "SELECT k, count(*)::BIGINT AS n FROM (SELECT try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events) WHERE k > 2 AND k NOT IN (10, 100) GROUP BY k")
def magic_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int").alias("k")
    return table(spark, d, "events").select(k).filter("k > 2 and k not in (10, 100)").groupBy("k").agg(F.count("*").alias("n"))


@register("counter_struct", "SELECT count(*) FILTER (l_returnflag = 'R')::BIGINT AS returned, count(*) FILTER (l_returnflag = 'A')::BIGINT AS accepted, count(*) FILTER (l_linestatus = 'O')::BIGINT AS open, count(*) FILTER (l_discount > 0.05)::BIGINT AS discounted FROM lineitem")
def counter_struct(spark: SparkSession, d: str) -> DataFrame:
    c = {"returned": F.col("l_returnflag") == "R", "accepted": F.col("l_returnflag") == "A", "open": F.col("l_linestatus") == "O", "discounted": F.col("l_discount") > 0.05}
    return table(spark, d, "lineitem").agg(*[F.count_if(x).alias(k) for k, x in c.items()])


@register("coverage_pct", "SELECT lang, count(*)::BIGINT AS n, round(100.0 * sum(quality) / count(*), 4)::DOUBLE AS pct FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang)")
def coverage_pct(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return j.rollup("lang").agg(F.count("*").alias("n"), F.round(F.lit(100.0) * F.sum("quality") / F.count("*"), 4).alias("pct"))


@register("first_wins", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return rank.first_per_key(table(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@register("last_wins", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    return rank.last_per_key(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@register("hotspots", "SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) FILTER (l_returnflag = 'R')::BIGINT AS returned, count(*)::BIGINT AS n_lines FROM lineitem GROUP BY l_suppkey HAVING count(*) FILTER (l_returnflag = 'R') >= 5 ORDER BY returned DESC, l_suppkey LIMIT 15")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count("*").alias("n_lines"))
    return rank.top(g.filter("returned >= 5"), 15, F.desc("returned"), F.col("l_suppkey"))


@register("file_rollup", "SELECT source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS n_chars, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source")
def file_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@register("cluster_rollup", "SELECT p_type, count(DISTINCT p_brand)::BIGINT AS brands, count(*)::BIGINT AS parts FROM part GROUP BY p_type HAVING count(DISTINCT p_brand) >= 2 AND count(*) >= greatest(1, count(DISTINCT p_brand) // 2)")
def cluster_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").groupBy("p_type").agg(F.count_distinct("p_brand").alias("brands"), F.count("*").alias("parts"))
    return g.filter("brands >= 2 and parts >= greatest(1, brands div 2)")


@register("health_score", "SELECT c_custkey, greatest(0, least(100, 100 - least(30, n * 2) - least(20, late * 5) - CASE WHEN c_acctbal < 0 THEN 25 ELSE 0 END))::BIGINT AS score FROM customer JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS late FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def health_score(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("late"))
    penalty = F.least(F.lit(30), F.col("n") * 2) + F.least(F.lit(20), F.col("late") * 5) + F.when(F.col("c_acctbal") < 0, 25).otherwise(0)
    return table(spark, d, "customer").join(o, "c_custkey").select("c_custkey", F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty)).cast("long").alias("score"))


@register("impact_bucket", "SELECT bucket, count(*)::BIGINT AS parts FROM (SELECT CASE WHEN n > 50 THEN 'critical' WHEN n > 20 THEN 'high' WHEN n > 5 THEN 'medium' ELSE 'low' END AS bucket FROM (SELECT p_partkey, count(l_orderkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey)) GROUP BY bucket")
def impact_bucket(spark: SparkSession, d: str) -> DataFrame:
    uses = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    bucket = F.when(n > 50, "critical").when(n > 20, "high").when(n > 5, "medium").otherwise("low")
    return table(spark, d, "part").join(uses, "p_partkey", "left").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("parts"))


@register("delta_baseline", "SELECT a AS before, b AS after, CASE WHEN abs(b - a) * 1.0 / a <= 0.1 THEN 'same' WHEN b > a THEN 'up' ELSE 'down' END AS trend FROM (SELECT count(*) FILTER (year(o_orderdate) < 1995)::BIGINT AS a, count(*) FILTER (year(o_orderdate) >= 1995)::BIGINT AS b FROM orders)")
def delta_baseline(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").agg(F.count_if(F.year("o_orderdate") < 1995).alias("before"), F.count_if(F.year("o_orderdate") >= 1995).alias("after"))
    a, b = F.col("before"), F.col("after")
    return n.select("before", "after", F.when(F.try_divide(F.abs(b - a), a) <= 0.1, "same").when(b > a, "up").otherwise("down").alias("trend"))


@register("nearest_rank", "SELECT event_type, s[1] AS least, s[len(s) // 2 + 1] AS p50, s[len(s) * 95 // 100 + 1] AS p95, s[len(s)] AS most FROM (SELECT event_type, list_sort(list(value)) AS s FROM events GROUP BY event_type)")
def nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return rank.nearest_ranks(table(spark, d, "events"), "event_type", "value", {"least": 0, "p50": 50, "p95": 95, "most": 100})


@register("ring_100", "SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS up FROM events) WHERE up > 5 ORDER BY ts DESC, event_id DESC LIMIT 100")
def ring_100(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "value", "ts")
    warm = e.orderBy("ts", "event_id").limit(5).select("event_id")
    return e.join(F.broadcast(warm), "event_id", "left_anti").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "value")


@register("queue_position", "SELECT event_id, row_number() OVER w AS place, coalesce(sum(value::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM (SELECT event_id, user_id, ts, floor(value)::BIGINT AS value FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def queue_position(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("work", F.floor("value").cast("long"))
    return e.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("place"), rank.work_ahead("work", ["user_id"], ["ts", "event_id"]).cast("long").alias("ahead"))


@register("dead_code", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def dead_code(spark: SparkSession, d: str) -> DataFrame:
    return joins.unused(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select(F.col("doc_id").alias("labelled")), "doc_id", "labelled")


@register("semi_join", "SELECT doc_id, lang FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@register("range_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY)")
def range_semi(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders").select("o_orderkey", "o_orderdate"), table(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    return joins.having_in_range(o, li, F.col("l_orderkey") == F.col("o_orderkey"), F.col("l_shipdate"), F.col("o_orderdate"), F.col("o_orderdate") + F.expr("interval 30 days")).select("o_orderkey")


@register("theta_contains", "SELECT w AS word, count(*)::BIGINT AS n FROM part, (VALUES ('a'), ('st'), ('ing'), ('x1'), ('art')) v(w) WHERE contains(p_name, w) GROUP BY w")
def theta_contains(spark: SparkSession, d: str) -> DataFrame:
    return joins.containing(table(spark, d, "part"), ["a", "st", "ing", "x1", "art"], "p_name").groupBy("word").agg(F.count("*").alias("n"))


@register("full_outer_diff", "WITH h AS (SELECT doc_id, substr(sha256(text), 1, 16) AS h FROM documents), o AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE h END AS h FROM h WHERE doc_id % 5 <> 0), n AS (SELECT * FROM h WHERE doc_id % 3 <> 0) SELECT doc_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM o FULL JOIN n USING (doc_id) WHERE o.h IS DISTINCT FROM n.h")
def full_outer_diff(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("h"))
    # two made-up snapshots of the same files: what the operator compares, not a cut of its input
    old = h.filter("doc_id % 5 <> 0").withColumn("h", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("h")))
    return joins.difference(old, h.filter("doc_id % 3 <> 0"), "doc_id", "h")


@register("self_join_parent", "SELECT a.conv_id, a.turn, b.role AS next_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def self_join_parent(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn").join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role")), ["conv_id", "turn"])


def _id_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))


_SETS = "SELECT doc_id AS id FROM documents {} SELECT vec_id FROM embeddings"


@register("set_union", _SETS.format("UNION"))
def set_union(spark: SparkSession, d: str) -> DataFrame:
    a, b = _id_sets(spark, d)
    return a.union(b).distinct()


@register("set_intersect", _SETS.format("INTERSECT"))
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = _id_sets(spark, d)
    return a.intersect(b)


@register("set_except", _SETS.format("EXCEPT"))
def set_except(spark: SparkSession, d: str) -> DataFrame:
    a, b = _id_sets(spark, d)
    return a.subtract(b)


@register("content_hash", "SELECT substr(sha256(text), 1, 16) AS hash, count(*)::BIGINT AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(text.content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@register("occurrence_count", "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM documents")
def occurrence_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.occurrences(F.col("text"), "the").alias("n"))


@register("identifier_sets", "SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+')), lambda x: x NOT IN ('The', 'Of', 'And')))::BIGINT AS n FROM documents")
def identifier_sets(spark: SparkSession, d: str) -> DataFrame:
    names = F.array_except(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))), F.array(*[F.lit(x) for x in ("The", "Of", "And")]))
    return table(spark, d, "documents").select("doc_id", F.size(names).cast("long").alias("n"))


@register("sanitize", "SELECT p_partkey, translate(p_name, '.<> -/', '______') AS name FROM part")
def sanitize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.sanitized(F.col("p_name")).alias("name"))


@register("camel_keywords", "SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(p_type, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z]+'), lambda x: length(x) >= 3), ' ') AS words FROM part")
def camel_keywords(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(text.camel_words(F.col("p_type")), " ").alias("words"))


@register("path_parts", "SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, list_last(string_split(url, '/')) AS leaf FROM pages")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), text.last_part("url").alias("leaf"))


@register("diag_parse", "SELECT event_id, event_type || '.src:' || user_id AS place, 'error' AS severity, 'value ' || floor(value)::BIGINT AS message FROM events WHERE event_type = 'error'")
def diag_parse(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat("event_type", F.lit(".src:"), "user_id", F.lit(": "), "event_type", F.lit(": value "), F.floor("value"))
    p = r"^([^:]+:\d+): (error|warning): (.*)$"
    out = table(spark, d, "events").select("event_id", *[F.regexp_extract(line, p, i).alias(n) for i, n in ((1, "place"), (2, "severity"), (3, "message"))])
    return out.filter("severity <> ''")


@register("embed_text", "SELECT p_partkey, p_name || chr(10) || 'Brand: ' || p_brand || chr(10) || 'Type: ' || p_type || chr(10) || 'Size: ' || p_size AS text FROM part")
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.concat_ws("\n", "p_name", F.concat(F.lit("Brand: "), "p_brand"), F.concat(F.lit("Type: "), "p_type"), F.concat(F.lit("Size: "), "p_size")).alias("text"))


_EDGES = "SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events"


def _event_edges(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).filter("dst is not null")


@register("call_edges", f"SELECT src, dst, count(*)::BIGINT AS weight FROM ({_EDGES}) WHERE dst IS NOT NULL GROUP BY src, dst")
def call_edges(spark: SparkSession, d: str) -> DataFrame:
    return _event_edges(spark, d).groupBy("src", "dst").agg(F.count("*").alias("weight"))


_TRADE = "SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


@register("degree_metrics", f"WITH e AS ({_TRADE}) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node")
def degree_metrics(spark: SparkSession, d: str) -> DataFrame:
    # pairs are made distinct as soon as a key is known by its nation, before the next join
    nation = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    o = table(spark, d, "orders").join(nation, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "dst")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey").join(s, "l_suppkey").select("src", "l_orderkey")
    return graph.degrees(li.join(o, "l_orderkey").select("src", "dst").distinct())


def _geo_edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return n.select(F.col("r_name").alias("src"), F.col("n_name").alias("dst")).unionByName(s.select(F.col("n_name").alias("src"), F.col("s_name").alias("dst")))


_GEO = "SELECT r_name AS src, n_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@register("trace_bfs", f"WITH RECURSIVE e AS ({_GEO}), t(node, depth) AS (SELECT 'ASIA', 0 UNION SELECT dst, depth + 1 FROM t JOIN e ON node = src WHERE depth < 3) SELECT node, min(depth)::INT AS depth FROM t GROUP BY node")
def trace_bfs(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(_geo_edges(spark, d), graph.one(spark, "ASIA"), 3)


@register("simple_paths", f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({_EDGES}) WHERE dst IS NOT NULL), t(node, path, n) AS (SELECT 'click', ['click'], 1 UNION ALL SELECT dst, list_append(path, dst), n + 1 FROM t JOIN e ON node = src WHERE n < 4 AND node <> 'purchase' AND NOT list_contains(path, dst)) SELECT array_to_string(path, '>') AS path, (n - 1)::BIGINT AS length FROM t WHERE node = 'purchase'")
def simple_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.simple_paths(_event_edges(spark, d), "click", "purchase", 4)


@register("inherit_chain", "WITH RECURSIVE p AS (SELECT doc_id AS child, doc_id // 2 AS parent FROM documents WHERE doc_id > 0), t(child, ancestor, depth) AS (SELECT child, parent, 1 FROM p UNION ALL SELECT t.child, p.parent, depth + 1 FROM t JOIN p ON ancestor = p.child) SELECT DISTINCT child, ancestor, depth::INT AS depth FROM t")
def inherit_chain(spark: SparkSession, d: str) -> DataFrame:
    return graph.ancestors(table(spark, d, "documents").filter("doc_id > 0").select(F.col("doc_id").alias("child"), F.expr("doc_id div 2").alias("parent")))


_PAIRS = "SELECT q.vec_id AS query, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0"
_RANKED = "SELECT query, vec_id, score FROM ({}) QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= {}"


def _queries(e: DataFrame) -> DataFrame:
    return e.filter("vec_id % 100 = 0")


@register("knn", _RANKED.format(_PAIRS, 10))
def knn(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return search.knn_many(e, _queries(e), "vec_id", "embedding", 10)


@register("similar_to", _RANKED.format(_PAIRS + " AND q.vec_id <> e.vec_id", 10))
def similar_to(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return search.knn_many(e, _queries(e), "vec_id", "embedding", 10, itself=False)


@register("l2_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 4) AS total FROM embeddings")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(search.normalized(F.col("embedding")), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


_NEAR = _RANKED.format(_PAIRS, 100)


@register("hybrid", _RANKED.format(f"SELECT query, vec_id, round(CASE WHEN contains(text, 'tion') THEN least(score + 0.2, 1.0) ELSE score END, 6) AS score FROM ({_NEAR}) JOIN documents ON doc_id = vec_id", 10))
def hybrid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    near = search.knn_many(e, _queries(e), "vec_id", "embedding", 100)
    j = near.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").contains("tion").cast("int").alias("hit")), "vec_id")
    return rank.top_per_key(j.select("query", "vec_id", F.round(search.boosted(F.col("score"), F.col("hit")), 6).alias("score")), ["query"], 10, F.desc("score"), F.col("vec_id"))


@register("pattern_only", "SELECT doc_id, CASE WHEN regexp_matches(text, 'th[a-z]+ing') THEN 0.7 ELSE 0.5 END::DOUBLE AS score FROM documents")
def pattern_only(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", search.boosted(F.lit(0.5), F.col("text").rlike("th[a-z]+ing").cast("int")).alias("score"))


@register("upsert", "SELECT doc_id, quality, 9 AS toxic FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, quality, toxic FROM labels l WHERE NOT EXISTS (SELECT 1 FROM labels c WHERE c.quality = 0 AND c.doc_id = l.doc_id)")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return joins.upsert(base, base.filter("quality = 0").withColumn("toxic", F.lit(9)), "doc_id")


@register("debounce_sessions", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*)::BIGINT AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    return windows.sessions(table(spark, d, "events"), "ts", "30 minutes", "user_id")


@register("tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def tumbling(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(table(spark, d, "events"), "ts", "1 hour", "event_type")


@register("sliding", "SELECT strftime(date_trunc('hour', ts) - k * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_start, count(*)::BIGINT AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL")
def sliding(spark: SparkSession, d: str) -> DataFrame:
    return windows.tumbling(table(spark, d, "events"), "ts", "2 hours", slide="1 hour")


@register("stream_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*)::BIGINT AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return windows.stream_tumbling(spark, f"{d}/events.parquet", "ts", "1 hour", "10 minutes", "event_type")
