"""Finders with parameters, usage and summaries on the driver's tables, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmine.operators import boundaries, finders, history, metrics
from quillmine.plans.reference import quantities
from quillmine.plans.registry import query
from quillmine.sources.tables import load


@query("f1_library_rules", "SELECT p_partkey AS id, p_brand AS language, p_container AS scope, p_type FROM (SELECT *, p_size % 4 AS p_container FROM part) WHERE p_size > 5 AND p_brand = (SELECT min(p_brand) FROM part) AND list_contains(string_split(lower(p_type), ' '), (SELECT string_split(lower(min(p_type)), ' ')[1] FROM part))")
def _(spark, d):
    part = load(spark, d, "part")
    least = part.agg(F.min("p_brand").alias("brand"), F.min("p_type").alias("type")).first()
    rules = part.select(F.col("p_partkey").alias("id"), (F.col("p_size") > 5).alias("is_global"), F.col("p_brand").alias("language"), F.split("p_type", " ").alias("categories"), (F.col("p_size") % 4).alias("scope"), "p_type")
    return finders.library_rules(rules, least.brand, least.type.split(" ")[0].upper()).select("id", "language", "scope", "p_type")


NODES = "SELECT 's' || s_suppkey AS id, 'r' || s_nationkey AS repository, 'main' AS branch, 'file' AS type, 'n' || s_nationkey AS file_path FROM supplier UNION ALL SELECT 'p' || p_partkey, 'r' || p_size % 25, 'dev', 'class', p_brand FROM part"


def nodes_of(spark, d):
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    s = load(spark, d, "supplier").select(key("s", "s_suppkey").alias("id"), key("r", "s_nationkey").alias("repository"), F.lit("main").alias("branch"), F.lit("file").alias("type"), key("n", "s_nationkey").alias("file_path"))
    p = load(spark, d, "part").withColumn("r", F.col("p_size") % 25).select(key("p", "p_partkey").alias("id"), key("r", "r").alias("repository"), F.lit("dev").alias("branch"), F.lit("class").alias("type"), F.col("p_brand").alias("file_path"))
    return s.unionByName(p)


@query("f2_graph_nodes", f"SELECT * FROM ({NODES}) WHERE repository = 'r7' AND type IN ('class', 'function')")
def _(spark, d):
    return finders.graph_nodes(nodes_of(spark, d), repository="r7", types=["class", "function"])


@query("f3_graph_edges", f"WITH n AS ({NODES}), e AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target, CASE l_returnflag WHEN 'R' THEN 'CALLS' ELSE 'IMPORTS' END AS type FROM lineitem) SELECT * FROM e WHERE type = 'CALLS' AND (source IN (SELECT id FROM n WHERE file_path = 'n3') OR target IN (SELECT id FROM n WHERE file_path = 'n3'))")
def _(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "CALLS").otherwise("IMPORTS")
    e = load(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"), kind.alias("type"))
    return finders.graph_edges(e, nodes_of(spark, d), ["CALLS"], path="n3")


@query("f10_issue_search", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_size BETWEEN 5 AND 40 AND (contains(lower(p_name), '12') OR contains(lower(p_brand), '12') OR contains(CAST(p_partkey AS VARCHAR), '12') OR contains(lower(p_type), '12'))")
def _(spark, d):
    return finders.find(load(spark, d, "part"), between={"p_size": (5, 40)}, text=" 12 ", within=["p_name", "p_brand", "p_partkey", "p_type"]).select("p_partkey", "p_name", "p_brand")


@query("f11_audit_page_whole", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-01' AND user_id BETWEEN 10 AND 60 ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def _(spark, d):
    rows = finders.find(load(spark, d, "events"), {"event_type": "error"}, between={"ts": ("2024-01-01", None), "user_id": (10, 60)}, order=[F.desc("ts"), "event_id"], offset=40, limit=20)
    return rows.select("event_id", "user_id", "event_type")


@query("f12_touching_imports", "WITH i AS (SELECT l_suppkey AS source, l_partkey AS target, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT s_suppkey AS path FROM supplier WHERE s_acctbal < 0) SELECT * FROM i WHERE source IN (FROM p) OR target IN (FROM p)")
def _(spark, d):
    imports = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.count("*").alias("n"))
    return finders.touching(imports, load(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("path")))


@query("f17_review_list_whole", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('2-HIGH', '1-URGENT') AND (contains(CAST(o_orderkey AS VARCHAR), '77') OR contains(CAST(o_custkey AS VARCHAR), '77'))")
def _(spark, d):
    return finders.find(load(spark, d, "orders"), {"o_orderstatus": "F"}, {"o_orderpriority": ["2-HIGH", "1-URGENT"]}, text="77", within=["o_orderkey", "o_custkey"]).select("o_orderkey", "o_custkey")


@query("a1_usage_buckets", "SELECT l_returnflag, l_suppkey, count(*) AS records, sum(l_quantity) AS l_quantity FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-06-30' GROUP BY 1, 2")
def _(spark, d):
    return finders.usage_by(load(spark, d, "lineitem"), ["l_returnflag", "l_suppkey"], ["l_quantity"], "l_shipdate", "1994-01-01", "1996-06-30")


@query("a2_token_usage_whole", "SELECT l_suppkey, count(*) AS records, sum(l_quantity) AS l_quantity, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1")
def _(spark, d):
    return finders.usage_by(load(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity", "l_linenumber"], "l_shipdate", "1995-01-01", by="l_quantity")


@query("a17_feedback_whole", "SELECT user_id AS rule, count(*) AS total, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) % 3 IN (0, 1) GROUP BY 1")
def _(spark, d):
    level = (F.get_json_object("props", "$.k").cast("int") % 3).cast("string")
    rows = load(spark, d, "events").select(F.col("user_id").alias("rule"), F.col("event_type").alias("kind"), level.alias("severity"), F.lit("t").alias("team"))
    return finders.feedback_by_rule(rows, ["click", "error"], ["0", "1"], ["t", "u"])


@query("a8_ownership_summary_whole", """
WITH o AS (SELECT l_partkey AS file, l_suppkey AS c, sum(l_quantity) AS lines FROM lineitem GROUP BY 1, 2), e AS (SELECT *, floor(lines / sum(lines) OVER (PARTITION BY file) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS share FROM o),
f AS (SELECT file, count(*) AS n, max(share) AS top, sum(lines) AS lines, count(*) FILTER (share >= .5) AS p, count(*) FILTER (share < .5 AND share >= .2) AS s FROM e GROUP BY 1)
SELECT count(*) AS files, sum(lines) AS lines, CAST(sum(p) AS BIGINT) AS primary_owners, CAST(sum(s) AS BIGINT) AS secondary_owners, floor(avg(n) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS mean_owners, floor(avg(top) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS mean_top_share, (SELECT count(DISTINCT c) FROM e) AS contributors FROM f""")
def _(spark, d):
    return finders.ownership_summary(history.ownership(quantities(spark, d)))


@query("a13_scans_by_repository", "SELECT o_custkey AS repository, count(*) AS scans, CAST(sum(o_orderkey % 10) AS BIGINT) AS files, CAST(sum(o_orderkey % 7) AS BIGINT) AS nodes, CAST(sum(o_orderkey % 3) AS BIGINT) AS edges, floor(avg(o_totalprice) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS mean_duration, arg_min(o_orderkey, (-epoch_us(o_orderdate), o_orderkey)) AS latest FROM orders GROUP BY 1")
def _(spark, d):
    key = F.col("o_orderkey")
    return finders.scan_summary(load(spark, d, "orders").select(key.alias("id"), F.col("o_custkey").alias("repository"), (key % 10).alias("files"), (key % 7).alias("nodes"), (key % 3).alias("edges"), F.col("o_totalprice").alias("duration"), F.col("o_orderdate").alias("completed_at")))


@query("a15_heatmap_categories", """
WITH e AS (SELECT o_custkey AS path, o_orderstatus AS c, o_orderpriority AS s, CAST(o_orderkey % 3 AS DOUBLE) AS n FROM orders), s AS (SELECT path, string_agg(s || '=' || CAST(n AS INT), ',' ORDER BY s) AS severities FROM (SELECT path, s, sum(n) AS n FROM e GROUP BY 1, 2) GROUP BY 1), c AS (SELECT path, string_agg(c || '=' || n, ',' ORDER BY c) AS categories FROM (SELECT path, c, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1)
SELECT path, sum(n) AS total, severities, categories FROM e JOIN s USING (path) JOIN c USING (path) GROUP BY ALL""")
def _(spark, d):
    n = (F.col("o_orderkey") % 3).cast("double")
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("path"), n.alias("total"), F.create_map("o_orderpriority", n).alias("severities"), F.create_map("o_orderstatus", F.lit(1.0)).alias("categories"))
    told = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("int").cast("string"))), ",").alias(c)
    return finders.merged_heatmap(rows).select("path", "total", told("severities"), told("categories"))


@query("u3_issues_in_scope", """
WITH i AS (SELECT o_custkey AS id, o_orderkey, o_orderpriority AS source, substr(o_orderpriority, 3) AS severity, 'c' || o_orderkey % (SELECT count(*) FROM part) AS path, o_orderstatus AS kind FROM orders), s AS (SELECT 'c' || p_partkey AS path FROM part WHERE p_size > 10),
f AS (SELECT id, arg_min(source, o_orderkey) AS source, arg_min(severity, o_orderkey) AS severity, arg_min(path, o_orderkey) AS path, arg_min(kind, o_orderkey) AS kind FROM i WHERE path IN (FROM s) GROUP BY 1)
SELECT *, CASE severity WHEN 'URGENT' THEN 0 WHEN 'HIGH' THEN 1 ELSE 2 END AS rank FROM f ORDER BY rank, path, source, kind, id LIMIT 200""")
def _(spark, d):
    part = load(spark, d, "part")
    n = part.agg(F.count("*").alias("n"))  # one row
    path = F.concat(F.lit("c"), (F.col("o_orderkey") % F.col("n")).cast("string"))
    issues = load(spark, d, "orders").crossJoin(F.broadcast(n)).select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("source"), F.substr("o_orderpriority", F.lit(3)).alias("severity"), path.alias("path"), F.col("o_orderstatus").alias("kind"))
    scope = part.where("p_size > 10").select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("path"))
    return finders.issues_in_scope(issues, scope, ["URGENT", "HIGH"])


@query("o3_filtered_search", """
WITH v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM v),
s AS (SELECT q.id AS query_id, u.id, floor(list_dot_product(q.v, u.v) * 100000.0 + 0.5) / 100000.0 AS similarity FROM u q, u WHERE q.id % 20 = 0 AND u.label IN (1, 2)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM s)
SELECT query_id, id, similarity FROM r WHERE place <= 10""")
def _(spark, d):
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.struct("label").alias("metadata"), F.col("embedding").cast("array<double>").alias("v"))
    one = [rows.where(boundaries.metadata_filter({"metadata": {"label": k}})) for k in (1, 2)]
    return metrics.nearest_each(rows.where("id % 20 = 0").select("id", "v"), one[0].unionByName(one[1]).select("id", "v"), 10)
