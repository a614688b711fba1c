"""Queries of the survey's inventory on the driver's tables, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmine.functions import scalars as X
from quillmine.operators import history, metrics
from quillmine.plans.registry import query
from quillmine.sources.tables import load

AS_OF = "1998-01-01"
R = lambda x, k="1e4": f"floor(({x}) * {k} + 0.5) / {k}"


def changes(spark, d):
    """Orders as commits, parts as files, suppliers as contributors."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_shipdate")
    return lines.toDF("commit", "file", "contributor", "added", "deleted", "at")


def quantities(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("contributor"), F.col("l_quantity").alias("lines"))


def authored(spark, d):
    return load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("file"), F.col("event_type").alias("author"), F.col("ts").alias("at"))


COUPLING = f"""
WITH b AS (SELECT l_orderkey AS c, l_partkey AS f, max(l_shipdate) AS at FROM lineitem GROUP BY ALL),
n AS (SELECT f, count(*) AS n FROM b GROUP BY f),
p AS (SELECT x.f AS l, y.f AS r, count(*) AS shared, max(x.at) AS last_at FROM b x JOIN b y ON x.c = y.c AND x.f < y.f GROUP BY ALL)
SELECT p.l AS "left", p.r AS "right", shared, {R("shared / (a.n + z.n - shared)", "10000.0")} AS strength, last_at
FROM p JOIN n a ON a.f = p.l JOIN n z ON z.f = p.r"""


@query("a6_temporal_coupling", COUPLING)
def _(spark, d):
    return history.temporal_coupling(changes(spark, d))


@query("w10_normalized_coupling", f'WITH t AS ({COUPLING}) SELECT "left", "right", {R("strength / (SELECT max(strength) FROM t)", "10000.0")} AS weight FROM t')
def _(spark, d):
    return history.normalized_coupling(history.temporal_coupling(changes(spark, d)))


@query("a4_churn", f"SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS churn FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND TIMESTAMP '{AS_OF}' GROUP BY 1")
def _(spark, d):
    return history.churn(changes(spark, d), AS_OF, 365)


@query("a5_contributors", f"SELECT l_suppkey AS contributor, count(DISTINCT l_orderkey) AS commits, count(DISTINCT l_partkey) AS files, {R('sum(l_quantity)', '10000.0')} AS additions, {R('sum(l_tax)', '10000.0')} AS deletions, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at FROM lineitem GROUP BY 1")
def _(spark, d):
    return history.contributors(changes(spark, d))


OWN = "SELECT l_partkey AS file, l_suppkey AS contributor, sum(l_quantity) AS lines FROM lineitem GROUP BY ALL"


@query("a7_ownership", f"WITH o AS (SELECT *, lines / sum(lines) OVER (PARTITION BY file) AS e FROM ({OWN})) SELECT file, contributor, lines, {R('e', '10000.0')} AS share, CASE WHEN e >= .5 THEN 'primary' WHEN e >= .2 THEN 'secondary' ELSE 'minor' END AS role FROM o")
def _(spark, d):
    return history.ownership(quantities(spark, d))


@query("a9_bus_factor", f"WITH o AS (SELECT file, sum(lines) OVER (PARTITION BY file ORDER BY lines DESC, contributor ROWS UNBOUNDED PRECEDING) - lines AS b, sum(lines) OVER (PARTITION BY file) AS t FROM ({OWN})) SELECT file, CAST(count(*) FILTER (b < 0.8::DOUBLE * t) AS BIGINT) AS bus_factor FROM o GROUP BY 1")
def _(spark, d):
    return history.bus_factor(quantities(spark, d))


@query("w2_churn_trend", f"""
WITH m AS (SELECT l_partkey AS file, date_trunc('month', l_shipdate) AS "at", sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
w AS (SELECT file, avg(value) OVER (PARTITION BY file ORDER BY "at" ROWS 2 PRECEDING) AS s, avg(value) OVER (PARTITION BY file ORDER BY "at" ROWS 7 PRECEDING) AS l, row_number() OVER (PARTITION BY file ORDER BY "at" DESC) AS n FROM m),
r AS (SELECT *, {R("CASE WHEN l = 0 THEN 0 ELSE (s - l) / l END", "10000.0")} AS ratio FROM w WHERE n = 1)
SELECT file, {R("s", "10000.0")} AS short_mean, {R("l", "10000.0")} AS long_mean, ratio, CASE WHEN ratio > .15 THEN 'ACCELERATING' WHEN ratio < -.15 THEN 'DECELERATING' ELSE 'STABLE' END AS direction FROM r""")
def _(spark, d):
    lines = load(spark, d, "lineitem")
    return history.trend(lines.groupBy(F.col("l_partkey").alias("file"), F.date_trunc("month", "l_shipdate").alias("at")).agg(F.sum("l_quantity").alias("value")))


@query("w4_cumulative_share", f"""
WITH e AS (SELECT event_id AS id, user_id AS file, event_type AS author, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total,
count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS own FROM events) SELECT *, {R("own / total", "10000.0")} AS share FROM e""")
def _(spark, d):
    return history.cumulative_share(authored(spark, d))


@query("w5_handoffs", "WITH e AS (SELECT user_id AS file, event_type AS to_author, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_author FROM events) SELECT file, from_author, to_author, count(*) AS handoffs FROM e WHERE from_author <> to_author GROUP BY ALL")
def _(spark, d):
    return history.handoffs(authored(spark, d))


@query("w6_ownership_periods", """
WITH e AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new FROM events),
p AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS period FROM e)
SELECT user_id AS file, period, event_type AS author, count(*) AS changes, min(ts) AS from_at, max(ts) AS to_at FROM p GROUP BY ALL""")
def _(spark, d):
    return history.periods(authored(spark, d))


@query("a11_complexity_churn", f"""
WITH f AS (SELECT CAST(p_size AS DOUBLE) AS c, CAST(coalesce(n, 0) AS DOUBLE) AS h FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey),
a AS (SELECT count(*) AS files, corr(c, h) AS r, quantile_cont(c, .75) AS qc, quantile_cont(h, .75) AS qh FROM f)
SELECT files, {R("r", "10000.0")} AS correlation, {R("qc", "10000.0")} AS complexity_threshold, {R("qh", "10000.0")} AS churn_threshold, (SELECT count(*) FROM f WHERE c >= qc AND h >= qh) AS hotspots,
CASE WHEN abs(r) >= .7 THEN 'STRONG' WHEN abs(r) >= .4 THEN 'MODERATE' WHEN abs(r) >= .2 THEN 'WEAK' ELSE 'NONE' END AS strength FROM a""")
def _(spark, d):
    churned = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n"))
    files = load(spark, d, "part").join(churned, F.col("l_partkey") == F.col("p_partkey"), "left")
    return metrics.correlate(files.select(F.col("p_size").cast("double").alias("complexity"), F.coalesce("n", F.lit(0)).cast("double").alias("churn")))


@query("a12_drift", f"SELECT p_brand AS module, count(*) AS imports, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS violations, {R('''sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*)''', '1000000.0')} AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def _(spark, d):
    rows = load(spark, d, "lineitem").join(load(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return metrics.drift(rows.select(F.col("p_brand").alias("module"), (F.col("l_returnflag") == "R").cast("long").alias("violation")))


@query("a13_scan_summary", "SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources, max(doc_id) AS last_id FROM documents GROUP BY 1")
def _(spark, d):
    return load(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"), F.max("doc_id").alias("last_id"))


LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("a14_issue_summary", "SELECT o_orderstatus AS source, count(*) AS total, " + ", ".join(f"CAST(count(*) FILTER (o_orderpriority = '{s}') AS BIGINT) AS s_{s[0]}" for s in LEVELS) + ", count(DISTINCT o_custkey) AS files FROM orders GROUP BY 1")
def _(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("severity"), F.col("o_custkey").alias("file"))
    return metrics.issue_summary(rows, LEVELS)


@query("a18_rule_effectiveness", f"""
WITH e AS (SELECT event_type AS rule, pow(.5::DOUBLE, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 3.6e9::DOUBLE / 168) AS w, CASE WHEN value > 50 THEN 1 ELSE 0 END AS p FROM events)
SELECT rule, count(*) AS n, {R("sum(w)", "1000.0")} AS weight, {R("sum(w * p) / sum(w)", "1000000.0")} AS rate FROM e GROUP BY 1""")
def _(spark, d):
    events = load(spark, d, "events")
    last = events.agg(F.max("ts").alias("as_of"))
    return metrics.decayed_rates(events.crossJoin(F.broadcast(last)).select(F.col("event_type").alias("rule"), F.col("ts").alias("at"), "as_of", (F.col("value") > 50).cast("int").alias("positive")))


@query("a25_ranges", "SELECT min(p_size) AS min_size, max(p_size) AS max_size, min(p_retailprice) AS min_price, max(p_retailprice) AS max_price, count(*) AS files FROM part")
def _(spark, d):
    return load(spark, d, "part").agg(F.min("p_size").alias("min_size"), F.max("p_size").alias("max_size"), F.min("p_retailprice").alias("min_price"), F.max("p_retailprice").alias("max_price"), F.count("*").alias("files"))


@query("a29_confusion", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def _(spark, d):
    return load(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("w1_keep_highest", "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) = 1 AS kept FROM documents")
def _(spark, d):
    return metrics.keep_first_of(load(spark, d, "documents").select("doc_id", "text", "n_chars"), "text", "n_chars", "doc_id").select("doc_id", "kept")


@query("w7_priority_rank", "SELECT o_custkey, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def _(spark, d):
    return metrics.top_per(load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey", ["o_orderpriority", "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@query("w9_impact_level", "SELECT o_custkey AS file, min(o_orderpriority) AS level FROM orders GROUP BY 1")
def _(spark, d):
    return load(spark, d, "orders").groupBy(F.col("o_custkey").alias("file")).agg(F.min("o_orderpriority").alias("level"))


@query("j1_file_metrics", "SELECT p_partkey AS file, coalesce(q, 0) AS churn, coalesce(n, 0) AS issues FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def _(spark, d):
    per = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.sum((F.col("l_returnflag") == "R").cast("long")).alias("n"))
    return load(spark, d, "part").join(per, F.col("l_partkey") == F.col("p_partkey"), "left").select(F.col("p_partkey").alias("file"), F.coalesce("q", F.lit(0.0)).alias("churn"), F.coalesce("n", F.lit(0)).alias("issues"))


@query("j3_snapshot_diff", f"""
WITH b AS (SELECT l_partkey AS file, sum(l_quantity) AS before FROM lineitem WHERE l_shipdate < TIMESTAMP '{AS_OF}' GROUP BY 1), a AS (SELECT l_partkey AS file, sum(l_quantity) AS after FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1),
j AS (SELECT coalesce(b.file, a.file) AS file, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN before <> after THEN 'changed' ELSE 'same' END AS state, after - before AS delta FROM b FULL JOIN a ON a.file = b.file)
SELECT * FROM j WHERE state <> 'same'""")
def _(spark, d):
    lines = load(spark, d, "lineitem").withColumnRenamed("l_partkey", "file")
    sums = lambda rows: rows.groupBy("file").agg(F.sum("l_quantity").alias("q"))
    return metrics.full_diff(sums(lines.where(F.col("l_shipdate") < F.lit(AS_OF).cast("timestamp"))), sums(lines.where("l_returnflag <> 'R'")), "file", "q")


@query("u2_edge_difference", "SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem WHERE l_linestatus = 'O' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'")
def _(spark, d):
    edges = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), "l_linestatus")
    return edges.where("l_linestatus = 'O'").drop("l_linestatus").subtract(edges.where("l_linestatus = 'F'").drop("l_linestatus"))


@query("u5_relation_types", "SELECT DISTINCT event_type FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_type").distinct()


@query("x2_normalized_text", r"SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')))) AS digest FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(X.normalized_text(F.col("text")), 256).alias("digest"))


@query("x19_district", r"SELECT page_id, CASE WHEN instr(p, '/') > 0 THEN regexp_extract(p, '^(.*)/[^/]*$', 1) ELSE 'root' END AS district, regexp_extract(p, '([^/]*)$', 1) AS name FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*/?', '') AS p FROM pages)")
def _(spark, d):
    path = X.path_of(F.col("url"))
    return load(spark, d, "pages").select("page_id", X.district(path).alias("district"), X.file_name(path).alias("name"))


@query("x29_backoff", "SELECT event_id, least(30000.0::DOUBLE, 100.0::DOUBLE * pow(2.0::DOUBLE, greatest(0, event_id % 12 - 1))) AS wait_ms FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", X.backoff(F.lit(100.0), 30000.0, F.col("event_id") % 12).alias("wait_ms"))


@query("f8_glob_filter", f"SELECT page_id FROM pages WHERE regexp_matches(url, '{X.glob_pattern('http*://**/*1*')}')")
def _(spark, d):
    return load(spark, d, "pages").where(F.col("url").rlike(X.glob_pattern("http*://**/*1*"))).select("page_id")


@query("o3_vector_search", f"""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, {R("greatest(-1, least(1, list_dot_product(CAST(embedding AS DOUBLE[]), q) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))))", "1000000.0")} AS similarity
FROM embeddings, q ORDER BY similarity DESC, id LIMIT 10""")
def _(spark, d):
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return metrics.nearest(rows, rows.where("id = 0").select(F.col("v").alias("q")), 10)
