"""Filters, joins, aggregates, graphs and scalars of the survey on the driver's tables, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmine.functions.scalars import min_max, path_of, rounded
from quillmine.operators import graphs, relations
from quillmine.plans.registry import query
from quillmine.sources.tables import load

CUT = "1998-01-01"
R = lambda x, k="10000.0": f"floor(({x}) * {k} + 0.5) / {k}"


@query("f1_rule_filter", "SELECT p_partkey, p_brand, p_type FROM part WHERE lower(p_type) = 'economy' AND p_size <= 10")
def _(spark, d):
    return load(spark, d, "part").where((F.lower("p_type") == "economy") & (F.col("p_size") <= 10)).select("p_partkey", "p_brand", "p_type")


@query("f2_node_filter", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 2, 3)")
def _(spark, d):
    return load(spark, d, "supplier").where(F.col("s_nationkey").isin(1, 2, 3)).select("s_suppkey", "s_name")


@query("f3_edge_filter", "SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE p_type = 'ECONOMY' AND s_nationkey < 5")
def _(spark, d):
    part = load(spark, d, "part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("target"))
    supplier = load(spark, d, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("source"))
    edges = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    return edges.join(supplier, "source", "left_semi").join(part, "target", "left_semi").select("source", "target").distinct()


@query("f4_metadata_filter", "SELECT vec_id FROM embeddings WHERE label IN (1, 3) OR label IS NULL")
def _(spark, d):
    return load(spark, d, "embeddings").where(F.col("label").isin(1, 3) | F.col("label").isNull()).select("vec_id")


@query("f5_severity_cap", "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 25 AS kept FROM orders")
def _(spark, d):
    return relations.first_per_severity(load(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 25)


@query("f9_line_matches", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
m AS (SELECT doc_id, line, regexp_extract_all(body, '[0-9]{4,}') AS found FROM l)
SELECT doc_id AS id, CAST(line AS INT) AS line, CAST(generate_subscripts(found, 1) AS INT) AS nth, unnest(found) AS match FROM m""")
def _(spark, d):
    return relations.line_matches(load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "[0-9]{4,}")


@query("f10_search", "SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')) AND p_size > 20")
def _(spark, d):
    hit = F.lower("p_name").contains("ring") | F.lower("p_brand").contains("ring")
    return load(spark, d, "part").where(hit & (F.col("p_size") > 20)).select("p_partkey", "p_name")


@query("f11_audit_page", "SELECT event_id, event_type FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20")
def _(spark, d):
    rows = load(spark, d, "events").where("event_type = 'click'").orderBy(F.desc("ts"), "event_id")
    return rows.offset(20).limit(20).select("event_id", "event_type")


@query("f12_import_subset", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (1, 2) OR l_partkey IN (5, 6, 7)")
def _(spark, d):
    return load(spark, d, "lineitem").where(F.col("l_suppkey").isin(1, 2) | F.col("l_partkey").isin(5, 6, 7)).select("l_orderkey", "l_linenumber")


@query("a1_usage_by_brand", f"SELECT p_brand AS brand, count(*) AS n, {R('sum(l_extendedprice)')} AS cost FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_shipdate BETWEEN TIMESTAMP '{CUT}' AND TIMESTAMP '2000-01-01' GROUP BY 1")
def _(spark, d):
    rows = load(spark, d, "lineitem").where(F.col("l_shipdate").between(F.lit(CUT).cast("timestamp"), F.lit("2000-01-01").cast("timestamp")))
    per = rows.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("c"))
    return per.join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("brand")).agg(F.sum("n").alias("n"), rounded(F.sum("c")).alias("cost"))


@query("a2_token_usage", f"SELECT l_suppkey AS key, {R('sum(l_quantity)')} AS quantity, {R('sum(l_extendedprice)')} AS total FROM lineitem GROUP BY 1")
def _(spark, d):
    return load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(rounded(F.sum("l_quantity")).alias("quantity"), rounded(F.sum("l_extendedprice")).alias("total"))


@query("a8_ownership_summary", "SELECT count(DISTINCT l_partkey) AS files, count(DISTINCT l_suppkey) AS owners, CAST(sum(l_quantity) AS BIGINT) AS lines FROM lineitem")
def _(spark, d):
    return load(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("files"), F.countDistinct("l_suppkey").alias("owners"), F.sum("l_quantity").cast("long").alias("lines"))


@query("a16_rollup", f"SELECT r_name AS region, n_name AS nation, count(*) AS files, {R('sum(s_acctbal)')} AS total FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def _(spark, d):
    rows = load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(load(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("files"), rounded(F.sum("s_acctbal")).alias("total"))


@query("a17_feedback", "SELECT event_type AS rule, count(*) AS n, count(*) FILTER (value > 50) AS accepted, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(spark, d):
    return load(spark, d, "events").groupBy(F.col("event_type").alias("rule")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("accepted"), F.countDistinct("user_id").alias("users"))


@query("a19_false_positives", f"WITH r AS (SELECT user_id AS rule, count(*) AS n, count(*) FILTER (event_type = 'error') / count(*) AS e FROM events GROUP BY 1) SELECT rule, n, {R('e', '1000000.0')} AS rate, e >= .7 AND n >= 10 AS deactivate FROM r WHERE n >= 5 AND e > .1")
def _(spark, d):
    rate = F.count_if(F.col("event_type") == "error") / F.count("*")
    rows = load(spark, d, "events").groupBy(F.col("user_id").alias("rule")).agg(F.count("*").alias("n"), rate.alias("e"))
    return rows.where("n >= 5 and e > 0.1").select("rule", "n", rounded(F.col("e"), 6).alias("rate"), ((F.col("e") >= 0.7) & (F.col("n") >= 10)).alias("deactivate"))


@query("a20_team_patterns", f"WITH r AS (SELECT user_id AS rule, count(*) AS n, (count(*) FILTER (event_type = 'click') - count(*) FILTER (event_type = 'error')) / count(*) AS s FROM events GROUP BY 1) SELECT rule, {R('greatest(-1, least(1, s))', '1000000.0')} AS score, {R('least(1, n / 250)', '1000000.0')} AS confidence FROM r")
def _(spark, d):
    score = (F.count_if(F.col("event_type") == "click") - F.count_if(F.col("event_type") == "error")) / F.count("*")
    rows = load(spark, d, "events").groupBy(F.col("user_id").alias("rule")).agg(score.alias("s"), F.count("*").alias("n"))
    return rows.select("rule", rounded(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s"))), 6).alias("score"), rounded(F.least(F.lit(1.0), F.col("n") / 250), 6).alias("confidence"))


def edges_of(spark, d):
    return load(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), "l_quantity", "l_linestatus", "l_linenumber")


EDGES = "SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem"


@query("a23_degrees", f"SELECT node, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(1 - o) AS BIGINT) AS incoming, count(*) AS total FROM (SELECT source AS node, 1 AS o FROM ({EDGES}) UNION ALL SELECT target, 0 FROM ({EDGES})) GROUP BY 1")
def _(spark, d):
    return graphs.degrees(edges_of(spark, d).select("source", "target").distinct())


@query("a24_fan_patterns", f"SELECT target AS node, count(*) AS fan_in FROM ({EDGES}) GROUP BY 1 HAVING count(*) >= 3")
def _(spark, d):
    return edges_of(spark, d).groupBy(F.col("target").alias("node")).agg(F.countDistinct("source").alias("fan_in")).where("fan_in >= 3")


LINKS = "SELECT source, target FROM (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem WHERE l_linenumber % 2 = 1 UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem WHERE l_linenumber % 2 = 0)"


def links_of(spark, d):
    """All lines as edges: odd ones from supplier to part, even ones back."""
    e = edges_of(spark, d)
    back = e.where("l_linenumber % 2 = 0").select(F.col("target").alias("source"), F.col("source").alias("target"))
    return e.where("l_linenumber % 2 = 1").select("source", "target").unionByName(back).distinct()


def _rank_sql(iterations: int = 20) -> str:
    steps = [f"""r{i + 1} AS MATERIALIZED (SELECT n.node, n.degree, (1 - .85::DOUBLE) / c.n + .85::DOUBLE * (coalesce(g.gain, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE degree = 0) / c.n) AS rank
FROM n, c LEFT JOIN (SELECT target, sum(rank / degree) AS gain FROM e JOIN r{i} ON node = source GROUP BY 1) g ON g.target = n.node)""" for i in range(iterations)]
    return f"""WITH e AS MATERIALIZED ({LINKS}), v AS (SELECT source AS node FROM e UNION SELECT target FROM e),
n AS MATERIALIZED (SELECT node, coalesce(k, 0) AS degree FROM v LEFT JOIN (SELECT source, count(*) AS k FROM e GROUP BY 1) ON source = node), c AS MATERIALIZED (SELECT count(*) AS n FROM n),
r0 AS (SELECT node, degree, 1.0::DOUBLE / c.n AS rank FROM n, c), {", ".join(steps).replace("FROM n, c LEFT JOIN", "FROM n CROSS JOIN c LEFT JOIN")}
SELECT node, {R("rank", "100000000.0")} AS rank FROM r{iterations}"""


@query("g1_page_rank", _rank_sql())
def _(spark, d):
    return graphs.page_rank(links_of(spark, d)).select("node", rounded(F.col("rank"), 8).alias("rank"))


@query("g4_impact_radius", f"WITH RECURSIVE e AS MATERIALIZED ({LINKS}), w(node, distance) AS (SELECT 's1', 0 UNION SELECT e.target, distance + 1 FROM w JOIN e ON e.source = w.node WHERE distance < 4) SELECT node, CAST(min(distance) AS INT) AS distance FROM w GROUP BY 1")
def _(spark, d):
    return graphs.reached(links_of(spark, d), spark.createDataFrame([("s1",)], "node string"), 4)


@query("g9_reachable", f"WITH RECURSIVE e AS MATERIALIZED (SELECT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem), w(node) AS (SELECT 's1' UNION SELECT e.b FROM w JOIN e ON e.a = w.node) SELECT node FROM w")
def _(spark, d):
    e = edges_of(spark, d).select("source", "target")
    return graphs.reached(e, spark.createDataFrame([("s1",)], "node string"), both=True).select("node")


TREE = "SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation"


def tree_of(spark, d):
    """Edges from customers to nations, and between nations and regions both ways."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    c = load(spark, d, "customer").select(name("c", "c_custkey").alias("source"), name("n", "c_nationkey").alias("target"))
    up = load(spark, d, "nation").select(name("n", "n_nationkey").alias("source"), name("r", "n_regionkey").alias("target"))
    return c.unionByName(up).unionByName(up.select(F.col("target").alias("source"), F.col("source").alias("target")))


def customers_of(spark, d):
    return load(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))


PATHS = f"WITH RECURSIVE e AS MATERIALIZED ({TREE}), w(path, steps) AS (SELECT ['c' || c_custkey], 0 FROM customer UNION ALL SELECT list_append(path, e.target), steps + 1 FROM w JOIN e ON e.source = path[-1] AND NOT list_contains(path, e.target) WHERE steps < 5)"


@query("g6_simple_paths", f"{PATHS} SELECT array_to_string(path, '>') AS path, CAST(steps AS INT) AS steps FROM w WHERE steps > 0")
def _(spark, d):
    found = graphs.simple_paths(tree_of(spark, d), customers_of(spark, d), 5)
    return found.select(F.array_join("path", ">").alias("path"), "steps")


@query("g8_call_chains", f"{PATHS} SELECT array_to_string(path, '>') AS path, CAST(steps AS INT) AS steps FROM w WHERE steps = 5 OR NOT EXISTS (SELECT 1 FROM e WHERE e.source = path[-1] AND NOT list_contains(path, e.target))")
def _(spark, d):
    found = graphs.simple_paths(tree_of(spark, d), customers_of(spark, d), 5, complete=True)
    return found.select(F.array_join("path", ">").alias("path"), "steps")


@query("j4_graph_diff", """
WITH b AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem WHERE l_linestatus = 'F'), a AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem WHERE l_linestatus = 'O')
SELECT *, 'added' AS state FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'removed' FROM (FROM b EXCEPT FROM a)""")
def _(spark, d):
    e = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), "l_linestatus")
    return graphs.edge_diff(e.where("l_linestatus = 'F'"), e.where("l_linestatus = 'O'"))


@query("j5_tightest_container", """
WITH f AS (SELECT p_partkey AS function, p_partkey % 50 AS file, p_size AS first, p_size + p_partkey % 13 AS last FROM part)
SELECT event_id AS id, function, CAST(last - first AS BIGINT) AS span FROM events JOIN f ON file = user_id % 50 AND floor(value) BETWEEN first AND last
QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY last - first, first, function) = 1""")
def _(spark, d):
    calls = load(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("file"), F.floor("value").alias("line"))
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    functions = load(spark, d, "part").select(key.alias("function"), (key % 50).alias("file"), size.alias("first"), (size + key % 13).alias("last"))
    return relations.tightest_container(calls, functions)


@query("j7_import_resolution", """
WITH c AS (SELECT c_custkey AS id, unnest([c_custkey * 3, c_custkey * 2, c_custkey + 7]) AS target, unnest([0, 1, 2]) AS pos FROM customer)
SELECT id, CAST(min(pos) AS INT) AS pos, arg_min(target, pos) AS target FROM c SEMI JOIN part ON p_partkey = target GROUP BY 1""")
def _(spark, d):
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    k = F.col("id")
    return relations.first_existing(rows, F.array(k * 3, k * 2, k + 7), load(spark, d, "part").select(F.col("p_partkey").alias("target")))


@query("j10_shared_symbols", """
WITH u AS (SELECT DISTINCT l_suppkey AS repo, l_partkey AS symbol FROM lineitem)
SELECT a.repo AS "left", b.repo AS "right", count(*) AS shared, min(a.symbol) AS symbol FROM u a JOIN u b ON a.symbol = b.symbol AND a.repo < b.repo GROUP BY ALL HAVING count(*) >= 3""")
def _(spark, d):
    return relations.shared_symbols(load(spark, d, "lineitem").select(F.col("l_suppkey").alias("repo"), F.col("l_partkey").alias("symbol")), 3)


@query("j11_layer_policy", """
WITH t AS (SELECT c.c_nationkey AS a, s.s_nationkey AS b, count(*) AS n FROM lineitem JOIN supplier s ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer c ON c_custkey = o_custkey GROUP BY ALL)
SELECT a, b, n, CASE WHEN (x.n_regionkey + y.n_regionkey) % 3 = 0 THEN 'forbidden' WHEN (x.n_regionkey + y.n_regionkey) % 3 = 1 THEN 'ok' WHEN y.n_regionkey = (x.n_regionkey + 1) % 5 THEN 'ok' ELSE 'not allowed' END AS verdict
FROM t JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b""")
def _(spark, d):
    lines = load(spark, d, "lineitem").join(load(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy("l_orderkey", "s_nationkey").agg(F.count("*").alias("c"))
    made = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_nationkey")
    trade = lines.join(made, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.sum("c").alias("n"))
    nation = load(spark, d, "nation")
    x, y = (nation.select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias(f"{k}_layer")) for k in ("a", "b"))
    both = F.col("a_layer") + F.col("b_layer")
    mode = F.when(both % 3 == 0, "forbid").when(both % 3 == 1, "allow")
    return trade.join(x, "a").join(y, "b").select("a", "b", "n", relations.layer_verdict(mode, F.col("b_layer") == (F.col("a_layer") + 1) % 5).alias("verdict"))


KINDS = "SELECT l_partkey AS symbol, list_sort(list(DISTINCT l_returnflag)) AS k FROM lineitem WHERE l_shipdate {} TIMESTAMP '1998-01-01' GROUP BY 1"


@query("j14_surface_diff", f"""
WITH b AS ({KINDS.format("<")}), a AS ({KINDS.format(">=")}), j AS (SELECT coalesce(b.symbol, a.symbol) AS symbol, CASE WHEN a.k IS NULL THEN 'REMOVED' WHEN b.k IS NULL THEN 'ADDED' WHEN a.k <> b.k THEN 'CHANGED' END AS change FROM b FULL JOIN a ON a.symbol = b.symbol)
SELECT *, CASE change WHEN 'REMOVED' THEN 'HIGH' WHEN 'CHANGED' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM j WHERE change IS NOT NULL""")
def _(spark, d):
    lines, cut = load(spark, d, "lineitem"), F.lit(CUT).cast("timestamp")
    kinds = lambda rows: rows.groupBy(F.col("l_partkey").alias("symbol")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("kinds"))
    return relations.surface_changes(kinds(lines.where(F.col("l_shipdate") < cut)), kinds(lines.where(F.col("l_shipdate") >= cut)))


@query("j15_breaking_changes", """
WITH r AS (SELECT p_partkey AS symbol FROM part WHERE p_type = 'ECONOMY'), u AS (SELECT DISTINCT l_partkey AS symbol, l_suppkey AS importer FROM lineitem SEMI JOIN r ON symbol = l_partkey)
SELECT symbol, count(*) AS total, array_to_string(list_sort(list(importer))[1:10], ',') AS importers FROM u GROUP BY 1""")
def _(spark, d):
    removed = load(spark, d, "part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("symbol"))
    return relations.breaking(removed, load(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("importer")), 10)


@query("j16_silos", """
WITH o AS (SELECT DISTINCT p_brand, p_partkey, p_size, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT p_brand AS district, count(DISTINCT l_suppkey) AS owners, count(DISTINCT p_partkey) AS files, (SELECT CAST(sum(p_size) AS BIGINT) FROM (SELECT DISTINCT p_partkey, p_size FROM o i WHERE i.p_brand = o.p_brand)) AS loc FROM o GROUP BY 1""")
def _(spark, d):
    own = load(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    joined = own.join(load(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    files = joined.select("p_brand", "p_partkey", "p_size").distinct().groupBy("p_brand").agg(F.count("*").alias("files"), F.sum("p_size").alias("loc"))
    owners = joined.groupBy("p_brand").agg(F.countDistinct("l_suppkey").alias("owners"))
    return owners.join(files, "p_brand").select(F.col("p_brand").alias("district"), "owners", "files", "loc")


@query("j18_contracts", "WITH n AS (SELECT c_custkey AS name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT name, n, CASE WHEN n = 0 THEN 'MISSING' ELSE 'AMBIGUOUS' END AS issue FROM n WHERE n <> 1")
def _(spark, d):
    return relations.contract_issues(load(spark, d, "customer").select(F.col("c_custkey").alias("name")), load(spark, d, "orders").select(F.col("o_custkey").alias("name")))


@query("w3_drift_trend", f"WITH p AS (SELECT date_trunc('day', ts) AS day, count(*) FILTER (event_type = 'error') / count(*) AS s FROM events GROUP BY 1) SELECT strftime(day, '%Y-%m-%d') AS day, {R('s', '1000000.0')} AS score, {R('s - lag(s) OVER (ORDER BY day)', '1000000.0')} AS delta FROM p")
def _(spark, d):
    # One row per day from here on.
    p = load(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("t")).agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("s"))
    delta = F.col("s") - F.lag("s").over(Window.orderBy("t"))
    return p.select(F.date_format("t", "yyyy-MM-dd").alias("day"), rounded(F.col("s"), 6).alias("score"), rounded(delta, 6).alias("delta"))


@query("o2_rule_page", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 50")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").offset(50).limit(25)


@query("o6_pending", "SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 50")
def _(spark, d):
    return load(spark, d, "events").where("event_type = 'error'").orderBy("ts", "event_id").limit(50).select("event_id", "event_type")


@query("o8_hot_areas", "SELECT l_partkey AS file, count(*) AS issues FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY issues DESC, file LIMIT 20")
def _(spark, d):
    return load(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("file")).agg(F.count("*").alias("issues")).orderBy(F.desc("issues"), "file").limit(20)


@query("x3_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("x9_min_max", f"WITH m AS (SELECT min(p_size) AS a, max(p_size) AS b FROM part) SELECT p_partkey, {R('CASE WHEN a = b THEN 0 ELSE (p_size - a) / (b - a) END', '1000000.0')} AS scaled FROM part, m")
def _(spark, d):
    part = load(spark, d, "part")
    ends = part.agg(F.min("p_size").alias("a"), F.max("p_size").alias("b"))
    # One row of ends.
    return part.crossJoin(F.broadcast(ends)).select("p_partkey", rounded(min_max(F.col("p_size"), F.col("a"), F.col("b")), 6).alias("scaled"))


@query("x25_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("x26_ancestors", r"WITH p AS (SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '/') AS s FROM pages) SELECT page_id, array_to_string(s[1:i], '/') AS directory FROM p, LATERAL (SELECT unnest(range(1, len(s))) AS i)")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", F.explode(relations.ancestors(path_of(F.col("url")))).alias("directory"))


@query("t1_rate_window", "SELECT event_id AS id, user_id AS key, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS \"window\", row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id) <= 3 AS admitted FROM events")
def _(spark, d):
    return relations.admitted(load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at")), 3600, 3)


@query("t3_inbox_dedup", "SELECT user_id, event_type, min(event_id) AS first_id, count(*) AS deliveries FROM events GROUP BY 1, 2")
def _(spark, d):
    return load(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"), F.count("*").alias("deliveries"))
