"""Whole results of history, metrics, reviews and graphs on the driver's tables, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmine.operators import insights, paths
from quillmine.plans.analysis import STEPS, steps_of
from quillmine.plans.extended import LINKS, links_of
from quillmine.plans.reference import COUPLING, changes
from quillmine.plans.registry import query
from quillmine.sources.tables import load


def R(x: str, places: int = 6) -> str:
    return f"floor(({x}) * 1e{places}::DOUBLE + 0.5) / 1e{places}::DOUBLE"


@query("a6_filtered_coupling", f"""WITH t AS ({COUPLING}), p AS (SELECT p_partkey FROM part WHERE p_size = (SELECT max(p_size) FROM part)) SELECT * FROM t WHERE "left" IN (FROM p) OR "right" IN (FROM p)""")
def _(spark, d):
    """Pairs with a part of the greatest size."""
    part = load(spark, d, "part")
    asked = part.join(F.broadcast(part.agg(F.max("p_size").alias("p_size"))), "p_size").select(F.col("p_partkey").alias("file"))
    return insights.coupling_of(changes(spark, d), asked)


@query("w2_rolling_trends", f"""
WITH m AS (SELECT l_partkey AS file, date_trunc('month', l_shipdate) AS "at", sum(l_quantity) AS value FROM lineitem GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY "at" DESC) AS n FROM m),
g AS (SELECT file, count(*) AS samples, max(value) FILTER (n = 1) AS latest, avg(value) FILTER (n <= 3) AS a3, avg(value) FILTER (n <= 5) AS a5, avg(value) FILTER (n <= 8) AS a8, count(*) FILTER (n <= 3) AS c3, count(*) FILTER (n <= 5) AS c5, count(*) FILTER (n <= 8) AS c8 FROM n GROUP BY 1),
h AS (SELECT *, {R("a3")} AS s, {R("a8")} AS l FROM g), r AS (SELECT *, {R(R("s - l") + " / CASE WHEN l = 0 THEN 1 ELSE abs(l) END")} AS ratio FROM h)
SELECT file, samples, latest, s AS short_mean, l AS long_mean, {R("s - l")} AS delta, ratio, CASE WHEN ratio >= .15 THEN 'ACCELERATING' WHEN ratio <= -.15 THEN 'DECELERATING' ELSE 'STABLE' END AS direction,
 '3:' || c3 || ',5:' || c5 || ',8:' || c8 AS windows, {R("a5")} AS middle_mean FROM r""")
def _(spark, d):
    months = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("file"), F.date_trunc("month", "l_shipdate").alias("at")).agg(F.sum("l_quantity").alias("value"))
    rows = insights.rolling_trends(months)
    windows = F.array_join(F.transform("rolling", lambda x: F.concat_ws(":", x["window"].cast("string"), x["samples"].cast("string"))), ",")
    return rows.withColumn("windows", windows).withColumn("middle_mean", F.col("rolling")[1]["average"]).drop("rolling")


POINTS = "SELECT p_partkey AS file, CAST(p_size AS DOUBLE) AS complexity, CAST(coalesce(n, 0) AS DOUBLE) AS churn FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"


@query("a11_correlated_points", f"""
WITH f AS ({POINTS}), q AS (SELECT min(complexity) AS c0, max(complexity) AS c1, min(churn) AS h0, max(churn) AS h1, quantile_cont(complexity, .75) AS c, quantile_cont(churn, .75) AS h FROM f)
SELECT file, complexity, churn, {R("(complexity - c0) / (c1 - c0)")} AS scaled_complexity, {R("(churn - h0) / (h1 - h0)")} AS scaled_churn, complexity >= c AS high_complexity, churn >= h AS high_churn, complexity >= c AND churn >= h AS hotspot FROM f, q""")
def _(spark, d):
    churned = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n"))
    rows = load(spark, d, "part").join(churned, F.col("l_partkey") == F.col("p_partkey"), "left")
    return insights.correlated_points(rows.select(F.col("p_partkey").alias("file"), F.col("p_size").cast("double").alias("complexity"), F.coalesce("n", F.lit(0)).cast("double").alias("churn")))


@query("a5_contributor_files", f"SELECT l_suppkey AS contributor, l_partkey AS file, count(DISTINCT l_orderkey) AS commits, {R('sum(l_quantity)')} AS added, {R('sum(l_tax)')} AS deleted, max(l_shipdate) AS last_at, {R(R('sum(l_quantity)') + ' + ' + R('sum(l_tax)'))} AS changes FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return insights.contributor_files(changes(spark, d))


@query("o1_ranked_contributors", f"SELECT l_suppkey AS contributor, count(DISTINCT l_orderkey) AS commits, {R('sum(l_quantity) + sum(l_tax)')} AS changes FROM lineitem GROUP BY 1 ORDER BY commits DESC, changes DESC, contributor LIMIT 25")
def _(spark, d):
    return insights.ranked_contributors(changes(spark, d), 25)


#: Orders as suggestions: their priorities as severities, their states as categories.
SUGGESTED = "SELECT o_orderkey AS ordinal, CASE o_orderstatus WHEN 'F' THEN 'Security' WHEN 'O' THEN 'breaking change' ELSE 'odd' END AS category, substr(o_orderpriority, 3) AS severity FROM orders"


def suggested(spark, d):
    category = F.when(F.col("o_orderstatus") == "F", "Security").when(F.col("o_orderstatus") == "O", "breaking change").otherwise("odd")
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), category.alias("category"), F.substr("o_orderpriority", F.lit(3)).alias("severity"))


WEIGHED = "CASE upper(severity) WHEN 'LOW' THEN 10 WHEN 'MEDIUM' THEN 20 WHEN 'HIGH' THEN 30 WHEN 'CRITICAL' THEN 50 ELSE 0 END"


@query("w7_prioritized", f"""
WITH s AS (SELECT *, CASE category WHEN 'Security' THEN 20 WHEN 'breaking change' THEN 18 ELSE 0 END + {WEIGHED} AS score FROM ({SUGGESTED})), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, ordinal) AS place FROM s)
SELECT *, CASE WHEN place > 100 THEN 'low_priority' END AS discarded FROM r""")
def _(spark, d):
    return insights.prioritized(suggested(spark, d), 100)


@query("f5_severity_gate", f"""
WITH s AS (SELECT *, {WEIGHED} AS w, row_number() OVER (PARTITION BY CASE WHEN upper(severity) IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN upper(severity) ELSE 'INFO' END ORDER BY ordinal) AS n FROM ({SUGGESTED}))
SELECT ordinal, category, severity, CASE WHEN w < 10 OR upper(severity) = 'HIGH' AND n > 50 OR upper(severity) = 'LOW' THEN 'below_threshold' END AS discarded FROM s""")
def _(spark, d):
    return insights.severity_gate(suggested(spark, d), "low", {"HIGH": 50, "LOW": 0})


@query("a16_path_tree", """
WITH f AS (SELECT 'r' || s_nationkey % 5 || '/n' || s_nationkey || CASE WHEN s_suppkey % 3 = 0 THEN '/deep' ELSE '' END || '/s' || s_suppkey AS path, CAST(coalesce(n, 0) AS BIGINT) AS lines, coalesce(q, 0.0) AS size FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey),
p AS (SELECT *, string_split(path, '/') AS p FROM f), u AS (SELECT array_to_string(p[1:i], '/') AS up, len(p) - 1 AS depth, i, lines, size FROM p, range(0, 6) r(i) WHERE i < len(p)),
d AS (SELECT up AS path, count(*) FILTER (depth = i) AS files, CAST(sum(lines) AS BIGINT) AS lines, sum(size) AS size FROM u GROUP BY 1),
k AS (SELECT path, files, lines, size, true AS folder FROM d UNION ALL SELECT path, 0, lines, size, false FROM f), x AS (SELECT *, CASE WHEN path = '' THEN NULL WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/', 1) ELSE '' END AS parent FROM k)
SELECT path, parent, string_split(path, '/')[-1] AS name, folder, files, CASE WHEN folder THEN (SELECT count(*) FROM x y WHERE y.parent = x.path AND y.folder) ELSE 0 END AS folders, lines, size FROM x""")
def _(spark, d):
    deep = F.when(F.col("s_suppkey") % 3 == 0, "/deep").otherwise("")
    path = F.concat(F.lit("/r"), (F.col("s_nationkey") % 5).cast("string"), F.lit("/n"), F.col("s_nationkey").cast("string"), deep, F.lit("//s"), F.col("s_suppkey").cast("string"))
    used = load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("size"))
    rows = load(spark, d, "supplier").join(used, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return insights.path_tree(rows.select(path.alias("path"), "lines", "size"), ["lines", "size"])


@query("w8_merged_configs", """
SELECT o_custkey AS scope, '{"a":{"last":' || max(o_orderkey) || ',"own":' || max(o_orderkey) FILTER (o_orderkey % 2 = 0) || '},"list":[' || max(o_orderkey) || '],"p":"' || arg_max(o_orderpriority, o_orderkey) || '"}' AS body
FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1
UNION ALL SELECT o_custkey, '{"a":{"last":' || max(o_orderkey) || '},"list":[' || max(o_orderkey) || '],"p":"' || arg_max(o_orderpriority, o_orderkey) || '"}' FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1""")
def _(spark, d):
    key = F.col("o_orderkey")
    inner = F.struct(key.alias("last"), F.when(key % 2 == 0, key).alias("own"))
    body = F.to_json(F.struct(inner.alias("a"), F.array(key).alias("list"), F.col("o_orderpriority").alias("p")))
    return insights.merged_configs(load(spark, d, "orders").select(F.col("o_custkey").alias("scope"), key.alias("position"), body.alias("body")))


@query("j1_file_metric_rows", """
WITH m AS (SELECT l_partkey AS path, sum(l_quantity) - 600 AS loc, CAST(count(*) AS DOUBLE) AS issues FROM lineitem GROUP BY 1), h AS (SELECT l_partkey AS path, count(*) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT p_partkey AS path, greatest(0.0, coalesce(loc, 0)) AS loc, CAST(coalesce(total, issues, 0) AS DOUBLE) AS issue_count, CASE WHEN p_size % 2 = 0 THEN p_size / 100.0::DOUBLE END AS coverage, CASE WHEN p_size % 2 = 1 THEN p_brand END AS last_review
FROM part LEFT JOIN m ON m.path = p_partkey LEFT JOIN h ON h.path = p_partkey""")
def _(spark, d):
    line = load(spark, d, "lineitem")
    used = line.groupBy("l_partkey").agg((F.sum("l_quantity") - 600).alias("loc"), F.count("*").alias("issue_count"))
    part = load(spark, d, "part").select(F.col("p_partkey").alias("path"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") / 100.0).alias("coverage"), F.col("p_brand").alias("last_review"))
    metrics = part.join(used, F.col("l_partkey") == F.col("path"), "left").select("path", "loc", "issue_count", "coverage", "last_review")
    heat = line.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("total"))
    return insights.file_metric_rows(part, metrics, heat, ["loc"])


@query("j3_metric_diff", """
WITH b AS (SELECT l_partkey AS file, sum(l_quantity) AS loc, CAST(count(*) AS DOUBLE) AS churn FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01' GROUP BY 1), a AS (SELECT l_partkey AS file, sum(l_quantity) AS loc, CAST(count(*) AS DOUBLE) AS churn FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01' GROUP BY 1)
SELECT coalesce(b.file, a.file) AS file, CASE WHEN b.file IS NULL THEN 'added' WHEN a.file IS NULL THEN 'removed' ELSE 'changed' END AS state, b.loc AS before_loc, a.loc AS after_loc, b.churn AS before_churn, a.churn AS after_churn,
 CASE WHEN b.loc IS DISTINCT FROM a.loc THEN coalesce(a.loc, 0) - coalesce(b.loc, 0) END AS delta_loc, CASE WHEN b.churn IS DISTINCT FROM a.churn THEN coalesce(a.churn, 0) - coalesce(b.churn, 0) END AS delta_churn
FROM b FULL JOIN a ON a.file = b.file WHERE b.file IS NULL OR a.file IS NULL OR b.loc <> a.loc OR b.churn <> a.churn""")
def _(spark, d):
    line = load(spark, d, "lineitem")
    side = lambda when: line.where(when).groupBy(F.col("l_partkey").alias("file")).agg(F.sum("l_quantity").alias("loc"), F.count("*").cast("double").alias("churn"))
    return insights.metric_diff(side("l_shipdate < timestamp_ntz'1995-06-01'"), side("l_shipdate >= timestamp_ntz'1995-06-01'"), "file", ["loc", "churn"])


@query("j4_graph_diff_whole", """
WITH bn AS (SELECT 'p' || l_partkey AS id, l_returnflag || count(*) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey, l_returnflag), an AS (SELECT 'p' || l_partkey AS id, 'A' || count(*) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey),
be AS (SELECT DISTINCT 'p' || l_partkey AS s, 's' || l_suppkey AS t FROM lineitem WHERE l_returnflag = 'A'), ae AS (SELECT DISTINCT 'p' || l_partkey AS s, 's' || l_suppkey AS t FROM lineitem WHERE l_returnflag = 'R')
SELECT 'node' AS kind, CASE WHEN bn.id IS NULL THEN 'added' WHEN an.id IS NULL THEN 'removed' ELSE 'changed' END AS state, coalesce(bn.id, an.id) AS id, CAST(NULL AS VARCHAR) AS target, CAST(NULL AS VARCHAR) AS type FROM bn FULL JOIN an ON bn.id = an.id WHERE bn.v IS DISTINCT FROM an.v
UNION ALL SELECT 'edge', 'removed', s, t, 'USES' FROM (FROM be EXCEPT FROM ae) UNION ALL SELECT 'edge', 'added', s, t, 'USES' FROM (FROM ae EXCEPT FROM be)""")
def _(spark, d):
    line = load(spark, d, "lineitem").withColumn("id", F.concat(F.lit("p"), F.col("l_partkey").cast("string")))

    def graph(flag: str):
        rows = line.where(F.col("l_returnflag") == flag)
        nodes = rows.groupBy("id").agg(F.create_map(F.lit("n"), F.count("*").cast("string")).alias("metadata"))
        return nodes, rows.select(F.col("id").alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"), F.lit("USES").alias("type"))

    return insights.graph_diff(graph("A"), graph("R"))


@query("j8_resolved_references", """
WITH u AS (SELECT o_orderkey AS use, o_custkey AS file, 'y' || o_orderkey % 3000 AS symbol FROM orders), c AS (SELECT DISTINCT 'y' || l_orderkey % 2900 AS symbol, l_partkey AS target FROM lineitem WHERE l_linenumber >= 5), i AS (SELECT DISTINCT o_custkey AS file, l_partkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT symbol, count(*) AS n, min(target) AS a, list_sort(list(target))[1:5] AS f FROM c GROUP BY 1), m AS (SELECT use, count(*) AS i, min(target) AS o FROM u JOIN i USING (file) JOIN c USING (symbol, target) GROUP BY 1),
r AS (SELECT u.*, n, a, f, coalesce(i, 0) AS i, o FROM u LEFT JOIN n USING (symbol) LEFT JOIN m USING (use))
SELECT use, file, symbol, CASE WHEN i = 1 OR n = 1 THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN i = 1 THEN o WHEN n = 1 THEN a END AS target, CASE WHEN i = 1 THEN 0.95::DOUBLE WHEN n = 1 THEN 0.7::DOUBLE END AS confidence,
 CASE WHEN i = 1 OR n = 1 THEN NULL WHEN n IS NULL THEN 'SYMBOL_NOT_FOUND' ELSE 'AMBIGUOUS_SYMBOL' END AS reason, CASE WHEN i <> 1 AND n > 1 THEN array_to_string(f, ',') END AS candidates FROM r""")
def _(spark, d):
    orders, line = load(spark, d, "orders"), load(spark, d, "lineitem")
    name = lambda c, k: F.concat(F.lit("y"), (F.col(c) % k).cast("string"))
    uses = orders.select(F.col("o_orderkey").alias("use"), F.col("o_custkey").alias("file"), name("o_orderkey", 3000).alias("symbol"))
    candidates = line.where("l_linenumber >= 5").select(name("l_orderkey", 2900).alias("symbol"), F.col("l_partkey").alias("target"))
    imports = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("file"), F.col("l_partkey").alias("target"))
    rows = insights.resolved_references(uses, candidates, imports, 0.95, 0.7)
    return rows.withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


@query("j15_breaking_changes_whole", """
WITH x AS (SELECT DISTINCT 's' || l_suppkey AS file, 'y' || l_partkey AS symbol, l_returnflag AS f FROM lineitem), b AS (SELECT DISTINCT file, symbol FROM x WHERE f <> 'N'), a AS (SELECT DISTINCT file, symbol FROM x WHERE f = 'N' AND file <> 's1'),
l AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.file = b.file AND a.symbol = b.symbol)),
k AS (SELECT DISTINCT CASE WHEN file IN (SELECT file FROM a) THEN 'REMOVED_SYMBOL_EXPORT' ELSE 'REMOVED_FILE_EXPORT_SURFACE' END AS kind, file, CASE WHEN file IN (SELECT file FROM a) THEN symbol END AS symbol FROM l),
i AS (SELECT DISTINCT 'o' || l_orderkey AS importer, 's' || l_suppkey AS file, 'y' || l_partkey AS symbol FROM lineitem), u AS (SELECT DISTINCT k.kind, k.file, k.symbol, importer FROM k JOIN i ON i.file = k.file AND (k.symbol IS NULL OR i.symbol = k.symbol)),
g AS (SELECT kind, file, symbol, count(*) AS total, list_sort(list(importer))[1:20] AS importers FROM u GROUP BY 1, 2, 3)
SELECT k.kind, k.file, k.symbol, coalesce(total, 0) AS total, array_to_string(importers, ',') AS importers, coalesce(total, 0) > 20 AS truncated FROM k LEFT JOIN g ON g.kind = k.kind AND g.file = k.file AND g.symbol IS NOT DISTINCT FROM k.symbol""")
def _(spark, d):
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    x = load(spark, d, "lineitem").select(name("s", "l_suppkey").alias("file"), name("y", "l_partkey").alias("symbol"), "l_returnflag", name("o", "l_orderkey").alias("importer"))
    imports = x.groupBy(F.col("importer").alias("file"), F.col("file").alias("target")).agg(F.collect_set("symbol").alias("symbols"))
    rows = insights.breaking_changes(x.where("l_returnflag <> 'N'"), x.where("l_returnflag = 'N' and file <> 's1'"), imports, 20)
    return rows.withColumn("importers", F.array_join("importers", ","))


@query("j16_bus_factors", "SELECT p_brand AS district, count(DISTINCT l_suppkey % 3 + p_size % 2) AS bus_factor, count(DISTINCT p_partkey) AS files FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def _(spark, d):
    part = load(spark, d, "part")
    files = part.select(F.col("p_partkey").alias("file"), F.concat_ws("/", "p_brand", "p_name").alias("path"))
    own = load(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_partkey").alias("file"), F.expr("l_suppkey % 3 + p_size % 2").alias("owner"))
    return insights.bus_factors(files, own)


RATES = """e AS (SELECT CAST(user_id AS VARCHAR) AS rule, CASE event_type WHEN 'error' THEN 'f' WHEN 'click' THEN 'a' END AS k, pow(.5::DOUBLE, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 3.6e9::DOUBLE / 168) AS w FROM events),
r AS (SELECT rule, count(*) AS n, coalesce(sum(w) FILTER (k = 'a'), 0) / sum(w) AS a, coalesce(sum(w) FILTER (k = 'f'), 0) / sum(w) AS f FROM e GROUP BY 1)"""


def rates_of(spark, d):
    events = load(spark, d, "events")
    last = events.agg(F.max("ts").alias("as_of"))
    kind = F.when(F.col("event_type") == "error", "false_positive").when(F.col("event_type") == "click", "accepted").otherwise("other")
    rows = events.crossJoin(F.broadcast(last)).select(F.col("user_id").cast("string").alias("rule"), kind.alias("kind"), F.col("ts").alias("at"), "as_of")
    return insights.rule_rates(rows)


@query("a19_false_positives_whole", f"WITH {RATES} SELECT rule, {R('f')} AS rate, CASE WHEN f >= .3 AND n >= 10 THEN 'DEACTIVATE_RULE' ELSE 'MONITOR' END AS recommendation FROM r WHERE f > .2 AND n >= 5")
def _(spark, d):
    return insights.false_positives(rates_of(spark, d), 0.2, 0.3)


@query("a20_weighted_patterns", f"WITH {RATES} SELECT rule, {R('greatest(-1, least(1, a - f))')} AS score, {R('least(1, n / 60)')} AS confidence FROM r")
def _(spark, d):
    return insights.team_patterns(rates_of(spark, d), 60)


@query("a23_top_hubs", f"SELECT node, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(1 - o) AS BIGINT) AS incoming, count(*) AS total FROM (SELECT source AS node, 1 AS o FROM ({LINKS}) UNION ALL SELECT target, 0 FROM ({LINKS})) GROUP BY 1 ORDER BY total DESC, node LIMIT 10")
def _(spark, d):
    return insights.top_hubs(links_of(spark, d))


@query("a24_structural_patterns", f"""
WITH RECURSIVE e AS (SELECT DISTINCT source, target FROM ({STEPS}) WHERE target IS NOT NULL), n AS (SELECT source AS node FROM e UNION SELECT target FROM e), r AS (SELECT source AS a, target AS b FROM e UNION SELECT r.a, e.target FROM r JOIN e ON e.source = r.b),
c AS (SELECT n.node, least(n.node, coalesce((SELECT min(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = n.node), n.node)) AS component FROM n), g AS (SELECT * FROM e WHERE source <> target),
a AS (SELECT 'CIRCULAR_DEPENDENCY' AS type, component AS name, count(*) AS score FROM c GROUP BY 2 HAVING count(*) >= 3 UNION ALL SELECT 'HIGH_FAN_IN', target, count(*) FROM g GROUP BY 2 HAVING count(*) >= 3 UNION ALL SELECT 'HIGH_FAN_OUT', source, count(*) FROM g GROUP BY 2 HAVING count(*) >= 3
 UNION ALL SELECT 'MIXED_ABSTRACTION', CAST(user_id AS VARCHAR), count(DISTINCT event_type) FROM events GROUP BY 2 HAVING count(DISTINCT event_type) >= 3), p AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, name) AS n FROM a)
SELECT type, name, score FROM p WHERE n <= 10""")
def _(spark, d):
    e = steps_of(spark, d).select("source", "target")
    nodes = load(spark, d, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_type").alias("type"))
    return insights.structural_patterns(e, nodes, paths.cyclic_components(e))


@query("t1_limited_calls", "WITH w AS (SELECT event_id AS id, user_id % 500 AS key, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS w0, CAST(floor(epoch(ts)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY user_id % 500, floor(epoch(ts) / 3600) ORDER BY ts, event_id) AS n FROM events) SELECT id, key, w0 AS \"window\", n <= 2 AS admitted, CASE WHEN n > 2 THEN w0 + 3600 - sec END AS retry_after FROM w")
def _(spark, d):
    spark_utc = F.to_timestamp(F.concat(F.col("ts").cast("string"), F.lit("Z")))
    return insights.limited_calls(load(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 500).alias("key"), spark_utc.alias("at")), 3600, 2)
