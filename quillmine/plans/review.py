"""Scores, reviews, source text, ownership and graphs of the survey on the driver's tables, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmine.functions.scalars import path_of, rounded
from quillmine.operators import graphs, history, metrics, review, scores, source_code, windows
from quillmine.plans.registry import query
from quillmine.sources.tables import load
from quillmine.streaming import state

FILES = """f AS (
  SELECT p_partkey AS file, p_brand AS silo, CAST(p_size AS DOUBLE) AS complexity, coalesce(n, 0.0) AS churn, coalesce(q, 0.0) AS loc, coalesce(r, 0.0) AS bugs
  FROM part LEFT JOIN (SELECT l_partkey, CAST(count(*) AS DOUBLE) AS n, sum(l_quantity) AS q, CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS r FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""
EDGES = "e AS MATERIALIZED (SELECT DISTINCT l_suppkey AS source, l_suppkey % 7 * 11 + l_partkey % 5 AS target FROM lineitem)"


def files(spark, d):
    """Parts as files: size as complexity, lines as churn, quantity as lines of code, returns as bugs."""
    line = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.count("*").cast("double").alias("n"), F.sum("l_quantity").alias("q"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("r"))
    part = load(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("silo"), F.col("p_size").cast("double").alias("complexity"))
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return part.join(line, "file", "left").select("file", "silo", "complexity", zero("n", "churn"), zero("q", "loc"), zero("r", "bugs"))


@query("a3_cost_by_model", """
WITH r AS (SELECT l_returnflag AS model, l_quantity AS i, l_linenumber * 10 AS o, l_partkey % 7 AS t FROM lineitem)
SELECT model, CAST(sum(i + o + t) AS DOUBLE) AS tokens, floor(sum(floor((i / 1000.0 * CASE model WHEN 'A' THEN 0.03 WHEN 'N' THEN 0.01 ELSE 0.02 END + o / 1000.0 * CASE model WHEN 'A' THEN 0.06 WHEN 'N' THEN 0.02 ELSE 0.05 END + t / 1000.0 * CASE model WHEN 'A' THEN 0.09 WHEN 'N' THEN 0.0 ELSE 0.07 END) * 1000000 + 0.5) / 1000000) * 1000000 + 0.5) / 1000000 AS cost FROM r GROUP BY 1""")
def _(spark, d):
    kinds = [F.col("l_quantity").alias("input"), (F.col("l_linenumber") * 10).alias("output"), (F.col("l_partkey") % 7).alias("reasoning")]
    usage = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), *kinds).withColumn("total", F.expr("input + output + reasoning"))
    return scores.cost_by_model(usage, {"A": (0.03, 0.06, 0.09), "N": (0.01, 0.02, 0.0)}, (0.02, 0.05, 0.07))


@query("a15_issue_heatmap", """
WITH c AS (SELECT o_custkey AS file, o_orderpriority AS severity, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT file, CAST(sum(n) AS BIGINT) AS total, '{' || string_agg('"' || severity || '":' || n, ',' ORDER BY severity) || '}' AS severities FROM c GROUP BY 1""")
def _(spark, d):
    one = load(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("severity"), F.lit(1).cast("long").alias("n"))
    return review.merged_heatmap(one)


@query("a21_risk_score", f"""
WITH {FILES}, r AS (SELECT file, floor((least(100, complexity * 2) * 0.35 + least(100, churn) * 0.15 + least(100, bugs * 4) * 0.2 + least(100, loc / 20) * 0.2 + 50 * 0.1) * 100 + 0.5) / 100 AS risk FROM f)
SELECT file, risk, CASE WHEN risk >= 75 THEN 'CRITICAL' WHEN risk >= 50 THEN 'HIGH' WHEN risk >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r""")
def _(spark, d):
    least = lambda x: F.least(F.lit(100.0), x)
    score, level = scores.risk([least(F.col("complexity") * 2), least(F.col("churn")), least(F.col("bugs") * 4), least(F.col("loc") / 20), F.lit(50.0)])
    return files(spark, d).select("file", score.alias("risk"), level.alias("level"))


@query("a22_architecture_health", """
WITH v AS (SELECT n_regionkey AS layer, count(DISTINCT s_suppkey) AS t, count(*) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 0 GROUP BY 1),
m AS (SELECT n_regionkey AS layer, avg(n_nationkey % 7) AS methods, 1 - sum(CASE n_nationkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS clean FROM nation GROUP BY 1),
s AS (SELECT coalesce(m.layer, v.layer) AS layer, greatest(0, least(100, 100.0 - coalesce(t, 0) * 4)) AS coupling, CASE WHEN methods IS NULL THEN 100.0 ELSE greatest(0, least(100, methods * 16)) END AS cohesion,
      greatest(0, least(100, 100.0 - coalesce(v, 0) * 8)) AS layers, CASE WHEN clean IS NULL THEN 100.0 ELSE greatest(0, least(100, clean * 100)) END AS models FROM m FULL JOIN v ON m.layer = v.layer)
SELECT layer, CAST(floor(coupling * 100 + 0.5) / 100 AS DOUBLE) AS coupling, CAST(floor(cohesion * 100 + 0.5) / 100 AS DOUBLE) AS cohesion, CAST(floor(layers * 100 + 0.5) / 100 AS DOUBLE) AS layers, CAST(floor(models * 100 + 0.5) / 100 AS DOUBLE) AS models,
       CAST(floor((coupling + cohesion + layers + models) / 4 * 100 + 0.5) / 100 AS DOUBLE) AS overall FROM s""")
def _(spark, d):
    nation = load(spark, d, "nation")
    bad = load(spark, d, "supplier").where("s_acctbal < 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("layer"), F.col("s_suppkey").alias("target"))
    models = nation.select(F.col("n_regionkey").alias("layer"), (F.col("n_nationkey") % 7).alias("methods"), F.expr("case n_nationkey % 4 when 0 then 2 when 1 then 1 else 0 end").alias("wrong"))
    return scores.health(bad, models, "layer")


@query("a26_comparison_summary", """
WITH b AS (SELECT l_partkey AS file, sum(l_quantity) AS loc FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1), a AS (SELECT l_partkey AS file, sum(l_quantity) AS loc FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1)
SELECT count(*) FILTER (b.file IS NULL) AS added, count(*) FILTER (a.file IS NULL) AS removed, count(*) FILTER (a.loc <> b.loc) AS changed, sum(coalesce(a.loc, 0) - coalesce(b.loc, 0)) AS loc_delta FROM b FULL JOIN a ON a.file = b.file""")
def _(spark, d):
    line = load(spark, d, "lineitem")
    # One pass: both sides are sums of one grouping.
    side = lambda when, name: [F.sum(F.when(when, F.col("l_quantity"))).alias(name)]
    old = F.col("l_shipdate") < "1997-01-01"
    rows = line.groupBy("l_partkey").agg(*side(old, "b"), *side(~old, "a"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.agg(F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.sum(zero(F.col("a")) - zero(F.col("b"))).alias("loc_delta"))


@query("a28_running_averages", "SELECT event_id, sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS mean_value, count(*) OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth_of_day FROM events")
def _(spark, d):
    rows = load(spark, d, "events").select("event_id", "event_type", "ts", F.date_trunc("day", "ts").alias("day"), F.floor("value").cast("long").alias("v"))
    rows = windows.running_sums(rows, ["event_type"], ["ts", "event_id"], {"total": F.col("v"), "nth": F.lit(1).cast("long")})
    rows = windows.running_sums(rows, ["event_type", "day"], ["ts", "event_id"], {"nth_of_day": F.lit(1).cast("long")})
    return rows.select("event_id", (F.col("total") / F.col("nth")).alias("mean_value"), "nth_of_day")


@query("x20_risk_confidence", f"WITH {FILES} SELECT file, greatest(45.0, least(96.0, floor(45 + bugs * 9 + churn * 3 + complexity * 0.55 + 0.5))) AS confidence FROM f")
def _(spark, d):
    return files(spark, d).select("file", scores.confidence(F.col("bugs"), F.col("churn"), F.col("complexity")).cast("double").alias("confidence"))


@query("x21_sprint_improvement", """
WITH m AS (SELECT p_brand AS team, CASE WHEN p_size % 2 = 0 THEN 'Coverage' ELSE 'Churn' END AS label, CAST(p_size AS DOUBLE) AS before, CAST(p_size % 17 AS DOUBLE) AS after FROM part)
SELECT team, CAST(greatest(0, floor(sum(CASE label WHEN 'Coverage' THEN after - before ELSE before - after END / greatest(before, 1) * 100) / count(*) + 0.5)) AS BIGINT) AS improvement FROM m GROUP BY 1""")
def _(spark, d):
    size = F.col("p_size")
    m = load(spark, d, "part").select(F.col("p_brand").alias("team"), F.when(size % 2 == 0, "Coverage").otherwise("Churn").alias("label"), size.cast("double").alias("before"), (size % 17).cast("double").alias("after"))
    return scores.improvement(m, "team")


@query("x22_silo_risk", f"""
WITH {FILES}, s AS (SELECT file, p_brand || ':' || p_size AS silo, f.complexity, churn FROM f JOIN part ON p_partkey = file), o AS (SELECT DISTINCT l_partkey AS file, l_suppkey % 3 + p_size % 2 AS owner FROM lineitem JOIN part ON p_partkey = l_partkey), n AS (SELECT silo, count(DISTINCT owner) AS n FROM s JOIN o USING (file) GROUP BY 1),
g AS (SELECT silo, count(*) AS files, sum(complexity) AS c, sum(churn) AS h FROM s WHERE file IN (SELECT file FROM o) GROUP BY 1)
SELECT silo, files, CAST(greatest(1, n) AS BIGINT) AS contributors,
       CAST(greatest(1, least(99, CASE WHEN n <= 1 THEN 65 WHEN n = 2 THEN 40 ELSE 18 END + least(20, floor(c / 2 + 0.5)) + least(14, floor(h * 2 + 0.5)))) AS BIGINT) AS risk FROM g JOIN n USING (silo)""")
def _(spark, d):
    part = load(spark, d, "part").select("p_partkey", "p_size", F.concat_ws(":", "p_brand", "p_size").alias("of"))
    own = load(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    rows = files(spark, d).join(part, F.col("p_partkey") == F.col("file")).withColumn("silo", F.col("of"))
    return scores.silos(rows, own.select(F.col("p_partkey").alias("file"), F.expr("l_suppkey % 3 + p_size % 2").alias("owner")))


@query("o5_refactoring_targets", f"""
WITH {FILES} SELECT file, CAST(greatest(1, floor(loc / 40 + complexity / 8 + 0.5)) AS BIGINT) AS effort, CAST(greatest(1, least(99, floor(bugs * 12 + churn * 6 + 0.5))) AS BIGINT) AS risk,
CAST(greatest(1, floor(complexity * 1.2 + bugs * 10 + 0.5)) AS BIGINT) AS roi FROM f ORDER BY roi DESC, file LIMIT 20""")
def _(spark, d):
    return scores.refactoring(files(spark, d), 20)


@query("o4_risk_overlay", f"""
WITH {FILES}, r AS (SELECT file, greatest(45.0, least(96.0, floor(45 + bugs * 9 + churn * 3 + complexity * 0.55 + 0.5))) AS confidence, CASE WHEN bugs >= 12 THEN 3 WHEN bugs >= 6 THEN 2 ELSE 1 END AS priority FROM f)
SELECT file, CAST(priority AS INT) AS priority, confidence FROM r ORDER BY priority DESC, confidence DESC, file LIMIT 25""")
def _(spark, d):
    level = F.when(F.col("bugs") >= 12, 3).when(F.col("bugs") >= 6, 2).otherwise(1)
    rows = files(spark, d).select("file", level.alias("priority"), scores.confidence(F.col("bugs"), F.col("churn"), F.col("complexity")).cast("double").alias("confidence"))
    return rows.orderBy(F.desc("priority"), F.desc("confidence"), "file").limit(25)


@query("o9_leaderboard", f"""
WITH {FILES}, o AS (SELECT DISTINCT l_partkey AS file, l_suppkey AS person FROM lineitem), c AS (SELECT l_suppkey AS person, count(*) AS commits FROM lineitem GROUP BY 1),
p AS (SELECT s_suppkey AS person, s_name AS name, coalesce(commits, 0) AS commits FROM supplier LEFT JOIN c ON person = s_suppkey),
w AS (SELECT person, count(*) AS n, avg(complexity) AS x, avg(churn) AS h, avg(bugs) AS b FROM o JOIN f USING (file) GROUP BY 1), z AS (SELECT complexity AS x0, churn AS h0, bugs AS b0 FROM f ORDER BY file LIMIT 1),
m AS (SELECT person, name, commits, greatest(1, least(180, floor(100 - coalesce(x, x0) * 3 - coalesce(h, h0) * 1.2 - coalesce(b, b0) * 6 + 0.5))) AS q, greatest(1, least(180, floor(commits * 1.1 + coalesce(n, 1) * 4 + 0.5))) AS v, greatest(1, least(180, floor(coalesce(n, 1) * 12 + commits * 0.6 + 0.5))) AS u FROM p LEFT JOIN w USING (person), z),
s AS (SELECT person, name, CAST(q AS BIGINT) AS quality_month, CAST(greatest(1, least(180, floor(q + (3 + commits / 25) + 0.5))) AS BIGINT) AS quality_sprint, CAST(greatest(1, least(180, q - 4)) AS BIGINT) AS quality_quarter,
 CAST(v AS BIGINT) AS velocity_month, CAST(greatest(1, least(180, v + 8)) AS BIGINT) AS velocity_sprint, CAST(greatest(1, least(180, v - 6)) AS BIGINT) AS velocity_quarter,
 CAST(u AS BIGINT) AS ownership_month, CAST(greatest(1, least(180, u + 4)) AS BIGINT) AS ownership_sprint, CAST(greatest(1, least(180, u + 10)) AS BIGINT) AS ownership_quarter FROM m)
SELECT *, row_number() OVER (ORDER BY quality_sprint DESC, name, person) AS place FROM s""")
def _(spark, d):
    line = load(spark, d, "lineitem")
    commits = line.groupBy(F.col("l_suppkey").alias("person")).agg(F.count("*").alias("commits"))
    people = load(spark, d, "supplier").select(F.col("s_suppkey").alias("person"), F.col("s_name").alias("name")).join(commits, "person", "left").withColumn("commits", F.coalesce("commits", F.lit(0)))
    return scores.leaderboard(files(spark, d).withColumn("position", F.col("file")), people, line.select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("person")))


@query("w11_forecast", """
WITH p AS (SELECT date_trunc('day', ts) AS "at", avg(value) AS score FROM events GROUP BY 1), l AS (SELECT *, row_number() OVER (ORDER BY "at") AS i FROM (SELECT * FROM p ORDER BY "at" DESC LIMIT 6)),
f AS (SELECT "at", i, greatest(1, floor(score + 0.5)) AS h, greatest(1, floor(score - i * 2 + 0.5)) AS f FROM l)
SELECT CAST("at" AS VARCHAR) AS "at", CAST(h AS BIGINT) AS historical, CAST(f AS BIGINT) AS forecast, CAST(least(100, f + i + 3) AS BIGINT) AS high, CAST(greatest(1, f - i - 3) AS BIGINT) AS low FROM f""")
def _(spark, d):
    points = load(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("at")).agg(F.avg("value").alias("score"))
    return scores.forecast(points).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query("t12_scaling", """
WITH b AS (SELECT o_orderpriority AS queue, count(*) FILTER (o_orderstatus = 'O') / 4.0 AS backlog, CAST(4 AS BIGINT) AS replicas FROM orders GROUP BY 1),
w AS (SELECT *, CAST(greatest(2, least(16, ceil(backlog / 120))) AS BIGINT) AS wanted, backlog / replicas AS each FROM b)
SELECT queue, CASE WHEN each > 144 OR each < 96 THEN wanted ELSE replicas END AS replicas, CASE WHEN each > 144 THEN 'SCALE_UP' WHEN each < 96 THEN 'SCALE_DOWN' ELSE 'NOOP' END AS action FROM w""")
def _(spark, d):
    b = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("queue")).agg((F.count_if(F.col("o_orderstatus") == "O") / 4.0).alias("backlog"))
    n, action = scores.scaling(F.col("backlog"), F.lit(4))
    return b.select("queue", n.alias("replicas"), action.alias("action"))


@query("f13_enabled_rules", """
WITH l AS (SELECT p_type AS rule, p_size % 5 AS layer, p_partkey AS position, p_retailprice > 1200 AS enabled FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY layer DESC, position DESC) AS n, row_number() OVER (PARTITION BY rule ORDER BY layer, position) AS m FROM l)
SELECT a.rule, CAST(b.layer AS INT) AS layer, b.position FROM r a JOIN r b ON a.rule = b.rule AND b.m = 1 WHERE a.n = 1 AND a.enabled""")
def _(spark, d):
    return review.resolved_rules(load(spark, d, "part").select(F.col("p_type").alias("rule"), (F.col("p_size") % 5).alias("layer"), F.col("p_partkey").alias("position"), (F.col("p_retailprice") > 1200).alias("enabled")))


@query("w8_merged_settings", "SELECT user_id, event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def _(spark, d):
    return review.merged_settings(load(spark, d, "events").select("user_id", F.col("event_type").alias("key"), F.col("event_id").alias("layer"), "value"), "user_id")


PATCH = "p AS (SELECT doc_id AS file, text AS patch FROM documents), s AS (SELECT event_id AS id, event_id % (SELECT count(*) * 6 // 5 FROM documents) AS file, CASE WHEN event_id % 7 = 0 THEN ' ' WHEN event_id % 3 = 0 THEN 'the' ELSE 'schen' END AS code FROM events)"


def suggestions(spark, d):
    e = F.col("event_id")
    # A fifth more files than there are patches; one row.
    most = load(spark, d, "documents").agg(F.floor(F.count("*") * 6 / 5).alias("most"))
    rows = load(spark, d, "events").crossJoin(F.broadcast(most)).select(e.alias("id"), (e % F.col("most")).alias("file"), F.when(e % 7 == 0, " ").when(e % 3 == 0, "the").otherwise("schen").alias("code"))
    return rows, load(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("patch"))


@query("f7_already_done", f"WITH {PATCH} SELECT id, s.file, NOT (trim(code) <> '' AND coalesce(contains(patch, trim(code)), false)) AS keep FROM s LEFT JOIN p ON p.file = s.file")
def _(spark, d):
    return review.already_done(*suggestions(spark, d))


@query("f6_grounded", f"WITH {PATCH} SELECT id, s.file, patch IS NULL OR coalesce(contains(patch, trim(code)), false) OR id % 2 = 0 OR id % 5 = 0 AS keep FROM s LEFT JOIN p ON p.file = s.file")
def _(spark, d):
    rows, patches = suggestions(spark, d)
    verdicts = rows.where("id % 5 > 0").select("id", (F.col("id") % 2 == 0).alias("real"))
    return review.grounded(rows, patches, verdicts)


@query("f14_context_batches", "WITH r AS (SELECT p_partkey AS file, p_brand AS fingerprint, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 10 AS batch FROM part WHERE p_size > 10) SELECT fingerprint, batch, string_agg(CAST(file AS VARCHAR), ',' ORDER BY file) AS files FROM r GROUP BY 1, 2")
def _(spark, d):
    rows = review.batches(load(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("fingerprint")), 10)
    return rows.withColumn("files", F.array_join(F.col("files").cast("array<string>"), ","))


@query("f15_named_both_ends", "WITH k AS (SELECT n_nationkey FROM nation WHERE contains(lower(n_name), 'n_1')) SELECT DISTINCT s_nationkey AS source, c_nationkey AS target FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE s_nationkey IN (FROM k) AND c_nationkey IN (FROM k)")
def _(spark, d):
    nodes = load(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"))
    return review.with_both_ends(nodes, trade(spark, d), "N_1").distinct()


@query("f16_triage_scope", "SELECT o_orderkey, o_custkey AS owner FROM orders WHERE o_custkey IN (7, 10, 13)")
def _(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"), F.lit(0).alias("repository"))
    return review.in_scope(rows, "team", 7, [10, 13], []).select("o_orderkey", "owner")


@query("f17_review_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'urgent') AND o_custkey % 2 = 0")
def _(spark, d):
    rows = load(spark, d, "orders").where((F.col("o_orderstatus") == "O") & F.contains(F.lower("o_orderpriority"), F.lit("urgent")) & (F.col("o_custkey") % 2 == 0))
    return rows.select("o_orderkey", "o_orderstatus")


@query("j2_metric_rows", f"""
WITH {FILES}, c AS (SELECT file, CASE WHEN file % 11 = 0 THEN -1.0 ELSE complexity END AS v FROM f WHERE file % 5 > 0), l AS (SELECT file, CASE WHEN file % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE loc END AS v FROM f)
SELECT f.file AS path, coalesce(CASE WHEN NOT isnan(l.v) AND l.v >= 0 AND l.v < 'inf'::DOUBLE THEN l.v END, 0) AS loc, coalesce(CASE WHEN c.v >= 0 THEN c.v END, 0) AS complexity FROM f LEFT JOIN c ON c.file = f.file LEFT JOIN l ON l.file = f.file""")
def _(spark, d):
    f = files(spark, d)
    c = f.where("file % 5 > 0").select(F.col("file").alias("path"), F.when(F.col("file") % 11 == 0, -1.0).otherwise(F.col("complexity")).alias("value"))
    loc = f.select(F.col("file").alias("path"), F.when(F.col("file") % 13 == 0, float("nan")).otherwise(F.col("loc")).alias("value"))
    return review.metric_rows(f.select(F.col("file").alias("path")), {"loc": loc, "complexity": c})


@query("j6_range_overlap", "SELECT l_orderkey, l_linenumber, l_quantity <= 30 AND 10 <= l_quantity + l_linenumber AS overlaps FROM lineitem")
def _(spark, d):
    q = F.col("l_quantity")
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", review.overlap(q, q + F.col("l_linenumber"), F.lit(10), F.lit(30)).alias("overlaps"))


@query("j8_symbols", """
WITH c AS (SELECT p_type || '/' || p_size % 40 AS symbol, p_partkey AS target, p_partkey % 5 = 0 AS imported FROM part), g AS (SELECT symbol, count(*) FILTER (imported) AS i, count(*) AS n, min(target) FILTER (imported) AS one, min(target) AS a, list_sort(list(DISTINCT target))[1:3] AS l FROM c GROUP BY 1),
u AS (SELECT o_orderkey AS use, CASE o_orderkey % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'PROMO' ELSE 'STANDARD' END || '/' || o_orderkey % 60 AS symbol FROM orders)
SELECT use, u.symbol, CASE WHEN n IS NULL THEN 'SYMBOL_NOT_FOUND' WHEN i = 1 OR n = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, CASE WHEN i = 1 THEN one WHEN n = 1 THEN a END AS target, CASE WHEN n > 1 AND i <> 1 THEN array_to_string(l, ',') END AS candidates FROM u LEFT JOIN g ON g.symbol = u.symbol""")
def _(spark, d):
    c = load(spark, d, "part").select(F.concat("p_type", F.lit("/"), (F.col("p_size") % 40).cast("string")).alias("symbol"), F.col("p_partkey").alias("target"), (F.col("p_partkey") % 5 == 0).alias("imported"))
    k = F.col("o_orderkey")
    u = load(spark, d, "orders").select(k.alias("use"), F.concat(F.when(k % 3 == 0, "ECONOMY").when(k % 3 == 1, "PROMO").otherwise("STANDARD"), F.lit("/"), (k % 60).cast("string")).alias("symbol"))
    return review.resolved_symbols(u, c)


@query("j9_similar_files", """
WITH f AS (SELECT DISTINCT o_custkey AS file, o_orderpriority || o_orderstatus || month(o_orderdate) % 4 AS feature FROM orders), n AS (SELECT file, count(*) AS n FROM f GROUP BY 1), m AS (SELECT a.file AS a, b.file AS b, count(*) AS c FROM f a JOIN f b ON a.feature = b.feature AND a.file < b.file GROUP BY 1, 2)
SELECT a, b, c / (x.n + y.n - c) AS similarity FROM m JOIN n x ON x.file = a JOIN n y ON y.file = b WHERE c / (x.n + y.n - c) >= 0.6""")
def _(spark, d):
    f = load(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.concat("o_orderpriority", "o_orderstatus", (F.month("o_orderdate") % 4).cast("string")).alias("feature"))
    return review.similar_files(f, 0.6)


@query("u3_combined_issues", """
WITH i AS (SELECT o_custkey % 400 AS id, o_orderkey AS source, o_orderpriority AS severity, o_clerk AS path, o_orderstatus AS kind FROM (SELECT *, CAST(o_orderkey % 17 AS VARCHAR) AS o_clerk FROM orders)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source) AS n FROM i) WHERE n = 1), r AS (SELECT *, CASE WHEN list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], severity) > 0 THEN list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], severity) ELSE 4 END AS rank FROM f)
SELECT id, source, severity, path, kind, CAST(rank AS BIGINT) AS rank FROM r ORDER BY rank, path, source, kind, id LIMIT 200""")
def _(spark, d):
    i = load(spark, d, "orders").select((F.col("o_custkey") % 400).alias("id"), F.col("o_orderkey").alias("source"), F.col("o_orderpriority").alias("severity"), (F.col("o_orderkey") % 17).cast("string").alias("path"), F.col("o_orderstatus").alias("kind"))
    return review.combined_issues(i, ["1-URGENT", "2-HIGH", "3-MEDIUM"], 200).withColumn("rank", F.col("rank").cast("long"))


CHANGES = """c AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey AS file, l_suppkey % 4 AS author, l_shipdate AS "at" FROM lineitem), k AS (SELECT *, count(*) OVER (PARTITION BY file, author ORDER BY "at", id ROWS UNBOUNDED PRECEDING) AS own FROM c), m AS (SELECT *, max(own) OVER w AS most, count(*) OVER w AS total FROM k WINDOW w AS (PARTITION BY file ORDER BY "at", id ROWS UNBOUNDED PRECEDING)), o AS (SELECT *, last_value(CASE WHEN own = most THEN author END IGNORE NULLS) OVER (PARTITION BY file ORDER BY "at", id ROWS UNBOUNDED PRECEDING) AS owner FROM m), b AS (SELECT *, lag(owner) OVER (PARTITION BY file ORDER BY "at", id) AS owner_before FROM o)"""


def changes(spark, d):
    return load(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("file"), (F.col("l_suppkey") % 4).alias("author"), F.col("l_shipdate").alias("at"))


@query("w4_dominant_owner", f"WITH {CHANGES} SELECT id, file, author, total, own, floor(own / total * 10000.0 + 0.5) / 10000.0 AS share, owner, owner_before FROM b")
def _(spark, d):
    return history.dominant_owner(changes(spark, d)).drop("at")


@query("w5_owner_handoffs", f"WITH {CHANGES} SELECT file, owner_before AS from_owner, owner AS to_owner, id FROM b WHERE owner <> owner_before")
def _(spark, d):
    return history.owner_handoffs(changes(spark, d)).drop("at")


@query("w6_owner_periods", f"""WITH {CHANGES}, p AS (SELECT *, sum(CASE WHEN owner_before IS NULL OR owner <> owner_before THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY "at", id ROWS UNBOUNDED PRECEDING) AS period FROM b) SELECT file, CAST(period AS BIGINT) AS period, owner, count(*) AS changes FROM p GROUP BY 1, 2, 3""")
def _(spark, d):
    return history.owner_periods(changes(spark, d)).drop("from_at", "to_at")


def trade(spark, d):
    """Edges from the nations of suppliers to those of customers."""
    line = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    s, c = load(spark, d, "supplier").select("s_suppkey", "s_nationkey"), load(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    e = line.join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey"))
    return e.select(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target"))


def edges(spark, d):
    k, p = F.col("l_suppkey"), F.col("l_partkey")
    return load(spark, d, "lineitem").select(k.alias("source"), (k % 7 * 11 + p % 5).alias("target")).distinct()


@query("g3_strong_components", f"""
WITH RECURSIVE {EDGES}, n AS (SELECT source AS node FROM e UNION SELECT target FROM e),
r AS (SELECT source AS a, target AS b FROM e UNION SELECT r.a, e.target FROM r JOIN e ON e.source = r.b)
SELECT n.node, coalesce((SELECT max(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = n.node), n.node) AS component FROM n""")
def _(spark, d):
    return graphs.strong_components(edges(spark, d))


@query("g5_impact", """
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT l_suppkey AS source, l_partkey * 31 AS target FROM lineitem), w AS (SELECT source, target FROM e UNION SELECT target, source FROM e), r AS (SELECT x AS node, 0 AS distance FROM (VALUES (CAST(1 AS BIGINT)), (99999999)) AS t(x) UNION SELECT w.target, distance + 1 FROM r JOIN w ON w.source = r.node WHERE distance < 3)
SELECT node, CAST(min(distance) AS INT) AS distance, node IN (SELECT source FROM w) AS known FROM r GROUP BY 1""")
def _(spark, d):
    e = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") * 31).alias("target")).distinct()
    return graphs.impact(e, spark.range(1).select(F.explode(F.array(F.lit(1).cast("long"), F.lit(99_999_999).cast("long"))).alias("node")), 3)


@query("g14_federation", "SELECT 'a:' || n_nationkey AS source, 'a:' || n_regionkey AS target, 'a' AS graph FROM nation UNION ALL SELECT 'b:' || s_suppkey, 'b:' || s_nationkey, 'b' FROM supplier")
def _(spark, d):
    a = load(spark, d, "nation").select(F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("target"))
    return graphs.federated({"a": a, "b": load(spark, d, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_nationkey").alias("target"))})


@query("x5_patch_text", r"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(x) <= 1 THEN '' WHEN x[1] IN ('+', '-', ' ') THEN x[2:] ELSE x END) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(regexp_replace(array_to_string(l, chr(10)), '^\s+|\s+$', '', 'g')) AS digest FROM l""")
def _(spark, d):
    return load(spark, d, "documents").where("text is not null").select("doc_id", F.md5(source_code.patch_text(F.col("text"))).alias("digest"))


SOURCE = r"""t AS (SELECT page_id, html AS s FROM pages), k AS (SELECT page_id, regexp_replace(s, '(/\*(?:.|\n)*?\*/|//[^\n]*)|("(?:\\.|[^"\\\n])*"|''(?:\\.|[^''\\\n])*''|`(?:\\.|[^`\\])*`)', '\2' || chr(1), 'g') AS s FROM t),
c AS (SELECT page_id, replace(regexp_replace(s, '(?:"(?:\\.|[^"\\\n])*"|''(?:\\.|[^''\\\n])*''|`(?:\\.|[^`\\])*`)' || chr(1), '""', 'g'), chr(1), '') AS s FROM k)"""


@query("x6_lines_of_code", f"WITH {SOURCE} SELECT page_id, CAST(len(list_filter(string_split(s, chr(10)), lambda x: regexp_replace(x, '\\s', '', 'g') <> '')) AS BIGINT) AS loc FROM c")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", source_code.lines_of_code(F.col("html")).alias("loc"))


@query("x7_cyclomatic", f"WITH {SOURCE} SELECT page_id, CAST(CASE WHEN regexp_replace(s, '\\s', '', 'g') = '' THEN 0 ELSE 1 + len(regexp_extract_all(lower(s), '\\b(?:if|for|while|case|catch)\\b|&&|\\|\\|')) END AS BIGINT) AS complexity FROM c")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", source_code.cyclomatic(F.col("html"), "typescript").alias("complexity"))


@query("x8_language", """
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'kotlin' WHEN 3 THEN 'javascript' WHEN 4 THEN 'python' END AS language FROM part""")
def _(spark, d):
    k = F.col("p_size") % 6
    path = F.concat(F.lit("src/"), "p_name", F.when(k == 0, ".mts").when(k == 1, ".PY").when(k == 2, ".kts").otherwise(""))
    text = F.when(k == 3, "#!/usr/bin/env node\nx").when(k == 4, "#!/usr/bin/python3\nx").otherwise("x")
    return load(spark, d, "part").select("p_partkey", source_code.language_of(path, text).alias("language"))


@query("x13_fingerprint", """
WITH u AS (SELECT l_partkey, string_agg(DISTINCT lower(l_returnflag || l_linenumber), ',' ORDER BY lower(l_returnflag || l_linenumber)) AS imports, string_agg(DISTINCT lower(l_linestatus), ',' ORDER BY lower(l_linestatus)) FILTER (l_linenumber % 2 = 0) AS calls FROM lineitem GROUP BY 1)
SELECT p_partkey, sha256('language=go|filePath=src/' || p_partkey || '.go|name=' || lower(p_name) || '|kind=function|async=0|exported=1|parent=' || CASE WHEN p_size % 2 = 0 THEN '<none>' ELSE lower(p_brand) END || '|lineSpan=' || greatest(1, p_size - 9) || '|imports=' || coalesce(imports, '') || '|calls=' || coalesce(calls, '') || '|signature=(' || lower(p_type) || ',int)=>' || CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE lower(p_brand) END) AS digest,
 sha256('(' || lower(p_type) || ',int)=>' || CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE lower(p_brand) END) AS signature_digest FROM part LEFT JOIN u ON l_partkey = p_partkey""")
def _(spark, d):
    caller = F.when(F.col("l_linenumber") % 2 == 0, F.lit(None).cast("string")).otherwise(F.lit("another"))
    uses = load(spark, d, "lineitem").groupBy("l_partkey").agg(F.collect_set(F.concat(F.lit(" "), "l_returnflag", F.col("l_linenumber").cast("string"))).alias("imports"), F.collect_set(F.struct(caller.alias("caller"), F.col("l_linestatus").alias("callee"))).alias("calls"))
    rows = load(spark, d, "part").join(uses, F.col("l_partkey") == F.col("p_partkey"), "left")
    signed = source_code.signature(F.array(F.col("p_type"), F.lit(" Int ")), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")))
    path = F.concat(F.lit("src\\"), F.col("p_partkey").cast("string"), F.lit(".go"))
    flags = (F.lit(False), F.lit(True))
    digest, own = source_code.function_fingerprint(F.lit("Go"), path, F.col("p_name"), F.lit("function"), flags, F.when(F.col("p_size") % 2 != 0, F.col("p_brand")), (F.lit(10), F.col("p_size")), F.col("imports"), F.col("calls"), signed)
    return rows.select("p_partkey", digest.alias("digest"), own.alias("signature_digest"))


@query("x15_roles", """
WITH c AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), 'the')) AS a, len(regexp_extract_all(lower(coalesce(text, '')), 'sch')) AS b, len(regexp_extract_all(lower(coalesce(text, '')), 'que')) AS c FROM documents)
SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'unknown' WHEN a = greatest(a, b, c) THEN 'reader' WHEN b = greatest(a, b, c) THEN 'writer' ELSE 'service' END AS role FROM c""")
def _(spark, d):
    text = F.coalesce("text", F.lit(""))
    return load(spark, d, "documents").select("doc_id", source_code.role_score(text, {"reader": ("the",), "writer": ("sch",), "service": ("que",)}).alias("role"))


@query("x16_redaction", r"""
SELECT event_id, '{"by":{"Token":"[REDACTED]","note":"' || CASE WHEN event_id % 3 = 0 THEN '[REDACTED]' ELSE event_type END || '"},"n":' || user_id || ',"tags":["' || event_type || '","' || CASE WHEN event_id % 2 = 0 THEN '[REDACTED]' ELSE 'u' || user_id END || '"],"user":"[REDACTED]"}' AS body FROM events""")
def _(spark, d):
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    mail = F.concat(name, F.lit("@mail.example"))
    inner = F.struct(F.lit("abc").alias("Token"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("ask "), mail)).otherwise(F.col("event_type")).alias("note"))
    payload = F.struct(inner.alias("by"), F.col("user_id").alias("n"), F.array("event_type", F.when(F.col("event_id") % 2 == 0, mail).otherwise(name)).alias("tags"), F.col("user_id").alias("user"))
    rows = load(spark, d, "events").select("event_id", payload.alias("v"))
    return rows.select("event_id", F.to_json(source_code.redacted(F.col("v"), rows.schema["v"].dataType)).alias("body"))


@query("x16_redacted_json", r"""
SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"who":[{"email":"[REDACTED]"},"' || CASE WHEN event_id % 2 = 0 THEN '[REDACTED]' ELSE 'x' END || '"]}' AS body FROM events""")
def _(spark, d):
    text = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "who": [{"email": {"a": 1}}, "'), F.when(F.col("event_id") % 2 == 0, "a@b.c d").otherwise("x"), F.lit('"]}'))
    return load(spark, d, "events").select("event_id", source_code.redacted_json(text).alias("body"))


@query("x23_look_back", "SELECT o_orderkey, o_orderdate >= TIMESTAMP '1998-08-02' - INTERVAL 90 DAY AS recent FROM orders")
def _(spark, d):
    return load(spark, d, "orders").select("o_orderkey", (F.col("o_orderdate") >= F.expr("timestamp_ntz '1998-08-02' - interval 90 days")).alias("recent"))


@query("x24_date_parse", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN -9223372036854775808 WHEN 1 THEN epoch_ms(date_trunc('day', ts)) WHEN 2 THEN epoch_ms(date_trunc('second', ts)) - 7200000 ELSE epoch_ms(date_trunc('second', ts)) END AS ms FROM events")
def _(spark, d):
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 4 == 0, "soon").when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 4 == 2, F.concat(time, F.lit("+02:00"))).otherwise(F.concat(time, F.lit("Z")))
    return load(spark, d, "events").select("event_id", source_code.date_millis(text).alias("ms"))


@query("x27_relative_path", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'a/' || p_brand WHEN 1 THEN p_brand ELSE 'a/b/' || p_type END AS path FROM part")
def _(spark, d):
    k = F.col("p_size") % 3
    raw = F.when(k == 0, F.concat(F.lit("a//b/.././"), "p_brand")).when(k == 1, F.concat(F.lit("../x/../"), "p_brand")).otherwise(F.concat(F.lit("a/./b/"), "p_type", F.lit("/")))
    return load(spark, d, "part").select("p_partkey", source_code.resolved_path(raw).alias("path"))


@query("x28_sorted_json", "SELECT o_orderkey, '{\"a\":\"' || o_orderstatus || '\",\"b\":\"' || o_custkey || '\"}' AS line FROM orders")
def _(spark, d):
    m = F.create_map(F.lit("b"), F.col("o_custkey").cast("string"), F.lit("a"), F.col("o_orderstatus"))
    return load(spark, d, "orders").select("o_orderkey", source_code.sorted_json(m).alias("line"))


@query("x30_date_reducers", "SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS earliest, strftime(max(o_orderdate), '%Y-%m-%d') AS latest FROM orders GROUP BY 1")
def _(spark, d):
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return load(spark, d, "orders").groupBy("o_custkey").agg(day(F.min("o_orderdate")).alias("earliest"), day(F.max("o_orderdate")).alias("latest"))


@query("x1_paths", r"SELECT page_id, lower(regexp_extract(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[^/]\.([^./]+)$', 1)) AS extension FROM pages")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", source_code.extension(path_of(F.col("url"))).alias("extension"))


@query("u1_distinct_sets", "SELECT l_partkey AS file, string_agg(DISTINCT l_suppkey, ',' ORDER BY l_suppkey) AS owners FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("o"))
    return rows.select("file", F.array_join(F.col("o").cast("array<string>"), ",").alias("owners"))


@query("a10_file_ownership", """
WITH b AS (SELECT l_partkey AS file, l_suppkey AS owner, sum(l_quantity) AS lines, count(*) AS commits, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY lines DESC, commits DESC, owner) AS n, sum(lines) OVER (PARTITION BY file) AS total FROM b)
SELECT file, owner, floor(lines / total * 10000.0 + 0.5) / 10000.0 AS share, commits, strftime(last, '%Y-%m-%d') AS last_change FROM r WHERE n = 1""")
def _(spark, d):
    per = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("owner")).agg(F.sum("l_quantity").alias("lines"), F.count("*").alias("commits"), F.max("l_shipdate").alias("last"))
    # No window over a file's owners: the greatest of a struct combines before the shuffle.
    best = F.max(F.struct("lines", "commits", (-F.col("owner")).alias("o"), "last"))
    rows = per.groupBy("file").agg(best.alias("b"), F.sum("lines").alias("total"))
    return rows.select("file", (-F.col("b.o")).alias("owner"), rounded(F.col("b.lines") / F.col("total")).alias("share"), "b.commits", F.date_format("b.last", "yyyy-MM-dd").alias("last_change"))


@query("o3_search_many", """
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM v),
s AS (SELECT q.id AS query_id, u.id, floor(list_dot_product(q.v, u.v) * 100000.0 + 0.5) / 100000.0 AS similarity FROM u q, u WHERE q.id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM s)
SELECT query_id, id, similarity FROM r WHERE place <= 5""")
def _(spark, d):
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return metrics.nearest_each(rows.where("id % 20 = 0"), rows, 5)


@query("t2_auto_pause", """
WITH e AS (SELECT user_id, event_id, ts, event_type, CAST(floor(value / 10) AS BIGINT) AS n, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events),
c AS (SELECT *, CAST(sum(CASE WHEN event_type IN ('click', 'view') THEN n ELSE 0 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS suggestions FROM e) SELECT event_id, suggestions, suggestions >= 25 AS paused FROM c""")
def _(spark, d):
    kind = F.when(F.col("event_type") == "error", "resume").when(F.col("event_type").isin("click", "view"), "trigger").otherwise("other")
    e = load(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("at"), kind.alias("kind"), F.floor(F.col("value") / 10).cast("long").alias("n"))
    return state.paused(e, 25).select(F.col("id").alias("event_id"), F.col("count").alias("suggestions"), "paused")


@query("t6_dead_letters", "SELECT event_id, user_id % 6 AS attempts FROM events WHERE event_type = 'error' AND user_id % 6 >= 3 AND props IS NOT NULL")
def _(spark, d):
    e = load(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("failed"), (F.col("user_id") % 6).alias("attempts"), F.col("props").alias("job"))
    return state.dead_letters(e, 3).select(F.col("id").alias("event_id"), "attempts")
