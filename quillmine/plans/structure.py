"""Boundaries, contracts, stores and filters of the survey on the driver's tables, each with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmine.functions.scalars import rounded
from quillmine.operators import boundaries
from quillmine.plans.registry import query
from quillmine.sources import stores
from quillmine.sources.tables import load

TOP = "'src/m' || {0} % 5 || '/f' || {0}"


@query("j12_module_violations", f"""
WITH i AS (SELECT DISTINCT {TOP.format("l_suppkey")} AS source, {TOP.format("l_partkey")} AS target FROM lineitem),
m AS (SELECT source, target, CASE WHEN source[6] IN ('0', '1') THEN 'core' WHEN source[6] = '2' THEN 'api' WHEN source[6] = '3' THEN 'ui' END AS source_module, CASE WHEN target[6] IN ('0', '1') THEN 'core' WHEN target[6] = '2' THEN 'api' WHEN target[6] = '3' THEN 'ui' END AS target_module FROM i)
SELECT * FROM m WHERE source_module <> target_module""")
def _(spark, d):
    path = lambda c: F.concat(F.lit("src/m"), F.col(c) % 5, F.lit("/f"), F.col(c))
    imports = load(spark, d, "lineitem").select(path("l_suppkey").alias("source"), path("l_partkey").alias("target"))
    return boundaries.module_violations(imports, {"core": ["src/m0/**", "src/m1/**"], "api": ["src/m2/*"], "ui": ["src/m3/**"]})


@query("j13_package_violations", """
WITH i AS (SELECT DISTINCT 'packages/p' || l_suppkey % 5 || '/f' || l_suppkey AS source, CASE WHEN l_linenumber % 2 = 0 THEN '@m/p' || l_partkey % 7 || '/x' ELSE '../p' || l_partkey % 7 END AS specifier,
  CASE WHEN l_linenumber % 2 = 1 THEN 'p' || l_partkey % 7 END AS met, CASE WHEN l_linenumber % 2 = 0 THEN 'p' || l_partkey % 7 END AS target, 'p' || l_suppkey % 5 AS package FROM lineitem)
SELECT source, specifier, package, met AS target, 'CROSS_PACKAGE' AS kind, 'HIGH' AS severity FROM i WHERE met <> package
UNION ALL SELECT source, specifier, package, target, CASE WHEN target = package THEN 'SELF_PACKAGE' WHEN target > 'p4' THEN 'UNKNOWN_PACKAGE' ELSE 'UNDECLARED' END, CASE WHEN target = package THEN 'LOW' ELSE 'MEDIUM' END
FROM i WHERE target = package OR target > 'p4' OR (target IS NOT NULL AND package = 'p0' AND target NOT IN ('p1', 'p2')) OR (target IS NOT NULL AND package = 'p1' AND target <> 'p4')""")
def _(spark, d):
    even = F.col("l_linenumber") % 2 == 0
    to = F.concat(F.lit("p"), F.col("l_partkey") % 7)
    source = F.concat(F.lit("packages/p"), F.col("l_suppkey") % 5, F.lit("/f"), F.col("l_suppkey"))
    specifier = F.when(even, F.concat(F.lit("@m/"), to, F.lit("/x"))).otherwise(F.concat(F.lit("../"), to))
    imports = load(spark, d, "lineitem").select(source.alias("source"), specifier.alias("specifier"), F.when(~even, F.concat(F.lit("packages/"), to, F.lit("/f"))).alias("resolved"))
    packages = spark.createDataFrame([(f"p{i}", i < 2) for i in range(5)], "package string, declares boolean")
    declared = spark.createDataFrame([("p0", "p1"), ("p0", "p2"), ("p1", "p4")], "package string, target string")
    return boundaries.package_violations(imports, packages, declared, "@m/")


@query("j17_structure_differences", """
WITH p AS (SELECT c_nationkey AS layer, c_mktsegment AS module, string_agg(DISTINCT CAST(c_custkey % 3 AS VARCHAR), ',' ORDER BY CAST(c_custkey % 3 AS VARCHAR)) AS p FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1, 2),
b AS (SELECT c_nationkey AS layer, c_mktsegment AS module, string_agg(DISTINCT CAST(c_custkey % 3 AS VARCHAR), ',' ORDER BY CAST(c_custkey % 3 AS VARCHAR)) AS b FROM customer WHERE c_custkey % 2 = 1 GROUP BY 1, 2)
SELECT layer, module, CASE WHEN b IS NULL THEN 'missing' WHEN p IS NULL THEN 'unexpected' ELSE 'match' END AS status, p = b AS same_direction FROM p FULL JOIN b USING (layer, module)""")
def _(spark, d):
    def side(odd):
        rows = load(spark, d, "customer").where(F.col("c_custkey") % 2 == odd).groupBy(F.col("c_nationkey").alias("layer"), F.col("c_mktsegment").alias("module"))
        return rows.agg(F.array_sort(F.collect_set((F.col("c_custkey") % 3).cast("string"))).alias("depends"))

    return boundaries.structure_differences(side(0), side(1))


@query("j18_declared_contracts", """
WITH c AS (SELECT 'i' || l_partkey % 50 AS name, l_suppkey AS file FROM lineitem WHERE l_linenumber = 7),
n AS (SELECT l_suppkey AS file, l_orderkey AS declaration, 'i' || l_partkey % 60 AS name, row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_partkey % 60 ORDER BY l_linenumber) AS nth FROM lineitem),
r AS (SELECT DISTINCT l_suppkey AS file, l_partkey % 10 + 1 AS target FROM lineitem WHERE l_linenumber = 1),
here AS (SELECT name, file, count(*) AS same FROM c GROUP BY 1, 2), per AS (SELECT name, count(*) AS n FROM c GROUP BY 1),
far AS (SELECT name, r.file, CAST(sum(same) AS BIGINT) AS near FROM here JOIN r ON here.file = r.target GROUP BY 1, 2),
t AS (SELECT n.file, declaration, n.name, coalesce(same, near, per.n, 0) AS k FROM n LEFT JOIN per ON per.name = n.name LEFT JOIN here ON here.name = n.name AND here.file = n.file LEFT JOIN far ON far.name = n.name AND far.file = n.file WHERE nth = 1)
SELECT file, declaration, name, 'DUPLICATE' AS issue, 'LOW' AS severity FROM n WHERE nth > 1
UNION ALL SELECT file, declaration, name, CASE WHEN k = 0 THEN 'MISSING' ELSE 'AMBIGUOUS' END, CASE WHEN k = 0 THEN 'HIGH' ELSE 'MEDIUM' END FROM t WHERE k <> 1""")
def _(spark, d):
    line = load(spark, d, "lineitem")
    name = lambda n: F.concat(F.lit("i"), F.col("l_partkey") % n).alias("name")
    declared = line.select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("declaration"), F.col("l_linenumber").alias("position"), name(60))
    contracts = line.where("l_linenumber = 7").select(name(50), F.col("l_suppkey").alias("file"))
    reachable = line.where("l_linenumber = 1").select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 10 + 1).alias("target"))
    return boundaries.declared_contracts(declared, contracts, reachable)


@query("j18_contracts_of_all_lines", """
WITH c AS (SELECT 'i' || p_partkey // 2 AS name, CAST(p_size AS BIGINT) AS file FROM part),
n AS (SELECT l_suppkey AS file, l_orderkey AS declaration, 'i' || l_partkey * 3 // 4 AS name, row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_partkey * 3 // 4 ORDER BY l_linenumber) AS nth FROM lineitem),
r AS (SELECT DISTINCT l_suppkey AS file, l_linenumber + 3 AS target FROM lineitem),
here AS (SELECT name, file, count(*) AS same FROM c GROUP BY 1, 2), per AS (SELECT name, count(*) AS n FROM c GROUP BY 1),
far AS (SELECT name, r.file, CAST(sum(same) AS BIGINT) AS near FROM here JOIN r ON here.file = r.target GROUP BY 1, 2),
t AS (SELECT n.file, declaration, n.name, coalesce(same, near, per.n, 0) AS k FROM n LEFT JOIN per ON per.name = n.name LEFT JOIN here ON here.name = n.name AND here.file = n.file LEFT JOIN far ON far.name = n.name AND far.file = n.file WHERE nth = 1)
SELECT file, declaration, name, 'DUPLICATE' AS issue, 'LOW' AS severity FROM n WHERE nth > 1
UNION ALL SELECT file, declaration, name, CASE WHEN k = 0 THEN 'MISSING' ELSE 'AMBIGUOUS' END, CASE WHEN k = 0 THEN 'HIGH' ELSE 'MEDIUM' END FROM t WHERE k <> 1""")
def _(spark, d):
    line, part = load(spark, d, "lineitem"), load(spark, d, "part")
    name = lambda c: F.concat(F.lit("i"), F.expr(c).cast("string")).alias("name")
    declared = line.select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("declaration"), F.col("l_linenumber").alias("position"), name("l_partkey * 3 div 4"))
    contracts = part.select(name("p_partkey div 2"), F.col("p_size").cast("long").alias("file"))
    reachable = line.select(F.col("l_suppkey").alias("file"), (F.col("l_linenumber") + 3).alias("target"))
    return boundaries.declared_contracts(declared, contracts, reachable)


@query("a27_shared_state", """
WITH m AS (SELECT DISTINCT l_suppkey AS file, 's' || l_partkey AS symbol, CASE l_returnflag WHEN 'A' THEN 'setAll' WHEN 'R' THEN 'addRow' ELSE 'get' || l_returnflag END AS method FROM lineitem),
s AS (SELECT file, symbol, list_sort(list(method)) AS mutators FROM m WHERE starts_with(lower(method), 'set') OR starts_with(lower(method), 'add') GROUP BY 1, 2),
i AS (SELECT DISTINCT o_custkey AS consumer, l_suppkey AS file, CASE WHEN o_orderkey % 97 > 0 THEN 's' || l_partkey END AS symbol FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
u AS (SELECT s.file, s.symbol, count(DISTINCT consumer) AS consumers FROM s JOIN i ON i.file = s.file AND (i.symbol = s.symbol OR i.symbol IS NULL) GROUP BY 1, 2)
SELECT file, symbol, consumers, array_to_string(mutators, ',') AS mutators, CASE WHEN consumers >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM u JOIN s USING (file, symbol) WHERE consumers >= 2""")
def _(spark, d):
    mode = F.col("l_returnflag")
    method = F.when(mode == "A", "setAll").when(mode == "R", "addRow").otherwise(F.concat(F.lit("get"), mode))
    lines = load(spark, d, "lineitem")
    symbol = F.concat(F.lit("s"), "l_partkey")
    methods = lines.select(F.col("l_suppkey").alias("file"), symbol.alias("symbol"), method.alias("method"))
    none = F.array().cast("array<string>")
    symbols = F.when(F.col("o_orderkey") % 97 > 0, F.array(symbol)).otherwise(none)
    imports = load(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("consumer"), F.col("l_suppkey").alias("file"), symbols.alias("symbols"))
    return boundaries.shared_state(methods, imports, ["set", "add"]).withColumn("mutators", F.concat_ws(",", "mutators"))


@query("p6_filter_chain", """
WITH a AS (SELECT o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus <> 'P' ORDER BY o_orderkey) AS r, o_orderstatus <> 'P' AS keep FROM orders),
b AS (SELECT *, NOT keep AND r <= 100 AS gone1 FROM a),
c AS (SELECT *, 100 - (SELECT count(*) FROM b WHERE gone1) AS room, o_totalprice >= 5000 AS keep2, row_number() OVER (PARTITION BY gone1, o_totalprice >= 5000 ORDER BY CAST(NOT keep AS INT), o_orderkey) AS r2 FROM b)
SELECT o_orderkey, CASE WHEN gone1 THEN 'status' WHEN NOT keep2 AND r2 <= room THEN 'price' END AS discarded_by FROM c""")
def _(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    chain = [("status", F.col("o_orderstatus") != "P"), ("price", F.col("o_totalprice") >= 5000)]
    return boundaries.filter_chain(rows, chain, "o_orderkey", 100).select("o_orderkey", "discarded_by")


@query("f4_compiled_filter", "SELECT event_id FROM events WHERE event_type IN ('click', 'error') AND CAST(json_extract(props, '$.k') AS BIGINT) IN (1, 2, 3)")
def _(spark, d):
    rows = load(spark, d, "events").withColumn("props", F.from_json("props", "k long"))
    return rows.where(boundaries.metadata_filter({"event_type": ["click", "error"], "props": {"k": [1, 2, 3]}})).select("event_id")


@query("x12_severity_weights", "SELECT o_orderkey, CASE upper(substr(o_orderpriority, 3)) WHEN 'LOW' THEN 10 WHEN 'MEDIUM' THEN 20 WHEN 'HIGH' THEN 30 WHEN 'CRITICAL' THEN 50 ELSE 0 END AS weight FROM orders")
def _(spark, d):
    # fixed values: the weights of the severities; any other text counts as INFO
    weights = {"INFO": 0, "LOW": 10, "MEDIUM": 20, "HIGH": 30, "CRITICAL": 50}
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return load(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(known, F.upper(F.substr("o_orderpriority", F.lit(3)))), F.lit(0)).alias("weight"))


@query("x17_sampled_events", """
WITH h AS (SELECT event_id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(event_type || ':' || user_id || ':' || props, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS hash FROM events)
SELECT event_id, hash, hash % 10000 < 2500 AS sampled FROM h""")
def _(spark, d):
    seed = F.concat_ws(":", "event_type", "user_id", "props")
    rows = load(spark, d, "events").select("event_id", boundaries.seeded_bucket(seed).alias("hash"))
    return rows.withColumn("sampled", F.col("hash") % 10000 < 2500)


@query("u4_shared_features", """
WITH t AS (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS s FROM documents)
SELECT a.doc_id, CAST(len(list_intersect(a.s, b.s)) AS INT) AS shared, CAST(len(list_distinct(list_concat(a.s, b.s))) AS INT) AS united, floor(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) * 10000 + 0.5) / 10000 AS jaccard
FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def _(spark, d):
    t = load(spark, d, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("s"))
    pairs = t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t")), "doc_id")
    return boundaries.shared_features(pairs, "s", "t").select("doc_id", "shared", "united", rounded(F.col("jaccard")).alias("jaccard"))


@query("g13_type_flow", "SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_linenumber AS symbol FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R' ORDER BY 1, 2, 3 LIMIT 500")
def _(spark, d):
    rows = load(spark, d, "lineitem").where("l_linestatus = 'F' and l_returnflag = 'R'")
    return rows.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.col("l_linenumber").alias("symbol")).distinct().orderBy("source", "target", "symbol").limit(500)


@query("s4_commits", "SELECT o_orderkey AS id, o_custkey AS author, o_orderdate AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31' ORDER BY day DESC, id LIMIT 100")
def _(spark, d):
    history = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("at"))
    return stores.commits(history, since="1996-01-01", until="1997-12-31", most=100).withColumnRenamed("at", "day")


@query("s5_blame", "WITH r AS (SELECT l_partkey AS path, l_linenumber AS a, CAST(l_linenumber + l_quantity % 5 AS INT) AS b, l_suppkey AS author FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 5)) SELECT path, unnest(range(a, b + 1)) AS line, author FROM r")
def _(spark, d):
    first = F.col("l_linenumber").cast("long")
    ranges = load(spark, d, "lineitem").select(F.col("l_partkey").alias("path"), first.alias("first"), (first + F.col("l_quantity") % 5).cast("long").alias("last"), F.col("l_suppkey").alias("author"))
    return stores.blame(ranges, load(spark, d, "part").where("p_size <= 5").select(F.col("p_partkey").alias("path")))


@query("s7_ref_diff", """
WITH s AS (SELECT l_partkey AS path, l_linestatus AS ref, CAST(sum(l_quantity) AS BIGINT) % 3 AS digest FROM lineitem GROUP BY 1, 2), b AS (FROM s WHERE ref = 'F'), a AS (FROM s WHERE ref = 'O')
SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'modified' END AS status FROM b FULL JOIN a ON a.path = b.path WHERE b.digest IS DISTINCT FROM a.digest""")
def _(spark, d):
    ref = lambda r: load(spark, d, "lineitem").where(F.col("l_linestatus") == r).groupBy(F.col("l_partkey").alias("path")).agg((F.sum("l_quantity").cast("long") % 3).alias("digest"))
    return stores.ref_diff(ref("F"), ref("O"))


@query("s9_vector_upsert", """
WITH n AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY version DESC) AS r FROM (SELECT vec_id, label + 100 AS label, 1 AS version FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, label + 200, 2 FROM embeddings WHERE vec_id % 6 = 0))
SELECT * FROM (SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label FROM n WHERE r = 1) WHERE vec_id % 5 <> 0""")
def _(spark, d):
    stored = load(spark, d, "embeddings").select("vec_id", "label")
    new = [stored.where(F.col("vec_id") % m == 0).select("vec_id", (F.col("label") + 100 * v).alias("label"), F.lit(v).alias("version")) for v, m in ((1, 3), (2, 6))]
    return stores.deleted(stores.upserted(stored, new[0].union(new[1]), "vec_id"), stored.where("vec_id % 5 = 0"), "vec_id")


@query("s10_find_by_status", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def _(spark, d):
    at = F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp"))
    return load(spark, d, "orders").where((F.col("o_orderstatus") == "F") & at).select("o_orderkey")


@query("s12_dequeue", "SELECT event_id AS job, 'taken' AS state FROM (SELECT * FROM events ORDER BY user_id NULLS LAST, ts, event_id LIMIT 50) UNION ALL SELECT event_id, 'waiting' FROM (SELECT * FROM events ORDER BY user_id NULLS LAST, ts, event_id OFFSET 50)")
def _(spark, d):
    taken, left = stores.dequeued(load(spark, d, "events").select(F.col("event_id").alias("job"), F.col("user_id").alias("priority"), F.col("ts").alias("at")), 50)
    return taken.select("job", F.lit("taken").alias("state")).union(left.select("job", F.lit("waiting")))


@query("s13_graph_json", """SELECT '{"id":"r' || n_regionkey || '","targets":[' || string_agg('"n' || n_nationkey || '"', ',' ORDER BY 'n' || n_nationkey) || ']}' AS json FROM nation GROUP BY n_regionkey""")
def _(spark, d):
    per = load(spark, d, "nation").groupBy(F.concat(F.lit("r"), "n_regionkey").alias("id")).agg(F.array_sort(F.collect_list(F.concat(F.lit("n"), "n_nationkey"))).alias("targets"))
    return per.select(F.to_json(F.struct("id", "targets")).alias("json"))
