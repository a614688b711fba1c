"""The code graph, file trees and scans on the driver's tables, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmine.functions import payloads, scalars
from quillmine.operators import code_graph, file_tree, graphs, review, rules, source_code
from quillmine.plans.registry import query
from quillmine.sources import blueprints, stores
from quillmine.sources.tables import fresh_path, load


def parsed_files(spark, d):
    """Orders as parsed files: their lines declare classes, interfaces and functions, call functions and import the order before."""
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    n = F.col("l_linenumber")
    at = lambda first, last: F.struct((100 * n + first).cast("int").alias("lineStart"), (100 * n + last).cast("int").alias("lineEnd"), F.lit(0).alias("columnStart"), F.lit(0).alias("columnEnd")).alias("location")
    name = lambda letter, c, k: F.concat(F.lit(letter), (F.col(c) % k).cast("string"))
    owner = F.min(F.when(n % 3 == 1, F.struct(n, name("C", "p", 40).alias("name")))).over(Window.partitionBy("l_orderkey"))["name"]
    lines = lines.withColumn("owner", owner)
    classes = F.when(n % 3 == 1, F.struct(name("C", "p", 40).alias("name"), F.lit(True).alias("exported"), F.array(name("C", "s", 40)).alias("extendsTypes"), F.array(F.concat(name("I", "s", 30), F.lit("<T>"))).alias("implementsTypes"), at(0, 99)))
    interfaces = F.when(n % 3 == 2, F.struct(name("I", "p", 30).alias("name"), F.lit(False).alias("exported"), F.array(name("I", "s", 30)).alias("extendsTypes"), at(0, 99)))
    functions = F.struct(name("f", "p", 60).alias("name"), F.lit("function").alias("kind"), F.lit(True).alias("exported"), F.lit(False).alias("async"), F.when(n % 3 == 0, F.col("owner")).alias("parentClassName"), at(0, 50))
    callee = F.when(n % 3 == 0, F.concat(F.lit("this."), name("f", "s", 60))).when(n % 3 == 1, name("f", "s", 60)).otherwise(F.concat(name("C", "s", 40), F.lit("."), name("f", "p", 60)))
    calls = F.struct(name("f", "p", 60).alias("caller"), callee.alias("callee"), at(10, 10))
    each = {"classes": classes, "interfaces": interfaces, "functions": functions, "calls": calls}
    held = lines.groupBy("l_orderkey").agg(*[F.collect_list(c).alias(k) for k, c in each.items()])
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = orders.withColumn("before", before)
    end = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(".ts")
    folder = F.concat(F.lit("src/m"), F.col("o_custkey").cast("string"), F.lit("/"))
    where = F.struct(F.lit(1).alias("lineStart"), F.lit(1).alias("lineEnd"), F.lit(0).alias("columnStart"), F.lit(0).alias("columnEnd")).alias("location")
    imports = F.filter(F.array(F.struct(F.concat(F.lit("./x/../o"), F.col("before").cast("string"), end).alias("source"), where)), lambda i: i["source"].isNotNull())
    none = {"typeAliases": "array<struct<name: string, exported: boolean, location: struct<lineStart: int, lineEnd: int, columnStart: int, columnEnd: int>>>", "enums": "array<struct<name: string, exported: boolean, members: array<string>, location: struct<lineStart: int, lineEnd: int, columnStart: int, columnEnd: int>>>"}
    rows = orders.join(held, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    empty = [F.lit(None).cast(kind).alias(k) for k, kind in none.items()]
    return rows.select(F.concat(folder, F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".ts")).alias("filePath"), F.lit("typescript").alias("language"), F.lit(False).alias("hasSyntaxErrors"), imports.alias("imports"), *each, *empty)


PARSED = """
WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
f AS (SELECT o_orderkey AS o, 'src/m' || o_custkey || '/o' || o_orderkey || '.ts' AS file, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, o_custkey FROM orders),
x AS (SELECT f.file, n, p, s, arg_min('C' || p % 40, n) FILTER (n % 3 = 1) OVER (PARTITION BY l.o) AS owner FROM l JOIN f USING (o)),
c AS (SELECT file, 'C' || p % 40 AS name, 'class:' || file || ':C' || p % 40 || ':' || 100 * n AS id, 'C' || s % 40 AS up, 'I' || s % 30 AS does FROM x WHERE n % 3 = 1),
i AS (SELECT file, 'I' || p % 30 AS name, 'type:' || file || ':interface:I' || p % 30 || ':' || 100 * n AS id, 'I' || s % 30 AS up FROM x WHERE n % 3 = 2),
u AS (SELECT file, n, 'f' || p % 60 AS name, CASE WHEN n % 3 = 0 THEN owner END AS parent, s, p FROM x),
fn AS (SELECT *, 'function:' || file || ':' || coalesce(parent, 'global') || ':' || name || ':' || 100 * n AS id, CASE n % 3 WHEN 0 THEN parent || '.f' || s % 60 WHEN 1 THEN 'f' || s % 60 ELSE 'C' || s % 40 || '.f' || p % 60 END AS callee FROM u)
"""


@query("s11_graph_nodes", PARSED + "SELECT id, 'class' AS type, name, file AS file_path FROM c UNION ALL SELECT id, 'type', name, file FROM i UNION ALL SELECT id, 'function', concat_ws('.', parent, name), file FROM fn UNION ALL SELECT 'file:' || file, 'file', string_split(file, '/')[-1], file FROM f")
def _(spark, d):
    return code_graph.nodes(parsed_files(spark, d)).drop("metadata")


@query("g11_graph_edges", PARSED + """,
im AS (SELECT a.file, b.file AS target FROM f a JOIN f b ON a.before = b.o),
re AS (SELECT file, target FROM im UNION SELECT file, file FROM f),
ty AS (SELECT file, name, id, true AS cl FROM c UNION ALL SELECT file, name, id, false FROM i),
one AS (SELECT name, min(id) AS id, bool_or(cl) AS cl FROM ty GROUP BY 1 HAVING count(*) = 1),
dc AS (SELECT file, name, min(id) AS declared FROM c GROUP BY 1, 2), di AS (SELECT file, name, min(id) AS declared FROM i GROUP BY 1, 2),
us AS (SELECT DISTINCT c.file, declared, up AS name, 'EXTENDS' AS type, true AS cl FROM c JOIN dc USING (file, name) UNION SELECT c.file, declared, does, 'IMPLEMENTS', false FROM c JOIN dc USING (file, name) UNION SELECT i.file, declared, up, 'EXTENDS', false FROM i JOIN di USING (file, name)),
nt AS (SELECT us.*, ty.id FROM us JOIN re USING (file) JOIN ty ON ty.file = re.target AND ty.name = us.name AND ty.cl = us.cl),
te AS (SELECT declared AS source, id AS target, type FROM nt UNION SELECT us.declared, one.id, us.type FROM us JOIN one USING (name, cl) WHERE NOT EXISTS (SELECT 1 FROM re JOIN ty ON ty.file = re.target WHERE re.file = us.file AND ty.name = us.name)),
ix AS (SELECT file, name, id FROM fn UNION ALL SELECT file, parent || '.' || name, id FROM fn WHERE parent IS NOT NULL),
un AS (SELECT name, min(id) AS id FROM ix GROUP BY 1 HAVING count(*) = 1),
ca AS (SELECT DISTINCT file, id AS source, callee AS name, contains(callee, '.') AS dotted FROM fn WHERE callee IS NOT NULL),
hi AS (SELECT ca.*, ix.id AS target, re.target <> ca.file AS imported, max(CASE WHEN re.target <> ca.file THEN 1 ELSE 0 END) OVER (PARTITION BY ca.source, ca.name) AS others FROM ca JOIN re USING (file) JOIN ix ON ix.file = re.target AND ix.name = ca.name),
ce AS (SELECT source, target FROM hi WHERE dotted OR imported = (others = 1) UNION SELECT source, un.id FROM ca JOIN un USING (name) WHERE NOT dotted AND NOT EXISTS (SELECT 1 FROM hi WHERE hi.source = ca.source AND hi.name = ca.name))
SELECT 'file:' || file AS source, 'file:' || target AS target, 'IMPORTS' AS type FROM im UNION SELECT declared, fn.id, 'HAS_METHOD' FROM fn JOIN dc ON dc.file = fn.file AND dc.name = fn.parent UNION SELECT * FROM te UNION SELECT source, target, 'CALLS' FROM ce""")
def _(spark, d):
    return code_graph.edges(parsed_files(spark, d))


# Hosts are folders, the rest of an address is a path in them.
IGNORES = [(".gitignore", "*.html\n!*keep*\n# note\nblog.*\n/m.**/25*\n"), ("www/.gitignore", "x"), ("spam-farm.example.org/.gitignore", "en/\n!en\n7*\n")]


def url_tree(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$|/+$", "")
    blobs = load(spark, d, "pages").select(F.regexp_replace(path, "/+$", "").alias("path")).where("path <> ''").distinct()
    parts = F.split("path", "/")
    ups = blobs.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("path")).distinct()
    return blobs.withColumn("type", F.lit("blob")).unionByName(ups.withColumn("type", F.lit("tree")))


@query("s6_visible_tree", r"""
WITH b AS (SELECT DISTINCT rtrim(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS path FROM pages), bl AS (SELECT path, 'blob' AS type FROM b WHERE path <> ''),
t AS (SELECT * FROM bl UNION ALL SELECT DISTINCT array_to_string(string_split(path, '/')[1:i], '/'), 'tree' FROM bl, range(1, 20) r(i) WHERE i < len(string_split(path, '/'))),
w AS (SELECT path, type, string_split(path, '/') AS p, i AS k, (type = 'tree' OR i < len(string_split(path, '/'))) AS folder FROM t, range(1, 20) r(i) WHERE i <= len(string_split(path, '/'))),
m AS (SELECT path, type, 1 AS place, false AS negated FROM w WHERE regexp_full_match(p[k], '[^/]*\.html') UNION ALL SELECT path, type, 2, true FROM w WHERE regexp_full_match(p[k], '[^/]*keep[^/]*')
 UNION ALL SELECT path, type, 3, false FROM w WHERE regexp_full_match(p[k], 'blog\.[^/]*') UNION ALL SELECT path, type, 4, false FROM w WHERE regexp_full_match(array_to_string(p[1:k], '/'), 'm\..*/25[^/]*')
 UNION ALL SELECT path, type, 5, false FROM w WHERE p[1] = 'spam-farm.example.org' AND k > 1 AND folder AND p[k] = 'en' UNION ALL SELECT path, type, 6, true FROM w WHERE p[1] = 'spam-farm.example.org' AND k > 1 AND p[k] = 'en'
 UNION ALL SELECT path, type, 7, false FROM w WHERE p[1] = 'spam-farm.example.org' AND k > 1 AND regexp_full_match(p[k], '7[^/]*')),
g AS (SELECT path, type, arg_max(negated, place) AS negated FROM m GROUP BY 1, 2),
v AS (SELECT t.* FROM t LEFT JOIN g USING (path, type) WHERE coalesce(g.negated, true))
SELECT path, type FROM v WHERE type = 'blob' OR EXISTS (SELECT 1 FROM v x WHERE starts_with(x.path, v.path || '/'))""")
def _(spark, d):
    return file_tree.visible_tree(url_tree(spark, d), spark.createDataFrame(IGNORES, "path string, content string"))


@query("s2_incremental_scan", r"""
WITH h AS (SELECT source AS repository, 'd' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.go' ELSE '.txt' END AS path, text FROM documents),
b AS (SELECT source AS repository, 'd' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.go' ELSE '.txt' END AS path, CASE WHEN lang = 'en' THEN text ELSE 'old ' || text END AS text FROM documents)
SELECT repository, CASE split_part(path, '.', 2) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' ELSE 'go' END AS language, count(*) AS files, CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')))) AS BIGINT) AS loc
FROM h WHERE NOT path LIKE '%.txt' AND NOT EXISTS (SELECT 1 FROM b WHERE b.repository = h.repository AND b.path = h.path AND b.text = h.text) GROUP BY 1, 2""")
def _(spark, d):
    end = F.element_at(F.array(*map(F.lit, (".py", ".ts", ".go", ".txt"))), (F.col("doc_id") % 4 + 1).cast("int"))
    head = load(spark, d, "documents").select(F.col("source").alias("repository"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), end).alias("path"), "text", "lang")
    base = head.withColumn("text", F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat(F.lit("old "), "text")))
    return file_tree.scan_totals(file_tree.scanned(file_tree.changed_files(base, head.drop("lang")))).drop("nodes", "edges")


@query("x11_canonical", r"""SELECT event_id, '{"a":[{"t":"' || event_type || '","u":' || user_id || '}],"k":' || json_extract_string(props, '$.k') || '}' AS body FROM events""")
def _(spark, d):
    mixed = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "a": [ {"u": '), F.col("user_id").cast("string"), F.lit(', "t": "'), "event_type", F.lit('"} ]}'))
    return load(spark, d, "events").select("event_id", payloads.canonical(mixed).alias("body"))


@query("x11_marked_dates", r"""SELECT o_orderkey, '{"id":' || o_orderkey || ',"seen":[{"at":{"$date":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') || '"}}]}' AS body FROM orders""")
def _(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_orderkey").alias("id"), F.array(F.struct(F.col("o_orderdate").alias("at"))).alias("seen")).alias("v"))
    kind = rows.schema["v"].dataType
    # Written, read and written again.
    body = payloads.serialized(F.col("v"), kind)
    return rows.select("o_orderkey", payloads.serialized(payloads.deserialized(body, kind), kind).alias("body"))


@query("s14_blueprint_rules", """
SELECT n_regionkey AS id, least(n_name, r_name) AS source, greatest(n_name, r_name) AS target, CASE WHEN n_nationkey % 2 = 0 THEN 'allow' ELSE 'forbid' END AS mode
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 3""")
def _(spark, d):
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rule = F.struct(F.least("n_name", "r_name").alias("source"), F.greatest("n_name", "r_name").alias("target"), F.when(F.col("n_nationkey") % 2 == 0, "allow").otherwise("forbid").alias("mode"))
    name = F.struct(F.concat(F.lit(" "), "n_name").alias("name"), F.array("r_name").alias("allow"))
    held = n.groupBy(F.col("n_regionkey").alias("id"), "r_name").agg(F.collect_list(rule).alias("rules"), F.collect_list(name).alias("layers"))
    layers = F.concat("layers", F.array(F.struct(F.col("r_name").alias("name"), F.array().cast("array<string>").alias("allow"))))
    # One blueprint has no version that counts.
    text = F.to_json(F.struct(F.when(F.col("id") == 3, 0.5).otherwise(1.0).alias("version"), layers.alias("layers"), "rules"))
    return blueprints.parse_blueprints(held.select("id", text.alias("text"))).rules


@query("p2_rule_dispatch", r"""
WITH f AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT rule, CAST(count(*) AS BIGINT) AS findings, count(DISTINCT doc_id) AS files, CAST(sum(n) AS BIGINT) AS lines FROM
 (SELECT 'worthless' AS rule, doc_id, n FROM f WHERE contains(line, 'worthless') UNION ALL SELECT 'numbers', doc_id, n FROM f WHERE regexp_matches(line, '[0-9]{4,}') UNION ALL SELECT 'wide', doc_id, n FROM f WHERE length(line) > 400) GROUP BY 1""")
def _(spark, d):
    kinds = [("worthless", "REGEX", "Word", "worthless", "HIGH"), ("numbers", "REGEX", "Numbers", "[0-9]{4,}", "LOW"), ("wide", "AST", "Wide", "400", "MEDIUM"), ("tone", "PROMPT", "Tone", "be kind", "LOW")]

    def wide(path: str, content: str, rule: str):
        return [(n, n, f"more than {rule}", None) for n, line in enumerate(content.split("\n"), 1) if len(line) > int(rule)]

    given = spark.createDataFrame(kinds, "id string, type string, title string, rule string, severity string")
    found = rules.dispatch(load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")), given, wide)
    return found.groupBy("rule").agg(F.count("*").alias("findings"), F.countDistinct("path").alias("files"), F.sum("line_start").alias("lines"))


@query("x14_embeddings", "SELECT doc_id, CAST(length(text) AS DOUBLE) AS size, CAST(length(replace(text, 'e', 'ee')) - length(text) AS DOUBLE) AS es FROM documents")
def _(spark, d):
    found = rules.embedded(load(spark, d, "documents").select("doc_id", "text"), lambda texts: [[len(t), t.count("e")] for t in texts])
    return found.select("doc_id", F.col("embedding")[0].alias("size"), F.col("embedding")[1].alias("es"))


@query("j7_import_targets", PARSED + "SELECT a.file, b.file AS target FROM f a JOIN f b ON a.before = b.o")
def _(spark, d):
    return code_graph.import_targets(parsed_files(spark, d))


@query("x15_semantic_roles", PARSED + """,
g AS (SELECT 'src/' || CASE o_custkey % 4 WHEN 0 THEN 'domain' WHEN 1 THEN 'utils' WHEN 2 THEN 'application' ELSE 'adapters' END || '/o' || f.o || '.ts' AS file, coalesce(k, 0) AS k, coalesce(i, 0) AS i, coalesce(n, 0) AS n, CASE WHEN before IS NULL THEN 0 ELSE 1 END AS m, o_custkey % 4 AS z
 FROM f LEFT JOIN (SELECT file, count(*) AS n, count(*) FILTER (n % 3 = 1) AS k, count(*) FILTER (n % 3 = 2) AS i FROM x GROUP BY 1) USING (file)),
s AS (SELECT file, CASE WHEN z = 3 THEN 3 ELSE 0 END AS a, CASE WHEN z = 0 THEN 3 ELSE 0 END + CASE WHEN k > 0 AND n > 0 THEN 2 ELSE 0 END AS b, CASE WHEN z = 2 THEN 3 ELSE 0 END + CASE WHEN m > 0 AND n > 0 THEN 1 ELSE 0 END AS c, CASE WHEN z = 1 THEN 3 ELSE 0 END + CASE WHEN n >= 3 AND k = 0 THEN 3 ELSE 0 END AS u,
 CASE WHEN k + n >= 3 THEN 2 ELSE 0 END + CASE WHEN i >= 2 THEN 2 ELSE 0 END + CASE WHEN n = 0 AND k > 0 THEN 1 ELSE 0 END AS p FROM g), t AS (SELECT *, greatest(0, a, b, c, u, p) AS w FROM s), r AS (SELECT *, least(1.0, floor(w / 8 * 100 + 0.5) / 100) AS confidence FROM t)
SELECT file, CASE WHEN confidence < 0.4 THEN 'UNKNOWN' WHEN a = w THEN 'INFRASTRUCTURE_ADAPTER' WHEN b = w THEN 'DOMAIN_MODEL' WHEN c = w THEN 'APPLICATION_SERVICE' WHEN u = w THEN 'UTILITY_MODULE' ELSE 'API_SURFACE' END AS role, CAST(confidence AS DOUBLE) AS confidence FROM r""")
def _(spark, d):
    rows = parsed_files(spark, d)
    key = F.regexp_extract("filePath", "m([0-9]+)/", 1).cast("long") % 4
    folder = F.when(key == 0, "domain").when(key == 1, "utils").when(key == 2, "application").otherwise("adapters")
    rows = rows.withColumn("filePath", F.concat(F.lit("src/"), folder, F.lit("/"), F.substring_index("filePath", "/", -1)))
    return code_graph.semantic_roles(rows, 0.4).drop("signals")


@query("f14_context_gate", "WITH r AS (SELECT p_partkey AS file, p_brand AS fingerprint, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 7 AS batch FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)) SELECT fingerprint, batch, string_agg(CAST(file AS VARCHAR), ',' ORDER BY file) AS files FROM r GROUP BY 1, 2")
def _(spark, d):
    context = load(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_partkey").alias("file"))
    rows = review.context_gate(load(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("fingerprint")), context, 7)
    return rows.withColumn("files", F.array_join(F.col("files").cast("array<string>"), ","))


@query("g14_federated_nodes", "SELECT 'a:' || s_suppkey AS id, 'a' AS repository, CAST(s_suppkey AS VARCHAR) AS original_id, s_name AS name FROM supplier UNION ALL SELECT 'b:' || p_partkey, 'b', CAST(p_partkey AS VARCHAR), p_name FROM part")
def _(spark, d):
    a = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    none = load(spark, d, "nation").select(F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("target"))
    return graphs.federated_graphs({"a": (a, none), "b": (b, none)})[0]


@query("x1_normalized_paths", r"SELECT page_id, replace(replace(url, '//', '/'), '/', '/') AS path FROM pages")
def _(spark, d):
    mixed = F.concat(F.lit("  "), F.replace(F.replace("url", F.lit("//"), F.lit("/")), F.lit("/"), F.lit("\\")), F.lit(" "))
    return load(spark, d, "pages").select("page_id", source_code.normalized_path(mixed).alias("path"))


@query("x4_cosine", "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.id, floor(greatest(-1, least(1, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))))) * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS similarity FROM v a JOIN v b ON b.id = a.id + 1")
def _(spark, d):
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    after = rows.select((F.col("id") - 1).alias("id"), F.col("v").alias("w"))
    return rows.join(after, "id").select("id", scalars.rounded(scalars.cosine(F.col("v"), F.col("w")), 6).alias("similarity"))


@query("x6_code_lines", r"""
WITH f AS (SELECT doc_id, doc_id % 3 AS k, text FROM documents), l AS (SELECT doc_id, k, unnest(string_split(text, chr(10))) AS line FROM f)
SELECT doc_id, CASE k WHEN 0 THEN 'python' WHEN 1 THEN 'ruby' ELSE 'typescript' END AS language, CAST(count(*) FILTER (regexp_matches(line, '\S') AND NOT regexp_matches(line, '["''#/*`]')) AS BIGINT) AS plain FROM l GROUP BY 1, 2""")
def _(spark, d):
    """Lines without quotes or comment marks, which count alike in every language."""
    end = F.element_at(F.array(*map(F.lit, ("x.py", "Rakefile", "x.ts"))), (F.col("doc_id") % 3 + 1).cast("int"))
    plain = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike("[\"'#/*`]")), "\n")
    rows = load(spark, d, "documents").select("doc_id", source_code.detected_language(F.concat(F.lit("a/"), end), F.col("text"), strict=True).alias("language"), plain.alias("text"))
    return rows.select("doc_id", "language", source_code.code_lines(F.col("language"), F.col("text")).cast("long").alias("plain"))


@query("x8_detected_languages", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'ruby' WHEN 1 THEN 'tsx' WHEN 2 THEN 'python' WHEN 3 THEN 'javascript' END AS language FROM documents")
def _(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("src\\GemFile", "a/B.TSX", "tool", "run", "note.txt"))), (F.col("doc_id") % 5 + 1).cast("int"))
    text = F.when(F.col("doc_id") % 5 == 2, F.concat(F.lit("#!/usr/bin/env python3\n"), "text")).when(F.col("doc_id") % 5 == 3, F.concat(F.lit("#!/usr/bin/node\n"), "text")).otherwise(F.col("text"))
    return load(spark, d, "documents").select("doc_id", source_code.detected_language(name, text).alias("language"))


@query("x10_rounding", "SELECT event_id, floor((value - 50) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS four, floor((value - 50) / 3 * 1e6::DOUBLE + 0.5) / 1e6::DOUBLE AS six FROM events")
def _(spark, d):
    return load(spark, d, "events").select("event_id", scalars.rounded(F.col("value") - 50).alias("four"), scalars.rounded((F.col("value") - 50) / 3, 6).alias("six"))


@query("x18_severity", "SELECT o_orderkey, CASE WHEN substr(o_orderpriority, 3) IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL', 'INFO') THEN substr(o_orderpriority, 3) END AS severity FROM orders")
def _(spark, d):
    text = F.concat(F.lit(" "), F.lower(F.substr("o_orderpriority", F.lit(3))))
    return load(spark, d, "orders").select("o_orderkey", scalars.severity(F.trim(text), ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")).alias("severity"))


@query("s8_snapshots", """
SELECT o_orderkey AS node, o_orderstatus AS scope, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS version FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority <> '5-LOW'""")
def _(spark, d):
    """All states are saved, then one again with fewer rows; the others stay."""
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.col("o_orderstatus").alias("scope"), "o_orderpriority")
    path = fresh_path(spark, "snapshots")
    stores.save_scopes(rows.select("node", "scope", F.lit(1).alias("version")), path)
    stores.save_scopes(rows.where("scope = 'F' and o_orderpriority <> '5-LOW'").select("node", "scope", F.lit(2).alias("version")), path)
    return spark.read.parquet(path)


@query("s13_graph_lines", """
SELECT 0 AS kind, '{"id":"s' || s_suppkey || '","label":"' || s_name || '"}' AS line FROM supplier UNION ALL SELECT 0, '{"id":"n' || n_nationkey || '","label":"n' || n_nationkey || '"}' FROM nation
UNION ALL SELECT 1, '{"id":"s' || s_suppkey || '|IN|n' || s_nationkey || '","source":"s' || s_suppkey || '","target":"n' || s_nationkey || '","type":"IN"}' FROM supplier""")
def _(spark, d):
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    s = load(spark, d, "supplier")
    nodes = s.select(key("s", "s_suppkey").alias("id"), F.col("s_name").alias("label")).unionByName(load(spark, d, "nation").select(key("n", "n_nationkey").alias("id"), F.lit(None).cast("string").alias("label")))
    return stores.graph_lines(nodes, s.select(key("s", "s_suppkey").alias("source"), key("n", "s_nationkey").alias("target"), F.lit("IN").alias("type")))
