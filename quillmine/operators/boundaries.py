"""Borders between modules and packages, planned against built structure, contracts and shared state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmine.functions.scalars import glob_pattern
from quillmine.sources.tables import rewritten

#: Files that hold a contract of one name, and files that a file reaches, which are listed beside a declared name.
HOLDERS, TARGETS = 16, 256


def module_of(path: Column, modules: dict[str, list[str]]) -> Column:
    """The module whose globs match a path, null if none does; two matching modules are an error."""
    hits = [F.when(F.greatest(*[path.rlike(glob_pattern(g)) for g in (*globs, globs[-1])]), name) for name, globs in sorted(modules.items())]
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) > 1, F.raise_error(F.concat(F.lit("more than one module matches "), path)).cast("string")).otherwise(F.get(found, F.lit(0)))


def module_violations(imports: DataFrame, modules: dict[str, list[str]]) -> DataFrame:
    """Imports (source, target) from one module into another; paths that no module matches are skipped."""
    both = imports.select("source", "target", module_of(F.col("source"), modules).alias("source_module"), module_of(F.col("target"), modules).alias("target_module"))
    return both.where("source_module <> target_module").distinct()


def package_of(path: Column) -> Column:
    """The second part of packages/<name>/..., null for any other path."""
    return F.nullif(F.trim(F.regexp_extract(path, "^packages/([^/]*)/", 1)), F.lit(""))


def package_violations(imports: DataFrame, packages: DataFrame, declared: DataFrame, alias: str) -> DataFrame:
    """Wrong imports (source, specifier, resolved) between packages (package, declares).

    A resolved path in another package is CROSS_PACKAGE (HIGH). A specifier that starts with the alias names
    a package: the own one (LOW), one that doesn't exist (MEDIUM), or one that declared (package, target)
    lacks (MEDIUM), unless the package declares nothing at all. Imports from outside of packages are dropped.
    """
    named = F.nullif(F.substring_index(F.substr("specifier", F.lit(len(alias) + 1)), "/", 1), F.lit(""))
    rows = imports.select("source", "specifier", package_of(F.col("source")).alias("package"), package_of(F.col("resolved")).alias("met"), F.when(F.col("specifier").startswith(alias), named).alias("target")).distinct()
    direct = rows.where("met <> package").select("source", "specifier", "package", F.col("met").alias("target"), F.lit("CROSS_PACKAGE").alias("kind"), F.lit("HIGH").alias("severity"))
    known = packages.select(F.col("package").alias("target")).distinct().withColumn("known", F.lit(True))
    own = packages.groupBy("package").agg(F.max("declares").alias("declares"))
    said = declared.select("package", "target").distinct().withColumn("said", F.lit(True))
    asked = rows.where("package is not null and target is not null").join(known, "target", "left").join(own, "package", "left").join(said, ["package", "target"], "left")
    kind = F.when(F.col("target") == F.col("package"), "SELF_PACKAGE").when(F.col("known").isNull(), "UNKNOWN_PACKAGE").when(F.col("declares") & F.col("said").isNull(), "UNDECLARED")
    asked = asked.withColumn("kind", kind).where("kind is not null").withColumn("severity", F.when(F.col("kind") == "SELF_PACKAGE", "LOW").otherwise("MEDIUM"))
    return direct.unionByName(asked.select(direct.columns))


def structure_differences(planned: DataFrame, built: DataFrame) -> DataFrame:
    """Modules (layer, module, depends) planned and built: missing, unexpected or match; a match may still differ in what it depends on.

    Of rows with equal keys the greatest counts.
    """
    side = lambda df, name: df.groupBy("layer", "module").agg(F.max(F.concat_ws(",", "depends")).alias(name))
    both = side(planned, "p").join(side(built, "b"), ["layer", "module"], "full")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("p").isNull(), "unexpected").otherwise("match")
    return both.select("layer", "module", status.alias("status"), (F.col("p") == F.col("b")).alias("same_direction"))


def shared_state(methods: DataFrame, imports: DataFrame, prefixes: list[str], least: int = 2, high: int = 5) -> DataFrame:
    """Exported symbols (file, symbol, method) with methods of a mutating name that at least so many files import.

    imports are (consumer, file, symbols); an empty list of symbols imports all of a file.
    """
    name = F.lower(F.trim("method"))
    mutating = methods.where(F.greatest(*[name.startswith(p) for p in (*prefixes, prefixes[-1])]))
    state = mutating.groupBy("file", "symbol").agg(F.array_sort(F.collect_set("method")).alias("mutators"))
    known = imports.where("consumer is not null")
    whole = known.where(F.size("symbols") == 0).select("consumer", "file").distinct()
    single = known.where(F.size("symbols") > 0).select("consumer", "file", F.explode("symbols").alias("symbol")).distinct()
    # Those who import all of a file are counted once for the file; beside them, only who doesn't is counted by symbol.
    every = whole.groupBy("file").agg(F.count("*").alias("every"))
    some = single.join(whole, ["file", "consumer"], "left_anti").groupBy("file", "symbol").agg(F.count("*").alias("some"))
    n = state.join(some, ["file", "symbol"], "left").join(every, "file", "left")
    n = n.select("file", "symbol", (F.coalesce("some", F.lit(0)) + F.coalesce("every", F.lit(0))).alias("consumers"), "mutators").where(F.col("consumers") >= least)
    return n.withColumn("severity", F.when(F.col("consumers") >= high, "HIGH").otherwise("MEDIUM"))


def _listed(pairs: DataFrame, key: str, item: Column, most: int, **figures: Column) -> DataFrame:
    """(key, figures, many, items): per key its items as a list, or null and many where there are more than that."""
    sizes = pairs.groupBy(key).agg((F.count("*") > most).alias("many"), *[c.alias(n) for n, c in figures.items()])
    few = pairs.join(sizes.where("not many"), key, "left_semi").groupBy(key).agg(F.collect_list(item).alias("items"))
    return rewritten(sizes.join(few, key, "left"))


def declared_contracts(declared: DataFrame, contracts: DataFrame, reachable: DataFrame) -> DataFrame:
    """Wrong contracts (file, declaration, position, name): DUPLICATE (LOW) from the second of a declaration on, MISSING (HIGH), AMBIGUOUS (MEDIUM).

    Of the contracts (name, file) those of the same file come first, then those in files reachable (file, target), then all.
    A name that one contract has is right wherever that is. Else a declared name looks its few holders up among its file's
    few targets; where either are many, its file and name go by the shorter way, so that contracts never meet all files
    that reach them.
    """
    rows = declared.where(F.length(F.trim("name")) > 0).groupBy("file", "declaration", F.trim("name").alias("name")).agg(F.count("*").cast("int").alias("times"))
    here = rewritten(contracts.where("name is not null").groupBy("name", "file").agg(F.count("*").alias("same")))
    reach = rewritten(reachable.where("file is not null and target is not null").select("file", "target").distinct())
    per = _listed(here, "name", F.struct("file", "same"), HOLDERS, all=F.sum("same")).toDF("name", "spread", "all", "held")
    ways = _listed(reach, "file", F.col("target"), TARGETS).toDF("file", "wide", "targets")
    rows = rows.join(per, "name", "left")
    asks = F.coalesce(F.col("all") > 1, F.lit(False))
    rows = rows.withColumn("asks", asks).join(ways.withColumn("asks", F.lit(True)), ["file", "asks"], "left")
    total = lambda keeps: F.aggregate(F.filter("held", keeps), F.lit(None).cast("long"), lambda n, x: F.coalesce(n, F.lit(0).cast("long")) + x["same"])
    found = F.coalesce(total(lambda x: x["file"] == F.col("file")), total(lambda x: F.array_contains("targets", x["file"])))
    apart = F.col("asks") & (F.col("spread") | F.coalesce("wide", F.lit(False)))
    rows = rows.withColumn("found", found)
    if not per.where("spread").isEmpty() or not ways.where("wide").isEmpty():
        asked = rows.where(apart).select("file", "name", "held").distinct()
        by_holder = asked.where("held is not null").select("file", "name", F.explode("held").alias("h")).select("file", "name", F.col("h.file").alias("target"), "h.same").join(reach, ["file", "target"])
        by_target = asked.where("held is null").join(reach, "file").join(here.withColumnRenamed("file", "target"), ["name", "target"])
        near = by_holder.select("file", "name", "same").unionByName(by_target.select("file", "name", "same")).groupBy("file", "name").agg(F.sum("same").alias("near"))
        rest = rows.where(apart).drop("found").join(here, ["name", "file"], "left").join(near, ["name", "file"], "left").withColumn("found", F.coalesce("same", "near"))
        rows = rows.where(~apart).unionByName(rest.select(rows.columns))
    n = F.coalesce("found", "all", F.lit(0))
    one = lambda issue, severity: F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"))
    again = F.array_repeat(one("DUPLICATE", "LOW"), F.col("times") - 1)
    wrong = F.when(n == 0, F.array(one("MISSING", "HIGH"))).when(n > 1, F.array(one("AMBIGUOUS", "MEDIUM"))).otherwise(F.slice(F.array(one("", "")), 1, 0))
    return rows.select("file", "declaration", "name", F.explode(F.concat(again, wrong)).alias("i")).select("file", "declaration", "name", "i.issue", "i.severity")


def filter_chain(rows: DataFrame, filters: list[tuple[str, Column]], key: str, budget: int) -> DataFrame:
    """Marks what filters (name, keeps) discard, in turn and in the order of key, until the budget is spent.

    Discards beyond the budget go back behind the rows that passed. Adds discarded_by (null: passed) and
    place, the order that the passed rows have at the end. Only as many keys as the budget allows meet in one task.
    """
    now, gone, left = rows.withColumn("place", F.array(F.col(key).cast("long"))), [], budget
    for name, keeps in filters:
        keep = F.coalesce(keeps, F.lit(False))
        cut = now.where(~keep).orderBy("place").limit(left).select(key, F.lit(name).alias("discarded_by"))
        left -= cut.count()
        marked = now.join(cut, key, "left")
        gone.append(marked.where("discarded_by is not null"))
        now = marked.where("discarded_by is null").drop("discarded_by").withColumn("place", F.concat(F.array((~keep).cast("long")), "place"))
    out = now.withColumn("discarded_by", F.lit(None).cast("string"))
    for g in gone:
        out = out.unionByName(g)
    return out


def metadata_filter(value: dict, parent: str = "") -> Column:
    """The condition that a nested filter states: scalars are equal, None is null, a list holds the value; all must be true.

    Nested keys are joined by dots. Empty keys, empty lists, lists of mixed kinds and other values are errors.
    """
    out = F.lit(True)
    for raw, v in value.items():
        if not raw.strip():
            raise ValueError(f"empty key under {parent or '<root>'}")
        path = f"{parent}.{raw.strip()}" if parent else raw.strip()
        if isinstance(v, dict):
            out &= metadata_filter(v, path)
        elif v is None:
            out &= F.col(path).isNull()
        elif isinstance(v, (bool, int, float, str)):
            out &= F.col(path) == F.lit(v)
        elif isinstance(v, list) and v and (all(isinstance(x, str) for x in v) or all(isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < float("inf") for x in v)):
            out &= F.col(path).isin(v)
        else:
            raise ValueError(f"unsupported filter value at {path}")
    return out


def seeded_bucket(text: Column) -> Column:
    """A 32-bit hash of a text's UTF-16 units (exclusive or, then the multiplication of the FNV hash)."""
    step = lambda h, unit: (h.bitwiseXOR(unit) * F.lit(16777619)) % F.lit(1 << 32)

    def take(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        over = code - 0x10000
        pair = step(step(h, F.lit(0xD800) + F.shiftright(over, 10)), F.lit(0xDC00) + over.bitwiseAND(F.lit(0x3FF)))
        return F.when(code < 0x10000, step(h, code)).otherwise(pair)

    # fixed value: the hash's first state
    return F.when(F.length(text) == 0, F.lit(2166136261)).otherwise(F.aggregate(F.split(text, ""), F.lit(2166136261), take))


def shared_features(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Adds shared, united and jaccard of two columns of arrays; two empty sets are alike."""
    shared, united = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return pairs.withColumn("shared", shared).withColumn("united", united).withColumn("jaccard", F.when(F.col("united") == 0, 1.0).otherwise(F.col("shared") / F.col("united")))
