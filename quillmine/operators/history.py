"""Commits, contributors and ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions.scalars import rounded


#: Files of a commit from which on its pairs are dealt out in blocks of so many files.
BULK = 256


def temporal_coupling(changes: DataFrame) -> DataFrame:
    """Files changed in one commit, from distinct rows (commit, file, at): shared commits and their Jaccard share.

    A commit's files meet in one exchange, which the files' own counts use again, and pairs come from the sorted
    list of them. The list of a bulk commit is cut into blocks, and pairs of blocks are dealt to tasks anew.
    """
    baskets = changes.repartition("commit").groupBy("commit", "file").agg(F.max("at").alias("at"))
    commits = baskets.groupBy("commit").agg(F.sort_array(F.collect_list(F.struct("file", "at"))).alias("f"))
    each = commits.where(F.size("f") <= BULK).select("f", F.posexplode("f").alias("i", "x"))
    pairs = each.select("x", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("y"))
    bulk = commits.where(F.size("f") > BULK).select("f", F.explode(F.sequence(F.lit(0), F.floor((F.size("f") - 1) / BULK).cast("int"))).alias("a"))
    bulk = bulk.select("f", "a", F.explode(F.sequence("a", F.floor((F.size("f") - 1) / BULK).cast("int"))).alias("b"))
    part = lambda c: F.slice("f", F.col(c) * BULK + 1, F.lit(BULK))
    blocks = bulk.select(part("a").alias("p"), part("b").alias("q")).repartition(F.xxhash64("p", "q"))
    met = blocks.select("q", F.explode("p").alias("x")).select("x", F.explode("q").alias("y")).where(F.col("x.file") < F.col("y.file"))
    pairs = pairs.unionByName(met).groupBy(F.col("x.file").alias("left"), F.col("y.file").alias("right")).agg(F.count("*").alias("shared"), F.max("x.at").alias("last_at"))
    alone = baskets.groupBy("file").agg(F.count("*").alias("n"))
    pairs = pairs.join(alone.toDF("left", "n_left"), "left").join(alone.toDF("right", "n_right"), "right")
    strength = rounded(F.col("shared") / (F.col("n_left") + F.col("n_right") - F.col("shared")))
    return pairs.select("left", "right", "shared", strength.alias("strength"), "last_at")


def churn(changes: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Distinct commits per file in the days up to as_of."""
    until = F.lit(as_of).cast("timestamp")
    recent = changes.where((F.col("at") >= until - F.expr(f"interval {days} days")) & (F.col("at") <= until))
    return recent.groupBy("file").agg(F.countDistinct("commit").alias("churn"))


def contributors(changes: DataFrame) -> DataFrame:
    """Commits, added and deleted lines, first and last change per contributor."""
    return changes.groupBy("contributor").agg(
        F.countDistinct("commit").alias("commits"), F.countDistinct("file").alias("files"), rounded(F.sum("added")).alias("additions"),
        rounded(F.sum("deleted")).alias("deletions"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
    )


def ownership(lines: DataFrame, primary: float = 0.5, secondary: float = 0.2) -> DataFrame:
    """Share of each contributor in a file's lines, with its role."""
    per = lines.groupBy("file", "contributor").agg(F.sum("lines").alias("lines"))
    share = F.col("lines") / F.sum("lines").over(Window.partitionBy("file"))
    role = F.when(F.col("exact") >= primary, "primary").when(F.col("exact") >= secondary, "secondary").otherwise("minor")
    return per.withColumn("exact", share).select("file", "contributor", "lines", rounded(F.col("exact")).alias("share"), role.alias("role"))


def bus_factor(lines: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Least number of contributors, largest first, that hold the threshold of a file's lines."""
    per = lines.groupBy("file", "contributor").agg(F.sum("lines").alias("lines"))
    whole = Window.partitionBy("file")
    order = whole.orderBy(F.desc("lines"), "contributor").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.withColumn("before", F.sum("lines").over(order) - F.col("lines")).withColumn("total", F.sum("lines").over(whole))
    return per.groupBy("file").agg(F.sum((F.col("before") < threshold * F.col("total")).cast("long")).alias("bus_factor"))


def normalized_coupling(pairs: DataFrame) -> DataFrame:
    """Strength as a part of the greatest strength."""
    top = pairs.agg(F.max("strength").alias("top"))
    return pairs.crossJoin(F.broadcast(top)).select("left", "right", rounded(F.when(F.col("top") > 0, F.col("strength") / F.col("top")).otherwise(0.0)).alias("weight"))


def trend(points: DataFrame, short: int = 3, long: int = 8, band: float = 0.15) -> DataFrame:
    """Means of the last rows of each file, and whether the short one runs ahead of the long one."""
    order = Window.partitionBy("file").orderBy("at")
    mean = lambda n: F.avg("value").over(order.rowsBetween(-(n - 1), 0))
    last = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("at")))
    rows = points.select("file", mean(short).alias("s"), mean(long).alias("l"), last.alias("n")).where("n = 1")
    ratio = F.when(F.col("l") == 0, F.lit(0.0)).otherwise((F.col("s") - F.col("l")) / F.col("l"))
    way = F.when(F.col("r") > band, "ACCELERATING").when(F.col("r") < -band, "DECELERATING").otherwise("STABLE")
    return rows.withColumn("r", rounded(ratio)).select("file", rounded(F.col("s")).alias("short_mean"), rounded(F.col("l")).alias("long_mean"), F.col("r").alias("ratio"), way.alias("direction"))


def cumulative_share(rows: DataFrame) -> DataFrame:
    """After each change of a file: changes so far, those of its author, and the author's share."""
    running = Window.partitionBy("file").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("file", "author").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("total", F.count("*").over(running)).withColumn("own", F.count("*").over(own))
    return rows.select("id", "file", "author", "total", "own", rounded(F.col("own") / F.col("total")).alias("share"))


def periods(rows: DataFrame) -> DataFrame:
    """Unbroken runs of one author in a file."""
    order = Window.partitionBy("file").orderBy("at", "id")
    new = F.coalesce((F.lag("author").over(order) != F.col("author")).cast("long"), F.lit(1))
    rows = rows.withColumn("new", new).withColumn("period", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("file", "period", "author").agg(F.count("*").alias("changes"), F.min("at").alias("from_at"), F.max("at").alias("to_at"))


def handoffs(rows: DataFrame) -> DataFrame:
    """Changes of author in a file: who handed over to whom, and how often."""
    before = F.lag("author").over(Window.partitionBy("file").orderBy("at", "id"))
    moved = rows.withColumn("from_author", before).where("from_author <> author")
    return moved.groupBy("file", "from_author", F.col("author").alias("to_author")).agg(F.count("*").alias("handoffs"))


def dominant_owner(rows: DataFrame) -> DataFrame:
    """After each change of a file (id, file, author, at): who has made most changes so far, the latest of equals.

    Whoever just made a change wins a tie, so the owner moves to an author exactly when that author's own
    count reaches the highest so far.
    """
    running = Window.partitionBy("file").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    own = F.count("*").over(Window.partitionBy("file", "author").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("own", own).withColumn("most", F.max("own").over(running)).withColumn("total", F.count("*").over(running))
    rows = rows.withColumn("owner", F.last(F.when(F.col("own") == F.col("most"), F.col("author")), ignorenulls=True).over(running))
    before = F.lag("owner").over(Window.partitionBy("file").orderBy("at", "id"))
    return rows.select("id", "file", "author", "at", "total", "own", rounded(F.col("own") / F.col("total")).alias("share"), "owner", before.alias("owner_before"))


def owner_handoffs(rows: DataFrame) -> DataFrame:
    """Changes of the dominant owner: file, from_owner, to_owner, id and at of the change."""
    return dominant_owner(rows).where("owner <> owner_before").select("file", F.col("owner_before").alias("from_owner"), F.col("owner").alias("to_owner"), "id", "at")


def owner_periods(rows: DataFrame) -> DataFrame:
    """Unbroken runs of one dominant owner in a file."""
    order = Window.partitionBy("file").orderBy("at", "id")
    new = F.coalesce((F.col("owner") != F.col("owner_before")).cast("long"), F.lit(1))
    runs = dominant_owner(rows).withColumn("period", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("file", "period", "owner").agg(F.count("*").alias("changes"), F.min("at").alias("from_at"), F.max("at").alias("to_at"))
