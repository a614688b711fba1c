"""Scores and costs of files, teams and plans, as column expressions and grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmine.functions.scalars import rounded

#: Weights of a risk score's five factors, and the scores where its levels begin.
RISK_WEIGHTS = (0.35, 0.15, 0.2, 0.2, 0.1)
RISK_LEVELS = ((75, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM"))
#: Penalties of an architecture's health, and points of a method.
TARGET_PENALTY, LAYER_PENALTY, METHOD_POINTS = 4, 8, 16


def whole(x: Column) -> Column:
    """The nearest whole number, halves up."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def record_cost(prices: dict[str, tuple[float, float, float]], default: tuple[float, float, float]) -> Column:
    """The cost of one usage (model, input, output, reasoning), to six places; prices are those of a thousand tokens of each kind."""
    if any(p < 0 for own in (default, *prices.values()) for p in own):
        raise ValueError("prices must not be negative")
    cost = F.lit(0.0)
    for i, kind in enumerate(("input", "output", "reasoning")):
        price = F.lit(float(default[i]))
        for model, own in prices.items():
            price = F.when(F.col("model") == model, float(own[i])).otherwise(price)
        cost = cost + F.coalesce(kind, F.lit(0)) / 1000.0 * price
    return rounded(cost, 6)


def cost_by_model(usage: DataFrame, prices: dict[str, tuple[float, float, float]], default: tuple[float, float, float]) -> DataFrame:
    """(model, tokens, cost) of usage (model, input, output, reasoning, total): costs of records, each to six places, added up."""
    return usage.groupBy("model").agg(F.sum("total").alias("tokens"), rounded(F.sum(record_cost(prices, default)), 6).alias("cost"))


def total_cost(by_model: DataFrame) -> DataFrame:
    """One row: the tokens and cost of all models."""
    return by_model.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), rounded(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"))


def risk(factors: list[Column]) -> tuple[Column, Column]:
    """Score of five factors of 0 to 100, to two places, and its level."""
    score = rounded(sum((f * w for f, w in zip(factors, RISK_WEIGHTS, strict=True)), F.lit(0.0)), 2)
    level = F.lit("LOW")
    for least, name in reversed(RISK_LEVELS):
        level = F.when(score >= least, name).otherwise(level)
    return score, level


def confidence(bugs: Column, churn: Column, complexity: Column) -> Column:
    return clamp(whole(45 + bugs * 9 + churn * 3 + complexity * 0.55), 45, 96)


def health(violations: DataFrame, models: DataFrame, by: str) -> DataFrame:
    """Coupling, cohesion, layer and model scores of each group, and their mean.

    violations has the group and target; models the group, methods and wrong, the number of its own violations.
    """
    v = violations.groupBy(by).agg(F.countDistinct("target").alias("targets"), F.count("*").alias("violations"))
    m = models.groupBy(by).agg(F.avg("methods").alias("methods"), (1 - F.sum("wrong") / F.count("*")).alias("clean"))
    rows = m.join(v, by, "full")
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = {
        "coupling": clamp(100.0 - none("targets") * TARGET_PENALTY, 0, 100),
        "cohesion": F.when(F.col("methods").isNull(), 100.0).otherwise(clamp(F.col("methods") * METHOD_POINTS, 0, 100)),
        "layers": clamp(100.0 - none("violations") * LAYER_PENALTY, 0, 100),
        "models": F.when(F.col("clean").isNull(), 100.0).otherwise(clamp(F.col("clean") * 100, 0, 100)),
    }
    return rows.select(by, *[rounded(x, 2).alias(k) for k, x in parts.items()], rounded(sum(parts.values(), F.lit(0.0)) / 4, 2).alias("overall"))


def silos(files: DataFrame, owners: DataFrame) -> DataFrame:
    """Knowledge risk of each silo: files has silo, file, complexity and churn; owners has file and owner. Files without an owner don't count, nor do silos of such."""
    files = files.join(owners.select("file").distinct(), "file", "left_semi")
    own = files.select("silo", "file").join(owners.select("file", "owner").distinct(), "file").groupBy("silo").agg(F.countDistinct("owner").alias("contributors"))
    per = files.groupBy("silo").agg(F.count("*").alias("files"), F.sum("complexity").alias("complexity"), F.sum("churn").alias("churn"))
    n = F.col("contributors")
    base = F.when(n <= 1, 65).when(n == 2, 40).otherwise(18)
    none = lambda c: F.coalesce(c, F.lit(0.0))
    score = base + F.least(F.lit(20), whole(none("complexity") / 2)) + F.least(F.lit(14), whole(none("churn") * 2))
    return per.join(own, "silo").select("silo", "files", F.greatest(F.lit(1), n).cast("long").alias("contributors"), clamp(score, 1, 99).cast("long").alias("risk"))


def refactoring(files: DataFrame, n: int) -> DataFrame:
    """The n files of the highest return; files has file, loc, complexity, churn and bugs."""
    effort = F.greatest(F.lit(1), whole(F.col("loc") / 40 + F.col("complexity") / 8))
    rows = files.select("file", effort.cast("long").alias("effort"), clamp(whole(F.col("bugs") * 12 + F.col("churn") * 6), 1, 99).cast("long").alias("risk"), F.greatest(F.lit(1), whole(F.col("complexity") * 1.2 + F.col("bugs") * 10)).cast("long").alias("roi"))
    return rows.orderBy(F.desc("roi"), "file").limit(n)


def forecast(points: DataFrame, n: int = 6) -> DataFrame:
    """The last n points (at, score) with scores that fall by 2 a step, and a band that widens by 1."""
    last = points.orderBy(F.desc("at")).limit(n)
    i = F.row_number().over(Window.orderBy("at"))  # at most n rows
    rows = last.withColumn("i", i).withColumn("f", F.greatest(F.lit(1), whole(F.col("score") - F.col("i") * 2)))
    radius = F.col("i") + 3
    return rows.select("at", F.greatest(F.lit(1), whole(F.col("score"))).cast("long").alias("historical"), F.col("f").cast("long").alias("forecast"), F.least(F.lit(100), F.col("f") + radius).cast("long").alias("high"), F.greatest(F.lit(1), F.col("f") - radius).cast("long").alias("low"))


def improvement(metrics: DataFrame, by: str) -> DataFrame:
    """Mean relative improvement of metrics (label, before, after) in percent; more coverage is better, less of all else."""
    base = F.greatest(F.col("before"), F.lit(1.0))
    better = F.when(F.col("label") == "Coverage", F.col("after") - F.col("before")).otherwise(F.col("before") - F.col("after"))
    return metrics.groupBy(by).agg(F.greatest(F.lit(0), whole(F.sum(better / base * 100) / F.greatest(F.count("*"), F.lit(1)))).cast("long").alias("improvement"))


def leaderboard(files: DataFrame, people: DataFrame, ownership: DataFrame) -> DataFrame:
    """Quality, velocity and ownership of each person in a month, a sprint and a quarter; place goes by the sprint's quality, then name.

    files: file, position, complexity, churn, bugs; people: person, name, commits; ownership: file, person. Files that
    aren't among files don't count; a person without any is measured by the first file.
    """
    none = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    measured = files.select("file", *[none(c) for c in ("complexity", "churn", "bugs")])
    own = ownership.select("file", "person").distinct().join(measured, "file")
    per = own.groupBy("person").agg(F.count("*").alias("files"), *[F.avg(c).alias(c) for c in ("complexity", "churn", "bugs")])
    first = files.groupBy().agg(F.min_by(F.struct(*[none(c) for c in ("complexity", "churn", "bugs")]), "position").alias("first"))
    # One row: the first file.
    rows = people.join(per, "person", "left").crossJoin(F.broadcast(first))
    for c in ("complexity", "churn", "bugs"):
        rows = rows.withColumn(c, F.coalesce(c, F.col(f"first.{c}"), F.lit(0.0)))
    rows = rows.withColumn("files", F.greatest(F.coalesce("files", F.lit(1)), F.lit(1)))
    to = lambda x: clamp(whole(x), 1, 180).cast("long")
    month = {
        "quality": to(100 - F.col("complexity") * 3 - F.col("churn") * 1.2 - F.col("bugs") * 6),
        "velocity": to(F.col("commits") * 1.1 + F.col("files") * 4), "ownership": to(F.col("files") * 12 + F.col("commits") * 0.6),
    }
    rows = rows.select("person", "name", "commits", *[x.alias(f"{k}_month") for k, x in month.items()])
    more = {"quality": (3 + F.col("commits") / 25, -4), "velocity": (8, -6), "ownership": (4, 10)}
    names = [n for k in more for n in (f"{k}_month", f"{k}_sprint", f"{k}_quarter")]
    for k, (sprint, quarter) in more.items():
        rows = rows.withColumn(f"{k}_sprint", to(F.col(f"{k}_month") + sprint)).withColumn(f"{k}_quarter", to(F.col(f"{k}_month") + quarter))
    # People are ranked per quality, of which there are 180 at most, so that no task ranks all.
    sizes = rows.groupBy("quality_sprint").agg(F.count("*").alias("n"))
    before = sizes.select("quality_sprint", (F.sum("n").over(Window.orderBy(F.desc("quality_sprint"))) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("quality_sprint").orderBy("name", "person"))
    return rows.withColumn("nth", nth).join(F.broadcast(before), "quality_sprint").select("person", "name", *names, (F.col("before") + F.col("nth")).alias("place"))


def scaling(load: Column, replicas: Column, target: float = 120, least: int = 2, most: int = 16, band: float = 0.2) -> tuple[Column, Column]:
    """Replicas wanted and what to do, from the load and the present number of replicas."""
    each = load / replicas
    wanted = clamp(F.ceil(load / target), least, most).cast("long")
    up, down = (each > target * (1 + band)) & (replicas < most), (each < target * (1 - band)) & (replicas > least)
    return F.when(up | down, wanted).otherwise(replicas.cast("long")), F.when(up, "SCALE_UP").when(down, "SCALE_DOWN").otherwise("NOOP")
