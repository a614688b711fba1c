"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots, whose number never changes. Their bytes are added up per slot; a
map from slots to shards, stored under a version, says where a slot lives. Rebalancing edits the map: heavy
shards give slots away until sizes are near equal, and the edited map is the next version. Another shard is
added by handing slots to it alone. Maps and slot totals have a row per slot, a fixed number, so they are edited
on the driver and broadcast.

A record is an id, the text's digest and size, and the copy number among rows alike in these; so rows that
repeat, even a third of all, are spread over the slots like others, and the same table gives the same shards.

Defined cases: a null text counts as empty (HEADER bytes); null ids are hashed as such; texts of any length
are measured whole and never split, so a shard can't be smaller than its largest record; an empty table gives
no rows and the first version of the map; other columns are ignored by manifest() and carried by placed().
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmine.llm.common import fresh_path, materialize, unused

SLOTS = 8192
SHARDS = 40
#: Bytes that a record takes beside its text.
HEADER = 16
#: Copies of a row that are numbered at once.
COPIES = 4096
MAP = "slot int, shard int, bytes long"


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, digest, copy, virtual_slot) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + HEADER).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("digest"))
    # Counted before anything else, so that a very frequent row is one row of this exchange for each task.
    per = rows.groupBy("doc_id", "size", "text_crc32", "digest").agg(F.count("*").alias("n"))
    blocks = per.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    left = F.least(F.lit(COPIES), F.col("n") - F.col("block") * COPIES).cast("int")
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), left - 1))).withColumn("copy", F.col("copy") + F.col("block") * COPIES)
    return copies.select("doc_id", "size", "text_crc32", "digest", "copy", _slot(F.col("doc_id"), F.col("digest"), F.col("copy"), slots).alias("virtual_slot"))


def _slot(doc_id, digest, copy, slots: int):
    return F.pmod(F.xxhash64(doc_id, digest, copy.cast("long")), F.lit(slots)).cast("int")


def slot_totals(found: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (bytes, rows) of the slots that have records; one entry per slot at most."""
    rows = found.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    return {r["virtual_slot"]: (r["bytes"], r["n"]) for r in rows}


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """The shard of each slot, equal numbers of neighbouring slots each."""
    return [s * shards // slots for s in range(slots)]


def rebalanced(where: list[int], sizes: dict[int, int], shards: int = SHARDS) -> list[int]:
    """The map with slots moved so that the shards' bytes are near equal.

    Shards above the mean give their largest slots that they can spare; these go, the largest first, to
    the lightest shard each. Then the heaviest shard gives a slot to the lightest, or swaps one with it, as
    long as the two come closer. Slots without bytes stay.
    """
    where, load = list(where), [0] * shards
    held: list[set[int]] = [set() for _ in range(shards)]
    for slot, size in sizes.items():
        load[where[slot]] += size
        held[where[slot]].add(slot)
    mean, free = sum(load) / max(1, shards), []
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (-sizes[s], s)):
            if load[shard] - sizes[slot] >= mean:
                load[shard] -= sizes[slot]
                held[shard].discard(slot)
                free.append(slot)

    def put(slot: int, shard: int) -> None:
        where[slot] = shard
        load[shard] += sizes[slot]
        held[shard].add(slot)

    def take(slot: int) -> None:
        load[where[slot]] -= sizes[slot]
        held[where[slot]].discard(slot)

    for slot in sorted(free, key=lambda s: (-sizes[s], s)):
        put(slot, min(range(shards), key=lambda k: (load[k], k)))
    while True:
        high, low = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[high] - load[low]
        # What moves from high to low, net: best half the gap, and less than all of it.
        given = [(s, None, sizes[s]) for s in held[high]] + [(s, t, sizes[s] - sizes[t]) for s, t in _near(held[high], held[low], sizes, gap / 2)]
        able = [(abs(net - gap / 2), s, t) for s, t, net in given if 0 < net < gap]
        if not able:
            return where
        _, s, t = min(able, key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2]))
        take(s)
        put(s, low)
        if t is not None:
            take(t)
            put(t, high)


def _near(of: Iterable[int], among: Iterable[int], sizes: dict[int, int], net: float) -> Iterable[tuple[int, int]]:
    """For each slot of one shard the one of another that is smaller by about net."""
    from bisect import bisect_left

    others = sorted((sizes[t], t) for t in among)
    for s in of:
        i = bisect_left(others, (sizes[s] - net, -1))
        for k in (i - 1, i):
            if 0 <= k < len(others):
                yield s, others[k][1]


def grown(where: list[int], sizes: dict[int, int], shards: int = SHARDS) -> list[int]:
    """The map with one more shard, which alone gets slots: of the heaviest shards, until it holds its share."""
    where, load = list(where), [0] * (shards + 1)
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot in sorted(sizes, key=lambda s: (sizes[s], s)):
        load[where[slot]] += sizes[slot]
        held[where[slot]].append(slot)
    share = sum(load) / (shards + 1)
    while any(held):
        heavy = max((k for k in range(shards) if held[k]), key=lambda k: (load[k], -k))
        slot = held[heavy].pop()
        if load[shards] + sizes[slot] > share:
            continue
        where[slot] = shards
        load[heavy] -= sizes[slot]
        load[shards] += sizes[slot]
    return where


def save(spark: SparkSession, path: str, version: int, where: list[int], sizes: dict[int, int]) -> None:
    """Stores a version of the map; a version that is there already is an error."""
    rows = [(slot, shard, sizes.get(slot, 0)) for slot, shard in enumerate(where)]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """(version, the shard of each slot) of a version, the newest if none is given."""
    store = spark.read.parquet(path)
    version = store.agg(F.max("version")).first()[0] if version is None else version
    rows = store.where(F.col("version") == version).select("slot", "shard").collect()
    return version, [r["shard"] for r in sorted(rows)]


def manifest(docs: DataFrame, path: str | None = None, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, digest, copy, virtual_slot, map_version, shard, slot) of every row.

    slot counts a shard's rows from 0 without gaps. The map is kept below path (a folder of this run if none is
    given): the newest version there, or the first one, is edited for the bytes of these documents, and stored
    as the next version if that changed it.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "slot-map")
    found = materialize(records(docs, slots), "shard-records")
    totals = slot_totals(found)
    sizes = {s: b for s, (b, _) in totals.items()}
    try:
        version, where = load(spark, path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        version, where = 0, first_map(slots, shards)
        save(spark, path, version, where, sizes)
    new = rebalanced(where, sizes, shards)
    if new != where:
        version += 1
        save(spark, path, version, new, sizes)
    version, where = load(spark, path, version)
    full, first = [0] * shards, []
    for slot in range(slots):
        first.append((slot, where[slot], full[where[slot]]))
        full[where[slot]] += totals.get(slot, (0, 0))[1]
    # One row per slot.
    plan = F.broadcast(spark.createDataFrame(first, "virtual_slot int, shard int, before long"))
    nth = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(F.asc_nulls_last("doc_id"), "digest", "copy")) - 1
    placed = found.withColumn("nth", nth).join(plan, "virtual_slot")
    return placed.select("doc_id", "size", "text_crc32", "digest", "copy", "virtual_slot", F.lit(version).alias("map_version"), "shard", (F.col("before") + F.col("nth")).alias("slot"))


def placed(docs: DataFrame, where: list[int], shard: str = "shard") -> DataFrame:
    """The documents, with all their columns and that of their shard by the map; without an exchange of texts.

    Rows alike in id and text, which the manifest numbers, all count as the first copy here.
    """
    slot, name = unused(docs, "slot_"), unused(docs, shard)
    text = F.coalesce(F.col("text"), F.lit(""))
    plan = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(where)), f"{slot} int, {name} int"))
    return docs.withColumn(slot, _slot(F.col("doc_id"), F.xxhash64(text), F.lit(0), len(where))).join(plan, slot).select(*[F.col(f"`{c}`") for c in docs.columns], name)
