"""Balanced shards by label propagation: documents move to the shards of the documents they are linked with.

Documents with equal texts are linked.  Groups with more than a share ``LARGE`` of a shard are laid out first: whole into the
shard where they leave least room, or, if they fit into none, over the fewest shards.  The other documents are dealt over
the room that is left.  In every round the links of a document vote with their shards; it wants to be
where most of them are.  What a shard takes in is bounded by what leaves it and by the unlinked documents it can give
away.  At the end unlinked documents, and linked ones where these do not suffice (large groups last), move from shards with too many to
shards with too few, until numbers of documents are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborbook.llm.tables import written

ROUNDS = 3
#: A group with more than this share of a shard is placed before the others, by the driver: there are few of them.
LARGE = 0.25
#: Documents that are numbered together.
NUMBERED = 256


def _shard_of(what: Column, shards: int) -> Column:
    return F.pmod(what, F.lit(shards)).cast("int")


def _laid_out(groups: list[tuple[bytes, int]], room: list[int]) -> list[tuple[bytes, list[int], list[int]]]:
    """(key, shards, how many rows of the group are in these and the ones before) of each group (key, rows); fills ``room``."""
    out = []
    for key, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        whole = [j for j, r in enumerate(room) if r >= n]
        to = [min(whole, key=lambda j: (room[j], j))] if whole else sorted(range(len(room)), key=lambda j: (-room[j], j))
        used, ends, left = [], [], n
        for j in to:
            part = min(left, room[j])
            if part:
                room[j] -= part
                left -= part
                used.append(j)
                ends.append(n - left)
        out.append((key, used, ends))
    return out


def _propagate(linked: DataFrame, loose: dict[int, int], shards: int) -> DataFrame:
    """One round over (_row, _key, _shard)."""
    votes = linked.groupBy("_key", "_shard").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("_key").agg(F.max_by("_shard", F.struct("n", F.xxhash64("_key", "_shard"))).alias("_want"))
    wanted = written(linked.join(best, "_key"), "wanted")
    moves = {(r["_shard"], r["_want"]): r["n"] for r in wanted.groupBy("_shard", "_want").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {}
    for j in range(shards):
        leaving = sum(n for (a, b), n in moves.items() if a == j != b)
        coming = sum(n for (a, b), n in moves.items() if b == j != a)
        share[j] = min(1.0, (leaving + loose.get(j, 0)) / coming) if coming else 1.0
    admitted = F.element_at(F.lit([share[j] for j in range(shards)]), F.col("_want") + 1)
    draw = F.pmod(F.xxhash64("_key", F.lit("draw")), F.lit(1_000_000)) / 1_000_000  # a group is drawn as a whole
    return wanted.select("_row", "_key", F.when(draw < admitted, F.col("_want")).otherwise(F.col("_shard")).alias("_shard"))


def _numbered(rows: DataFrame, count: int, shards: int) -> DataFrame:
    """Gapless ``_place`` from 0 within ``_shard``, by ``_rank`` (0 to 2), without a shard meeting in one task."""
    parts = max(1, count // (shards * NUMBERED))
    rows = rows.withColumn("_part", F.col("_rank") * parts + F.pmod(F.xxhash64("_row", F.lit("part")), F.lit(parts)).cast("int"))
    sizes = rows.groupBy("_shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_shard", "_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_shard", "_part").orderBy("_row")) - 1
    placed = rows.withColumn("_inside", inside).join(offsets, ["_shard", "_part"])
    return placed.withColumn("_place", F.col("_offset") + F.col("_inside")).drop("_part", "_inside", "_offset")


def balanced_shards(docs: DataFrame, shards: int = 40, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row.

    ``size``: UTF-8 bytes of the text (none for null) and 16.  Null counts as the empty text.  Numbers of rows per shard
    are at most one apart, slots of a shard are gapless from 0.  Repeated ids are allowed; equal rows are interchangeable.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(
        F.col(doc_id).alias("_id"),
        (F.length(body) + 16).cast("bigint").alias("_size"),
        F.crc32(body).alias("_crc"),
        F.unhex(F.sha2(body, 256)).alias("_key"),
    )
    # A number of its own for every row; equal rows may swap theirs, so a repeated task changes nothing that can be seen.
    base = written(base.withColumn("_row", F.struct("_id", "_key", F.monotonically_increasing_id().alias("n"))), "documents")
    count = base.count()
    sizes = base.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    sizes = written(sizes, "groups")
    limit = max(1, int(LARGE * count / shards))
    due = [count // shards + (j < count % shards) for j in range(shards)]
    room = list(due)
    large = [(bytes(r["_key"]), r["_n"]) for r in sizes.where(F.col("_n") > limit).collect()]  # fewer than 2 * shards / LARGE rows
    laid = [(key, k, to, ends) for k, (key, to, ends) in enumerate(_laid_out(large, room))]
    laid = F.broadcast(base.sparkSession.createDataFrame(laid, "_key binary, _shard int, _to array<int>, _ends array<bigint>"))
    usual = sizes.where(F.col("_n") <= limit).select(F.col("_key"), F.lit(1).alias("_rank"))

    def at(values: list[int], shard: Column) -> Column:
        return F.element_at(F.lit(values).cast("array<bigint>"), shard + 1)

    fields = ["_id", "_size", "_crc", "_key", "_row"]
    wide = base.join(laid, "_key").withColumn("_rank", F.lit(2))
    wide = _numbered(wide, count, max(1, len(large)))  # within each group
    place = F.size(F.filter("_ends", lambda e: e <= F.col("_place")))
    wide = wide.select(*fields, F.get("_to", place).alias("_shard"), "_rank")
    free = [sum(room[: j + 1]) for j in range(shards)]
    draw = F.pmod(F.xxhash64("_row"), F.lit(max(1, free[-1])))
    rest = base.join(laid, "_key", "left_anti").join(usual, "_key", "left").withColumn("_draw", draw)
    start = F.size(F.filter(F.lit(free).cast("array<bigint>"), lambda e: e <= F.col("_draw")))
    rest = written(rest.select(*fields, start.alias("_shard"), F.coalesce("_rank", F.lit(0)).alias("_rank")), "placed")

    loose = {r["_shard"]: r["n"] for r in rest.where("_rank = 0").groupBy("_shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    linked = rest.where("_rank = 1").select("_row", "_key", "_shard")
    for _ in range(ROUNDS):
        linked = _propagate(linked, loose, shards)
    settled = rest.where("_rank = 1").drop("_shard").join(linked.select("_row", "_shard"), "_row").select(*fields, "_shard", "_rank")
    placed = rest.where("_rank = 0").unionByName(settled).unionByName(wide)
    placed = written(_numbered(placed, count, shards), "numbered")

    have = {r["_shard"]: r["n"] for r in placed.groupBy("_shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    surplus = [max(0, have.get(j, 0) - due[j]) for j in range(shards)]
    lack = [max(0, due[j] - have.get(j, 0)) for j in range(shards)]
    stay = [have.get(j, 0) - surplus[j] for j in range(shards)]
    before, ends = [sum(surplus[:j]) for j in range(shards)], [sum(lack[: j + 1]) for j in range(shards)]

    leaves = F.col("_place") < at(surplus, F.col("_shard"))
    queue = at(before, F.col("_shard")) + F.col("_place")  # number among all that leave
    target = F.size(F.filter(F.lit(ends).cast("array<bigint>"), lambda e: e <= F.col("_queue")))
    moved = placed.withColumn("_leaves", leaves).withColumn("_queue", queue).withColumn("_target", target)
    shard = F.when(F.col("_leaves"), F.col("_target")).otherwise(F.col("_shard"))
    arrived = at(stay, F.col("_target")) + F.col("_queue") - (at(ends, F.col("_target")) - at(lack, F.col("_target")))
    slot = F.when(F.col("_leaves"), arrived).otherwise(F.col("_place") - at(surplus, F.col("_shard")))
    return moved.select(
        F.col("_id").alias(doc_id),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        shard.cast("int").alias("shard"),
        slot.cast("bigint").alias("slot"),
    )
