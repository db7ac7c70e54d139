"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `nodes` points on a ring of 64-bit hashes; a key goes to the next point clockwise. A shard takes at
most its share of the bytes times `1 + slack`; keys that find it full go on clockwise to the next point whose shard has
room. Keys are hashes of the text, so equal texts are one group, which stays whole: only one that finds no shard with
room for all of it is split, by rows.

The walk needs no row in one place. Groups larger than `slack` of a shard (fewer than shards / slack of them, whatever
the input) are placed first, one by one, the largest first. The loads of the other groups are summed by the ring's arcs
(shards x nodes), the driver walks the arcs and cuts each into byte ranges, a range for a shard, and groups find their
range by a running sum in the order of their keys. Groups across a cut (at most one for each cut) are placed one by one,
the largest first, clockwise to the first shard with room for them, or else to the emptiest shard. Running sums are taken
over parts of an arc, by ranges of keys, and of a large group, by a hash of the id; the number of parts changes no result.

Null texts have no bytes and size `overhead`. Repeated rows are placed each for itself, in the group of their text. Extra
columns, whatever their names, are ignored. An empty table gives no rows. Only the size and a hash of a text, however
long, are moved.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, written


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(point, shard), ascending; points are signed 64-bit numbers."""
    points = {}
    for s in range(shards):
        for v in range(nodes):
            points.setdefault(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s)
    return sorted(points.items())


def walk(owners: list[int], loads: list[int], room: list[int]) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """For each arc, (shard, end of its byte range) in order; and the bytes given to each shard, of which each has `room`."""
    free, room = room, list(room)
    ranges: list[list[tuple[int, int]]] = [[] for _ in owners]
    over = [0] * len(owners)
    for i, (s, load) in enumerate(zip(owners, loads, strict=True)):
        take = min(load, room[s])
        room[s] -= take
        if take:
            ranges[i].append((s, take))
        over[i] = load - take
    for i, more in enumerate(over):
        j, done = i, loads[i] - more
        while more:
            j = (j + 1) % len(owners)
            take = min(more, room[owners[j]])
            if take:
                room[owners[j]] -= take
                more, done = more - take, done + take
                ranges[i].append((owners[j], done))
    return ranges, [f - r for f, r in zip(free, room, strict=True)]


def place_groups(groups: list[tuple[int, int, int, int]], order: list[int], capacity: int, shards: int) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """For each group (arc, bytes, rows, key), (shard, end of its range of rows) in order; and the bytes given to each shard.

    The largest comes first, and goes clockwise to the first shard with room for it whole. Without one it is split: each
    shard, clockwise, takes the rows that it has room for, and rows left over go to the emptiest shard one by one.
    """
    given = [0] * shards
    out: list[list[tuple[int, int]]] = [[] for _ in groups]
    for i in sorted(range(len(groups)), key=lambda i: (-groups[i][1], groups[i][0], groups[i][3])):
        arc, size, rows, _ = groups[i]
        clockwise = list(dict.fromkeys(order[arc:] + order[:arc]))
        whole = next((s for s in clockwise if given[s] + size <= capacity), None)
        if whole is not None:
            given[whole] += size
            out[i].append((whole, rows))
            continue
        one, done = size / rows, 0
        for s in clockwise:
            n = min(rows - done, max(0, int((capacity - given[s]) // one)))
            if n:
                given[s] += round(n * one)
                done += n
                out[i].append((s, done))
        while done < rows:
            s = min(range(shards), key=lambda s: (given[s], s))
            given[s] += round(one)
            done += 1
            out[i].append((s, done))
    return out, given


def level(given: list[int], more: int, capacity: int) -> int:
    """What each shard may hold so that `more` bytes fit above what they have: the capacity, unless that is too little."""
    while sum(max(0, capacity - g) for g in given) < more:
        capacity += max(1, -(-(more - sum(max(0, capacity - g) for g in given)) // len(given)))
    return capacity


def shard(docs: DataFrame, shards: int = 24, nodes: int = 128, slack: float = 0.001, overhead: int = 8, part_rows: int = 100_000, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes': sizes are near equal), shard, slot (gapless from 0 in each shard), grown_shard (null)."""
    spark = docs.sparkSession
    points = ring(shards, nodes)
    order_of = [s for _, s in points]
    arcs = len(points)
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("key"))
    # the arc of a key: how many points lie below it, by binary search
    keyed = keyed.withColumn("edges", F.array(*[F.lit(p) for p, _ in points])).withColumn("low", F.lit(0)).withColumn("high", F.lit(arcs))
    for _ in range(arcs.bit_length()):
        mid = F.shiftright(F.col("low") + F.col("high"), 1)
        right = F.coalesce(F.get("edges", mid) < F.col("key"), F.lit(False)) & (F.col("low") < F.col("high"))
        keyed = keyed.withColumns({"low": F.when(right, mid + 1).otherwise(F.col("low")), "high": F.when(right | (F.col("low") >= F.col("high")), F.col("high")).otherwise(mid)})
    # the keys beyond the last point come before those up to the first
    keyed = written(keyed.select("doc_id", "size", "text_crc32", "key", F.pmod("low", F.lit(arcs)).cast("int").alias("arc"), (F.col("low") == 0).alias("turned")))

    total = keyed.agg(F.sum("size")).first()[0] or 0
    capacity = max(1, -(-int(total * (1 + slack)) // shards), -(-total // shards))
    groups = written(keyed.groupBy("arc", "key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    is_large = F.col("bytes") > int(capacity * slack)
    large = [(r["arc"], r["bytes"], r["n"], r["key"]) for r in groups.filter(is_large).collect()]  # fewer than shards / slack
    large.sort()
    taken, given = place_groups(large, order_of, capacity, shards)
    loads, counts = [0] * arcs, [0] * arcs
    for r in groups.filter(~is_large).groupBy("arc").agg(F.sum("bytes").alias("load"), F.sum("n").alias("n")).collect():  # at most shards x nodes rows
        loads[r["arc"]], counts[r["arc"]] = r["load"], r["n"]
    capacity = level(given, sum(loads), capacity)
    ranges, _ = walk(order_of, loads, [max(0, capacity - g) for g in given])

    # lanes: the arcs, then the large groups; all tables of lanes are bounded by the ring and shards / slack
    lanes = spark.createDataFrame([(key, arcs + i, -(-n // part_rows)) for i, (_, _, n, key) in enumerate(large)], "key long, lane int, parts int")
    at_ring = spark.createDataFrame([(i, -(-max(n, 1) // part_rows), float(points[i - 1][0]), float((points[i][0] - points[i - 1][0]) % 2**64 or 2**64)) for i, n in enumerate(counts)], "arc int, arc_parts int, begin double, width double")
    away = F.col("key").cast("double") - F.col("begin") + F.when((F.col("arc") == 0) & F.col("turned"), F.lit(2.0**64)).otherwise(F.lit(0.0))
    range_part = F.least(F.col("arc_parts") - 1, F.floor(away / F.col("width") * F.col("arc_parts")))
    keyed = keyed.join(F.broadcast(at_ring), "arc").join(F.broadcast(lanes), "key", "left")
    part = F.when(F.col("lane").isNotNull(), F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.col("parts"))).otherwise(F.greatest(range_part, F.lit(0)))
    keyed = keyed.select("doc_id", "size", "text_crc32", "key", "turned", F.coalesce("lane", "arc").alias("lane"), part.cast("int").alias("part"))

    sums = keyed.groupBy("lane", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    prior = Window.partitionBy("lane").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sums.select("lane", "part", *[F.coalesce(F.sum(c).over(prior), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows")]))
    cuts = F.broadcast(spark.createDataFrame([(i, [e for _, e in r], [s for s, _ in r]) for i, r in enumerate([*ranges, *taken]) if r], "lane int, ends array<bigint>, owners array<int>"))
    order = Window.partitionBy("lane", "part").orderBy("turned", "key", "doc_id", "size", "text_crc32")
    group = Window.partitionBy("lane", "part", "turned", "key")
    placed = keyed.join(sized(offsets, offsets.count()), ["lane", "part"]).join(cuts, "lane")
    placed = placed.withColumn("start", F.col("bytes_before") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("turn", F.row_number().over(order))
    alone = F.col("lane") >= arcs  # rows of a large group find their range for themselves
    placed = placed.withColumn("from", F.when(alone, F.col("rows_before") + F.col("turn") - 1).otherwise(F.min("start").over(group))).withColumn("weight", F.when(alone, F.lit(1)).otherwise(F.sum("size").over(group)))
    at = F.size(F.filter("ends", lambda e: e <= F.col("from")))
    placed = placed.withColumn("at", at).withColumn("whole", F.col("from") + F.col("weight") <= F.get("ends", F.col("at")))
    placed = written(placed.select("doc_id", "size", "text_crc32", "key", "lane", "part", F.get("owners", F.col("at")).alias("shard"), "whole", "turn"))

    across = placed.filter("not whole").groupBy("lane", "part", "key").agg(F.sum("size").alias("size")).collect()  # at most a group for each cut
    held = {r["shard"]: r["b"] for r in placed.filter("whole").groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    bytes_of = [held.get(s, 0) for s in range(shards)]
    moved = []
    for r in sorted(across, key=lambda r: (-r["size"], r["lane"], r["part"], r["key"])):
        clockwise = dict.fromkeys(order_of[r["lane"] :] + order_of[: r["lane"]])
        s = next((s for s in clockwise if bytes_of[s] + r["size"] <= capacity), None)
        if s is None:
            s = min(range(shards), key=lambda s: (bytes_of[s], s))
        bytes_of[s] += r["size"]
        moved.append((r["lane"], r["part"], r["key"], s))
    if moved:
        fixed = F.broadcast(spark.createDataFrame(moved, "lane int, part int, key long, moved int"))
        placed = placed.join(fixed, ["lane", "part", "key"], "left").withColumn("shard", F.coalesce("moved", "shard")).drop("moved")

    counts = placed.groupBy("shard", "lane", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("lane", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = written(counts.select("shard", "lane", "part", before.alias("base")))
    slot = F.row_number().over(Window.partitionBy("lane", "part", "shard").orderBy("turn")) - 1 + F.col("base")
    return placed.join(sized(bases, bases.count()), ["shard", "lane", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def locate(key: int, points: list[tuple[int, int]]) -> int:
    """The arc of a key, as the plan above finds it."""
    return bisect.bisect_left([p for p, _ in points], key) % len(points)
