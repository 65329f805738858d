"""Filling containers of fixed capacity with items, over the histogram of item lengths."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.session import ship, written

#: Pieces per rank bucket aimed at, and the most buckets.
PER_BUCKET, MOST_BUCKETS = 1 << 18, 4096
#: Classes of lengths a capacity has at most, and so the histogram rows of a profile. Up to this capacity a class is one
#: length; in larger containers lengths are taken in steps, and an item has the room of its class.
MOST_LENGTHS = 1 << 17
#: Ranks within a length stay below 2 to this power.
RANK_BITS = 45


class Runs(NamedTuple):
    """Where the items of each class of lengths go, by rank: for the ranks first .. first + containers * times - 1 of
    `length`, container = base + r // times, slot = slot + r % times, offset = offset + r % times * length, r = rank -
    first, lengths and offsets in steps."""

    length: np.ndarray
    first: np.ndarray
    base: np.ndarray
    times: np.ndarray
    slot: np.ndarray
    offset: np.ndarray


def fill_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns (containers, [(length, times), ...]) that hold every item of the histogram once.

    Shortest pack first: lengths are placed longest first, each item into a container with the most room; a pattern
    whose containers are more than the items left is split. If none has room, new containers are opened that hold as
    many items of the length as fit, so that a very common length doesn't open a container per item.

    The items of a length are not gone through: they bring the largest rooms down to a level, which is looked for, and
    a pattern takes its share of them at once. So a length adds two patterns and splits one at most, and a pattern
    grows by an entry for each of its different lengths, however many items there are and however short.
    """
    rooms: dict[int, list] = {}  # [containers, [(containers, pattern), ...]] by room
    order: list[int] = []  # the rooms as negative numbers
    done: list[tuple[int, tuple]] = []

    def add(containers: int, pattern: tuple, room: int) -> None:
        if room == 0:
            done.append((containers, pattern))
            return
        if room not in rooms:
            rooms[room] = [0, []]
            heapq.heappush(order, -room)
        rooms[room][0] += containers
        rooms[room][1].append((containers, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit {capacity}")
        taken: list[tuple[int, int, list]] = []  # the largest rooms, in falling order

        def places(level: int) -> int:
            """Items placed until no room taken is above the level."""
            return sum(n * -((level - room) // length) for room, n, _ in taken if room > level)  # noqa: B023

        low = -order[0] if order else 0
        while low >= length and places(low) < left:
            for _ in range(len(taken) + 1):
                if order and -order[0] >= length:
                    room = -heapq.heappop(order)
                    taken.append((room, *rooms.pop(room)))
            low = max(-order[0] if order else 0, length - 1)
        if taken:
            level, high = low, taken[0][0]
            while level < high:
                middle = (level + high) // 2
                level, high = (level, middle) if places(middle) <= left else (middle + 1, high)
            left -= places(level)
            for room, _, group in taken:
                times = max(0, -((level - room) // length))
                now = room - times * length
                more = now == level >= length
                while group and (times or more and left):
                    containers, pattern = group.pop()
                    used = min(containers, left) if more else 0
                    left -= used
                    if used:
                        add(used, (pattern, (length, times + 1)), now - length)
                    if containers > used:
                        add(containers - used, (pattern, (length, times)) if times else pattern, now)
                for containers, pattern in group:
                    add(containers, pattern, now)
        times = capacity // length
        if left >= times:
            add(left // times, (None, (length, times)), capacity - times * length)
            left %= times
        if left:
            add(1, (None, (length, left)), capacity - left * length)
    out = []
    for containers, pattern in done + [x for room in sorted(rooms) for x in rooms[room][1]]:
        items: list[tuple[int, int]] = []
        while pattern is not None:
            pattern, item = pattern
            items.append(item)
        out.append((containers, items[::-1]))
    return out


def lay_out(patterns: list[tuple[int, list[tuple[int, int]]]]) -> Runs:
    """Ranges of ranks per length for the patterns, sorted by length and rank; containers are numbered from 0."""
    columns, next_rank, base = [array("q") for _ in Runs._fields], {}, 0
    for containers, items in patterns:
        slot = offset = 0
        for length, times in items:
            first = next_rank.get(length, 0)
            next_rank[length] = first + containers * times
            for column, x in zip(columns, (length, first, base, times, slot, offset), strict=True):
                column.append(x)
            slot += times
            offset += times * length
        base += containers
    runs = Runs(*(np.frombuffer(c, np.int64) for c in columns))
    by_rank = np.lexsort((runs.first, runs.length))
    return Runs(*(c[by_rank] for c in runs))


def _place(runs: dict[int, Runs]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            capacity, step, kind, rank = (column[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("capacity", "step", "class", "rank"))
            container, slot, offset = (np.zeros(len(rank), np.int64) for _ in range(3))
            for c in np.unique(capacity):
                own, r = np.flatnonzero(capacity == c), runs[int(c)]
                at = np.searchsorted(r.length << RANK_BITS | r.first, kind[own] << RANK_BITS | rank[own], "right") - 1
                inside = rank[own] - r.first[at]
                container[own] = r.base[at] + inside // r.times[at]
                slot[own] = r.slot[at] + inside % r.times[at]
                offset[own] = r.offset[at] + inside % r.times[at] * kind[own]
            yield pa.RecordBatch.from_arrays(
                [column["profile"], column["item"], column["part"], pa.array(container), pa.array(slot.astype(np.int32)), pa.array(offset * step), column["length"]],
                names=["profile", "item", "part", "container", "position", "start", "length"],
            )

    return run


def pack(items: DataFrame, profiles: DataFrame, item: str, size: str) -> DataFrame:
    """(profile, item, part, container, position, start, length): where each item lies, for each container profile.

    An item larger than the capacity is divided into full containers and a rest (parts 0, 1, ...), no other is. A
    container's items have positions 0, 1, ... and begin at token `start`. Items of size 0 or null need no room: they
    get one row with a null container, position and start. Equal rows are placed each.
    Profiles of a null or non-positive capacity are left out; `profiles` is a table of a few rows of fixed number.

    The driver sees one histogram row per profile and class of lengths (`MOST_LENGTHS` at most) and computes patterns;
    a class is one length, but for capacities above `MOST_LENGTHS`, where it is a range of them and items begin where
    the class before ends, so that up to a step of room may lie between two. Items are joined to patterns by their rank
    among those of the same class. Ranks are counted within hashed buckets of a
    length and offset by the buckets before, so that a length shared by a third of all items is spread over tasks.
    """
    kinds = [(r["profile"], r["capacity"]) for r in profiles.select("profile", F.col("capacity").cast("long").alias("capacity")).distinct().collect() if r["capacity"] and r["capacity"] > 0]
    ship(items.sparkSession)
    sizes = written(items.select(F.col(item).alias("item"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size")))
    each = sizes.withColumn("k", F.explode(F.array(*[F.struct(F.lit(p).cast("string").alias("profile"), F.lit(c).alias("capacity")) for p, c in kinds]) if kinds else F.expr("cast(array() as array<struct<profile:string,capacity:bigint>>)"))).select("k.profile", "k.capacity", "item", "size")
    parts = F.when(F.col("size") > 0, F.ceil(F.col("size") / F.col("capacity")))
    pieces = each.where("size > 0").select("profile", "capacity", "item", "size", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    step = F.ceil(F.col("capacity") / MOST_LENGTHS)
    pieces = pieces.select("profile", "capacity", "item", F.col("part").cast("int").alias("part"), F.least(F.col("capacity"), F.col("size") - F.col("part") * F.col("capacity")).alias("length"), step.alias("step"))
    pieces = pieces.withColumn("class", F.least(F.expr("(length + step - 1) div step"), F.expr("capacity div step")))

    histogram = pieces.groupBy("capacity", "step", "class").agg(F.count("*").alias("n"))
    by_capacity: dict[int, dict[int, int]] = {}
    room: dict[int, int] = {}
    for r in histogram.collect():  # MOST_LENGTHS rows per profile at most
        by_capacity.setdefault(r["capacity"], {})[r["class"]] = r["n"]
        room[r["capacity"]] = r["capacity"] // r["step"]
    same = {c: sum(1 for _, x in kinds if x == c) for _, c in kinds}
    runs = {c: lay_out(fill_patterns({k: n // same[c] for k, n in h.items()}, room[c])) for c, h in by_capacity.items()}
    total = sum(sum(h.values()) for h in by_capacity.values())
    buckets = max(1, min(MOST_BUCKETS, total // PER_BUCKET))

    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("item", "part"), F.lit(buckets)).cast("int"))
    key = ["profile", "capacity", "class"]
    before = keyed.groupBy(*key, "bucket").agg(F.count("*").alias("n"))
    before = before.select(*key, "bucket", F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = keyed.withColumn("at", F.row_number().over(W.partitionBy(*key, "bucket").orderBy("item", "part")) - 1)
    ranked = inside.join(before, [*key, "bucket"]).select("profile", "capacity", "item", "part", "length", "step", "class", (F.col("before") + F.col("at")).alias("rank"))
    kind_of_item = sizes.schema["item"].dataType.simpleString()
    placed = ranked.mapInArrow(_place(runs), f"profile string, item {kind_of_item}, part int, container long, position int, start long, length long")
    empty = each.where("size <= 0").select("profile", "item", F.lit(0).alias("part"), F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("long").alias("start"), F.lit(0).cast("long").alias("length"))
    return placed.unionByName(empty)


def fill_report(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, capacity, items, parts, containers, tokens, least, filled): how well each profile's containers are
    filled; `items` are those that take room, `parts` the pieces they lie in, `least` is the number of containers no
    packing can go below, `filled` the share of room that is used."""
    of = packed.groupBy("profile").agg(F.count(F.when((F.col("part") == 0) & F.col("container").isNotNull(), 1)).alias("items"), F.count("container").alias("parts"), (F.coalesce(F.max("container"), F.lit(-1)) + 1).alias("containers"), F.sum("length").alias("tokens"))
    room = F.col("containers") * F.col("capacity")
    return of.join(F.broadcast(profiles.select("profile", "capacity").distinct()), "profile").select(
        "profile", "capacity", "items", "parts", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), F.when(room > 0, F.round(F.col("tokens") / room, 6)).alias("filled")
    )
