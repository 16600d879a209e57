"""Sharding: best-fit-decreasing packing of indivisible groups of equal texts.

Groups go, largest first, to the bin with the least remaining capacity that still holds them; the bins are found in a
balanced tree over their remaining capacities.  Groups of like size are exchangeable, so what the driver packs is the
histogram of group sizes with 12 significant bits: at most 2,048 classes for each power of two, whatever the number
of documents.  A class counts with its largest size, so no bin takes more than its capacity.  All groups of a class go
one after another into the tightest bin until it is full, which is what packing them singly would do; bins in the
same state are one node of the tree, so the driver's work grows with the classes, not with bins or documents.
Groups then find their bin by their rank in their class.

With a fixed number of shards the capacity is the smallest (to 1/2,048 of the fair share) that needs no more
bins, so sizes come out near equal.  A group is never split: one that alone exceeds the capacity has a bin of
its own, and with a fixed number of shards it sets the size of the largest.

Edge cases: a null text has no bytes and counts as the empty text; null and repeated ids and repeated rows are
placed row by row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callweave.llm.common import bounded, cut_lineage, parallelism

BITS = 12
#: Ranks that share a join key, so that a group meets only the runs near its rank.
RANKS = 1 << 12


class RoomTree:
    """A treap from remaining capacity to the runs of bins that have it: (first bin, number of bins)."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _weight(room: int) -> int:
        """A fixed, well mixed priority, which keeps the tree balanced."""
        x = (room + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        return (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity that holds ``size``."""
        node, best = self.root, None
        while node is not None:
            room, _, low, high, _ = node
            best, node = (room, low) if room >= size else (best, high)
        return best

    def add(self, room: int, first: int, count: int) -> None:
        def put(node):
            if node is None:
                return [room, self._weight(room), None, None, [(first, count)]]
            if room == node[0]:
                node[4].append((first, count))
                return node
            side = 2 if room < node[0] else 3
            node[side] = child = put(node[side])
            if child[1] > node[1]:  # rotate, so that priorities fall from the root on
                node[side], child[5 - side] = child[5 - side], node
                return child
            return node

        self.root = put(self.root)

    def take(self, room: int) -> tuple[int, int]:
        """One run of bins with this capacity; the node goes with its last run."""

        def merged(low, high):
            if low is None or high is None:
                return low or high
            if low[1] > high[1]:
                low[3] = merged(low[3], high)
                return low
            high[2] = merged(low, high[2])
            return high

        above, node = None, self.root
        while node[0] != room:
            above, node = node, node[2] if room < node[0] else node[3]
        run = node[4].pop()
        if not node[4]:
            rest = merged(node[2], node[3])
            if above is None:
                self.root = rest
            else:
                above[2 if room < above[0] else 3] = rest
        return run


@dataclass(frozen=True)
class Run:
    """Groups of one class with ranks from ``start`` on: ``each`` of them into every bin from ``first`` on."""

    index: int
    start: int
    stop: int
    each: int
    first: int


def pack(classes: list[tuple[int, int]], capacity: int) -> tuple[list[Run], int]:
    """Best-fit-decreasing over (size, count) classes: runs, and how many bins they take."""
    tree, runs, bins = RoomTree(), [], 0
    for index in sorted(range(len(classes)), key=lambda i: -classes[i][0]):
        size, count = classes[index]
        placed = 0
        while placed < count:
            room = tree.tightest(size)
            if room is None:  # as many new bins as the rest of the class fills
                room = max(capacity, size)
                first, there = bins, -(-(count - placed) // (room // size))
                bins += there
            else:
                first, there = tree.take(room)
            each, left = room // size, count - placed
            full = min(there, left // each)
            if full:
                runs.append(Run(index, placed, placed + full * each, each, first))
                placed += full * each
                tree.add(room - each * size, first, full)
            rest, used = count - placed, full
            if used < there and rest:  # the last bin of the class takes less
                runs.append(Run(index, placed, placed + rest, rest, first + used))
                tree.add(room - rest * size, first + used, 1)
                placed, used = count, used + 1
            if used < there:
                tree.add(room, first + used, there - used)
    return runs, bins


def pack_into(classes: list[tuple[int, int]], shards: int) -> list[Run]:
    """Runs for the smallest capacity that needs at most ``shards`` bins."""
    total = sum(s * c for s, c in classes)
    low = max(max((s for s, _ in classes), default=1), -(-total // shards))
    step = max(1, low // 2048)
    lo, hi = 0, 1

    def tried(k: int):
        runs, bins = pack(classes, low + k * step)
        return runs if bins <= shards else None

    while (best := tried(hi)) is None:
        lo, hi = hi, 2 * hi
    while lo < hi:
        mid = (lo + hi) // 2
        if (runs := tried(mid)) is not None:
            best, hi = runs, mid
        else:
            lo = mid + 1
    return best


def shard(docs: DataFrame, shards: int = 8, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot and grown_shard for every document.

    ``shards`` bins of near equal bytes, or, with ``capacity``, as few bins of that many bytes as best fit finds.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"))
    base = cut_lineage(base)
    chunks = parallelism(spark)
    groups = base.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"))
    shift = F.greatest(F.lit(0), F.length(F.bin("bytes")) - BITS)
    groups = groups.withColumn("shift", shift).withColumn("class", F.expr("shiftleft(shiftright(bytes, shift), shift)"))
    groups = cut_lineage(groups.withColumn("chunk", F.pmod(F.xxhash64("h1"), F.lit(chunks))).select("h1", "h2", "bytes", "class", "chunk"))
    counts = groups.groupBy("class", "chunk").agg(F.count("*").alias("k"), F.max("bytes").alias("most"))
    histogram = counts.groupBy("class").agg(F.sum("k").alias("k"), F.max("most").alias("most")).collect()
    classes = [(r.most, r.k) for r in histogram]
    runs = pack(classes, capacity)[0] if capacity else pack_into(classes, shards) if classes else []
    placed = spark.createDataFrame([(histogram[r.index]["class"], r.start, r.stop, r.each, r.first) for r in runs], "class long, start long, stop long, each long, first long")
    placed = placed.withColumn("block", F.explode(F.expr(f"sequence(start div {RANKS}, (stop - 1) div {RANKS})")))
    before = Window.partitionBy("class").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("class", "chunk", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("offset"))
    ranked = groups.withColumn("rn", F.row_number().over(Window.partitionBy("class", "chunk").orderBy("h1", "h2")) - 1)
    ranked = ranked.join(offsets, ["class", "chunk"]).withColumn("rank", F.col("rn") + F.col("offset")).withColumn("block", F.expr(f"rank div {RANKS}"))
    where = ranked.join(bounded(placed), ["class", "block"]).where("rank >= start and rank < stop").select("h1", "h2", F.expr("first + (rank - start) div each").cast("int").alias("shard"))
    rows = base.join(where, ["h1", "h2"]).withColumn("chunk", F.pmod(F.xxhash64("id", "h1"), F.lit(chunks)))
    rows = cut_lineage(rows.select("id", "size", "text_crc32", "shard", "chunk"))
    ahead = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("k")).select("shard", "chunk", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("start"))
    numbered = rows.withColumn("rn", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("id", "text_crc32")) - 1)
    slots = numbered.join(bounded(starts), ["shard", "chunk"])
    return slots.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rn") + F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
