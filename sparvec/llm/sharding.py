"""Sharding: best-fit-decreasing bin packing of indivisible groups.

Groups of rows with equal texts are sorted by size; each, largest first, enters the bin with the tightest remaining
capacity that still holds it, found in a balanced tree of remaining capacities. ``pack`` minimises the number of
bins of a fixed capacity; ``smallest_capacity`` turns that round and finds, by bisection, the least capacity at which a
fixed number of bins is enough. Where one group is larger than the mean, or best fit leaves bins empty at that capacity, the others could be spread
more evenly: ``leveled`` settles the fullest bin and packs what is left into the remaining bins, until they are near equal.

How it scales: only a histogram goes to the driver. Its classes are (size of a group), exact up to EXACT_SIZE and
with PRECISION steps to an octave above, so it has at most EXACT_SIZE + 48 * PRECISION rows (under 2**19) however many
documents there are. The groups of a class are alike, so packing deals whole runs of a class to a bin; a group finds its
bin by its rank in its class. Ranks and slots are counted in two levels (block, then row within it), so no task holds a
class, a shard or a hot group alone. Texts are never shuffled.

Defined results: null texts are one group of their own, each row of size 1 (empty texts are another); very long texts count with all their bytes; ties are
broken by the group's hash, so any partitioning gives the same shards; repeated rows (also of one id) each get a slot;
an empty table gives an empty result; extra columns are dropped. A group larger than total / shards stays whole, so then
its shard is larger than the others, which share the rest evenly.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

EXACT_SIZE = 1 << 16
PRECISION = 1 << 12
SHARDS = 8
#: Rows that a block of the two-level counts aims at.
BLOCK_ROWS = 50_000
#: The least capacity is found up to a part in 2**FINE, which takes about as many packings.
FINE = 16
#: Bins are near equal when the fullest and the emptiest differ by at most this share of the mean.
NEAR = 0.001


class CapacityTree:
    """Remaining capacities in order, in a two-level balanced tree of sorted leaves; each entry names its bin."""

    LEAF = 512

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []

    def add(self, remaining: int, name: int) -> None:
        entry = (remaining, name)
        if not self.tops:
            self.leaves, self.tops = [[entry]], [entry]
            return
        i = min(bisect_left(self.tops, entry), len(self.tops) - 1)
        leaf = self.leaves[i]
        insort(leaf, entry)
        self.tops[i] = leaf[-1]
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[i : i + 1] = [leaf[:half], leaf[half:]]
            self.tops[i : i + 1] = [leaf[half - 1], leaf[-1]]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the entry with the least remaining capacity of size or more."""
        entry = (size, -1)
        i = bisect_left(self.tops, entry)
        if i == len(self.tops):
            return None
        leaf = self.leaves[i]
        found = leaf.pop(bisect_left(leaf, entry))
        if leaf:
            self.tops[i] = leaf[-1]
        else:
            del self.leaves[i], self.tops[i]
        return found


def pack(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[int, dict[int, list[tuple[int, int]]]] | None:
    """Best-fit decreasing of classes (size, count) into bins of the capacity.

    Returns the number of bins and, by size, the runs (bin, count) in the order in which its groups are dealt. None
    when more than ``most`` bins would be needed. A group above the capacity gets a bin of its own.
    """
    tree, bins, runs = CapacityTree(), 0, {}
    for size, count in sorted(classes, reverse=True):
        dealt = runs.setdefault(size, [])
        while count:
            found = tree.take_tightest(size)
            if found is None:
                if most is not None and bins >= most:
                    return None
                found = (max(capacity, size), bins)
                bins += 1
            remaining, name = found
            # the bin stays the tightest that holds this size until it no longer does
            n = min(count, remaining // size) if size else count
            dealt.append((name, n))
            count -= n
            tree.add(remaining - n * size, name)
    return bins, runs


def smallest_capacity(classes: list[tuple[int, int]], shards: int) -> tuple[int, dict[int, list[tuple[int, int]]]]:
    total = sum(s * c for s, c in classes)
    low = max([-(-total // shards), *(s for s, _ in classes)], default=0)
    high = low
    while (best := pack(classes, high, shards)) is None:
        high += max(1, high // 8)
    while high - low > low >> FINE:
        mid = (low + high) // 2
        if (got := pack(classes, mid, shards)) is not None:
            best, high = got, mid
        else:
            low = mid + 1
    return high, best[1]


def leveled(classes: list[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """Runs (bin, count) by size: the least capacity for all bins, then, the fullest being settled, the least for the others, and so on."""
    left, free = dict(classes), list(range(shards))
    runs: dict[int, list[tuple[int, int]]] = {size: [] for size in left}
    while left:
        _, got = smallest_capacity(list(left.items()), len(free))
        load = [0] * len(free)
        for size, dealt in got.items():
            for name, n in dealt:
                load[name] += size * n
        full, last = load.index(max(load)), (max(load) - min(load)) * len(free) <= NEAR * sum(load)
        for size, dealt in got.items():
            for name, n in dealt:
                if last or name == full:
                    runs[size].append((free[name], n))
                    left[size] -= n
        left = {size: n for size, n in left.items() if n}
        del free[full]
    return runs


def size_class(size):
    """The upper end of the class of a size: the size itself, or from EXACT_SIZE a multiple of its octave / PRECISION."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(size.cast("double"))) - 12).cast("long")
    return F.when(size < EXACT_SIZE, size).otherwise(F.ceil(size / step).cast("long") * step)


def with_rank(df: DataFrame, keys: list[str], order: list[str], blocks: int, name: str) -> DataFrame:
    """Number the rows of each key from 0, gapless, in the order of (block, order) where block is a hash of order."""
    df = df.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = df.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inner = Window.partitionBy(*keys, "__block").orderBy(*order)
    ranked = df.withColumn("__in", F.row_number().over(inner) - 1)
    return ranked.join(counts, [*keys, "__block"]).withColumn(name, F.col("__before") + F.col("__in")).drop("__block", "__before", "__in")


def shard(docs: DataFrame, shards: int = SHARDS, capacity: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. With ``capacity``, as few bins of that many bytes as best fit finds."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.unhex(F.when(F.col("text").isNull(), F.lit("00")).otherwise(F.md5(text.cast("binary")))).alias("__group"),
    )
    rows = written(rows, "shard-rows")
    groups = rows.groupBy("__group").agg(F.sum("size").alias("__bytes")).withColumn("__class", size_class(F.col("__bytes")))
    groups = written(groups.drop("__bytes"), "shard-groups")
    histogram = groups.groupBy("__class").agg(F.count(F.lit(1)).alias("n"))
    classes = [(int(a), int(b)) for a, b in histogram.collect()]  # bounded: see above
    if capacity is None:
        runs = leveled(classes, shards)
    else:
        _, runs = pack(classes, capacity)
    plan = []
    for size, dealt in runs.items():
        upto = 0
        ends, names = [], []
        for name, n in dealt:
            upto += n
            ends.append(upto)
            names.append(name)
        plan.append((size, ends, names))
    plan_df = spark.createDataFrame(plan, "__class long, __ends array<long>, __bins array<int>")
    n_groups = sum(c for _, c in classes)
    ranked = with_rank(groups, ["__class"], ["__group"], max(1, n_groups // BLOCK_ROWS), "__rank")
    placed = ranked.join(plan_df, "__class").select(
        "__group", F.element_at("__bins", F.size(F.filter("__ends", lambda e: e <= F.col("__rank"))) + 1).alias("shard")
    )
    out = rows.join(placed, "__group").drop("__group")
    blocks = max(8, rows.count() // BLOCK_ROWS)
    return with_rank(out, ["shard"], ["doc_id", "text_crc32", "size"], blocks, "slot")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shard(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
