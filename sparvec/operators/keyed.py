"""Keyed changes of an index table, as functions from table to table.

An index table has slot, key (DECIMAL(20, 0), null for an anonymous vector or a dead slot), key_pos (a slot's place in its key's list), alive, and
payload columns (codes, scale, ...). Slots are dense and stable until ``compact``. Nothing is changed in place: each
function returns the next table, and joins are hash joins on key or slot.

A batch of changes has seq, its order; where one key occurs more than once, the last one wins. Rows without a key are anonymous vectors wherever keys are
optional: each gets a slot of its own, and none is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = "decimal(20,0)"
#: Blocks of the two-level numbering: what is counted, summed in one task and broadcast has this many rows at most.
BLOCKS = 1024
FIXED = ("slot", "key", "key_pos", "alive")


def payload(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in FIXED]


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Number rows densely from 0 in the order of a unique LONG column, however its values lie.

    Quantiles of the column cut the rows into at most BLOCKS blocks of about the same size; the blocks are counted, and rows ranked inside them.
    """
    at = [k / BLOCKS for k in range(1, BLOCKS)]
    cuts = df.agg(F.array_distinct(F.percentile_approx(order, at, 10 * BLOCKS)).alias("__cuts"))
    cut = F.expr(f"aggregate(__cuts, 0, (n, c) -> n + IF(c < {order}, 1, 0))")
    df = df.crossJoin(F.broadcast(cuts)).withColumn("__b", cut).drop("__cuts")
    counts = df.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(order)) - 1
    return df.withColumn("__r", rank).join(F.broadcast(counts), "__b").withColumn(name, (F.col("__before") + F.col("__r")).cast("long")).drop("__b", "__r", "__before")


def end(slots: DataFrame) -> DataFrame:
    """One row: the number of slots, dead ones included."""
    return slots.agg((F.coalesce(F.max("slot"), F.lit(-1)) + 1).cast("long").alias("__end"))


def places(order: str) -> Column:
    """The place of a row in its key's list, null without a key; rows without a key aren't brought together."""
    w = Window.partitionBy("key", F.when(F.col("key").isNull(), F.col(order))).orderBy(order)
    return F.when(F.col("key").isNotNull(), F.row_number().over(w) - 1).cast("long")


def table_of(df: DataFrame, slot: str, key: Column | None = None) -> DataFrame:
    """A first index table from a payload with dense slots; keys that occur more than once are lists in slot order."""
    out = df.withColumn("slot", F.col(slot).cast("long")).withColumn("key", (key if key is not None else F.lit(None)).cast(KEY))
    if slot != "slot":
        out = out.drop(slot)
    out = out.withColumn("key_pos", places("slot") if key is not None else F.lit(None).cast("long")).withColumn("alive", F.lit(True))
    return out.select(*FIXED, *payload(out))


def primary(slots: DataFrame) -> DataFrame:
    """(key, slot) of each key's first slot in its list."""
    return slots.filter("alive AND key IS NOT NULL").groupBy("key").agg(F.min_by("slot", "key_pos").alias("slot"))


def append(slots: DataFrame, new: DataFrame) -> DataFrame:
    """Add rows (seq, key, key_pos, payload) behind the last slot, in the order of seq."""
    added = numbered(new, "seq", "__k").crossJoin(F.broadcast(end(slots)))
    added = added.withColumn("slot", F.col("__end") + F.col("__k")).withColumn("alive", F.lit(True))
    return slots.unionByName(added.select(*[F.col(c).cast(slots.schema[c].dataType) for c in slots.columns]))


def add(slots: DataFrame, batch: DataFrame) -> DataFrame:
    """Append anonymous vectors (seq, payload)."""
    return append(slots, batch.withColumns({"key": F.lit(None).cast(KEY), "key_pos": F.lit(None).cast("long")}))


def add_keyed(slots: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert or replace (seq, key, payload): a known key's first slot is replaced in place, a new key gets a new slot, a null key always."""
    parts = payload(slots)
    batch = batch.withColumn("key", F.col("key").cast(KEY))
    last = batch.filter("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct(*parts), "seq").alias("__p"), F.min("seq").alias("seq"))
    known = last.join(primary(slots), "key", "left")
    changed = known.filter("slot IS NOT NULL").select("slot", "__p")
    kept = slots.join(changed, "slot", "left").withColumns({c: F.when(F.col("__p").isNotNull(), F.col(f"__p.{c}")).otherwise(F.col(c)) for c in parts}).select(*slots.columns)
    new = known.filter("slot IS NULL").select("seq", "key", F.lit(0).cast("long").alias("key_pos"), *[F.col(f"__p.{c}").alias(c) for c in parts])
    return append(kept, new.unionByName(batch.filter("key IS NULL").select("seq", "key", F.lit(None).cast("long").alias("key_pos"), *parts)))


def add_keyed_multi(slots: DataFrame, batch: DataFrame) -> DataFrame:
    """Append (seq, key, payload) always; a key collects slots."""
    have = slots.filter("alive AND key IS NOT NULL").groupBy("key").agg((F.max("key_pos") + 1).alias("__next"))
    new = batch.withColumn("key", F.col("key").cast(KEY)).withColumn("__i", places("seq")).join(*_apart(have, "seq"), "left").drop("__key")
    return append(slots, new.withColumn("key_pos", (F.coalesce("__next", F.lit(0)) + F.col("__i")).cast("long")))


def _apart(known: DataFrame, order: str) -> tuple[DataFrame, Column]:
    """What joins rows to a table of keys without bringing the rows without a key together: keys are never negative."""
    return known.withColumnRenamed("key", "__key"), F.coalesce(F.col("key"), (-1 - F.col(order)).cast(KEY)) == F.col("__key")


def contains_key(slots: DataFrame, keys: DataFrame) -> DataFrame:
    """keys with ``found``."""
    mine = slots.filter("alive AND key IS NOT NULL").select("key").distinct().withColumn("__f", F.lit(True))
    return keys.withColumn("key", F.col("key").cast(KEY)).join(mine, "key", "left").withColumn("found", F.coalesce("__f", F.lit(False))).drop("__f")


def key_of(slots: DataFrame, wanted: DataFrame) -> DataFrame:
    """(slot, key) of the slots asked for; the key is null for dead, anonymous and unknown slots."""
    return wanted.select("slot").join(slots.filter("alive").select("slot", "key"), "slot", "left")


def relabel(slots: DataFrame, old: int, new: int) -> tuple[DataFrame, DataFrame]:
    """Rename a key: (table, one row with ``done``). Nothing happens when old is unknown or new is taken; old to itself is done if known."""
    hit = lambda k: F.coalesce(F.max(F.col("alive") & F.coalesce(F.col("key") == F.lit(k).cast(KEY), F.lit(False))), F.lit(False))
    verdict = slots.agg(hit(old).alias("o"), hit(new).alias("n")).select((F.col("o") & (F.lit(old == new) | ~F.col("n"))).alias("done"))
    named = slots.crossJoin(F.broadcast(verdict)).withColumn("key", F.when(F.col("done") & (F.col("key") == F.lit(old).cast(KEY)), F.lit(new).cast(KEY)).otherwise(F.col("key")))
    return named.select(*slots.columns), verdict


def remove_keyed(slots: DataFrame, keys: DataFrame) -> DataFrame:
    """Kill all slots of the keys given; a later insert of such a key gets a new slot."""
    gone = keys.select(F.col("key").cast(KEY).alias("key")).distinct()
    out = slots.join(*_apart(gone, "slot"), "left")
    dead = F.col("__key").isNotNull()
    return _killed(out, dead).select(*slots.columns)


def _killed(df: DataFrame, dead: Column) -> DataFrame:
    return df.withColumn("alive", F.col("alive") & ~dead).withColumn("key_pos", F.when(dead, None).otherwise(F.col("key_pos"))).withColumn("key", F.when(dead, None).otherwise(F.col("key")))


def remove_keyed_at(slots: DataFrame, key: int, slot: int) -> DataFrame:
    """Kill one slot of a key, if it is one; the last slot of the key's list takes its place there."""
    mine = F.col("alive") & (F.col("key") == F.lit(key).cast(KEY))
    facts = slots.filter(mine).agg(F.max("key_pos").alias("__last"), F.max(F.when(F.col("slot") == slot, F.col("key_pos"))).alias("__at"))
    out = slots.crossJoin(F.broadcast(facts))
    dead = F.coalesce(mine & (F.col("slot") == slot), F.lit(False))
    moved = F.coalesce(mine & ~dead & F.col("__at").isNotNull() & (F.col("key_pos") == F.col("__last")), F.lit(False))
    out = out.withColumn("__m", moved).withColumn("__d", dead)
    out = out.withColumn("key_pos", F.when(F.col("__m"), F.col("__at")).otherwise(F.col("key_pos")))
    return _killed(out, F.col("__d")).select(*slots.columns)


def compact(slots: DataFrame) -> DataFrame:
    """Drop dead slots and number the others densely in their order, with all their planes; key lists are in slot order again."""
    out = numbered(slots.filter("alive"), "slot", "__new").withColumn("slot", F.col("__new")).drop("__new")
    return out.withColumn("key_pos", places("slot")).select(*slots.columns)


def stats(slots: DataFrame) -> DataFrame:
    """One row: n_slots, n_live, n_tombstones, n_keys."""
    live = F.coalesce(F.sum(F.col("alive").cast("long")), F.lit(0))
    n = F.count(F.lit(1))
    return slots.agg(n.alias("n_slots"), live.alias("n_live"), (n - live).alias("n_tombstones"), F.countDistinct(F.when(F.col("alive"), F.col("key"))).alias("n_keys"))
