"""Benchmark decontamination: template canonicalisation.

Texts are cut into words (runs of letters and digits). Words that start with a digit, words with a capital letter, and units are
replaced by typed placeholders; the template is the sequence that remains. Windows of WINDOW template words of the benchmark are
joined by hash with those of all documents. Windows without a literal word are evidence only where their values are the same, so they are joined by
their values; so are items shorter than WINDOW words, as one window of their own length.

Slots are checked on each diagonal (document place minus item place) of a document and an item: each value of the item must stand for one value of the
document, so a question with other numbers or names is caught, and a chance meeting of templates is not. Two values may become the same one, and
unchanged values always count; a window goes when one of its own changed values has another value elsewhere on the diagonal. A document holds an
item when RUN words of it in a row lie in the windows that are left, or COVERED_PERCENT of its words do, on any diagonals; so neither a word edited in an
item of 13 words or more nor a quotation of a part hides it.

Built-in functions only. The benchmark's windows are broadcast while there are at most BROADCAST_ROWS of them, and shuffled beyond (where Spark splits the
rows of a frequent window); the same holds for the few candidate places. Windows are joined as they are made, so no document's windows are gathered. A
document window meets as many rows as the benchmark has windows of its hash.

Defined results: null and empty texts have no words and hold nothing; very long texts are read whole; rows without an id can't be named and hold nothing;
items without words are never held; repeated rows give one row, and rows that share an id but not the text are checked one by one and give one row; ties
don't arise; empty tables give an empty result; only doc_id and text, and item_id and text, are read, so other columns don't matter.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

WINDOW = 5
#: Words of an item in a row, or the share of its words, that make a leak.
RUN = 13
COVERED_PERCENT = 60
BROADCAST_ROWS = 500_000

#: Units, in lower case.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "ton", "tons", "ounce", "ounces",
    "pound", "pounds", "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes",
    "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro",
    "euros", "percent", "degree", "degrees", "watt", "watts", "volt", "volts", "joule", "joules", "meter", "meters", "metre", "metres",
)
NUMBER, NAME, UNIT = 1, 2, 3


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def code(word: Column) -> Column:
    """A placeholder, or the word's hash."""
    return (
        F.when(F.ascii(word).between(48, 57), F.lit(NUMBER))
        .when(F.lower(word) != word, F.lit(NAME))
        .when(word.isin(*UNITS), F.lit(UNIT))
        .otherwise(F.xxhash64(word))
        .cast("long")
    )


def windows(of: str, size: int) -> Column:
    """The hashes of the windows of an array, in order."""
    return F.when(F.size(of) >= size, F.expr(f"transform(sequence(1, size({of}) - {size - 1}), i -> xxhash64(slice({of}, i, {size})))"))


MATCHES = "doc_id long, item_id long, n_words long, n_covered long, longest_run long, exact boolean"


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """MATCHES: the words of the item, how many of them the document holds, in a row at most, and whether all their values are the same."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("item_words")).withColumn("item_codes", F.transform("item_words", code))
    items = items.filter(F.size("item_codes") > 0).withColumn("size", F.least(F.size("item_codes"), F.lit(WINDOW))).dropDuplicates(["item_id", "item_words"])
    items = written(items.withColumn("n_words", F.size("item_words").cast("long")), "bench-items")
    # windows by size, and whether they have a literal word and so go by their templates: at most WINDOW + 1 kinds
    own = items.select("item_id", "size", F.posexplode(F.expr("transform(sequence(1, size(item_codes) - size + 1), i -> struct(slice(item_words, i, size) AS w, slice(item_codes, i, size) AS c))")).alias("q", "x"))
    literal = (F.col("size") == WINDOW) & F.exists("x.c", lambda c: ~c.between(NUMBER, UNIT))
    own = own.select("item_id", "q", "size", literal.alias("literal"), F.when(literal, F.xxhash64("x.c")).otherwise(F.xxhash64("x.w")).alias("h"))
    own = written(own, "bench-windows")
    kinds = sorted(tuple(r) for r in own.groupBy("size", "literal").count().collect())
    th = F.xxhash64("text").alias("th")
    texts = docs.select("doc_id", th, words_of(F.col("text")).alias("words"))
    found = []
    for size, by_template, n in kinds:
        bench = own.filter((F.col("size") == size) & (F.col("literal") == by_template)).select("item_id", "q", "h")
        of = texts.withColumn("words", F.transform("words", code)) if by_template else texts
        mine = of.select("doc_id", "th", F.posexplode(windows("words", size)).alias("p", "h"))
        found.append(mine.join(F.broadcast(bench) if n <= BROADCAST_ROWS else bench, "h").select("doc_id", "th", "item_id", "q", (F.col("p") - F.col("q")).alias("diagonal")))
    if not found:
        return docs.sparkSession.createDataFrame([], MATCHES)
    met = written(functools.reduce(DataFrame.unionByName, found).filter("doc_id IS NOT NULL").distinct(), "bench-met")
    known = ["doc_id", "th", "item_id"]
    # windows that cover a share of the words are at least a WINDOW-th as many
    likely = f"n_found * size * 100 >= n_words * {COVERED_PERCENT} OR n_found + size > {RUN}"
    pairs = met.groupBy(*known).agg(F.countDistinct("q").alias("n_found")).join(items.select("item_id", "n_words", "size"), "item_id").filter(likely).select(*known)
    places = met.join(pairs, known, "left_semi").groupBy(*known, "diagonal").agg(F.array_sort(F.collect_set("q")).alias("qs"))
    places = written(places, "bench-places")
    discard(met, own)
    small = places.count() <= BROADCAST_ROWS // 10
    source = docs.select("doc_id", "text", th)
    if small:
        source = source.join(F.broadcast(places.select("doc_id", "th").distinct()), ["doc_id", "th"], "left_semi")
    placed = source.join(F.broadcast(places) if small else places, ["doc_id", "th"]).withColumn("words", words_of(F.col("text"))).drop("text").join(items, "item_id")
    span = "sequence(q, q + size - 1)"
    slot, value = f"item_codes[k] BETWEEN {NUMBER} AND {UNIT}", "get(words, CAST(k + diagonal AS INT))"
    values = F.expr(f"array_distinct(transform(filter(array_distinct(flatten(transform(qs, q -> {span}))), k -> {slot}), k -> struct(item_words[k] AS a, {value} AS b)))")
    # the changed values of those that have another value elsewhere on the diagonal; none where each value has one
    conflicts = F.expr(
        "CASE WHEN size(array_distinct(transform(pairs, x -> x.a))) = size(pairs) THEN slice(pairs, 1, 0)"
        " ELSE filter(pairs, x -> x.a <> x.b AND exists(pairs, y -> y.a = x.a AND y.b <> x.b)) END"
    )
    good = F.expr(f"filter(qs, q -> NOT exists({span}, k -> {slot} AND array_contains(conflicts, struct(item_words[k] AS a, {value} AS b))))")
    longest = F.expr(
        "aggregate(good, named_struct('last', -9, 'n', 0, 'most', 0), (s, q) -> named_struct('last', q, 'n', IF(q = s.last + 1, s.n + 1, 1),"
        " 'most', greatest(s.most, IF(q = s.last + 1, s.n + 1, 1))), s -> s.most + size - 1)"
    )
    same = F.expr(f"forall(good, q -> forall({span}, k -> NOT ({slot}) OR item_words[k] = {value}))")
    each = placed.withColumn("pairs", values).withColumn("conflicts", conflicts).withColumn("good", good).filter(F.size("good") > 0)
    each = each.select(*known, "n_words", "size", longest.alias("longest"), same.alias("same"), F.explode("good").alias("q"))
    per = each.groupBy(*known, "n_words", "size").agg(F.max("longest").cast("long").alias("longest_run"), F.min("same").alias("exact"), F.collect_set("q").alias("good"))
    per = per.withColumn("n_covered", F.expr(f"size(array_distinct(flatten(transform(good, q -> {span}))))").cast("long"))
    per = per.filter((F.col("longest_run") >= RUN) | (F.col("n_covered") * 100 >= F.col("n_words") * COVERED_PERCENT))
    best = F.max(F.struct("n_covered", "longest_run", "exact", "n_words")).alias("best")
    return per.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_words", "best.n_covered", "best.longest_run", "best.exact")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, nor a large part of one, all columns."""
    return docs.join(matches(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'b', item_id, regexp_extract_all(text, '[\p{L}\p{N}]+') FROM benchmark WHERE text IS NOT NULL
),
coded AS (
  SELECT kind, id, w, len(w) AS n, list_transform(w, lambda x: CASE WHEN ascii(x) BETWEEN 48 AND 57 THEN '#1' WHEN lower(x) <> x THEN '#2' WHEN list_contains([%s], x) THEN '#3' ELSE x END) AS c
  FROM words WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT least(n, 5) AS size FROM coded WHERE kind = 'b'),
starts AS (
  SELECT kind, id, w, c, n, size, unnest(range(0, n - size + 1)) AS p FROM coded, sizes WHERE n >= size AND (kind = 'd' OR size = least(n, 5))
),
win AS (
  SELECT kind, id, n, size, p, CASE WHEN size = 5 AND len(list_filter(c[p + 1 : p + size], lambda x: x NOT IN ('#1', '#2', '#3'))) > 0
    THEN array_to_string(c[p + 1 : p + size], ' ') ELSE '= ' || array_to_string(w[p + 1 : p + size], ' ') END AS t FROM starts
),
met AS (
  SELECT DISTINCT d.id AS doc_id, b.id AS item_id, b.n AS n_words, b.size, b.p AS q, d.p - b.p AS diagonal
  FROM win d JOIN win b ON d.t = b.t AND d.size = b.size AND d.kind = 'd' AND b.kind = 'b'
),
places AS (SELECT DISTINCT doc_id, item_id, diagonal, unnest(range(q, q + size)) AS k FROM met),
slots AS (
  SELECT doc_id, item_id, diagonal, k, i.w[k + 1] AS a, x.w[k + diagonal + 1] AS b FROM places
  JOIN coded i ON i.kind = 'b' AND i.id = item_id JOIN coded x ON x.kind = 'd' AND x.id = doc_id WHERE i.c[k + 1] IN ('#1', '#2', '#3')
),
torn AS (SELECT doc_id, item_id, diagonal, a FROM slots GROUP BY ALL HAVING count(DISTINCT b) > 1),
bad AS (SELECT doc_id, item_id, diagonal, k FROM slots JOIN torn USING (doc_id, item_id, diagonal, a) WHERE a <> b),
good AS (
  SELECT * FROM met m WHERE NOT EXISTS (SELECT 1 FROM bad x WHERE x.doc_id = m.doc_id AND x.item_id = m.item_id AND x.diagonal = m.diagonal AND x.k >= m.q AND x.k < m.q + m.size)
),
other AS (
  SELECT DISTINCT g.doc_id, g.item_id FROM good g JOIN slots x ON x.doc_id = g.doc_id AND x.item_id = g.item_id AND x.diagonal = g.diagonal AND x.k >= g.q AND x.k < g.q + g.size
  WHERE x.a <> x.b
),
numbered AS (SELECT *, q - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY q) AS island FROM good),
runs AS (SELECT doc_id, item_id, count(*) + any_value(size) - 1 AS run FROM numbered GROUP BY doc_id, item_id, diagonal, island),
longest AS (SELECT doc_id, item_id, max(run) AS longest_run FROM runs GROUP BY ALL),
covered AS (SELECT doc_id, item_id, n_words, count(DISTINCT k) AS n_covered FROM (SELECT doc_id, item_id, n_words, unnest(range(q, q + size)) AS k FROM good) GROUP BY ALL)
SELECT doc_id, item_id, CAST(n_words AS BIGINT) AS n_words, n_covered, CAST(longest_run AS BIGINT) AS longest_run, o.doc_id IS NULL AS exact
FROM covered JOIN longest USING (doc_id, item_id) LEFT JOIN other o USING (doc_id, item_id) WHERE longest_run >= 13 OR n_covered * 100 >= n_words * 60
""" % ", ".join(f"'{u}'" for u in UNITS)
