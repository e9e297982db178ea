"""URL filters: host word segmentation and naive Bayes.

The labels of a host and the parts of its path are cut into words: a unigram Viterbi search finds the split with the
largest likelihood under word counts. A multinomial naive Bayes classifier then scores the words of host and path. It
learns from all URLs: those whose words hold one of the seed words count as bad, the others as good. Fixed rules for
(host, path) come first, the longest that fits deciding.

Words are counted in the texts of all pages (where there is a column html), in all paths, and in host labels, there once for each further host that has the
label: a name of one host is to be split, not a word. The fixed lists have a small share of the counts. A word has 2 to MAX_WORD letters.

How it scales: each different part of a URL is split once. Its substrings are joined with the counts, which stay distributed, and a task gets a part with those
of its substrings that are words. Different URLs get the words of their parts by a join, and pages the scores of their URLs. Only the naive Bayes counts
of BUCKETS hashed words go to the driver and into tasks. Counting covers every row and is pre-aggregated.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, no words, and the class that the
prior favours or, without learning rows, ``allow``; equal scores give ``allow``; of equal splits the one whose last word is longest wins; long parts and texts are
read whole; repeated rows are judged alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_step, discard, table, written

#: (verdict, host, path), as the contract of the query gives them.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BUCKETS = 1 << 14
MAX_WORD = 24

#: Each word of the fixed lists counts as this share of all.
FIXED_SHARE = 1e-4
#: What an unknown word costs beyond a word seen once, and for each of its letters.
UNKNOWN, LETTER = math.log(10), 2.3

#: Words whose presence marks a URL as bad while learning.
SEEDS = (
    "adult", "bet", "bets", "betting", "bitcoin", "cam", "casino", "cheap", "crack", "cracked", "dating", "escort", "farm", "free",
    "gambling", "hack", "hot", "keygen", "loan", "loans", "lottery", "malware", "nude", "pharma", "phishing", "pills", "poker",
    "porn", "prize", "replica", "sex", "sexy", "slot", "slots", "spam", "torrent", "viagra", "warez", "win", "winner", "xxx",
)
#: Frequent words of hosts and paths, which split names even where the corpus lacks them.
COMMON = (
    "about", "and", "art", "article", "best", "blog", "book", "books", "business", "city", "club", "com", "daily", "data", "de",
    "digital", "en", "es", "example", "for", "forum", "fr", "game", "games", "global", "group", "health", "help", "home", "html", "info",
    "in", "index", "learn", "life", "local", "magazine", "map", "market", "media", "mobile", "music", "my", "net", "network", "news",
    "of", "on", "online", "open", "org", "page", "photo", "post", "press", "review", "school", "science", "search", "shop",
    "site", "sport", "store", "study", "tech", "the", "times", "to", "today", "tools", "tour", "travel", "university", "video",
    "web", "wiki", "world", "www", "your",
)

PART = r"(\p{L}+|\p{Nd}+)"
MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of() -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def segmented(name: str, costs: dict[str, float], unknown: float) -> list[str]:
    """The cheapest split of a name into words; costs are those of the words in it, and others cost unknown and LETTER a letter."""
    n = len(name)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - MAX_WORD), end):
            word = name[start:end]
            cost = best[start] + (costs[word] if word in costs else unknown + LETTER * len(word))
            if cost < best[end]:
                best[end], back[end] = cost, start
    out = []
    while n:
        out.append(name[back[n] : n])
        n = back[n]
    return out[::-1]


def parsed(pages: DataFrame) -> DataFrame:
    url = F.col("url")
    return pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))


def parts_of(text: str):
    return F.regexp_extract_all(F.lower(text), F.lit(PART), F.lit(1))


def word_counts(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """(w, n) of all words; urls: the different hosts and paths with their rows."""
    paths = urls.select(F.explode(parts_of("path")).alias("w"), "n")
    labels = urls.select("host").distinct().select(F.explode(F.array_distinct(parts_of("host"))).alias("w")).groupBy("w").agg((F.count(F.lit(1)) - 1).alias("n"))
    found = paths.unionByName(labels.filter("n > 0"))
    if "html" in pages.columns:
        texts = pages.select(F.explode(parts_of(F.regexp_replace("html", MARKUP, " "))).alias("w"))
        found = found.unionByName(texts.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    return found.filter(f"length(w) BETWEEN 2 AND {MAX_WORD} AND w RLIKE '^\\\\p{{L}}'").groupBy("w").agg(F.sum("n").alias("n"))


def splits(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(part, words): each different part of the hosts and paths, and its words; numbers are one word."""
    spark = urls.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    fixed = spark.createDataFrame([(w, max(1, int(total * FIXED_SHARE))) for w in sorted({*COMMON, *SEEDS})], "w string, n long")
    total += fixed.agg(F.sum("n")).first()[0]
    costs = counts.unionByName(fixed).groupBy("w").agg((F.log(F.lit(float(total))) - F.log(F.sum("n").cast("double"))).alias("cost"))
    parts = urls.select(F.explode(F.concat(parts_of("host"), parts_of("path"))).alias("part")).distinct()
    names = parts.filter("part RLIKE '^\\\\p{L}'").withColumn("id", F.md5("part"))
    starts = names.filter("length(part) > 1").select("id", "part", F.explode(F.expr("sequence(1, length(part) - 1)")).alias("i"))
    pieces = starts.select("id", F.expr(f"substr(part, i, {MAX_WORD})").alias("rest")).select("id", "rest", F.explode(F.expr("sequence(2, greatest(2, length(rest)))")).alias("k"))
    pieces = pieces.select("id", F.expr("left(rest, k)").alias("w")).distinct()
    known = pieces.join(costs, "w").groupBy("id").agg(F.collect_list(F.struct("w", "cost")).alias("known"))
    unknown = math.log(total) + UNKNOWN

    def cut(batches):
        for b in batches:
            words = [segmented(p, {x["w"]: x["cost"] for x in k or ()}, unknown) for p, k in zip(b.column("part").to_pylist(), b.column("known").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(words, pa.list_(pa.string()))], ["part", "words"])

    split = arrow_step(names.join(known, "id", "left").select("part", "known"), cut, "part string, words array<string>")
    return split.unionByName(parts.filter("part RLIKE '^\\\\p{Nd}'").select("part", F.array(F.lit("<num>")).alias("words")))


def url_words(urls: DataFrame, split: DataFrame) -> DataFrame:
    """urls with words, those of the host and the path in their order."""
    each = urls.select("host", "path", F.posexplode(F.concat(parts_of("host"), parts_of("path"))).alias("pos", "part"))
    found = each.join(split, "part").groupBy("host", "path").agg(F.sort_array(F.collect_list(F.struct("pos", "words"))).alias("all"))
    found = found.select("host", "path", F.flatten(F.col("all.words")).alias("words"))
    return urls.join(found, ["host", "path"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


class Bayes:
    def __init__(self, rows: list[tuple[int, int, int]], docs: tuple[int, int]) -> None:
        sums = [sum(n for _, k, n in rows if k == c) for c in (0, 1)]
        of = {(b, k): n for b, k, n in rows}
        self.odds = {b: math.log((of.get((b, 1), 0) + 1) / (sums[1] + BUCKETS)) - math.log((of.get((b, 0), 0) + 1) / (sums[0] + BUCKETS)) for b in {b for b, _, _ in rows}}
        self.none = math.log(sums[0] + BUCKETS) - math.log(sums[1] + BUCKETS)
        self.prior = math.log((docs[1] + 1) / (docs[0] + 1)) if sum(docs) else -1.0

    def score(self, words: list[str]) -> float:
        return self.prior + sum(self.odds.get(bucket(w), self.none) for w in words)


def fit(words: DataFrame) -> Bayes:
    """Learn from (words, n): a URL's words, and how many rows have it."""
    seeds = F.array(*[F.lit(w) for w in SEEDS])
    known = words.select("words", "n", F.arrays_overlap("words", seeds).cast("int").alias("k"))
    docs = {r["k"]: int(r["n"]) for r in known.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    each = known.select(F.explode("words").alias("w"), "k", "n")
    got = each.groupBy(F.pmod(F.crc32(F.col("w").cast("binary")), F.lit(BUCKETS)).cast("int").alias("b"), "k").agg(F.sum("n").alias("n")).collect()
    return Bayes([(r["b"], r["k"], int(r["n"])) for r in got], (docs.get(0, 0), docs.get(1, 0)))


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds that it is bad), words."""
    rows = parsed(pages)
    urls = written(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "url-rows")
    counts = written(word_counts(pages, urls), "url-counts")
    split = written(splits(urls, counts), "url-splits")
    words = written(url_words(urls, split), "url-words")
    discard(counts, split, urls)
    bayes = fit(words)

    def run(batches):
        for b in batches:
            score = [bayes.score(w) for w in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("path"), pa.array(score, pa.float64()), b.column("words")], ["host", "path", "score", "words"])

    scored = arrow_step(words.select("host", "path", "words"), run, "host string, path string, score double, words array<string>")
    rule, verdict = rule_of()
    judged = rows.join(scored, ["host", "path"], "left").withColumns({"rule": rule, "verdict": verdict})
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.array_join("words", " ").alias("words"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
