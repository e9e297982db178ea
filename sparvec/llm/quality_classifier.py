"""Quality classifier: co-training of two views.

One classifier sees the content of a text (which of its words and their beginnings are in a vocabulary, and shares of symbols, capitals and repeats), the other
the page's metadata, which are the columns beside the text (source, language and length). Each is a logistic regression. Over ROUNDS rounds both are trained, each
labels the unlabelled rows of which it is sure, and these labels go into the other's training rows. Then each view's log odds are
calibrated on labelled rows, and the calibrated views are combined on others; neither were seen by training nor by the choice of the vocabulary, and
their rows weigh as much as their kind is frequent among all labelled rows. All documents are scored.

A document is bad when its label says low quality or toxic. Learning reads at most PER_KIND rows of each kind (good, low
quality, toxic, unlabelled), those with the least hash of their id, and a vocabulary of the VOCABULARY terms with the largest
chi-square; so what goes to the driver and into tasks is bounded. Scoring reads whole texts.

Defined results: a null text counts as an empty one; null metadata is a value of its own; without labelled rows of both kinds
everything is kept with score 0.5; of several labels of one id the worst counts; repeated rows are scored alike; extra columns
are ignored (``good`` keeps them); an empty table gives an empty result; a document at the threshold is kept.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_step, discard, table, written

PER_KIND = 2_000
VOCABULARY = 1_000
ROUNDS = 4
#: The shares of rows held out for calibration, and for combination, in percent.
CALIBRATED, COMBINED = 15, 15
#: Pseudo-labels are taken from rows with at least this probability, at most PSEUDO of each kind a round.
SURE = 0.97
PSEUDO = 300
STEPS = 250
#: Documents with at least this probability of being good are kept.
KEEP = 0.5
SOURCES = 64

#: Terms in fewer learning rows are left out, and those whose chi-square is below a quarter of the rows, within these limits.
MIN_ROWS = 5
MIN_CHI, MAX_CHI = 10.0, 60.0
PREFIXES = (3, 4, 5)

PUNCTUATION = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”’…"})
SYMBOL = re.compile(r"[#*$%&|<>]")
LANGUAGES, LENGTHS = 16, 24
META = SOURCES + LANGUAGES + LENGTHS
#: Shares that the content view has besides its terms.
SHARES = 7


def terms_of(text: str) -> set[str]:
    """The words of a text, and their beginnings of PREFIXES letters."""
    words = set(text.lower().translate(PUNCTUATION).split())
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + "-" for w in words if len(w) > n])
    return out


def shares(text: str) -> list[float]:
    """Of symbols, exclamations, repeated words, different words, line ends, capitals and digits."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    return [
        min(1.0, 3 * len(SYMBOL.findall(text)) / n),
        min(1.0, 3 * text.count("!!") / n),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        min(1.0, len(set(words)) / n),
        min(1.0, text.count("\n") / n * 4),
        min(1.0, 2 * sum(map(str.isupper, words)) / n),
        min(1.0, sum(map(text.count, "0123456789")) / chars * 10),
    ]


def metadata(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """The metadata view: indicators of source, language and length."""
    v = np.zeros(META, np.float32)
    v[zlib.crc32(("" if source is None else "s" + source).encode()) % SOURCES] = 1
    v[SOURCES + zlib.crc32(("" if lang is None else "l" + lang).encode()) % LANGUAGES] = 1
    if n_chars is not None:
        v[SOURCES + LANGUAGES + min(LENGTHS - 1, max(0, n_chars).bit_length())] = 1
    return v


def content(texts: list[str], index: dict[str, int]) -> np.ndarray:
    """The content view: which words of the vocabulary a text has, and its shares."""
    m = np.zeros((len(texts), len(index) + SHARES), np.float32)
    keys = index.keys()
    for i, t in enumerate(texts):
        m[i, len(index) :] = shares(t)
        if index:
            m[i, [index[w] for w in terms_of(t) & keys]] = 1
    return m


class Logistic:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, decay: float = 2e-4, steps: int = STEPS, weights: np.ndarray | None = None) -> "Logistic":
        """Without weights both classes weigh the same. Adam on the whole batch, from zero, so the result is deterministic."""
        sample = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) if weights is None else weights / weights.sum()
        sample = sample.astype(np.float32)
        w, b = np.zeros(x.shape[1], np.float32), 0.0
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
            e = sample * (p - y)
            g = np.append(x.T @ e + decay * w, e.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
        return cls(w, b)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


class Model:
    def __init__(self, index: dict[str, int], text: Logistic, meta: Logistic, calibrated: tuple[Logistic, Logistic], combined: Logistic) -> None:
        self.index, self.text, self.meta, self.calibrated, self.combined = index, text, meta, calibrated, combined

    def score(self, texts: list[str], sources: list, langs: list, lengths: list) -> np.ndarray:
        """Columns: probability of being good by both views, by content, by metadata."""
        if not texts:
            return np.zeros((0, 3))
        views = (self.text.odds(content(texts, self.index)), self.meta.odds(np.stack([metadata(*x) for x in zip(sources, langs, lengths)])))
        odds = np.stack([c.odds(v[:, None]) for c, v in zip(self.calibrated, views)], axis=1)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([self.combined.odds(odds), odds]), -30, 30)))


def cotrain(index: dict[str, int], x_text: np.ndarray, x_meta: np.ndarray, y: np.ndarray, held: np.ndarray, weights: np.ndarray) -> Model | None:
    """y: 1 good, 0 bad, -1 unlabelled; held: 0 for training, 1 for calibration, 2 for combination; weights: of the rows that are held out."""
    known, pool = (y >= 0) & (held == 0), (y < 0) & (held == 0)
    if any(len(set(y[(y >= 0) & (held == k)])) < 2 for k in range(3)):
        return None
    x = (x_text, x_meta)
    labels = [np.where(known, y, -1), np.where(known, y, -1)]  # each view's own training labels
    models = [Logistic.fit(v[k >= 0], k[k >= 0]) for v, k in zip(x, labels)]
    for _ in range(ROUNDS):
        for mine, other in ((0, 1), (1, 0)):
            free = np.flatnonzero(pool & (labels[other] < 0))
            p = 1 / (1 + np.exp(-np.clip(models[mine].odds(x[mine][free]), -30, 30)))
            for kind, sure in ((1, p), (0, 1 - p)):
                order = np.argsort(-sure, kind="stable")[:PSEUDO]
                labels[other][free[order[sure[order] >= SURE]]] = kind
        models = [Logistic.fit(v[k >= 0], k[k >= 0]) for v, k in zip(x, labels)]
    first, second = (y >= 0) & (held == 1), (y >= 0) & (held == 2)
    calibrated = tuple(Logistic.fit(m.odds(v[first])[:, None], y[first], 1e-4, weights=weights[first]) for m, v in zip(models, x))
    odds = np.stack([c.odds(m.odds(v[second])[:, None]) for c, m, v in zip(calibrated, models, x)], axis=1)
    return Model(index, models[0], models[1], calibrated, Logistic.fit(odds, y[second], 1e-4, weights=weights[second]))


def held_out():
    """0 for training, 1 for calibration, 2 for combination."""
    of = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(100))
    return F.when(of < CALIBRATED, 1).when(of < CALIBRATED + COMBINED, 2).otherwise(0).alias("held")


def views(docs: DataFrame) -> list:
    """The columns that scoring reads; the length is that of the text where there is no column for it."""
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.char_length("text").cast("long")
    return [F.coalesce("text", F.lit("")).alias("text"), F.col("source"), F.col("lang"), length.alias("n_chars")]


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    spark = docs.sparkSession
    mixed = F.xxhash64("doc_id")
    worst = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    here = docs.select("doc_id").filter("doc_id IS NOT NULL").join(worst.withColumn("l", F.lit(True)), "doc_id", "left").distinct()
    kind = F.when(F.col("l").isNull(), -1).when(F.col("t") == 1, 2).when(F.col("q") == 0, 3).when((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0), 1)
    here = here.select("doc_id", kind.alias("kind"), mixed.alias("h"))
    chosen = None
    for k in (-1, 1, 2, 3):
        part = here.filter(F.col("kind") == k).orderBy("h", "doc_id").limit(PER_KIND)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 4 * PER_KIND ids
    sample = docs.select("doc_id", *views(docs)).withColumn("held", held_out()).join(F.broadcast(chosen.select("doc_id", "kind")), "doc_id")
    sample = written(sample.dropDuplicates(["doc_id"]), "classifier-sample")

    def terms(batches):
        for b in batches:
            got = Counter((w, k) for t, k in zip(b.column("text").to_pylist(), b.column("kind").to_pylist()) for w in terms_of(t))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in got], pa.string()), pa.array([k for _, k in got], pa.int32()), pa.array(list(got.values()), pa.int64())], ["w", "kind", "n"])

    labelled = sample.filter("kind > 0 AND held = 0").select("text", "kind")
    kinds = {r["kind"]: r["count"] for r in labelled.groupBy("kind").count().collect()}
    counts = arrow_step(labelled, terms, "w string, kind int, n long").groupBy("w").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3)])
    n, good = sum(kinds.values()), kinds.get(1, 0)
    # the larger of the chi-squares of good against toxic and good against low quality
    def chi(a: str, na: int, b: str, nb: int):
        p = (F.col(a) + F.col(b) + 0.5) / F.lit(float(max(1, na + nb) + 1))
        e = F.col(a) - p * na
        x = e * e / (p * (1.0001 - p) * max(1, na) * max(1, nb)) * max(1, na + nb)
        # only terms that are more frequent in bad rows: what a short text lacks is no sign of anything
        return F.when(F.col(b) * max(1, na) > F.col(a) * max(1, nb), x).otherwise(F.lit(0.0))

    best = F.greatest(*[chi("n1", good, f"n{k}", kinds.get(k, 0)) for k in (2, 3)])
    top = counts.filter(F.col("n1") + F.col("n2") + F.col("n3") >= MIN_ROWS).select("w", best.alias("x")).filter(F.col("x") >= min(MAX_CHI, max(MIN_CHI, n / 4))).orderBy(F.desc("x"), "w").limit(VOCABULARY).collect() if n else []
    index = {r["w"]: i for i, r in enumerate(sorted(top, key=lambda r: r["w"]))}

    def features(batches):
        for b in batches:
            seen = content(b.column("text").to_pylist(), index)
            meta = [metadata(*x).tobytes() for x in zip(*(b.column(c).to_pylist() for c in ("source", "lang", "n_chars")))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("kind"), b.column("held"), pa.array([x.tobytes() for x in np.packbits(seen[:, : len(index)].astype(bool), axis=1)], pa.binary()), pa.array([x.tobytes() for x in seen[:, len(index) :]], pa.binary()), pa.array(meta, pa.binary())], ["doc_id", "kind", "held", "bits", "shares", "meta"])

    rows = arrow_step(sample.select("doc_id", "kind", "held", "text", "source", "lang", "n_chars"), features, "doc_id long, kind int, held int, bits binary, shares binary, meta binary").collect()
    # of all labelled rows, not of the sample
    frequent = {r["kind"]: r["count"] for r in here.groupBy("kind").count().collect()}
    discard(sample)
    if not rows:
        return None
    rows.sort(key=lambda r: r["doc_id"])
    floats = lambda c: np.stack([np.frombuffer(bytes(r[c]), np.float32) for r in rows])
    bits = np.stack([np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8))[: len(index)] for r in rows]).astype(np.float32)
    y = np.array([{-1: -1, 1: 1}.get(r["kind"], 0) for r in rows])
    sampled = Counter(r["kind"] for r in rows)
    weights = np.array([frequent[r["kind"]] / sampled[r["kind"]] for r in rows])
    return cotrain(index, np.concatenate([bits, floats("shares")], axis=1), floats("meta"), y, np.array([r["held"] for r in rows]), weights)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, kept, score, content_score, metadata_score (probabilities of being good)."""
    model = fit(docs, labels)

    def run(batches):
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars")]
            p = model.score(*columns) if model else np.full((b.num_rows, 3), 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p[:, 0] >= KEEP), *(pa.array(p[:, k].astype(np.float64)) for k in range(3))], ["doc_id", "kept", "score", "content_score", "metadata_score"])

    return arrow_step(docs.select("doc_id", *views(docs)), run, "doc_id long, kept boolean, score double, content_score double, metadata_score double")


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, all columns."""
    model = fit(docs, labels)
    if model is None:
        return docs

    @F.pandas_udf("boolean")
    def keeps(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.Series:
        plain = lambda s: [None if x is None or x != x else x for x in s]
        lengths = [None if x is None else int(x) for x in plain(n_chars)]
        return pd.Series(model.score(plain(text), plain(source), plain(lang), lengths)[:, 0] >= KEEP)

    return docs.filter(keeps(*views(docs)))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
