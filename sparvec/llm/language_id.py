"""Language ID: nearest of several clustered centroids per language.

A text becomes a vector of hashed n-grams (one to three bytes of its lower-cased letters) with TF-IDF weights and length one.
The vectors of each language's learning rows are clustered by spherical k-means, and a text gets the language of
the centroid with the largest cosine; a text that is farther from it than nearly all learning rows are is marked as rejected.

Learning reads at most PER_LANGUAGE rows of a language, the ones with the least hash of their id, and fewer where more than LEARN_ROWS / PER_LANGUAGE languages
share LEARN_ROWS rows; every language has one at least. That bounds what goes to the driver: vectors of DIMENSIONS exact counts, of two bytes each, or of four
in a text where some count needs them. Prediction reads whole texts and nothing else, SLICE texts at a time.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without learning rows everything is ``und``;
rows without an id aren't held out and not learned from; of equal cosines the first language in alphabetical order wins; repeated rows are predicted alike; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_step, table, texts_of

DIMENSIONS = 1 << 12
PER_LANGUAGE = 500
#: Learning rows of all languages together.
LEARN_ROWS = 128_000
#: Texts whose counts a task holds together.
SLICE = 256
CENTROIDS = 4
ROUNDS = 12
#: The share of learning rows that lies farther from its centroid than the limit for rejection.
REJECT_SHARE = 0.005

LETTER = re.compile(r"[^\W\d_]")
#: ASCII without letters, to spaces.
_PLAIN = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256))


def counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0x27D4EB2F) + b[2:] * np.uint32(0x165667B1)
    shift = np.uint32(20)
    return sum(np.bincount(x >> shift, minlength=DIMENSIONS) for x in (b * np.uint32(0xC2B2AE3D), two * np.uint32(0x9E3779B1), three * np.uint32(0x9E3779B1)))


def packed(many: np.ndarray) -> bytes:
    """Counts as bytes, exactly: two bytes a count, or four when one doesn't fit."""
    return many.astype(np.uint16 if many.max() < 1 << 16 else np.uint32).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * DIMENSIONS else np.uint32)


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, limits: np.ndarray) -> None:
        self.languages, self.idf, self.centroids, self.owner, self.limits = languages, idf, centroids, owner, limits

    def vectors(self, many: np.ndarray) -> np.ndarray:
        v = np.log1p(many) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    @classmethod
    def fit(cls, rows: list[tuple[str, np.ndarray]]) -> "Model | None":
        if not rows:
            return None
        languages = sorted({x for x, _ in rows})
        many = np.stack([c for _, c in rows]).astype(np.float32)
        idf = (np.log((1 + len(many)) / (1 + (many > 0).sum(0))) + 1).astype(np.float32)
        self = cls(languages, idf, np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
        vectors = self.vectors(many)
        centres, owner, limits = [], [], []
        for k, language in enumerate(languages):
            own = vectors[[i for i, (x, _) in enumerate(rows) if x == language]]
            c = own[np.linspace(0, len(own) - 1, min(CENTROIDS, len(own))).astype(int)].copy()
            for _ in range(ROUNDS):
                near = (own @ c.T).argmax(1)
                for j in range(len(c)):
                    if (near == j).any():
                        m = own[near == j].mean(0)
                        c[j] = m / max(float(np.linalg.norm(m)), 1e-12)
            best = (own @ c.T).max(1)
            centres.append(c)
            owner += [k] * len(c)
            limits.append(float(np.quantile(best, REJECT_SHARE)))
        self.centroids, self.owner, self.limits = np.concatenate(centres), np.array(owner), np.array(limits)
        return self

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        known = [i for i, t in enumerate(texts) if LETTER.search(t)]
        for at in range(0, len(known), SLICE):
            part = known[at : at + SLICE]
            many = np.empty((len(part), DIMENSIONS), np.float32)
            for row, i in zip(many, part):
                row[:] = counts(texts[i])
            for i, row in zip(part, self.vectors(many) @ self.centroids.T):
                j = int(row.argmax())
                k = self.owner[j]
                out[i] = self.languages[k], float(min(1.0, max(0.0, row[j]))), bool(row[j] < self.limits[k])
        return out


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(learn: DataFrame) -> Model | None:
    """Learn from the texts and languages of the rows given (doc_id, text, lang)."""
    known = learn.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per = known.groupBy("lang").count().collect()
    if not per:
        return None
    most = max(1, min(PER_LANGUAGE, LEARN_ROWS // len(per)))
    mixed = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30))
    # the low hashes of each language; twice as many as wanted (and all where few are), of which the least are kept below
    limits = learn.sparkSession.createDataFrame([(r["lang"], min(1.0, (2.0 * most + 20) / r["count"]) * (1 << 30)) for r in per], "__lang string, __limit double")
    low = known.select(mixed.alias("__h"), "lang", "text").join(F.broadcast(limits), F.col("lang") == F.col("__lang")).filter("__h < __limit")

    def run(batches):
        for b in batches:
            got = [(h, x, packed(counts(t))) for h, x, t in zip(b.column("__h").to_pylist(), b.column("lang").to_pylist(), texts_of(b)) if LETTER.search(t)]
            h, x, v = zip(*got) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(x, pa.string()), pa.array(v, pa.binary())], ["h", "lang", "v"])

    from pyspark.sql.window import Window

    vectors = arrow_step(low.select("__h", "lang", "text"), run, "h long, lang string, v binary")
    first = Window.partitionBy("lang").orderBy("h", "v")
    rows = vectors.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most).collect()
    rows.sort(key=lambda r: (r["lang"], r["n"]))
    return Model.fit([(r["lang"], unpacked(bytes(r["v"]))) for r in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected (too far from every centroid, or nothing to judge)."""

    def run(batches):
        for b in batches:
            got = model.predict(texts_of(b)) if model else [("und", 0.0, True)] * b.num_rows
            cols = list(zip(*got)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return arrow_step(docs.select("doc_id", held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out())))
