"""Quality rules: line-first cleaning.

Every line of a text is judged on its own by punctuation, navigation and boilerplate rules; the lines that fail go, and
then a document that lost too large a part of its text is rejected. Long lines are judged like short ones, by shares of their words. All rules
are linear in the length of a line, also where it is one word.

Defined results: a null text counts as an empty one (no words, base_failed, not kept); a line without a word is neither
judged nor counted as lost; repeated rows are judged one by one and alike; a document that loses just MAX_LOST_PERCENT is kept, and a line at another
limit fails (ties); extra columns are ignored by the query and kept by ``clean``; an empty table gives an empty result. Whole texts are read, of any length.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from .common import arrow_step, table, texts_of, unused

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line fails when symbols make up this share of its word characters.
MAX_SYMBOL_PERCENT = 10
#: A line of at least REPEAT_WORDS words fails when fewer than this share of them differ.
REPEAT_WORDS = 12
MIN_DISTINCT_PERCENT = 25
#: A line of at least SHOUT_WORDS words fails when this share of them end in two exclamation marks.
SHOUT_WORDS = 3
MAX_SHOUT_PERCENT = 50
#: Short lines without closing punctuation are titles, buttons and menus.
MIN_OPEN_WORDS = 4
#: A document that loses more than this share of its word characters is rejected.
MAX_LOST_PERCENT = 50

CLOSING = ".!?\"'»”’…:;)"
#: Marks between the items of a menu or a path, as words of their own; those of MARKS also as the beginning or end of a word.
BETWEEN, MARKS = frozenset("|/>»›•·"), "|»›•·"
#: A menu has at least MIN_MARKS marks, and this many words to an item at most, on average.
MIN_MARKS, ITEM_WORDS = 2, 5
#: A line has boilerplate when it has one phrase to so many words.
PHRASE_WORDS = 40
BOILERPLATE = re.compile(
    r"all rights reserved|licensed under|released under|terms of (?:use|service)|privacy policy|cookie|javascript|lorem ipsum"
    r"|click here|sign up|log ?in\b|subscribe|copyright|\(c\) ?\d{4}|SPDX-License-Identifier",
    re.IGNORECASE,
)

#: Without any of these in its lower case, a text has no phrase of BOILERPLATE, unless it has a letter whose case is irregular.
CORES = (
    "rights reserved", "licensed under", "released under", "terms of ", "privacy policy", "cookie", "javascript", "lorem ipsum",
    "click here", "sign up", "log", "subscribe", "copyright", "(c)", "spdx-license",
)
IRREGULAR = re.compile("[ıİſ\u212a]")


def hints(text: str) -> tuple[bool, bool]:
    """Whether any line of a text can have marks, and whether any can have boilerplate; looked up once for all lines."""
    low = text.lower()
    return any(c in text for c in BETWEEN), any(c in low for c in CORES) or bool(IRREGULAR.search(text))


def line_fails(line: str, marked: bool = True, phrased: bool = True) -> str | None:
    """The name of the first rule that the line breaks, or None. The line has a word. marked, phrased: what ``hints`` says of its text."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    chars = sum(map(len, words))
    if 100 * sum(map(line.count, SYMBOLS)) >= MAX_SYMBOL_PERCENT * chars:
        return "symbols"
    if n >= SHOUT_WORDS and line.count("!!") * 100 >= MAX_SHOUT_PERCENT * n:
        return "shouting"
    if n >= REPEAT_WORDS and 100 * len(set(words)) < MIN_DISTINCT_PERCENT * n:
        return "repetition"
    if n < MIN_OPEN_WORDS and line.rstrip()[-1:] not in CLOSING:
        return "punctuation"
    marks = sum(w in BETWEEN or w[0] in MARKS or w[-1] in MARKS for w in words) if marked else 0
    if marks >= MIN_MARKS and n - sum(w in BETWEEN for w in words) <= ITEM_WORDS * (marks + 1):
        return "navigation"
    if phrased and PHRASE_WORDS * sum(1 for _ in BOILERPLATE.finditer(line)) > n:
        return "boilerplate"
    return None


def cleaned(text: str) -> tuple[str, int, int]:
    """The text without its failing lines, how many lines went, and the word characters lost."""
    kept, gone, lost = [], 0, 0
    marked, phrased = hints(text)
    for line in text.split("\n"):
        if line_fails(line, marked, phrased) is None:
            kept.append(line)
        else:
            gone += 1
            lost += len(line) - sum(map(line.count, SPACES))
    return "\n".join(kept), gone, lost


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    counts = Counter(windows)
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def judged(text: str) -> tuple:
    """The fields of JUDGED behind the id, and the text without its failing lines."""
    words = text.encode("utf-8", "surrogatepass").split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = repeated_words(words)
    base_failed = n_words < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n_words
    left, gone, lost = cleaned(text)
    kept = not base_failed and 100 * lost <= MAX_LOST_PERCENT * word_chars
    return n_words, word_chars, n_symbols, dup, repeat, base_failed, kept, gone, lost, left


JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, n_chars_lost long"


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: counts, verdicts, and what the line rules removed."""
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2
    names = [x.split()[0] for x in JUDGED.split(", ")]

    def run(batches):
        for b in batches:
            cols = list(zip(*(judged(t)[:-1] for t in texts_of(b)))) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return arrow_step(docs.select("doc_id", "text"), run, JUDGED)


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, all columns, with their failing lines removed."""
    kind = StructType([StructField("text", StringType()), StructField("kept", BooleanType())])

    @F.pandas_udf(kind)
    def both(texts: pd.Series) -> pd.DataFrame:
        got = [judged(t or "") for t in texts]
        return pd.DataFrame({"text": [g[-1] for g in got], "kept": [g[6] for g in got]})

    (name,) = unused(docs, "judged")
    mark = F.col(name)
    return docs.withColumn(name, both("text")).filter(mark["kept"]).withColumn("text", mark["text"]).select(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
