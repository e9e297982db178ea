"""Byte-level BPE encoding and decoding.

A piece (one match of the splitting pattern) is mapped byte by byte to Latin-1, so that an Aho-Corasick automaton over the
vocabulary finds, for each place, all tokens that start there. The encoder takes the longest one and moves on while
each token is compatible with the one before it; where no token fits, it steps back and goes on with the next shorter one. Two tokens
are compatible when merging their joint bytes gives just these two again; that is computed once for a pair and kept.
A place from which no way on was found is marked and never tried again, so each place and token is tried once: linear time.
The result is the one that repeated merging by rank gives.

Which characters are letters and numbers differs between Unicode versions; here they are what the library takes for such, asked from it once.

Texts are cut into units first (an optional space and a run of other characters, or white space by the pattern's rule); no match of the
pattern spans two of them. A unit's ids are kept in a bounded memo, as texts repeat their words.

Defined results: a null text counts as an empty one, which has no tokens; lone surrogates are replaced as UTF-8 replaces them;
repeated rows give repeated results; of tokens that could start at a place the longest that leads to an end is taken (no ties arise); extra columns are ignored; an empty table gives an empty result. Texts and pieces of any
length are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_step, table, texts_of

#: Units kept in the memo; it starts anew when full.
MEMO_UNITS = 600_000
#: Longer units are encoded without being kept.
MEMO_CHARS = 64

# Unicode's White_Space, as the pattern's \s has it.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNITS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")



def library_class(name: str) -> set[str]:
    """The characters of a class, like ``\\p{L}``, as the library has them."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    found = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return set(bytes(found.encode_ordinary(every)).decode())


def ranges(chars: set[str]) -> str:
    """The characters as the inside of a class."""
    codes = sorted(map(ord, chars))
    starts = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    ends = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


@functools.cache
def letters_and_numbers() -> tuple[str, str, str]:
    """The library's letters and numbers, and all characters that Python's tables class in another way; each as the inside of a class."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    letters, numbers = library_class(r"\p{L}"), library_class(r"\p{N}")
    odd = (set(regex.findall(r"\p{L}", every)) ^ letters) | (set(regex.findall(r"\p{N}", every)) ^ numbers) | (set(filter(str.isalpha, every)) - letters)
    return ranges(letters), ranges(numbers), ranges(odd)


_coders: dict[tuple[str, str], "Coder"] = {}


class Coder:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        pattern = pattern.replace(r"\s", f"[{_WS}]").replace(f"[^[{_WS}]", f"[^{_WS}").replace(r"\S", f"[^{_WS}]")
        self.pieces = regex.compile(pattern).findall
        letters, numbers, odd = letters_and_numbers()
        # the pattern in the library's classes is slower, so only units with a character that is classed in another way get it
        self.odd = re.compile(f"[{odd}]").search if odd else lambda unit: None
        for name, inside in ((r"\p{L}", letters), (r"\p{N}", numbers)):
            pattern = re.sub(r"(\[[^\]]*?)" + re.escape(name), lambda m: m[1] + inside, pattern).replace(name, f"[{inside}]")
        self.exact = regex.compile(pattern).findall
        self.lengths = list(map(len, self.bytes_of))
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.names = [str(i) for i in range(len(self.bytes_of))]

    @classmethod
    def load(cls, path: str, pattern: str) -> "Coder":
        key = (path, pattern)
        if key not in _coders:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
            _coders[key] = cls(ranks, pattern)
        return _coders[key]

    def merged(self, data: bytes) -> list[int]:
        """Merging by rank, for the few bytes of two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            got = self.fits[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        at: list[list[int]] = [[] for _ in range(n)]
        for end, (length, rank) in self.automaton.iter(data.decode("latin-1")):
            at[end - length + 1].append(rank)  # ends ascend, so each list goes from short to long
        fits, lengths = self.fits, self.lengths
        closed: set[int] = set()
        tokens: list[int] = []
        passed: list[list[int]] = []  # by chosen token: the shorter candidates of its place
        pos, left, last = 0, at[0], -1
        while pos < n:
            while left:
                rank = left.pop()
                to = pos + lengths[rank]
                if to in closed:
                    continue
                if last >= 0:
                    good = fits.get((last, rank))
                    if good is None:
                        good = self.compatible(last, rank)
                    if not good:
                        continue
                tokens.append(rank)
                passed.append(left)
                pos, last = to, rank
                left = at[pos].copy() if pos < n else []
                break
            else:
                if not tokens:
                    raise ValueError("the vocabulary lacks single bytes")
                closed.add(pos)
                pos -= lengths[tokens.pop()]
                left = passed.pop()
                last = tokens[-1] if tokens else -1
        return tokens

    def encode_unit(self, unit: str) -> tuple[int, ...]:
        """The ids of a unit; words of letters, also with one ASCII mark behind, need no pattern."""
        body = unit[1:] if unit[0] == " " else unit
        odd = not unit.isascii() and self.odd(unit)
        if odd:
            pass
        elif body.isalpha():
            return tuple(self.encode_piece(unit.encode()))
        elif body[:-1].isalpha() and body[-1] in ".,;:!?":
            word = self.memo.get(unit[:-1])
            return (*(self.encode_piece(unit[:-1].encode()) if word is None else word), self.ranks[unit[-1].encode()])
        out: list[int] = []
        for piece in (self.exact if odd else self.pieces)(unit):
            out += self.encode_piece(piece.encode("utf-8", "replace"))
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        memo = self.memo
        units = UNITS.findall(text)
        got = list(map(memo.get, units))
        if None in got:
            for i, ids in enumerate(got):
                if ids is None:
                    unit = units[i]
                    ids = memo.get(unit)
                    if ids is None:
                        ids = self.encode_unit(unit)
                        if len(unit) <= MEMO_CHARS:
                            if len(memo) >= MEMO_UNITS:
                                memo.clear()
                            memo[unit] = ids
                    got[i] = ids
        return list(chain.from_iterable(got))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """All columns of docs, with ``ids`` added (or replaced)."""
    from pyspark.sql import functions as F

    path, pattern = (path, pattern) if path and pattern else default_vocabulary()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        coder = Coder.load(path, pattern)
        return pd.Series([coder.encode(t or "") for t in texts])

    return docs.withColumn("ids", ids(text))


def decode(tokens: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """All columns of tokens, with ``decoded`` (the bytes of the ids) added; null ids count as none."""
    from pyspark.sql import functions as F

    known, pattern = default_vocabulary()
    path = path or known

    @F.pandas_udf("binary")
    def decoded(rows: pd.Series) -> pd.Series:
        coder = Coder.load(path, pattern)
        return pd.Series([coder.decode(list(r)) if r is not None else b"" for r in rows])

    return tokens.withColumn("decoded", decoded(ids))


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode, decode, and return what identifies both, without shipping ids out of the Python step."""
    path, pattern = (path, pattern) if path and pattern else default_vocabulary()

    def run(batches):
        coder = Coder.load(path, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            n, a, d = [], [], []
            for t in texts_of(b):
                ids = coder.encode(t)
                n.append(len(ids))
                a.append(sha(" ".join(map(coder.names.__getitem__, ids)).encode()))
                d.append(sha(coder.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_step(docs.select("doc_id", "text"), run, DIGESTS)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
