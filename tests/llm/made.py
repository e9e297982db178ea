"""What the tests of this folder read."""

from __future__ import annotations

import random

WORDS = "the of and to in alpha beta gamma delta river stone cloud house paper green seven light world under over small great".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "ing", "ed", "ton", "ly"]) for _ in range(n))


def made_documents() -> list[tuple]:
    """Documents with copies, near copies, shared passages, repeats, nulls, empty and very long texts, and repeated rows."""
    rows = [(i, prose(i, 30 + 7 * i), "en", f"src{i % 3}") for i in range(30)]
    base = prose(5, 65).split()
    rows += [(100 + i, " ".join(base), "en", "src0") for i in range(5)]
    for i in range(40):
        words = prose(5, 65).split()
        for k in range(i % 5):
            words[(7 * i + 13 * k) % len(words)] = f"edit{i % 11}x{k}"
        rows.append((200 + i, " ".join(words), "en", "src0"))
    shared = prose(999, 60)
    rows += [(300 + i, f"{prose(1000 + i, 40)}\n{shared}\n{prose(2000 + i, 20)}", "de", "src1") for i in range(12)]
    rows += [(400, None, "en", None), (401, "", None, "src1"), (402, "a", "fr", "src2"), (403, "a b", "fr", "src2"), (404, "A B", "fr", "src2"), (405, " \n\t ", "fr", "src2")]
    rows += [(410, "ab" * 3000, "en", "src1"), (411, "x" * 900, "en", "src1"), (412, prose(7, 3000) + " end", "en", "src1"), (413, "ü日本\U0001f600 " * 200, "xx", "src1")]
    rows += [rows[3], rows[3], rows[60]]
    return rows
