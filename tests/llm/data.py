"""Small document tables with every edge case."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, size string, label int, bucket int, _row int, key int"


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def fold(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def sentence(rng: random.Random, n: int, vocabulary: int = 300) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" if rng.random() < 0.97 else rng.choice(["Ünï", "É", "the,", "ß"]) for _ in range(n)]


def texts(seed: int = 1, base: int = 40) -> list[str | None]:
    """Unrelated texts, exact and near copies, shared passages, and odd ones."""
    rng = random.Random(seed)
    out: list[str | None] = [" ".join(sentence(rng, rng.randrange(1, 160))) for _ in range(base)]
    passage = sentence(rng, 60)
    for _ in range(12):
        out.append(" ".join(sentence(rng, rng.randrange(0, 80)) + passage + sentence(rng, rng.randrange(0, 80))))
    for origin in (sentence(rng, 120), sentence(rng, 30), sentence(rng, 9), sentence(rng, 6)):
        for _ in range(14):  # a group larger than the limit for all pairs, with links of every strength
            copy = list(origin)
            for _ in range(rng.randrange(0, 6)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], ["new" + str(rng.randrange(50))], [copy[at], "x"]])
            out.append(" ".join(copy))
    out += [None, "", "  \n\t ", "one", "One", "ONE", "two words", "É", "é", "a b c d", "a b c d e", "A B c D e", None, ""]
    out += [" ".join(["same"] * 90), "same " * 200, "x" * 5000, "\n".join(["line of words"] * 30), "\x0b\x0c a\x0bb \r\n c"]
    out += [out[3], out[3], str(out[4]).upper(), str(out[5]) + " ", " ".join(sentence(rng, 3000))]
    return out


def documents(spark, rows: list[str | None] | None = None, ids: list[int | None] | None = None):
    rows = texts() if rows is None else rows
    ids = list(range(len(rows))) if ids is None else ids
    data = [
        (i, t, None if k % 11 == 3 else ("en", "fr", "de")[k % 3], None if k % 7 == 5 else f"s{k % 4}", None, k, "clash", k, None, 1, None)
        for k, (i, t) in enumerate(zip(ids, rows, strict=True))
    ]
    return spark.createDataFrame(data, SCHEMA)
