import random

import pytest

WORDS = [a + b for a in "ba ke lo mi nu pa re si to vu".split() for b in "da fe gi ho ju la me ni po ru sta tre".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, line: int = 12) -> str:
    words = [rng.choice(WORDS) + rng.choice(["", "", "s", "n", "rk"]) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]).capitalize() + "." for i in range(0, n, line))


def row(i, text, source="a"):
    return (i, text, "en", source, None if text is None else len(text))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, odd scripts, and columns whose names the operators use themselves."""
    rng = random.Random(3)
    some = prose(rng, 150)
    rows = [row(1, some), row(1, some), row(2, some), row(3, None), row(None, some), row(None, None), row(4, ""), row(5, " \n \t "), (6, some + "\nx", None, None, None), row(7, "日本語 のテキスト 😀 naïve x"), row(7, "the same id, another text"), row(8, prose(rng, 30_000)), row(9, "the " * 20_000), row(-5, "x" * 100_000), row(10, prose(rng, 40), None), row(11, "a\r\nb\x00c\x0bd")]
    names = ["d", "g", "b", "s", "rate", "end", "before", "shift", "gone", "lines", "copy", "keep", "verdict", "zstd_ratio", "chunk_low", "chunk_high", "token_ids", "n_tokens", "round_trip", "quality_score", "judged_text", "m", "leaf", "t"]
    docs = spark.createDataFrame(rows, SCHEMA)
    for i, name in enumerate(names):
        docs = docs.selectExpr("*", f"{i} as {name}")
    return docs


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)


@pytest.fixture(scope="session")
def plain(spark):
    """A small corpus with copies, near copies, shared passages and junk; and what they are."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(120, 400)) for _ in range(60)]
    passage = " ".join(prose(rng, 70, 70).split())
    texts = list(base)
    for i in range(10):  # exact copies
        texts.append(base[i])
    for i in range(10, 20):  # near copies: one word in twenty changed
        texts.append(" ".join(rng.choice(WORDS) if rng.random() < 0.05 else w for w in base[i].split(" ")))
    for i in range(20, 26):  # a shared passage
        words = base[i].split(" ")
        at = rng.randint(0, len(words))
        texts[i] = " ".join(words[:at] + [passage] + words[at:])
    return texts
