"""Tables with everything that a contract has to bear."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, `group` string, rank int, id string, m map<string,int>, `a.b` string, C0 int"


def prose(draw: random.Random, n: int) -> str:
    parts = ["the", "of", "ing", "tion", "er", "and", "re", "ea", "st", "ou", "ha", "ble"]
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Rows (doc_id, text, lang, source, ...) with nulls, empty and long texts, repeated rows and columns of clashing names."""
    draw = random.Random(5)
    texts = [prose(draw, draw.randint(20, 160)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    near = texts[3].split(" ")
    near[7] = "altered"
    rows += [(100, texts[3]), (101, " ".join(near)), (102, texts[3].replace(" ", "\n", 5)), (103, "one two"), (104, "one two"), (105, "")]
    rows += [(106, None), (None, texts[4]), (None, None), (5, texts[5]), (107, "   \n\t "), (108, "word " * 4000), (109, prose(draw, 9000)), (110, "naïve ÉCOLE ☃ 日本語  x y 😀" * 5), (111, "don't  it's  I'll\n\n\nend "), (112, "a" * 3000), (113, "<|endoftext|> tail\x00\x1f")]
    out = []
    for n, (i, t) in enumerate(rows):
        lang = None if n % 17 == 3 else ("en", "de")[n % 2]
        source = None if n % 13 == 5 else f"src{n % 3}"
        out.append((i, t, lang, source, None if t is None else len(t), "k", 7, "g", n, f"x{n}", {"z": n, "a": 1}, "dot", n % 3))
    return out


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
