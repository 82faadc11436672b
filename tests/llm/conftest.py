import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", ",", ".", "\n"]) * (r.random() < 0.15) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies, other scripts."""
    passage = prose(1, 60)
    rows = [
        (0, None), (1, ""), (2, " \t\n"), (3, "a"), (4, prose(2, 80)), (5, prose(2, 80)), (5, prose(2, 80)), (None, prose(3, 50)), (None, None),
        (6, prose(4, 40) + passage + prose(5, 40)), (7, passage), (8, prose(6, 30) + "\n" + passage), (9, prose(2, 80).replace("alpha", "alpha ")),
        (10, prose(7, 20_000)), (11, "x" * 30_000), (12, "é日本語 ñ   ١٢٣ 😀 don't  stop\x1c\x85\xa0 <|endoftext|>"), (13, "the quick line of text that repeats itself\n" * 9),
        (14, "The quick line of text, that repeats itself!\nanother line altogether stands here\n"), (15, prose(2, 80) + " once"), (16, "\x00\x0b\x0c\r"), (17, "12 345 6789 \\ < | > ' 's 'll"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with further columns whose names the operators use inside."""
    names = ["row", "fp", "n", "h", "k1", "part", "line", "lines", "digest", "root", "node", "length", "slot", "id", "toxic", "quality", "kept", "score"]
    return spark.createDataFrame([(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(odd_rows)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def real(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.fixture(scope="session")
def texts(real):
    return {r.doc_id: r.text or "" for r in real.collect()}
