import random

import pytest

WORDS = [a + b for a in ("ba", "de", "ki", "lo", "mu", "na", "po", "ri", "su", "te") for b in ("la", "men", "ro", "sti", "va")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


#: Rows with nulls in each column, blank texts, repeated rows, a repeated id and a long text.
ODD_ROWS = [
    (1, prose(1, 60)), (2, prose(1, 60)), (2, prose(1, 60)), (3, prose(2, 40)), (3, prose(3, 40)), (None, prose(1, 60)),
    (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one"), (None, None), (9, prose(9, 20_000)), (10, "Zoë 日本語 😀 " + prose(4, 30)),
]
#: Names that operators use inside.
CLASHES = ("key", "rank", "group", "label", "shard", "n", "text_crc32", "component_id", "units", "size", "ids", "score")


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ODD_ROWS, "doc_id long, text string")
    return df.selectExpr("*", *(f"'x' AS {c}" for c in CLASHES))


@pytest.fixture(scope="session")
def no_rows(odd):
    return odd.where("false")
