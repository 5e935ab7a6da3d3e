import random

import pytest

SMALL = "/root/testdata/sf0.001"

#: Columns whose names operators use inside.
CLASHING = ("piece", "n", "tokens", "component_id", "firsts", "line", "group", "rank")


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_rows():
    """Copies, near copies, repeated rows, nulls, empty and long texts."""
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    shared = words(2, 40)
    lines = [" ".join(words(100 + k, 9)) for k in range(12)]
    return [
        (1, " ".join(base)),
        (2, " ".join(base)),
        (2, " ".join(base)),
        (3, None),
        (4, ""),
        (None, " ".join(base)),
        (5, " \n\t\n "),
        (6, "x " * 30_000),
        (7, " ".join(near).upper().lower()),
        (8, " ".join(words(3, 50) + shared + words(4, 50))),
        (9, "\t".join(words(5, 10) + shared + words(6, 30))),
        (10, "one two"),
        (11, "One  TWO"),
        (12, "\n".join(lines)),
        (13, "\n".join([words(7, 1)[0], *lines[3:9], "", *lines[9:], "the end"])),
        (14, "This is under the MIT License; the GNU General\nPublic License, version 3."),
        (15, "mit\nlicense MIT license.mit-license Apache LicenseX ÀPACHE license apache license"),
        (16, "ÄÖÜ ß été 日本語 <|endoftext|> it's 2² ▁ x y"),
        (-5, " ".join(words(8, 25))),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, *[f"{i}-{c}" for c in CLASHING]) for i, t in odd_rows()]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def small_texts(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
