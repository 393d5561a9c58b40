"""Small tables with every awkward case, and brute-force helpers."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for columns of their own.
CLASHES = (
    "tkey spans kept n_words n_removed size grp hash cut target copies class_id is_first tid key band "
    "held_out lang_pred score ids n_tokens decoded toxic part f"
).split()


def words(start: int, n: int) -> str:
    return " ".join(f"w{start + i}" for i in range(n))


def awkward_rows() -> list[tuple]:
    long = words(0, 80)
    texts = [
        (None, long),
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "short"),
        (5, long),
        (6, "before " + long + " after"),
        (7, "x " + words(5, 70) + "\n" + words(500, 60)),
        (7, words(500, 60)),
        (8, words(500, 60)),
        (8, words(500, 60)),
        (9, "the same line\n" * 60),
        (10, words(2000, 4000)),
        (11, "é日本 \U0001f600 " * 40),
        (12, words(0, 79) + " other"),
        (13, "1234 !!! ..."),
    ]
    langs, sources = ["en", "fr", None], ["a", "b", None, "c"]
    return [
        (i, t, langs[k % 3], sources[k % 4], None if t is None else len(t)) for k, (i, t) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS)


@pytest.fixture(scope="session")
def clashing(awkward):
    from pyspark.sql import functions as F

    return awkward.withColumns({c: F.lit(f"mine {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not here")
    return spark.read.parquet(f"{SMALL}/documents.parquet")
