import hashlib
import re

import pytest
from pyspark.sql import functions as F

from floorledger.llm.exact_dedup import exact_dedup, keep_first

ROWS = [
    (5, "a  b\tc", "x"), (2, "a b c", None), (9, "a b c ", "y"), (7, None, "x"), (3, "", "x"), (8, " ", "x"), (11, "\n\n", "x"),
    (4, "a b c", "z"), (4, "a b c", "z"), (12, "é" * 50_000, "x"), (13, "é" * 50_000 + "!", "x"), (None, "a b c", "x"), (None, "alone", "x"),
]
SCHEMA = "doc_id long, text string, keep_id string"


def expected(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for doc, text, _ in rows:
        groups.setdefault(norm(text), []).append(doc)
    out = []
    for doc, text, _ in rows:
        ids = groups[norm(text)]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((doc, keep, len(ids), doc == keep, hashlib.sha256(norm(text).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("digest", [None, lambda c: F.lit(b"same"), lambda c: F.substring(F.unhex(F.md5(c)), 1, 1)])
def test_groups_are_those_of_the_bytes_even_if_hashes_collide(spark, digest):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = exact_dedup(docs, **({"digest": digest} if digest else {})).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(ROWS)))


def test_one_row_of_each_group_is_kept_with_all_its_columns(spark):
    got = keep_first(spark.createDataFrame(ROWS, SCHEMA))
    assert got.columns == ["doc_id", "text", "keep_id"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert sorted(str(r[0]) for r in rows) == sorted(["2", "9", "3", "8", "12", "13", "None"])
    assert (2, "a b c", None) in rows


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(docs).count() == 0
    assert keep_first(docs).count() == 0
