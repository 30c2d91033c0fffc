"""Words as byte arrays, distributed numbering, connected components."""

import random
import re

import numpy as np
import pyarrow as pa

from floorledger.llm import textarrays
from floorledger.llm.common import numbered, staged, unit_hash
from floorledger.llm.components import components

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", "a b  c", None, " Été\tNULL \x00 x ", "one", "\n\n", "Z " * 50, "x" * 300, "a b  c"]


def words_of(texts):
    data, offsets = textarrays.column_bytes(pa.array(texts, pa.string()))
    out = [[] for _ in texts]
    hashes = {}
    for a, b in textarrays.groups(offsets, 40):
        own = offsets[a : b + 1]
        text, start, end, hashed = textarrays.words(data, own, textarrays.byte_table(textarrays.SPACES))
        for t, i, j, h in zip(text, start, end, hashed):
            word = data[own[0] + i : own[0] + j].tobytes().decode()
            out[a + t].append(word)
            hashes.setdefault(int(h), set()).add("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word))
    return out, hashes


def test_words_are_those_between_ascii_white_space():
    out, hashes = words_of(TEXTS)
    assert out == [SPLIT.findall(t or "") for t in TEXTS]
    assert all(len(x) == 1 for x in hashes.values())


def test_a_text_longer_than_a_chunk_keeps_its_words(monkeypatch):
    monkeypatch.setattr(textarrays, "CHUNK", 64)
    long = " ".join(f"w{i}" for i in range(500)) + " " + "y" * 400
    out, hashes = words_of([long])
    assert out == [long.split()]
    assert len(hashes) == 501


def test_numbers_are_gapless_within_groups_and_sums_run(spark, monkeypatch):
    monkeypatch.setattr("floorledger.llm.common.ROWS_PER_BUCKET", 7)
    rows = [(i, "hot" if i % 3 else "cold", i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, w long").withColumn("o", unit_hash("id"))
    got = numbered(staged(df), ["g"], "o", 200, weight="w", ties=["id"]).collect()
    for g in ("hot", "cold"):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (r["o"], r["id"]))
        assert [r["n"] for r in own] == list(range(len(own)))
        assert [r["before"] for r in own] == [int(x) for x in np.cumsum([0] + [r["w"] for r in own])[:-1]]


def test_components_of_random_graphs_chains_and_stars(spark):
    pick = random.Random(4)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(180)]
    edges += [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2001 + k) for k in range(50)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["vertex"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in touched}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
