"""The pipeline's stages, each against what its own input calls for, and the registration of queries."""

import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402

from test_minhash import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.staged(stage(spark, out[-1], SF)))
    return out


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert [s.dtypes for s in stages[1:5]] == [stages[0].dtypes] * 4
    assert "sequence_id" in stages[5].columns


def test_rejected_documents_go_and_clean_ones_stay(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids(stages[1]))
    assert all(d in kept for d, q in labels.items() if q == 1)
    # of the few labels here, those it may learn from; held-out accuracy is tested on larger tables
    assert not [d for d, q in labels.items() if q == 0 and zlib.crc32(str(d).encode()) % 5 and d in kept]


def test_exact_and_near_copies_go(stages):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first = {}
    for r in sorted(stages[1].collect(), key=lambda r: r["doc_id"]):
        first.setdefault(norm(r["text"]), r["doc_id"])
    assert sorted(ids(stages[2])) == sorted(first.values())
    want = [r[0] for r in brute([(r["doc_id"], r["text"], None) for r in stages[2].collect()]) if r[3]]
    assert sorted(ids(stages[3])) == sorted(want)


def test_mixing_repeats_whole_documents_and_packing_places_each(stages):
    before, mixed = stages[3].collect(), Counter(ids(stages[4]))
    assert set(mixed) == {r["doc_id"] for r in before}
    assert max(mixed.values()) <= 2
    packed = Counter(r["doc_id"] for r in stages[5].collect() if r["piece"] == 0)
    assert packed == mixed


def test_run_is_its_stages(spark, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got, want = (Counter(map(tuple, s.select(*columns).collect())) for s in (corpus_pipeline.run(spark, SF), stages[5]))
    assert got == want


AWKWARD = ["text_sha256", "a.b", "row", "key", "id", "copies", "content", "text_key", "kept_id", "score", "epoch", "plan", "mix", "n", "tick`s"]


@pytest.mark.parametrize("stage", range(5))
def test_columns_of_any_name_pass_through(spark, stages, stage):
    docs = stages[stage]
    extra = docs.select("*", *[F.concat(F.lit(f"{k}:"), F.col("doc_id")).alias(c) for k, c in enumerate(AWKWARD)])
    got = corpus_pipeline.STAGES[stage][1](spark, extra, SF)
    if stage == 4:
        assert got.count() == stages[5].count()
        return
    assert got.dtypes == extra.dtypes
    rows = got.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(ids(stages[stage + 1]))
    assert all(r[c] == f"{k}:{r['doc_id']}" for r in rows for k, c in enumerate(AWKWARD))


WORDS = " ".join(f"w{i}" for i in range(60))
REPEATED = [(1, WORDS + " x"), (5, "other " * 9), (5, WORDS + " y"), (5, WORDS + " y"), (7, "q r s"), (7, "q  r s"), (7, "q r s")]
REPEATED += [(None, "z " * 8), (None, None), (9, None), (9, None), (9, ""), (3, "t u v w x y z")]


def table(rows):
    return [(d, t, "en", "web", len(t or "")) for d, t in rows]


def test_repeated_ids_through_every_stage(spark, stages):
    docs = spark.createDataFrame(table(REPEATED), stages[0].schema)
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    near = pairs(corpus_pipeline.near(spark, docs, SF))
    assert near.count((5, WORDS + " y")) == 0 and near.count((1, WORDS + " x")) == 1 and near.count((5, "other " * 9)) == 1
    assert sum(d == 7 for d, _ in near) == 1 and sum(d == 9 for d, _ in near) == 3
    assert len(near) == 9
    exact = pairs(corpus_pipeline.exact(spark, docs, SF))
    assert exact.count((5, WORDS + " y")) == 1 and sum(d == 7 for d, _ in exact) == 1
    assert sum(t in (None, "") for _, t in exact) == 1
    mixed = Counter(pairs(corpus_pipeline.mixing(spark, docs, SF)))
    assert set(mixed) == set(pairs(docs)) and all(mixed[x] >= n for x, n in Counter(pairs(docs)).items())
    good = corpus_pipeline.quality(spark, docs, SF)
    assert good.columns == docs.columns and set(pairs(good)) <= set(pairs(docs))
    assert corpus_pipeline.packing(spark, docs, SF).count() == len(REPEATED)


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert "op8_exact_dedup" in entry.oracle_sql()
