from collections import Counter
from math import log

import pytest

from floorledger.llm.mixing import entropy, mix, plan_mix, repeat_rows, source_table, weights_at, whole_budget

SCHEMA = "doc_id long, text string, source string, epoch string"
TOTALS = {"a": 9000, "b": 900, "c": 100, "none": 0}


def test_bisection_meets_the_entropy():
    plan = plan_mix(TOTALS, target_entropy=0.8)
    assert entropy(plan.weights) == pytest.approx(0.8, abs=1e-9)
    assert plan_mix(TOTALS, target_entropy=0.0).exponent == 1.0
    assert plan_mix(TOTALS, target_entropy=9.0).exponent == pytest.approx(0.0, abs=1e-12)
    assert entropy(weights_at(TOTALS, 0.0)) == pytest.approx(log(3))


def test_bisection_meets_the_repetition_limit():
    for limit in (1.5, 4.0):
        plan = plan_mix(TOTALS, max_repeats=limit)
        assert max(plan.passes.values()) == pytest.approx(limit)
        assert min(p for s, p in plan.passes.items() if TOTALS[s]) == pytest.approx(1.0)
        assert plan.budget == pytest.approx(whole_budget(TOTALS, plan.weights))
    assert plan_mix(TOTALS, max_repeats=1e9).exponent == 0.0
    assert plan_mix(TOTALS, max_repeats=2.0, budget=1000).budget == 1000
    with pytest.raises(ValueError):
        plan_mix(TOTALS)


def corpus():
    rows = [(k, "w " * (1 + k % 7), "big", None) for k in range(700)]
    rows += [(1000 + k, "w " * (1 + k % 5), "small", None) for k in range(90)]
    rows += [(2000, None, "empty", None), (2001, " ", "empty", None), (2002, "x", None, None), (None, "x y", "small", None), (3, "w w w w", "big", None)]
    return rows


@pytest.mark.parametrize("options", [{"max_repeats": 3.0}, {"target_entropy": 0.6}, {"max_repeats": 2.0, "budget": 500.0}])
def test_uses_meet_the_budget_of_each_source(spark, options):
    rows = corpus()
    got = mix(spark.createDataFrame(rows, SCHEMA), blocks=10, **options).collect()
    tokens = Counter()
    for _, t, s, _ in rows:
        tokens[s] += len((t or "").split())
    plan = plan_mix({s or "": n for s, n in tokens.items()}, **options)
    used = Counter()
    for r in got:
        used[r["source"]] += r["tokens"]
        assert 0 <= r["position"] < 1 and r["block"] == int(r["position"] * 10)
        assert r["weight"] == pytest.approx(plan.weights[r["source"] or ""])
    for source, n in tokens.items():
        want = plan.budget * plan.weights[source or ""]
        assert want - 1e-6 <= used[source] <= want + 8  # up to the document that reaches it
    times = Counter((r["doc_id"], r["epoch"]) for r in got if r["doc_id"] not in (3,))
    assert set(times.values()) == {1}
    if "budget" not in options:
        assert {r["doc_id"] for r in got} == {r[0] for r in rows}


def test_blocks_hold_the_weights(spark):
    got = mix(spark.createDataFrame(corpus(), SCHEMA), blocks=4, max_repeats=3.0).collect()
    for block in range(4):
        share = Counter()
        for r in got:
            if r["block"] == block:
                share[r["source"]] += r["tokens"]
        whole = sum(share.values())
        weight = {r["source"]: r["weight"] for r in got}
        assert share["big"] / whole == pytest.approx(weight["big"], abs=0.08)


def test_rows_keep_their_columns_and_passes_differ_in_order(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    out = repeat_rows(docs, max_repeats=3.0)
    assert out.columns == docs.columns
    rows = mix(docs, max_repeats=3.0).collect()
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r["doc_id"] for r in rows)
    orders = [[r["doc_id"] for r in sorted(rows, key=lambda r: r["position"]) if r["source"] == "small" and r["epoch"] == e] for e in (0, 1)]
    again = set(orders[1])
    assert again <= set(orders[0])
    assert [d for d in orders[0] if d in again] != orders[1]


def test_no_python_worker_takes_part(spark):
    """The plan of the result and of the source table have no Python in their lineage."""
    rows = mix(spark.createDataFrame(corpus(), SCHEMA), max_repeats=2.0)
    table = source_table(spark, [(":a", 0.25, 1.5, 1, 0.1), ("", 0.75, 2.0, 2, 0.0)])
    assert [tuple(r) for r in table.collect()] == [(":a", 0.25, 1.5, 1, 0.1), ("", 0.75, 2.0, 2, 0.0)]
    for frame in (rows, table):
        lineage = frame._jdf.queryExecution().toRdd().toDebugString()
        assert "Python" not in lineage


def brute_mix(rows, max_repeats):
    """Weights and passes from the definition, by a fine scan of the exponent instead of bisection."""
    tokens = Counter()
    for _, text, source in rows:
        tokens[source] += len((text or "").split())
    some = {s: t for s, t in tokens.items() if t}
    for step in range(100_001):
        a = step / 100_000
        power = {s: (t / sum(some.values())) ** a for s, t in some.items()}
        weight = {s: p / sum(power.values()) for s, p in power.items()}
        budget = max(t / weight[s] for s, t in some.items())
        passes = {s: budget * weight[s] / t for s, t in some.items()}
        if max(passes.values()) <= max_repeats:
            return weight, passes
    raise AssertionError


def test_weights_and_uses_are_those_of_the_definition(spark):
    rows = [(d, t, s) for d, t, s, *_ in corpus() if d is not None and d != 3]
    weight, passes = brute_mix(rows, 2.0)
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_repeats=2.0).collect()
    for r in got:
        if r["tokens"]:
            assert r["weight"] == pytest.approx(weight[r["source"]], abs=1e-4) and r["passes"] == pytest.approx(passes[r["source"]], abs=1e-3)
    for source in weight:
        whole = sum(len((t or "").split()) for _, t, s in rows if s == source)
        longest = max(len((t or "").split()) for _, t, s in rows if s == source)
        used = sum(r["tokens"] for r in got if r["source"] == source)
        assert passes[source] * whole - 1e-6 * whole - longest * 0.001 <= used <= passes[source] * whole + longest + whole * 1e-3
        for epoch in range(int(passes[source] + 1e-6)):
            assert Counter(r["doc_id"] for r in got if r["source"] == source and r["epoch"] == epoch) == Counter(d for d, _, s in rows if s == source)


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA), max_repeats=2.0).count() == 0
