import math

import numpy as np
import pytest

from floorledger.llm import embedding_itq as itq
from floorledger.llm.embedding_itq import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def cloud():
    random = np.random.default_rng(8)
    rows, k = [], 0
    for label in range(3):
        for _ in range(120):
            centre = random.normal(size=32)
            for _ in range(int(random.integers(1, 5))):
                x = centre + random.normal(size=32) * random.choice([0.05, 0.2, 0.4])
                rows.append((k, [float(v) for v in np.float32(x)], label, None))
                k += 1
    centre = random.normal(size=32)
    for _ in range(150):  # one large group
        rows.append((k, [float(v) for v in np.float32(centre + random.normal(size=32) * 0.02)], 1, None))
        k += 1
    same = rows[5][1]
    rows += [(k, same, 0, None), (k + 1, same, 0, None), (k + 1, same, 0, None), (k + 2, same, 2, None), (k + 3, [2 * v for v in same], 0, None)]
    odd = [None, [], [0.0] * 32, [math.nan] * 32, [math.inf] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 2.0], [1.0, 2.0]]
    rows += [(k + 10 + i, v, 0, None) for i, v in enumerate(odd)] + [(k + 30, same, None, None), (None, same, 0, None), (k + 31, [1e-44] * 32, 0, None)]
    return rows


def brute(rows, least):
    fine = [i for i, r in enumerate(rows) if r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = {i: np.float64(np.float32(rows[i][1])) for i in fine}
    unit = {i: x / np.abs(x).max() for i, x in unit.items()}
    unit = {i: x / math.sqrt(x @ x) for i, x in unit.items()}
    for n, i in enumerate(fine):
        for j in fine[:n]:
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root(i)] = min(ids.get(root(i), r[0]), r[0])
    return [(r[0], links[i], ids.get(root(i)), r[0] == ids.get(root(i))) for i, r in enumerate(rows)]


def test_links_and_components_are_those_of_brute_force(spark):
    rows = cloud()
    got = [tuple(r) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).select("vec_id", "n_links", "component_id", "kept").collect()]
    want = brute(rows, 0.93)
    assert len(got) == len(want)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.99 * there <= found <= there
    wrong = set(map(str, got)) ^ set(map(str, want))
    assert len(wrong) <= 0.02 * len(rows)


def test_blocks_of_a_large_bucket_give_the_same_links(spark):
    rows = [r for r in cloud() if r[2] == 1]
    df = spark.createDataFrame(rows, SCHEMA)
    classes = itq.usable(df).selectExpr("label", "class", "unit", "1L AS n")
    model = itq.learn(np.random.default_rng(0).normal(size=(200, 32)), 6, 4)
    counts = []
    for block in (1024, 16):
        found = itq.find_links(itq.keyed(classes, model), 0.93, block).collect()
        counts.append(sum(r["n"] for r in found if r["b"] is None))
    assert counts[0] == counts[1] > 150 * 149 * 0.9


def test_only_rows_that_cannot_link_and_empty_table(spark):
    df = spark.createDataFrame([(3, None, 1, None), (4, [0.0], 1, None)], SCHEMA)
    assert sorted(map(tuple, near_vectors(df).collect())) == [(3, 0, 3, True), (4, 0, 4, True)]
    assert near_vectors(df.limit(0)).count() == 0


def test_rotation_brings_data_closer_to_its_signs():
    random = np.random.default_rng(2)
    x = random.normal(size=(500, 8)) @ random.normal(size=(8, 8))
    x -= x.mean(0)
    loss = lambda r: np.square(x @ r - np.where(x @ r >= 0, 1, -1)).sum()
    assert loss(itq.itq(x, 40, 0)) < loss(itq.itq(x, 0, 0))
    tables, bits = itq.tables_for(5000, 0.93, 0.99)
    assert 1 - (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** tables >= 0.99


def leaning(count, norm, dims=64, label=0):
    """Unit vectors around a common direction, their mean of about ``norm``, a third of them with a partner at 0.93 to 0.95."""
    random = np.random.default_rng(31)
    line = np.eye(dims)[0]
    x = random.normal(size=(count, dims))
    x[:, 0] = 0
    x = norm * line + math.sqrt(1 - norm * norm) * x / np.linalg.norm(x, axis=1)[:, None]
    u, w = x[: count // 3], x[count // 3 : 2 * (count // 3)]
    w = w - (w * u).sum(1)[:, None] * u
    cosine = random.uniform(0.931, 0.95, size=(len(u), 1))
    partner = cosine * u + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w, axis=1)[:, None]
    return [(k, [float(v) for v in np.float32(v)], label, None) for k, v in enumerate(np.concatenate([x, partner]))]


@pytest.mark.parametrize("norm", [0.6, 0.9, 0.98])  # the last is one tight group
def test_links_are_found_among_vectors_with_a_common_direction(spark, norm):
    rows = leaning(600, norm)
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows, 0.93)
    found, there = sum(r["n_links"] for r in got), sum(r[1] for r in want)
    assert there >= 400 and 0.99 * there <= found <= there


def test_keys_agree_as_often_as_the_angle_says_wherever_the_mean_lies():
    for norm in (0.0, 0.5, 0.9):
        x = np.array([r[1] for r in leaning(1500, norm)])
        x /= np.linalg.norm(x, axis=1)[:, None]
        keys = itq.learn(x, *itq.tables_for(len(x), 0.93, 0.995)).keys(x)
        assert (keys[:500] == keys[1500:]).any(1).mean() >= 0.985
