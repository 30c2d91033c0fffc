import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from floorledger.llm import substring_automata
from floorledger.llm.substring_automata import Automaton, cuts, substring_dedup, word_hashes
from floorledger.llm.textarrays import groups

SCHEMA = "doc_id long, text string, spans string, text_key string, mark string"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    texts = [SPLIT.findall(t or "") for _, t, *_ in rows]
    starts = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc, *_), w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def corpus(seed=5):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdEF\x00é") for _ in range(pick.randrange(1, 4)))
    passages = [[word() for _ in range(pick.randrange(30, 120))] for _ in range(12)] + [["a", "b"] * 40, ["z"] * 90]
    rows = []
    for k in range(150):
        words = [word() for _ in range(pick.randrange(0, 60))]
        for _ in range(pick.randrange(0, 4)):
            p = pick.choice(passages)
            a = pick.randrange(0, len(p) // 3)
            words += p[a : len(p) - pick.randrange(0, len(p) // 3)] + [word() for _ in range(pick.randrange(0, 20))]
        rows.append((k, pick.choice([" ", "\n", " \t"]).join(words), "x", "x", "x"))
    rows += [(200, rows[3][1], None, None, None), (4, rows[4][1], None, None, None), (4, rows[9][1] + " q", None, None, None)]
    rows += [(None, rows[7][1], None, None, None), (None, None, None, None, None), (201, "", None, None, None), (202, " \n", None, None, None)]
    return rows + [(203, " ".join(f"w{i}" for i in range(35)), None, None, None), (204, "once " * 36, None, None, None)]


def found(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=str)


def test_removed_words_are_those_of_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    for window in (35, 12):
        out = substring_dedup(docs, window)
        assert found(out) == brute(rows, window)
    lengths = out.select(F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.start) = n_removed").alias("same"))
    assert lengths.filter("NOT same").isEmpty()


def test_fingerprints_of_many_contents_and_small_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_automata, "SHARD_WORDS", 500)
    common = " ".join(f"c{i}" for i in range(40))
    rows = corpus(8) + [(300 + k, f"{k} u{k} {common} v{k} {k}", None, None, None) for k in range(60)]
    monkeypatch.setattr(substring_automata.repeated_runs, "__defaults__", (35, 3))
    assert found(substring_dedup(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 35)


def test_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(substring_automata, "CHUNK", 300)
    monkeypatch.setattr(substring_automata, "groups", lambda offsets: groups(offsets, 300))
    monkeypatch.setattr(cuts, "__defaults__", (300,))
    rows = corpus(9) + [(400, "y" * 1000 + " " + " ".join(f"p{i}" for i in range(80)), None, None, None)]
    rows += [(401, " ".join(f"p{i}" for i in range(80)) + " " + "y" * 1000 + " " * 700, None, None, None)]
    data = np.frombuffer(rows[-1][1].encode(), np.uint8)
    assert b"".join(data[a:b].tobytes() for a, b in cuts(data, 300)) == data.tobytes()
    assert found(substring_dedup(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 35)
    for _, text, *_ in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        parts = list(word_hashes(data, np.array([0, len(data)]), 34))
        whole = parts[0][1].tolist()
        for _, hashed, first in parts[1:]:
            assert whole[first:] == hashed[: len(whole) - first].tolist()
            whole += hashed[len(whole) - first :].tolist()
        assert len(whole) == len(SPLIT.findall(text or ""))
        total, kept = substring_automata.without(data, np.array([[2, 5], [40, 77]]))
        words = SPLIT.findall(text or "")
        assert (total, kept) == (len(words), " ".join(words[:2] + words[5:40] + words[77:]))


def test_a_long_text_repeats_itself(spark):
    pick = random.Random(2)
    words = [f"{pick.randrange(10**9):x}" for _ in range(300_000)]
    words[250_000:250_050] = words[1000:1050]
    rows = [(1, " ".join(words), "", "", ""), (2, " ".join(words[131_000:131_040]), "", "", "")]
    assert found(substring_dedup(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 35)


def test_matching_statistics():
    pick = random.Random(4)
    for _ in range(30):
        held = [([pick.randrange(3) for _ in range(pick.randrange(1, 25))], pick.randrange(1, 4)) for _ in range(pick.randrange(1, 6))]
        automaton = Automaton()
        for sequence, weight in held:
            automaton.add(sequence, weight)
        automaton.close()
        query = [pick.randrange(3) for _ in range(30)]
        for k, (matched, weight) in enumerate(automaton.matches(query, 6)):
            counts = {n: sum(w * sum(s[i : i + n] == query[k + 1 - n : k + 1] for i in range(len(s) - n + 1)) for s, w in held) for n in range(1, min(6, k + 1) + 1)}
            longest = max([n for n, c in counts.items() if c], default=0)
            assert matched == longest
            if longest == 6:
                assert weight == counts[6]


def test_no_rows(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
