"""Language ID, quality and toxicity: held-out accuracy on the smallest useful tables, and odd rows."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from floorledger.llm import toxicity_crf as crf
from floorledger.llm.language_id import LanguageFilter, grams, identify_languages, pieces, plain_letter, slots
from floorledger.llm.quality_fm import Machine, keep_good, quality
from floorledger.llm.toxicity_crf import toxicity

SF = "/root/testdata/sf0.01"
ODD = [(9_000_001, None), (9_000_002, ""), (9_000_003, "123 !? \n"), (9_000_004, "the and " * 60_000), (None, "the of and that"), (9_000_005, "日本語の文"), (9_000_004, "the and " * 60_000)]


def documents(spark, extra=True):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(i, t, None, "s", 0, "clash") for i, t in ODD] if extra else []
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    return docs.unionByName(more, allowMissingColumns=True)


@pytest.fixture(scope="module")
def labels(spark):
    found = spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    return found.unionByName(odd)


def crc(doc, parts):
    return zlib.crc32(str(doc).encode()) % parts


def test_languages(spark):
    docs = documents(spark)
    got = identify_languages(docs)
    rows = got.collect()
    assert len(rows) == docs.count()
    true = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert all(r["held_out"] == (r["doc_id"] is not None and crc(r["doc_id"], 3) == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and true[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in held]) > 0.97
    odd = {}
    for r in rows:
        odd.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert odd[9_000_001] == odd[9_000_002] == odd[9_000_003] == ["und"]
    assert odd[9_000_004] == ["en", "en"] and odd[None] == ["en"]
    assert odd[9_000_005] == ["en"]  # letters, but of no learned n-gram: the most frequent language


def test_ngrams_do_not_depend_on_the_place_in_the_range():
    texts = [b"hola", b"", b" hola ", b"12", b"a", b"si, no", "día".encode(), b"hola", b"x"]

    def of(given):
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in given]))) + 3
        text, hashed = grams(np.frombuffer(b"abc" + b"".join(given) + b"zz", np.uint8), offsets)
        return [sorted(hashed[text == i].tolist()) for i in range(len(given))]

    alone = [of([t])[0] for t in texts]
    assert of(texts) == alone and of(texts[::-1]) == alone[::-1]
    assert alone[0] == alone[2] and len(alone[0]) == 3 + 4 + 3 + 2 and alone[1] == alone[3] == []


def test_languages_without_anything_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert identify_languages(spark.createDataFrame([], schema)).count() == 0
    got = identify_languages(spark.createDataFrame([(2, "abc", None)], schema)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]


def test_filter_returns_all_languages_of_a_gram_and_corrects_counts():
    data = np.frombuffer(b"abcabd", np.uint8)
    _, hashed = grams(data, np.array([0, 6]))
    masks = np.zeros((1, 1 << 12), np.uint64)
    for lang, part in enumerate((hashed, hashed[::2])):
        for at in slots(part, 3, 12):
            masks[0, at.astype(int)] |= np.uint64(1 << lang)
    model = LanguageFilter(["aa", "bb"], 1, masks, 3, 12)
    total, held = model.counts(data, np.array([0, 6]))
    assert total[0] == len(hashed) == held[0, 0] and held[0, 1] >= len(set(hashed[::2]))
    assert model.decide(data, np.array([0, 6, 6]))[0] == ["aa", "bb"]
    assert (model.false < 0.01).all()


def test_quality_held_out(spark, labels):
    docs = documents(spark)
    rows = quality(docs, labels).collect()
    assert len(rows) == docs.count()
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in held]) > 0.93
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (9_000_001, 9_000_002)}) == 1
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["predicted"] for r in rows)


def test_quality_and_toxicity_without_labels(spark, labels):
    none = labels.limit(0)
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert [r["score"] for r in quality(docs, none).collect()] == [0.5, 0.5]
    assert [(r["score"], r["spans"]) for r in toxicity(docs, none).collect()] == [(0.0, [])] * 2
    assert quality(docs.limit(0), labels).count() == toxicity(docs.limit(0), labels).count() == 0


def test_pairwise_sum_by_squares_is_the_sum_over_pairs():
    random = np.random.default_rng(1)
    machine = Machine(0.3, random.normal(size=12), random.normal(size=(12, 4)), np.zeros(2), np.ones(2))
    bucket, value, stats = np.array([0, 3, 7]), np.array([0.5, 0.2, 0.9]), np.array([[0.4, -0.1]])
    _, column, x = machine.joined(np.zeros(3, int), bucket, value, stats)
    margin = machine.w0 + machine.w[column] @ x
    for i, j in itertools.combinations(range(len(x)), 2):
        margin += machine.v[column[i]] @ machine.v[column[j]] * x[i] * x[j]
    got = machine.probability(np.zeros(3, int), bucket, value, stats)
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))


def test_toxicity_held_out(spark, labels):
    docs = documents(spark)
    rows = toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert np.mean([r["predicted"] == known[r["doc_id"]] for r in held]) > 0.93
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    found = [texts[r["doc_id"]][s["start"] : s["end"]].lower() for r in rows for s in r["spans"]]
    assert {"idiot", "scum", "moron"} & set(found)
    assert all(f == f.strip(" .,!?\n") for f in found)


def test_toxicity_is_learned_from_long_texts(spark):
    random = np.random.default_rng(6)
    vocabulary = np.array([f"w{i}x" for i in range(300)])

    def text(bad):
        sentences = [" ".join(random.choice(vocabulary, 8)) for _ in range(1800)]
        for i in range(0, 1800 if bad else 0, 20):
            sentences[i] += " filthy " + sentences[i][:12]
        return ". ".join(sentences)

    rows = [(k, text(k % 2 == 0)) for k in range(24)]
    assert all(len(t) > 50_000 for _, t in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(k, 1 - k % 2) for k in range(24)], "doc_id long, toxic int")
    got = {r["doc_id"]: (r["predicted"], r["spans"]) for r in toxicity(docs, known).collect()}
    assert [got[k][0] for k in range(24)] == [1 - k % 2 for k in range(24)]
    assert "filthy" in {rows[0][1][s["start"] : s["end"]] for s in got[0][1]}


def test_long_texts_give_whole_sentences_up_to_the_bound():
    texts = [b"one two. three", b" ".join(b"a%d b%d c%d." % (i, i, i) for i in range(400)), b"x " * 3000, b". " * 900, b"last one"]
    of = lambda given: np.concatenate(([0], np.cumsum([len(t) for t in given])))
    found = crf.tokens(np.frombuffer(b"".join(texts), np.uint8), of(texts))
    short = crf.shortened(found, of(texts), 1000)
    size = np.bincount(short.text, weights=short.end - short.start + 1, minlength=5)
    assert 1000 <= size[1] < 1020 and 1000 <= size[2] < 1000 + 2 * 256 and size[3] == 0
    for t in (0, 4):
        assert (short.word[short.text == t] == found.word[found.text == t]).all()
    assert short.first[short.text == 1].tolist() == [True, False, False] * (sum(short.text == 1) // 3)
    assert short.start[short.text == 1].max() > 0.9 * found.start[found.text == 1].max()
    alone = crf.tokens(np.frombuffer(texts[1], np.uint8), of(texts[1:2]))
    assert (crf.shortened(alone, of(texts[1:2]), 1000).word == short.word[short.text == 1]).all()


@pytest.mark.parametrize("n", [1, 7, 130, 500])
def test_marginals_against_all_paths(n):
    random = np.random.default_rng(n)
    emission, first, move = random.normal(0, 2, n), random.random(n) < 0.2, random.normal(size=(2, 2))
    first[0] = True
    p, counts = crf.marginals(emission, first, move, pairs=True)
    ends = np.append(np.flatnonzero(first), n)
    assert np.isclose(counts.sum(), n - len(ends) + 1)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a > 9:
            continue
        total, tagged = 0.0, np.zeros(b - a)
        for path in itertools.product((0, 1), repeat=int(b - a)):
            weight = np.exp(emission[a:b] @ path + sum(move[i, j] for i, j in zip(path, path[1:], strict=False)))
            total, tagged = total + weight, tagged + weight * np.array(path)
        assert np.allclose(tagged / total, p[a:b])


def brute_grams(text):
    """The n-grams of a text from its definition: of 2 to 5 bytes, within words with one space at either end."""
    out = Counter()
    for word in re.findall(b"[a-z\x80-\xff]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), text)):
        framed = b" " + word + b" "
        for size in (2, 3, 4, 5):
            for k in range(len(framed) - size + 1):
                gram = framed[k : k + size]
                if size > 2 or b" " not in gram:
                    out[gram] += 1
    return out


def test_ngrams_are_those_of_brute_force_in_one_part_and_in_many():
    pick = random.Random(8)
    texts = ["".join(pick.choice("abcD é1 \n.") for _ in range(pick.randrange(0, 400))).encode() for _ in range(40)] + [b"x" * 90, b"", b" "]
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        want = sorted(brute_grams(text).values())
        for most in (7, 50, 1 << 20):
            found = Counter()
            for part in pieces(np.array([0, len(data)]), data, most):
                found.update(grams(data, part)[1].tolist())
            assert sorted(found.values()) == want


def test_masks_give_the_languages_of_exact_sets():
    """Counts through the filters, corrected, against sets of n-grams per language."""
    pick = random.Random(9)
    word = lambda letters: "".join(pick.choice(letters) for _ in range(pick.randrange(2, 7)))
    held = {lang: {word(letters) for _ in range(300)} for lang, letters in (("aa", "abcdefg"), ("bb", "efghijk"), ("cc", "mnopqrs"))}
    exact = {lang: set().union(*(brute_grams(w.encode()) for w in words)) for lang, words in held.items()}
    masks = np.zeros((1, 1 << 21), np.uint64)
    for i, words in enumerate(held.values()):
        data = np.frombuffer(" ".join(words).encode(), np.uint8)
        at = slots(grams(data, np.array([0, len(data)]))[1], 3, 21)
        masks[0, at.reshape(-1).astype(np.int64)] |= np.uint64(1 << i)
    model = LanguageFilter(list(held), 0, masks, 3, 21)
    for _ in range(50):
        text = " ".join(word(pick.choice(["abcdefg", "efghijk", "mnopqrs", "xyz"])) for _ in range(30)).encode()
        total, counts = model.counts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        found = brute_grams(text)
        assert total[0] == sum(found.values())
        want = [sum(n for g, n in found.items() if g in exact[lang]) for lang in held]
        assert np.abs(counts[0] - want).max() <= 2
        if sum(want):
            best = model.decide(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0][0]
            assert want[list(held).index(best)] >= max(want) - 2


def test_memory_for_a_very_long_text():
    import tracemalloc

    data = np.frombuffer(b"some words of a long text, " * 2_000_000, np.uint8)[: 50 << 20]
    model = LanguageFilter(["a", "b"], 0, np.zeros((1, 1 << 21), np.uint64), 3, 21)
    tracemalloc.start()
    total, _ = model.counts(data, np.array([0, len(data)]))
    assert plain_letter(data, np.array([0, len(data)])).all()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total[0] > 50 << 20 and peak < 300 << 20
