import random
import re
import zlib
from collections import Counter

from floorledger.llm.spelling_trie import parts, spelling_variants

SCHEMA = "doc_id long, text string, word string, n string"
LOWER = {k: k + 32 for k in range(65, 91)}


def vocabulary(rows, every):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def brute(rows, every=31):
    n = vocabulary(rows, every)
    form, count = {}, {}
    for a in n:
        around = [b for b in n if near(a, b)]
        count[a] = len(around)
        best = min(around, key=lambda b: (-n[b], b), default=None)
        form[a] = best if best and n[best] >= 10 * n[a] else None
    out = []
    for a in n:
        root = a
        while form[root]:
            root = form[root]
        out.append((a, form[a], root, n[a], count[a], n[form[a]] if form[a] else None))
    return sorted(out, key=str)


def corpus():
    pick = random.Random(3)
    letters = "abcdeéÿz"
    base = ["".join(pick.choice(letters) for _ in range(pick.randrange(6, 15))) for _ in range(40)]
    base += ["aaaaaaaa", "aaaaaaaaa", "aaaaaaaaaa", "abababab", "babababa", "x" * 70, "x" * 69 + "y", "x" * 35 + "y" + "x" * 35]
    words = []
    for w in base:
        words += [w] * pick.choice([2, 3, 25, 400])
        for _ in range(pick.randrange(0, 8)):
            k, c = pick.randrange(len(w)), pick.choice(letters)
            v = pick.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
            words += [v] * pick.choice([1, 2, 2, 30])
    pick.shuffle(words)
    rows = []
    while words:
        some, words = words[:40], words[40:]
        rows.append((len(rows), pick.choice([" ", "-", "7", "\n"]).join(w.upper() if pick.random() < 0.1 else w for w in some), "q", "q"))
    return rows + [(None, "abcdefgh Abcdefgh", None, None), (1, None, None, None), (2, "", None, None), (3, rows[3][1], None, None), (3, rows[3][1], None, None)]


def test_variants_are_those_of_brute_force(spark):
    rows = corpus()
    for every in (31, 3):
        got = spelling_variants(spark.createDataFrame(rows, SCHEMA), every).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, every)


def test_every_edit_of_a_word_is_found(spark):
    word = "abcdefghaab"
    edits = {word[:k] + word[k + 1 :] for k in range(len(word))}
    edits |= {word[:k] + c + word[k + r :] for k in range(len(word) + 1) for r in (0, 1) for c in "abÿ" if k + r <= len(word)}
    rows = [(k, f"{w} {w}", None, None) for k, w in enumerate(sorted(edits | {word}))]
    got = spelling_variants(spark.createDataFrame(rows, SCHEMA), 10**9).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 10**9)


def test_a_very_long_run_and_a_very_long_text(spark):
    long = "ab" * 4_000
    rows = [(0, long, None, None), (1, long, None, None), (2, long[:-1] + " " + long[:-1], None, None), (3, "longword, " * 300_000, None, None)]
    got = {r["word"]: r for r in spelling_variants(spark.createDataFrame(rows, SCHEMA), 10**9).collect()}
    assert got["longword"]["n"] == 300_000 and got[long]["n_near"] == 1 and got[long[:-1]]["n_near"] == 1


def test_parts_of_a_text_keep_its_runs_whole():
    text = "".join(random.Random(1).choice("ab é7") for _ in range(5000))
    runs = re.compile("[a-zé]+")
    assert [w for p in parts(text, 16) for w in runs.findall(p)] == runs.findall(text)


def test_no_rows(spark):
    assert spelling_variants(spark.createDataFrame([], SCHEMA)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling_variants(spark.createDataFrame([(1, "short", "", "")], SCHEMA)).count() == 0
