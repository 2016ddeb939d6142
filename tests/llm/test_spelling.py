"""Spelling variants against brute force, with cells small enough to be split, and odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scoreloom.llm.spelling import ONE_CELL, cells_of, counts_of, fit_cells, last_forms, letters_of, near_words, spelling_variants, word_counts
from tests.llm.test_operators import LONG, ODD, ODD_IDS, docs_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_near(words):
    found = {}
    for w, n in words.items():
        others = sorted(((-m, v) for v, m in words.items() if near(w, v)))
        found[w] = (n, len(others), -others[0][0] if others else None, others[0][1] if others else None)
    return found


def brute_counts(rows):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def vocabulary(seed, size, letters="aabcé"):
    draw = random.Random(seed)
    words = {}
    while len(words) < size:
        w = "".join(draw.choice(letters) for _ in range(draw.randrange(7, 10)))
        words[w] = draw.choice([2, 2, 2, 30, 400, 400])
        if draw.random() < 0.4:
            k = draw.randrange(len(w))
            v = draw.choice([w[:k] + w[k + 1:], w[:k] + "ÿ" + w[k:], w[:k] + "z" + w[k + 1:]])
            if len(v) >= 7:
                words[v] = draw.choice([2, 40, 5000])
    return words


@pytest.mark.parametrize("sample, cell", [(1 << 20, 20), (60, 5), (1, 8000)])  # whole, thin and no samples
def test_near_words_equal_brute_force(spark, sample, cell):
    words = vocabulary(sample, 500)
    found = near_words(spark.createDataFrame(list(words.items()), "word string, n long"), sample, cell).collect()
    assert {r.word: (r.n, r.n_near, r.best_n, r.best) for r in found} == brute_near(words)
    assert len(found) == len(words)


def test_words_of_equal_letters_are_dealt_over_parts(spark):
    draw = random.Random(5)
    words = {"".join(draw.sample("aabbcde", 7)): draw.choice([2, 50]) for _ in range(900)}
    words |= {"".join(w[:3]) + "f" + w[4:]: 3 for w in list(words)[:60]}
    letters = counts_of(letters_of(pa.array([w for w in words if "f" not in w]), 7))
    tree = fit_cells(letters, 16, 1.0, 100)
    assert tree.cell == [0] and tree.parts[0] > 5
    found = near_words(spark.createDataFrame(list(words.items()), "word string, n long"), cell_words=100).collect()
    assert {r.word: (r.n, r.n_near, r.best_n, r.best) for r in found} == brute_near(words)


def test_a_question_reaches_every_cell_that_may_answer_it():
    words = list(vocabulary(8, 600))
    some = pa.array([w for w in words if len(w) == 8])
    counts = counts_of(letters_of(some, 8)).astype(int)
    tree = fit_cells(counts, 16, 1.0, 20)
    home = np.full(len(counts), -1)
    for node, rows in cells_of(tree, counts, 0, 0):
        assert (home[rows] == -1).all()
        home[rows] = node
    assert (home >= 0).all() and len(set(home)) > 5
    asked = {node: set(rows.tolist()) for node, rows in cells_of(tree, counts, 1, 1)}
    for i in range(len(counts)):
        step = counts - counts[i]
        close = (np.maximum(step, 0).sum(axis=1) <= 1) & (np.maximum(-step, 0).sum(axis=1) <= 1)
        assert all(i in asked[home[j]] for j in np.flatnonzero(close))
    assert sum(map(len, asked.values())) < 0.8 * len(counts) * len(set(home))
    assert [n for n, _ in cells_of(ONE_CELL, counts, 1, 1)] == [0]


def test_variants_of_documents_equal_brute_force(spark):
    draw = random.Random(11)
    words = list(vocabulary(12, 120))
    texts = [" ".join(draw.choice([w, w, w.upper().translate(UPPER), w.capitalize()]) for w in draw.choices(words[:10] * 40 + words, k=150)) for _ in range(60)]
    texts += [None, "", "short, wörd 123", "naïveté-naïveté NAÏVETÉS Naïvetés naïvetés"]
    ids = [None if k % 17 == 5 else k for k in range(len(texts))]
    rows = list(zip(ids, texts))
    counted = brute_counts(rows)
    docs = docs_of(spark, texts, ids)
    assert {r.word: r.n for r in word_counts(docs).collect()} == counted
    expected = {}
    found = brute_near(counted)
    form = {w: (b if m and m >= 10 * n else None) for w, (n, _, m, b) in found.items()}
    for w, (n, k, m, _) in found.items():
        root = w
        while form[root]:
            root = form[root]
        expected[w] = (form[w], root, n, k, m if form[w] else None)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(docs, cell_words=20).collect()}
    assert got == expected and sum(f is not None for f in form.values()) > 5


def test_odd_documents(spark):
    giant = "x" * 40_000
    rows = spelling_variants(docs_of(spark, [*ODD, giant, giant, giant + "y", giant + "y"], [*ODD_IDS, 100, 101, 102, 103])).collect()
    assert {(len(r.word), r.n, r.n_near) for r in rows if len(r.word) > 30_000} <= {(40_000, 2, 1), (40_001, 2, 1), (40_000, 2, 0), (40_001, 2, 0), (39_999, 2, 0)}
    assert spelling_variants(docs_of(spark, [])).collect() == []
    assert spelling_variants(docs_of(spark, [LONG])).collect() == []  # a word of four letters


def test_chains_end_at_the_last_form(spark):
    links = [(chr(97 + k), chr(98 + k)) for k in range(9)] + [("p", "q"), ("x", "d")]
    found = {r.word: r.root for r in last_forms(spark.createDataFrame(links, "word string, form string")).collect()}
    assert found == {**{chr(97 + k): "j" for k in range(9)}, "p": "q", "x": "j"}
