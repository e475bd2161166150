"""Periodic runs against a plain search, in any division into appends, and the stated results of odd rows."""

import random

import numpy as np
import pytest

from fieldloom.llm.word_runs import RunCatcher, dropped_words, periodic_runs


def plain_runs(words, min_length=6, exponent=4):
    found = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, exponent * q) and not any(s <= i and j + q <= e for s, e, _ in found):
                found.append((i, j + q, q))
            i = max(j, i + 1)
    return sorted(found)


def sequences():
    rng = random.Random(3)
    for size in (1, 2, 3, 5, 50):
        for _ in range(60):
            words = []
            while len(words) < rng.choice([5, 30, 200, 400]):
                period = [rng.randrange(size) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 30]))]
                words += (period * rng.randrange(1, 9))[: rng.randrange(1, 200)]
                words += [rng.randrange(size) for _ in range(rng.randrange(4))]
            yield words
    yield [0] * 5000
    yield [0, 1] * 1500 + [0] * 700 + [0, 1] * 900
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 3000:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]


def test_runs_equal_a_plain_search():
    for words in sequences():
        catcher = RunCatcher()
        catcher.append(np.array(words))
        assert catcher.runs() == plain_runs(words), words[:50]


def test_runs_do_not_depend_on_how_words_are_appended():
    rng = random.Random(5)
    for words in list(sequences())[::9]:
        words = words[:700]
        catcher, at = RunCatcher(), 0
        while at < len(words):
            step = rng.choice([1, 1, 1, 2, 7, 100])
            catcher.append(np.array(words[at : at + step]))
            at += step
        assert catcher.runs() == plain_runs(words)


def test_exponents_below_four_are_refused():
    with pytest.raises(ValueError):
        RunCatcher(min_exponent=3)


def test_dropped_words_are_all_but_the_first_period():
    assert dropped_words(9, [(1, 8, 2)]).tolist() == [False] * 3 + [True] * 5 + [False]


def test_odd_rows_and_clashing_columns(spark):
    long = "é x " * 40_000 + "end"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (5, "a " * 6), (5, "a " * 6), (None, "b\x0bb\x0cb b b b c"), (6, long), (7, "x " * 9)]
    docs = spark.createDataFrame([(i, t, [1], "r") for i, t in rows], "doc_id long, text string, runs array<int>, collapsed string")
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs(docs).collect()}
    assert got == {
        (1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (4, 2, (), "a b"), (5, 6, ((0, 6, 1),), "a"), (None, 7, ((0, 6, 1),), "b c"),
        (6, 80_001, ((0, 80_000, 2),), "é x end"), (7, 1, (), "x " * 9),
    }
    assert periodic_runs(docs.limit(0)).collect() == []
