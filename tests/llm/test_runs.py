"""Periodic runs against brute force, and on edge rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanledger.llm import runs


def brute(words, least_length=6, exponent=4):
    """Every maximal stretch per period, the smallest period of each."""
    found = {}
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least_length, exponent * p):
                found.setdefault((i, j + p), p)
            i = max(i + 1, j)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w.decode() for i, w in enumerate(words) if i not in gone)


def test_every_difference_is_covered_once():
    cover, v = runs.COVER, runs.COVER_MODULUS
    assert sorted((a - b) % v for a in cover for b in cover if a != b) == list(range(1, v))


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_random_documents(seed):
    rnd = random.Random(seed)
    docs = []
    for _ in range(rnd.randint(1, 6)):
        n, letters = rnd.choice([0, 1, 5, 6, 30, 200, 600]), rnd.choice([1, 2, 3, 50])
        words = [b"%d" % rnd.randrange(letters) for _ in range(n)]
        if n and rnd.random() < 0.6:
            a = rnd.randrange(n)
            p = rnd.randint(1, max(1, (n - a) // rnd.randint(2, 8)))
            for i in range(a, rnd.randint(a, n)):
                words[i] = words[a + (i - a) % p]
        docs.append(words)
    got = list(runs._searched(docs, 6, 4))
    assert [r for r, _ in got] == [brute(words) for words in docs]
    assert [c for _, c in got] == [collapsed(words, brute(words)) for words in docs]


def test_extensions_of_any_two_suffixes():
    rnd = np.random.default_rng(1)
    for letters in (1, 2, 5):
        ids = np.append(rnd.integers(0, letters, 300), letters)
        found = runs.Extensions(ids)
        i, j = rnd.integers(0, 301, (2, 2000))
        i, j = i[i != j], j[i != j]
        for a, b, n in zip(i, j, found.common(i, j), strict=True):
            rest = ids[max(a, b) :] == ids[min(a, b) : min(a, b) + 301 - max(a, b)]
            assert n == (len(rest) if rest.all() else rest.argmin())


def test_other_bounds():
    words = [b"a", b"b"] * 3 + [b"c"]
    assert [r for r, _ in runs._searched([words], 4, 3)] == [brute(words, 4, 3)] == [[(0, 6, 2)]]
    with pytest.raises(ValueError):
        runs.runs_of(np.array([0, 1]), np.array([1]), 2, 2)


def test_edge_rows(spark):
    long = "la li " * 40_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x x x x x"), (5, "x x x x x x"), (5, "x x x x x x"), (None, "y " * 9), (6, long), (7, "y" * 300_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "start": F.lit("s"), "n_words": F.lit(None)})
    found = runs.periodic_runs(frame).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert [(by_id[i].n_words, by_id[i].runs) for i in (1, 2, 3, 4, 7)] == [(0, []), (0, []), (0, []), (5, []), (1, [])]
    assert [tuple(x) for x in by_id[5].runs] == [(0, 6, 1)] and by_id[5].collapsed == "x"
    assert by_id[None].collapsed == "y"
    assert [tuple(x) for x in by_id[6].runs] == [(0, 80_000, 2)] and by_id[6].collapsed == "la li"
    assert runs.periodic_runs(frame.filter("false")).count() == 0


def test_the_strongest_run_is_compared_exactly(spark):
    frame = spark.createDataFrame([([(5, 8, 2), (0, 12, 3), (9, 9, 2), (20, 18, 4)],), ([],)], "runs array<struct<start:long,length:long,period:long>>")
    best = [r.best for r in frame.select(runs._strongest(F.col("runs")).alias("best")).collect()]
    assert tuple(best[0]) == (9, 9, 2) and best[1] is None
