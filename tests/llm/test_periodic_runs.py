"""Periodic runs against their definition."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from helixframe.llm import periodic_runs
from helixframe.llm.text import word_hashes


def brute(words, min_length=24, min_periods=3):
    n, runs = len(words), {}
    for q in range(n // min_periods, 0, -1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(min_length, min_periods * q):
                runs[i - q, j - i + q] = q  # smaller periods come later
            i = j
    return sorted(((s, m, q) for (s, m), q in runs.items()), key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_random_sequences():
    rng, count = random.Random(5), 0
    for trial in range(400):
        letters = [bytes([97 + i]) for i in range(rng.choice([1, 2, 3, 8, 40]))]
        words = []
        while len(words) < rng.randint(0, 300):
            phrase = [rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 7, 8, 9, 16, 17, 31, 33, 50]))]
            words += (phrase * rng.randint(1, 6))[:rng.randint(1, 200)]
        got = periodic_runs.find_runs(word_hashes(b" ".join(words)))
        assert got == brute(words), (trial, words)
        count += len(got)
        lengths = (rng.randint(1, 40), rng.randint(3, 5))
        assert periodic_runs.find_runs(word_hashes(b" ".join(words)), *lengths) == brute(words, *lengths)
    assert count > 400


def test_long_texts_stay_cheap():
    assert periodic_runs.find_runs(word_hashes(b"a " * 300_000)) == [(0, 300_000, 1)]
    phrase = [b"%d" % (i * i % 997) for i in range(5_000)]
    words = [b"x", *phrase * 4, b"y"]
    assert (1, 20_000, 5_000) in periodic_runs.find_runs(word_hashes(b" ".join(words)))


def test_few_periods_are_refused():
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.arange(50, dtype=np.uint64), 24, 2)


def test_query_columns(spark, docs, rows):
    more = [(9_000_000 + i, " ".join(["to be or not"] * 9 + ["a b c d e f g h i j k"] * 4), "en", "a", 0, 5, "x", 1) for i in range(40)]
    more += [(9_100_000 + i, "w " * 5_000 + "one\ttwo\x0bthree " * 700, "en", "a", 0, 5, "x", 1) for i in range(3)]
    table = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = periodic_runs.digests(periodic_runs.collapse_runs(periodic_runs.repeat_tails(table))).collect()
    want, damaged = [], 0
    for r in rows + more:
        words = (r[1] or "").encode().split()
        h = 1 if r[0] is None else zlib.crc32(str(r[0]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            damaged += 1
        runs = brute(words) if n < 2_000 else periodic_runs.find_runs(word_hashes(b" ".join(words)))
        best = None
        for s, m, q in runs:
            if best is None or m * best[2] > best[1] * q:
                best = (s, m, q)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        want.append((r[0], len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert damaged > 5


def test_empty_and_clashes(spark, docs, empty):
    assert periodic_runs.digests(periodic_runs.collapse_runs(periodic_runs.repeat_tails(empty))).count() == 0
    df = spark.createDataFrame([(1, "a " * 30, "own", 5)], "doc_id long, text string, runs string, n_words int")
    row = periodic_runs.collapse_runs(df).first()
    assert (row.doc_id, [tuple(r) for r in row.runs], row.n_words, row.collapsed) == (1, [(0, 30, 1)], 30, "a")
