"""Periodic runs against every stretch, period by period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import periodic
from tessella.llm.common import table


def brute_runs(words, exponent=4, least=6):
    """Every stretch, its least period found by trying all; kept if no longer one keeps the period."""
    n, out = len(words), []
    for s in range(n):
        for e in range(s + least, n + 1):
            q = next(q for q in range(1, e - s + 1) if all(words[i] == words[i + q] for i in range(s, e - q)))
            if e - s < exponent * q or (s and words[s - 1] == words[s - 1 + q]) or (e < n and words[e] == words[e - q]):
                continue
            out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def scanned_runs(words, exponent=4, least=6):
    """Every lag in turn, word by word, with stretches that a shorter period has left out."""
    n, seen = len(words), {}
    ids = np.unique(words, return_inverse=True)[1]
    for q in range(1, n // exponent + 1):
        i = 0
        if np.count_nonzero(ids[:-q] == ids[q:]) < max(least, exponent * q) - q:
            continue
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i:
                seen.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in seen.items())


def expected(doc_id, text):
    words = periodic.WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = scanned_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)), n,
    )


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 4), st.integers(1, 9))
def test_runs_against_every_stretch(ids, exponent, least):
    got = periodic.runs_of(np.array(ids, np.int64), exponent, least)
    assert got == scanned_runs(ids, exponent, least)
    if len(ids) < 30:
        assert got == [r for r in brute_runs(ids, exponent, least)]


def test_frequent_and_rare_words(monkeypatch):
    rng = random.Random(1)
    for most in (0, 3, 10**9):  # all words by autocorrelation, some, none
        monkeypatch.setattr(periodic, "frequent_from", lambda n, most=most: most)
        for n in (1, 7, 200, 900):
            ids = np.array([rng.choice((0, 0, 0, rng.randrange(n))) for _ in range(n)])
            want = [0, *((ids[:-q] == ids[q:]).sum() for q in range(1, n // 2 + 1))]
            assert periodic.lag_counts(ids, n // 2).tolist() == want


def test_long_texts_scan_few_lags(monkeypatch):
    scanned = []
    monkeypatch.setattr(periodic, "islands", lambda equal, own=periodic.islands: scanned.append(1) or own(equal))
    one = np.zeros(200_000, np.int64)
    assert periodic.runs_of(one) == [(0, 200_000, 1)] and len(scanned) == 1
    many = np.concatenate([np.arange(300), np.tile(np.arange(300, 370), 900), np.arange(400, 900)])
    assert periodic.runs_of(many) == [(300, 63_000, 70)] and len(scanned) < 10


def test_rows_and_digests(spark, small):
    from pyspark.sql import functions as F

    from tessella.llm.queries import op12_periodic_runs

    docs = table(spark, small, "documents").collect()
    got = op12_periodic_runs(spark, small).collect()
    assert sorted(map(tuple, got)) == sorted(expected(r.doc_id, r.text) for r in docs)
    assert sum(r.n_runs > 0 for r in got) > 20
    one = periodic.find_runs(spark.createDataFrame([(1, "x a b a b a b a b a y y y y y y")], "doc_id long, text string"))
    row = one.select("*", *(c.alias(n) for n, c in periodic.digests(F.col("runs")).items())).first()
    assert [tuple(r) for r in row.runs] == [(1, 9, 2), (10, 6, 1)] and row.collapsed == "x a b y" and row.exponent_milli == 4500


def test_messy_rows(spark, messy, empty):
    from pyspark.sql import functions as F

    planted = messy.select("doc_id", periodic.with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    texts = {(r.doc_id, r.text) for r in messy.collect()}
    got = periodic.find_runs(planted)
    rows = got.select("doc_id", *(c.alias(n) for n, c in periodic.digests(F.col("runs")).items()), F.sha2("collapsed", 256), "n_words").collect()
    assert len(rows) == messy.count() and {tuple(r) for r in rows} == {expected(*x) for x in texts}
    assert periodic.find_runs(messy).count() == messy.count() and periodic.find_runs(empty).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(messy, exponent=1)
