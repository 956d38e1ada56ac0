"""Periodic runs against a comparison of all places, on texts with planted repeats."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from fairlead.llm.periodic_runs import Agreement, RunRules, _in_one_row, find_runs, op11_periodic_runs, periodic_runs

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words, exponent=4, least=6):
    """Every maximal stretch of every period, the smallest period of each."""
    n, found = len(words), {}
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i) + 1
    return sorted((s, length, p) for (s, length), p in found.items())


def random_texts(seed, many=60):
    draw = random.Random(seed)
    for _ in range(many):
        n, letters = draw.randrange(0, 150), draw.choice([1, 2, 3, 20])
        words = [draw.randrange(letters) for _ in range(n)]
        for _ in range(draw.randrange(0, 3)):
            unit = [draw.randrange(letters) for _ in range(draw.randrange(1, 12))]
            at = draw.randrange(0, len(words) + 1)
            words[at:at] = (unit * 12)[: draw.randrange(2, 12 * len(unit))]
        yield words


@pytest.mark.parametrize("rules", [RunRules(), RunRules(side=2), RunRules(exponent=2, least=2), RunRules(exponent=3, least=9, side=3)])
def test_runs_equal_all_places(rules):
    texts = list(random_texts(rules.side + rules.exponent))
    found = find_runs([np.array(t, np.int64) for t in texts], rules)
    for number, words in enumerate(texts):
        got = [tuple(r[1:]) for r in found.tolist() if r[0] == number]
        assert got == sorted(plain_runs(words, rules.exponent, rules.least)), words


def test_agreement_equals_comparison():
    texts = [np.array(t, np.int64) for t in random_texts(5, 8) if len(t) > 1]
    words, begins, sizes = _in_one_row(texts)
    agree = Agreement(words)
    draw = random.Random(1)
    pairs = []
    for begin, size in zip(begins.tolist(), sizes.tolist()):
        pairs += [tuple(begin + k for k in draw.sample(range(size), 2)) for _ in range(200)]
    i, j = np.array(pairs).T
    for a, b, length in zip(i.tolist(), j.tolist(), agree(i, j).tolist()):
        k = 0
        while words[a + k] == words[b + k]:
            k += 1
        assert k == length


def test_long_texts():
    """A word 200,000 times, and a period of 1,000 words forty times among others."""
    unit = np.arange(1000) + 7
    texts = [np.zeros(200_000, np.int64), np.concatenate([np.arange(5000) + 2000, np.tile(unit, 40), unit[:11], [1]])]
    assert find_runs(texts).tolist() == [[0, 0, 200_000, 1], [1, 5000, 40_011, 1000]]


def expected(doc_id, text):
    words = [w.encode() for w in "".join(chr(32) if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (
        doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_query_equals_brute_force(spark):
    got = op11_periodic_runs(spark, FOLDER)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    texts = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, got.collect())) == sorted(expected(r.doc_id, r.text) for r in texts)
    assert sum(r.n_runs > 0 for r in got.collect()) > 10


def test_nulls_repeats_and_other_columns(spark, tmp_path):
    long = " ".join(["ab", "c"] * 900)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "x " * 9), (4, "x " * 9), (4, "x " * 9), (5, "X x " * 5), (6, long), (7, "é é " * 6)]
    table = spark.createDataFrame([(i, t, "r", "c", 9) for i, t in rows], "doc_id long, text string, runs string, collapsed string, __check long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(i, t)) for i, t in rows)
    found = {(r.doc_id, str(r.runs), r.collapsed) for r in periodic_runs(table).filter("doc_id is null or doc_id in (3, 6, 7)").collect()}
    run = "[Row(start=0, length={}, period={})]"
    assert found == {(None, run.format(9, 1), "x"), (3, "[]", ""), (6, run.format(1800, 2), "ab c"), (7, run.format(6, 1), "é é")}
    empty = periodic_runs(table.filter("false"))
    assert empty.count() == 0
