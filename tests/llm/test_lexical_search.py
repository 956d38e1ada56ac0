"""Ranked search against scores of all pairs, and the bounds that order it."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fairlead.llm.lexical_search import SearchRules, _flat, _levels, coordinates, impacts, search, sketch_index, distinct_terms

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LETTERS))


def plain_search(docs, items, top=10):
    split = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in split if c]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * big_n) // big_l
            score = sum(
                math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(terms(text))
                if c[t]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return sorted(out, key=str)


def tables(spark, docs, items):
    layout = "text string, size long, sketch string, row long"
    return (
        spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], f"doc_id long, {layout}"),
        spark.createDataFrame([(i, t, 1, "x", 2) for i, t in items], f"item_id long, {layout}"),
    )


DOCS = [
    *((i, f"alpha word{i % 7} beta x{i} " + "gamma " * (i % 5)) for i in range(60)),
    (100, None), (101, ""), (102, "!?, --"), (None, "alpha delta"), (103, "Alpha-DELTA É é"), (104, "alpha delta"), (104, "alpha delta"),
    *((200 + i, "same copy of delta words") for i in range(40)),
    (300, " ".join(f"t{i % 9000}" for i in range(60_000))),
]
ITEMS = [
    (1, "alpha gamma"), (2, None), (3, ""), (4, "..."), (5, "delta DELTA delta"), (6, "nowhere"), (7, "É"), (8, "copy same"), (8, "copy same"),
    (None, "beta word3"), (9, " ".join(f"t{i}" for i in range(0, 9000, 3))), (10, "alpha beta gamma delta x7 x8"),
]


@pytest.mark.parametrize("rules", [SearchRules(), SearchRules(top=3, width=1, block_terms=4)])
def test_search_equals_scores_of_all_pairs(spark, staging, rules):
    docs, items = tables(spark, DOCS, ITEMS)
    got = search(docs.repartition(5), items, staging, rules)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(DOCS, ITEMS, rules.top)


def test_empty_tables(spark, staging):
    docs, items = tables(spark, DOCS, ITEMS)
    none = docs.filter("false")
    assert search(none, items, staging).count() == 0
    assert search(docs.filter("text is null"), items, staging).count() == 0
    assert search(docs, items.filter("false"), staging).count() == 0


def test_bounds_are_never_below_impacts(spark):
    docs, _ = tables(spark, DOCS, ITEMS)
    kept = sketch_index(docs, 105, 60_900, SearchRules(width=1)).toArrow().combine_chunks().to_batches()[0]
    _, _, vocabulary, _ = distinct_terms(pa.array(["alpha gamma delta t7 t8 t8999 copy nowhere"]))
    levels = _levels(kept, vocabulary)
    found, begins = _flat(kept.column("terms"), np.uint64)
    counts, _ = _flat(kept.column("counts"), np.uint32)
    sizes, seen = kept.column("size").to_numpy(), 0
    for k in range(kept.num_rows):
        for t, term in enumerate(vocabulary):
            at = np.flatnonzero(found[begins[k] : begins[k + 1]] == term)
            if len(at):
                exact = impacts(counts[begins[k] + at].astype(np.int64), sizes[k], 105, 60_900)[0]
                assert int(levels[t, k]) * 1_000_000 >= exact * 255
                seen += 1
    assert seen > 100
    one, two = coordinates(vocabulary, 64)
    assert max(one.max(), two.max()) < 64
