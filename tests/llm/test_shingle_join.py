"""The shingle join and the pipeline against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fairlead.llm import words
from fairlead.llm.shingle_join import JoinRules, class_looks, close_in_sketch, close_pairs, one_of_each_group, shapes, similar_documents
from fairlead.sources.tables import Staging

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAYOUT = "doc_id long, text string, component_id string, group string"


def shingle_set(text: str | None, width: int) -> frozenset:
    found = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    return frozenset(tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))) if found else frozenset()


def components(rows, width, percent) -> list:
    sets = [shingle_set(t, width) for _, t, *_ in rows]
    above = list(range(len(rows)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            above[top(i)] = top(j)
    groups: dict = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[top(i)]) for i in range(len(rows))]


def edited(rng, text, edits):
    found = text.split()
    for _ in range(edits):
        found[rng.randrange(len(found))] = f"e{rng.randrange(10**6)}"
    return " ".join(found)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for length in (3, 5, 9, 30, 150, 150, 600):
        base = " ".join(rng.choices(vocabulary, k=length))
        rows += [(len(rows) + k, edited(rng, base, k % 8 if length > 9 else k % 2)) for k in range(24)]
    near = " ".join(rng.choices(vocabulary, k=120))
    rows += [(len(rows) + k, edited(rng, near, k % 12)) for k in range(90)]  # one large group
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows += [(len(rows) + k, " ".join(rng.choices(vocabulary, k=90)) + " " + passage) for k in range(40)]
    rows += [(5000, None), (5001, ""), (5002, " \t "), (5003, "One two"), (5004, "one TWO"), (5003, "one two"), (None, "one two"), (5006, "Éa b"), (5007, "éa b")]
    return [(i, t, "x", "y") for i, t in rows]


@pytest.mark.parametrize("width, percent, small, block", [(4, 85, 32, 2048), (5, 80, 6, 8)])
def test_components_equal_brute_force(spark, staging, rows, width, percent, small, block):
    rules = JoinRules(width, percent, small, block)
    found = similar_documents(spark.createDataFrame(rows, LAYOUT).repartition(3), staging, rules)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)
    assert got == sorted(components(rows, width, percent), key=str)


def test_one_of_each_group_stays(spark, staging, rows):
    docs = spark.createDataFrame(rows, LAYOUT)
    kept = one_of_each_group(docs, staging, JoinRules())
    assert kept.columns == docs.columns
    parts = components(rows, 5, 80)
    filled = {c for (_, size, c) in parts if size}
    got = [r.doc_id for r in kept.collect() if (r.text or "").strip()]
    assert sorted(got) == sorted(filled)
    assert sum(1 for r in kept.collect() if not (r.text or "").strip()) == 3


def test_large_sets_are_told_apart_in_their_bucket(spark, staging):
    """Sets of thousands of shingles in one bucket: only near ones leave it, also across lengths of sketches."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (300, 900, 1020, 1020, 2100, 2600, 4000, 4090, 4090, 7000)]
    texts += [edited(rng, texts[i], 8) + " more words" * (4 * (i == 7)) for i in (1, 2, 6, 7, 9)] + [t + " " + texts[0] for t in texts[4:7]]
    docs, rules = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], LAYOUT), JoinRules(5, 80)
    shape = staging.keep(shapes(docs, rules), "shapes")
    looks = staging.keep(class_looks(docs, shape, rules), "looks")
    number = {r.c: r.doc_id for r in shape.collect()}
    sets = [shingle_set(t, 5) for t in texts]
    linked = {(i, j) for i, j in combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    numbered = lambda df: {tuple(sorted((number[r.x], number[r.y]))) for r in df.collect()}
    for block in (2048, 4):
        bucket = looks.select(F.lit(1).alias("key"), "c", F.col("c").alias("root"), F.lit(len(texts)).alias("members"), "size", "sketch")
        assert numbered(close_pairs(bucket, JoinRules(5, 80, 2, block), all_of_them=True)) == linked
    pairs = looks.select(F.col("c").alias("x")).crossJoin(looks.select(F.col("c").alias("y"))).filter("x < y")
    assert len(linked) >= 8 and numbered(close_in_sketch(pairs, looks, rules)) == linked


def test_nothing_in_nothing_out(spark, staging):
    none = spark.createDataFrame([], LAYOUT)
    assert similar_documents(none, staging).count() == 0
    assert one_of_each_group(none, staging).count() == 0


def test_parts_are_more_than_the_differences():
    for rules in (JoinRules(4, 85), JoinRules(5, 80)):
        bands = rules.bands(3000)
        for a in range(1, 1000, 7):
            for b in range(a, a * 100 // rules.percent + 1):
                common = -(-rules.percent * (a + b) // (100 + rules.percent))
                own = next(i for i, (top, _) in enumerate(bands) if a <= top)
                other = next(i for i, (top, _) in enumerate(bands) if b <= top)
                assert other in (own, own + 1) and a + b - 2 * common <= rules.differences(bands[own][0]) < bands[own][1]


@pytest.mark.parametrize("block", [1, 2, 5, 1 << 20])
def test_words_do_not_depend_on_blocks(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    texts = ["a b", "", None, "Ab ab  AB\n\tx", "é É", "abcdefghijklmnop" * 5, " x ", "a", "b c"]
    hashes, bounds = words.word_hashes(pa.array(texts, pa.string()))
    found = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(t or "")] for t in texts]
    assert np.diff(bounds).tolist() == [len(f) for f in found]
    known: dict = {}
    for word, value in zip((w for f in found for w in f), hashes.tolist(), strict=True):
        assert known.setdefault(word, value) == value
    assert len(set(known.values())) == len(known)


def test_pipeline(spark):
    """Each stage against its definition, on what the stage before left."""
    folder = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    staging = Staging(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = staging.keep(stage(spark, docs, folder), name)
        seen[name] = (docs, out)
        assert name == "packing" or out.columns == docs.columns
        docs = out
    before, after = (f.collect() for f in seen["toxicity"])
    assert {r.doc_id for r in after} < {r.doc_id for r in before}
    before, after = (f.collect() for f in seen["line_dedup"])
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = (f.collect() for f in seen["near_duplicates"])
    groups = components([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted({c if size else d for d, size, c in groups})
    before, after = (f.collect() for f in seen["mixing"])
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    sequences: dict = {}
    for r in seen["packing"][1].collect():
        sequences[r.sequence_id] = sequences.get(r.sequence_id, 0) + r.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in sequences.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]


def test_pipeline_without_texts(spark, tmp_path):
    """No document at all, and documents without words: every stage runs and gives what its docstring says."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "labels"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None), (2, "", None, None, None), (3, " \n ", "x", "b", 3)]
    for name, table in (("none", docs.filter("false")), ("blank", spark.createDataFrame(rows, docs.schema))):
        staging, kept, left = Staging(spark), table, []
        for stage, function in corpus_pipeline.STAGES:
            kept = staging.keep(function(spark, kept, str(tmp_path)), f"{name}_{stage}")
            left.append(kept.count())
        assert left == ([0] * 5 if name == "none" else [5, 5, 5, 0, 0])
