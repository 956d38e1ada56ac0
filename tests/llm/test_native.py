"""Exact dedup, line dedup and mixing on small tables."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from compare import bag, connect

from fairlead.llm.exact_dedup import exact_duplicates
from fairlead.llm.line_dedup import LineRules, remove_boilerplate
from fairlead.llm.mixing import MixRules, apportion, mix, mixed_documents, source_targets
from fairlead.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
LAYOUT = "doc_id long, text string, lang string, source string, n_chars long, kept string, __salt string"


def docs(spark, *rows):
    """(doc_id, text, source), with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, None, "x", "y") for i, t, s in rows], LAYOUT)


def test_queries_equal_sql(spark):
    connection = connect(FOLDER)
    for name, sql in SQL.items():
        frame = QUERIES[name](spark, FOLDER)
        answer = connection.execute(sql)
        names = [c[0] for c in answer.description]
        assert sorted(names) == sorted(frame.columns)
        assert bag(frame.columns, frame.collect()) == bag(names, answer.fetchall()), name
        plan = frame._jdf.queryExecution().executedPlan().toString()
        if name not in ("op3_line_dedup", "op6_exact_dedup"):
            continue
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_exact_duplicates(spark, staging):
    long = "a b " * 50_000
    rows = [(1, "x", "s"), (2, "x", None), (3, None, "s"), (4, "", "s"), (5, long, "s"), (6, long + "c", "s"), (7, long + "d", "s")]
    rows += [(None, "x", "s"), (8, long + "c", "t"), (9, "X", "s"), (2, "x", "s"), (None, "alone", "s")]
    found = exact_duplicates(docs(spark, *rows), staging)
    got = sorted(((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in found.collect()), key=str)
    assert got == sorted([
        (0, None, 1, True), (0, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (3, 4, 2, False), (4, 4, 2, True),
        (5, 5, 1, True), (6, 8, 2, False), (7, 7, 1, True), (8, 8, 2, True), (9, 9, 1, True),
    ], key=str)


def test_empty_tables(spark, staging):
    none = docs(spark, (1, "x", "s")).filter("false")
    assert exact_duplicates(none, staging).count() == 0
    assert remove_boilerplate(none, staging).count() == 0
    assert mix(none, staging).count() == 0


def test_lines_on_many_sites_stay_once(spark, staging):
    rows = [(i, f"own {i}\n  Terms apply. \n\nend {i}", f"s{i % 9}") for i in range(20)]
    rows += [(50, "seven sites\nx", f"s{j}") for j in range(7)] + [(51, None, "s1"), (52, "", None), (None, "Terms apply.", "s2")]
    got = {(r.doc_id, r.text): (r.n_lines, r.n_removed) for r in remove_boilerplate(docs(spark, *rows), staging, LineRules(min_sites=8)).collect()}
    assert got[0, "own 0\n  Terms apply. \n\nend 0"] == (4, 0)
    assert all(got[i, f"own {i}\n\nend {i}"] == (4, 1) for i in range(1, 20))
    assert got[50, "seven sites\nx"] == (2, 0)
    assert got[51, None] == (0, 0) and got[52, ""] == (1, 0) and got[None, ""] == (1, 1)


def test_line_dedup_keeps_columns_of_any_name(spark, staging):
    """Columns named as helpers come back as they were; a very long text, repeated rows and a line of many sites."""
    extra = ["__key", "__drop", "__id", "__row", "key", "dropped", "lines", "column_0", "h", "g", "n_lines", "a.b"]
    rows = [(i, f"own {i}\nshared", f"s{i}", *(f"{c} {i}" for c in extra)) for i in range(10)]
    rows += [(20, "x\n" * 200_000 + "shared", "s1", *extra), (0, "own 0\nshared", "s0", *(f"{c} 0" for c in extra))]
    layout = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in extra)
    table = spark.createDataFrame(rows, layout)
    found = remove_boilerplate(table, staging, LineRules(min_sites=8))
    assert found.columns == [c for c in table.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    got = {r.doc_id: r for r in found.collect()}
    assert found.count() == 12 and got[0].n_removed == 0 and got[3].text == "own 3" and got[20].n_lines == 200_001
    assert all(got[3][c] == f"{c} 3" for c in extra if c != "n_lines")


def targets(sizes: dict, weights=(3, 1, 2)) -> dict:
    """The definition, by filling sources one at a time."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, rest, target = set(order), 1.5 * sum(sizes.values()), {}
    while True:
        level = rest / max(sum(weight[s] for s in left), 1)
        full = {s for s in left if weight[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in left}
        for s in full:
            target[s] = 2 * sizes[s]
            rest -= target[s]
        left -= full


@pytest.fixture(scope="module")
def mixture():
    rows, n = [], 0
    for source, count, words in [("b", 40, 90), ("a", 3, 50), (None, 25, 30), ("é", 10, 400), ("Z", 8, 1)]:
        for _ in range(count):
            n += 1
            rows.append((n, " ".join(f"w{n}_{i}" for i in range(words + n % 7)), source))
    return [*rows, (1000, None, "a"), (1001, "  ", "b"), (1, rows[0][1], "b")]


def test_mix_meets_its_targets(spark, staging, mixture):
    table = docs(spark, *mixture)
    rules = MixRules(shard_words=1000)
    found = mix(table, staging, rules).collect()
    assert len(found) == len(mixture)
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, text, source in mixture:
        sizes[source] += len((text or "").split())
    for r in found:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
    want = targets(sizes)
    for r in found:
        assert r.target == pytest.approx(want[r.source])
    for source, target in want.items():
        assert abs(taken[source] - target) <= rules.block_words * (2 + sizes[source] / 500)
    again = mix(table.repartition(5), staging, rules).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in found)


@pytest.mark.parametrize("texts", [{"a": "x y z " * 40, "b": None}, {"a": "", "b": None, None: " "}, {"a": "one two three", "b": "four " * 3}])
def test_mix_with_sources_or_shards_without_words(spark, staging, texts):
    """Collected, not only counted: a source without words, no words at all, and more shards than documents."""
    rows = [(i, t, s) for i, (s, t) in enumerate(texts.items())] + [(9, None, "a"), (10, "\t", "a")]
    rules = MixRules(shard_words=1, block_words=2)
    found = mix(docs(spark, *rows), staging, rules).collect()
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    assert {r.doc_id: r.size for r in found} == sizes
    assert all(0 <= r.taken <= 2 * r.size for r in found)
    want = targets({s: sum(sizes[i] for i, _, own in rows if own == s) for _, _, s in rows})
    assert all(r.target == pytest.approx(want[r.source]) for r in found)
    assert sum(r.taken for r in found) == pytest.approx(sum(want.values()), abs=2 * len(rows))
    taken = mixed_documents(docs(spark, *rows), staging, rules).collect()
    assert sum(len(r.text.split()) for r in taken) == sum(r.taken for r in found)


def test_mix_of_a_very_long_text(spark, staging):
    rows = [(1, "word " * 300_000, "a"), (2, "other " * 50, "b"), (2, "other " * 50, "b")]
    found = {(r.doc_id, r.size): r.taken for r in mix(docs(spark, *rows), staging).collect()}
    assert set(found) == {(1, 300_000), (2, 50)} and 0 < found[1, 300_000] <= 600_000


def test_seats_go_to_the_highest_quotients(spark, staging):
    """Against dealing one seat after the other: Sainte-Lague's divisors 1, 3, 5, ...; equal quotients by name, null last."""
    groups = {"g": {"a": 53, "b": 24, "c": 23, "d": 0}, "h": {"a": 7, None: 7, "b": 7}, None: {"z": 1000, "y": 1}, "k": {"x": 0}}
    seats = {"g": 17, "h": 4, None: 9, "k": 0}
    rows = [(g, p, float(v), seats[g]) for g, parties in groups.items() for p, v in parties.items()]
    table = spark.createDataFrame(rows, "key string, party string, votes double, seats long")
    got = {(r.key, r.party): r.quota for r in apportion(table, ["key"], "party", staging, "q").collect()}
    for g, parties in groups.items():
        won = dict.fromkeys(parties, 0)
        for _ in range(seats[g]):
            best = min(parties, key=lambda p: (-parties[p] / (2 * won[p] + 1), p is None, p or ""))
            won[best] += 1
        assert {p: got[g, p] for p in parties} == won


def test_plans_of_the_mix_stay_small(spark, staging):
    """What several steps read is stored: the driver keeps a thread for each exchange of a plan."""
    sizes = spark.createDataFrame([("a", 10), ("b", 500), (None, 40)], "source string, size long")
    targets = source_targets(sizes, MixRules(), staging)
    assert "Exchange" not in targets._jdf.queryExecution().executedPlan().toString()
    assert {r.source: (r.source_size, round(r.target, 6)) for r in targets.collect()} == {"a": (10, 20.0), "b": (500, 725.0), None: (40, 80.0)}
    parties = targets.selectExpr("0 as key", "source", "target as votes", "50L as seats")
    quotas = apportion(parties, ["key"], "source", staging, "few")
    assert quotas._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 8
    assert sum(r.quota for r in quotas.collect()) == 50


def test_mixed_texts_hold_what_is_taken(spark, staging, mixture):
    table = docs(spark, *mixture)
    rules = MixRules(shard_words=1000, block_words=64)
    taken, texts = defaultdict(int), defaultdict(list)
    for r in mix(table, staging, rules).collect():
        taken[r.doc_id] += r.taken
    out = mixed_documents(table, staging, rules)
    assert out.columns == table.columns
    whole = {i: (t or "").split() for i, t, _ in mixture}
    for r in out.collect():
        texts[r.doc_id].append(r.text.split())
    assert {i: sum(map(len, t)) for i, t in texts.items()} == {i: n for i, n in taken.items() if n}
    assert all(set(t) <= set(whole[i]) for i, parts in texts.items() for t in parts)


def test_hash_is_of_the_whole_text(spark):
    frame = QUERIES["op6_exact_dedup"](spark, FOLDER).orderBy("doc_id").limit(3).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert all(r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in frame)
