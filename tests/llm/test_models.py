"""Toxicity, language-model scoring, transcripts and neighbours on held-out rows and against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fairlead.llm import lm_scoring, toxicity, transcripts
from fairlead.llm.neighbours import NeighbourRules, chi_square_quantile, nearest

FOLDER = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, toxic string, severity string"


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = toxicity.severity_labels(spark.read.parquet(f"{FOLDER}/labels.parquet"))
    model = toxicity.fit(docs, labels.filter("doc_id % 3 <> 0"))
    assert model.grades.tolist() == [0, 1, 2] and (np.diff(model.thresholds) >= 0).all()
    held = toxicity.score(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    toxic = [r for r in held if r.grade]
    assert sum(r.toxic for r in toxic) > 0.8 * len(toxic)
    assert sum(r.toxic for r in held if not r.grade) < 0.01 * len(held)
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == toxicity.score(docs, model).filter("not toxic").count()


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(i, f"fine words {i} " + ("vile " * 3 if i % 4 == 0 else ""), "x", "y") for i in range(200)], DOCS)
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.when(F.col("doc_id") % 8 == 0, 2).otherwise(1)).otherwise(0).alias("grade"))
    model = toxicity.fit(docs, labels)
    cases = [(1, None, "x", "y"), (2, "", "x", "y"), (None, "so vile", "x", "y"), (3, "fine " * 50_000, "x", "y"), (3, "Vile, vile!", "x", "y")]
    found = toxicity.score(spark.createDataFrame(cases, DOCS), model).collect()
    assert [r.toxic for r in found] == [False, False, True, False, True]
    assert all(0 <= r.severity <= 2 for r in found) and found[4].severity >= found[2].severity > found[3].severity
    one = toxicity.fit(docs, labels.filter("grade = 0"))
    assert {(r.severity, r.toxic) for r in toxicity.score(docs, one).collect()} == {(0.0, False)}
    none = toxicity.fit(docs, labels.filter("false"))
    assert {(r.severity, r.toxic) for r in toxicity.score(docs.limit(3), none).collect()} == {(0.0, False)}


def test_slopes_are_those_of_the_likelihood():
    rng = np.random.default_rng(1)
    scores, thresholds, grade = rng.normal(size=9), np.array([-0.5, 0.7]), rng.integers(0, 3, 9)

    def loss(s, t):
        upper, lower = np.append(t, np.inf)[grade], np.append(-np.inf, t)[grade]
        return -np.log(toxicity._sigmoid(upper - s) - toxicity._sigmoid(lower - s)).mean()

    by_score, by_threshold = toxicity._slopes(scores, thresholds, grade)
    step = 1e-6
    assert by_score == pytest.approx([(loss(scores + step * e, thresholds) - loss(scores, thresholds)) / step for e in np.eye(9)], abs=1e-4)
    assert by_threshold == pytest.approx([(loss(scores, thresholds + step * e) - loss(scores, thresholds)) / step for e in np.eye(2)], abs=1e-4)


def brute_losses(texts, target, vocabulary, rules):
    """Means per word of both models, by dictionaries."""
    import math
    from collections import Counter

    def pairs(text):
        words = [w if w in vocabulary else None for w in text.lower().split()]
        return list(zip(["<s>", *words], words))

    result = {}
    for name, corpus in (("target", target), ("background", texts)):
        both = Counter(p for t in corpus for p in pairs(t or ""))
        single, before = Counter(), Counter()
        for (v, w), n in both.items():
            single[w] += n
            before[v] += n
        total, size = sum(single.values()), rules.vocabulary

        def p(v, w):
            base = (single[w] + rules.prior) / (total + rules.prior * size)
            if not before[v]:
                return base
            kinds = sum(min(n, rules.discount) for (x, _), n in both.items() if x == v)
            return (both[v, w] - min(both[v, w], rules.discount) + kinds * base) / before[v]

        result[name] = [sum(-math.log(p(*x)) for x in pairs(t)) / len(pairs(t)) if t and t.split() else None for t in texts]
    return result


def test_language_model_scores(spark, staging):
    texts = [f"the cat sat on mat{i % 3}" for i in range(30)] + [f"buy cheap cheap pills {i}" for i in range(30)] + ["", None]
    rows = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], DOCS)
    rules = lm_scoring.ModelRules(vocabulary=8, held=5)
    models = lm_scoring.fit(rows, rows.filter("doc_id < 30"), staging, rules)
    assert np.exp(-models.target).sum(axis=1) == pytest.approx(1, abs=1e-4)
    got = {r.doc_id: r for r in lm_scoring.score(rows, models).collect()}
    counts = {"cheap": 60, "the": 30, "cat": 30, "sat": 30, "on": 30, "buy": 30, "pills": 30}
    ranked = sorted(counts, key=lambda w: (-counts[w], int(lm_scoring.word_hashes(pa.array([w]))[0].view(np.int64)[0])))
    want = brute_losses(texts, texts[:30], set(ranked[:6]), rules)
    for i in range(62):
        for found, wanted in ((got[i].target_loss, want["target"][i]), (got[i].background_loss, want["background"][i])):
            assert found is wanted is None or found == pytest.approx(wanted, rel=1e-5)
    assert got[0].score < 0 < got[40].score and got[61].score is None and got[60].n_words == 0


@pytest.mark.parametrize("common", [4, 65_536])
def test_language_model_of_all_words(spark, staging, common):
    texts = [f"the cat sat on mat{i % 3}" for i in range(30)] + [f"buy cheap cheap pills {i}" for i in range(30)] + ["", None]
    rows = spark.createDataFrame([(i % 61 or None, t, "x", "y") for i, t in enumerate(texts)], DOCS)
    words = {w for t in texts for w in (t or "").split()}
    rules = lm_scoring.ModelRules(vocabulary=len(words) + 2, held=5, common=common)
    found = lm_scoring.score_whole(rows, rows.filter("doc_id < 30 or text like '%mat0'"), staging, rules).collect()
    want = brute_losses(texts, texts[:30], words, rules)
    rounded = lambda *x: tuple(v if v is None else round(v, 4) for v in x)
    expected = [(i % 61 or None, len((t or "").split()), *rounded(want["target"][i], want["background"][i])) for i, t in enumerate(texts)]
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.n_words, *rounded(r.target_loss, r.background_loss))) for r in found)


def test_rare_words_keep_their_identity(spark, tmp_path):
    texts = [" ".join(f"{'good' if i < 20 else 'bad'}{j}" for j in range(i % 20, 2000, 20)) for i in range(40)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 20), 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    words = {w for t in texts for w in t.split()}
    assert len(words) == 4000
    want = brute_losses(texts, texts[:20], words, lm_scoring.ModelRules(vocabulary=4002))
    found = lm_scoring.op8_lm_scoring(spark, str(tmp_path)).collect()
    assert len(found) == 40
    for r in found:
        assert r.target_loss == pytest.approx(want["target"][r.doc_id]) and r.background_loss == pytest.approx(want["background"][r.doc_id])


def test_roles_are_recovered(spark, staging):
    layout = "conv_id long, turn long, role string, text string, part string"
    rows = []
    for c in range(60):
        for t in range(6):
            user = t % 2 == 0
            rows.append((c, t, "user" if user else "assistant", f"why {c}?\nplease" if user else f"Because of {c}. " * 12, "x"))
    messages = spark.createDataFrame(rows, layout)
    model = transcripts.fit(messages, staging)
    fresh = [(500, t, None, text, "x") for t, (_, _, _, text, _) in enumerate(rows[:6])]
    fresh += [(501, 0, None, "Human: hello\nthere\nAI: Hi.\nUser: bye", "x"), (None, None, None, None, "x"), (502, 0, "user", "", "x")]
    found = transcripts.recover_turns(spark.createDataFrame(fresh, layout), model, staging).collect()
    roles = {(r.conv_id, r.turn, r.part): (r.role, r.rendered) for r in found}
    assert [roles[500, t, 0][0] for t in range(6)] == ["user", "assistant"] * 3
    assert roles[501, 0, 0] == ("user", "<|user|>\nhello\nthere\n<|end|>")
    assert roles[501, 0, 1] == ("assistant", "<|assistant|>\nHi.\n<|end|>")
    assert roles[501, 0, 2] == ("user", "<|user|>\nbye\n<|end|>")
    assert len(found) == 11
    assert transcripts.recover_turns(messages.filter("false"), model, staging).count() == 0


def test_fit_counts_every_line(spark, staging):
    """Against counting in plain Python; markers in the table count, and every table's rows sum to one."""
    rules = transcripts.TranscriptRules(window=4, context=2)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", ("User: hi\nmore" if c == 1 else f"line {t}?") + "\nlast" * (c % 3)) for c in range(4) for t in range(11)]
    rows += [(1, 10, *rows[21][2:]), (9, 0, "narrator", "left out"), (None, 0, "system", None), (9, 1, "system", "")]
    model = transcripts.fit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), staging, rules)
    assert all(np.allclose(np.exp(table).sum(axis=-1), 1) for table in (model.first, model.following, *model.seen))
    seen = [np.zeros((len(transcripts.STATES), n)) for n in transcripts.SHAPE]
    following = np.zeros((len(transcripts.STATES),) * 2)
    known = sorted((r for r in rows if r[2] in transcripts.ROLES), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3] or ""))
    last = None
    for conv, _, role, text in known:
        for i, line in enumerate((text or "").split("\n")):
            state = transcripts.STATES.index((transcripts.ROLES.index(role), i == 0))
            for table, value in zip(seen, transcripts.line_features(line, i == 0)[0]):
                table[state, value] += 1
            if last is not None and last[0] == conv:
                following[last[1], state] += 1
            last = (conv, state)
    counted = following + rules.prior
    assert np.allclose(np.exp(model.following), counted / counted.sum(axis=1, keepdims=True))
    for table, logs in list(zip(seen, model.seen))[2:]:
        assert np.allclose(np.exp(logs), (table + rules.prior) / (table + rules.prior).sum(axis=1, keepdims=True))
    assert seen[0][:, 1:].sum() > 0
    for state, (owner, begins) in enumerate(transcripts.STATES):
        lines = seen[0][state].sum() + rules.prior
        want = seen[0][state] + [rules.prior, *(lines * rules.marked * (0.9 if owner == r and begins else 0.01) for r in range(len(transcripts.ROLES)))]
        assert np.allclose(np.exp(model.seen[0][state]), want / want.sum())


def test_viterbi_finds_the_best_path():
    from itertools import product

    rng = np.random.default_rng(3)
    size = len(transcripts.STATES)
    logs = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1]))
    model = transcripts.RoleModel(logs(1, size)[0], logs(size, size), tuple(logs(size, n) for n in transcripts.SHAPE))
    features = np.stack([rng.integers(0, n, 4) for n in transcripts.SHAPE], axis=1)

    def value(path):
        seen = sum(model.seen[i][s, features[k, i]] for k, s in enumerate(path) for i in range(len(transcripts.SHAPE)))
        return seen + model.first[path[0]] + sum(model.following[a, b] for a, b in zip(path, path[1:]))

    best = max(product(range(size), repeat=4), key=value)
    assert tuple(transcripts.viterbi(features, model, True)) == best


def test_long_conversations_are_decoded_by_windows(spark, staging):
    rules = transcripts.TranscriptRules(window=10, context=4)
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "Q?" if t % 2 == 0 else "An answer. " * 20) for t in range(57)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = transcripts.recover_turns(messages, transcripts.fit(messages, staging, rules), staging, rules).collect()
    assert {r.turn: r.role for r in found} == {t: role for _, t, role, _ in rows} and len(found) == 57


def test_long_conversations_are_decoded_as_one_chain(spark, staging):
    # Only the first message tells who speaks: afterwards users and assistants take turns, and no line says more than another.
    size = len(transcripts.STATES)
    user, assistant = (transcripts.STATES.index((role, True)) for role in (1, 2))
    first, following = np.full(size, 0.001), np.full((size, size), 0.001)
    first[assistant] = following[user, assistant] = following[assistant, user] = 0.995
    model = transcripts.RoleModel(np.log(first), np.log(following), tuple(np.full((size, n), -np.log(n)) for n in transcripts.SHAPE))
    rows = [(c, t, f"line {t}") for c, n in ((1, 301), (2, 10), (None, 45), (3, 11)) for t in range(n)]
    rules = transcripts.TranscriptRules(window=10, context=4, fan=4)
    found = transcripts.recover_turns(spark.createDataFrame(rows, "conv_id long, turn long, text string"), model, staging, rules).collect()
    assert {(r.conv_id, r.turn): r.role for r in found} == {(c, t): "user" if t % 2 else "assistant" for c, t, _ in rows}
    assert len(found) == len(rows)


def test_crossings_join_to_the_whole():
    rng = np.random.default_rng(4)
    size = len(transcripts.STATES)
    logs = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1]))
    model = transcripts.RoleModel(logs(1, size)[0], logs(size, size), tuple(logs(size, n) for n in transcripts.SHAPE))
    features = np.stack([rng.integers(0, n, 60) for n in transcripts.SHAPE], axis=1)
    path = transcripts.viterbi(features, model, True)
    one, other = transcripts.crossing(features[:25], model, True), transcripts.crossing(features[25:], model, False)
    best = (one[0][:, None] + other).max(axis=0)
    assert best == pytest.approx(transcripts.crossing(features, model, True)[0])
    assert best.argmax() == path[-1]
    assert (transcripts.viterbi(features[25:], model, False, path[24], path[-1]) == path[25:]).all()


def test_neighbours(spark, staging):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=16).round(3).tolist(), "x") for i in range(1200)]
    vectors += [(2000 + i, [1.0] * 16, "x") for i in range(40)]
    vectors += [(3000, None, "x"), (3001, [0.0] * 16, "x"), (3002, [float("nan")] * 16, "x"), (3003, [None] * 16, "x")]
    vectors += [(3004, [float("inf")] * 16, "x"), (3005, [1.0, 2.0], "x"), (None, [1.0] * 16, "x")]
    table = spark.createDataFrame(vectors, "vec_id long, vector array<double>, score string")
    rules = NeighbourRules(block=256, leaf=16, queries=7)
    found: dict = {}
    for r in nearest(table, "vec_id % 50 = 0", staging, rules).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, matrix = np.array([v[0] for v in vectors[:1240]]), np.array([v[1] for v in vectors[:1240]])
    assert sorted(found) == sorted(i for i in ids.tolist() if i % 50 == 0)
    hits = 0
    for query, rows in found.items():
        apart = np.sqrt(((matrix - matrix[ids == query]) ** 2).sum(axis=1))
        apart[ids == query] = np.inf
        best = ids[np.lexsort((ids, apart))[:10]].tolist()
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert all(r[2] == pytest.approx(apart[ids == r[1]][0]) for r in rows)
        hits += len({r[1] for r in rows} & set(best))
    assert hits >= 0.9 * 10 * len(found)
    assert [r[1] for r in found[2000]] == list(range(2001, 2011)) and found[2000][0][2] == 0.0
    few = nearest(table.filter("vec_id in (0, 1, 2)"), "vec_id = 0", staging)
    assert few.count() == 2
    assert nearest(table.filter("false"), "vec_id = 0", staging).count() == 0


def test_neighbours_are_missed_with_two_per_cent_at_most():
    assert NeighbourRules().chance >= 0.98


def test_quantile_of_chi_square():
    assert chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)
    assert chi_square_quantile(0.99, 2) == pytest.approx(9.2103, abs=1e-3)


@pytest.mark.parametrize("discount", [0.75, 1.5])
def test_marked_target_and_pieces_of_blocks(spark, staging, discount):
    """The target as a column, bigrams in many blocks and texts longer than one; and a discount above one."""
    texts = [" ".join(f"w{(i * j) % 23}" for j in range(1 + i % 9)) for i in range(60)] + ["a b " * 300, None, "... !"]
    rows = spark.createDataFrame([(i, t, i % 3 == 0) for i, t in enumerate(texts)], "doc_id long, text string, good boolean")
    words = {w for t in texts[:-1] for w in (t or "").split()}
    rules = lm_scoring.ModelRules(vocabulary=len(words) + 2, held=7, discount=discount)
    want = brute_losses(texts[:-1] + [""], [t for i, t in enumerate(texts[:-1]) if i % 3 == 0], words, rules)
    for target in ("good", rows.filter("good")):
        found = {r.doc_id: r for r in lm_scoring.score_whole(rows.repartition(5), target, staging, rules).collect()}
        assert len(found) == 63
        for i, r in found.items():
            assert (r.target_loss, r.background_loss) == (want["target"][i], want["background"][i]) == (None, None) or (
                (r.target_loss, r.background_loss) == pytest.approx((want["target"][i], want["background"][i]), rel=1e-5)
            )


def test_no_row_is_shuffled_for_each_bigram(spark, staging):
    """A text's bigrams leave it as a few rows of lists, however many they are."""
    rows = spark.createDataFrame([(1, " ".join(f"x{i}" for i in range(50_000)))], "doc_id long, text string")
    blocks = lm_scoring.in_blocks(rows.selectExpr("doc_id", "text", "true as target"), lm_scoring.ModelRules())
    asked = lm_scoring._asked(blocks, 4).toArrow()
    assert asked.num_rows == 5
    values, _ = lm_scoring._flat(asked.column("pairs"))
    assert len(values) == len(set(values.tolist())) == 50_000
    assert sum(len(x) for c in ("before", "n", "t") for x in asked.column(c).to_pylist() if x) < 200_000


def test_numbers_in_bytes_come_back():
    values = np.array([0, 1, 127, 128, 300, 1 << 31, (1 << 62) + 5, 0])
    packed = lm_scoring._packed(values, np.array([0, 0, 3, 8]))
    assert [len(x) for x in packed.to_pylist()][:2] == [0, 3]
    assert lm_scoring._unpacked(pa.chunked_array([packed])).tolist() == values.tolist()
