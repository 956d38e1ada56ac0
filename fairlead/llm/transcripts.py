"""Roles in transcripts, recovered by a hidden Markov model, and turns in one canonical form.

The hidden state of a line is a role, and whether the line begins a turn. What is seen is the speaker marker before the
line, whether a message begins with it, its length, and how it ends. The model's probabilities are counts over conversations of
known roles; Viterbi's algorithm finds the most likely states of a transcript.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm.common import numbered, ship
from fairlead.sources.tables import Staging

ROLES = ("system", "user", "assistant")
# Names that stand before a speaker's line.
MARKERS = {
    "system": ("system", "instructions"),
    "user": ("user", "human", "customer", "question", "prompter", "q", "me"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "gpt", "a"),
}
_NAMES = {name: i + 1 for i, role in enumerate(ROLES) for name in MARKERS[role]}
_MARKER = re.compile(r"^[\s#>*<\[|]*(" + "|".join(sorted(_NAMES, key=len, reverse=True)) + r")[\]>*|]*\s*[:>\-]+[*\s]*", re.I)
#: Values of each feature: marker, begins a message, length, ending.
SHAPE = (len(ROLES) + 1, 2, 12, 3)
STATES = [(role, begins) for role in range(len(ROLES)) for begins in (True, False)]


@dataclass(frozen=True)
class TranscriptRules:
    """A task decodes ``window`` messages of a conversation, or joins ``fan`` such stretches. Counts start at ``prior``.

    For counting, a window has ``context`` more messages on either side. Pseudo-counts: a state has markers as if ``marked`` of its lines had
    been read once with each, nine tenths of that for the marker of a beginning state's own role and a hundredth for any other; a turn
    begins inside a message ``inner`` times as often as at the start of one.
    """

    window: int = 256
    context: int = 16
    prior: float = 0.5
    fan: int = 256
    marked: float = 0.01
    inner: float = 1 / 9


@dataclass(frozen=True)
class RoleModel:
    """Logarithms of probabilities: of the first state, of the next, and of each feature's values by state."""

    first: np.ndarray
    following: np.ndarray
    seen: tuple[np.ndarray, ...]


def line_features(line: str, begins: bool) -> tuple[tuple[int, ...], str]:
    """The values of the features, and the line without its marker."""
    found = _MARKER.match(line)
    rest = line[found.end() :] if found else line
    ending = 1 if rest.rstrip().endswith("?") else 2 if rest.rstrip().endswith((".", "!")) else 0
    marker = _NAMES[found.group(1).lower()] if found else 0
    return (marker, int(begins), min(len(rest).bit_length(), SHAPE[2] - 1), ending), rest


def placed_messages(messages: DataFrame, staging: Staging) -> DataFrame:
    """Messages with their place in the conversation, and how many it has, in order of turn, then text; null turns come last."""
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("text"), F.col("role")]
    line = staging.keep(numbered(messages, order, staging, "messages"), "ordered")
    starts = line.groupBy("conv_id").agg(F.min("position").alias("start"), F.count(F.lit(1)).alias("messages"))
    placed = line.alias("m").join(starts.alias("s"), F.col("m.conv_id").eqNullSafe(F.col("s.conv_id")))
    return placed.select("m.*", (F.col("position") - F.col("start")).alias("at"), "messages")


def windows(messages: DataFrame, staging: Staging, rules: TranscriptRules) -> DataFrame:
    """Messages with their window, and once more as context of a neighbouring one; a long conversation has many windows."""
    placed = placed_messages(messages, staging)
    near = F.array_distinct(
        F.transform(
            F.array(F.lit(-rules.context), F.lit(0), F.lit(rules.context)),
            lambda d: F.floor((F.col("at") + d) / rules.window),
        )
    )
    return placed.withColumn("window", F.explode(near)).filter("window >= 0")


def _lines(group: pd.DataFrame) -> Iterator[tuple[int, str, bool]]:
    for number, text in enumerate(group["text"]):
        for i, line in enumerate((text or "").split("\n")):
            yield number, line, i == 0


def fit(messages: DataFrame, staging: Staging, rules: TranscriptRules = TranscriptRules()) -> RoleModel:
    """The model counted over all messages (conv_id, turn, role, text) of known roles; rows of other roles are left out."""
    known = messages.filter(F.lower("role").isin(*ROLES)).withColumn("role", F.lower("role"))

    def counted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        counts: Counter = Counter()
        roles, inside = group["role"].tolist(), (group["at"] // rules.window == group["window"]).tolist()
        before, firsts = None, (group["at"] == 0).tolist()
        for number, line, begins in _lines(group):
            state = STATES.index((ROLES.index(roles[number]), begins))
            if inside[number]:
                counts[("first" if begins and firsts[number] else "next", before or 0, state)] += 1
                for i, value in enumerate(line_features(line, begins)[0]):
                    counts[(f"seen{i}", state, value)] += 1
            before = state
        rows = [(kind, i, j, n) for (kind, i, j), n in counts.items()]
        return pd.DataFrame(rows, columns=["kind", "i", "j", "n"])

    ship(messages.sparkSession.sparkContext)
    parts = windows(known, staging, rules).groupBy("conv_id", "window").applyInPandas(
        counted, "kind string, i long, j long, n long"
    )
    # One row per kind, state and value: a fixed number.
    table = parts.groupBy("kind", "i", "j").agg(F.sum("n").alias("n")).collect()
    size = len(STATES)
    tables = {"first": np.zeros((1, size)), "next": np.zeros((size, size))}
    tables.update((f"seen{i}", np.zeros((size, n))) for i, n in enumerate(SHAPE))
    for row in table:
        tables[row["kind"]][0 if row["kind"] == "first" else row["i"], row["j"]] += row["n"]
    # Smoothed counts. Tables of messages have few markers or none, and one turn each, so what a marker says and that a turn may also begin
    # inside a message comes from pseudo-counts, in proportion to a state's lines; counted ones are added to.
    smooth = {kind: table + rules.prior for kind, table in tables.items()}
    lines = tables["seen0"].sum(axis=1) + rules.prior
    for state, (owner, begins) in enumerate(STATES):
        for role in range(len(ROLES)):
            share = rules.marked * (0.9 if owner == role and begins else 0.01)
            smooth["seen0"][state, role + 1] = tables["seen0"][state, role + 1] + share * lines[state]
        if begins:
            smooth["seen1"][state, 0] += rules.inner * smooth["seen1"][state, 1]
    logs = {kind: np.log(table / table.sum(axis=1, keepdims=True)) for kind, table in smooth.items()}
    return RoleModel(logs["first"][0], logs["next"], tuple(logs[f"seen{i}"] for i in range(len(SHAPE))))


def _seen(features: np.ndarray, model: RoleModel) -> np.ndarray:
    return sum(table[:, features[:, i]].T for i, table in enumerate(model.seen))


def viterbi(features: np.ndarray, model: RoleModel, begins_conversation: bool, entry: int | None = None, leave: int | None = None) -> np.ndarray:
    """The most likely states; ties go to the first state. ``entry``: the state before the first line; ``leave``: the last line's, if known."""
    seen = _seen(features, model)
    best = seen[0] + (model.first if begins_conversation else 0 if entry is None else model.following[entry])
    back = np.zeros(seen.shape, np.int64)
    for i in range(1, len(seen)):
        ways = best[:, None] + model.following
        back[i] = ways.argmax(axis=0)
        best = ways.max(axis=0) + seen[i]
    path = np.empty(len(seen), np.int64)
    path[-1] = best.argmax() if leave is None else leave
    for i in range(len(seen) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def crossing(features: np.ndarray, model: RoleModel, begins_conversation: bool) -> np.ndarray:
    """The best score of all lines, by the state before the first and that of the last."""
    seen = _seen(features, model)
    best = seen[0] + (np.tile(model.first, (len(STATES), 1)) if begins_conversation else model.following)
    for own in seen[1:]:
        best = (best[:, :, None] + model.following).max(axis=1) + own
    return best


def _features(group: pd.DataFrame) -> np.ndarray:
    return np.array([line_features(line, begins)[0] for _, line, begins in _lines(group)])


def window_states(long: DataFrame, model: RoleModel, staging: Staging, rules: TranscriptRules) -> DataFrame | None:
    """conv_id, window, entry and leave: the states before and at the end of each window, on the best path of the whole conversation.

    ``long``: messages with their window. Crossings are joined ``fan`` at a time until one is left per conversation, whose best end is
    known; then the states between are found going back down. No task has more than ``window`` messages or ``fan`` crossings.
    """
    size = len(STATES)

    def crossed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        best = crossing(_features(group), model, group["at"].iloc[0] == 0)
        return pd.DataFrame({"conv_id": group["conv_id"].iloc[:1], "node": group["window"].iloc[:1], "best": [best.ravel().tolist()]}).astype({"conv_id": "Int64"})

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        best, *others = (np.array(b).reshape(size, size) for b in group["best"])
        for other in others:
            best = (best[:, :, None] + other).max(axis=1)
        return pd.DataFrame({"conv_id": group["conv_id"].iloc[:1], "node": group["above"].iloc[:1], "best": [best.ravel().tolist()]}).astype({"conv_id": "Int64"})

    def between(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        steps = [np.array(b).reshape(size, size) for b in group["best"]]
        scores = [steps[0][group["entry"].iloc[0]]]
        for step in steps[1:]:
            scores.append((scores[-1][:, None] + step).max(axis=0))
        leave = [int(group["leave"].iloc[0])]
        for score, step in zip(scores[-2::-1], steps[:0:-1], strict=True):
            leave.append(int((score + step[:, leave[-1]]).argmax()))
        leave.reverse()
        entry = [int(group["entry"].iloc[0]), *leave[:-1]]
        return pd.DataFrame({"conv_id": group["conv_id"], "node": group["node"], "entry": entry, "leave": leave}).astype({"conv_id": "Int64"})

    layout = "conv_id long, node long, best array<double>"
    above = F.expr(f"node div {rules.fan}").alias("above")
    levels = [staging.keep(long.groupBy("conv_id", "window").applyInPandas(crossed, layout), "crossings_0")]
    while (last := levels[-1].agg(F.max("node")).first()[0]) is not None and last > 0:
        joins = levels[-1].select("*", above).groupBy("conv_id", "above").applyInPandas(joined, layout)
        levels.append(staging.keep(joins, f"crossings_{len(levels)}"))
    if last is None:
        return None
    # A conversation's first state doesn't hang on what is before it.
    ends = F.expr(f"array_position(slice(best, 1, {size}), array_max(slice(best, 1, {size}))) - 1")
    states = levels[-1].select("conv_id", "node", F.lit(0).cast("long").alias("entry"), ends.alias("leave"))
    for i, level in reversed(list(enumerate(levels[:-1]))):
        one, other = level.select("*", above).alias("one"), states.alias("other")
        same = F.col("one.conv_id").eqNullSafe(F.col("other.conv_id")) & (F.col("one.above") == F.col("other.node"))
        met = one.join(other, same).select("one.*", "entry", "leave")
        found = met.groupBy("conv_id", "above").applyInPandas(between, "conv_id long, node long, entry long, leave long")
        states = staging.keep(found, f"states_{i}")
    return states.withColumnRenamed("node", "window")


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text.strip()}\n<|end|>"


def recover_turns(messages: DataFrame, model: RoleModel, staging: Staging, rules: TranscriptRules = TranscriptRules()) -> DataFrame:
    """conv_id, turn, part, role, rendered: the turns found in each message (conv_id, turn, text), most often one.

    A message may hold lines of several speakers; each that the model tells apart is a part, numbered from 0. A part that goes on with
    the last message's turn is a part of its own. Null text is one empty line; null conv_ids are one conversation. Repeated rows are messages of their own.
    Conversations of more than ``window`` messages are decoded by windows between states known from the whole conversation. Other columns are not read.
    """

    def decoded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        lines = [(number, *line_features(line, begins)) for number, line, begins in _lines(group)]
        entry, leave = (None if pd.isna(group[c].iloc[0]) else int(group[c].iloc[0]) for c in ("entry", "leave"))
        path = viterbi(np.array([features for _, features, _ in lines]), model, group["at"].iloc[0] == 0, entry, leave)
        found: list[list] = []
        conv, turns = group["conv_id"].tolist(), group["turn"].tolist()
        last = None
        for (number, _, rest), state in zip(lines, path.tolist(), strict=True):
            role, begins = STATES[state]
            if last is None or last[0] != number:
                found.append([conv[number], turns[number], 0, ROLES[role], [rest]])
            elif begins or last[1] != role:
                found.append([conv[number], turns[number], found[-1][2] + 1, ROLES[role], [rest]])
            else:
                found[-1][4].append(rest)
            last = (number, role)
        rows = [(c, t, part, role, render(role, "\n".join(text))) for c, t, part, role, text in found]
        return pd.DataFrame(rows, columns=["conv_id", "turn", "part", "role", "rendered"]).astype(
            {"conv_id": "Int64", "turn": "Int64", "part": "int64"}
        )

    ship(messages.sparkSession.sparkContext)
    plain = messages.select("conv_id", "turn", "text").withColumn("role", F.lit(None).cast("string"))
    placed = placed_messages(plain, staging).withColumn("window", F.expr(f"at div {rules.window}"))
    states = window_states(placed.filter(F.col("messages") > rules.window), model, staging, rules)
    if states is None:
        known = placed.select("*", *(F.lit(None).cast("long").alias(c) for c in ("entry", "leave")))
    else:
        same = F.col("m.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("m.window") == F.col("s.window"))
        known = placed.alias("m").join(states.alias("s"), same, "left").select("m.*", "entry", "leave")
    return known.groupBy("conv_id", "window").applyInPandas(
        decoded, "conv_id long, turn long, part long, role string, rendered string"
    )


def op7_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles counted over the whole table, then recovered without looking at them."""
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return recover_turns(messages, fit(messages, Staging(spark)), Staging(spark))
