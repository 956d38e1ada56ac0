"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is dealt in blocks of equal word count. Sources get blocks by the highest quotients
``votes / (2 * seats + 1)``; a source's blocks go to its shards by the same rule; inside a shard,
documents lie in a seeded order and the shard's quota of blocks is drawn with a seeded start.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fairlead.llm.common import documents, numbered, whole
from fairlead.sources.tables import Staging

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixRules:
    """Weights go round the sources in code-point order. ``shard_words`` bounds what one task orders."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    block_words: int = 16
    shard_words: int = 1 << 16
    seed: int = 20


def source_targets(sizes: DataFrame, rules: MixRules, staging: Staging) -> DataFrame:
    """source, source_size, target: ``share`` of all words by weight, none above ``most`` times its size.

    Level L is where the sum of ``min(weight * L, most * size)`` reaches the total. A source is full
    if the sum at the level that fills it is not above the total.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = numbered(totals, [F.col("source").asc_nulls_last()], staging, "sources")
    turn = F.pmod("position", F.lit(len(rules.weights)))
    weights = F.array(*(F.lit(w) for w in rules.weights))
    weighed = order.select(
        "source",
        "source_size",
        F.get(weights, turn.cast("int")).cast("double").alias("weight"),
        (F.col("source_size") * rules.most).cast("double").alias("most"),
    ).withColumn("fills_at", F.col("most") / F.col("weight"))
    filling = numbered(
        weighed, [F.col("fills_at"), F.col("source").asc_nulls_last()], staging, "filling", ["weight", "most"]
    )
    # Stored, as it is read three times: plans that hold it three times over cost the driver threads and memory.
    filling = staging.keep(filling, "filled")
    # Two rows of sums reach the driver.
    words, weights = filling.agg((F.sum("source_size") * rules.share).cast("double"), F.sum("weight")).first()
    words, weights = F.lit(words).cast("double"), F.lit(weights).cast("double")
    at_level = F.col("most_before") + F.col("fills_at") * (weights - F.col("weight_before"))
    judged = filling.withColumn("full", at_level <= words)
    (level,) = judged.agg(
        (words - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))), F.lit(0.0)))
        / F.sum(F.when(~F.col("full"), F.col("weight")))
    ).first()
    share = F.when(F.col("full"), F.col("most")).otherwise(
        F.least(F.col("most"), F.col("weight") * F.lit(level).cast("double"))
    )
    return judged.select("source", "source_size", share.alias("target"))


def apportion(parties: DataFrame, key: list[str], party: str, staging: Staging, name: str) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each ``key`` group, dealt to its parties by Sainte-Lague.

    ``parties`` has the key columns, ``party``, ``votes`` and the group's ``seats``. Half a seat per
    party less, one divisor gives every party seats it surely gets; half a seat more bounds what it can get. Only the quotients
    between, about two per party, are ranked, in one global order. What several steps read is stored, so that each plan stays small.
    """
    groups = parties.groupBy(*key).agg(
        F.sum("votes").alias("__votes"), F.count(F.lit(1)).alias("__n"), F.first("seats").alias("__seats")
    )
    on = _same("p", "g", key)
    rows = parties.alias("p").join(groups.alias("g"), on).select("p.*", "__votes", "__n", "__seats")
    share = F.when(F.col("__votes") > 0, F.col("votes") / F.col("__votes")).otherwise(F.lit(0.0))

    def sure(seats: Column) -> Column:
        return F.greatest(F.floor(share * seats + 0.5 - 1e-9), F.lit(0)).cast("long")

    rows = rows.withColumn("__sure", sure(F.col("__seats") - F.col("__n") / 2)).withColumn(
        "__high", sure(F.col("__seats") + F.col("__n") / 2) + 1
    )
    rows = staging.keep(rows, f"{name}_parties")
    quotients = rows.filter("votes > 0").select(
        *key, party, "votes", F.explode(F.sequence("__sure", "__high")).alias("__next")
    ).withColumn("__quotient", F.col("votes") / (F.col("__next") * 2 + 1))
    order = [*(F.col(k).asc_nulls_last() for k in key), F.col("__quotient").desc(), F.col(party).asc_nulls_last()]
    ranked = staging.keep(numbered(quotients, order, staging, name), f"{name}_ranked")
    left = rows.groupBy(*key).agg((F.first("__seats") - F.sum("__sure")).alias("__left"))
    starts = ranked.groupBy(*key).agg(F.min("position").alias("__start"))
    limits = left.alias("l").join(starts.alias("s"), _same("l", "s", key)).select("l.*", "__start")
    won = (
        ranked.alias("r")
        .join(limits.alias("m"), _same("r", "m", key))
        .filter("position - __start < __left")
        .groupBy(*(F.col(f"r.{k}") for k in key), F.col(f"r.{party}"))
        .agg(F.count(F.lit(1)).alias("__won"))
    )
    return (
        rows.alias("a")
        .join(won.alias("w"), _same("a", "w", [*key, party]), "left")
        .select("a.*", (F.col("__sure") + F.coalesce("__won", F.lit(0))).alias("quota"))
        .drop("__votes", "__n", "__seats", "__sure", "__high")
    )


def _same(left: str, right: str, columns: list[str]) -> Column:
    condition = F.lit(True)
    for column in columns:
        condition = condition & F.col(f"{left}.{column}").eqNullSafe(F.col(f"{right}.{column}"))
    return condition


def _drawn(docs: DataFrame, staging: Staging, rules: MixRules) -> DataFrame:
    """Per row: doc_id, source, size, draw (its place in the seeded order), source_size, target, and of its shard ends, quota, blocks, start."""
    sizes = staging.keep(
        docs.select(
            "doc_id",
            "source",
            F.regexp_count(whole(), F.lit(WORD)).cast("long").alias("size"),
            _draw(rules).alias("draw"),
        ),
        "sizes",
    )
    targets = staging.keep(source_targets(sizes, rules, staging), "targets")
    (seats,) = targets.agg(F.round(F.sum("target") / rules.block_words).cast("long")).first()
    parties = targets.withColumn("votes", F.col("target")).withColumn("all", F.lit(0))
    shares = staging.keep(
        apportion(parties.withColumn("seats", F.lit(seats).cast("long")), ["all"], "source", staging, "source_quotients").select(
            "source",
            "source_size",
            "target",
            F.col("quota").alias("seats"),
            F.greatest(F.lit(1), F.ceil(F.col("source_size") / rules.shard_words)).cast("long").alias("shards"),
        ),
        "shares",
    )
    rows = (
        sizes.alias("d")
        .join(shares.select("source", "shards").alias("s"), _same("d", "s", ["source"]))
        .select("d.*", F.pmod(F.xxhash64(F.lit(rules.seed + 1), F.col("draw")), F.col("shards")).alias("shard"))
    )
    shards = staging.keep(rows.groupBy("source", "shard").agg(F.sum("size").alias("votes")), "shards")
    shards = shards.alias("h").join(shares.alias("s"), _same("h", "s", ["source"])).select(
        "h.*", "source_size", "target", "seats"
    )
    quotas = staging.keep(apportion(shards, ["source"], "shard", staging, "shard_quotients"), "quotas")

    blocks = F.ceil(F.col("votes") / rules.block_words).cast("long")
    quotas = quotas.withColumn("blocks", blocks).withColumn(
        "quota", F.least(F.col("quota"), F.col("blocks") * rules.most)
    )
    inside = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size")
    placed = rows.withColumn("ends", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.alias("d").join(
        quotas.select("source", "shard", "source_size", "target", "quota", "blocks").alias("q"),
        _same("d", "q", ["source", "shard"]),
    ).select(
        "d.doc_id", "d.source", "size", "draw", "source_size", "target", "quota", "blocks", "ends",
        # A shard without words has no block.
        F.pmod(F.xxhash64(F.lit(rules.seed + 2), F.col("d.source"), F.col("d.shard")), F.greatest("blocks", F.lit(1))).alias("start"),
    )


def _draw(rules: MixRules) -> Column:
    return F.xxhash64(F.lit(rules.seed), F.col("doc_id"), whole())


def _times(block: str) -> str:
    """How often a block is taken, as SQL.

    Every block is taken ``quota div blocks`` times. Of the rest, ``quota % blocks``, those blocks are taken once more at which
    ``(block * rest + start) div blocks`` steps up: exactly as many, for any start.
    """
    steps = f"((({block} + 1) * (quota % blocks) + start) div blocks - ({block} * (quota % blocks) + start) div blocks)"
    return f"((quota div blocks) + {steps})"


def mix(docs: DataFrame, staging: Staging, rules: MixRules = MixRules()) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted).

    Null text has size 0; null is a source of its own, last in order. Rows that are equal in doc_id and text
    are rows of their own; reruns agree. Documents of one source are dealt to shards by hash, so a source with
    most rows is ordered in many tasks. Other columns are not read. An empty table gives an empty result.
    """

    def before(at: str) -> str:
        """Words taken of the shard's first ``at`` words, as SQL."""
        block = f"({at} div {rules.block_words})"
        full = f"({block} * (quota div blocks) + ({block} * (quota % blocks) + start) div blocks)"
        return f"({rules.block_words} * {full} + ({at} % {rules.block_words}) * {_times(block)})"

    taken = F.expr(f"{before('ends')} - {before('(ends - size)')}")
    return _drawn(docs, staging, rules).select(
        "doc_id", "source", "size", "source_size", "target",
        F.when((F.col("size") > 0) & (F.col("blocks") > 0), taken).otherwise(F.lit(0)).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, staging: Staging, rules: MixRules = MixRules()) -> DataFrame:
    """The mix itself: rows with the columns of ``docs``, and in ``text`` the words taken, with the white space after them.

    The first row of a document has the words of all blocks taken at least once, a second one those of blocks taken
    twice, and so on; rows without words are left out. A text taken whole is unchanged.
    """
    turn = Window.partitionBy("draw").orderBy("ends")
    plan = _drawn(docs, staging, rules).filter("size > 0 and quota > 0").withColumn("nth", F.row_number().over(turn))
    plan = plan.select("draw", "nth", "size", "quota", "blocks", "ends", "start")
    names = [f"__{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("draw", F.xxhash64(F.lit(rules.seed), *_named(docs, "doc_id", "text")))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("draw").orderBy(names[0])))
    text = names[docs.columns.index("text")]
    words = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), 0)
    times = f"transform(sequence(0, size - 1), i -> {_times(f'((ends - size + i) div {rules.block_words})')})"
    taken = rows.join(plan, ["draw", "nth"]).withColumn("__times", F.expr(times)).withColumn("__words", words)
    taken = taken.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.array_max("__times").cast("int"))))
    taken = taken.filter("__turn > 0 and array_max(__times) >= __turn")
    chosen = F.array_join(F.filter("__words", lambda w, i: F.get("__times", i) >= F.col("__turn")), "")
    new = F.when(F.array_min("__times") >= F.col("__turn"), F.col(text)).otherwise(chosen)
    return taken.select(*((new if n == text else F.col(n)).alias(c) for n, c in zip(names, docs.columns)))


def _named(docs: DataFrame, *columns: str) -> list[Column]:
    """Of columns renamed by number, the given ones, null texts as empty."""
    at = [F.col(f"__{docs.columns.index(c)}") for c in columns]
    return [whole(c) if name == "text" else c for name, c in zip(columns, at)]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), Staging(spark)).drop("source")
