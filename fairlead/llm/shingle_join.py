"""Documents whose sets of word shingles have a Jaccard similarity of at least a limit, by parity sketches.

A set is cut by hash into parts, and each part's sketch is the XOR of its shingles' hashes. One shingle in
only one of two sets changes one part, so sets with at most d differences agree in a part if there are
d + 1 of them (pigeonhole). A few more parts make it possible to leave out those that say little, see ``part_keys``. Sizes of similar sets are close: sets are joined within a size band and with the next. A second
sketch of single bits, whose Hamming distance is at most the number of differences, discards candidates; the rest
are verified on the whole sets. Rows with equal sets are one class throughout, and copies are never paired.

Links are looked for in rounds. The first pairs each class with one of its bucket. Then only classes that aren't yet
connected are paired, all with all in small buckets, and in large ones block by block inside tasks that return pairs whose
sketches are close: first just enough to connect them, at last all. What is not connected after that shares no link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.llm.common import documents, in_batches, may_hold, portions, row_filter, salted, ship, spread, whole
from fairlead.llm.mixing import WORD
from fairlead.llm.words import scramble, shingles, word_hashes
from fairlead.sources.tables import Staging

#: 64-bit words of the bit sketch: the least, and the most that are sent for each row of a bucket.
SKETCH_WORDS, SKETCH_MOST = 16, 1024


@dataclass(frozen=True)
class JoinRules:
    """Sets of ``width``-word shingles are linked if ``100 * common >= percent * all``.

    Buckets with more than ``small`` classes are compared in blocks of about ``block`` classes.
    """

    width: int = 5
    percent: int = 80
    small: int = 32
    block: int = 2048

    def differences(self, size: int) -> int:
        """The most differences of linked sets, of which the smaller has at most ``size`` shingles."""
        larger = size * 100 // self.percent
        return (100 - self.percent) * (size + larger) // (100 + self.percent)

    def bands(self, most: int) -> list[tuple[int, int]]:
        """(largest size, parts) of each size band, up to the one that holds ``most``.

        There are some more parts than differences: so many that linked sets agree in ``spare`` parts or more.
        """
        found, low = [], 1
        while low <= most:
            high = low * 100 // self.percent
            differences = self.differences(high)
            found.append((high, differences + self.spare(differences)))
            low = high + 1
        return found

    def spare(self, differences: int) -> int:
        return 1 + differences // 12


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _name(values: np.ndarray) -> np.uint64:
    """A set's 64-bit name, from the XOR and the sum of its shingles; equal sets have equal names."""
    total = scramble(values).sum(dtype=np.uint64, keepdims=True)
    return scramble(np.bitwise_xor.reduce(values) ^ scramble(total + np.uint64(len(values))))[0]


def _sketch(values: np.ndarray, words: int = SKETCH_WORDS) -> np.ndarray:
    """Bit i is the parity of the shingles whose hash ends in i."""
    bits = np.bincount((values & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _wide_words(size: int) -> int:
    """Words of a sketch with four to eight bits for each shingle, a power of two."""
    return max(SKETCH_WORDS, 1 << (size // 16).bit_length())


def _short_words(size: int) -> int:
    """Words of a sketch with at least a bit for each shingle, a power of two. With fewer bits unrelated sets look as close as linked ones."""
    return min(max(SKETCH_WORDS, 1 << (max(size - 1, 0) // 64).bit_length()), SKETCH_MOST)


def _folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set with fewer words."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _apart(one: np.ndarray, other: np.ndarray) -> int:
    """Bits in which two sketches differ, the longer one folded to the length of the other."""
    short = min(len(one), len(other))
    return int(np.bitwise_count(_folded(one, short) ^ _folded(other, short)).sum())


def shapes(docs: DataFrame, rules: JoinRules) -> DataFrame:
    """Per row: doc_id, text_hash, size of its set, and the set's name c (null if it is empty)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(whole()).alias("text_hash"))

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            sets = shingles(*word_hashes(batch.column("text")), rules.width)
            size, names = zip(*((len(v), _name(v).view(np.int64) if len(v) else None) for v in sets), strict=True)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(size, pa.int64()), pa.array(names, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "size", "c"])

    return in_batches(rows, shaped, "doc_id long, text_hash long, size long, c long")


def part_keys(docs: DataFrame, rules: JoinRules) -> DataFrame:
    """(key, c) for each part of each set, in its own size band's cut and in the next smaller band's.

    A task emits each set once; how many parts there are grows with the set. Parts with less than two shingles are weak: many unrelated sets
    agree in them. Linked sets agree in ``spare`` parts, and what is weak in one is so in the other; so a set with fewer weak
    parts than that does without them, and any other emits all.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in portions(batches):
            words, bounds = word_hashes(batch.column("text"))
            bands = rules.bands(max(int(np.diff(bounds).max(initial=0)), 1))
            tops = np.array([top for top, _ in bands])
            keys, names = [], []
            for values in shingles(words, bounds, rules.width):
                if not len(values):
                    continue
                name = int(_name(values))
                if name in seen:
                    continue
                seen.add(name)
                own = int(np.searchsorted(tops, len(values)))
                content, high = scramble(values), values >> np.uint64(32)
                for band in (own, own - 1):
                    if band < 0 or not rules.differences(bands[band][0]):
                        continue  # only equal sets are linked
                    parts = bands[band][1]
                    part = (high * np.uint64(parts)) >> np.uint64(32)  # sorted, as the values are
                    starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
                    sketch = np.zeros(parts, np.uint64)
                    sketch[part[starts].astype(np.int64)] = np.bitwise_xor.reduceat(content, starts)
                    place = np.arange(parts, dtype=np.uint64) + np.uint64(band << 40)
                    held = np.bincount(part.astype(np.int64), minlength=parts)
                    strong = held > 1
                    if parts - int(strong.sum()) >= rules.spare(rules.differences(bands[band][0])):
                        strong[:] = True
                    keys.append(scramble(sketch ^ scramble(place + np.uint64(1)))[strong])
                    names.append(np.full(len(keys[-1]), name, np.uint64))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(keys)), _signed(np.concatenate(names))], ["key", "c"]
                )

    return in_batches(docs.select("text"), keyed, "key long, c long")


def _per_class(docs: DataFrame, wanted: DataFrame, rules: JoinRules, read: Callable[[np.ndarray], tuple], kinds: dict[str, tuple[pa.DataType, str]]) -> DataFrame:
    """c and what ``read`` makes of a set (columns ``kinds``), for the sets whose texts have the hashes ``wanted`` (text_hash), and maybe for others."""
    rows = docs.select("text", F.xxhash64(whole()).alias("text_hash"))
    rows = may_hold(rows, "text_hash", row_filter(wanted, "text_hash"))
    arrow = [pa.int64(), *(kind for kind, _ in kinds.values())]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in portions(batches):
            found = []
            for values in shingles(*word_hashes(batch.column("text")), rules.width):
                name = int(_name(values).view(np.int64)) if len(values) else None
                if name is not None and name not in seen:
                    seen.add(name)
                    found.append((name, *read(values)))
            if found:
                columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["c", *kinds])

    schema = ", ".join(["c long", *(f"{n} {kind}" for n, (_, kind) in kinds.items())])
    sets = in_batches(rows.select("text"), made, schema)
    return sets.groupBy("c").agg(*(F.first(n).alias(n) for n in kinds))


def class_looks(docs: DataFrame, wanted: DataFrame, rules: JoinRules) -> DataFrame:
    """c, size, sketch (a bit or two for each shingle) and wide (about a byte for each shingle at most)."""
    kinds = {"size": (pa.int64(), "long"), "sketch": (pa.binary(), "binary"), "wide": (pa.binary(), "binary")}
    read = lambda v: (len(v), *(_sketch(v, words(len(v))).tobytes() for words in (_short_words, _wide_words)))
    return _per_class(docs, wanted, rules, read, kinds)


def class_items(docs: DataFrame, wanted: DataFrame, rules: JoinRules) -> DataFrame:
    """c and items (the sorted shingles, eight bytes each)."""
    return _per_class(docs, wanted, rules, lambda v: (v.tobytes(),), {"items": (pa.binary(), "binary")})


def close_in_sketch(pairs: DataFrame, looks: DataFrame, rules: JoinRules) -> DataFrame:
    """The pairs (x, y) whose sizes and sketches allow a link, and how many bits their wide sketches are apart.

    Wide sketches are sent only for pairs whose short ones allow a link.
    """
    for kind in ("sketch", "wide"):
        pairs = _close_in(kind, pairs.select("x", "y"), looks, rules)
    return pairs


def _close_in(kind: str, pairs: DataFrame, looks: DataFrame, rules: JoinRules) -> DataFrame:
    p = rules.percent
    for side in ("x", "y"):
        shape = looks.select(F.col("c").alias(side), F.col("size").alias(f"size_{side}"), F.col(kind).alias(f"look_{side}"))
        pairs = pairs.join(shape, side)
        if side == "y":
            pairs = pairs.filter(F.least("size_x", "size_y") * 100 >= F.greatest("size_x", "size_y") * p)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("size_x").to_numpy() + batch.column("size_y").to_numpy()
            seen = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(f"look_{side}")] for side in "xy")
            apart = np.array([_apart(one, other) for one, other in zip(*seen, strict=True)], np.int64)
            near_enough = pa.array(apart * (100 + p) <= total * (100 - p))
            columns = [c.filter(near_enough) for c in (batch.column("x"), batch.column("y"), pa.array(apart))]
            yield pa.RecordBatch.from_arrays(columns, ["x", "y", "apart"])

    columns = ("x", "y", "size_x", "size_y", "look_x", "look_y")
    return in_batches(pairs.select(*columns), near, "x long, y long, apart long")


def linked_pairs(close: DataFrame, sets: DataFrame, rules: JoinRules) -> DataFrame:
    """The pairs (x, y) that are linked, by their whole sets."""
    p = rules.percent
    for side in ("y", "x"):
        close = close.join(sets.select(F.col("c").alias(side), F.col("items").alias(f"items_{side}")), side)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column("items_x"), batch.column("items_y"), strict=True):
                one, other = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, other))
                at = np.minimum(np.searchsorted(other, one), len(other) - 1)
                common = int((other[at] == one).sum())
                keep.append(100 * common >= p * (len(one) + len(other) - common))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("x"), kept.column("y")], ["x", "y"])

    return in_batches(close.select("x", "y", "items_x", "items_y"), linked, "x long, y long")


def close_pairs(rows: DataFrame, rules: JoinRules, all_of_them: bool) -> DataFrame:
    """Pairs (x, y) of large buckets with close sketches and different roots.

    ``rows``: key, c, root, members, size, sketch. A bucket is cut into blocks by hash and each two blocks meet in one task.
    Unless ``all_of_them``, a task returns only pairs that connect roots it has not connected yet.
    """
    blocks = F.ceil(F.col("members") / rules.block).cast("long")
    own = F.pmod(F.xxhash64("c"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", other)
    met = met.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    def near(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("c")
        names, roots, sizes = (group[n].to_numpy() for n in ("c", "root", "size"))
        sketches = [np.frombuffer(v, np.uint64) for v in group["sketch"]]
        length = np.array([len(s) for s in sketches])
        # For each length, the sketches at least as long, folded to it, and each row's place among them.
        folded = {n: (np.cumsum(length >= n) - 1, np.stack([_folded(s, n) for s in sketches if len(s) >= n])) for n in np.unique(length).tolist()}
        within = group["low"].iloc[0] == group["high"].iloc[0]
        side = group["own"].to_numpy()
        found: list[tuple[int, int, int]] = []
        for i in range(len(group)):
            others = np.arange(i + 1, len(group)) if within else np.flatnonzero(side != side[i]) if side[i] == group["low"].iloc[0] else []
            others = np.asarray(others, np.int64)
            others = others[roots[others] != roots[i]]
            others = others[np.minimum(sizes[others], sizes[i]) * 100 >= np.maximum(sizes[others], sizes[i]) * rules.percent]
            apart, shorter = np.zeros(len(others), np.int64), np.minimum(length[others], length[i])
            for n in np.unique(shorter).tolist():
                place, table = folded[n]
                at = np.flatnonzero(shorter == n)
                apart[at] = np.bitwise_count(table[place[others[at]]] ^ table[place[i]]).sum(axis=1, dtype=np.int64)
            total = sizes[others] + sizes[i]
            close = apart * (100 + rules.percent) <= total * (100 - rules.percent)
            found.extend(zip(apart[close].tolist(), [i] * int(close.sum()), others[close].tolist(), strict=True))
        if not all_of_them:
            # One order of pairs for all buckets: they then mostly choose the same ones.
            found = _forest(sorted(found, key=lambda p: (p[0], *sorted((names[p[1]], names[p[2]])))), roots)
        pairs = [(min(names[i], names[j]), max(names[i], names[j])) for _, i, j in found]
        return pd.DataFrame(pairs, columns=["x", "y"], dtype="int64")

    ship(rows.sparkSession.sparkContext)
    return met.groupBy("key", "low", "high").applyInPandas(near, "x long, y long").distinct()


def _forest(pairs: list[tuple[int, int, int]], roots: np.ndarray) -> list[tuple[int, int, int]]:
    """The first pairs that connect the roots as far as all of them do."""
    above = {r: r for r in roots.tolist()}

    def top(r: int) -> int:
        while above[r] != r:
            above[r] = above[above[r]]
            r = above[r]
        return r

    kept = []
    for pair in pairs:
        one, other = top(int(roots[pair[1]])), top(int(roots[pair[2]]))
        if one != other:
            above[one] = other
            kept.append(pair)
    return kept


def components(links: DataFrame, staging: Staging, name: str) -> DataFrame:
    """c and root (the smallest name reachable) of each name in ``links`` (x, y).

    Each round takes the smallest root among neighbours, then the root's root, so chains shorten fast. Every
    round is written, and a lost executor costs only its tasks.
    """
    both = links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    edges = staging.keep(both, f"{name}_edges")
    labels = staging.keep(
        edges.groupBy(F.col("x").alias("c")).agg(F.least(F.min("y"), F.first("x")).alias("root")), f"{name}_0"
    )
    turn = 0
    while True:
        turn += 1
        heard = (
            edges.join(labels.select(F.col("c").alias("y"), "root"), "y")
            .groupBy(F.col("x").alias("c"))
            .agg(F.min("root").alias("heard"))
        )
        nearer = labels.join(heard, "c").select("c", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        jump = labels.select(F.col("c").alias("root"), F.col("root").alias("next"))
        following = nearer.join(jump, "root").select("c", "old", F.least("root", "next").alias("root"))
        labels = staging.keep(following, f"{name}_{turn}")
        if labels.filter("old <> root").isEmpty():
            return labels.select("c", "root")
        labels = labels.select("c", "root")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, c, root and the number of members, of those buckets whose classes aren't all connected; each class once.

    A class with copies in several tasks has come in from each of them.
    """
    known = members.select("key", "c").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    bucket = Window.partitionBy("key")
    again = F.col("c").eqNullSafe(F.lag("c").over(bucket.orderBy("c")))
    known = known.withColumn("again", again).filter("not again").drop("again")
    apart = F.min("root").over(bucket) != F.max("root").over(bucket)
    counted = known.withColumn("apart", apart).withColumn("members", F.count(F.lit(1)).over(bucket))
    return counted.filter("apart").drop("apart")


@dataclass(frozen=True)
class Classes:
    """The documents, a text_hash for each class c (``texts``), and ``class_looks`` of those that share a bucket with others (``looks``)."""

    docs: DataFrame
    texts: DataFrame
    looks: DataFrame

    @contextmanager
    def whole_sets(self, pairs: DataFrame, staging: Staging, rules: JoinRules, name: str) -> Iterator[DataFrame]:
        """``class_items`` of the classes in ``pairs`` (x, y), read off the texts again; they are deleted at the end.

        Most classes that share a bucket are far apart by their sketches, which have an eighth of the size. Inside, results must be stored.
        """
        apart = Staging(staging.spark, f"{staging.folder}/items_{name}")
        both = pairs.select(F.col("x").alias("c")).unionByName(pairs.select(F.col("y").alias("c"))).distinct()
        wanted = self.texts.join(both, "c", "left_semi").select("text_hash")
        yield apart.keep(class_items(self.docs, wanted, rules), "items")
        apart.remove()


def set_links(docs: DataFrame, shape: DataFrame, staging: Staging, rules: JoinRules) -> DataFrame:
    """c and root of the classes that are linked with another; what the module's head describes."""
    bucket = Window.partitionBy("key")
    members = staging.keep(
        part_keys(docs, rules)
        .select(
            "key", "c",
            F.min("c").over(bucket).alias("lead"),
            F.max("c").over(bucket).alias("last"),
        )
        .filter("lead <> last")
        .drop("last"),
        "members",
    )
    stars = staging.keep(
        members.filter("c <> lead").select(F.col("lead").alias("x"), F.col("c").alias("y")).distinct(), "stars"
    )
    texts = staging.keep(shape.groupBy("c").agg(F.min("text_hash").alias("text_hash")), "texts")
    wanted = texts.join(members.select("c").distinct(), "c", "left_semi").select("text_hash")
    looks = staging.keep(class_looks(docs, wanted, rules), "looks")
    classes = Classes(docs, texts, looks)
    close = staging.keep(close_in_sketch(stars, looks, rules), "close_1")
    with classes.whole_sets(close, staging, rules, "1") as sets:
        links = staging.keep(linked_pairs(close, sets, rules), "links_1")

    left = staging.keep(_rooted(members, components(links, staging, "roots_1")), "left_1")
    small = left.filter(F.col("members") <= rules.small)
    pairs = (
        small.select("key", F.col("c").alias("x"), F.col("root").alias("root_x"))
        .join(small.select("key", F.col("c").alias("y"), F.col("root").alias("root_y")), "key")
        .filter("x < y and root_x <> root_y")
        .select("x", "y")
        .distinct()
    )
    large = left.filter(F.col("members") > rules.small)
    short = looks.select("c", "size", "sketch")
    connecting = close_pairs(large.join(short, "c"), rules, all_of_them=False)
    # Stored, so that the shuffles of the buckets are gone when the sketches of pairs are sent.
    pairs = staging.keep(pairs.unionByName(connecting).distinct().join(stars, ["x", "y"], "left_anti"), "pairs_2")
    links = _more_links(links, pairs, classes, staging, rules, "2")
    roots = components(links, staging, "roots_2")

    large = staging.keep(_rooted(large, roots), "left_2")
    if large.isEmpty():
        return roots
    rest = staging.keep(close_pairs(large.join(short, "c"), rules, all_of_them=True), "pairs_3")
    return components(_more_links(links, rest, classes, staging, rules, "3"), staging, "roots_3")


def _more_links(links: DataFrame, pairs: DataFrame, classes: Classes, staging: Staging, rules: JoinRules, name: str) -> DataFrame:
    """``links`` and enough of those among ``pairs`` to connect the same classes as all of them would.

    Whole sets are sent only where they can matter: first for the closest pairs of each class, then for the pairs that these have not connected.
    """
    close = close_in_sketch(pairs, classes.looks, rules)
    places = (F.row_number().over(Window.partitionBy(side).orderBy("apart", "x", "y")) for side in ("x", "y"))
    close = staging.keep(close.withColumn("first", F.least(*places) <= 2), f"close_{name}")
    with classes.whole_sets(close, staging, rules, name) as sets:
        best = linked_pairs(close.filter("first").select("x", "y"), sets, rules)
        links = staging.keep(links.unionByName(best), f"links_{name}a")
        roots = components(links, staging, f"roots_{name}a")
        rest = close.filter("not first").select("x", "y")
        for side in ("x", "y"):
            top = roots.select(F.col("c").alias(side), F.col("root").alias(f"root_{side}"))
            rest = rest.join(top, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
        rest = staging.keep(rest.filter("root_x <> root_y").select("x", "y"), f"rest_{name}")
        return staging.keep(links.unionByName(linked_pairs(rest, sets, rules)), f"links_{name}")


def similar_documents(docs: DataFrame, staging: Staging, rules: JoinRules = JoinRules()) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included), text_hash, and group.

    The group is a number that linked rows share, null for a row that is linked with none.

    Rows with equal sets are linked. A row without words, also of null text, has no shingles and its own doc_id. Null doc_ids
    take part, and are never the smallest unless all are null. Rows of one doc_id with several texts may lie
    in several components. Other columns are not read. An empty table gives an empty result.
    """
    shape = staging.keep(shapes(docs, rules), "shapes")
    filled = shape.filter("c is not null")
    roots = set_links(docs, filled, staging, rules)
    classes = filled.groupBy("c").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    rooted = staging.keep(
        classes.join(roots, "c", "left").filter("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "c")),
        "rooted",
    )
    firsts = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    answer = staging.keep(rooted.join(firsts, "root").select("c", "component_id", "root"), "answer")
    joined = salted(shape, F.struct("doc_id", "text_hash")).join(spread(answer), ["c", "__salt"], "left")
    return joined.select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "text_hash",
        F.col("root").alias("group"),
    )


def one_of_each_group(docs: DataFrame, staging: Staging, rules: JoinRules = JoinRules()) -> DataFrame:
    """The rows of ``docs`` without those linked to a row that stays: of each group, one row of the smallest doc_id stays.

    Rows without words stay. Rows whose doc_id and text are equal are told apart only in number.
    """
    found = staging.keep(similar_documents(docs, staging, rules).filter("group is not null"), "groups")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    keepers = found.groupBy("group").agg(F.min(key).alias("key")).select("key.*")
    rows = found.select(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").distinct()
    same = ["none", "id", "text_hash"]
    named = lambda df: df.select("none", F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")
    losers = staging.keep(named(rows).join(named(keepers), same, "left_anti"), "losers")
    ours = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.xxhash64(whole())]
    names = [f"__{i}" for i in range(len(docs.columns))]
    marked = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), *(o.alias(n) for o, n in zip(ours, same, strict=True)))
    kept = marked.join(losers, same, "left_anti")
    text = names[docs.columns.index("text")]
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(names[0]))
    empty = ~F.coalesce(F.col(text), F.lit("")).rlike(WORD)
    return kept.withColumn("nth", nth).filter((F.col("nth") == 1) | empty).select(
        *(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True))
    )


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_documents(documents(spark, sf_dir), Staging(spark), JoinRules(width=4, percent=85))
    return found.drop("text_hash", "group")
