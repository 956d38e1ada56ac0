"""Periodic runs of words: maximal stretches that repeat their smallest period several times.

How far two places of a word sequence agree is answered by a difference cover: of every 16 suffixes only the 7 at places
of the cover are sorted. From any two places both reach sampled ones after the same few words, which are
compared one by one; the rest is a range minimum over the sorted samples' common prefixes (sparse table).
A period is tried only at places a few periods apart, so all periods of n words take about n log n places. Texts none of
whose places can lie in a run are not indexed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm.common import documents, in_batches, portions, whole
from fairlead.llm.mixing import WORD

#: Places of the grid that are looked at together.
_BLOCK = 1 << 20


@dataclass(frozen=True)
class RunRules:
    """A run has at least ``least`` words and ``exponent`` times its period. The cover has ``side`` squared residues."""

    exponent: int = 4
    least: int = 6
    side: int = 4

    def __post_init__(self) -> None:
        if self.exponent < 2 or self.least < 1 or self.side < 2:
            raise ValueError("exponent and side must be at least 2, least at least 1")


class Agreement:
    """``(i, j)`` -> how many words from place i on equal those from place j on, for arrays of different places.

    No word may agree beyond the end of its text: each text ends with a word that occurs once.
    """

    def __init__(self, words: np.ndarray, side: int = RunRules.side) -> None:
        self.cycle, n = side * side, len(words)
        residues = np.arange(self.cycle)
        # Every difference modulo side**2 is a multiple of side less a number below side.
        cover = (residues < side) | (residues % side == 0)
        self.slot, self.sampled = np.cumsum(cover) - 1, int(cover.sum())
        steps = np.arange(self.cycle)
        met = cover[(residues[:, None, None] + steps) % self.cycle] & cover[(residues[None, :, None] + steps) % self.cycle]
        self.gap = met.argmax(axis=2)
        top = int(words.max(initial=0)) + 1
        self.words = np.concatenate([words.astype(np.int64), np.arange(top, top + self.cycle)])
        places = np.arange(n)
        self.samples = places[cover[places % self.cycle]]
        self._sort()

    def _sort(self) -> None:
        """``rank`` of each sampled suffix, and the sparse table of the common prefixes of neighbours in this order."""
        m, cycle = len(self.samples), self.cycle
        order, rank, tied = np.arange(m), np.zeros(m, np.int64), np.arange(m)

        def refine(key: np.ndarray) -> None:
            """Sorts the tied suffixes, which have the slots ``tied``, by one more key."""
            nonlocal tied
            members = order[tied]
            members = members[np.lexsort((key[members], rank[members]))]
            order[tied] = members
            fresh = np.ones(len(members), bool)
            fresh[1:] = (np.diff(rank[members]) != 0) | (np.diff(key[members]) != 0)
            rank[members] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(members)), 0))]
            last = np.append(fresh[1:], True)
            tied = tied[~(fresh & last)]

        bits = max(int(self.words.max(initial=0)).bit_length(), 1)
        together = max(62 // bits, 1)
        for first in range(0, cycle, together):
            if len(tied):
                key = np.zeros(m, np.int64)
                members = order[tied]
                for step in range(first, min(first + together, cycle)):
                    key[members] = key[members] << bits | self.words[self.samples[members] + step]
                refine(key)
        # A place one cycle on is a sample, too; equal ranks of a level mean equal first words, twice as many each level.
        levels, length = [], 1
        while len(tied):
            levels.append(rank.copy())
            key = np.zeros(m, np.int64)
            members = order[tied]
            key[members] = levels[-1][members + length * self.sampled]
            refine(key)
            length *= 2
        self.rank = rank
        one, two = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(m - 1, 0), np.int64)
        for level in reversed(range(len(levels))):
            same = levels[level][one] == levels[level][two]
            common[same] += cycle << level
            one[same] += self.sampled << level
            two[same] += self.sampled << level
        live = np.arange(len(common))
        for step in range(cycle):
            live = live[self.words[self.samples[one[live]] + step] == self.words[self.samples[two[live]] + step]]
            common[live] += 1
        self.table = [common.astype(np.int32 if len(self.words) < 1 << 31 else np.int64)]
        while (1 << len(self.table)) <= len(common):
            half, row = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(row[:-half], row[half:]))

    def _least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least common prefix of neighbours from slot ``low`` up to before ``high``."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            found[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << int(k))])
        return found

    def _sample(self, place: np.ndarray) -> np.ndarray:
        return place // self.cycle * self.sampled + self.slot[place % self.cycle]

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        gap = self.gap[i % self.cycle, j % self.cycle]
        agreed, live = np.zeros(len(i), np.int64), np.arange(len(i))
        while len(live):
            live = live[agreed[live] < gap[live]]
            live = live[self.words[i[live] + agreed[live]] == self.words[j[live] + agreed[live]]]
            agreed[live] += 1
        on = np.flatnonzero(agreed == gap)
        one, two = (self.rank[self._sample(x[on] + gap[on])] for x in (i, j))
        agreed[on] += self._least(np.minimum(one, two), np.maximum(one, two))
        return agreed


Places = tuple[np.ndarray, np.ndarray, np.ndarray]


def grid_places(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray, rules: RunRules) -> Iterator[Places]:
    """(text, period, place): places of the grid whose neighbours a period away let them lie in a run, in blocks.

    The places of period p are ``(exponent - 1) * p`` words apart. A run reaches over at least one of them, with
    ``exponent - 1`` places in a row, each a period on, at which the word comes again a period later.
    """
    periods = np.where(sizes >= rules.least, sizes // rules.exponent, 0)
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    stride = (rules.exponent - 1) * period
    places = (sizes[text] - period - 1) // stride + 1
    ends = np.cumsum(places)
    low = 0
    while low < len(text):
        before = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + _BLOCK, "right")))
        pair = np.repeat(np.arange(low, high), places[low:high])
        nth = np.arange(len(pair)) - (ends[pair] - places[pair] - before)
        at = begins[text[pair]] + nth * stride[pair]
        hit = np.flatnonzero(words[at] == words[at + period[pair]])
        pair, at = pair[hit], at[hit]
        found, step = text[pair], period[pair]
        first, last = begins[found], begins[found] + sizes[found] - step
        reach = np.ones(len(at), np.int64)
        for direction in (-1, 1):
            going = np.arange(len(at))
            for times in range(1, rules.exponent - 1):
                place = at[going] + direction * times * step[going]
                inside = (place >= first[going]) & (place < last[going])
                going, place = going[inside], place[inside]
                going = going[words[place] == words[place + step[going]]]
                reach[going] += 1
        near = reach >= rules.exponent - 1
        yield found[near], step[near], at[near]
        low = high


def _in_one_row(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words one after the other, each text followed by a word of its own, and where each begins and its size."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    words = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    for t, begin in zip(texts, begins.tolist(), strict=True):
        words[begin : begin + len(t)] = t
    words[begins + sizes] = int(words.max(initial=0)) + 1 + np.arange(len(texts))
    return words, begins, sizes


def find_runs(texts: list[np.ndarray], rules: RunRules = RunRules()) -> np.ndarray:
    """The runs of texts given as numbers of words: rows (text, start, length, period), sorted."""
    words, begins, sizes = _in_one_row(texts)
    chosen = np.zeros(len(texts), bool)
    for found, _, _ in grid_places(words, begins, sizes, rules):
        chosen[found] = True
    names, rows = np.flatnonzero(chosen), [np.zeros((0, 4), np.int64)]
    if len(names):
        words, begins, sizes = _in_one_row([texts[t] for t in names.tolist()])
        agree = Agreement(words, rules.side)
        for found, period, at in grid_places(words, begins, sizes, rules):
            stride = (rules.exponent - 1) * period
            # A run that reaches back to the place before on the grid is found from there.
            before = np.flatnonzero(at - stride >= begins[found])
            known = before[agree(at[before] - stride[before], at[before] - stride[before] + period[before]) >= stride[before]]
            new = np.ones(len(at), bool)
            new[known] = False
            found, period, at, stride = found[new], period[new], at[new], stride[new]
            # The least start from which on all agree: by halving, as agreement holds from every later start.
            least, most = np.zeros(len(at), np.int64), np.minimum(stride, at - begins[found])
            while (open_ := np.flatnonzero(least < most)).size:
                middle = (least[open_] + most[open_] + 1) // 2
                start = at[open_] - middle
                holds = agree(start, start + period[open_]) >= middle
                least[open_] = np.where(holds, middle, least[open_])
                most[open_] = np.where(holds, most[open_], middle - 1)
            length = least + period + agree(at, at + period)
            long = length >= np.maximum(rules.least, rules.exponent * period)
            rows.append(np.stack([names[found], at - least - begins[found], length, period], axis=1)[long])
    runs = np.concatenate(rows)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    # Multiples of the smallest period give the same stretch.
    first = np.ones(len(runs), bool)
    first[1:] = (np.diff(runs[:, :3], axis=0) != 0).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


RUN_SCHEMA = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, rules: RunRules = RunRules()) -> DataFrame:
    """Per row: doc_id, ``runs`` (start, length, period in words, by start, then period) and ``collapsed``.

    Words are runs of anything but space and tab to carriage return, compared byte by byte. A run is maximal, has its smallest
    period, and keeps ``RunRules``. ``collapsed`` is the text's words joined by one space, without those that a run
    holds after its first period. Null and empty texts have no runs and an empty ``collapsed``. Each row is looked at by
    itself: repeated rows give repeated results, other columns are not read, an empty table gives an
    empty result. Nothing is shuffled; a very long text takes memory in proportion to its words.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            split = [t.split() for t in batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()]
            known: dict[bytes, int] = defaultdict(count().__next__)
            numbers = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in split]
            runs = find_runs(numbers, rules)
            offsets = np.searchsorted(runs[:, 0], np.arange(len(split) + 1)).astype(np.int32)
            collapsed = []
            for words, low, high in zip(split, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if high > low:
                    begins, lengths, periods = runs[low:high, 1:].T
                    changes = np.zeros(len(words) + 1, np.int64)
                    np.add.at(changes, begins + periods, 1)
                    np.add.at(changes, begins + lengths, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(changes[:-1]) == 0).tolist()]
                collapsed.append(b" ".join(words))
            parts = [pa.array(np.ascontiguousarray(runs[:, k]), pa.int64()) for k in (1, 2, 3)]
            listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
            columns = [batch.column("doc_id"), listed, pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "collapsed"])

    return in_batches(docs.select("doc_id", "text"), rows, f"doc_id long, runs {RUN_SCHEMA}, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; in about every tenth text the words from some place on repeat those at that place.

    With h the CRC-32 of the decimal doc_id, g = h div 10 and n words: if h % 10 = 0 and n > 0, word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) div (3 + g % 8). Rows without doc_id stay as they are.
    """
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(whole(), F.lit(WORD), F.lit(0))

    def repeated(state: Column) -> Column:
        n, g = F.size(state["words"]).cast("long"), state["g"]
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        taken = F.transform(places, lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.array_join(F.transform(taken, lambda i: F.get(state["words"], i.cast("int"))), " ")

    states = F.array(F.struct(words.alias("words"), F.floor(F.col("__check") / 10).alias("g")))
    nonempty = F.regexp_like(whole(), F.lit(WORD))
    changed = F.when((F.col("__check") % 10 == 0) & nonempty, F.element_at(F.transform(states, repeated), 1))
    return docs.select("doc_id", "text", check.alias("__check")).select("doc_id", F.coalesce(changed, "text").alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of the whole table's texts with planted periods, as digests."""
    found = periodic_runs(with_planted_periods(documents(spark, sf_dir)))
    # The greatest: longest, then earliest, then of the smallest period.
    best = F.array_max(
        F.transform(
            "runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))
        )
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["start"]).alias("start"),
        best["length"].alias("length"),
        (-best["period"]).alias("period"),
        F.floor(1000 * best["length"] / -best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
