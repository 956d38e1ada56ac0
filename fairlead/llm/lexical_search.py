"""Ranked lexical search by hashed max-sketches.

Each document has an index row: its terms with their counts, and a sketch of as many small numbers as suit its terms. A term's
impact is folded into two hashed coordinates, each of which keeps the greatest impact it meets. The lesser of a term's two
coordinates is never below its impact, so a batch of items is looked up in the sketches for upper bounds of
all scores. Documents are then scored exactly in order of falling bounds, until the next bound is below the items' tenth score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.llm.common import documents, in_batches, numbered, portions, whole
from fairlead.llm.words import PUNCTUATION, word_hashes
from fairlead.sources.tables import Staging

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: An impact is below this number; sketches keep it in steps of a 255th, rounded up.
_MOST, _STEPS = 1_000_000, 255


@dataclass(frozen=True)
class SearchRules:
    """``top`` documents per item. A sketch has ``width`` coordinates per distinct term, up to a power of two.

    Items are looked up together in blocks of about ``block_terms`` terms; every block meets every document.
    """

    top: int = 10
    width: int = 8
    block_terms: int = 1 << 16


def impacts(counts: np.ndarray, sizes: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The part of a term in a document's score, before its weight: grows with its count, falls with the document's size."""
    length = 10 + 90 * sizes * documents // max(terms, 1)
    return 1_000_000_000 * counts // (1000 * counts + 8 * length)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def distinct_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(size of each text in terms, its number of distinct terms, and for all texts in turn those terms, sorted, and their counts)."""
    hashes, bounds = word_hashes(column, PUNCTUATION)
    sizes = np.diff(bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((hashes, text))
    hashes = hashes[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(hashes)))
    return sizes, np.bincount(text[at], minlength=len(sizes)), hashes[at], counts


def coordinates(terms: np.ndarray, width: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A term's two places in a sketch of ``width`` (a power of two) coordinates."""
    last = np.asarray(width).astype(np.uint64) - np.uint64(1)
    return (terms & last).astype(np.int64), (terms >> np.uint64(32) & last).astype(np.int64)


def sketch_index(docs: DataFrame, holding: int, terms: int, rules: SearchRules = SearchRules()) -> DataFrame:
    """Per row with a term: doc_id, size, sketch, terms, counts (arrays as bytes). ``holding`` documents have ``terms`` terms."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            sizes, distinct, found, counts = distinct_terms(batch.column("text"))
            text = np.repeat(np.arange(len(sizes)), distinct)
            level = -(-impacts(counts, sizes[text], holding, terms) * _STEPS // _MOST)
            widths = 1 << np.ceil(np.log2(np.maximum(distinct * rules.width, 64))).astype(np.int64)
            begins = np.cumsum(widths) - widths
            sketches = np.zeros(int(widths.sum()), np.uint8)
            for place in coordinates(found, widths[text]):
                np.maximum.at(sketches, begins[text] + place, level.astype(np.uint8))
            ends = np.cumsum(distinct)
            held = np.flatnonzero(sizes).tolist()
            columns = [
                batch.column("doc_id").take(pa.array(held, pa.int64())),
                pa.array(sizes[held], pa.int64()),
                pa.array([sketches[begins[k] : begins[k] + widths[k]].tobytes() for k in held], pa.binary()),
                pa.array([found[ends[k] - distinct[k] : ends[k]].tobytes() for k in held], pa.binary()),
                pa.array([counts[ends[k] - distinct[k] : ends[k]].astype(np.uint32).tobytes() for k in held], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "sketch", "terms", "counts"])

    return in_batches(docs.select("doc_id", "text"), rows, "doc_id long, size long, sketch binary, terms binary, counts binary")


def item_blocks(items: DataFrame, staging: Staging, rules: SearchRules) -> DataFrame:
    """Per item with a term: row, item_id, terms, and the block of items it is looked up with."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            _, distinct, found, _ = distinct_terms(batch.column("text"))
            parts = np.split(found, np.cumsum(distinct)[:-1])
            columns = [
                batch.column("item_id"),
                pa.array([p.tobytes() for p in parts], pa.binary()),
                pa.array(distinct, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "terms", "n"])

    termed = in_batches(items.select("item_id", "text"), rows, "item_id long, terms binary, n long").filter("n > 0")
    termed = staging.keep(termed.withColumn("row", F.monotonically_increasing_id()), "items")
    return numbered(termed, [F.col("row")], staging, "items_in_order", ["n"]).select(
        "row", "item_id", "terms", F.expr(f"n_before div {rules.block_terms}").alias("block")
    )


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of a binary column in one, and where each begins (and the last ends)."""
    parts = [np.frombuffer(v.as_buffer(), kind) for v in column]
    return np.concatenate([np.zeros(0, kind), *parts]), np.cumsum([0, *map(len, parts)])


def _held_by(index: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """In how many documents each term of a block of items occurs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(vocabulary), np.int64)
        for batch in portions(batches, "terms"):
            found, _ = _flat(batch.column("terms"), np.uint64)
            at = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
            held += np.bincount(at[vocabulary[at] == found], minlength=len(vocabulary))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], ["term", "held"])

    # As many rows as the block has terms.
    counted = in_batches(index.select("terms"), rows, "term long, held long").groupBy("term").agg(F.sum("held").alias("held"))
    return {r.term: r.held for r in counted.collect()}


@dataclass
class Item:
    """One item: its terms' places in the block's vocabulary, their weights, and the best documents so far."""

    row: int
    item_id: int | None
    terms: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        self.best: list[tuple[int, bool, int]] = []


def _levels(batch: pa.RecordBatch, vocabulary: np.ndarray) -> np.ndarray:
    """Upper bounds of impacts, in steps: one row per term of the vocabulary, one column per document."""
    sketches, bounds = _flat(batch.column("sketch"), np.uint8)
    widths, levels = np.diff(bounds), np.zeros((len(vocabulary), batch.num_rows), np.uint8)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        turned = np.ascontiguousarray(sketches[bounds[at][:, None] + np.arange(width)].T)
        one, two = coordinates(vocabulary, int(width))
        levels[:, at] = np.minimum(turned[one], turned[two])
    return levels


def _search_block(index: DataFrame, items: list[Item], vocabulary: np.ndarray, holding: int, terms: int, rules: SearchRules) -> DataFrame:
    """Per task and item the best documents: row, item_id, doc_id, score. Bounds tell which documents are scored."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Item(i.row, i.item_id, i.terms, i.weights) for i in items]
        for batch in portions(batches, "terms"):
            levels = _levels(batch, vocabulary)
            found, begins = _flat(batch.column("terms"), np.uint64)
            counts, _ = _flat(batch.column("counts"), np.uint32)
            sizes, ids = batch.column("size").to_numpy(), batch.column("doc_id").to_pylist()
            for item in own:
                # Whole numbers in doubles, exact: bounds in units of _MOST / _STEPS.
                bound = (item.weights.astype(np.float64) @ levels[item.terms].astype(np.float64)).astype(np.int64) * _MOST
                last = -item.best[-1][0] if len(item.best) == rules.top else 1
                near = np.flatnonzero(bound >= max(last, 1) * _STEPS)
                near = near[np.argsort(-bound[near], kind="stable")]
                wanted, low, many = vocabulary[item.terms], 0, rules.top
                while low < len(near) and bound[near[low]] >= max(last, 1) * _STEPS:
                    for k in near[low : low + many].tolist():
                        held = found[begins[k] : begins[k + 1]]
                        at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                        there = np.flatnonzero(held[at] == wanted)
                        part = impacts(counts[begins[k] + at[there]].astype(np.int64), sizes[k], holding, terms)
                        score = int(item.weights[there] @ part)
                        if score > 0:
                            item.best.append((-score, ids[k] is None, ids[k] or 0))
                    item.best = sorted(item.best)[: rules.top]
                    last = -item.best[-1][0] if len(item.best) == rules.top else 1
                    low, many = low + many, 2 * many
        best = [(i.row, i.item_id, None if none else doc_id, -score) for i in own for score, none, doc_id in i.best]
        columns = [pa.array([b[k] for b in best], pa.int64()) for k in range(4)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "item_id", "doc_id", "score"])

    return in_batches(index, rows, "row long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, staging: Staging, rules: SearchRules = SearchRules()) -> DataFrame:
    """Per item of ``items`` (item_id, text) its ``top`` documents with a score above 0: item_id, rank, doc_id, score.

    A term is a run of letters, digits and characters above 127, A-Z as a-z, known by a 64-bit hash. Its weight is
    floor(1000 ln((2N + 2) / (2 df + 1))); see ``impacts`` for the rest. Equal scores are ranked by doc_id, null last. Null and empty texts have
    no term: such documents are never found, such items find nothing, and an empty table on either side gives an empty result. Repeated
    rows are documents, or items, of their own. Other columns are not read. A copy of a text costs as much as any text; no
    documents are gathered by key but the best of each task.
    """
    counted = docs.select(F.regexp_count(whole(), F.lit(TERM)).cast("long").alias("n"))
    totals = counted.agg(F.count_if(F.col("n") > 0).alias("holding"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    index = staging.keep(sketch_index(docs, totals.holding, totals.terms, rules), "index")
    blocks = staging.keep(item_blocks(items, staging, rules), "blocks")
    found = []
    for (number,) in sorted(blocks.select("block").distinct().toLocalIterator()):
        asked = blocks.filter(F.col("block") == number).collect()
        parts = [np.frombuffer(r.terms, np.uint64) for r in asked]
        vocabulary = np.unique(np.concatenate(parts))
        held = _held_by(index, vocabulary)
        weights = np.array([weight(totals.holding, held.get(k, 0)) for k in range(len(vocabulary))], np.int64)
        own = [Item(r.row, r.item_id, at, weights[at]) for r, at in ((r, np.searchsorted(vocabulary, p)) for r, p in zip(asked, parts))]
        found.append(staging.keep(_search_block(index, own, vocabulary, totals.holding, totals.terms, rules), f"found-{number}"))
    if not found:
        return blocks.select("item_id", F.lit(0).alias("rank"), F.col("row").alias("doc_id"), F.col("row").alias("score"))
    ranks = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(ranks))
    return ranked.filter(F.col("rank") <= rules.top).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table ranked for every item of ``benchmark``."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Staging(spark))


_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

OP12_SQL = f"""
WITH split AS (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(len(terms))::BIGINT AS big_l FROM split WHERE len(terms) > 0),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
counted AS (
  SELECT doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM split)
  WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counted, totals GROUP BY term),
scored AS (
  SELECT item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM wanted JOIN counted USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""
