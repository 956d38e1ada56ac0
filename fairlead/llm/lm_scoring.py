"""Cross-entropy difference: documents scored by two matched bigram models over one vocabulary.

The target model is counted on the documents of a wanted kind, the background model on all. Both have the same vocabulary, smoothing
and order, so that a difference of losses says which kind of text a document is, not how the models were made.

``score_whole`` counts every word and every bigram; its models are Spark tables that grow with the documents, dealt in parts. ``fit`` and ``score``
are for models of a bounded vocabulary that fit into every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.llm.common import documents, in_batches, portions, ship
from fairlead.llm.words import PUNCTUATION, scramble, word_hashes
from fairlead.sources.tables import Staging

#: Numbers of what is no word: a word outside the vocabulary, and the start of a document.
UNKNOWN, START = 0, 1


@dataclass(frozen=True)
class ModelRules:
    """``vocabulary``: the most frequent words of the background, with two more entries for unknown words and starts.

    It bounds the models of ``fit``: two tables of its square. ``discount`` is taken off each bigram seen and given to the unigrams, whose
    counts start at ``prior``. A task counts up to ``held`` distinct words or bigrams before it hands them on; in ``score_whole`` it is the words
    of a block, and about those of a part. ``common`` had words looked up in each task; no result depends on it, and it is not read any more.
    """

    vocabulary: int = 2048
    discount: float = 0.75
    prior: float = 0.5
    held: int = 1_000_000
    common: int = 65_536


def word_counts(docs: DataFrame, rules: ModelRules) -> DataFrame:
    """word (its hash) and n over all documents; tasks sum first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])

        for part in portions(batches):
            found, n = np.unique(word_hashes(part.column("text"), PUNCTUATION)[0], return_counts=True)
            both, place = np.unique(np.concatenate([words, found]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), minlength=len(both)).astype(np.int64)
            words = both
            if len(words) > rules.held:
                yield batch()
                words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield batch()

    return in_batches(docs.select("text"), counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _numbers(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number in the vocabulary (sorted hashes), and where each text's words begin (and the last end)."""
    words, bounds = word_hashes(column, PUNCTUATION)
    if not len(vocabulary):
        return np.full(len(words), UNKNOWN), bounds
    at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
    return np.where(vocabulary[at] == words, at + 2, UNKNOWN), bounds


def _bigrams(numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number before each word, START for a text's first, and the word's."""
    before = np.concatenate([[START], numbers[:-1]])[: len(numbers)]
    before[bounds[:-1][bounds[:-1] < bounds[1:]]] = START
    return before, numbers


def bigram_counts(docs: DataFrame, vocabulary: np.ndarray, rules: ModelRules) -> DataFrame:
    """before, word and n over all of ``docs``. A task has a table of the vocabulary's square, and hands on what it counted."""
    size = rules.vocabulary

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for part in portions(batches):
            before, words = _bigrams(*_numbers(part.column("text"), vocabulary))
            cells, n = np.unique(before * size + words, return_counts=True)
            table[cells] += n
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(table[cells])], ["cell", "n"])

    counts = in_batches(docs.select("text"), counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return counts.select(F.expr(f"cell div {size}").alias("before"), (F.col("cell") % size).alias("word"), "n")


@dataclass(frozen=True)
class BigramModels:
    """The shared vocabulary (sorted hashes), and the losses -log P(word | before) of both models."""

    vocabulary: np.ndarray
    target: np.ndarray
    background: np.ndarray


def losses(counts: np.ndarray, unigrams: np.ndarray, rules: ModelRules) -> np.ndarray:
    """-log P of every word after one word, of which ``counts`` were seen; unseen ones by the unigrams."""
    single = (unigrams + rules.prior) / (unigrams.sum() + rules.prior * len(unigrams))
    total = counts.sum()
    if not total:
        return -np.log(single)
    taken = np.minimum(counts, rules.discount)
    return -np.log((counts - taken + taken.sum() * single) / total)


def fit(docs: DataFrame, target: DataFrame, staging: Staging, rules: ModelRules = ModelRules()) -> BigramModels:
    """Both models; their counts cover all of ``docs`` and all of ``target``.

    What reaches the driver is bounded by the vocabulary: its words, its unigram counts, and a row of losses for each word.
    """
    top = word_counts(docs, rules).orderBy(F.desc("n"), "word").limit(rules.vocabulary - 2)
    vocabulary = np.sort(np.array([r["word"] for r in top.select("word").collect()], np.int64).view(np.uint64))
    cells = bigram_counts(target, vocabulary, rules).withColumn("kind", F.lit("target")).unionByName(
        bigram_counts(docs, vocabulary, rules).withColumn("kind", F.lit("background"))
    )
    cells = staging.keep(cells, "bigrams")  # read twice
    size = rules.vocabulary
    singles = {kind: np.zeros(size) for kind in ("target", "background")}
    for row in cells.groupBy("kind", "word").agg(F.sum("n").alias("n")).collect():
        singles[row["kind"]][row["word"]] = row["n"]

    def row_losses(group: pd.DataFrame) -> pd.DataFrame:
        tables = {}
        for kind, unigrams in singles.items():
            own, counts = group[group["kind"] == kind], np.zeros(size)
            counts[own["word"].to_numpy()] = own["n"]
            tables[kind] = [losses(counts, unigrams, rules).astype(np.float32).tobytes()]
        return pd.DataFrame({"before": [group["before"].iloc[0]], **tables})

    ship(docs.sparkSession.sparkContext)
    found = cells.groupBy("before").applyInPandas(row_losses, "before long, target binary, background binary")
    tables = {kind: np.tile(losses(np.zeros(size), unigrams, rules).astype(np.float32), (size, 1)) for kind, unigrams in singles.items()}
    for row in found.collect():
        for kind, table in tables.items():
            table[row["before"]] = np.frombuffer(row[kind], np.float32)
    return BigramModels(vocabulary, tables["target"], tables["background"])


def score(docs: DataFrame, models: BigramModels) -> DataFrame:
    """Per row: doc_id, n_words, target_loss, background_loss (means per word), and score, target less background.

    The smaller the score, the more a text is of the target's kind. Null or empty text has 0 words and null losses.
    Other columns are not read. The models, of a size that the vocabulary bounds, are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((models.vocabulary, models.target.ravel(), models.background.ravel()))
    size = len(models.target)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, *tables = shared.value
        for batch in portions(batches):
            numbers, bounds = _numbers(batch.column("text"), vocabulary)
            before, words = _bigrams(numbers, bounds)
            n = np.diff(bounds)
            text = np.repeat(np.arange(len(n)), n)
            empty = pa.array(n == 0)
            sums = [np.bincount(text, table[before * size + words].astype(np.float64), minlength=len(n)) for table in tables]
            target, background = (s / np.maximum(n, 1) for s in sums)
            nothing = pa.scalar(None, pa.float64())
            means = [pc.if_else(empty, nothing, pa.array(m)) for m in (target, background, target - background)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), *means],
                ["doc_id", "n_words", "target_loss", "background_loss", "score"],
            )

    schema = "doc_id long, n_words long, target_loss double, background_loss double, score double"
    return in_batches(docs.select("doc_id", "text"), scored, schema)


def in_blocks(docs: DataFrame, rules: ModelRules) -> DataFrame:
    """block, row, doc_id, text, target and size (bytes): rows one after the other whose texts have about ``held`` words are a block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64()).to_numpy()
            ends, rows = seen + np.cumsum(sizes), batch.column("row").to_numpy()
            # The upper bits of a row's number are its task's.
            blocks = (rows >> 33 << 33) + (ends - sizes) // (rules.held * WORD_BYTES)
            seen = int(ends[-1]) if len(ends) else seen
            yield pa.RecordBatch.from_arrays([pa.array(blocks), *batch.columns, pa.array(sizes)], ["block", *batch.schema.names, "size"])

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", "target")
    return in_batches(texts, cut, "block long, row long, doc_id long, text string, target boolean, size long")


@dataclass(frozen=True)
class _Piece:
    """The words and bigrams of some texts: distinct words (hashes, the start among them), distinct bigrams as their hash and the places of
    both words, how often each occurs, and for each text's words in turn the place of the bigram."""

    words: np.ndarray
    before: np.ndarray
    word: np.ndarray
    pairs: np.ndarray
    n: np.ndarray
    place: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def of(column: pa.Array | pa.ChunkedArray) -> _Piece:
        found, bounds = word_hashes(column, PUNCTUATION)
        words, numbers = np.unique(np.concatenate([np.array([START], np.uint64), found]), return_inverse=True)
        before = numbers[:-1].copy()
        before[bounds[:-1][bounds[:-1] < bounds[1:]]] = numbers[0]
        cells, place, n = np.unique(before * len(words) + numbers[1:], return_inverse=True, return_counts=True)
        before, word = cells // len(words), cells % len(words)
        return _Piece(words, before, word, scramble(words[before]) + words[word], n, place, bounds)


def _dealt(hashes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the hashes by part, in their order, and where each part's begin (and the last end)."""
    part = (scramble(hashes) >> np.uint64(32)).astype(np.int64) % parts
    return np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.BinaryArray:
    """Lists of numbers from 0, most of them small, as bytes: seven bits in each, the last below 128."""
    values = values.astype(np.uint64)
    lengths = np.ones(len(values), np.int64)
    while (longer := values >> (7 * lengths).astype(np.uint64) > 0).any():
        lengths += longer
    ends = np.concatenate([[0], np.cumsum(lengths)])
    data = np.empty(ends[-1], np.uint8)
    for k in range(lengths.max(initial=0)):
        some = np.flatnonzero(lengths > k)
        data[ends[some] + k] = (values[some] >> np.uint64(7 * k)) & np.uint64(127) | np.where(lengths[some] > k + 1, 128, 0).astype(np.uint64)
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends[bounds].astype(np.int32)), pa.py_buffer(data)])


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    """All numbers of ``_packed`` lists, one after the other. Null is empty."""
    data = np.frombuffer(b"".join(x for x in column.to_pylist() if x), np.uint8)
    last = np.flatnonzero(data < 128)
    begins = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    shifts = 7 * (np.arange(len(data)) - np.repeat(begins, last - begins + 1))
    return np.add.reduceat((data & 127).astype(np.int64) << shifts, begins) if len(last) else last


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, one after the other, and where each list's begin (and the last end). Null is empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return pc.list_flatten(column).to_numpy(), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _rows(schema: str, rows: int, /, **columns) -> pa.RecordBatch:
    """A batch with the columns of the schema; those not given are null."""
    return pa.RecordBatch.from_arrays([_array(columns.get(name), kind, rows) for name, kind in _fields(schema)], [name for name, _ in _fields(schema)])


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(field.split(" ")) for field in schema.split(", ")]


def _array(values, kind: str, rows: int) -> pa.Array:
    inner = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind.removeprefix("array<").removesuffix(">")]
    wanted = pa.list_(inner) if kind.startswith("array") else inner
    if values is None:
        return pa.nulls(rows, wanted)
    return (pa.array(np.full(rows, values)) if np.isscalar(values) else values if isinstance(values, pa.Array) else pa.array(values)).cast(wanted)


SCORES = ["doc_id", "n_words", "target_loss", "background_loss", "score"]
#: Bytes of a word, with what lies between words.
WORD_BYTES = 7
#: What a piece asks: of each of its bigrams, or (part null) of its words. n and t: how often they occur in it, and in its texts of the target;
#: ``before`` holds steps from one place to the next. ``answer`` is 0 for pieces that are only counted.
ASKED = "part int, block long, piece long, answer int, pairs array<long>, before binary, n binary, t binary, words array<long>, single_n binary, single_t binary, after_n binary, after_t binary"
#: The answer, bigram by bigram; and of the bigrams that this piece stands for, by the place of their first word (in steps), what the discount
#: is taken of: how many occur more often than its whole part says, and how often they occur up to that.
ANSWERED = "part int, block long, piece long, answer int, n binary, t binary, at binary, more_n binary, more_t binary, full_n binary, full_t binary, words array<long>, single_n binary, single_t binary, after_n binary, after_t binary"
COUNTS = ["single_n", "single_t", "after_n", "after_t"]
TAKEN = ["more_n", "more_t", "full_n", "full_t"]
_ALL = ", ".join(f"{c} binary" for c in COUNTS + TAKEN)
WORDS = f"part int, block long, piece long, answer int, words array<long>, {_ALL}"
#: Of a piece's words, or (block null) of all words of a part.
STATS = f"part int, block long, piece long, {_ALL}, all_n long, all_t long, all_words long"


def _asked(texts: DataFrame, parts: int, extra: bool = False) -> DataFrame:
    """What the pieces of the texts ask. A piece is a block, or what a task reads of it; it is named by its first row.

    Pieces of ``extra`` texts, all of the target, count for that alone and want no answer.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def asked() -> Iterator[pa.RecordBatch]:
            block, first = held[0].column("block")[0].as_py(), held[0].column("row")[0].as_py()
            piece = _Piece.of(pa.chunked_array([b.column("text") for b in held]))
            marked = np.concatenate([b.column("target").fill_null(False).to_numpy(zero_copy_only=False) for b in held])
            held.clear()
            order, bounds = _dealt(piece.pairs, parts)
            some = np.flatnonzero(np.diff(bounds))
            before = piece.before[order]
            steps = np.diff(before, prepend=0)
            steps[bounds[some]] = before[bounds[some]]
            bounds = np.concatenate([bounds[some], bounds[-1:]])
            same = {"block": block, "piece": first, "answer": int(not extra)}
            text = np.repeat(np.arange(len(piece.bounds) - 1), np.diff(piece.bounds))
            t = np.bincount(piece.place, marked[text], minlength=len(piece.n)).astype(np.int64)
            n = np.zeros_like(t) if extra else piece.n
            yield _rows(
                ASKED, len(some), part=some, **same, pairs=_lists(piece.pairs.view(np.int64)[order], bounds), before=_packed(steps, bounds),
                n=_packed(n[order], bounds), t=_packed(t[order], bounds),
            )
            whole = np.array([0, len(piece.words)])
            counts = [np.bincount(at, c, minlength=len(piece.words)).astype(np.int64) for at in (piece.word, piece.before) for c in (n, t)]
            yield _rows(ASKED, 1, **same, words=_lists(piece.words.view(np.int64), whole), **{c: _packed(v, whole) for c, v in zip(COUNTS, counts)})

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if held and low < high and held[0].column("block")[0].as_py() != blocks[low]:
                    yield from asked()
                if low < high:
                    held.append(batch.slice(low, high - low))
        if held:
            yield from asked()

    return in_batches(texts.select("block", "row", "text", "target"), pieces, ASKED)


def _answered(rules: ModelRules):
    def answered(part: pa.Table) -> pa.Table:
        if part.column("part")[0].as_py() is None:
            return pa.Table.from_batches([_rows(ANSWERED, part.num_rows, **{c: part.column(c).combine_chunks() for c in ("block", "piece", "answer", "words", *COUNTS)})])
        pairs, bounds = _flat(part.column("pairs"))
        steps, pieces = _unpacked(part.column("before")), np.repeat(np.arange(part.num_rows), np.diff(bounds))
        found, first, place = np.unique(pairs, return_index=True, return_inverse=True)
        sums = [np.bincount(place, _unpacked(part.column(c)), minlength=len(found)).astype(np.int64) for c in "nt"]
        # The first piece that has a bigram stands for it.
        ends = np.cumsum(steps)
        before = ends - np.repeat(ends[bounds[:-1]] - steps[bounds[:-1]], np.diff(bounds))
        owner = np.zeros(len(pairs), bool)
        owner[first] = True
        cells, at = np.unique((pieces[owner] << 32) + before[owner], return_inverse=True)
        limit = int(rules.discount)
        taken = [np.bincount(at, x, minlength=len(cells)) for f in (lambda s: s > limit, lambda s: np.minimum(s, limit)) for x in (f(s[place[owner]]) for s in sums)]
        own = np.searchsorted(cells >> 32, np.arange(part.num_rows + 1))
        places = cells & 0xFFFFFFFF
        steps = np.diff(places, prepend=0)
        some = own[:-1][own[:-1] < own[1:]]
        steps[some] = places[some]
        same = {c: part.column(c).combine_chunks() for c in ("part", "block", "piece", "answer")}
        return pa.Table.from_batches([_rows(
            ANSWERED, part.num_rows, **same, n=_packed(sums[0][place], bounds), t=_packed(sums[1][place], bounds),
            at=_packed(steps, own), **{c: _packed(v, own) for c, v in zip(TAKEN, taken)},
        )])

    return answered


def _words_asked(parts: int):
    def asked(piece: pa.Table) -> pa.Table:
        """A piece's words by part, with what the discount takes in all."""
        own = piece.filter(pc.is_valid(piece.column("words")))
        words = _flat(own.column("words"))[0]
        at = [np.cumsum(_unpacked(piece.column("at").slice(i, 1))) for i in range(piece.num_rows)]
        at = np.concatenate(at).astype(np.int64)
        taken = {c: np.bincount(at, _unpacked(piece.column(c)), minlength=len(words)) for c in TAKEN}
        order, bounds = _dealt(words.view(np.uint64), parts)
        some = np.flatnonzero(np.diff(bounds))
        bounds = np.concatenate([bounds[some], bounds[-1:]])
        same = {c: own.column(c)[0].as_py() for c in ("block", "piece", "answer")}
        counts = {**{c: _unpacked(own.column(c)) for c in COUNTS}, **taken}
        return pa.Table.from_batches([_rows(WORDS, len(some), part=some, **same, words=_lists(words[order], bounds), **{c: _packed(v[order], bounds) for c, v in counts.items()})])

    return asked


def _words_answered(part: pa.Table) -> pa.Table:
    words, bounds = _flat(part.column("words"))
    found, place = np.unique(words, return_inverse=True)
    sums = {c: np.bincount(place, _unpacked(part.column(c)), minlength=len(found)).astype(np.int64) for c in (*COUNTS, *TAKEN)}
    # The start is no word: it is never second in a bigram.
    answer = part.column("answer").to_numpy()
    asking = np.flatnonzero(answer)
    mine = np.repeat(answer == 1, np.diff(bounds))
    starts = np.concatenate([[0], np.cumsum(np.diff(bounds)[asking])])
    same = {c: part.column(c).take(pa.array(asking)).combine_chunks() for c in ("part", "block", "piece")}
    answers = _rows(STATS, len(asking), **same, **{c: _packed(s[place[mine]], starts) for c, s in sums.items()})
    totals = {"all_n": int(sums["single_n"].sum()), "all_t": int(sums["single_t"].sum()), "all_words": int(((sums["single_n"] + sums["single_t"]) > 0).sum())}
    return pa.Table.from_batches([answers, _rows(STATS, 1, **totals)])


def score_whole(docs: DataFrame, target: DataFrame | str, staging: Staging, rules: ModelRules = ModelRules()) -> DataFrame:
    """As ``score``, by models of all words: the target's of ``target``, some of ``docs``, and the background's of all ``docs``.

    ``target`` may be the name of a boolean column of ``docs`` that tells the target's rows, which spares counting them again.

    Texts lie in blocks. A block asks for the counts of its distinct bigrams, then of its distinct words, each of the part that its hash
    belongs to, and is answered place by place; so a common word or bigram is one entry a block, and the answers need no hashes.
    Bigrams are known by 64 bits. Null texts are empty.
    """
    marked = isinstance(target, str)
    texts = docs.select("doc_id", "text", (F.col(target) if marked else F.lit(False)).alias("target"))
    # Stored, as a block's texts have to be the same when it asks and when it is answered.
    blocks = staging.keep(in_blocks(texts, rules), "blocks", codec="zstd")
    parts = max(1, -(-(blocks.agg(F.sum("size")).first()[0] or 0) // (rules.held * WORD_BYTES)))
    ship(docs.sparkSession.sparkContext)
    asked = _asked(blocks, parts)
    if not marked:
        wanted = in_blocks(target.select(F.lit(None).alias("doc_id"), "text", F.lit(True).alias("target")), rules)
        asked = asked.unionByName(_asked(wanted, parts, extra=True))
    # The words' rows have no part: each goes a way of its own.
    way = F.when(F.col("part").isNull(), -1 - F.pmod(F.xxhash64("block", "piece"), F.lit(parts))).otherwise(F.col("part"))
    answered = staging.keep(asked.groupBy(way.alias("way")).applyInArrow(_answered(rules), ANSWERED), "answered", codec="zstd")
    words = answered.select("block", "piece", "answer", "words", *COUNTS, "at", *TAKEN)
    words = words.groupBy("answer", "block", "piece").applyInArrow(_words_asked(parts), WORDS)
    stats = staging.keep(words.groupBy("part").applyInArrow(_words_answered, STATS), "stats", codec="zstd")
    sums = stats.agg(*(F.sum(f"all_{c}") for c in ("n", "t", "words"))).first()
    whole = dict(zip("nt", (s or 0 for s in sums)))
    mass = {c: whole[c] + rules.prior * ((sums[2] or 0) + 2) for c in whole}

    def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts, answers = texts.sort_by("row"), answers.sort_by([("piece", "ascending"), ("part", "ascending")])
        rows, named = texts.column("row").to_numpy(), answers.column("piece").to_numpy()
        begins = np.searchsorted(rows, np.unique(named)).tolist()
        found = []
        for low, high in zip(begins, [*begins[1:], len(rows)]):
            part = texts.slice(low, high - low)
            piece, mine = _Piece.of(part.column("text")), answers.filter(pa.array(named == rows[low]))
            pairs, stats = mine.filter(pc.is_valid(mine.column("n"))), mine.filter(pc.is_valid(mine.column("single_n")))

            def placed(table: pa.Table, column: str, hashes: np.ndarray) -> np.ndarray:
                values = np.empty(len(hashes))
                values[_dealt(hashes, parts)[0]] = _unpacked(table.column(column))
                return values

            n = np.diff(piece.bounds)
            text = np.repeat(np.arange(len(n)), n)
            means = []
            for c in "tn":
                count = placed(pairs, c, piece.pairs)
                single, after, more, full = (placed(stats, f"{name}_{c}", piece.words) for name in ("single", "after", "more", "full"))
                taken = full + (rules.discount - int(rules.discount)) * more
                alone = ((single + rules.prior) / mass[c])[piece.word]
                after = after[piece.before]
                seen = count - np.minimum(count, rules.discount) + taken[piece.before] * alone
                loss = -np.log(np.where(after > 0, seen / np.maximum(after, 1), alone)).astype(np.float32)
                means.append(np.bincount(text, loss[piece.place].astype(np.float64), minlength=len(n)) / np.maximum(n, 1))
            empty, nothing = pa.array(n == 0), pa.scalar(None, pa.float64())
            losses = [pc.if_else(empty, nothing, pa.array(m)) for m in (*means, means[0] - means[1])]
            found.append(pa.table([part.column("doc_id").combine_chunks(), pa.array(n), *losses], SCORES))
        return pa.concat_tables(found)

    answers = answered.filter("answer = 1 and n is not null").select("part", "block", "piece", "n", "t")
    answers = answers.unionByName(stats.filter("block is not null").drop("all_n", "all_t", "all_words"), allowMissingColumns=True)
    texts = blocks.select("block", "row", "doc_id", "text")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        scored, "doc_id long, n_words long, target_loss double, background_loss double, score double"
    )


def labelled_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, and ``good``: whether the document is labelled as of high quality and not toxic.

    The join is by sorted ids at every size: labels grow with the documents, so they aren't broadcast while they are few.
    Rows without an id are dealt out by their texts.
    """
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id"))
    good = good.distinct().withColumn("good", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("none", F.col("doc_id").isNull())
    rows = rows.withColumn("id", F.coalesce("doc_id", F.xxhash64("text")))
    found = rows.join(good.withColumn("none", F.lit(False)).hint("merge"), ["none", "id"], "left")
    return found.select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = labelled_good(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_whole(docs, "good", Staging(spark))
