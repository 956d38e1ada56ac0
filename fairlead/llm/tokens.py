"""Token counts by finite-state machines compiled from a byte-level BPE tokenizer.

Two deterministic transducers run one after the other. The first reads characters and marks where a
piece (what merges never cross) begins. Its few states allow chunks of the stream to be read all at once:
each chunk yields a map from entry state to exit state, the maps are composed by a parallel prefix scan, and then
every chunk knows its entry state. The second reads the bytes of a piece; each transition is annotated
with the number of tokens it adds. Its states are made when first reached.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from fairlead.llm.common import documents, in_batches, portions

#: Characters of a chunk, and of the block whose chunks are read at once.
CHUNK = 256
BLOCK = 1 << 19
#: Pieces and states a worker keeps in memory; beyond, it forgets them and compiles anew. Longer pieces aren't kept.
MOST_PIECES = 300_000
MOST_STATES = 200_000
LONG_PIECE = 512

# Symbols: letter, number, other, apostrophe that can begin a contraction of 2 or 3 characters, blank before a
# piece, white space that goes on or ends the text, last white space of a run, end of a text.
LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, SPACE, LAST, END = range(9)
# States: at a piece's end; in a run of letters, numbers, others; after a blank; in white space; one or two more to go.
_AFTER, _LETTERS, _NUMBERS, _OTHERS, _OPEN, _SPACES, _ONE, _TWO = range(8)
# The code points with Unicode's property White_Space.
WHITE = (*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
# Endings that the tokenizer's pattern splits off after an apostrophe.
SHORT_ENDINGS, LONG_ENDINGS = ("s", "t", "m", "d"), ("re", "ve", "ll")


def _piece_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece begins, by symbol and state."""
    following, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    runs = {LETTER: _LETTERS, NUMBER: _NUMBERS, OTHER: _OTHERS, SHORT: _OTHERS, LONG: _OTHERS}
    for symbol, run in runs.items():
        following[symbol] = run
        begins[symbol, [run, _OPEN]] = False
    for symbol, first in ((SHORT, _ONE), (LONG, _TWO)):
        alone = [s for s in range(8) if s not in (_OTHERS, _OPEN)]
        following[symbol, alone] = first
    following[LETTER, _ONE], following[LETTER, _TWO] = _AFTER, _ONE
    begins[LETTER, [_ONE, _TWO]] = False
    following[BLANK], following[SPACE], following[LAST], following[END] = _OPEN, _SPACES, _AFTER, _AFTER
    begins[SPACE, _SPACES] = False
    begins[END] = False
    return following.ravel(), begins.ravel()


_FOLLOWING, _BEGINS = _piece_machine()


_UNKNOWN = 255


def _probed(point: int) -> int:
    """The kind of a character that Python's Unicode tables don't have: as the tokenizer library splits it."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    return next((kind for lead, kind in (("a", LETTER), ("1", NUMBER)) if len(split(lead + chr(point))) == 1), OTHER)


@functools.cache
def _kinds() -> np.ndarray:
    """LETTER, NUMBER, SPACE, OTHER or (not assigned in Python's tables) _UNKNOWN, of every code point."""
    by_category = {"L": LETTER, "N": NUMBER}
    kinds = np.array([by_category.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    kinds[[c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]] = _UNKNOWN
    kinds[list(WHITE)] = SPACE
    return kinds


def _symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of each character; ``ends`` are the places of the marks that end a text."""
    symbols = _kinds()[points]
    if symbols.max(initial=0) == _UNKNOWN:
        for point in np.unique(points[symbols == _UNKNOWN]).tolist():
            _kinds()[point] = _probed(point)
        symbols = _kinds()[points]
    symbols[ends] = END
    after = np.append(symbols[1:], END)
    last = (symbols == SPACE) & (after != SPACE) & (after != END)
    quote = np.flatnonzero((points == ord("'")) & (symbols == OTHER) & (after == LETTER))
    padded = np.concatenate([points, np.zeros(2, points.dtype)])
    one, two = padded[quote + 1], padded[quote + 2]
    short = np.isin(one, [ord(c) for c in SHORT_ENDINGS])
    long = np.zeros(len(quote), bool)
    for ending in LONG_ENDINGS:
        long |= (one == ord(ending[0])) & (two == ord(ending[1]))
    symbols[last] = np.where(points[last] == 32, BLANK, LAST)
    symbols[quote[short]] = SHORT
    symbols[quote[long]] = LONG
    return symbols


def piece_starts(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Whether a piece begins, at each character: all chunks advance together."""
    count = -(-len(symbols) // chunk)
    rows = np.full(count * chunk, END, np.uint8)
    rows[: len(symbols)] = symbols
    rows = np.ascontiguousarray(rows.reshape(count, chunk).T) * np.uint8(8)
    maps = np.repeat(np.arange(8, dtype=np.uint8)[:, None], count, axis=1)
    for row in rows:
        maps = _FOLLOWING[maps + row]
    # After the step of width w, a map covers the 2w chunks up to its own.
    width = 1
    while width < count:
        maps[:, width:] = _compose(maps[:, :-width], maps[:, width:])
        width *= 2
    state = np.append(np.uint8(_AFTER), maps[_AFTER, :-1])
    begins = np.empty((chunk, count), bool)
    for j, row in enumerate(rows):
        at = state + row
        begins[j] = _BEGINS[at]
        state = _FOLLOWING[at]
    return begins.T.ravel()[: len(symbols)]


def _compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The map of reading ``first`` and ``then``, for each pair of columns."""
    return then[first, np.arange(first.shape[1])[None, :]]


@functools.cache
def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a character: printable ones as themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in plain)
    names.update((chr(256 + i), b) for i, b in enumerate(others))
    return names


def token_bytes(name: str) -> bytes:
    byte_of = _byte_of()
    return bytes(byte_of[c] for c in name)


#: Stands for no tokens added in a transition; the count may also fall, by less than a token's length.
_ZERO = 128


class PieceMachine:
    """Counts a piece's tokens by a transducer over its bytes, made from the tokenizer's merges.

    A text has one token sequence in which all neighbours are compatible, meaning that the two texts
    joined give just the two tokens. So the last token of a prefix is the one token at its end
    that is compatible with the last token before it. A state holds what this needs: the longest suffix that begins
    some token, and for each prefix that ends in it and after which a token may still run, its last token and its
    count less the present one.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.special = sorted((t["content"] for t in model["added_tokens"]), key=len, reverse=True)
        self.tokens = {token_bytes(name) for name in model["model"]["vocab"] if name not in self.special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        self.ranks = {(token_bytes(a), token_bytes(b)): rank for rank, (a, b) in enumerate(pairs)}
        self.heads = {token[:n] for token in self.tokens for n in range(1, len(token) + 1)}
        self.made = {a + b: (rank, a, b) for (a, b), rank in self.ranks.items()}
        self.alone: dict[bytes, bool] = {}
        self.forget()

    def forget(self) -> None:
        start = (b"", ((None, 0),))
        self.states, self.numbers, self.steps = [start], {start: 0}, {}

    def merged(self, text: bytes) -> list[bytes]:
        """The tokens by the merge rule itself; used to see which single tokens can stand alone."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranks = [self.ranks.get(pair, len(self.ranks)) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == len(self.ranks):
                break
            left, right = parts[ranks.index(best)], parts[ranks.index(best) + 1]
            joined, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == left and parts[i + 1] == right:
                    joined.append(left + right)
                    i += 2
                else:
                    joined.append(parts[i])
                    i += 1
            parts = joined
        return parts

    def fits(self, before: bytes | None, token: bytes) -> bool:
        """Whether two tokens stay as they are when their texts are joined.

        Goes back in time: undoes the later merge of the two sides, and looks whether the pair then at the
        border would have been merged before that. Of equal merges the left one comes first.
        """
        if before is None:
            known = self.alone.get(token)
            if known is None:
                known = self.alone[token] = self.merged(token) == [token]
            return known
        left, right, limit = before, token, len(self.ranks)
        while True:
            if self.ranks.get((left, right), limit) < limit:
                return False
            made_left, made_right = self.made.get(left), self.made.get(right)
            if made_left is None and made_right is None:
                return True
            if made_right is None or (made_left is not None and made_left[0] > made_right[0]):
                limit, left = made_left[0], made_left[2]
            else:
                limit, right = made_right[0] + 1, made_right[1]

    def compile(self, number: int, byte: int) -> int:
        """The transition from a state on a byte: next state and, in the last eight bits, tokens added plus _ZERO."""
        suffix, lasts = self.states[number]
        suffix += bytes((byte,))
        while suffix not in self.heads:
            suffix = suffix[1:]
        for length in range(1, len(suffix) + 1):
            token, last = suffix[-length:], lasts[-length]
            if last and token in self.tokens and self.fits(last[0], token):
                added = last[1] + 1
                break
        kept = lasts[len(lasts) - len(suffix) :]
        # Of no use: a prefix after which no token goes on.
        rest = (k and suffix[i:] in self.heads and (k[0], k[1] - added) or None for i, k in enumerate(kept))
        state = (suffix, (*rest, (token, 0)))
        following = self.numbers.setdefault(state, len(self.states))
        if following == len(self.states):
            self.states.append(state)
        self.steps[number << 8 | byte] = step = following << 8 | (added + _ZERO)
        return step

    def count(self, piece: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.forget()
        number = total = 0
        steps = self.steps
        for byte in piece:
            key = number << 8 | byte
            step = steps.get(key)
            if step is None:
                step = self.compile(number, byte)
            number = step >> 8
            total += step & 255
        return total - _ZERO * len(piece)


class PieceCounts(dict):
    """Counts of pieces seen before; a new one runs through the machine."""

    def __init__(self, path: str) -> None:
        self.machine = PieceMachine(path)

    def __missing__(self, piece: bytes) -> int:
        count = self.machine.count(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= MOST_PIECES:
                self.clear()
            self[piece] = count
        return count


_SAFE = re.compile(r"(?<=\S) (?=\S)")


def segments(texts: Sequence[str], special: Sequence[str]) -> Iterator[tuple[int, str | None, str | None]]:
    """(text's number, part, special token after it). Special tokens cut texts, and so do, in long texts, blanks at which a piece surely begins."""
    cut = re.compile("|".join(map(re.escape, special))) if special else None
    for number, text in enumerate(texts):
        at = 0
        while True:
            found = cut.search(text, at) if cut else None
            stop = found.start() if found else len(text)
            while stop - at > BLOCK:
                safe = _SAFE.search(text, at + BLOCK, stop)
                if not safe:
                    break
                yield number, text[at : safe.start()], None
                at = safe.start()
            yield number, text[at:stop], found.group() if found else None
            if not found:
                break
            at = found.end()


def pieces_of(parts: Sequence[str]) -> tuple[list[bytes], np.ndarray]:
    """The pieces of all parts in order, and where each part's begin (and the last end)."""
    joined = "\0".join(parts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = piece_starts(_symbols(points, ends))
    width = np.uint8(1) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    firsts = np.flatnonzero(starts)
    starts[ends] = True
    edges = np.flatnonzero(starts)
    lasts = edges[np.searchsorted(edges, firsts, "right")]
    data = joined.encode("utf-8", "surrogatepass")
    pieces = [data[a:b] for a, b in zip(offsets[firsts].tolist(), offsets[lasts].tolist(), strict=True)]
    return pieces, np.concatenate([[0], np.searchsorted(firsts, ends)])


def part_blocks(texts: Sequence[str], special: Sequence[str]) -> Iterator[list[tuple[int, str, str | None]]]:
    block, size = [], 0
    for part in segments(texts, special):
        block.append(part)
        size += len(part[1]) + 1
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


@functools.lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


def count_tokens(texts: Sequence[str], path: str) -> np.ndarray:
    """Tokens of each text. A special token's string counts as that one token, as is the library's default."""
    counts = piece_counts(path)
    total = np.zeros(len(texts), np.int64)
    for block in part_blocks(texts, counts.machine.special):
        numbers = [number for number, _, _ in block]
        pieces, bounds = pieces_of([part for _, part, _ in block])
        sums = np.concatenate([[0], np.cumsum(np.fromiter(map(counts.__getitem__, pieces), np.int64, len(pieces)))])
        np.add.at(total, numbers, np.diff(sums[bounds]))
        np.add.at(total, numbers, [mark is not None for _, _, mark in block])
    return total


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Null text counts as empty: 0 and 0. Whole texts are read, in blocks; rows stay where they are, so nothing
    is shuffled. Other columns are not read. ``path`` must be readable on every worker.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            text = batch.column("text").fill_null("")
            size = pc.binary_length(text).cast(pa.int64())
            tokens = count_tokens(text.to_pylist(), path)
            columns = [batch.column("doc_id"), size, pa.array(tokens), pa.array(tokens > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return in_batches(
        docs.select("doc_id", "text"), counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_file())
