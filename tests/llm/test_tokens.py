"""Token counts and packing against the tokenizer library."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fairlead.llm import tokens
from fairlead.llm.packing import PackRules, _tail, encode, hilbert, pack

PATH = tokens.tokenizer_file()
LAYOUT = "doc_id long, text string, n_tokens string, row string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


PARTS = ["'s", "'re", "'", " ", "  ", "\n", "\t", "the", "ing", "A", "1", "23", "!", "é", "中", " ", "\u0085", "😀", "<|endoftext|>", "Ᲊ"]


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS) | st.text(max_size=3), max_size=12).map("".join), min_size=1, max_size=4))
def test_counts_and_ids_are_the_library_s(texts):
    from tokenizers import Tokenizer

    library = test_counts_and_ids_are_the_library_s.__dict__.setdefault("library", Tokenizer.from_file(PATH))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert tokens.count_tokens(texts, PATH).tolist() == [len(w) for w in want]
    assert [i.tolist() for i in encode(texts, PATH)] == want


def test_chunks_and_cuts_change_nothing(library, monkeypatch):
    texts = ["", "a " * 3000 + "!!" * 500, " \n" * 700 + "x", "b" * 2000, "it's we're 12 \t\n 'll"]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    for block in (7, 300, 1 << 19):
        monkeypatch.setattr(tokens, "BLOCK", block)
        assert tokens.count_tokens(texts, PATH).tolist() == want
    symbols = np.random.default_rng(1).integers(0, 8, 1000).astype(np.uint8)
    assert all((tokens.piece_starts(symbols, n) == tokens.piece_starts(symbols, 1000)).all() for n in (1, 3, 64, 999))


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_STATES", 50)
    monkeypatch.setattr(tokens, "MOST_PIECES", 5)
    words = "several words of the ordinary kind and extraordinarily incomprehensible unforgettable ones"
    assert tokens.count_tokens([words], PATH).tolist() == [len(library.encode(words).ids)]


def test_count_query_cases(spark):
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (3, "é", "x", "y"), (3, "é", "x", "y"), (None, "a " * 600, "x", "y")]
    found = tokens.token_counts(spark.createDataFrame(rows, LAYOUT), PATH)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect())
    assert got == [(0, 1200, 601, True), (1, 0, 0, False), (2, 0, 0, False), (3, 2, 1, False), (3, 2, 1, False)]
    assert tokens.token_counts(spark.createDataFrame([], LAYOUT), PATH).count() == 0


@pytest.mark.parametrize("dimensions, bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_goes_through_all_cells_by_neighbours(dimensions, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    keys = hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert set(np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)) == {1}


def test_tail_is_powers_of_two():
    assert np.diff(_tail(2048 * 3 + 1025, 2048)).tolist() == [1024, 1]
    assert _tail(4096, 2048).tolist() == [4096] and _tail(0, 2048).tolist() == [0]


def test_packing_is_a_partition(spark, staging, library):
    rows = [(i, "some words " * (i % 9 * 30), "x", "y") for i in range(60)]
    rows += [(100, None, "x", "y"), (101, "", "x", "y"), (None, "alone", "x", "y"), (102, "long text " * 4000, "x", "y")]
    found = pack(spark.createDataFrame(rows, LAYOUT).repartition(5), PATH, staging, PackRules(length=256)).collect()
    ids = {i: np.array([*library.encode(t or "").ids, 1], "<u4") for i, t, *_ in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        whole = ids[r.doc_id]
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids) and len(sequences) == max(sequences) + 1
    for group, full in ((pieces, None), (sequences, 256)):
        for name, parts in group.items():
            end = 0
            for start, length in sorted(parts):
                assert start == end
                end += length
            assert end == len(ids[name]) if full is None else end == full or end & (end - 1) == 0
    assert pack(spark.createDataFrame([], LAYOUT), PATH, staging).count() == 0


@pytest.mark.parametrize("text", ["x" + " " * 1_000_000 + "y", "\n" * 3_000_000, " " * 3_000_000 + "<|endoftext|> a"])
def test_long_white_space_has_the_library_s_ids(library, text):
    assert encode([text], tokens.tokenizer_file())[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_a_text_of_white_space(spark, staging, library):
    text = "a" + " " * 1_000_000 + "b"
    n = len(library.encode(text, add_special_tokens=False).ids) + 1
    rows = pack(spark.createDataFrame([(1, text), (2, "c")], "doc_id long, text string"), tokens.tokenizer_file(), staging).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == n and {r.doc_tokens for r in rows if r.doc_id == 1} == {n}
