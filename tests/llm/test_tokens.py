"""Token files, packing and byte-level BPE against the libraries on whole texts."""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strideline.llm import bpe, packing, token_files
from strideline.llm.units import UnitEncoder
from strideline.operators.staging import staging_path

JSON, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


WHOLE = {path: Tokenizer.from_file(path) for path in (JSON, WORDS)}
TIKTOKEN = tiktoken.Encoding(
    "t", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={}
)
PIECES = st.lists(st.sampled_from(["the", "Été", "don't", " ", "  ", "\n", "\n\n", "\t", "\x85", "\x1c", " ", "á", "́", "Σ", "12", "##", "\x00", ".", "日本", "<|endoftext|>", "<|ENDofTEXT|>", "<|startoftext|>", "|", "The", "WORD,", "x" * 120, ",", "***", "It's", "),", "_", "@x", "`"]))


@pytest.mark.parametrize("path", [JSON, WORDS])
@settings(max_examples=200, deadline=None)
@given(parts=PIECES)
def test_units_join_to_the_whole(path, parts):
    text = "".join(parts)
    own = UnitEncoder.of(path)
    assert np.frombuffer(own.encode([text])[0], own.dtype).tolist() == WHOLE[path].encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(parts=PIECES)
def test_safe_parts_join_to_the_whole(parts):
    text = "".join(parts)
    assert [i for p in bpe.safe_parts(text, 3) for i in TIKTOKEN.encode_ordinary(p)] == TIKTOKEN.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1)))
def test_rank_code_round_trip(values):
    control, data = token_files.encode_ranks(np.array(values, "<u4"))
    assert token_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values)).tolist() == values


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=8))
def test_rank_code_of_many(documents):
    counts = np.array([len(d) for d in documents], np.int64)
    control, data = token_files.encode_all(np.array([x for d in documents for x in d], "<u4"), counts)
    assert list(zip(control, data, strict=True)) == [token_files.encode_ranks(np.array(d, "<u4")) for d in documents]
    joined = [np.frombuffer(b"".join(parts), np.uint8) for parts in (control, data)]
    assert token_files.decode_all(*joined, counts).tolist() == [x for d in documents for x in d]


def ids_of(path, text, end):
    return np.array([*WHOLE[path].encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_token_files(spark, request, name, monkeypatch):
    monkeypatch.setattr(token_files, "BUCKET_BYTES", 30_000)
    monkeypatch.setattr(token_files, "SEGMENT_BYTES", 5_000)
    docs = request.getfixturevalue(name)
    folder = staging_path(spark)
    token_files.write_token_files(docs, folder, JSON, 2)
    read = token_files.with_start(token_files.read_token_files(spark, folder), token_files.segment_starts(spark, folder))
    got = sorted(((r["start"], r["doc_id"], bytes(r["ids"])) for r in read.collect()))
    expected = sorted(((r["doc_id"] is not None, r["doc_id"], ids_of(JSON, r["text"], 2).tobytes()) for r in docs.collect()), key=lambda r: (r[0], r[1] or 0))
    assert [r[1] for r in got] == [r[1] for r in expected]
    assert sorted((str(r[1]), r[2]) for r in got) == sorted((str(r[1]), r[2]) for r in expected)
    at = 0
    for start, _, ids in got:
        assert start == at
        at += len(ids) // 4


def test_token_files_of_nothing(spark, empty):
    folder = staging_path(spark)
    token_files.write_token_files(empty, folder, JSON, 2)
    assert token_files.with_start(token_files.read_token_files(spark, folder), token_files.segment_starts(spark, folder)).count() == 0


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_byte_bpe(spark, request, name):
    docs = request.getfixturevalue(name)
    got = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect()
    made = lambda t: np.array(TIKTOKEN.encode_ordinary(t or ""), "<u4")
    expected = [(r["doc_id"], len(made(r["text"])), made(r["text"]).tobytes(), (r["text"] or "").encode()) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in got), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("name", ["odd", "documents"])
def test_packing(spark, request, name):
    docs = request.getfixturevalue(name)
    pieces, placed = packing.pack(docs, WORDS, 0, 512)
    rows = placed.collect()
    stored = {(r["part"], r["length"], r["local"]): bytes(r["ids"]) for r in pieces.collect()}
    assert len(stored) == len(rows)
    whole, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = stored[r["part"], r["length"], r["local"]]
        assert len(ids) == 4 * r["length"] and zlib.crc32(ids) == r["crc32"]
        whole[r["doc_id"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], ids))
    expected = defaultdict(list)
    for r in docs.collect():
        ids = ids_of(WORDS, r["text"], 0).tobytes()
        expected[r["doc_id"]] += [(s, ids[4 * s : 4 * (s + 512)]) for s in range(0, len(ids) // 4, 512)]
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in expected.items()}
    for held in sequences.values():
        at = 0
        for offset, length, _ in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 512) * 1.02 + 3
    made = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(pieces, placed).collect()}
    assert made == {k: b"".join(i for _, _, i in sorted(v)) for k, v in sequences.items()}


def test_packing_of_nothing(empty):
    _, placed = packing.pack(empty, WORDS, 0, 512)
    assert placed.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_holds_every_piece(histogram):
    bins = packing.plan(histogram, 64, groups=8)
    held = defaultdict(int)
    for items, times in bins:
        assert sum(items) <= 64 and times > 0
        for item in items:
            held[item] += times
    assert dict(held) == histogram
    slots = set()
    for length, n in histogram.items():
        table = packing.places(bins)
        own = table[table[:, 0] == length]
        for rank in range(n):
            _, first, sequence, copies, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            slot = (sequence + (rank - first) // copies, offset + (rank - first) % copies * length)
            assert slot not in slots
            slots.add(slot)


def test_plan_is_tight():
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(rng.integers(1, 2049, 100_000), return_counts=True)
    bins = packing.plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), 2048)
    assert sum(n for _, n in bins) <= int((lengths * counts).sum() / 2048 * 1.01)


def test_start_is_of_long_type(odd):
    assert dict(bpe.encode(odd, RANKS, PATTERN).dtypes)["n_tokens"] == "bigint"
    assert bpe.encode(odd, RANKS, PATTERN).agg(F.count(F.lit(1))).first()[0] == odd.count()


def test_a_worker_holds_one_cache():
    from strideline.llm import arrow

    first = arrow.held("a", dict)
    assert arrow.held("a", dict) is first
    arrow.held("b", list)
    assert arrow.held("a", dict) is not first
    arrow.release()
    assert not arrow._HELD


def test_runs_of_texts_do_not_change_ids(monkeypatch):
    import public_tokenizers

    from strideline.llm import units

    own = units.UnitEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", "one two\n three  four", "x" * 50, "one two\n three  four", "ß \U0001f600 end"]
    whole = own.encode(texts)
    monkeypatch.setattr(units, "RUN_CHARS", 7)
    assert own.encode(texts) == whole and own.encode([]) == []


def test_strings_of_added_tokens_are_tokens():
    assert np.frombuffer(UnitEncoder(JSON).encode(["a <|endoftext|> b"])[0], "<u2").tolist() == [64, 220, 50256, 275]


def test_units_of_real_texts(documents):
    texts = [r["text"] or "" for r in documents.collect()]
    for path in (JSON, WORDS):
        own = UnitEncoder(path)
        assert own.separators and own.splits_marks
        assert [np.frombuffer(v, own.dtype).tolist() for v in own.encode(texts)] == [e.ids for e in WHOLE[path].encode_batch(texts, add_special_tokens=False)]


def test_the_cache_is_bounded_in_bytes(monkeypatch):
    from strideline.llm import units

    monkeypatch.setattr(units, "CACHE_BYTES", 20_000)
    own = UnitEncoder(JSON)
    for i in range(50):
        own.encode([f"w{i} " + " ".join(f"u{i}x{j}" for j in range(20)) + " " + "z" * 5_000])
        assert own.held <= 30_000 and all(len(k) <= units.LONG_UNIT for k in own.cache)
        assert own.held == sum(len(k) + len(v or b"") + units.ENTRY_BYTES for k, v in own.cache.items())


def many_units(n):
    return ["The " + " ".join(f"wörd{i:x}," if i % 3 else f"word{i:x}" for i in range(begin, begin + 200)) for begin in range(0, n, 200)]


@pytest.mark.parametrize("path", [JSON, WORDS])
def test_kept_units_take_few_bytes(path):
    import tracemalloc

    import pyarrow as pa

    own = UnitEncoder(path)
    own.encode(many_units(200))
    texts, n = many_units(20_000), 20_000
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    own.encode(texts)
    kept = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert len(own.cache) > 0.9 * n and kept < 80 * n


@pytest.mark.parametrize("path", [JSON, WORDS])
def test_new_units_are_handled_many_at_a_time(path):
    import cProfile
    import pstats

    own, texts = UnitEncoder(path), many_units(20_000)
    profile = cProfile.Profile()
    got = profile.runcall(own.encode, texts)
    assert pstats.Stats(profile).total_calls < 20_000
    assert [np.frombuffer(v, own.dtype).tolist() for v in got] == [e.ids for e in WHOLE[path].encode_batch(texts, add_special_tokens=False)]
