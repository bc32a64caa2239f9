"""The pipeline's stages on rows without an id and rows that share one, against brute force."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from strideline.llm import perplexity, pii, quality_rules

from .conftest import LONG, ODD
from .test_groups import brute_links
from .test_text import WORD, counts, kneser_ney

JUNK = "zq#x 0)9 vv~~k\x7f %%wq}{ " * 15


@pytest.fixture(scope="module")
def rows(documents):
    """(doc_id, text): the odd rows, some documents, one repeated, one without its id, and junk under a good one's id."""
    some = [(r["doc_id"] + 1_000, r["text"]) for r in documents.where("length(text) < 2000").orderBy("doc_id").limit(25).collect()]
    return ODD + some + some[:2] + [(None, t) for _, t in some[2:5]] + [(some[5][0], JUNK), (None, JUNK)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    # Columns more than documents have, with names the stages use inside.
    names = "doc_id long, text string, lang string, source string, n_chars long, row string, kept int, class_id string, first int, key double"
    frame = spark.createDataFrame([(k, t, "en", "web", len(t or ""), "r", 0, "c", 1, 0.5) for k, t in rows], names)
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(k, int(k % 2), 0) for k in sorted({k for k, t in rows if k is not None and k > 1_000 and t != JUNK})]
    spark.createDataFrame([r for r in labels if r[0] % 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet"), path


def passes(text):
    """The verdict of the rules, from their own threshold table."""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = counts(text)
    if n_words < 50 or 100 * n_repeat_words > 50 * n_words:
        return False
    lines = [x for x in text.split("\n") if WORD.search(x)]
    words = WORD.findall(text)
    stop = sum(w in {f for s in quality_rules.STOP_WORDS for f in (s, s.capitalize())} for w in words)
    blank = " \t\n\x0b\x0c\r"
    shares = {
        "n_words": n_words,
        "chars_per_word": word_chars / n_words,
        "symbols_per_word": n_symbols / n_words,
        "exclaimed_per_word": len(re.findall("[!?]", text)) / n_words,
        "stop_words": stop,
        "stop_word_share": stop / n_words,
        "bullet_line_share": sum(x.lstrip(blank)[:1] in ("-", "*", "•", "|") for x in lines) / len(lines),
        "ellipsis_line_share": sum(x.rstrip(blank).endswith(("...", "…")) for x in lines) / len(lines),
        "dup_line_share": n_dup_lines / len(lines),
    }
    bounds = quality_rules.THRESHOLDS
    assert set(shares) == set(bounds)
    return all((low is None or shares[k] >= low) and (high is None or shares[k] <= high) for k, (low, high) in bounds.items())


def found(frame, *columns):
    return Counter(tuple(r) for r in frame.select(*(columns or ("doc_id", "text"))).collect())


def test_classifier(spark, docs):
    frame, path = docs
    good = {r[0] for r in spark.read.parquet(f"{path}/labels.parquet").where("quality = 1").select("doc_id").collect()}
    each = frame.withColumn("fold", perplexity._fold()).select("doc_id", "text", "fold").collect()
    trusted = [(r["text"].encode(), r["fold"]) for r in each if r["doc_id"] in good and r["text"]]
    less = lambda t: perplexity.SHORT / math.sqrt(len(t))
    held = sorted(kneser_ney([u for u, g in trusted if g != f], t) - less(t) for t, f in trusted)
    limit = held[math.ceil(perplexity.QUANTILE * len(held)) - 1]
    score = {t: kneser_ney([u for u, _ in trusted], t.encode()) - less(t.encode()) for t in {r["text"] for r in each if r["text"]}}
    assert LONG in score
    assert all(abs(s - limit) > 1e-4 for s in score.values() if s != limit)
    expected = Counter((r["doc_id"], r["text"]) for r in each if r["text"] and score[r["text"]] <= limit)
    assert any(k is None for k, _ in expected) and 0 < sum(expected.values()) < len(each)
    assert found(corpus_pipeline.quality_classifier(spark, frame, path)) == expected


def test_rules(spark, docs, rows):
    assert found(corpus_pipeline.rules(spark, *docs)) == Counter((k, t) for k, t in rows if passes(t or ""))
    got = found(corpus_pipeline.rules(spark, docs[0], docs[1]))
    base = {t for _, t in rows if counts(t or "")[0] >= 50 and 100 * counts(t or "")[4] <= 50 * counts(t or "")[0]}
    assert got and all(t in base for _, t in got)
    kept = {t for _, t in got}  # a text is kept with all of its rows
    assert got == Counter((k, t) for k, t in rows if t in kept)


def test_near_duplicates(spark, docs, rows):
    links = brute_links(list(enumerate([t for _, t in rows])))
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(links[i][1], []).append((key is None, key or 0))
    expected = Counter((None if min(g)[0] else min(g)[1],) for g in groups.values())
    assert found(corpus_pipeline.near_duplicates(spark, *docs), "doc_id") == expected


def test_personal_data_stage(spark, docs, rows):
    clean = lambda t: None if t is None else pii.redacted(t, sorted({s for both in pii.spans(t) for s in both}))
    assert found(corpus_pipeline.personal_data(spark, *docs)) == Counter((k, clean(t)) for k, t in rows)


def check_packed(placed, texts):
    """Pieces hold the ids of the texts, lie gapless in their sequences, and fill them well."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected, total = Counter(), 0
    for key, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            expected[(key, piece, start, len(part), zlib.crc32(part.tobytes()))] += 1
    assert found(placed, "doc_id", "piece", "start", "length", "ids_crc32") == expected
    sequences = defaultdict(list)
    for r in placed.collect():
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= total / 2048 * 1.1 + 2


def test_packing_stage(spark, docs, rows):
    check_packed(corpus_pipeline.pack(spark, *docs), rows)


def test_run_is_its_stages_one_after_another(spark, docs, rows, tmp_path):
    frame, path = docs
    for number, (_, function) in enumerate(corpus_pipeline.STAGES[:-1]):
        function(spark, frame, path).write.parquet(f"{tmp_path}/{number}")
        frame = spark.read.parquet(f"{tmp_path}/{number}")
        assert tuple(frame.columns) == corpus_pipeline.COLUMNS and frame.count()
    check_packed(corpus_pipeline.run(spark, path), [(r["doc_id"], r["text"]) for r in frame.collect()])


def test_stages_of_nothing(spark, docs, tmp_path):
    frame, path = docs
    frame.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    none = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, none, str(tmp_path)).collect() == []
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
