"""The log made of turns folds back to them; long texts and long conversations."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strideline.llm import chat


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, message string")


@pytest.fixture(scope="module")
def conversations(spark):
    long = "word [INST] and </s> more " * 40_000
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} of {t} 😀" * (t + 1)) for c in range(40) for t in range(6)]
    rows += [(50, 0, "user", None), (50, 1, "assistant", ""), (50, 1, None, "no role"), (50, 1, None, "no role"), (None, 0, "user", "no id"), (51, 0, "assistant", long)]
    rows += [(52, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(3_000)]
    return turns_of(spark, rows)


def messages(frame):
    return sorted(((r["conv_id"], r["message"], r["role"], r["text"] or "") for r in frame.select("conv_id", "message", "role", "text").collect()), key=str)


def test_the_log_folds_back_to_the_turns(conversations):
    log = chat.log_of_turns(conversations)
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == set(chat.KINDS) and min(kinds.values()) > 100
    assert log.where(F.col("text") == "an early answer").count() > 100
    # Rows come in any order.
    shuffled = log.repartition(5, F.xxhash64("seq", "text")).sortWithinPartitions(F.xxhash64("text", "seq"))
    assert messages(chat.fold(shuffled)) == messages(chat.numbered(conversations))


def test_every_event_of_a_turn_matters(spark, conversations):
    """Without its edits, or its deltas, the log folds to something else."""
    log, expected = chat.log_of_turns(conversations), messages(chat.numbered(conversations))
    for kind in chat.KINDS:
        assert messages(chat.fold(log.where(F.col("kind") != kind))) != expected


def test_rendered_texts_come_back_whole(conversations):
    rendered = chat.render(chat.fold(chat.log_of_turns(conversations))).withColumn("turns", chat.parse(F.col("formatted")))
    held = {}
    for conv, number, role, text in messages(chat.numbered(conversations)):
        held.setdefault(conv, []).append((number, role or "", text))
    rows = rendered.withColumn("learnt", chat.learnt_text(F.col("formatted"), F.col("loss_mask"))).collect()
    assert {r["conv_id"] for r in rows} == set(held)
    for r in rows:
        own = [(role, text) for _, role, text in sorted(held[r["conv_id"]])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == own
        assert r["learnt"] == "".join(text for role, text in own if role == "assistant")
    assert max(r["n_turns"] for r in rows) == 3_000 and max(len(r["formatted"]) for r in rows) > 1_000_000


def test_a_log_of_nothing(spark):
    assert chat.fold(chat.log_of_turns(turns_of(spark, []))).collect() == []
