"""What the stages of a corpus pipeline share: numbered rows, and decisions that take effect by row.

A stage decides by row, not by ``doc_id``: rows without an id and rows that share one are judged each by their own
text. So the rows are stored with a number of their own first, and the decisions are joined back by that number. Such
a copy is dropped by :func:`release`, which a stage calls when it begins: the result of the stage before is written
by then, and nothing reads the copy any more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideline.llm import near_dups, perplexity
from strideline.operators.staging import discard, stage

_copies: list[DataFrame] = []


def release() -> None:
    """Drop the copies of earlier stages."""
    while _copies:
        discard(_copies.pop())


def numbered(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows, stored with ``row``, a number no other row has."""
    copy = stage(docs.select(F.monotonically_increasing_id().alias("row"), *columns))
    _copies.append(copy)
    return copy


def kept(rows: DataFrame, decided: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows whose number is in ``decided``."""
    return rows.join(decided.select("row"), "row", "left_semi").select(*columns)


def readable(docs: DataFrame, labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that the perplexity model keeps; a label speaks for all rows of its id, a row without an id has none.

    Null and empty texts go, as :func:`strideline.llm.perplexity.judge` rejects them; equal texts of one language share
    a verdict. An empty table stays empty; columns besides ``columns`` are dropped.
    """
    rows = numbered(docs, columns)
    own = stage(rows.select("row", "doc_id").join(labels.select("doc_id", "quality"), "doc_id").select(F.col("row").alias("doc_id"), "quality"))
    judged = perplexity.judge(perplexity.score(rows, own, key="row"), own)
    return kept(rows, judged.where("kept").select(F.col("doc_id").alias("row")), columns)


def one_of_each(docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of each class of near duplicates: of the smallest id, one without an id if none has one; ties, such as a
    repeated row, go to the smallest row number.

    A text without a full n-gram (null and empty ones too) is a class with its equals, as
    :func:`strideline.llm.near_dups.jaccard_join` says. An empty table stays empty.
    """
    rows = numbered(docs, columns)
    joined = near_dups.jaccard_join(rows, key="row").select(F.col("doc_id").alias("row"), "class_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    first = joined.join(rows.select("row", "doc_id"), "row").groupBy("class_id").agg(F.min(order).alias("first"))
    return kept(rows, first.select("first.row"), columns)
