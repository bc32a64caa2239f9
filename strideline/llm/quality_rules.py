"""Quality rules: a table of thresholds compiled into one projection of text ratios.

Everything is a built-in expression over one row: no user function, no shuffle. A rule is
(ratio, lowest, highest); a document is kept if the base rules hold and every ratio that
exists lies inside its bounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The word, symbol and line definitions, and the base rules.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Common words of the languages served: en, de, fr, es.
STOP_WORDS = (
    "the of and to a in is that it for was on are as with at be this by from or an "
    "der die das und ist in zu den von mit im nicht auf ein eine als auch des dem sich für "
    "le la les de des et en un une est du que qui dans par sur pour au avec pas "
    "el los las del y que una por con para se no su lo como más al es"
).split()

#: ratio: (lowest, highest); None is no bound.
THRESHOLDS: dict[str, tuple[float | None, float | None]] = {
    "n_words": (50, 200_000),
    "chars_per_word": (2.0, 12.0),
    "symbols_per_word": (None, 0.10),
    "exclaimed_per_word": (None, 0.20),
    "stop_words": (2, None),
    "stop_word_share": (0.04, None),
    "bullet_line_share": (None, 0.90),
    "ellipsis_line_share": (None, 0.30),
    "dup_line_share": (None, 0.40),
}


def words_of(text: Column) -> Column:
    """Maximal runs of characters that aren't ASCII white space."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def measure(docs: DataFrame, *, text: str = "text", keep: Sequence[str] = ("doc_id",), stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The kept columns and every count the rules are made of. A null text counts as empty."""
    t, n, words, lines, h = (F.col(c) for c in ("_t", "_n", "_words", "_lines", "_h"))
    common = sorted({form for w in stop_words for form in (w, w.capitalize())})
    frame = docs.select(*(F.col(k) for k in keep), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    frame = frame.withColumn("_words", words_of(t)).withColumn("_n", F.size("_words"))
    frame = frame.withColumn("_lines", F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""))

    # Words in windows found twice or more: equal windows meet when (hash, place) is sorted, and the
    # places of those cover up to three words each. Most texts have no equal windows and stop early.
    wh, s = F.col("_wh"), F.col("_s")
    frame = frame.withColumn("_wh", F.transform(words, lambda w: F.xxhash64(w)))
    whole = F.slice(wh, F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0)))
    frame = frame.withColumn("_h", F.transform(whole, lambda a, i: F.xxhash64(a, F.get(wh, i + 1), F.get(wh, i + 2))))
    ordered = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("at"))))
    frame = frame.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), ordered))
    none = F.array().cast("array<int>")
    pairs = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])).otherwise(none))
    frame = frame.withColumn("_at", F.when(s.isNotNull(), F.sort_array(F.flatten(pairs))))
    start = F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("_at", start, lambda c, i: F.struct((c["sum"] + F.least(F.lit(WINDOW), i - c["last"])).alias("sum"), i.alias("last")))
    return frame.select(
        *(F.col(k) for k in keep),
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered["sum"], F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.regexp_count(t, F.lit("[!?]")).cast("long").alias("n_exclaimed"),
        F.size(F.filter(words, lambda w: w.isin(*common))).cast("long").alias("n_stop_words"),
        F.size(F.filter(lines, lambda x: F.left(F.ltrim(x), F.lit(1)).isin("-", "*", "•", "|"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
    )


def ratios() -> dict[str, Column]:
    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))

    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "exclaimed_per_word": share("n_exclaimed", "n_words"),
        "stop_words": F.col("n_stop_words").cast("double"),
        "stop_word_share": share("n_stop_words", "n_words"),
        "bullet_line_share": share("n_bullet_lines", "n_lines"),
        "ellipsis_line_share": share("n_ellipsis_lines", "n_lines"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
    }


def apply_rules(measured: DataFrame, thresholds: dict[str, tuple[float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """Add ``base_failed``, ``kept`` and ``failed_rules`` (names in the order of the table)."""
    ratio = ratios()
    unknown = set(thresholds) - set(ratio)
    if unknown:
        raise ValueError(f"no such ratios: {sorted(unknown)}")
    failed = []
    for name, (low, high) in thresholds.items():
        tests = [ratio[name] < low] if low is not None else []
        tests += [ratio[name] > high] if high is not None else []
        if tests:
            failed.append(F.when(reduce(lambda a, b: a | b, tests), F.lit(name)))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    named = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    frame = measured.withColumn("base_failed", base).withColumn("failed_rules", named)
    return frame.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def kept_rows(judged: DataFrame) -> DataFrame:
    """Only the kept rows. A generator of one row or none instead of a filter: the optimizer would push a
    filter below the projections and write every measure out again for each of its uses."""
    one = F.when(F.col("kept"), F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    return judged.select("*", F.explode(one).alias("_kept")).drop("_kept")
