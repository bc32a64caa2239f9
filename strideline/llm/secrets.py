"""Secret scan: fixed patterns, and Markov models of random strings against ordinary identifiers.

Two first-order character models are trained, one on random strings, one on ordinary words
and identifiers. A long run of key characters counts as a secret if the log-likelihood
ratio of the two, per transition, passes a threshold. All of it is built-in expressions:
the model is one constant array, a candidate is scored by folding over its characters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns. A run of at least n characters is the maximal run the kinds
# ``access`` and ``hex`` ask for, as no shorter match can hide a longer one.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "markov")

#: Characters of candidates; the models know no others. The state before a string is 0.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
STATES = len(ALPHABET) + 1
#: Labelled documents the model of ordinary strings is fitted on, and words shorter than this it ignores.
TRAIN_DOCS = 2_000
MIN_ORDINARY = 4
#: Least log-likelihood ratio per transition, in nats.
THRESHOLD = 0.5


def _codes(text: Column) -> Column:
    """Places of the characters in the alphabet, from 1."""
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def labelled_samples(docs: DataFrame, labels: DataFrame, *, limit: int = TRAIN_DOCS) -> DataFrame:
    """Samples (``value``, ``random``) from at most ``limit`` documents labelled as good.

    Ordinary: their words of key characters, without what the fixed patterns find. Random:
    the values found by the patterns, and per document two strings of hash bits in base 64.
    The documents are the first by hash of their id; the limit bounds the fit, not the scan.
    """
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # At most ``limit`` ids are broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    clean = texts
    for pattern in (ASSIGN, ACCESS, HEX):
        clean = clean.withColumn("text", F.regexp_replace("text", pattern, " "))
    words = F.regexp_extract_all("text", F.lit(f"[A-Za-z0-9+/_=-]{{{MIN_ORDINARY},}}"), F.lit(0))
    ordinary = clean.select(F.explode(words).alias("value"), F.lit(False).alias("random"))
    found = F.concat(
        F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 12),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
        F.array(*(F.base64(F.unhex(F.sha2(F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")), 256))) for i in range(2))),
    )
    return ordinary.unionByName(texts.select(F.explode(found).alias("value"), F.lit(True).alias("random")))


def train(samples: DataFrame, *, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each transition, random over ordinary: a table of STATES x STATES."""
    codes = F.filter(_codes(F.col("value")), lambda c: c > 0)
    pairs = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0)))), codes, lambda a, b: a * STATES + b)
    cells = samples.select("random", F.explode(pairs).alias("cell")).groupBy("cell", "random").agg(F.count(F.lit(1)).alias("n"))
    counts = {True: [smoothing] * STATES**2, False: [smoothing] * STATES**2}
    for row in cells.where("cell is not null").collect():  # at most 2 x STATES x STATES rows
        counts[row["random"]][row["cell"]] += row["n"]
    table = []
    for state in range(STATES):
        rows = {label: c[state * STATES : (state + 1) * STATES] for label, c in counts.items()}
        sums = {label: sum(r) for label, r in rows.items()}
        table += [math.log(a / sums[True]) - math.log(b / sums[False]) for a, b in zip(rows[True], rows[False], strict=True)]
    return table


def score(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of a string of key characters."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")  # folded to a constant
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last"))
    walk = F.aggregate(
        _codes(value), start, lambda s, c: F.struct((s["sum"] + F.get(table, s["last"] * STATES + c)).alias("sum"), c.alias("last"))
    )
    return walk["sum"] / F.length(value)


def _found(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Matches as an array of (gap, match, value), the gap being the text before a match; empty if there are none."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else matches
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("match"), values.alias("value"))
    none = F.array().cast("array<struct<gap:string,match:string,value:string>>")
    return F.when(text.rlike(pattern), F.filter(zipped, lambda x: x["match"].isNotNull())).otherwise(none)


#: Matches whose places are added up at a time: an array that grows by appending is copied each time.
_BLOCK = 128
_PLACE = "array<struct<start:int,number:int,end:int,value:string>>"


def _located(found: Column, kind: str) -> Column:
    """(start, kind number, end, value) in code points, from a stored column of :func:`_found`.

    What lies between the matches gives their places: running sums, for blocks of matches first and then inside
    each block.
    """
    number = KINDS.index(kind)
    count = F.size(found)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(count - 1, F.lit(0)) / _BLOCK).cast("int")), lambda b: F.slice(found, (b * _BLOCK + 1).cast("int"), F.lit(_BLOCK)))
    sized = F.transform(blocks, lambda xs: F.struct(xs.alias("xs"), F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["match"])).alias("size")))

    def inside(xs: Column, begin: Column) -> Column:
        first = F.struct(begin.alias("at"), F.array().cast(_PLACE).alias("out"))

        def step(s: Column, x: Column) -> Column:
            start = s["at"] + F.length(x["gap"])
            end = start + F.length(x["match"])
            one = F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end"), x["value"].alias("value"))
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

        return F.aggregate(xs, first, step)["out"]

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PLACE}>").alias("out"))
    walked = F.aggregate(sized, start, lambda s, b: F.struct((s["at"] + b["size"]).alias("at"), F.concat(s["out"], F.array(inside(b["xs"], s["at"]))).alias("out")))
    return F.when(count > 0, F.flatten(walked["out"])).otherwise(F.array().cast(_PLACE))


def scan(docs: DataFrame, model: list[float], *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The key and ``spans``: (start, kind, end) of base spans and of runs the models call random.

    Sorted by start, then kind. A model's span never overlaps a base span. Null texts are empty;
    keys pass through whatever they are; other columns are dropped. No shuffle.
    """
    t = F.col("_t")
    frame = docs.select(F.col(key).alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    patterns = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "markov": (CANDIDATE, 0)}
    frame = frame.withColumns({f"_found_{kind}": _found(t, *pattern) for kind, pattern in patterns.items()})
    placed = {"assign": "_assign", "access": "_access", "hex": "_hex", "markov": "_long"}
    frame = frame.withColumns({name: _located(F.col(f"_found_{kind}"), kind) for kind, name in placed.items()})
    base = F.concat(F.filter("_assign", lambda x: F.length(x["value"]) >= MIN_ASSIGNED), F.col("_access"), F.col("_hex"))
    frame = frame.withColumn("_base", base)
    free = F.filter("_long", lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    frame = frame.withColumn("_free", free)
    random = F.when(F.size("_free") > 0, F.filter("_free", lambda x: score(x["value"], model) >= threshold)).otherwise(F.col("_free"))
    spans = F.sort_array(F.transform(F.concat("_base", random), lambda x: F.struct(x["start"], x["number"], x["end"])))
    names = F.array(*(F.lit(k) for k in KINDS))
    named = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.get(names, x["number"]).alias("kind"), x["end"].alias("end")))
    return frame.select(F.col(key), named.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
