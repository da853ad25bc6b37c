"""Quality rules whose cut-offs come from mergeable quantile sketches per language and source.

Each document gets four ratios: word length, symbols, repeated lines and repeated words. A
sketch of a group is a table of bucket counts. Buckets are exact for small values and 1/32
wide beyond, so sketches merge by adding counts, in any order and with the same result each
time. The fences of a group are its outer quartiles plus three times their distance, but never
nearer to them than a stated least distance. Groups with few documents take the fences of
their language, and languages with few documents those of the corpus; those sketches are
sums of the group sketches, so no text is read again.

With those distances the spread of a group seldom matters. ``TailRules`` adds fences that only
the spread sets: sketches of the documents that pass the base rules, and for rates, which are
mostly 0, of those above 0. A document has to lie within both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from leakscan.llm.common import SEPARATORS, attach, let, materialize, null_safe, packed_row, words

SYMBOLS = "#*$%&|<>"
METRICS = ("word_length", "symbol_rate", "line_repeat_rate", "word_repeat_rate")
#: Count, whole and least event of each rate: one symbol, one repeated line, one window of three words that is there twice.
RATES = {"symbol_rate": ("n_symbols", "word_chars", 1), "line_repeat_rate": ("n_dup_lines", "n_lines", 1), "word_repeat_rate": ("n_repeat_words", "n_words", 6)}


@dataclass(frozen=True)
class QualityRules:
    """``least_*``: the least distance of a fence from its quartile, per thousand (characters per 1000 words for lengths)."""

    min_words: int = 50
    max_repeat_percent: int = 50
    fence: int = 3
    min_group: int = 200
    least_word_length: int = 4000
    least_symbol_rate: int = 200
    least_line_repeat_rate: int = 400
    least_word_repeat_rate: int = 250

    def least(self, metric: str) -> int:
        return getattr(self, f"least_{metric}")


@dataclass(frozen=True)
class TailRules(QualityRules):
    """The same rules and, beside them, fences without a least distance.

    All fences come from documents that pass the base rules. A fence of the second kind is the outer quartile plus ``fence`` times the distance of the quartiles. It is
    wider only by what a sketch bucket rounds off, and a rate may exceed it by one event.
    """


def _repeat_words(hashes: Column) -> Column:
    """Words in three-word windows that the text has twice or more; ``hashes`` has one hash per window."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = let(pairs, lambda s: F.filter(s, lambda x, k: F.coalesce(
            (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]),
            x["h"] == F.get(s, k - 1)["h"], x["h"] == F.get(s, k + 1)["h"], F.lit(False))))
        starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        widths = let(starts, lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))
        return F.aggregate(widths, F.lit(0), lambda total, x: total + x)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def _text_counts(text: Column) -> Column:
    """Struct of the counts of one text. The text is split into words once."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.translate(line, SEPARATORS, "") != "")

    def of_words(w: Column) -> Column:
        last = F.size(w) - 3
        windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.coalesce(_repeat_words(windows), F.lit(0)).cast("long").alias("n_repeat_words"))

    def of_lines(rows: Column) -> Column:
        return F.struct(F.size(rows).cast("long").alias("n_lines"), (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"))

    return F.struct(
        let(words(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.length(F.translate(text, SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def measure(docs: DataFrame, rules: QualityRules = QualityRules(), keep_row: bool = True) -> DataFrame:
    """Counts and ratios of each document, written once. Null texts count as empty.

    ``row`` holds the input columns (with ``keep_row``; else only ``doc_id``). Windows are compared by 64-bit hash.
    """
    source = docs if keep_row else docs.select("doc_id")
    frame = packed_row(
        docs if keep_row else docs.select("doc_id", "text", "lang", "source"),
        c=_text_counts(F.coalesce(docs["text"], F.lit(""))),
        lang_key=null_safe(docs["lang"]),
        source_key=null_safe(docs["source"]),
    )
    row = F.col("row") if keep_row else F.struct(*[F.col(f"row.`{name}`") for name in source.columns]).alias("row")
    flat = frame.select(
        row, "lang_key", "source_key", "c.w.n_words", "c.word_chars", "c.n_symbols", "c.l.n_dup_lines", "c.l.n_lines", "c.w.n_repeat_words"
    )
    per = lambda part, whole: F.expr(f"if({whole} = 0, 0, {part} * 1000 div {whole})")
    flat = flat.withColumns({
        "base_failed": (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
        "word_length": per("word_chars", "n_words"),
        "symbol_rate": per("n_symbols", "word_chars"),
        "line_repeat_rate": per("n_dup_lines", "n_lines"),
        "word_repeat_rate": per("n_repeat_words", "n_words"),
    })
    return materialize(flat, "measured")


def bucket(value: str) -> Column:
    """Sketch bucket of a whole number of at least 0: exact below 64, then 32 per power of two."""
    step = f"greatest(0, length(bin({value})) - 6)"
    return F.expr(f"32 * {step} + shiftright({value}, {step})").cast("int")


def bucket_start(number: str) -> Column:
    """The smallest value in a bucket."""
    return F.expr(f"if({number} < 64, {number}, shiftleft({number} - 32 * ({number} div 32 - 1), cast({number} div 32 - 1 as int)))").cast("long")


def sketch(measured: DataFrame) -> DataFrame:
    """Bucket counts per language, source and ratio."""
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(m).alias("bucket")) for m in METRICS]))
    return (
        measured.select("lang_key", "source_key", entries.alias("e"))
        .groupBy("lang_key", "source_key", "e.metric", "e.bucket")
        .agg(F.count("*").alias("n"))
    )


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups: sums of the counts."""
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """First and third quartile of each group and ratio: the start of the bucket that holds it."""
    group = Window.partitionBy(*keys, "metric")
    running = sketches.withColumns({
        "upto": F.sum("n").over(group.orderBy("bucket")),
        "size": F.sum("n").over(group),
        "start": bucket_start("bucket"),
    })
    return running.groupBy(*keys, "metric").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("size"), F.col("start"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("size"), F.col("start"))).alias("q3"),
        F.max("size").alias("size"),
    )


def _chosen(groups: DataFrame, rules: QualityRules) -> DataFrame:
    """``own`` size and the quartiles to ``use`` of each group and ratio: those of the group, its language or the corpus."""
    spread = F.struct("q1", "q3", "size")
    own = quartiles(groups, ["lang_key", "source_key"]).select("lang_key", "source_key", "metric", spread.alias("q"))
    lang = quartiles(merge(groups, ["lang_key"]), ["lang_key"]).select("lang_key", "metric", spread.alias("by_lang"))
    whole = quartiles(merge(groups, []), []).select("metric", spread.alias("by_all"))
    use = (
        F.when(F.col("q.size") >= rules.min_group, F.col("q"))
        .when(F.col("by_lang.size") >= rules.min_group, F.col("by_lang"))
        .otherwise(F.col("by_all"))
    )
    return own.join(lang, ["lang_key", "metric"]).join(F.broadcast(whole), "metric").select(
        "lang_key", "source_key", "metric", F.col("q.size").alias("own"), use.alias("use"))


def _picks(ends: tuple[str, ...]) -> list[Column]:
    return [F.max(F.when(F.col("metric") == m, F.col(end))).alias(f"{end}_{m}") for m in METRICS for end in ends]


def _tail_sketch(measured: DataFrame) -> DataFrame:
    """Sketch of the documents that pass the base rules.

    Each group has every ratio, if need be with a count of 0 only, so that it can take its language's or the corpus' quartiles.
    """
    none = F.explode(F.array(*[F.lit(m) for m in METRICS])).alias("metric")
    names = ["lang_key", "source_key", "metric", "bucket", "n"]
    every = measured.select("lang_key", "source_key").distinct().select("lang_key", "source_key", none, F.lit(-1).alias("bucket"), F.lit(0).cast("long").alias("n"))
    return sketch(measured.where(~F.col("base_failed"))).select(*names).unionByName(every)


def _tail_bounds(groups: DataFrame, rules: QualityRules) -> DataFrame:
    """``tail_low_*`` and ``tail_high_*`` per language and source; null if nothing in the corpus sets a fence."""
    tails = groups.where((F.col("metric") == "word_length") | (F.col("bucket") != 0))
    bucket_width = lambda end: F.expr(f"1 + use.{end} div 32")
    width = rules.fence * (F.col("use.q3") - F.col("use.q1"))
    bound = _chosen(tails, rules).where(F.col("use.size") > 0).select(
        "lang_key", "source_key", "metric",
        (F.col("use.q1") - width - bucket_width("q1")).alias("tail_low"), (F.col("use.q3") + width + bucket_width("q3")).alias("tail_high"))
    return bound.groupBy("lang_key", "source_key").agg(*_picks(("tail_low", "tail_high")))


def fences(measured: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Lower and upper fence of each ratio per language and source, one row per group, written once."""
    tails = isinstance(rules, TailRules)
    groups = materialize(_tail_sketch(measured) if tails else sketch(measured), "sketch")
    least = F.create_map(*[F.lit(x) for m in METRICS for x in (m, rules.least(m))])
    width = F.greatest(rules.fence * (F.col("use.q3") - F.col("use.q1")), least[F.col("metric")])
    bound = _chosen(groups, rules).select("lang_key", "source_key", "metric", F.col("own").alias("size"), (F.col("use.q1") - width).alias("low"), (F.col("use.q3") + width).alias("high"))
    found = bound.groupBy("lang_key", "source_key").agg(F.max("size").alias("group_size"), *_picks(("low", "high")))
    if tails:
        rows = measured.groupBy("lang_key", "source_key").agg(F.count("*").alias("group_size"))
        found = found.drop("group_size").join(rows, ["lang_key", "source_key"]).join(_tail_bounds(groups, rules), ["lang_key", "source_key"], "left")
    return materialize(found, "fences")


def judge(measured: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """``measured`` with ``kept``: the base rules hold and every ratio lies within the fences of its group."""
    bounded = attach(measured, fences(measured, rules), ["lang_key", "source_key"], "group_size")
    inside = F.lit(True)
    for metric in METRICS:
        inside = inside & (F.col(metric) <= F.col(f"high_{metric}"))
    inside = inside & (F.col("word_length") >= F.col("low_word_length"))
    if isinstance(rules, TailRules):
        within = F.col("word_length").between(F.col("tail_low_word_length"), F.col("tail_high_word_length"))
        inside = inside & F.coalesce(within, F.lit(True))
        for metric, (count, whole, event) in RATES.items():
            within = 1000 * (F.col(count) - event) <= F.col(f"tail_high_{metric}") * F.col(whole)
            inside = inside & F.coalesce(within, F.lit(True))
    return bounded.withColumn("kept", ~F.col("base_failed") & inside)


def quality_report(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per row of ``docs``: counts, ``base_failed`` and ``kept``.

    Null text counts as empty, null language or source is a group of its own, repeated rows are
    judged one by one, and an empty table gives an empty result.
    """
    judged = judge(measure(docs, rules, keep_row=False), rules)
    return judged.select(
        F.col("row.doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    return judge(measure(docs, rules), rules).where("kept").select("row.*")
