"""Fences that the spread of a group sets, and the pipeline stage that uses them."""

import corpus_pipeline
from leakscan.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(number, symbols=0, repeated_lines=0, length=6):
    """80 different words of ``length`` letters, 8 to a line; the first line is there ``repeated_lines`` times more."""
    rest = length - 4
    words = [f"{chr(97 + number % 26)}{k:02d}{chr(97 + number // 26 % 26)}" + "x" * rest for k in range(80)]
    words = [w[:-1] + "#" if k < symbols else w for k, w in enumerate(words)]
    lines = [" ".join(words[i : i + 8]) for i in range(0, 80, 8)]
    return "\n".join(lines + lines[:1] * repeated_lines)


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA)
    return {r.doc_id for r in corpus_pipeline.drop_low_quality(spark, docs, "").collect()}, docs


def test_equal_ratios_get_the_verdict_of_their_source(spark):
    # a: 2 to 4 symbols are usual; b: 25 to 45 are
    rows = [(i, text(i, 2 + i % 3), "a") for i in range(300)] + [(1000 + i, text(i, 25 + i % 21), "b") for i in range(300)]
    rows += [(5000, text(7, 30), "a"), (5001, text(7, 30), "b")]
    got, docs = kept(spark, rows)
    assert got == {i for i, *_ in rows} - {5000}
    # the fences with least distances tell nothing apart here
    assert quality.keep_good(docs).count() == len(rows)


def test_repeated_lines_and_word_lengths_have_tails(spark):
    rows = [(i, text(i), "a") for i in range(300)] + [(1000 + i, text(i, 0, 1), "a") for i in range(220)]
    rows += [(5000, text(7, 0, 3), "a"), (5001, text(7, 0, 0, 9), "a"), (5002, text(7, 0, 0, 4), "a")]
    got, docs = kept(spark, rows)
    assert got == {i for i, *_ in rows} - {5000, 5001, 5002}
    assert quality.keep_good(docs).count() == len(rows)


def test_one_symbol_in_a_source_without_any_stays(spark):
    rows = [(i, text(i), "a") for i in range(300)] + [(5000, text(7, 1), "a")]
    assert kept(spark, rows)[0] == {i for i, *_ in rows}


def test_failed_documents_set_no_fence(spark):
    # most documents of the source are too short and full of symbols
    rows = [(i, text(i, 2 + i % 3), "a") for i in range(210)] + [(1000 + i, "#a #b #c", "a") for i in range(900)] + [(5000, text(7, 30), "a")]
    assert kept(spark, rows)[0] == set(range(210))
