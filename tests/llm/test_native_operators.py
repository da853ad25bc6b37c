"""Quality rules, pseudonyms and mixture against plain Python on small tables."""

import math
import re

import pytest
from pyspark.sql import functions as F

from leakscan.llm import mixture, pseudonyms, quality
from leakscan.llm.quality import bucket, bucket_start

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id int, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 5, "x") for i, t, lang, s in rows], SCHEMA)


def sample_texts():
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta"]
    long = " ".join(words[(i * i + i // 7) % 8] + str(i % 13) for i in range(3000))
    return [
        None, "", "   \n\t", "one", "one two", "a b a b a b a b", "x y z x y z", "line\nline\n\nline\nother",
        "#a $b *c %d &e |f <g >h", " ".join(["the quick brown fox"] * 20), long, "lone\x1cword glued", "\n".join(["same words here"] * 9),
    ]


def expected_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_python(spark):
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None) for i, t in enumerate(sample_texts())]
    got = quality.quality_report(docs(spark, rows + rows[:4])).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        n = expected_counts(rows[r.doc_id][1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.kept and r.base_failed)


def test_quality_thresholds_follow_the_group(spark):
    plain = [" ".join(f"word{i}x{k}" for k in range(80)) for i in range(300)]
    loud = [" ".join(f"w{i}x{k}##" for k in range(80)) for i in range(3)]
    rows = [(i, t, "en", "a") for i, t in enumerate(plain + loud)]
    # where every text looks like that, the same text is ordinary
    rows += [(1000 + i, " ".join(f"w{i}x{k}##" for k in range(80)), "en", "b") for i in range(300)]
    kept = {r.doc_id for r in quality.quality_report(docs(spark, rows)).where("kept").collect()}
    assert kept == set(range(300)) | set(range(1000, 1300))
    table = docs(spark, rows)
    stayed = quality.keep_good(table)
    assert stayed.columns == table.columns and stayed.count() == 600


def test_sketches_merge_and_bound_their_error(spark):
    values = [*range(200), 1000, 12345, 999_999, 2**40 + 7]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", bucket("v").alias("b")).select("v", "b", bucket_start("b").alias("low"))
    seen = {}
    for v, b, low in rows.orderBy("v").collect():
        assert low <= v and (v - low) * 32 <= v and (low == v or v >= 64)
        seen.setdefault(b, low)
    assert list(seen) == sorted(seen)
    counts = spark.createDataFrame([("a", "m", v % 10, 1) for v in range(100)] + [("b", "m", 50, 25)], "k string, metric string, bucket int, n long")
    whole = quality.quartiles(quality.merge(counts, []), []).first()
    assert (whole.q1, whole.q3, whole.size) == (3, 9, 125)


def test_empty_tables(spark):
    empty = docs(spark, [])
    assert quality.quality_report(empty).count() == quality.keep_good(empty).count() == 0
    assert mixture.mix_report(empty).count() == mixture.mix(empty).count() == 0
    assert pseudonyms.pseudonym_report(empty, "k").count() == pseudonyms.pseudonymize(empty, "k").count() == 0


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


FOUND = "card 4111111111111111 and 4111-1111-1111-1111, call +1 (212) 555-0187 from 10.20.30.40 on 2024-02-29 or 29/02/2024, 29.02.2024; id 123-45-6789"
KEPT = "no card 4111111111111112, no address 300.1.1.1 nor 1.2.3.4.5, no date 2023-02-30, version 1.2, year 2024, 12345"


def test_pseudonyms_keep_the_format_and_can_be_undone(spark):
    rows = [(1, FOUND, "en", "a"), (2, KEPT, "en", "a"), (3, "again 4111111111111111!", "en", "b"), (4, None, None, None), (5, "", "en", "a")]
    table = docs(spark, rows)
    new = {r.doc_id: r.text for r in pseudonyms.pseudonymize(table, "key").collect()}
    assert new[2] == KEPT and new[4] is None and new[5] == ""
    shape = lambda t: re.sub(r"[0-9]+(?=\.[0-9]+\.[0-9]+)|(?<=[0-9]\.)[0-9]+(?=\.|\s)", "N", re.sub("[0-9]", "9", t))
    assert shape(new[1]).replace("N", "").replace("9", "") == shape(FOUND).replace("N", "").replace("9", "")
    cards = re.findall(r"\d{16}|\d{4}(?:-\d{4}){3}", new[1])
    assert all(luhn(c.replace("-", "")) for c in cards) and cards[0] == cards[1].replace("-", "") != "4111111111111111"
    assert re.search(r"\d{16}", new[3]).group() == cards[0]
    assert all(int(x) < 256 for x in re.search(r"from (\S+) on", new[1]).group(1).split("."))
    iso, slashed, dotted = re.search(r"on (\S+) or (\S+), (\S+);", new[1]).groups()
    assert iso.split("-") == slashed.split("/")[::-1] == dotted.split(".")[::-1]
    back = pseudonyms.pseudonymize(pseudonyms.pseudonymize(table, "key"), "key", inverse=True)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t for i, t, *_ in rows}
    assert {r.doc_id: r.text for r in pseudonyms.pseudonymize(table, "other").collect()}[1] != new[1]


def test_mail_names_and_tokens_are_linked(spark):
    mail, token = "ann.lee-7@mail.example.com", "0123456789abcdef0123456789abcdef01234567"
    table = docs(spark, [(1, f"{mail} {token}", "en", "a"), (2, f"x {mail}", "en", "a"), (3, f"{token}", "en", "a")])
    new = {r.doc_id: r.text for r in pseudonyms.pseudonymize(table, "key").collect()}
    first, second = new[1].split()
    assert first.endswith("@mail.example.com") and first != mail and len(first) == len(mail) and new[2] == f"x {first}"
    assert re.fullmatch("[0-9a-f]{40}", second) and second != token and new[3] == second


def test_digit_permutation_is_one_to_one(spark):
    frame = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = frame.select("d", pseudonyms.permute_digits(F.col("d"), "k", "t").alias("p")).collect()
    assert len({r.p for r in out}) == 1000 and all(len(r.p) == 3 for r in out) and any(r.p != r.d for r in out)


def expected_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return {**fixed, **share}
        for s in over:
            fixed[s] = 3.0 * sizes[s]
            left -= fixed[s]
        if len(fixed) == len(names):
            return fixed


def test_mixture_targets_and_takes(spark):
    rows = []
    for source, count in (("b", 400), ("a", 30), (None, 200), ("é", 50), ("Z", 6)):
        rows += [(len(rows) + i, " ".join(["w"] * (1 + (i * 7) % 23)), "en", source) for i in range(count)]
    rows += [(5000, None, "en", "a"), (5001, "", "en", "b"), (None, "w w w", "en", "b"), (None, "w w", "en", "b"), *[(7, "w w w w", "en", "b")] * 3]
    table = docs(spark, rows)
    got = mixture.mix_report(table).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    wanted = expected_targets(sizes)
    by_size = {n: s for s, n in sizes.items()}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        source = by_size[r.source_size]
        assert math.isclose(r.target, wanted[source], rel_tol=1e-9)
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert not r.size or r.taken // r.size >= min(3, int(wanted[source] // sizes[source]))
        taken[source] += r.taken
    for source, n in taken.items():
        assert abs(n - wanted[source]) <= 4
    assert sorted(map(str, mixture.mix_report(table.repartition(7)).collect())) == sorted(map(str, got))
    mixed = mixture.mix(table)
    assert mixed.columns == table.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(taken.values())


def test_mixture_prefers_good_documents(spark):
    clean, odd = " ".join(["word"] * 20), " ".join(["1#2$"] * 20)
    rows = [(i, clean if i % 2 else odd, "en", "a") for i in range(600)] + [(1000 + i, clean, "en", "b") for i in range(2000)]
    got = mixture.mix_report(docs(spark, rows), weights=(1.0, 20.0)).where("doc_id < 1000").collect()
    good = sum(r.taken > 0 for r in got if r.doc_id % 2)
    assert good > 3 * sum(r.taken > 0 for r in got if r.doc_id % 2 == 0) > 0


@pytest.mark.parametrize("text", ["", None])
def test_only_empty_texts(spark, text):
    table = docs(spark, [(1, text, "en", "a"), (2, text, None, None)])
    assert [r.taken for r in mixture.mix_report(table).collect()] == [0, 0]
    assert [r.kept for r in quality.quality_report(table).collect()] == [False, False]
