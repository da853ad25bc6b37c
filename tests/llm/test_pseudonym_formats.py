"""Formats of phone numbers, dates and cards, their inverse, and look-alikes that must stay."""

import re
from datetime import date

from leakscan.llm import pseudonyms

PHONES = [
    "(202) 555-0147", "(202)555-0147", "202-555-0147", "202.555.0147", "202 555 0147", "1-800-555-0199", "+1 202-555-0147", "+12025550147",
    "+1.202.555.0147", "+44 20 7946 0958", "+442079460958", "+44 (0)20 7946 0958", "+49 30 901820", "+33 1 23 45 67 89", "020 7946 0958",
    "(020) 7946 0958", "01632 960001", "030/9018200", "01 23 45 67 89", "+1 (212) 555-0187",
]
CARDS = ["3782 822463 10005", "3782-822463-10005", "378282246310005", "3056 930902 5904"]
BY_MONTH = ["03/25/2024", "3/25/2024", "03-25-2024", "12/31/1999", "02/29/2024"]
BY_DAY = ["25/03/2024", "3/5/2024", "5-3-2024", "05-03-2024", "25-3-2024", "5.3.2024", "29/2/2024", "1.12.2024", "9/10/2023"]
BY_YEAR = ["2024-3-5", "2024/03/25", "2024-02-29"]
STAY = [
    "3782 822463 10006", "3782 822463-10005", "13/13/2024", "31/31/2024", "30/02/2024", "03.25.2024", "1/2/24", "2024-13-01", "2024-02-30", "0/5/2024",
    "+1234", "+1234567890123456", "555-0147", "202-555-01478", "x202-555-0147", "202-555-0147-22", "12-555-0147", "2025550147", "1,234 567 8900000", "version 10.20.30",
]


def replaced(spark, texts, inverse=False):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(pseudonyms.pseudonymize(table, "key", inverse).collect(), key=lambda r: r.doc_id)]


def shape(text):
    return re.sub("[0-9]", "9", text)


def test_each_format_is_found_kept_and_undone(spark):
    values = PHONES + CARDS + BY_MONTH + BY_DAY + BY_YEAR
    texts = [f"see {v}, ok" for v in values]
    new = replaced(spark, texts)
    assert [v for v, a, b in zip(values, texts, new, strict=True) if a == b] == []
    assert [shape(t) for t in new] == [shape(t) for t in texts]
    assert replaced(spark, new, inverse=True) == texts


def test_dates_keep_their_order(spark):
    for values, order in ((BY_MONTH, (2, 0, 1)), (BY_DAY, (2, 1, 0)), (BY_YEAR, (0, 1, 2))):
        for new in replaced(spark, values):
            parts = [int(x) for x in re.split("[/.-]", new)]
            found = date(*(parts[i] for i in order))
            assert order != (2, 0, 1) or found.day > 12


def test_look_alikes_stay(spark):
    texts = [f"see {v}, ok" for v in STAY]
    assert replaced(spark, texts) == texts


def test_mailboxes_of_digits_and_neighbours(spark):
    mails = ["1234567890123456@example.com", "4111111111111111@example.com", "1234567890123@mail.example.org"]
    new = replaced(spark, mails)
    assert all(a.split("@")[0] != b.split("@")[0] and a.split("@")[1] == b.split("@")[1] and len(a) == len(b) for a, b in zip(mails, new, strict=True))
    text = "+44 20 7946 0958 2024-01-02 and 4111 1111 1111 1111 or 10.20.30.40"
    (both,) = replaced(spark, [text])
    assert replaced(spark, [both], inverse=True) == [text]
    assert "7946" not in both and "2024-01-02" not in both and "4111 1111 1111 1111" not in both
