"""Format-preserving pseudonyms for personal numbers, dates and names of mailboxes.

A found value is validated first: card numbers by their check digit, addresses by the range
of their parts, dates by the calendar. Its digits then go through a keyed Feistel network, a
permutation of all digit strings of that length, so the result has the same format and equal values
get equal pseudonyms in every document. Separators and prefixes stay. A card number gets a
fitting check digit; a date becomes another date of the 400-year cycle from 1800 to 2199 in the same form and order; an
address becomes another address. With the key, ``inverse=True`` restores all of these.
The name before a mail domain and 40-digit access tokens are replaced by letters and digits
of a keyed digest of the same length, which links equal values but can't be restored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leakscan.llm.common import let, packed_row

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
TOKEN = r"(?<![0-9A-Za-z])(?:[0-9a-f]{40}|[0-9A-F]{40})(?![0-9A-Za-z])"
ADDRESS = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
DATE_FORM = r"\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4}"
DATE = rf"(?<![\d/.-])(?:{DATE_FORM})(?![\d/-]|\.\d)"
# International numbers: with an area code in brackets, of country code 1, and others of 8 to 15 digits in groups.
ABROAD = (
    r"\+\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|\+(?!\d{16})(?=(?:[ .()-]{0,2}\d){8})\d{1,3}(?:[ .-]?\(\d{1,4}\))?[ .-]?\d{1,4}(?:[ .-]?(?!\d{4}-\d)\d{2,4}){1,4}(?!\d)"
)
# National numbers: 3-3-4 digits, and those that begin with a 0.
TEN = r"(?:1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
HOME = (
    rf"{TEN}"
    r"|0\d(?:[ .-]\d{2}){4}"
    r"|(?:\(0\d{1,4}\) ?|0\d{1,4}[ /-])\d{3,4}[ -]?\d{3,4}"
)
PHONE = rf"(?<![\d+])(?:{ABROAD})|(?<![\w+./-])(?:{HOME})(?![\w/]|[.-]\d)"
SOCIAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)(?:\d{4}(?<quad>[ -])\d{4}\k<quad>\d{4}\k<quad>\d{4}|\d{4}(?<six>[ -])\d{6}\k<six>\d{4,5}|\d{13,19})(?!\d)"
#: The days of 400 years are 189 * 773, and day 0 of the cycle is 1800-01-01.
CYCLE = (189, 773)
FIRST_DAY = "1800-01-01"
#: Steps to a date of the same form; at least a fifth of all dates has each form, so none is left out.
STEPS = 256

# A mailbox can have a name of digits only, so EMAIL stands before CARD.
ANY = "|".join([EMAIL, CARD, TOKEN, PHONE, ADDRESS, DATE, SOCIAL])


def _round_value(key: str, kind: str, size: Column, step: Column, half: Column) -> Column:
    """60 bits that depend on key, kind, length, round and one half."""
    text = F.concat(F.lit(f"{key}|{kind}|"), size.cast("string"), F.lit("|"), step.cast("string"), F.lit("|"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """A keyed permutation of all pairs (left < left_size, right < right_size); struct with ``x`` and ``y``."""
    length = left_size + right_size

    def forward(s: Column, i: Column) -> Column:
        modulus = F.when(i % 2 == 1, left_size).otherwise(right_size)
        return F.struct(s["y"].alias("x"), F.pmod(s["x"] + _round_value(key, kind, length, i, s["y"]), modulus).alias("y"))

    def backward(s: Column, i: Column) -> Column:
        modulus = F.when(i % 2 == 1, left_size).otherwise(right_size)
        return F.struct(F.pmod(s["y"] - _round_value(key, kind, length, i, s["x"]), modulus).alias("x"), s["x"].alias("y"))

    steps = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    start = F.struct(left.cast("long").alias("x"), right.cast("long").alias("y"))
    return F.aggregate(steps, start, backward if inverse else forward)


def permute_digits(digits: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """Another string of as many digits (2 to 36), one to one."""
    head = F.floor(F.length(digits) / 2).cast("int")
    tail = F.length(digits) - head
    power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    pair = feistel(F.substr(digits, F.lit(1), head), F.substr(digits, head + 1), power(head), power(tail), key, kind, inverse)
    return let(pair, lambda p: F.concat(F.lpad(p["x"].cast("string"), head, "0"), F.lpad(p["y"].cast("string"), tail, "0")))


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string; a multiple of 10 for valid card numbers."""

    def add(total: Column, i: Column) -> Column:
        x = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced one by one."""
    chars = F.split(value, "")

    def put(s: Column, c: Column) -> Column:
        hit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["text"], F.when(hit, F.substr(digits, s["next"], F.lit(1))).otherwise(c)).alias("text"),
            (s["next"] + hit.cast("int")).alias("next"),
        )

    return F.aggregate(chars, F.struct(F.lit("").alias("text"), F.lit(1).alias("next")), put)["text"]


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(value: Column, key: str, inverse: bool) -> Column:
    def swap(d: Column) -> Column:
        body = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", inverse)
        sealed = let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(_luhn(d) % 10 == 0, _refill(value, sealed)).otherwise(value)

    return let(_only_digits(value), swap)


def _address(value: Column, key: str, inverse: bool) -> Column:
    parts = F.transform(F.split(value, "\\."), lambda x: x.cast("long"))

    def swap(p: Column) -> Column:
        size = F.lit(65536).cast("long")
        pair = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], size, size, key, "address", inverse)
        text = let(pair, lambda q: F.concat_ws(".", *[
            x.cast("string") for half in ("x", "y") for x in (F.shiftright(q[half], 8), q[half] % 256)]))
        plain = F.array_join(F.transform(p, lambda x: x.cast("string")), ".") == value
        return F.when((F.array_max(p) < 256) & plain, text).otherwise(value)

    return let(parts, swap)


def _date(value: Column, key: str, inverse: bool) -> Column:
    """Another date in the same form.

    The year stands first or last. With the year last, the day comes first if that is a date, else the month may (not with
    dots). One-digit parts stay one digit. A form that not all dates have is met by permuting until a date has it, which the inverse undoes.
    """
    parts = F.split(value, "[/.-]")
    first = F.regexp_extract(value, "[/.-]", 0)

    def as_day(year: Column, month: Column, day: Column) -> Column:
        iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
        return F.datediff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")

    rows, columns = (F.lit(n).cast("long") for n in CYCLE)
    date_of = lambda d: F.date_add(F.lit(FIRST_DAY).cast("date"), d.cast("int"))

    def once(d: Column) -> Column:
        return let(feistel(F.floor(d / columns), d % columns, rows, columns, key, "date", inverse), lambda p: p["x"] * columns + p["y"])

    def swap(s: Column) -> Column:
        p, by_month, year_first = s["parts"], s["by_month"], s["year_first"]
        month_at = F.when(year_first | ~by_month, F.lit(2)).otherwise(F.lit(1))
        day_at = F.when(year_first, F.lit(3)).when(by_month, F.lit(2)).otherwise(F.lit(1))
        short_month, short_day = (F.length(F.element_at(p, at)) == 1 for at in (month_at, day_at))

        def fits(d: Column) -> Column:
            return let(date_of(d), lambda m: (~short_month | (F.month(m) < 10)) & (~short_day | (F.day(m) < 10)) & (~by_month | (F.day(m) > 12)))

        def step(found: Column, _: Column) -> Column:
            return F.when(found["done"], found).otherwise(let(once(found["d"]), lambda d: F.struct(d.alias("d"), fits(d).alias("done"))))

        def written(d: Column) -> Column:
            number = lambda n, short: F.when(short, n.cast("string")).otherwise(F.lpad(n.cast("string"), 2, "0"))
            joined = lambda a, b, c: F.concat(a, s["first"], b, s["first"], c)
            month, day, year = number(F.month(d), short_month), number(F.day(d), short_day), F.year(d).cast("string")
            return F.when(year_first, joined(year, month, day)).when(
                by_month, joined(month, day, year)).otherwise(joined(day, month, year))

        walk = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(s["d"].alias("d"), F.lit(False).alias("done")), step)
        plain = ~short_month & ~short_day & ~by_month
        moved = F.when(plain, F.struct(once(s["d"]).alias("d"), F.lit(True).alias("done"))).otherwise(walk)
        return F.when((s["d"] >= 0) & (s["d"] < rows * columns), let(moved, lambda m: F.when(m["done"], written(date_of(m["d"]))).otherwise(value))).otherwise(value)

    def read(p: Column) -> Column:
        year_first = F.length(p[0]) == 4
        days_first = F.when(year_first, as_day(p[0], p[1], p[2])).otherwise(as_day(p[2], p[1], p[0]))
        by_month = days_first.isNull() & ~year_first & (first != ".")
        day = F.when(by_month, as_day(p[2], p[0], p[1])).otherwise(days_first)
        return F.struct(p.alias("parts"), first.alias("first"), year_first.alias("year_first"), by_month.alias("by_month"), day.alias("d"))

    return let(let(parts, read), swap)


def _phone(value: Column, key: str, inverse: bool) -> Column:
    """The country code or leading 0 or 1 stays; the digits after it are permuted."""
    bracket = F.locate("(", value)
    known = value.rlike(r"^\+\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}$")
    head = F.regexp_extract(value, r"^(?:\+1|\+\d{1,3}(?=[ .(-])|\+\d|\(?0)", 0)
    head = F.when(value.rlike(f"^(?:{TEN})$"), F.regexp_extract(value, r"^(?:1[ .-])?", 0)).otherwise(head)
    cut = F.when(known, bracket).otherwise(F.length(head) + 1)
    local = F.substr(value, cut)
    return F.concat(F.substr(value, F.lit(1), cut - 1), _refill(local, permute_digits(_only_digits(local), key, "phone", inverse)))


def _digest_like(value: Column, key: str, kind: str) -> Column:
    """As many hexadecimal digits of keyed digests as ``value`` has characters."""
    digest = lambda i: F.sha2(F.concat(F.lit(f"{key}|{kind}|"), i.cast("string"), F.lit("|"), value), 256)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 64).cast("int")), digest)
    return F.substr(F.array_join(blocks, ""), F.lit(1), F.length(value))


def pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one found value; a value that fails its check stays as it is."""
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    at = F.locate("@", value)
    mail, token = (value, value) if inverse else (
        F.concat(_digest_like(F.substr(value, F.lit(1), at - 1), key, "mail"), F.substr(value, at)),
        F.when(value.rlike("[a-f]"), _digest_like(value, key, "token")).otherwise(F.upper(_digest_like(value, key, "token"))),
    )
    return (
        F.when(at > 0, mail)
        .when(F.substr(value, F.lit(1), F.lit(1)) == "+", _phone(value, key, inverse))
        .when(whole(r"[0-9A-Fa-f]{40}"), token)
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), _address(value, key, inverse))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), _refill(value, permute_digits(_only_digits(value), key, "social", inverse)))
        .when(whole(DATE_FORM), _date(value, key, inverse))
        .when(whole(HOME), _phone(value, key, inverse))
        .otherwise(_card(value, key, inverse))
    )


def _replace(text: Column, key: str, inverse: bool) -> Column:
    """Struct of the new text and the numbers of values found and changed."""

    def joined(old: Column, new: Column) -> Column:
        pieces = F.zip_with(F.split(text, ANY, -1), new, lambda part, value: F.concat(part, F.coalesce(value, F.lit(""))))
        changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x))
        return F.struct(F.array_join(pieces, "").alias("text"), F.size(old).alias("found"), changed.alias("changed"))

    none = F.struct(text.alias("text"), F.lit(0).alias("found"), F.lit(0).alias("changed"))
    found = F.regexp_extract_all(text, F.lit(ANY), 0)
    swapped = let(found, lambda old: F.when(F.size(old) == 0, none).otherwise(
        let(F.transform(old, lambda value: pseudonym(value, key, inverse)), lambda new: joined(old, new))))
    return F.when(text.rlike("[0-9@]"), swapped).otherwise(none)


def _with_new_text(docs: DataFrame, key: str, inverse: bool) -> DataFrame:
    return packed_row(docs, new=_replace(docs["text"], key, inverse))


def pseudonymize(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; all other columns stay.

    Null and empty texts stay as they are; repeated rows get equal texts; an empty table stays empty.
    Lengths change only where an address gets parts of other lengths; ``n_chars``, if present, follows the new text.
    """
    row = F.col("row")
    new = {"text": F.col("new.text"), "n_chars": F.when(row["n_chars"].isNotNull(), F.length("new.text")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    columns = [new.get(n, row[n]).alias(n) for n in docs.columns]
    return _with_new_text(docs, key, inverse).select(*columns)


def pseudonym_report(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id``, the new ``text``, and how many values were found and changed."""
    return _with_new_text(docs, key, False).select("row.doc_id", "new.text", F.coalesce("new.found", F.lit(0)).alias("n_found"), F.coalesce("new.changed", F.lit(0)).alias("n_changed"))
