"""Keyed, format-preserving pseudonyms for personal data: a Feistel permutation within each value's format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Rounds of the permutation.
ROUNDS = 8

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
PHONE = (
    r"(?<![\p{L}\d+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?<![\d.+-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])"
)
DATE = (
    r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{1,2}/\d{1,2}/\d{4}(?![\d/])"
    r"|(?<![\d.])\d{1,2}\.\d{1,2}\.\d{4}(?!\.?\d)"
)
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
CARD = r"(?<!\d)(?:\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{4} \d{4} \d{4}|\d{13,19})(?!\d)"
ANY = "|".join([EMAIL, PHONE, DATE, SSN, ADDRESS, CARD])

#: Dates in this range are permuted among themselves: 2^16 days from the first on.
FIRST_DAY = "1900-01-01"
LAST_DAY = "2079-06-06"


def _digest(key: str, kind: str, step: Column, half: Column) -> Column:
    """The round function: hexadecimal digits that depend on key, kind, round and the other half."""
    return F.sha2(F.concat(F.lit(f"{key}:{kind}:"), step.cast("string"), F.lit(":"), half.cast("string")).cast("binary"), 512)


def _rotate(c: Column, by: Column) -> Column:
    """A digit or letter moved on within its class; other characters stay."""

    def within(first: str, size: int) -> Column:
        start = ord(first)
        return F.char(F.pmod(F.ascii(c) - start + by, F.lit(size)) + start)

    return (
        F.when(c.rlike("^[0-9]$"), within("0", 10))
        .when(c.rlike("^[a-z]$"), within("a", 26))
        .when(c.rlike("^[A-Z]$"), within("A", 26))
        .otherwise(c)
    )


def _moved(half: Column, digest: Column) -> Column:
    """A half with every character moved by its own part of the digest."""
    parts = F.regexp_extract_all(digest, F.lit("(.{4})"), F.lit(1))
    length = F.char_length(half)
    enough = F.slice(F.flatten(F.array_repeat(parts, F.floor(length / 32).cast("int") + 1)), 1, length)
    moved = F.zip_with(F.split(half, ""), enough, lambda c, p: _rotate(c, F.conv(p, 16, 10).cast("int")))
    return F.when(length == 0, half).otherwise(F.array_join(moved, ""))


def _alternate(left: Column, right: Column, change: Callable[[Column, Column, Column], Column]) -> Column:
    """The network: in turn, change one half by a digest of the other. Each round can be undone, so it permutes."""

    def step(state: Column, k: Column) -> Column:
        changed_left = F.struct(change(state["l"], state["r"], k).alias("l"), state["r"].alias("r"))
        changed_right = F.struct(state["l"].alias("l"), change(state["r"], state["l"], k).alias("r"))
        return F.when(k % 2 == 0, changed_left).otherwise(changed_right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.alias("l"), right.alias("r")), step)


def permuted_text(value: Column, key: str, kind: str) -> Column:
    """Permute the digits and letters of a value; their places and classes, and all else, stay."""
    middle = F.floor(F.char_length(value) / 2).cast("int")
    left, right = F.substring(value, F.lit(1), middle), F.substring(value, middle + 1, F.char_length(value))
    return F.transform(
        F.array(_alternate(left, right, lambda own, other, k: _moved(own, _digest(key, kind, k, other)))),
        lambda s: F.concat(s["l"], s["r"]),
    )[0]


def permuted_number(value: Column, bits: int, key: str, kind: str) -> Column:
    """Permute the integers of ``2 * bits`` bits."""
    size = 1 << bits
    left, right = F.floor(value / size).cast("long"), F.pmod(value, F.lit(size)).cast("long")

    def change(own: Column, other: Column, k: Column) -> Column:
        part = F.conv(F.substring(_digest(key, kind, k, other), 1, 8), 16, 10).cast("long")
        return own.bitwiseXOR(F.pmod(part, F.lit(size)))

    return F.transform(F.array(_alternate(left, right, change)), lambda s: s["l"] * size + s["r"])[0]


def _luhn_sum(digits: Column, doubled_from: int) -> Column:
    """The checksum's sum; the last digit is doubled if ``doubled_from`` is 0, else the one before it."""
    reverse = F.split(F.reverse(digits), "")
    values = F.transform(
        reverse,
        lambda c, i: F.when(i % 2 == doubled_from, F.pmod(c.cast("int") * 2 - 1, F.lit(9)) + F.when(c == "0", -8).otherwise(1)).otherwise(
            c.cast("int")
        ),
    )
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _card(value: Column, key: str) -> Column:
    """A number with a valid check digit gets a permuted body and that body's check digit; others stay."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    valid = _luhn_sum(digits, 1) % 10 == 0
    body = permuted_text(F.substring(value, F.lit(1), F.char_length(value) - 1), key, "card")
    checked = F.transform(
        F.array(body), lambda b: F.concat(b, F.pmod(-_luhn_sum(F.regexp_replace(b, "[^0-9]", ""), 0), F.lit(10)).cast("string"))
    )[0]
    return F.when(valid, checked).otherwise(value)


def _address(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p)
    valid = ~F.exists(parts, lambda p: p > 255)
    new = F.transform(
        F.array(permuted_number(number, 16, key, "address")),
        lambda n: F.concat_ws(".", *[F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]),
    )[0]
    return F.when(valid, new).otherwise(value)


def _date(value: Column, key: str) -> Column:
    """A real date becomes another one in the same notation; the same day in any notation becomes the same day."""
    result = value
    base = F.unix_date(F.lit(FIRST_DAY).cast("date"))
    notations = [
        (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"), (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
        (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    ]
    for shape, notation in reversed(notations):
        day = F.try_to_timestamp(value, F.lit(notation)).cast("date")
        index = permuted_number((F.unix_date(day) - base).cast("long"), 8, key, "date")
        new = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), index.cast("int")), notation)
        fits = value.rlike(shape) & day.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))
        result = F.when(F.coalesce(fits, F.lit(False)), new).otherwise(result)
    return result


def _pseudonym(value: Column, key: str) -> Column:
    local = F.substring_index(value, "@", 1)
    email = F.concat(permuted_text(local, key, "email"), F.lit("@"), F.substring_index(value, "@", -1))
    country = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(value, F.char_length(country) + 1, F.char_length(value))
    phone = F.concat(country, permuted_text(rest, key, "phone"))
    return (
        F.when(value.contains("@"), email)
        .when(value.rlike(f"^(?:{DATE})$"), _date(value, key))
        .when(value.rlike(f"^(?:{SSN})$"), permuted_text(value, key, "ssn"))
        .when(value.rlike(f"^(?:{ADDRESS})$"), _address(value, key))
        .when(value.rlike(f"^(?:{CARD})$"), _card(value, key))
        .otherwise(phone)
    )


def pseudonymised(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """Replace personal data in the whole text of every row: ``doc`` (all columns), ``new_text``, ``n_replaced``.

    Found are e-mail addresses (their local part), telephone numbers, social security numbers, IPv4
    addresses with octets up to 255, card numbers with a valid check digit, and real dates from
    ``FIRST_DAY`` to ``LAST_DAY``. What looks alike but is not valid stays. A value is permuted within
    its format by a Feistel network whose round function is keyed: lengths, separators, country codes, check
    digits and notations hold, and equal values have equal pseudonyms in every document. Whoever has the key can undo it; pass a secret one.

    NULL stays NULL with nothing replaced; empty and blank texts stay as they are, as does everything around
    the values. Repeated rows are treated alike; texts of any length are read whole. Built-in expressions only, no exchange.
    """
    text = docs[text_column]
    matched = docs.select(
        F.struct("*").alias("doc"),
        text.alias("text"),
        F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).alias("old"),
    )
    renamed = matched.withColumn("new", F.when(F.size("old") > 0, F.transform("old", lambda v: _pseudonym(v, key))))
    woven = F.array_join(
        F.zip_with(F.split("text", ANY, -1), F.col("new"), lambda between, v: F.concat(between, F.coalesce(v, F.lit("")))), ""
    )
    differ = F.size(F.filter(F.zip_with("old", "new", lambda a, b: a != b), lambda x: x))
    return renamed.select(
        "doc",
        F.when(F.col("new").isNotNull(), woven).otherwise(F.col("text")).alias("new_text"),
        F.when(F.col("new").isNotNull(), differ).otherwise(0).cast("long").alias("n_replaced"),
    )
