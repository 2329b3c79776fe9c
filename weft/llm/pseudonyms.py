"""Format-preserving Feistel pseudonyms, in DataFrame functions only.

Personal values are found by one pattern and validated; a valid value is replaced by
a keyed permutation of its own format, so equal values stay linked in all documents
and the written form (spaces, dashes, brackets, order of a date) is kept:

- payment cards (13-19 digits, Luhn): the first digit stays, the others are permuted,
  the check digit is made anew. Groups of digits with one space or dash between them are
  read as a whole: a valid undivided, 4-4-4-4 or 4-6-5 number comes first, then the
  longest valid run of whole groups, from the left; neighbouring groups (a CVV, an
  expiry date) stay. Groups that look like a date, a social security or a telephone
  number are taken as such;
- dates (1600-2399; 2024-01-31, also with a time behind T, 2024/01/31, 31.01.2024,
  31/01/2024, 1/2/2024): permuted among the 146,097 days of their 400 years; where day
  or month had one digit, both are written without leading zeros;
- telephone numbers of ten digits with area and exchange of 200-999, with or without
  country code 1: permuted among such numbers;
- social security numbers and IPv4 addresses: permuted among valid ones;
- e-mail addresses and secrets (access keys, hex keys of 32 digits or more, values of
  password=, token= and the like) have no numeric format: a keyed digest of the same
  shape takes their place.

The Feistel rounds add a keyed SHA-256 of one half to the other, modulo the half's
size, so each format is permuted within itself. Numbers that fail validation stay.

Null texts stay null, empty texts empty, both with counts of 0. Every input row gives
one row; columns of the same name as an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
EDGE, END = r"(?<![0-9A-Za-z_.@-])", r"(?![0-9A-Za-z_@]|[.-][0-9A-Za-z])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
NAMED = r"(?<=\b(?:password|passwd|pwd|secret|token|api_key|apikey)=)[^\s\"',;<>]{4,}+"
ACCESS_KEY = r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
HEX_KEY = r"(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,128}+(?![0-9A-Za-z])"
ADDRESS = EDGE + r"\d{1,3}(?:\.\d{1,3}){3}" + END
SHORT_DATE = r"\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}"
DATE = EDGE + r"(?:\d{4}-\d{2}-\d{2}(?=T\d{2})|(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|" + SHORT_DATE + ")" + END + ")"
SOCIAL = EDGE + r"\d{3}-\d{2}-\d{4}" + END
PHONE = r"(?<![0-9A-Za-z_.@+-])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}" + END
#: The end of a group of digits, and what divides it from the next one of the same run.
GROUP_END = r"(?![0-9A-Za-z_@]|\.[0-9A-Za-z]|-[A-Za-z])"
NEXT = f"[ -](?!{DATE}|{SOCIAL}|{PHONE})(?=\\d)"
#: All groups of a run, if the whole ones have 13 digits or more; possessive, so that a long run needs no stack.
CARD = (
    EDGE + rf"(?=(?:\d(?:(?=\d)|{GROUP_END}{NEXT})){{12}}\d++{GROUP_END})"
    rf"\d++(?:{NEXT}\d++{GROUP_END})*+"
)
FOUND = "|".join((EMAIL, NAMED, ACCESS_KEY, HEX_KEY, ADDRESS, DATE, SOCIAL, PHONE, CARD))
WHOLE = {
    "email": "@", "address": r"^\d{1,3}(?:\.\d{1,3}){3}$",
    "date": r"^(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|" + SHORT_DATE + ")$", "social": r"^\d{3}-\d{2}-\d{4}$",
    "phone": r"^(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}$",
    "card": r"^(?=(?:[ -]?\d){13})\d++(?:[ -]\d++)*+$", "access": r"^AKIA[0-9A-Z]{16}$",
}
USUAL_CARD = r"^(?:\d+|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})[ -]?$"
KINDS = ("email", "secret", "address", "date", "social", "phone", "card")


def keyed(key: str, tag: str, round_: Column, half: Column) -> Column:
    """60 keyed pseudorandom bits."""
    text = F.concat_ws("|", F.lit(key), F.lit(tag), round_.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, left: Column, right: Column, key: str, tag: str) -> Column:
    """Keyed permutation of 0 .. left * right - 1; the halves are added to in turn."""
    def turn(halves: Column, k: Column) -> Column:
        l, r = halves["l"], halves["r"]
        return F.struct(
            F.when(k % 2 == 0, (l + keyed(key, tag, k, r)) % left).otherwise(l).alias("l"),
            F.when(k % 2 == 1, (r + keyed(key, tag, k, l)) % right).otherwise(r).alias("r"),
        )

    start = F.struct(
        F.floor((value - value % right) / right).cast("long").alias("l"), (value % right).alias("r")
    )
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda h: h["l"] * right + h["r"]
    )


def long_(n: int) -> Column:
    return F.lit(n).cast("long")


def filled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in turn by ``digits``."""
    def step(done: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(
            F.when(digit, done["k"] + 1).otherwise(done["k"]).alias("k"),
            F.concat(done["out"], F.when(digit, F.substr(digits, done["k"], F.lit(1))).otherwise(c)).alias("out"),
        )

    start = F.struct(F.lit(1).alias("k"), F.lit("").alias("out"))
    return F.aggregate(F.split(form, ""), start, step, lambda done: done["out"])


def luhn_sum(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).try_cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)


def card(m: Column, digits: Column, key: str) -> Column:
    n = F.length(digits)
    left, right = (F.round(F.pow(F.lit(10.0), x)).cast("long") for x in (F.ceil((n - 2) / 2), F.floor((n - 2) / 2)))
    inner = F.substr(digits, F.lit(2), n - 2).try_cast("long")
    tag = "card"
    new = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lpad(feistel(inner, left, right, key, tag).cast("string"), n - 2, F.lit("0")))
    check = (10 - luhn_sum(F.concat(new, F.lit("0"))) % 10) % 10
    return filled(m, F.concat(new, check.cast("string")))


def bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def cards(m: Column, key: str) -> Column:
    """struct(value, kind, n): a run of groups of digits with its ``n`` valid cards replaced; null without any."""
    return bound(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0)), lambda groups: _cards(groups, key))


def _cards(groups: Column, key: str) -> Column:
    n = F.size(groups)

    def joined(i: Column, size: Column) -> Column:
        return F.array_join(F.slice(groups, i + 1, size), "")

    def only_digits(text: Column) -> Column:
        return F.regexp_replace(text, "[^0-9]", "")

    def valid(i: Column, size: Column) -> Column:
        return bound(
            only_digits(joined(i, size)), lambda digits: F.when(F.length(digits).between(13, 19), luhn_sum(digits) % 10 == 0).otherwise(False)
        )

    def longest(i: Column) -> Column:
        sizes = F.filter(F.sequence(F.lit(1), F.least(F.lit(19), n - i)), lambda size: valid(i, size))
        return bound(sizes, lambda some: F.struct(
            F.coalesce(F.array_max(F.filter(some, lambda size: joined(i, size).rlike(USUAL_CARD))), F.lit(0)).alias("usual"),
            F.coalesce(F.array_max(some), F.lit(0)).alias("any"),
        ))

    def replaced(starts: Column) -> Column:
        def step(done: Column, i: Column) -> Column:
            at = F.element_at(starts, i + 1)
            later = F.exists(F.slice(starts, i + 2, F.greatest(at["any"] - 1, F.lit(0))), lambda x: x["usual"] > 0)
            size = F.when(i < done["next"], 0).when(at["usual"] > 0, at["usual"]).when(later, 0).otherwise(at["any"])

            def taken(size: Column) -> Column:
                text = joined(i, size)
                new = F.when(size > 0, card(text, only_digits(text), key)).when(i < done["next"], "").otherwise(F.element_at(groups, i + 1))
                return F.struct(
                    F.concat(done["out"], new).alias("out"), F.when(size > 0, i + size).otherwise(done["next"]).alias("next"),
                    (done["n"] + F.when(size > 0, 1).otherwise(0)).alias("n"),
                )

            return bound(size, taken)

        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("next"), F.lit(0).alias("n"))
        return F.aggregate(
            F.sequence(F.lit(0), n - 1), start, step, lambda done: F.struct(done["out"].alias("value"), F.lit("card").alias("kind"), done["n"].alias("n"))
        )

    starts = F.transform(F.sequence(F.lit(0), n - 1), longest)
    return bound(starts, lambda some: F.when(F.exists(some, lambda x: x["any"] > 0), replaced(some)))


def phone(m: Column, digits: Column, key: str) -> Column:
    ten = F.substr(digits, F.length(digits) - 9, F.lit(10))
    area, exchange, line = (F.substr(ten, F.lit(a), F.lit(n)).try_cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
    new = feistel(((area - 200) * 800 + exchange - 200) * 10_000 + line, long_(80_000), long_(80_000), key, "phone")
    high = F.floor((new - new % 10_000) / 10_000).cast("long")
    head = F.floor((high - high % 800) / 800).cast("long")
    shown = F.concat(
        F.substr(digits, F.lit(1), F.length(digits) - 10), (head + 200).cast("string"),
        (high % 800 + 200).cast("string"), F.lpad((new % 10_000).cast("string"), 4, "0"),
    )
    return filled(m, shown)


def social(m: Column, digits: Column, key: str) -> Column:
    area, group, serial = (F.substr(digits, F.lit(a), F.lit(n)).try_cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    new = feistel((place * 99 + group - 1) * 9_999 + serial - 1, long_(898 * 99), long_(9_999), key, "social")
    high = F.floor((new - new % 9_999) / 9_999).cast("long")
    head = F.floor((high - high % 99) / 99).cast("long")
    shown = F.concat(
        F.lpad(F.when(head >= 665, head + 2).otherwise(head + 1).cast("string"), 3, "0"),
        F.lpad((high % 99 + 1).cast("string"), 2, "0"), F.lpad((new % 9_999 + 1).cast("string"), 4, "0"),
    )
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, filled(m, shown))


def address(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, "\\."), lambda p: p.try_cast("long"))
    value = F.aggregate(parts, F.expr("0L"), lambda total, p: total * 256 + p)
    new = feistel(value, long_(65_536), long_(65_536), key, "address")
    octets = F.transform(
        F.array(*[F.lit(k) for k in (24, 16, 8, 0)]),
        lambda k: F.floor(new / F.pow(F.lit(2.0), k)).cast("long") % 256,
    )
    return F.when(~F.exists(parts, lambda p: p > 255), F.array_join(octets.cast("array<string>"), "."))


def date(m: Column, digits: Column, key: str) -> Column:
    """Day first where the year stands last, month first where only that is a date."""
    year_first = m.rlike("^[0-9]{4}")
    parts = F.transform(F.split(m, "[-/.]"), lambda p: F.when(F.length(p) == 1, F.concat(F.lit("0"), p)).otherwise(p))
    padded = F.array_join(parts, "")
    unpadded = F.length(padded) > F.length(digits)
    year = F.when(year_first, F.substr(padded, F.lit(1), F.lit(4))).otherwise(F.substr(padded, F.lit(5), F.lit(4)))
    a = F.when(year_first, F.substr(padded, F.lit(5), F.lit(2))).otherwise(F.substr(padded, F.lit(3), F.lit(2)))
    b = F.when(year_first, F.substr(padded, F.lit(7), F.lit(2))).otherwise(F.substr(padded, F.lit(1), F.lit(2)))
    plain = F.try_to_timestamp(F.concat(year, a, b), F.lit("yyyyMMdd")).cast("date")
    swapped = F.try_to_timestamp(F.concat(year, b, a), F.lit("yyyyMMdd")).cast("date")
    american = plain.isNull() & ~year_first
    day = F.coalesce(plain, F.when(american, swapped))
    origin = F.lit("1600-01-01").cast("date")
    since = F.datediff(day, origin).cast("long")
    new = since - since % 146_097 + feistel(since % 146_097, long_(189), long_(773), key, "date")
    made = F.date_add(origin, new.cast("int"))
    shown = (
        F.when(year_first, F.date_format(made, "yyyyMMdd"))
        .when(american, F.date_format(made, "MMddyyyy")).otherwise(F.date_format(made, "ddMMyyyy"))
    )
    mark = F.when(m.contains("/"), "/").otherwise(".")
    short = F.concat_ws("", F.date_format(made, "M"), mark, F.date_format(made, "d"), mark, F.date_format(made, "yyyy"))
    short_day_first = F.concat_ws("", F.date_format(made, "d"), mark, F.date_format(made, "M"), mark, F.date_format(made, "yyyy"))
    valid = day.isNotNull() & (year >= "1600") & (year < "2400")
    written = F.when(unpadded, F.when(american, short).otherwise(short_day_first)).otherwise(filled(m, shown))
    return F.when(valid, written)


def letters(text: Column, key: str, tag: str, n: Column) -> Column:
    return F.translate(F.substr(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), text), 256), F.lit(1), n), "0123456789abcdef", "abcdefghijklmnop")


def email(m: Column, key: str) -> Column:
    low = F.lower(m)
    return F.concat(
        letters(low, key, "email", F.lit(12)), F.lit("@"),
        letters(F.substring_index(low, "@", -1), key, "domain", F.lit(8)), F.lit(".example"),
    )


def secret(m: Column, key: str) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), m), 256)
    access = F.concat(F.lit("AKIA"), F.upper(letters(m, key, "access", F.lit(16))))
    long_digest = F.repeat(digest, F.ceil(F.length(m) / 64).cast("int"))
    return F.when(m.rlike(WHOLE["access"]), access).otherwise(F.substr(long_digest, F.lit(1), F.length(m)))


def pseudonym(m: Column, key: str) -> Column:
    """struct(value, kind, n) of one found text; null or a null value where it fails validation, n is the number of values in it."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    cases = [
        ("email", m.contains("@") & m.rlike("^" + EMAIL + "$"), email(m, key)),
        ("address", m.rlike(WHOLE["address"]), address(m, key)),
        ("date", m.rlike(WHOLE["date"]), date(m, digits, key)),
        ("social", m.rlike(WHOLE["social"]), social(m, digits, key)),
        ("phone", m.rlike(WHOLE["phone"]), phone(m, digits, key)),
    ]

    def of(kind: str, value: Column) -> Column:
        return F.struct(value.alias("value"), F.lit(kind).alias("kind"), F.lit(1).alias("n"))

    made = None
    for name, found, new in cases:
        made = F.when(found, of(name, new)) if made is None else made.when(found, of(name, new))
    return made.when(m.rlike(WHOLE["card"]), cards(m, key)).otherwise(of("secret", secret(m, key)))


def _number(values: Column | str) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda total, x: total + x["n"])


def _of_kind(kind: str) -> Column:
    return _number(F.filter("_valid", lambda x: x["kind"] == kind))


def pseudonymise(documents: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """The documents with pseudonyms in ``text_col`` and, if asked, the count of each kind and of all."""
    text = F.col(text_col).cast("string")
    likely = F.coalesce(text.rlike("[0-9@=]"), F.lit(False))
    found = F.when(likely, F.regexp_extract_all(text, F.lit(FOUND), F.lit(0)))
    rows = documents.withColumn("_found", found)
    rows = rows.withColumn(
        "_made", F.when(F.size("_found") > 0, F.transform("_found", lambda m: pseudonym(m, key)))
    )
    parts = F.split(text, FOUND, -1)
    new = F.array_join(
        F.transform(
            F.arrays_zip(parts.alias("part"), F.col("_made").alias("made"), F.col("_found").alias("old")),
            lambda x: F.concat(x["part"], F.coalesce(x["made"]["value"], x["old"], F.lit(""))),
        ),
        "",
    )
    rows = rows.withColumn(text_col, F.when(F.col("_made").isNotNull(), new).otherwise(text))
    if counts:
        valid = F.coalesce(F.filter("_made", lambda x: x["value"].isNotNull()), F.array().cast("array<struct<value:string,kind:string,n:int>>"))
        rows = rows.withColumn("_valid", valid)
        rows = rows.withColumns(
            {
                **{f"n_{k}": _of_kind(k) for k in KINDS},
                "n_private": _number("_valid"),
            }
        ).drop("_valid")
    return rows.drop("_found", "_made")


def with_length(documents: DataFrame, text_col: str, chars_col: str) -> DataFrame:
    """``chars_col`` set to the number of characters of the text; null texts keep theirs."""
    kind = documents.schema[chars_col].dataType
    return documents.withColumn(chars_col, F.coalesce(F.length(text_col).cast(kind), F.col(chars_col)))
