"""Checks of single values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions import patterns as P


#: The e-mail pattern, asked only where a run of its first characters starts or a match has ended: from any later place
#: in a run the same sign and domain follow. What comes before the first word boundary is passed over; group 1 is the address.
_LOCAL = r"[A-Za-z0-9._%+\-]"
EMAIL_FROM_RUN = rf"(?U)(?:(?<!{_LOCAL})|\G)(?:(?!\b){_LOCAL})*+(" + P.EMAIL.replace("+@", "++@") + ")"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(value: Column) -> Column:
    """The ASCII digits of a value."""
    return F.regexp_replace(value, "[^0-9]", "")


def digit_count(value: Column) -> Column:
    return F.length(digits(value))


def _numbers(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: c.cast("int"))


def luhn_valid(value: Column) -> Column:
    """13 to 19 ASCII digits whose Luhn sum is a multiple of ten."""
    doubled = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = lambda t: F.aggregate(F.transform(_numbers(F.reverse(t)), doubled), F.lit(0), lambda a, x: a + x)
    return let(digits(value), lambda t: F.length(t).between(13, 19) & F.when(F.length(t) > 0, total(t) % 10 == 0).otherwise(False))


def tckn_valid(value: Column) -> Column:
    """Eleven ASCII digits, the first not zero, the last two check digits of the others."""
    at = lambda n, i: F.get(n, F.lit(i))
    total = lambda n, of: sum((at(n, i) for i in of[1:]), at(n, of[0]))
    tenth = lambda n: F.pmod(total(n, (0, 2, 4, 6, 8)) * 7 - total(n, (1, 3, 5, 7)), F.lit(10))
    checks = lambda n: (at(n, 0) != 0) & (at(n, 9) == tenth(n)) & (at(n, 10) == total(n, tuple(range(10))) % 10)
    return let(digits(value), lambda t: F.when(F.length(t) == 11, let(_numbers(t), checks)).otherwise(False))


def is_placeholder(value: Column) -> Column:
    """The whole value is a placeholder; a line break after it does not count as its end."""
    return value.rlike(rf"(?U)\A{P.PLACEHOLDER}\z")


def digit_isolated(text: Column, start: Column, end: Column) -> Column:
    """Neither neighbour of the code points [start, end) is an ASCII digit."""
    before = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise("")
    after = F.substring(text, end + 1, F.lit(1))
    return ~before.rlike("[0-9]") & ~after.rlike("[0-9]")


def password_value(value: Column) -> Column:
    return F.length(F.btrim(value, F.lit("\"'"))) >= 3


def credential(value: Column) -> Column:
    """The trimmed token has a letter, an ASCII digit and a special character, and is no address, link or placeholder."""
    trimmed = F.ltrim(F.rtrim(value, F.lit(P.TRIM_END)), F.lit(P.TRIM_START))

    def judged(v: Column) -> Column:
        bad = F.contains(v, F.lit("://")) | F.startswith(F.lower(v), F.lit("www.")) | is_placeholder(v) | v.rlike(EMAIL_FROM_RUN)
        special = "[" + "".join("\\" + c for c in P.CREDENTIAL_SPECIALS) + "]"
        return (F.length(v) >= 6) & ~bad & v.rlike(r"\p{IsAlphabetic}") & v.rlike("[0-9]") & v.rlike(special)

    return let(trimmed, judged)


#: Detector name -> check of a matched value.
VALID = {
    "labelled_password": password_value,
    "credential": credential,
    "credit_card": luhn_valid,
    "national_id": tckn_valid,
    "phone": lambda v: digit_count(v).between(10, 12),
    "phone_international": lambda v: digit_count(v).between(9, 14),
}
ISOLATED = ("phone", "phone_international")
