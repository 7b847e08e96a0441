"""Page labels: kind, value and PDF style of a label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INVALID, ARABIC, ROMAN_LOWER, ROMAN_UPPER, ALPHA_UPPER, ALPHA_LOWER = range(6)
#: Names of the kinds and their PDF numbering styles, by number of the kind.
NAMES = ("invalid", "arabic", "roman-lower", "roman-upper", "alpha-upper", "alpha-lower")
STYLES = ("", "D", "r", "R", "A", "a")
#: Fixed value: roman numerals up to 4999 in their standard form.
ROMAN = "^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def is_roman(label: Column) -> Column:
    return (F.length(label) > 0) & F.upper(label).rlike(ROMAN)


def label_kind(label: Column) -> Column:
    """Kind of one label by itself; NULL and what is none of the kinds are invalid."""
    lower, upper = label.rlike("^[a-z]+$"), label.rlike("^[A-Z]+$")
    return (
        F.when(label.isNull(), INVALID)
        .when(label.rlike("^[0-9]+$"), ARABIC)
        .when(lower & is_roman(label), ROMAN_LOWER)
        .when(upper & is_roman(label), ROMAN_UPPER)
        .when(upper, ALPHA_UPPER)
        .when(lower, ALPHA_LOWER)
        .otherwise(INVALID)
    )


def roman_value(label: Column) -> Column:
    """Value of a roman numeral: its letters' sum, less twice each letter that stands before a larger one."""
    s = F.upper(label)

    def count(part: str) -> Column:
        return (F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / F.lit(len(part))

    letters = {"M": 1000, "D": 500, "C": 100, "L": 50, "X": 10, "V": 5, "I": 1}
    less = {"IV": 2, "IX": 2, "XL": 20, "XC": 20, "CD": 200, "CM": 200}
    total = F.lit(0)
    for k, v in letters.items():
        total = total + count(k) * v
    for k, v in less.items():
        total = total - count(k) * v
    return total.cast("int")


def alpha_value(label: Column) -> Column:
    """Only the first letter and the length count: A 1, Z 26, AA and AB 27, ZZ 52."""
    return (F.ascii(F.upper(label)) - 64 + 26 * (F.length(label) - 1)).cast("int")


def label_value(label: Column, kind: Column) -> Column:
    return F.when(kind == ARABIC, label.try_cast("int")).when(kind.isin(ROMAN_LOWER, ROMAN_UPPER), roman_value(label)).when(kind.isin(ALPHA_UPPER, ALPHA_LOWER), alpha_value(label))


def kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), kind + 1)


def kind_style(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STYLES)), kind + 1)
