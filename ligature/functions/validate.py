"""Syntax checks of line notation: named violations as an array column, and their descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import once

# Names and texts of the violations.
DESCRIPTIONS = {
    "empty_or_invalid": "SMILES is empty or not a string",
    "bracket_close_without_open": "Closing bracket ] without matching [",
    "unclosed_brackets": "Opening bracket [ not closed",
    "extra_bracket_close": "Extra closing bracket ]",
    "empty_brackets": "Empty brackets [] found",
    "paren_close_without_open": "Closing parenthesis ) without matching (",
    "unclosed_parentheses": "Opening parenthesis ( not closed",
    "extra_paren_close": "Extra closing parenthesis )",
    "empty_parentheses": "Empty parentheses () found",
    "starts_with_bond": "SMILES starts with bond symbol (=, #, -)",
    "ends_with_bond": "SMILES ends with bond symbol",
    "consecutive_bonds": "Consecutive bond symbols found",
    "bond_after_open_paren": "Bond symbol immediately after (",
    "bond_before_close_paren": "Bond symbol immediately before )",
    "starts_with_stereo": "SMILES starts with stereochemistry marker (/, \\)",
    "ends_with_stereo": "SMILES ends with stereochemistry marker",
    "consecutive_stereo": "Consecutive stereochemistry markers found",
    "invalid_start_token": "SMILES starts with invalid token",
    "starts_with_closure": "SMILES starts with closing bracket or paren",
    "starts_with_ring_digit": "SMILES starts with ring digit",
    "aromatic_without_rings": "Aromatic atoms present without ring structures",
}


def _names(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, name) for test, name in pairs]))


def balance(text: Column, opening: str, closing: str) -> Column:
    """(last, low): the running count of open less closed, up to where it first falls below 0."""
    marks = F.filter(F.split(text, ""), lambda c: c.isin(opening, closing))
    start = F.struct(F.lit(0).alias("last"), F.lit(0).alias("low"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["last"] + F.when(c == opening, 1).otherwise(-1)
        return F.when(acc["low"] < 0, acc).otherwise(F.struct(now.alias("last"), F.least(acc["low"], now).alias("low")))

    return F.aggregate(marks, start, step)


def _pairs(text: Column, opening: str, closing: str, close: str, unclosed: str, extra: str, empty: str) -> Column:
    return once(
        balance(text, opening, closing),
        lambda state: _names((state["low"] < 0, close), (state["last"] > 0, unclosed), (state["last"] < 0, extra), (text.contains(opening + closing), empty)),
    )


def ring_violations(text: Column, split_digits: bool = False) -> Column:
    """Ring numbers seen once or more than twice, in the order of their first place."""
    found = F.regexp_extract_all(text, F.lit(r"%\d\d|\d" if split_digits else r"%?\d+"), F.lit(0))
    digits = F.transform(found, lambda d: F.regexp_replace(d, "^%?0*(?=\\d)", ""))

    def names(digits: Column) -> Column:
        def name(d: Column) -> Column:
            n = F.size(F.filter(digits, lambda x: x == d))
            return F.when(n == 1, F.concat(F.lit("unclosed_ring_"), d)).when(n > 2, F.concat(F.lit("duplicate_ring_"), d))

        return F.array_compact(F.transform(F.array_distinct(digits), name))

    return once(digits, names)


def violations(column: Column, bracket_aware: bool = False) -> Column:
    """All violations in a fixed order; a valid string has none. Null and blank are ``empty_or_invalid``.

    By default digits in brackets count as ring numbers, a run of digits is one number, and a bond after an
    opening parenthesis is flagged; ``bracket_aware`` takes brackets out first, splits digits, drops that rule.
    """
    text = F.trim(column)
    outside = F.regexp_replace(text, r"\[[^\]]*\]", "*") if bracket_aware else text
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    # isupper/isdigit of a character: it has a lower case; it is a decimal digit
    upper = (F.upper(first) == first) & (F.lower(first) != first)
    bonds = _names(
        (first.isin("=", "#", "-"), "starts_with_bond"),
        (last.isin("=", "#", "-"), "ends_with_bond"),
        (text.rlike("==|##|--"), "consecutive_bonds"),
        (F.lit(False) if bracket_aware else text.rlike(r"\([=#-]"), "bond_after_open_paren"),
        (text.rlike(r"[=#-]\)"), "bond_before_close_paren"),
    )
    stereo = _names((first.isin("/", "\\"), "starts_with_stereo"), (last.isin("/", "\\"), "ends_with_stereo"), (text.rlike(r"[/\\][/\\]"), "consecutive_stereo"))
    start = _names(
        (~first.isin(*"bcnops", "[") & ~upper, "invalid_start_token"),
        (first.isin("]", ")"), "starts_with_closure"),
        (first.rlike(r"^[\d%]"), "starts_with_ring_digit"),
    )
    aromatic = _names(((F.length(F.regexp_replace(outside, "[^bcnosp]", "")) > 3) & ~outside.rlike(r"\d"), "aromatic_without_rings"))
    every = F.concat(
        _pairs(text, "[", "]", "bracket_close_without_open", "unclosed_brackets", "extra_bracket_close", "empty_brackets"),
        _pairs(text, "(", ")", "paren_close_without_open", "unclosed_parentheses", "extra_paren_close", "empty_parentheses"),
        ring_violations(outside, bracket_aware),
        bonds,
        stereo,
        start,
        aromatic,
    )
    return F.when(F.coalesce(text, F.lit("")) == "", F.array(F.lit("empty_or_invalid"))).otherwise(every)


def is_valid(column: Column, bracket_aware: bool = False) -> Column:
    return F.size(violations(column, bracket_aware)) == 0


def describe_violation(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DESCRIPTIONS.items() for x in pair])
    number = F.element_at(F.split(name, "_"), -1)
    return (
        F.when(name.startswith("unclosed_ring_"), F.concat(F.lit("Ring closure "), number, F.lit(" is unclosed")))
        .when(name.startswith("duplicate_ring_"), F.concat(F.lit("Ring digit "), number, F.lit(" used more than twice")))
        .otherwise(F.coalesce(F.try_element_at(table, name), F.concat(F.lit("Unknown violation: "), name)))
    )
