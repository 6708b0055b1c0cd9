"""Text columns: stripping, template extraction, reasoning clean-up, summary selection."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from parselab.functions import fixed

# Java flags: d = only \n ends a line, U = Unicode classes, i = any case.
_MARKED = rf"(?idU){fixed.MARKER}{fixed.SPACE}*{fixed.REST_OF_LINE}"
_PHRASED = [rf"(?idU){p}:?{fixed.SPACE}*{fixed.REST_OF_LINE}" for p in fixed.TEMPLATE_PHRASES]
_OPENER = rf"(?iU)^(?:{'|'.join(fixed.LINE_OPENERS)}):?{fixed.SPACE}*"
_PARAGRAPH = rf"(?U)\n{fixed.SPACE}*\n"


def strip(text: Column) -> Column:
    """Remove white space, Unicode included, from both ends."""
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def strip_quotes(text: Column) -> Column:
    return F.btrim(text, F.lit(fixed.QUOTES))


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){fixed.SPACE}+", " ")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def fill(wording: str, **values: Column) -> Column:
    """Put columns into the ``{name}`` places of a fixed wording; a missing value reads ``nan``."""
    names = "|".join(values)
    parts = re.split(rf"\{{({names})\}}", wording)
    return F.concat(
        *[
            F.coalesce(values[part].cast("string"), F.lit("nan")) if at % 2 else F.lit(part)
            for at, part in enumerate(parts)
        ]
    )


def strip_markers(text: Column) -> Column:
    """Drop special tokens one after the other: a removal may expose the next token."""
    for token in fixed.SPECIAL_TOKENS:
        text = F.replace(text, F.lit(token), F.lit(""))
    return text


def line_with(text: Column, word: str) -> Column:
    """The first line that holds ``word``, found by position: one pass however long the lines are."""
    at = F.instr(text, word)
    before = F.substring_index(F.substring(text, F.lit(1), at - 1), "\n", -1)
    return F.concat(before, F.substring_index(F.substr(text, at), "\n", 1))


def inject_marker(text: Column) -> Column:
    """Append a template marker with the first wildcard line where the marker is absent."""
    first = line_with(text, fixed.WILDCARD)
    marked = F.when(
        ~text.contains(fixed.MARKER) & text.contains(fixed.WILDCARD),
        F.concat(text, F.lit(f"\n\n{fixed.MARKER} "), strip(first)),
    ).otherwise(text)
    return F.concat(strip(marked), F.lit("\n\n\n\n"))


def normalise_output(text: Column) -> Column:
    return inject_marker(strip_markers(text))


def extract_template(text: Column) -> Column:
    """Struct ``(template, tier)``: the first rule that applies to the output text decides."""

    def found(template: Column, tier: int) -> Column:
        return F.struct(template.alias("template"), F.lit(tier).alias("tier"))

    def after(pattern: str) -> Column:
        return strip_quotes(strip(F.regexp_extract(text, pattern, 1)))

    low, high = fixed.LINE_LENGTH
    wildcard_line = F.get(
        F.filter(
            F.transform(lines(text), strip),
            lambda line: line.contains(fixed.WILDCARD) & F.length(line).between(low, high),
        ),
        F.lit(0),
    )
    first_line = strip(F.substring_index(text, "\n", 1))

    rule = F.when(text.rlike(_MARKED), found(after(_MARKED), 1))
    for pattern in _PHRASED:
        rule = rule.when(text.rlike(pattern), found(after(pattern), 2))
    return (
        rule.when(
            wildcard_line.isNotNull(),
            found(strip_quotes(F.regexp_replace(wildcard_line, _OPENER, "")), 3),
        )
        .when(first_line != "", found(first_line, 4))
        .otherwise(found(text, 5))
    )


def clean_reasoning(text: Column) -> Column:
    """Cut think ends, fenced blocks and step lines; unwrap boxed answers."""
    text = F.replace(text, F.lit(fixed.THINK_END), F.lit(" "))
    text = F.regexp_replace(text, fixed.FENCED, " ")
    text = F.regexp_replace(text, fixed.STEP_LINE, " ")
    text = F.regexp_replace(text, fixed.BOXED_MATH, "$1")
    return F.regexp_replace(text, fixed.BOXED, "$1")


def summary_by_marker(text: Column) -> Column:
    """Lower-case text after the last summary marker, or NULL without one."""
    low = F.lower(text)
    tail = F.element_at(F.split(low, fixed.SUMMARY_MARKER), -1)
    tidy = collapse_space(F.btrim(tail, F.lit(fixed.WHITESPACE + fixed.QUOTES)))
    return F.when(low.contains(fixed.SUMMARY_MARKER), tidy)


def last_paragraph(text: Column) -> Column:
    """Last paragraph that is not blank, or NULL."""
    body = strip(text)
    # The body ends in a visible character, so the last piece of the split is never blank.
    return F.when(body != "", strip(F.element_at(F.split(body, _PARAGRAPH), -1)))


def shorten(text: Column, limit: int = fixed.SUMMARY_LIMIT) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    ).otherwise(text)


def na_words(text: Column) -> Column:
    """NULL for the words a CSV cell may hold for a missing value."""
    return F.when(~text.isin(fixed.NA_WORDS), text)
