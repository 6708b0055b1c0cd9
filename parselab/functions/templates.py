"""Columns over templates: the pattern a template stands for, its literal parts, letters and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parselab.functions import fixed


def literal_parts(template: Column) -> Column:
    """The constant texts around the wildcards, in order."""
    return F.split(template, r"<\*>")


def slot_count(template: Column) -> Column:
    without = F.replace(template, F.lit(fixed.WILDCARD), F.lit(""))
    return ((F.length(template) - F.length(without)) / len(fixed.WILDCARD)).cast("int")


MOST_SLOTS = 60  # beyond, and for texts with the two control characters below, the parts are searched one by one
BEGIN, BETWEEN = "\x02", "\x1f"
GROUPS = BETWEEN.join(f"${k}" for k in range(1, MOST_SLOTS + 1))


def pattern(template: Column) -> Column:
    """The pattern a template stands for.

    A wildcard and the constant part behind it are one atomic group, which ends at the first place of that part and is never entered
    again: a text that does not fit costs no more than one that does. Spark keeps the last pattern compiled.
    """
    escaped = F.regexp_replace(template, r"[\\^$.|?*+()\[\]{}]", r"\\$0")
    return F.concat(F.lit("(?s)^(?>"), F.replace(escaped, F.lit(r"<\*>"), F.lit(")(?>(.+?)")), F.lit(r"\z)"))


def read_slots(log: Column, template: Column) -> Column:
    """The text at each wildcard, of one character at least; NULL when the log does not fit the template.

    All slots are read by one replacement of the whole text.
    """
    count = slot_count(template)
    shown = F.concat(F.lit(BEGIN), F.call_function("substring_index", F.lit(GROUPS), F.lit(BETWEEN), count))
    read = F.regexp_replace(log, pattern(template), shown)
    fits = F.startswith(read, F.lit(BEGIN))
    slots = F.when(fits, F.split(F.substring(read, 2, 2**31 - 1), BETWEEN, -1))
    return (
        F.when(count == 0, F.when(log == template, F.array().cast("array<string>")))
        .when(_plain(log, template), slots)
        .otherwise(_searched_slots(log, template))
    )


def _plain(log: Column, template: Column) -> Column:
    return (slot_count(template) <= MOST_SLOTS) & ~F.contains(log, F.lit(BEGIN)) & ~F.contains(log, F.lit(BETWEEN))


def _searched_slots(log: Column, template: Column) -> Column:
    """The same for any number of wildcards and any text.

    Constant parts are found one after the other, each at its first place that leaves its wildcard a character, the last
    one at the end. Earliest places leave the most room, so they are what the lazy groups of a pattern would take,
    without going back: the work is one search per part.
    """
    parts = literal_parts(template)
    count = F.size(parts)
    first, last = F.get(parts, F.lit(0)), F.get(parts, count - 1)
    start = F.struct(
        F.startswith(log, first).alias("fits"), F.length(first).alias("read"), F.array().cast("array<string>").alias("values")
    )

    def find(state: Column, part: Column) -> Column:
        # Places count from 1; a wildcard begins at ``read + 1``.
        place = F.when(part == "", state["read"] + 2).otherwise(F.call_function("locate", part, log, state["read"] + 2))
        fits = state["fits"] & (place > 0) & (place <= F.length(log) + 1)
        value = F.substr(log, state["read"] + 1, place - state["read"] - 1)
        return F.when(
            fits,
            F.struct(
                F.lit(True).alias("fits"),
                (place - 1 + F.length(part)).alias("read"),
                F.concat(state["values"], F.array(value)).alias("values"),
            ),
        ).otherwise(
            F.struct(F.lit(False).alias("fits"), state["read"].alias("read"), state["values"].alias("values"))
        )

    middle = F.slice(parts, F.lit(2), F.greatest(count - 2, F.lit(0)))
    done = F.aggregate(middle, start, find)
    end = F.length(log) - F.length(last)
    value = F.substr(log, done["read"] + 1, end - done["read"])
    whole = F.when(
        done["fits"] & (end > done["read"]) & F.endswith(log, last), F.concat(done["values"], F.array(value))
    )
    return F.when(count == 1, F.when(log == template, F.array().cast("array<string>"))).otherwise(whole)


def matches(log: Column, template: Column) -> Column:
    by_pattern = F.regexp_instr(log, pattern(template)) > 0
    found = F.when(slot_count(template) <= MOST_SLOTS, by_pattern).otherwise(_searched_slots(log, template).isNotNull())
    return F.when(log.isNotNull() & template.isNotNull(), found)


def refill(template: Column, values: Column) -> Column:
    """Put ``values`` into the wildcards in order; constants unchanged."""
    parts = literal_parts(template)
    filled = F.zip_with(parts, values, lambda part, value: F.concat(part, F.coalesce(value, F.lit(""))))
    return F.array_join(filled, "")


def letter_number(letter: Column) -> Column:
    return F.ascii(F.upper(letter)) - 64


def number_letter(number: Column) -> Column:
    """A..Z for 1..26; NULL beyond, where the number is the only name."""
    return F.when(number.between(1, 26), F.char((number + 64).cast("bigint")))


def wildcard(template: Column) -> Column:
    return template.contains(fixed.WILDCARD)
