"""Columns that read JSON out of model replies. Parsing is strict: one JSON value, nothing behind it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parselab.functions import fixed
from parselab.functions.text import lines, strip, strip_quotes


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _outermost(text: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing sign; NULL when one is absent, '' when they cross."""
    begin = F.instr(text, opening)
    end = F.length(text) - F.instr(F.reverse(text), closing) + 1
    both = text.contains(opening) & text.contains(closing)
    return F.when(both, F.when(end < begin, F.lit("")).otherwise(F.substring(text, begin, end - begin + 1)))


def json_object_slice(text: Column) -> Column:
    return _outermost(text, "{", "}")


def json_array_slice(text: Column) -> Column:
    """The widest ``[...]`` of a text, or '' without one."""
    return F.coalesce(_outermost(text, "[", "]"), F.lit(""))


def parse_single(text: Column) -> Column:
    """VARIANT array that holds the one JSON value of ``text``; NULL when it holds none or two."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(_get(wrapped, "$[1]", "variant").isNull(), wrapped)


def label_number(parsed: Column) -> Column:
    """The label as INT when it is a JSON integer, a whole decimal or ``true``; else NULL."""
    label = _get(parsed, "$[0].label", "variant")
    number = _get(parsed, "$[0].label", "double")
    numeric = _kind(label).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)")
    return F.when(numeric & (number == F.floor(number)) & (F.abs(number) < 2**31), number.cast("int"))


def label_text(parsed: Column) -> Column:
    """The named error type; NULL when it is absent, empty, zero, false or ``Unknown``."""
    kind = _kind(_get(parsed, "$[0].error_type", "variant"))
    text = _get(parsed, "$[0].error_type", "string")
    number = _get(parsed, "$[0].error_type", "double")
    return (
        F.when(kind == "STRING", F.when(~text.isin("", fixed.UNKNOWN), text))
        .when(kind.rlike("^(VOID|ARRAY<VOID>|OBJECT<>)$"), F.lit(None))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"), F.when(number != 0, text))
        .otherwise(text)
    )


def line_candidates(text: Column, output: Column) -> Column:
    """Lines that may be logs, each with the given template: the reading of a reply without JSON."""
    kept = F.filter(
        F.transform(lines(text), strip),
        lambda line: (F.length(line) > fixed.LOG_MIN)
        & ~F.startswith(line, F.lit(fixed.NOT_A_LOG[0]))
        & ~F.startswith(line, F.lit(fixed.NOT_A_LOG[1]))
        & ~F.startswith(line, F.lit(fixed.NOT_A_LOG[2])),
    )
    return F.transform(kept, lambda line: _variant(line, output))


def _variant(text: Column, output: Column, error_type: Column | None = None) -> Column:
    kind = F.lit(None).cast("int") if error_type is None else error_type
    return F.struct(text.alias("input"), output.alias("output"), kind.alias("error_type"))


def substitution_variants(items: Column, original: Column, template: Column) -> Column:
    """String items of the array that differ from the source log; the template stays."""
    texts = F.transform(
        F.filter(items, lambda item: _kind(item) == "STRING"),
        lambda item: strip_quotes(strip(item.cast("string"))),
    )
    changed = F.filter(texts, lambda text: ~text.eqNullSafe(original))
    return F.transform(changed, lambda text: _variant(text, template))


def _complete(item: Column) -> Column:
    return (
        _kind(item).startswith("OBJECT")
        & _get(item, "$.example", "variant").isNotNull()
        & _get(item, "$.template", "variant").isNotNull()
    )


def _worded(item: Column) -> Column:
    return (_kind(_get(item, "$.example", "variant")) == "STRING") & (
        _kind(_get(item, "$.template", "variant")) == "STRING"
    )


def badly_typed(items: Column) -> Column:
    """True when an object has both fields but one of them is no text: the whole reply then falls back."""
    return F.exists(items, lambda item: _complete(item) & ~F.coalesce(_worded(item), F.lit(False)))


def rewrite_variants(items: Column, original: Column) -> Column:
    """Objects with example and template whose example differs from the source log."""
    pairs = F.transform(
        F.filter(items, lambda item: _complete(item) & F.coalesce(_worded(item), F.lit(False))),
        lambda item: _variant(
            strip(_get(item, "$.example", "string")),
            strip(_get(item, "$.template", "string")),
            _get(item, "$.error_type", "int"),
        ),
    )
    return F.filter(pairs, lambda pair: ~pair["input"].eqNullSafe(original))


def loose_objects(text: Column) -> Column:
    """Flat objects found in a reply that has no array."""
    found = F.regexp_extract_all(text, F.lit(fixed.FLAT_OBJECT), F.lit(0))
    parsed = F.transform(found, F.try_parse_json)
    return F.filter(parsed, lambda item: item.isNotNull())
