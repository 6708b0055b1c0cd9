"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parselab.llm.common import mapped, texts

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    "(" + "|".join(map(_either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # as [0-9a-f]+ of 32 or more: a run is found at its first character
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper")
Span = tuple[int, int, str]


@dataclass(frozen=True)
class Entropy:
    """Windows of ``window`` characters inside candidate strings, and the least entropy in bits by character class.

    Classes: ``hex`` is a run of digits and a-f (or A-F) with both digits and letters; ``base64`` is any string of the
    candidate alphabet in which a window has digits, small and large letters; ``lower`` and ``upper`` are runs of digits and
    letters of one case, in windows with both and a letter beyond hex. Runs are looked for inside a candidate, so what is joined
    to them by other signs does not hide them. Windows of letters alone or digits alone are words and numbers.
    ``allowed``: a candidate is let be where one of these patterns matches around it; they begin where a run of their characters begins
    and do not go back in it, so their work is linear. Of an address the query string is not let be. ``names``: a run of one case
    that is all of one of these is a name. One-case windows that overlap a base span are not reported again.
    """

    window: int = 20
    least_hex: float = 3.0
    least_base64: float = 3.9
    least_one_case: float = 3.4
    allowed: tuple[str, ...] = (
        r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}",
        r"(?<![A-Za-z0-9+.-])[0-9+.-]*+[A-Za-z][A-Za-z0-9+.-]*+://[^\s?#]+",
        r"(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)+",
        r"data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+",
        r"(?:sha(?:1|256|512)|md5)[-:][A-Za-z0-9+/=]+",
    )
    names: tuple[str, ...] = (r"[A-Za-z]+[0-9]+", r"[0-9]+[A-Za-z]+", r"[A-Za-z]+[0-9]{1,4}[A-Za-z]+")


CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")  # without a digit it has no class
HEX_RUNS = re.compile(r"[0-9a-f]{20,}"), re.compile(r"[0-9A-F]{20,}")
ONE_CASE_RUNS = {"lower": re.compile(r"[0-9a-z]{20,}"), "upper": re.compile(r"[0-9A-Z]{20,}")}
BEYOND_HEX = re.compile(r"[G-Zg-z]")
DIGIT = re.compile(r"[0-9]")
LETTER = re.compile(r"[A-Za-z]")
SMALL = re.compile(r"[a-z]")
LARGE = re.compile(r"[A-Z]")


def base_spans(text: str) -> list[Span]:
    """Leftmost, non-overlapping matches per kind that are long enough, whole match as (start, end, kind)."""
    found: list[Span] = []
    low = text.lower()  # only to pass over texts; letters outside ASCII never make a keyword disappear
    if any(word in low for word in KEYWORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def window_entropies(string: str, window: int) -> Iterator[tuple[int, float]]:
    """(start, bits) of every window, from counts that change by one character a step."""
    steps = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    up = [b - a for a, b in zip(steps, steps[1:], strict=False)]  # what a count of c gains by one more
    whole = math.log2(window)
    counts = dict.fromkeys(string, 0)
    total = 0.0
    for new in string[: window - 1]:
        total += up[counts[new]]
        counts[new] += 1
    for i, new in enumerate(string[window - 1 :]):
        c = counts[new]
        total += up[c]
        counts[new] = c + 1
        yield i, whole - total / window
        old = string[i]
        c = counts[old] - 1
        counts[old] = c
        total -= up[c]


def _mixed(string: str) -> bool:
    return bool(DIGIT.search(string) and SMALL.search(string) and LARGE.search(string))


class _Cover:
    """Spans by start, and whether any of them reaches into a stretch."""

    def __init__(self, spans: list[tuple[int, int]]):
        ordered = sorted(spans)
        self.starts = [a for a, _ in ordered]
        self.reach = list(accumulate((z for _, z in ordered), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


def _runs(candidate: str, rule: Entropy) -> Iterator[tuple[str, int, str, float]]:
    """(class, start, string, least bits): what is scanned in a candidate."""
    for pattern in HEX_RUNS:
        for m in pattern.finditer(candidate):
            if DIGIT.search(m[0]) and LETTER.search(m[0]):
                yield "hex", m.start(), m[0], rule.least_hex
    for kind, pattern in ONE_CASE_RUNS.items():
        for m in pattern.finditer(candidate):
            if DIGIT.search(m[0]) and BEYOND_HEX.search(m[0]) and not any(re.fullmatch(p, m[0]) for p in rule.names):
                yield kind, m.start(), m[0], rule.least_one_case
    if _mixed(candidate):
        yield "base64", 0, candidate, rule.least_base64


def _in_class(kind: str, window: str) -> bool:
    if kind == "hex":
        return True
    if kind == "base64":
        return _mixed(window)
    return bool(DIGIT.search(window) and BEYOND_HEX.search(window))


def entropy_spans(text: str, rule: Entropy, allowed: re.Pattern, base: list[Span] = ()) -> list[Span]:
    """Unions of overlapping windows whose entropy reaches the least of their class."""
    found: list[Span] = []
    let_be: _Cover | None = None
    known = _Cover([(a, z) for a, z, _ in base])
    for m in CANDIDATE.finditer(text):
        runs = list(_runs(m[0], rule)) if DIGIT.search(m[0]) else []
        if not runs:
            continue
        if let_be is None:
            let_be = _Cover([a.span() for a in allowed.finditer(text)])
        if let_be.meets(m.start(), m.end()):
            continue
        for kind, at, string, least in runs:
            at += m.start()
            one_case = kind in ONE_CASE_RUNS
            open_at = end = None
            for i, bits in window_entropies(string, rule.window):
                if bits < least or not _in_class(kind, string[i : i + rule.window]):
                    continue
                if one_case and known.meets(at + i, at + i + rule.window):
                    continue
                if end is not None and i > end:
                    found.append((at + open_at, at + end, f"entropy_{kind}"))
                    open_at = None
                open_at = i if open_at is None else open_at
                end = i + rule.window
            if end is not None:
                found.append((at + open_at, at + end, f"entropy_{kind}"))
    return found


def all_spans(text: str, rule: Entropy, allowed: re.Pattern) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans; entropy spans inside a base span are not repeated. By start, then kind."""

    def order(span: Span):
        return span[0], KINDS.index(span[2]), span[1]

    base = sorted(base_spans(text), key=order)
    covered = sorted(base)
    added, k, reach = [], 0, -1
    for start, end, kind in sorted(entropy_spans(text, rule, allowed, base)):
        while k < len(covered) and covered[k][0] <= start:
            reach = max(reach, covered[k][1])
            k += 1
        if end > reach:
            added.append((start, end, kind))
    return base, sorted(base + added, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SCHEMA = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint"
)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Entropy = Entropy()) -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans (code points, end exclusive).

    A null text is an empty one and has no spans; repeated rows give repeated rows; an empty table gives none; other
    columns are not read.
    """

    def per_batch(part: pa.RecordBatch) -> dict[str, list]:
        allowed = re.compile("|".join(f"(?:{p})" for p in rule.allowed) or r"(?!)")
        out: dict[str, list] = {name: [] for name in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added")}
        for t in texts(part):
            base, spans = all_spans(t, rule, allowed)
            kinds = [s[2] for s in base]
            for name in ("assign", "access", "hex"):
                out[f"n_{name}"].append(kinds.count(name))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
            out["n_added"].append(len(spans) - len(base))
        return {"doc_id": part.column("doc_id"), **out}

    return mapped(df.selectExpr(f"cast(`{key}` as bigint) AS doc_id", f"`{text}` AS text"), per_batch, SCHEMA)


def redacted(
    df: DataFrame, text: str = "text", n_chars: str | None = "n_chars", mask: str = "[SECRET]", rule: Entropy = Entropy()
) -> DataFrame:
    """All rows and columns; every found span (overlapping ones as one) is replaced by ``mask``, ``n_chars`` recounted.

    Texts without a span, nulls included, stay as they are.
    """
    counted = n_chars in df.columns if n_chars else False

    def cover(value: str | None, allowed: re.Pattern) -> str | None:
        spans = all_spans(value, rule, allowed)[1] if value else []
        if not spans:
            return value
        pieces, at = [], 0
        for start, end, _ in spans:
            if start >= at:
                pieces += [value[at:start], mask]
            at = max(at, end)
        return "".join([*pieces, value[at:]])

    def run(parts):
        allowed = re.compile("|".join(f"(?:{p})" for p in rule.allowed) or r"(?!)")
        for part in parts:
            old = part.column(text).to_pylist()
            new = [cover(t, allowed) for t in old]
            at = part.schema.get_field_index(text)
            part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
            if counted:
                at = part.schema.get_field_index(n_chars)
                counts = [n if a is b else len(b) for n, a, b in zip(part.column(at).to_pylist(), old, new, strict=True)]
                part = part.set_column(at, part.schema.field(at), pa.array(counts, part.schema.field(at).type))
            yield part

    return df.mapInArrow(run, T.StructType(df.schema.fields))
