"""Exact token counts of every prefix of a text, by dynamic programming over prefixes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parselab.llm.common import mapped, portions, texts

SPACE = "▁"
PUNCTUATION = ".,;:!?*%&#$"
CACHED = 600_000


class PrefixCounter:
    """Token counts of all prefixes for a byte-pair vocabulary with byte fallback.

    The last token of a prefix is the only token that ends there and whose pair with the last token of the rest
    before it is stable: encoding the two joined gives the two back. So counts follow from shorter prefixes, and
    nothing is encoded again. No piece has a space after another character; texts are cut there, and the table of each
    distinct cut is kept in a cache that is emptied when full. Runs of spaces are merged last and from the left.
    """

    def __init__(self, model: str, cached: int = CACHED):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [i for i in range(lib.vocab_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in pieces}
        self.spaces = {len(p) for p in self.score if not p.strip(SPACE)}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece goes on after a space: texts cannot be cut there")
        self.endings = {p[i:]: False for p in self.score for i in range(len(p))} | dict.fromkeys(self.score, True)
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.cached = cached
        self.tables: dict[str, bytes] = {}
        self.stable: dict[tuple[str, str], bool] = {}
        self.alone: dict[str, bool] = {}
        self.runs: dict[int, int] = {}

    def merged(self, string: str) -> list[str]:
        """Plain byte-pair merging: the best pair first, the leftmost of equals."""
        parts = list(string)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stable(self, left: str, right: str) -> bool:
        known = self.stable.get((left, right))
        if known is None:
            known = left[-1] + right[0] not in self.inside or self.merged(left + right) == [left, right]
            if len(self.stable) >= 4 * self.cached:
                self.stable.clear()
            self.stable[left, right] = known
        return known

    def extend(self, string: str, last: list[str], counts: list[int]) -> None:
        """Go on from the prefixes whose last tokens and counts are given; ``counts`` starts with 0 for no text.

        A character of no piece is a token of its own, of as many tokens as it has bytes.
        """
        endings, stable = self.endings, self.stable
        for i in range(len(last) + 1, len(string) + 1):
            found, start = [], i - 1
            while start >= 0 and (piece := endings.get(token := string[start:i])) is not None:
                if piece:
                    found.append(token)
                start -= 1
            size = 1
            for token in reversed(found):  # the longest first; exactly one fits
                start = i - len(token)
                if start == 0:
                    fits = self._stable_alone(token)
                else:
                    fits = stable.get((last[start - 1], token))
                    if fits is None:
                        fits = self._stable(last[start - 1], token)
                if fits:
                    break
            else:
                token = string[i - 1]
                size = len(token.encode("utf-8", "surrogatepass"))
            last.append(token)
            counts.append(counts[-len(token)] + size)

    def _stable_alone(self, token: str) -> bool:
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.merged(token) == [token]
        return known

    def run(self, k: int) -> int:
        """Tokens of k spaces: pairs are merged from the left, so the first piece grows as far as a piece is known."""
        if k not in self.runs:
            left, rest = [], [1] * k
            while rest:
                left.append(rest.pop())
                while len(left) > 1 and left[-2] + left[-1] in self.spaces:
                    left[-2:] = [left[-2] + left[-1]]
            self.runs[k] = len(left)
        return self.runs[k]

    def learn(self, words: set[str]) -> None:
        """Steps (int8) between the prefix counts of a space and each word; words hold no space.

        In sorted order a word goes on from the prefix that it shares with the one before.
        """
        whole, cut = set(), []
        for word in words:
            head = word.rstrip(PUNCTUATION)
            if head and head != word and head[-1] + word[len(head)] not in self.inside:
                cut.append((word, head, word[len(head) :]))
                whole.add(SPACE + head)
                whole.add(word[len(head) :])
            else:
                whole.add(SPACE + word)
        made: dict[str, bytes] = {}
        before, last, counts = "", [], [0]
        for string in sorted(whole):
            shared, most = 0, min(len(string), len(before))
            while shared < most and string[shared] == before[shared]:
                shared += 1
            del last[shared:], counts[shared + 1 :]
            self.extend(string, last, counts)
            made[string] = _steps(counts)
            before = string
        tables = self.tables
        for string, steps in made.items():
            if string[0] == SPACE:
                tables[string[1:]] = steps
        for word, head, tail in cut:
            tables[word] = made[SPACE + head] + made[tail]

    def _after_run(self, k: int, word: str) -> bytes:
        """Steps over k spaces, then a space and a word; a space that no letter takes joins the run."""
        last: list[str] = []
        counts = [0]
        self.extend(SPACE + word, last, counts)
        out = [0] + [self.run(j) for j in range(1, k + 1)]
        alone: list[bool] = []
        for i, token in enumerate(last, 1):
            alone.append(token == SPACE if i == len(token) else alone[i - len(token) - 1])
            out.append(self.run(k + 1) + counts[i] - 1 if alone[-1] else self.run(k) + counts[i])
        return _steps(out)

    def steps(self, texts: list[str]) -> Iterator[bytes]:
        """For each text the steps between the counts of all its prefixes; the first is for the space put before it."""
        cuts = [(t.replace(" ", SPACE).split(SPACE) if SPACE in t else t.split(" ")) if t else [] for t in texts]
        words = {w for cut in cuts for w in cut}
        new = words - self.tables.keys()
        if len(self.tables) + len(new) > self.cached:
            self.tables.clear()
            new = words
        self.learn(new)
        table = self.tables
        for cut in cuts:
            yield b"".join([table[w] for w in cut]) if "" not in cut else b"".join(self._with_runs(cut))

    def _with_runs(self, words: list[str]) -> Iterator[bytes]:
        run = 0
        for i, word in enumerate(words):
            if word == "" and i < len(words) - 1:
                run += 1
            elif run:
                yield self._after_run(run, word)
                run = 0
            else:
                yield self.tables[word]


def _steps(counts: list[int]) -> bytes:
    return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:], strict=False)])


def totals(steps: bytes, budget: int) -> tuple[int, int]:
    """(tokens of the whole text, characters of its longest prefix within the budget)."""
    moves = np.frombuffer(steps, np.int8)
    whole = int(moves.sum(dtype=np.int64))
    if whole <= budget:
        return whole, max(0, len(moves) - 1)
    within = np.flatnonzero(np.cumsum(moves, dtype=np.int64)[1:] <= budget)
    return whole, int(within[-1]) + 1 if len(within) else 0


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    """The counter of this worker; its cache goes on from task to task."""
    if model not in _COUNTERS:
        _COUNTERS[model] = PrefixCounter(model)
    return _COUNTERS[model]


def count_tokens(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", budget: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (characters of the longest prefix within ``budget``).

    A null text is an empty one and has no tokens. Rows are counted one by one; an empty table gives no rows; other
    columns are not read.
    """
    read = df.selectExpr(f"cast(`{key}` as bigint) AS doc_id", f"`{text}` AS text")

    def per_batch(part: pa.RecordBatch) -> dict[str, list]:
        values = texts(part)
        steps = (s for some in portions(values) for s in counter(model).steps(some))
        found = [totals(s, budget) for s in steps]
        return {
            "doc_id": part.column("doc_id"),
            "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in values],
            "n_tokens": [n for n, _ in found],
            "over_limit": [n > budget for n, _ in found],
            "fit_chars": [fit for _, fit in found],
        }

    return mapped(read, per_batch, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint")


def prefix_tables(df: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, steps: the count of every prefix, as zlib-packed int8 steps, to be stored beside the texts."""
    read = df.selectExpr(f"cast(`{key}` as bigint) AS doc_id", f"`{text}` AS text")

    def per_batch(part: pa.RecordBatch) -> dict[str, list]:
        steps = [s for some in portions(texts(part)) for s in counter(model).steps(some)]
        return {
            "doc_id": part.column("doc_id"),
            "n_chars": [max(0, len(s) - 1) for s in steps],
            "steps": [zlib.compress(s, 1) for s in steps],
        }

    return mapped(read, per_batch, "doc_id bigint, n_chars bigint, steps binary")


def _unpacked(steps: bytes) -> np.ndarray:
    counts = np.cumsum(np.frombuffer(zlib.decompress(steps), np.int8), dtype=np.int64)
    if len(counts):
        counts[0] = 0  # no text, no token
    return counts


def tokens_at(steps: Column, n_chars: Column) -> Column:
    """Token count of the prefix of ``n_chars`` characters, from a stored table."""

    @F.pandas_udf("bigint")
    def look(packed, n):
        import pandas as pd

        tables = map(_unpacked, packed)
        return pd.Series([int(t[min(max(k, 0), len(t) - 1)]) if len(t) else 0 for t, k in zip(tables, n, strict=True)])

    return look(steps, n_chars)


def chars_within(steps: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from a stored table."""

    @F.pandas_udf("bigint")
    def look(packed, most):
        import pandas as pd

        return pd.Series([
            int(np.flatnonzero(t <= b)[-1]) if len(t) and b >= 0 else 0
            for t, b in zip(map(_unpacked, packed), most, strict=True)
        ])

    return look(steps, budget)
