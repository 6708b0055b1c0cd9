"""Token ids of whole texts; the word vocabulary goes through a bounded cache of the cuts between white space."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED = 500_000
MARK = "\x01"
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
AFTER_LETTER = "([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?*%&#$]+)( |$)"


def packed(kind: str, ids: list[int]) -> bytes:
    """Little-endian unsigned numbers of 16 (H) or 32 (I) bits."""
    return struct.pack(f"<{len(ids)}{kind}", *ids)


class WordIds:
    """A vocabulary of the tokenizers library whose pre-tokenizer drops white space, so that texts are cut at spaces.

    Punctuation after a letter is a word of its own. Ids are kept as little-endian bytes by word; a full cache becomes the old one, whose
    words come over when they are met again. Texts are cut, and their ids put together, in Arrow: Python sees each distinct word of a
    call once.
    """

    def __init__(self, path: str, cached: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.cached = cached
        self.clear()
        self.library = Tokenizer.from_file(path)
        (self.mark,) = self.library.encode(MARK, add_special_tokens=False).ids  # one id, which no other text has
        self.tokenize = self.library.model.tokenize
        steps = self.library.pre_tokenizer.pre_tokenize_str
        self.letters = {ord(c): steps(c)[0][0] for c in map(chr, range(256)) if LETTERS.fullmatch(c)}

    def _word(self, word: str) -> bytes:
        """Ids of a word of plain letters in lower case: one pre-token, so the model alone is asked."""
        return packed("I", [token.id for token in self.tokenize(word.translate(self.letters))])

    def _marked(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, ids) of any words without the mark: many are encoded in one call, with the mark between."""
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self.library.encode(f" {MARK} ".join([*some, ""]), add_special_tokens=False).ids, "<u4")
            data, start = ids.tobytes(), 0
            for word, end in zip(some, np.flatnonzero(ids == self.mark).tolist(), strict=True):
                yield word, data[4 * start : 4 * end]
                start = end + 1

    def _encode(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """(word, ids) of words; plain letters are lowered one by one."""
        plain, other = {}, []
        for word in words:
            if word.isalpha() if word.isascii() else LETTERS.fullmatch(word):
                plain[word] = word.lower()
            else:
                other.append(word)
        lower = {*plain.values()}
        known = {w: self.ids[w] if w in self.ids else self._word(w) for w in lower}
        yield from known.items()
        yield from ((w, known[low]) for w, low in plain.items() if w != low)
        odd = {w for w in other if MARK in w or not w.strip()}
        yield from ((w, packed("I", self.library.encode(w, add_special_tokens=False).ids)) for w in odd)
        yield from self._marked([w for w in other if w not in odd])

    def known(self, words: list[str]) -> list[bytes]:
        """Ids of each of some distinct words."""
        found = [*map(self.ids.get, words)]
        if None not in found:
            return found
        new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if len(self.ids) + len(new) > self.cached:
            self.old, self.ids = self.ids, {w: ids for w, ids in zip(words, found, strict=True) if ids is not None}
        if self.old:
            self.ids.update((w, self.old[w]) for w in new if w in self.old)
            new = [w for w in new if w not in self.ids]
        self.ids.update(self._encode(new))
        return [*map(self.ids.__getitem__, words)]

    def clear(self) -> None:
        """At the end of a task: idle workers hold no cache."""
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        spaced = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " ")
        cuts = pc.split_pattern(pc.replace_substring_regex(spaced, AFTER_LETTER, r"\1 \2\3"), " ")
        words = cuts.flatten().dictionary_encode()
        known = self.known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(known, pa.large_binary()).take(words.indices)
        _, places, data = ids.buffers()
        ends = np.frombuffer(places, np.int64)[cuts.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        return (data[start:end].tobytes() for start, end in zip(ends, ends[1:], strict=False))


class RankIds:
    """Byte-level vocabulary in ranks; texts go to the library whole, which is faster than looking words up."""

    def __init__(self, path: str, pattern: str):
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.kind = "<u2" if len(ranks) < 1 << 16 else "<u4"

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned numbers of ``kind``."""
        return (np.array(self.library.encode_ordinary(t), self.kind).tobytes() for t in texts)


_MADE: dict[tuple, object] = {}


def once(kind, *of):
    """One encoder a worker; what it read from the vocabulary goes on from task to task."""
    if (kind, *of) not in _MADE:
        _MADE[kind, *of] = kind(*of)
    return _MADE[kind, *of]
