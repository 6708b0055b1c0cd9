"""Alignment against pairs of byte ranges, with the libraries of the two vocabularies."""

import random
from collections import Counter
from hashlib import sha256

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from parselab.llm import align

SCHEMA = "doc_id bigint, text string, key string, times int"
FILES = {"ranks": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN, "model": P.path("piece_bpe_32k.model")}
FIRST = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def bytes_of_chars():
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


CHARS = bytes_of_chars()


def cut(text):
    """(ids, byte ranges) by each tokenizer, or nothing."""
    whole = (" " + text).encode()
    a = FIRST.encode(" " + text, add_special_tokens=False).ids
    b = SECOND.encode(text)
    of_a = [bytes(CHARS[c] for c in FIRST.id_to_token(i)) for i in a]
    of_b = []
    for i in b:
        piece = SECOND.id_to_piece(i)
        of_b.append(bytes([int(piece[3:5], 16)]) if SECOND.is_byte(i) else piece.replace("▁", " ").encode())
    if not text or b"".join(of_a) != whole or b"".join(of_b) != whole:
        return [], [], [], []

    def ranges(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    return a, b, ranges(of_a), ranges(of_b)


def plain(rows):
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b, ra, rb = cut(text or "")
        links = [(i, j) for i, (s, e) in enumerate(ra) for j, (t, f) in enumerate(rb) if s < f and t < e]
        common = {e for _, e in ra} & {e for _, e in rb}
        shown, at = [], 0
        for end in sorted(common):
            inside = lambda r: at <= r[0] and r[1] <= end  # noqa: B023, E731
            left = ",".join(str(i) for i, r in zip(a, ra, strict=True) if inside(r))
            shown.append(left + "|" + ",".join(str(i) for i, r in zip(b, rb, strict=True) if inside(r)))
            at = end
        pairs = [(a[i], b[j]) for i, j in links]
        counts.update(pairs)
        docs.append((doc_id, len(a), len(b), len(common), pairs, sha256(";".join(shown).encode()).hexdigest() if a else ""))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return sorted(
        ((d, n, m, g, len(p), sum(counts[x] == most[x[1]] for x in p), sum(counts[x] for x in p), s) for d, n, m, g, p, s in docs),
        key=repr,
    )


def corpus(seed):
    rng = random.Random(seed)
    signs = ["the ", "ing", "naïve", " ", "  ", "\n", "日本", "🙂", "<|endoftext|>", "<s>", "▁", "ab12", "...", "\t", "é", "\x00", "Zürich "]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    words = "alpha beta gamma Delta token piece align quick brown 2024 foo_bar".split()
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    rows += [(500 + i, rows[70][1]) for i in range(40)] + rows[:3]
    return rows + [(900, None), (901, ""), (None, "alpha beta"), (902, " "), (903, "<0x41>"), (904, "word " * 300)]


def found(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "clash", 5) for d, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in align.align(df, **FILES, **options).collect()), key=repr)


@pytest.mark.parametrize("size", [200, 8_000_000])
def test_align_equals_overlapping_ranges(spark, size):
    rows = corpus(size)
    assert found(spark, rows, block_chars=size) == plain(rows)


def test_empty_table_and_tables_without_tokens(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "")]) == plain([(1, None), (2, "")])


def test_ranks_are_the_ids_of_the_vocabulary():
    aligner = align.Aligner(**FILES)
    rng = random.Random(8)
    for _ in range(1500):
        text = "".join(chr(rng.choice([*range(1, 0x250), *range(0x2000, 0x2070), 0x65E5, 0x1F642, 0x301])) for _ in range(rng.randrange(1, 40)))
        assert aligner.first.encode_ordinary(" " + text) == FIRST.encode(" " + text, add_special_tokens=False).ids
