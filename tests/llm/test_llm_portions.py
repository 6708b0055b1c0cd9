"""Packing holds the words of few texts at a time, and tokenizes a word once."""

import numpy as np
from tokenizers import Tokenizer

from parselab.llm import packing
from parselab.llm.registry import tokenizer
from parselab.llm.token_ids import WordIds


class Lengths:
    """Stands in for an encoder: a text becomes its length, and the sizes of the calls are noted."""

    def __init__(self):
        self.sizes = []

    def encode(self, texts):
        self.sizes.append(sum(map(len, texts)))
        return (np.array([len(t)], "<u4").tobytes() for t in texts)


def test_a_batch_is_encoded_in_small_portions(monkeypatch):
    encoder = Lengths()
    monkeypatch.setattr(packing, "once", lambda *_: encoder)
    texts = ["x" * n for n in range(150_000, 150_060)]
    found = [np.frombuffer(ids, "<u4").tolist() for ids in packing.document_ids(texts, "any", 2)]
    assert found == [[len(t), 2] for t in texts]
    assert max(encoder.sizes) <= 2_000_000 + max(map(len, texts))


def test_a_word_is_tokenized_once_whatever_stands_after_it():
    words = WordIds(tokenizer("word_bpe_49k.json"))
    asked, tokenize = [], words.tokenize
    words.tokenize = lambda word: asked.append(word) or tokenize(word)
    for text in ("thing", "Thing, thing", "thing.\nthing;", "THING!? thing***\n\nthing"):
        list(words.encode([text]))
    assert asked == ["thing"]


def test_words_have_the_ids_of_the_library():
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    parts = ["a", "Ünd", "schö", "ÿ.", "don't", "it's,", "x1.", ".", "***", ",$$$", "é́.", "é,", "́", "Σ.", "İ!", "日本,", "1,",
             "<|endoftext|>", "<|ENDOFTEXT|>.", "<|startoftext", "|>", "\x01", " ", " .", "ß&&&"]
    between = ["", " ", "  ", "\n", "\n\n", " \n ", "\t", "\r\n"]
    r = np.random.default_rng(3)
    texts = ["".join(part for _ in range(r.integers(0, 12)) for part in (r.choice(parts), r.choice(between))) for _ in range(3000)]
    texts += ["", " ", "\n", "a.", "a. ", "a.\n", "a,\n.b"]
    found = WordIds(tokenizer("word_bpe_49k.json"), 100).encode(texts)
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
