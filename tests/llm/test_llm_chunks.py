"""The chunk rule on texts of one full chunk, and on the rest of a text."""

import base64

import numpy as np
import zstandard

from parselab.llm import quality


def test_one_full_chunk():
    r = np.random.default_rng(6)
    noise = base64.b85encode(r.bytes(4096)).decode()
    head = " ".join(noise[i : i + 9] for i in range(0, len(noise), 9))[:4096]
    words = ["the", "river", "town", "old", "stone", "bridge", "market", "winter", "people", "north", "light", "house"]
    prose = " ".join(f"{words[k]}{k % 3}" for k in r.integers(0, len(words), 580))[:3900]
    press, bands = zstandard.ZstdCompressor(level=3), quality.Bands()
    for text in (head + prose, "ab" * 2048 + prose):
        data = text.encode()
        assert 4096 <= len(data) < 8192
        whole, chunks = quality.ratios(data, bands, press)
        assert chunks == [len(press.compress(part)) / 4096 for part in (data[:4096], data[-4096:])]
        assert bands.limits[3][1] <= whole <= bands.limits[3][2] or text.startswith("ab")
        assert not quality.in_bands(len(data), whole, chunks, bands)
        assert not quality.judge(text, bands, press)[-1]
    assert bands.chunk_limits[1] < quality.ratios((head + prose).encode(), bands, press)[1][0]


def test_the_rest_of_a_text_is_in_a_chunk():
    r = np.random.default_rng(7)
    words = [f"w{k}" for k in r.integers(0, 700, 9000)]
    prose = " ".join(words)[: 4096 * 2]
    noise = base64.b85encode(r.bytes(3200)).decode()[:3900]
    press, bands = zstandard.ZstdCompressor(level=3), quality.Bands()
    whole, chunks = quality.ratios((prose + noise).encode(), bands, press)
    assert len(chunks) == 3 and chunks[:2] == quality.ratios(prose.encode(), bands, press)[1]
    assert chunks[2] > bands.chunk_limits[1] and not quality.in_bands(len(prose + noise), whole, chunks, bands)
    assert quality.ratios(b"x" * 4095, bands, press)[1] == []
