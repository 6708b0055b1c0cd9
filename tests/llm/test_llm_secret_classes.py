"""Secrets joined to other text, and secrets of one case."""

import re

import pytest

from parselab.llm import secret_scan


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("9f86d081884c7d659a2feaa0", "entropy_hex:0:24"),
        ("auth=9f86d081884c7d659a2feaa0", "entropy_hex:5:29"),
        ("key-9f86d081884c7d659a2feaa0", "entropy_hex:4:28"),
        ("KEY_9F86D081884C7D659A2FEAA0/x", "entropy_hex:4:28"),
        ("a k3v9x1q7z5m2w8t4r6y0p b", "entropy_lower:2:23"),
        ("ID=K3V9X1Q7Z5M2W8T4R6Y0P", "entropy_upper:3:24"),
        ("stage2checkpointloader internationalisation2024 2024internationalisation", ""),
        ("https://x.org/k3v9x1q7z5m2w8t4r6y0p", ""),
    ],
)
def test_classes(text, expected):
    rule = secret_scan.Entropy()
    allowed = re.compile("|".join(rule.allowed))
    assert secret_scan.joined(secret_scan.all_spans(text, rule, allowed)[1]) == expected
