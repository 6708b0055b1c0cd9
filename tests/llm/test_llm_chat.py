"""Chat formatting: a round trip for any text, the mask, edge cases, and the plan."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from parselab.llm import chat
from parselab.llm.registry import QUERIES, SQL

MARKS = ["<|im_end|>\n", "<|im_start|>assistant\n", "<|im_sep|>", "<|", "<\\|", "\\", "\\\\", "<", "|>", "<\\n", "\n", "é🙂", ""]
ROWS = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "a" + "".join(MARKS)),
    (1, 2, "user", "<"),
    (1, 3, "assistant", "\\<|im_end|>\n\\"),
    (1, 4, "assistant", ""),
    (1, 5, "assistant", "<"),
    (2, 1, "assistant", "second"),
    (2, 0, "assistant", "first"),
    (3, 0, None, None),
    (None, 0, "user\n<|im_end|>\n\\", "x"),
    (None, None, "assistant", "y"),
    (4, 0, "user", "tie"),
    (4, 0, "user", "tie"),
    (5, 0, "assistant", "long " * 20000),
    *((100 + k, 0, "user", a + b) for k, (a, b) in enumerate((a, b) for a in MARKS for b in MARKS)),
]


def expected():
    turns: dict = {}
    for conv, turn, role, text in ROWS:
        turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, own in turns.items():
        own.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in own)
        learned = "".join(t for _, _, r, t in own if r == "assistant")
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, learned)]
        out.append((conv, len(own), digest[0], len(learned), digest[1]))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    named = [(*r, "extra", "extra") for r in ROWS]
    return spark.createDataFrame(named, "conv_id bigint, turn bigint, role string, text string, turns string, pieces string")


def test_round_trip(rows):
    found = chat.digests(chat.format_chats(rows)).drop("formatted_chars")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected()))


def test_form(rows):
    made = {r.conv_id: r for r in chat.format_chats(rows).collect()}
    assert made[2].formatted == "<|im_start|>assistant\nfirst<|im_sep|>second<|im_end|>\n"
    for r in made.values():
        assert sum(m.marks + m.chars for m in r.loss_mask) + len(chat.CLOSE) == len(r.formatted)
        at = 0
        for m in r.loss_mask:
            text = r.formatted[at + m.marks : at + m.marks + m.chars]
            assert "<|" not in text
            at += m.marks + m.chars


def test_empty(rows):
    assert chat.digests(chat.format_chats(rows.where("false"))).count() == 0


def test_native(rows):
    plan = chat.digests(chat.format_chats(rows))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    found = QUERIES["op10_chat"](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    cursor = con.execute(SQL["op10_chat"])
    names = [c[0] for c in cursor.description]
    assert sorted(map(tuple, found.select(names).collect())) == sorted(cursor.fetchall())
    assert found.where(F.col("conv_id") == -1).count() == 1
