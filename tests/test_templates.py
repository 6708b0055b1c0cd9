"""Reading templates: against lazy groups, and in time linear in the log."""

import hashlib
import random
import re
import time

from parselab.functions import fixed, templates
from pyspark.sql import functions as F


def lazy(log, template):
    parts = template.split("<*>")
    found = re.fullmatch("(.+?)".join(map(re.escape, parts)), log, re.DOTALL)
    return list(found.groups()) if found else None


def test_slots_equal_lazy_groups(spark):
    r = random.Random(7)
    rows = [("user 5 in", "user <*> in"), ("ab", "<*><*>"), ("a", "<*><*>"), ("", "<*>"), ("x.y\n", "x<*>y<*>"), ("a", "a")]
    for _ in range(1500):
        template = "".join(r.choice(["<*>", "a", "b", "ab", " ", "é", "\\E", "."]) for _ in range(r.randint(1, 7)))
        log = "".join(r.choice(["a", "b", "ab", " ", "é", "\\E", ".", "c\n"]) for _ in range(r.randint(0, 9)))
        rows.append((log, template))
        rows.append((template.replace("<*>", r.choice(["a", "b a", "é"])), template))
    df = spark.createDataFrame(rows, "log string, template string")
    log, template = F.col("log"), F.col("template")
    found = df.select("*", templates.read_slots(log, template).alias("slots"), templates.matches(log, template).alias("fits"))
    for row in found.collect():
        assert row["slots"] == lazy(row["log"], row["template"]), row
        assert row["fits"] == (row["slots"] is not None)


def test_many_slots_and_control_characters(spark):
    many = "<*>,".join(f"p{k}" for k in range(90))
    rows = [(many.replace("<*>", "v"), many), (many.replace("<*>", "v") + "x", many)]
    rows += [("\x02a b", "<*> b"), ("a\x1fb c", "<*> c"), ("\x02", "<*>x"), ("\x02x", "<*>x"), ("$1 (a) [b] {c} \\d ^", "$1 (<*>) [<*>] {c} \\d ^")]
    df = spark.createDataFrame(rows, "log string, template string")
    found = df.select("*", templates.read_slots(F.col("log"), F.col("template")).alias("slots"), templates.matches(F.col("log"), F.col("template")).alias("fits"))
    for row in found.collect():
        assert row["slots"] == lazy(row["log"], row["template"]), row
        assert row["fits"] == (row["slots"] is not None)


def test_missing(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "log string, template string")
    assert [r[0] for r in df.select(templates.matches(F.col("log"), F.col("template"))).collect()] == [None, None]


def test_long_log_that_does_not_fit(spark):
    log = " ".join(f"word{k % 50}" for k in range(20_000))
    template = "word0 " + "<*> word1 " * 8 + "never"
    df = spark.createDataFrame([(log, template)], "log string, template string").cache()
    df.count()
    start = time.perf_counter()
    assert [r[0] for r in df.select(templates.matches(F.col("log"), F.col("template"))).collect()] == [False]
    assert time.perf_counter() - start < 5


def test_wording_is_pinned():
    """Request keys are hashes of prompts, so no letter of their wording may change."""
    names = [n for n in dir(fixed) if n.isupper() and isinstance(getattr(fixed, n), str)]
    found = {n: hashlib.md5(getattr(fixed, n).encode()).hexdigest() for n in names if len(getattr(fixed, n)) > 80}
    assert found == PINNED


PINNED = {
    "ANALYSIS_HEADER": "d3e9349b7aab2ff145f307d4b23b8818",
    "AUGMENT_REWRITE": "18ac6ff12b5f792bcd7af26f3cbb4b6c",
    "AUGMENT_SEMANTIC": "ef375133dfe6324d85c0f44b5c856ee3",
    "AUGMENT_SUBSTITUTE": "f5925bcfd9b64e879e93e13928dae469",
    "AUGMENT_SYSTEM": "26c98dc1cf7e7bc8f1701612c79c7c9b",
    "CLASSIFY_USER": "aae3672754eacbd233625c9b91848cc3",
    "ERROR_SYSTEM": "070701c10658b5d06d789f0db704683f",
    "ERROR_USER": "98c6295caad5aca365ce25f40658d56e",
    "INSTRUCTION": "4341fcc71bb185b31da0fe1de8f63f30",
    "MERGED_HEADER": "a6852692a0708347b6eba773b76e11f4",
    "PARSE_PROMPT": "b6a217e7d8a8d2e4c97d1dc82c6a49d4",
    "TAXONOMY_SYSTEM": "aae006c21001baa519582f92350c6105",
    "TAXONOMY_USER": "29220266018b65055f1a6e3935f3d637",
    "TOPUP_REWRITE": "877b7fc6ba2a0562c9686bf3e3c2002f",
    "TOPUP_SEMANTIC": "b52dce0ca3393543013dbe37b702296d",
    "TOPUP_SUBSTITUTE": "3f681e7f489721cf6360a10b7cd0c16a",
}
