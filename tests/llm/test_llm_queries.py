"""The registered queries and the pipeline on the smallest tables, against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from test_llm_documents import check_packing, components_of, repeated

import corpus_pipeline
from parselab.llm.quality import Bands
from parselab.llm.registry import QUERIES, SQL, tokenizer

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def benchmark(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]


def test_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near duplicates", "benchmark decontamination", "secret scans", "packing",
    ]


def plain_verdict(text):
    """(base_failed, kept) of one text."""
    words = WORDS.findall(text)
    failed = len(words) < 10 or 100 * repeated(words) > 20 * len(words)
    data, bands = text.encode(), Bands()

    def ratio(part):
        return len(zstandard.ZstdCompressor(level=bands.level).compress(part)) / len(part)

    if failed or not data:
        return failed, False
    _, low, high = [x for x in bands.limits if len(data) <= x[0]][0]
    chunks = [ratio(data[i : i + bands.chunk]) for i in range(0, len(data) - bands.chunk + 1, bands.chunk)]
    chunks += [ratio(data[-bands.chunk :])] * (len(data) > bands.chunk and len(data) % bands.chunk > 0)
    outside = [c for c in chunks if not bands.chunk_limits[0] <= c <= bands.chunk_limits[1]]
    return failed, low <= ratio(data) <= high and len(outside) <= bands.chunk_share * len(chunks)


def test_op6(spark, documents):
    found = {r.doc_id: r for r in QUERIES["op6_quality"](spark, FOLDER).collect()}
    assert len(found) == len(documents)
    for i, t in documents:
        assert (found[i].base_failed, found[i].kept) == plain_verdict(t)
        words = WORDS.findall(t)
        assert (found[i].n_words, found[i].word_chars) == (len(words), sum(map(len, words)))


def plain_base(text):
    spans = []
    keyword = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    spans += [(m.start(), 0, m.end(), "assign") for m in keyword.finditer(text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def plain_entropy(text):
    """Windows of 20 that reach their limit, by counting each window anew: code points covered."""
    covered = set()
    for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
        for i in range(m.start(), m.end() - 19):
            window = text[i : i + 20]
            bits = -sum(c / 20 * math.log2(c / 20) for c in Counter(window).values())
            if re.search("[0-9]", window) and re.search("[a-z]", window) and re.search("[A-Z]", window) and bits >= 3.9:
                covered.update(range(i, i + 20))
    return covered


def test_op8(spark, documents):
    found = {r.doc_id: r for r in QUERIES["op8_secrets"](spark, FOLDER).collect()}
    assert len(found) == len(documents)
    for i, t in documents:
        base = plain_base(t)
        joined = ",".join(f"{k}:{a}:{z}" for a, _, z, k in base)
        assert found[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(found[i].spans.split(","))
        if not base and not re.search(r"://|@", t):
            added = [s.split(":") for s in found[i].spans.split(",") if s.startswith("entropy_base64")]
            assert {c for _, a, z in added for c in range(int(a), int(z))} == plain_entropy(t)


def leaked_items(text, benchmark, least=5, percent=60):
    """Items of which runs of five words that stand in the text cover enough."""
    words = re.findall(r"\w+", text.lower())
    runs = {tuple(words[k : k + least]) for k in range(len(words) - least + 1)}
    out = set()
    for i, item in benchmark:
        own = re.findall(r"\w+", item.lower())
        covered = {k + j for k in range(len(own) - least + 1) if tuple(own[k : k + least]) in runs for j in range(least)}
        if own and 100 * len(covered) >= percent * len(own):
            out.add(i)
    return out


def test_op7(spark, documents, benchmark):
    found = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontamination"](spark, FOLDER).collect()}
    assert found == {(i, item) for i, t in documents for item in leaked_items(t, benchmark)}


def test_op5(spark, documents):
    found = QUERIES["op5_near_duplicates"](spark, FOLDER).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(components_of(documents, 2))


def test_op3_and_op4(spark, documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    found = {r.doc_id: r.n_tokens for r in QUERIES["op3_token_counts"](spark, FOLDER).collect()}
    assert found == {i: len(library.encode(t)) for i, t in documents}
    shards = QUERIES["op4_sharding"](spark, FOLDER).collect()
    assert {(r.doc_id, r.text_crc32) for r in shards} == {(i, zlib.crc32(t.encode())) for i, t in documents}


def ids_of(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    return Counter((i, np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in texts)


def test_op9_and_op2(spark, documents):
    rows = QUERIES["op9_packing"](spark, FOLDER).collect()
    check_packing(rows, ids_of(documents), 4096)
    assert sum(r.length for r in rows) > 0.97 * 4096 * (len({r.sequence_id for r in rows}) - 1)
    matrix = QUERIES["op2_token_matrix"](spark, FOLDER).collect()
    assert Counter(i for r in matrix for i, s in zip(r.doc_ids, r.starts, strict=True) if s == 0) == Counter(i for i, _ in documents)


def masked(text):
    """Base spans masked; documents here have no other."""
    pieces, at = [], 0
    for a, _, z, _ in plain_base(text):
        if a >= at:
            pieces += [text[at:a], "[SECRET]"]
        at = max(at, z)
    return "".join([*pieces, text[at:]])


def test_pipeline(spark, documents, benchmark):
    kept = [(i, t) for i, t in documents if plain_verdict(t)[1]]
    kept = [(i, t) for (i, t), (_, _, c) in zip(kept, components_of(kept, 5), strict=True) if i == c]
    kept = [(i, masked(t)) for i, t in kept if not leaked_items(t, benchmark)]
    assert corpus_pipeline.ORACLE_SQL is None
    check_packing(corpus_pipeline.run(spark, FOLDER).collect(), ids_of(kept), 4096)


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = con.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    found = QUERIES[name](spark, FOLDER)
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(names).collect())) == sorted(cursor.fetchall())


def test_op11(spark, documents):
    from test_llm_substring import plain

    found = QUERIES["op11_substring"](spark, FOLDER).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, found), key=repr) == plain(documents)


def test_op12(spark, documents):
    from test_llm_align import cut

    found = {r.doc_id: r for r in QUERIES["op12_alignment"](spark, FOLDER).collect()}
    assert len(found) == len(documents)
    for i, t in documents:
        a, b, ends_a, ends_b = cut(t or "")
        common = {e for _, e in ends_a} & {e for _, e in ends_b}
        links = len({e for _, e in ends_a} | {e for _, e in ends_b})
        assert (found[i].n_a, found[i].n_b, found[i].n_groups, found[i].n_links) == (len(a), len(b), len(common), links)


def test_op13(spark):
    from test_llm_merkle import plain

    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    found = QUERIES["op13_merkle_manifest"](spark, FOLDER).collect()
    assert sorted(map(tuple, found), key=repr) == plain([(*r, 0, "") for r in rows])
