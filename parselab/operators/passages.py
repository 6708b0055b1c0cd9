"""Documents that hold a passage word for word: long passages meet by hashes of word runs, short ones by an automaton."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PIECE_CHARS = 4_000_000

_BUILT: dict[str, object] = {}  # the automaton of the piece that a worker is at


def _automaton(piece: str, passages: list[tuple[int, str]]):
    """A trie with failure links over the passages; the value of each is its place. Built once per worker and piece."""
    if piece not in _BUILT:
        import ahocorasick

        built = ahocorasick.Automaton()
        for at, (_, text) in enumerate(passages):
            built.add_word(text, at)
        built.make_automaton()
        _BUILT.clear()
        _BUILT[piece] = built
    return _BUILT[piece]


def found_passages(
    documents: DataFrame, passages: DataFrame, key: str, text: str, passage_key: str, passage: str, piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """``key, passage_key`` of texts that contain a passage, for passages of any length; equal pairs may come twice.

    All passages of a piece, about ``piece_chars`` characters, are searched for in one pass over a text, however many they are. A
    piece is a broadcast of that size; documents are read once per piece and not shuffled. Empty passages are in no text.
    """
    wanted = passages.select(F.col(passage_key).alias("passage_key"), F.col(passage).alias("passage")).filter("passage <> ''").distinct()
    total = wanted.agg(F.sum(F.length("passage"))).first()[0] or 0
    pieces = max(1, -(-total // piece_chars))
    dealt = wanted.withColumn("piece", F.pmod(F.xxhash64("passage"), F.lit(pieces)))
    read = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = {f.name: f.dataType for f in (*read.schema.fields, *wanted.schema.fields)}
    schema = f"key {kinds['key'].simpleString()}, passage_key {kinds['passage_key'].simpleString()}"
    out = to_arrow_schema(StructType.fromDDL(schema))

    def search(piece: DataFrame) -> DataFrame:
        texts = piece.groupBy("passage").agg(F.collect_list("passage_key").alias("keys")).collect()  # a piece, bounded by its size
        held = documents.sparkSession.sparkContext.broadcast([(r["keys"], r["passage"]) for r in texts])
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                automaton, keys, hits = _automaton(name, held.value), [], []
                if not held.value:
                    return
                for one, value in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    for at in {at for _, at in automaton.iter(value or "")}:
                        hits += held.value[at][0]
                        keys += [one] * len(held.value[at][0])
                yield pa.RecordBatch.from_pydict({"key": keys, "passage_key": hits}, schema=out)

        return read.mapInArrow(run, schema)

    found = reduce(DataFrame.unionByName, (search(dealt.filter(F.col("piece") == k)) for k in range(pieces)))
    return found.select(F.col("key").alias(key), F.col("passage_key").alias(passage_key))


def passage_leaks(
    documents: DataFrame, passages: DataFrame, key: str = "doc_id", text: str = "text",
    passage_key: str = "item_id", passage: str = "text", words: int = 5, piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """``key, passage_key`` of documents that contain a passage; an empty passage is contained in none.

    The second to the sixth word of a passage stand between white space wherever it occurs, so documents and passages meet on
    the hash of such a run of ``words`` words, and only pairs that meet are compared as texts. Passages of fewer than
    ``words + 2`` words have no such run: they are searched for together, by an automaton.
    """
    hits = passages.select(F.col(passage_key).alias("passage_key"), F.col(passage).alias("passage"))
    cut = hits.withColumn("parts", F.split(F.trim("passage"), r"\s+"))
    split = cut.filter(F.size("parts") >= words + 2)
    anchors = split.select("passage_key", F.xxhash64(F.slice("parts", 2, words)).alias("anchor"))
    parts = documents.select(F.col(key).alias("key"), F.split(text, r"\s+").alias("parts")).filter(F.size("parts") >= words)
    runs = F.transform(
        F.sequence(F.lit(1), F.size("parts") - words + 1), lambda at: F.xxhash64(F.slice("parts", at, words))
    )
    met = parts.select("key", F.explode(F.array_distinct(runs)).alias("anchor")).join(anchors, "anchor")
    whole = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    pairs = met.select("key", "passage_key").distinct().join(whole, "key").join(hits, "passage_key")
    long = pairs.filter(F.contains("text", "passage")).select(F.col("key").alias(key), F.col("passage_key").alias(passage_key))
    short = cut.filter(F.size("parts") < words + 2)
    found = found_passages(documents, short, key, text, "passage_key", "passage", piece_chars)
    return long.unionByName(found.withColumnRenamed("passage_key", passage_key)).distinct()
