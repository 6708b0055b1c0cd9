"""Cross-tokenizer alignment: each distinct text is tokenized and aligned once, pairs are counted by blocks and looked up by blocks."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parselab.llm.common import small_batches
from parselab.llm.exchange import block_table, groups, numbers, pack, planes, unpack, with_answers
from parselab.llm.token_ids import once
from parselab.session import written

PORTION = 500_000  # characters aligned at a time
BLOCK_CHARS = 8_000_000
WIDE = 1 << 31  # ids of both vocabularies as one number; at most 65 536 and 32 768 ids
NARROW = 1 << 15
MEASURES = ("n_a", "n_b", "n_groups", "n_links")
BLOCKS = (
    "block bigint, keys array<string>, times array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>,"
    " n_links array<bigint>, groups_sha256 array<string>, n_entries bigint, entries binary, links binary"
)
COUNTED = "block bigint, bucket bigint, n bigint, counts binary, ids binary"
FOUND = (
    "key string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
)
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Aligner:
    """Two tokenizers over the bytes of a space and the text: byte-level ranks (A) and a sentence-piece model (B)."""

    def __init__(self, ranks: str, pattern: str, model: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as lines:
            tokens = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.first = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=tokens, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=model)
        self.of_a = [b""] * (max(tokens.values()) + 1)
        for token, rank in tokens.items():
            self.of_a[rank] = token
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.of_b = [
            bytes.fromhex(BYTE.fullmatch(p)[1]) if self.second.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        if len(self.of_a) > WIDE // NARROW or len(self.of_b) > NARROW:
            raise ValueError("a vocabulary has too many ids")
        self.size_a, self.size_b = (np.array([len(t) for t in of], np.int64) for of in (self.of_a, self.of_b))
        # Decimal numbers with the sign that follows them, as rows of a table.
        signs = [f"{i}{sign}".encode() for i in range(max(len(self.of_a), len(self.of_b))) for sign in ",|;"]
        self.shown_size = np.array([len(s) for s in signs], np.int64)
        width = int(self.shown_size.max())
        self.shown = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in signs), np.uint8).reshape(-1, width)

    def tokens(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of each text by A and B; none where the joined bytes of either differ from a space and the text."""
        for text, b in zip(texts, self.second.encode(texts, num_threads=1), strict=True):
            a = self.first.encode_ordinary(" " + text)
            whole = b" " + text.encode("utf-8", "replace")
            same = text and b"".join([self.of_b[i] for i in b]) == whole and b"".join([self.of_a[i] for i in a]) == whole
            yield (a, b) if same else ([], [])

    def align(self, texts: list[str]) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
        """Measures and digest of each text; its distinct pairs as ``text * WIDE + a * NARROW + b``, and how many links hold each.

        All texts are laid one after the other: a text ends both in A and in B, so no group or link goes beyond it. Every stretch
        between two neighbouring token ends is just one link.
        """
        cut = list(self.tokens(texts))
        n_a, n_b = (np.array([len(c[side]) for c in cut], np.int64) for side in (0, 1))
        a, b = (np.array([i for c in cut for i in c[side]], np.int64) for side in (0, 1))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.concatenate((ends_a, ends_b))
        order = np.argsort(ends, kind="stable")  # two sorted runs; of equal ends that of A comes first
        ends, in_a = ends[order], order < len(a)
        starts = groups(ends)
        both = np.diff(starts, append=len(ends)) > 1
        at_a = in_a[starts]
        at_b = both | ~at_a
        index_a, index_b = np.cumsum(at_a) - at_a, np.cumsum(at_b) - at_b
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        text_of_a = np.repeat(np.arange(len(texts)), n_a)
        text = text_of_a[index_a] if len(a) else np.zeros(0, np.int64)
        count = lambda of: np.bincount(of, minlength=len(texts)).tolist()
        keys = np.sort(text * WIDE + a[index_a] * NARROW + b[index_b])
        first = groups(keys)
        made = {
            "n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": count(text[both]), "n_links": count(text),
            "groups_sha256": self._digests(a, b, index_a[both], index_b[both], last_a, last_b),
        }
        return made, keys[first], np.diff(first, append=len(keys))

    def _digests(self, a, b, closes_a, closes_b, last_a, last_b) -> list[str]:
        """Digest of the groups of each text; ``closes_a`` and ``closes_b`` are the last tokens of the groups."""
        shut_a, shut_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        shut_a[closes_a], shut_b[closes_b] = 1, 1
        group_a, group_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
        before = np.concatenate(([0], closes_b + 1))
        row = np.empty(len(a) + len(b), np.int64)
        row[np.arange(len(a)) + before[group_a]] = 3 * a + shut_a
        row[np.arange(len(b)) + closes_a[group_b] + 1 if len(b) else []] = 3 * b + 2 * shut_b
        sizes = self.shown_size[row]
        chars = self.shown[row]
        data = chars[np.arange(chars.shape[1]) < sizes[:, None]].tobytes()
        stops = np.concatenate(([0], np.cumsum(sizes)))[last_a + last_b].tolist()
        found, at = [], 0
        for stop in stops:
            found.append(sha256(data[at : stop - 1]).hexdigest() if stop > at else "")
            at = stop
        return found


def _mixed(pairs: np.ndarray, buckets: int) -> np.ndarray:
    x = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def _aligned(distinct: DataFrame, ranks: str, pattern: str, model: str, size: int) -> DataFrame:
    """Rows (text, key, times) as blocks of about ``size`` characters."""
    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, first, made = once(Aligner, ranks, pattern, model), TaskContext.get().partitionId() << 32, 0
        held: dict[str, list] = {}
        chars = texts_held = 0

        def add(rows: list[tuple[str, str, int]]) -> None:
            nonlocal texts_held
            texts, keys, times = map(list, zip(*rows, strict=True))
            found, entries, links = aligner.align(texts)
            more = found | {"keys": keys, "times": times}
            for name, values in more.items():
                held.setdefault(name, []).extend(values)
            held.setdefault("entries", []).append(entries + texts_held * WIDE)
            held.setdefault("links", []).append(links)
            texts_held += len(texts)

        def block() -> pa.RecordBatch:
            entries, links = np.concatenate(held.pop("entries")), np.concatenate(held.pop("links"))
            row = held | {
                "block": first + made, "n_entries": len(entries),
                "entries": pack(entries.astype(np.uint64)), "links": planes(links.astype(np.uint64)),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        some, size_of_some = [], 0
        for part in parts:
            for row in zip(*(part.column(c).to_pylist() for c in ("text", "key", "times")), strict=True):
                some.append(row)
                size_of_some += len(row[0])
                if size_of_some >= PORTION:
                    add(some)
                    chars, some, size_of_some = chars + size_of_some, [], 0
                    if chars >= size:
                        yield block()
                        made, held, chars, texts_held = made + 1, {}, 0, 0
        if some:
            add(some)
        if held:
            yield block()

    return distinct.mapInArrow(run, BLOCKS)


def _entries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, pair and links of each entry of a block, and its texts' times."""
    entries = unpack(row["entries"], row["n_entries"]).astype(np.int64)
    links = numbers(row["links"], row["n_entries"]).astype(np.int64)
    return entries // WIDE, entries % WIDE, links, np.array(row["times"], np.int64)


def _counted(blocks: DataFrame, buckets: int) -> DataFrame:
    """Rows ``COUNTED``: for each block and bucket the counts of the pairs that the block sent, in their order.

    A row without block has the greatest count of each B id (``ids``) among the bucket's pairs.
    """

    def sent(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                text, pairs, links, times = _entries(row)
                distinct, at = np.unique(pairs, return_inverse=True)
                counts = np.zeros(len(distinct), np.int64)
                np.add.at(counts, at, links * times[text])
                to = _mixed(distinct, buckets)
                order = np.argsort(to, kind="stable")
                for own in np.split(order, groups(to[order])[1:]) if len(order) else ():
                    out = {
                        "bucket": int(to[own[0]]), "block": row["block"], "n": len(own),
                        "pairs": pack(distinct[own].astype(np.uint64)), "counts": planes(counts[own].astype(np.uint64)),
                    }
                    yield pa.RecordBatch.from_pylist([out], schema=dealt_schema)

    dealt_ddl = "bucket bigint, block bigint, n bigint, pairs binary, counts binary"
    dealt_schema, schema = (to_arrow_schema(StructType.fromDDL(s)) for s in (dealt_ddl, COUNTED))

    def total(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        pairs = np.concatenate([unpack(r["pairs"], r["n"]) for r in rows]).astype(np.int64)
        counts = np.concatenate([numbers(r["counts"], r["n"]) for r in rows]).astype(np.int64)
        distinct, at = np.unique(pairs, return_inverse=True)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, at, counts)
        most = np.zeros(NARROW, np.int64)
        np.maximum.at(most, distinct % NARROW, sums)
        ids = np.flatnonzero(most)
        made = [{
            "block": None, "bucket": key[0].as_py(), "n": len(ids),
            "counts": planes(most[ids].astype(np.uint64)), "ids": pack(ids.astype(np.uint64)),
        }]
        for r, own in zip(rows, np.split(sums[at], np.cumsum([r["n"] for r in rows])[:-1]), strict=True):
            counts = planes(own.astype(np.uint64))
            made.append({"block": r["block"], "bucket": r["bucket"], "n": r["n"], "counts": counts, "ids": None})
        return pa.Table.from_pylist(made, schema=schema)

    narrow = blocks.select("block", "times", "n_entries", "entries", "links")
    return narrow.mapInArrow(sent, dealt_ddl).groupBy("bucket").applyInArrow(total, COUNTED)


def _greatest(counted: DataFrame) -> np.ndarray:
    """The greatest count of each B id: one number per id of the vocabulary, whatever the size of the corpus."""
    schema = to_arrow_schema(StructType.fromDDL("id int, most bigint"))

    def per_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(NARROW, np.int64)
        for part in parts:
            for row in part.to_pylist():
                ids = unpack(row["ids"], row["n"]).astype(np.int64)
                most[ids] = np.maximum(most[ids], numbers(row["counts"], row["n"]).astype(np.int64))
        ids = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(most[ids])], schema=schema)

    tops = counted.where("block is null").select("n", "counts", "ids").mapInArrow(per_task, "id int, most bigint")
    rows = tops.groupBy("id").agg(F.max("most").alias("most")).toArrow()  # at most NARROW rows
    most = np.zeros(NARROW, np.int64)
    most[rows["id"].to_numpy()] = rows["most"].to_numpy()
    return most


def _measured(asked: DataFrame, most, buckets: int) -> DataFrame:
    """``FOUND`` of each text of the blocks."""
    schema = to_arrow_schema(StructType.fromDDL(FOUND))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                (row,) = part.slice(k, 1).to_pylist()
                text, pairs, links, _ = _entries(row)
                distinct, at = np.unique(pairs, return_inverse=True)
                to = _mixed(distinct, buckets)
                order = np.argsort(to, kind="stable")
                counts = np.zeros(len(distinct), np.int64)
                own = sorted(row["answers"] or (), key=lambda a: a["bucket"])
                if own:
                    counts[order] = np.concatenate([numbers(a["counts"], a["n"]) for a in own]).astype(np.int64)
                best = counts == most.value[distinct % NARROW]
                sums, tops = np.zeros(len(row["keys"]), np.int64), np.zeros(len(row["keys"]), np.int64)
                np.add.at(sums, text, links * counts[at])
                np.add.at(tops, text, links * best[at])
                made = {name: row[name] for name in MEASURES}
                made |= {"key": row["keys"], "n_best": tops, "count_sum": sums, "groups_sha256": row["groups_sha256"]}
                yield pa.RecordBatch.from_pydict({name: made[name] for name in schema.names}, schema=schema)

    return asked.mapInArrow(run, FOUND)


def align(
    df: DataFrame, ranks: str, pattern: str, model: str, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Places where a token of both vocabularies ends cut the tokens into groups; a link is a pair of tokens whose bytes overlap. The
    count of a pair of ids is its links over all documents; ``n_best`` counts a document's links whose pair is the most frequent of
    its B id (ties included), ``count_sum`` sums the counts over its links.

    Rows are shuffled by their whole text, and equal texts become one row with its number of copies before anything is tokenized.
    Distinct texts lie in blocks. A block sends its distinct pairs with their counts, weighted by copies, to buckets by a hash
    of the pair, so that a frequent pair is one entry a block; the counts come back to the block. Greatest counts by B id are as many
    numbers as the vocabulary has ids. Measures reach the documents by the text's digest.

    Null and empty texts, and texts that a tokenizer changes, have no tokens: zeros and an empty digest. Repeated rows count each. An
    empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    own = F.when(F.col(f"`{text}`") != "", F.sha2(F.col(f"`{text}`"), 256))
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"), own.alias("key"))
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("times"))
    distinct = distinct.select("text", F.sha2("text", 256).alias("key"), "times")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    made = _aligned(distinct, ranks, pattern, model, block_chars)
    with small_batches(spark, 256), block_table(made, -(-total // block_chars)) as blocks:
        buckets = max(1, blocks.count())
        with small_batches(spark, 1):
            counted = written(_counted(blocks, buckets), "counted")
            most = spark.sparkContext.broadcast(_greatest(counted))
            answers = counted.where("block is not null").select("block", "bucket", "n", "counts")
            found = written(_measured(with_answers(blocks, answers), most, buckets), "measured")
    zero = {name: F.coalesce(name, F.lit(0)).alias(name) for name in (*MEASURES, "n_best", "count_sum")}
    joined = rows.select("doc_id", "key").join(found, "key", "left")
    return joined.select("doc_id", *zero.values(), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
