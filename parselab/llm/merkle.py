"""Merkle manifest of a dataset: persistent path-copying trees in aligned blocks, versions that go on upwards block by block."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parselab.session import written

ARITY = 3
HEIGHT = 6  # levels of a block: 729 leaves
LIST = ["no_list", "list"]
SIDES = "array<struct<before: string, after: string>>"
NODES = "no_list boolean, list string, place bigint, hash string, m bigint"
PROOFS = (
    "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes: int) -> int:
    """Levels until one node remains."""
    height = 0
    while nodes > 1:
        nodes, height = -(-nodes // ARITY), height + 1
    return height


@dataclass(frozen=True)
class Tree:
    """All levels over the nodes of a block; a tree is never changed, versions share it."""

    levels: tuple[tuple[str, ...], ...]

    @classmethod
    def over(cls, nodes: list[str], height: int) -> Tree:
        """``height`` levels above ``nodes``; the last run of a level may be shorter, even one node."""
        levels = [tuple(nodes)]
        for _ in range(height):
            below = levels[-1]
            levels.append(tuple(digest(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)))
        return cls(tuple(levels))

    @property
    def root(self) -> str:
        (root,) = self.levels[-1]
        return root

    def sides(self, place: int) -> list[tuple[str, str]]:
        """For each level the siblings before and after the path of a leaf, joined."""
        found = []
        for level in self.levels[:-1]:
            first = place - place % ARITY
            found.append(("".join(level[first:place]), "".join(level[place + 1 : first + ARITY])))
            place //= ARITY
        return found

    def version(self, place: int, leaf: str) -> Version:
        return Version(self, place, tuple(path_copy(leaf, self.sides(place))))


@dataclass(frozen=True)
class Version:
    """A tree in which one leaf differs: ``copied`` has the nodes on its path, all others are those of ``base``."""

    base: Tree
    place: int
    copied: tuple[str, ...]

    def node(self, level: int, at: int) -> str:
        return self.copied[level] if at == self.place // ARITY**level else self.base.levels[level][at]

    @property
    def root(self) -> str:
        return self.copied[-1]


def path_copy(node: str, sides: list[tuple[str, str]]) -> Iterator[str]:
    """The node and the copies of its ancestors next to the untouched ``sides``."""
    yield node
    for before, after in sides:
        node = digest(before, node, after)
        yield node


def leaves(
    df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
) -> DataFrame:
    """doc_id, the list's name, leaf and tampered leaf of each row.

    A leaf is the hash of all ``columns``, each as byte count, colon and value, or ``-`` for a null. Rows whose id's checksum is
    even are tampered with: line feeds go from the text.
    """

    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    def leaf(of_text: Column) -> Column:
        parts = [part(of_text if name == text else F.col(f"`{name}`")) for name in columns]
        return F.sha2(F.concat(*parts), 256)

    own, name = F.col(f"`{text}`"), F.col(f"`{source}`").cast("string")
    number = F.col(f"`{key}`").cast("bigint")
    even = F.coalesce(F.crc32(number.cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = even & F.coalesce(F.contains(own, F.lit("\n")), F.lit(False))
    hashed = df.select(
        number.alias("doc_id"), name.isNull().alias("no_list"), F.coalesce(name, F.lit("")).alias("list"),
        leaf(own).alias("hash"),
        F.when(changed, leaf(F.replace(own, F.lit("\n"), F.lit("")))).alias("changed"),
    )
    return hashed.withColumn("tampered", F.coalesce("changed", "hash")).drop("changed")


def placed(rows: DataFrame, ranges: list[Column], order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``place`` (0..) in their list and ``m``, the list's rows; ``order`` starts with the columns of ``LIST``.

    Rows are dealt out by ``ranges``, a short form of the order (a sample of it goes to the driver), and counted where they lie; counts
    by range and list give each range its offset, so no list is sorted or numbered as one, whatever share of the rows it has.
    """
    schema = StructType.fromDDL(f"{_ddl(rows)}, range int, at bigint")
    out = to_arrow_schema(schema)

    def number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, at = TaskContext.get().partitionId(), None, 0
        for part in parts:
            places = []
            for one in zip(part.column("no_list").to_pylist(), part.column("list").to_pylist(), strict=True):
                at = at + 1 if one == last else 0
                last = one
                places.append(at)
            columns = [*part.columns, pa.array([own] * part.num_rows, pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    dealt = written(rows.repartitionByRange(*ranges).sortWithinPartitions(*order).mapInArrow(number, schema), name)
    sizes = dealt.groupBy(*LIST, "range").agg(F.count("*").alias("size"))
    of_list = W.partitionBy(*LIST)
    before = of_list.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select(
        *LIST, "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), F.sum("size").over(of_list).alias("m")
    )
    return dealt.join(offsets, [*LIST, "range"]).withColumn("place", F.col("offset") + F.col("at")).drop("range", "at", "offset")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / F.lit(ARITY**height)).cast("bigint"))


def _tree(rows: list[dict], height: int) -> Tree:
    """The tree of a block; ``rows`` in their order. Where the list goes beyond the block, its height is that of all blocks."""
    m = rows[0]["m"]
    return Tree.over([r["hash"] for r in rows], height if m > ARITY**height else levels_of(m))


def _sorted(table: pa.Table) -> list[dict]:
    return table.sort_by("place").to_pylist()


def _rounds(nodes: DataFrame, height: int) -> list[DataFrame]:
    """``nodes``, the roots of their blocks, the roots of blocks of those, ... down to one node a list."""
    schema = to_arrow_schema(StructType.fromDDL(NODES))

    def root(key: tuple, table: pa.Table) -> pa.Table:
        rows = _sorted(table)
        first = rows[0]
        up = first | {"place": key[2].as_py(), "hash": _tree(rows, height).root, "m": -(-first["m"] // ARITY**height)}
        return pa.Table.from_pylist([{name: up[name] for name in schema.names}], schema=schema)

    rounds = [nodes]
    while True:
        own = _blocks(rounds[-1].select(*LIST, "place", "hash", "m"), height)
        rounds.append(written(own.groupBy(*LIST, "block").applyInArrow(root, NODES), "roots"))
        if (rounds[-1].agg(F.max("m")).first()[0] or 1) == 1:
            return rounds


def _paths(rounds: list[DataFrame], top: DataFrame, height: int, extra: str = "") -> DataFrame:
    """The nodes of the first of ``rounds`` (with the columns ``extra``), each with the sides of its path up to the root.

    ``top`` has them for the last nodes: the columns of ``LIST``, place 0, sides, subroot and root.
    """
    found = top
    for depth in reversed(range(len(rounds) - 1)):
        schema = f"no_list boolean, list string, place bigint, sides {SIDES}, subroot string, root string"
        schema += extra if depth == 0 else ""
        keys = [*LIST, "block"]
        above = found.withColumnRenamed("place", "block").groupBy(*keys)
        found = _blocks(rounds[depth], height).groupBy(*keys).cogroup(above).applyInArrow(_downwards(schema, height), schema)
        found = written(found, "paths")
    return found


def _downwards(schema: str, height: int):
    out = to_arrow_schema(StructType.fromDDL(schema))

    def down(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        rows, (up,) = _sorted(table), above.to_pylist()
        tree = _tree(rows, height)
        made = []
        for at, row in enumerate(rows):
            sides = [{"before": b, "after": a} for b, a in tree.sides(at)] + up["sides"]
            whole = row | {"sides": sides, "subroot": up["subroot"], "root": up["root"]}
            made.append({name: whole[name] for name in out.names})
        return pa.Table.from_pylist(made, schema=out)

    return down


def manifest(
    df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), height: int = HEIGHT,
) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The leaves of a source stand in the order of doc_id (null first, ties by leaf). Every ``ARITY`` neighbours have a parent, until one
    node, the source's subroot, remains; the subroots, null first and then by bytes of the name, have parents in the same way up
    to the root. A block is a subtree of ``height`` levels over an aligned run of nodes: one task holds one block, never a
    source. A tampered leaf is a version of its block that shares all nodes but those of its path; the version's root goes on
    through the blocks above in the same way.

    Texts are hashed where they are read; only hashes and ids are shuffled. Null values are ``-`` in a leaf, a null id is not tampered
    with, repeated rows are leaves of their own. An empty table gives no rows; other columns are not read.
    """
    hashed = written(leaves(df, key, source, text, columns), "hashed")  # ranges are sampled first: texts are read once all the same
    by_id = [*_list_order(), F.asc("doc_id")]
    ranges, order = [*by_id, F.substring("hash", 1, 8).asc()], [*by_id, F.asc("hash"), F.asc("tampered")]
    nodes = written(placed(hashed, ranges, order, "leaves"), "placed")
    rounds = _rounds(nodes, height)

    subroots = rounds[-1].select(
        F.lit(False).alias("no_list"), F.lit("").alias("list"), F.col("no_list").alias("no_source"), F.col("list").alias("source"), "hash"
    )
    by_name = [F.desc("no_source"), F.asc("source")]
    sources = written(placed(subroots, by_name, by_name, "sources"), "sources")
    above = _rounds(sources, height)
    none = F.array().cast(SIDES)
    whole = above[-1].select(*LIST, "place", none.alias("sides"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    named = sources.select(*LIST, "place", "hash", "m", "no_source", "source", F.col("hash").alias("own"))
    paths = _paths([named, *above[1:]], whole, height, ", no_source boolean, source string, own string")
    tops = paths.select(
        F.col("no_source").alias("no_list"), F.col("source").alias("list"), F.lit(0).cast("bigint").alias("place"),
        "sides", F.col("own").alias("subroot"), "root",
    )
    upper = _paths(rounds[1:], tops, height) if len(rounds) > 2 else tops

    out = to_arrow_schema(StructType.fromDDL(PROOFS))

    def prove(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        rows, (up,) = _sorted(table), above.to_pylist()
        tree, higher = _tree(rows, height), [(s["before"], s["after"]) for s in up["sides"]]
        made = []
        for at, row in enumerate(rows):
            version = tree.version(at, row["tampered"])
            *_, folded = path_copy(version.root, higher)
            proof = digest(*(b + a for b, a in tree.sides(at) + higher))
            made.append(
                {"doc_id": row["doc_id"], "leaf": row["hash"], "subroot": up["subroot"], "root": up["root"],
                 "proof_sha256": proof, "folded_root": folded, "verified": folded == up["root"]}
            )
        return pa.Table.from_pylist(made, schema=out)

    keys = [*LIST, "block"]
    own = _blocks(nodes, height).groupBy(*keys)
    return own.cogroup(upper.withColumnRenamed("place", "block").groupBy(*keys)).applyInArrow(prove, PROOFS)


def _list_order() -> list[Column]:
    """Null first, then by the bytes of the name."""
    return [F.desc("no_list"), F.asc("list")]
