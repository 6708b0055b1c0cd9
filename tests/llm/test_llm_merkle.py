"""The manifest against a plain tree over all leaves."""

import zlib
from hashlib import sha256

import pytest

from parselab.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, place int, hash string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def part(value):
    if value is None:
        return "-"
    return f"{len(str(value).encode())}:{value}"


def leaf(doc_id, text, lang, source, n_chars):
    return H(*map(part, (doc_id, source, lang, n_chars, text)))


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def siblings(levels, at):
    found = []
    for level in levels[:-1]:
        run = at - at % 3
        found.append((level[run:at], level[at + 1 : run + 3]))
        at //= 3
    return found


def plain(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = {}, {}
    for source in sources:
        own = [r for r in rows if r[3] == source]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r[:5])))
        members[source] = own
        trees[source] = up([leaf(*r[:5]) for r in own])
    top = up([trees[s][-1][0] for s in sources])
    root = top[-1][0] if rows else None
    out = []
    for k, source in enumerate(sources):
        for at, r in enumerate(members[source]):
            path = siblings(trees[source], at) + siblings(top, k)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            text = r[1].replace("\n", "") if even and r[1] is not None else r[1]
            node = leaf(r[0], text, *r[2:5])
            for before, after in path:
                node = H(*before, node, *after)
            proof = H(*(h for before, after in path for h in before + after))
            out.append((r[0], leaf(*r[:5]), trees[source][-1][0], root, proof, node, node == root))
    return sorted(out, key=repr)


def made(n, sources):
    odd = ["a\nb", "", None, "\n", "é\n\n" * 50, "plain", "x" * 3000 + "\n"]
    return [
        (i, odd[i % len(odd)], None if i % 5 == 0 else "en", sources[i * i % len(sources)], i if i % 3 else None, i, "clash")
        for i in range(n)
    ]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in merkle.manifest(df, **options).collect()), key=repr)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_equals_one_plain_tree(spark, height):
    rows = made(61, ["hot"] * 7 + ["b", None, "é", "Z", ""])
    assert found(spark, rows, height=height) == plain(rows)


def test_many_sources_and_repeated_rows(spark):
    rows = made(40, [f"s{i}" for i in range(11)])
    rows += rows[:5] + [(None, "t\n", "en", "s1", 1, 0, ""), (None, None, None, None, None, 0, "")]
    assert found(spark, rows, height=1) == plain(rows)


def test_single_leaf_and_empty_table(spark):
    rows = made(1, ["only"])
    ((doc_id, leaf_, subroot, root, proof, folded, verified),) = found(spark, rows)
    assert leaf_ == subroot == root and proof == H("") and (folded == root) == verified
    assert found(spark, []) == []


def test_versions_share_untouched_nodes():
    tree = merkle.Tree.over([f"{i}" for i in range(20)], 3)
    version = tree.version(4, "new")
    nodes = [f"{i}" if i != 4 else "new" for i in range(20)]
    assert version.root == merkle.Tree.over(nodes, 3).root
    assert len(version.copied) == 4
    assert version.node(0, 5) is tree.levels[0][5] and version.node(1, 1) != tree.levels[1][1]
