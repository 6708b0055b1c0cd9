"""Similar pairs by bounds and by hashing, against all products."""

import numpy as np
import pytest

from parselab.operators import vectors
from workload import catalog


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "pos long, vector array<double>")


def all_pairs(rows, threshold):
    unit = vectors.unit(np.asarray(rows, float))
    sim = unit @ unit.T
    return {(i, j) for i, j in zip(*np.nonzero(np.triu(sim > threshold, 1)), strict=True)}


def planted(n, copies, similarity, seed=0, dims=64):
    """Evenly spread vectors, and for some of them a copy at just the given cosine."""
    rng = np.random.default_rng(seed)
    base = vectors.unit(rng.normal(size=(n, dims)))
    other = rng.normal(size=(copies, dims))
    other -= (other * base[:copies]).sum(axis=1, keepdims=True) * base[:copies]
    near = similarity * base[:copies] + np.sqrt(1 - similarity**2) * vectors.unit(other)
    return np.concatenate([base, near])


@pytest.mark.parametrize("threshold", [-0.2, 0.0, 0.4, 0.9])
@pytest.mark.parametrize("block_rows", [9, 40, 2048])
def test_bounded_pairs_are_exact(spark, threshold, block_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 12)) * np.geomspace(8, 0.1, 12)
    rows = np.concatenate([c + rng.normal(scale=0.3, size=(25, 12)) for c in centres] + [np.zeros((3, 12)), np.repeat(centres[:1], 20, axis=0)])
    found = vectors.bounded_pairs(table(spark, rows), threshold, block_rows=block_rows).collect()
    assert len(found) == len({(r["i"], r["j"]) for r in found})
    assert {(r["i"], r["j"]) for r in found} == all_pairs(rows, threshold)


def test_products_are_left_undone_at_a_high_threshold(spark):
    """Evenly spread vectors in 64 dimensions, where no pair of blocks can be ruled out."""
    rows = planted(1500, 60, 0.95)
    df = table(spark, rows)
    found = vectors.bounded_pairs(df, 0.9, block_rows=256).collect()
    assert {(r["i"], r["j"]) for r in found} == all_pairs(rows, 0.9)
    begun, done = vectors.pair_work(df, 0.9, block_rows=256).groupBy().sum("products", "completed").first()
    assert done < 0.03 * begun


def test_blocks_are_ruled_out_where_spread_is_uneven(spark):
    rng = np.random.default_rng(5)
    rows = np.concatenate([c + rng.normal(scale=0.2, size=(40, 16)) for c in rng.normal(size=(40, 16)) * np.geomspace(5, 0.2, 16)])
    df = table(spark, rows)
    assert {(r["i"], r["j"]) for r in vectors.bounded_pairs(df, 0.98, block_rows=50).collect()} == all_pairs(rows, 0.98)
    work = vectors.pair_work(df, 0.98, block_rows=50).collect()
    blocks = len({r["low"] for r in work} | {r["high"] for r in work})
    assert len(work) < 0.6 * blocks * (blocks + 1) / 2


@pytest.mark.parametrize("similarity", [0.85, 0.90, 0.95])
def test_hashing_finds_planted_copies(spark, similarity):
    rows = planted(4000, 400, similarity + 1e-9)
    threshold = similarity - 1e-9
    df = table(spark, rows)
    expected = all_pairs(rows, threshold)
    found = vectors.hashed_pairs(df, threshold).collect()
    assert len(found) == len({(r["i"], r["j"]) for r in found})
    assert {(r["i"], r["j"]) for r in found} <= expected
    assert len(found) >= 0.9 * len(expected)
    candidates = vectors.hashed_candidates(vectors.unit_vectors(df, "pos", "vector"), threshold).count()
    assert candidates < 0.05 * len(rows) * (len(rows) - 1) / 2


def test_hot_buckets_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MEMBERS", 10)
    rows = np.concatenate([np.repeat(planted(1, 0, 1.0), 70, axis=0), planted(60, 5, 0.97, seed=2)])
    found = vectors.hashed_pairs(table(spark, rows), 0.9, recall=0.999).collect()
    assert len(found) == len({(r["i"], r["j"]) for r in found})
    assert {(r["i"], r["j"]) for r in found} == all_pairs(rows, 0.9)


def test_only_pairs_by_the_threshold_are_compared(spark):
    """Pairs at 0.82 share buckets like those at 0.9; their coarse products rule them out before any vector is sent."""
    rows = planted(600, 300, 0.82, seed=6)
    table_of = vectors.unit_vectors(table(spark, rows), "pos", "vector")
    assert vectors.hashed_candidates(table_of, 0.9, recall=1 - 1e-6, bits=8).count() == 0
    assert vectors.hashed_candidates(table_of, 0.81, recall=1 - 1e-6, bits=8).count() >= 300


@pytest.mark.parametrize("bits", [8, 13])
def test_a_vector_is_sent_once_for_all_its_pairs(spark, monkeypatch, bits):
    """Of 19 900 pairs of 200 near copies; also where buckets are cut into blocks and these into tiles of several sizes."""
    monkeypatch.setattr(vectors, "MEMBERS", 45)
    monkeypatch.setattr(vectors, "TILE", (16, 24))
    g = np.random.default_rng(8)
    rows = np.concatenate([g.normal(size=12) + g.normal(scale=0.02, size=(200, 12)), g.normal(size=(60, 12))])
    df = table(spark, rows)
    found = vectors.hashed_pairs(df, 0.97, recall=1 - 1e-6, bits=bits).collect()
    assert len(found) == len({(r["i"], r["j"]) for r in found})
    assert {(r["i"], r["j"]) for r in found} == all_pairs(rows, 0.97)
    portions = vectors._portions(vectors.unit_vectors(df, "pos", "vector"), 0.97, 1 - 1e-6, bits, 42)
    assert portions.selectExpr("sum(size(at))").first()[0] >= len(found) == 19900
    assert portions.selectExpr("sum(size(members))").first()[0] <= 8 * 260


def test_vectors_of_two_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0])], "pos long, vector array<double>").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        vectors.unit_vectors(df, "pos", "vector")


def test_empty_tables(spark):
    none = table(spark, [[1.0, 0.0]]).limit(0)
    assert vectors.bounded_pairs(none, 0.5).collect() == [] and vectors.hashed_pairs(none, 0.5).collect() == []


def test_a_vector_is_sent_to_few_tasks(spark):
    """However many blocks there are: at a threshold that rules no pair of blocks out, each row stood in 64 pairs of them."""
    df = table(spark, planted(512, 0, 1.0))
    rows = vectors.unit_vectors(df, "pos", "vector")
    spread, _, _ = vectors._spread(rows, -0.9, vectors.directions(rows)[0], 8, 512)
    assert spread.count() <= vectors.SIDES * 512


def test_sides_are_bounded_in_bytes():
    n, dims = 10**8, 64
    per = vectors.side_blocks(n // 2048, n, dims)
    assert per * 2048 * dims * 8 <= vectors.SIDE_BYTES


def test_a_low_threshold_is_not_left_to_hashing(spark):
    """Bands enough for 0.4 would compare each pair twice; no pair is lost there."""
    rows = planted(400, 60, 0.45, seed=4)
    found = vectors.hashed_pairs(table(spark, rows), 0.4, recall=1 - 1e-6, bits=8).collect()
    assert {(r["i"], r["j"]) for r in found} == all_pairs(rows, 0.4) and len(found) == len(all_pairs(rows, 0.4))


def test_cosine_pairs_has_no_floor(spark, tmp_path, rows):
    """Opposite vectors and a zero vector are pairs like any other; equal ids, and rows without a vector, are in none."""
    given = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [3.0, 4.0]), (4, [4.0, 3.0]), (5, None), (None, [1.0, 0.0])]
    spark.createDataFrame(given, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = rows(catalog.cosine_pairs(spark, str(tmp_path)), "i", "j", "sim")
    assert found == sorted([
        (0, 1, -1.0), (0, 2, 0.0), (0, 3, 0.0), (0, 4, 0.6), (0, 4, 0.8), (1, 2, 0.0), (1, 3, 0.0), (1, 4, -0.6), (1, 4, -0.8),
        (2, 3, 0.0), (2, 4, 0.6), (2, 4, 0.8), (3, 4, 0.0), (3, 4, 0.0),
    ], key=repr)


def test_rows_without_place_or_vector(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (None, [1.0, 0.0]), (3, None)], "pos long, vector array<double>"
    )
    assert [(r["i"], r["j"]) for r in vectors.bounded_pairs(df, 0.9).collect()] == [(1, 2)]
