"""Results do not depend on how the rows lie in partitions."""

import pytest

from workload import catalog, derived

SMALL = "/root/testdata/sf0.001"
CHECKED = [
    "parsing_accuracy", "grouping_accuracy", "running_accuracy", "stratified_shuffle", "round_robin_seeds",
    "capped_sample", "volume_cap", "sample_rows", "seed_summary_join", "merge_target", "substitute_variables",
    "distinct_variants", "summary_corpus", "taxonomy_blocks",
]


@pytest.mark.parametrize("name", CHECKED)
def test_layout(name, spark, rows, monkeypatch):
    plain = rows(catalog.QUERIES[name](spark, SMALL))
    read = derived.table
    monkeypatch.setattr(derived, "table", lambda s, d, n: read(s, d, n).repartition(13))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows(catalog.QUERIES[name](spark, SMALL)) == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
