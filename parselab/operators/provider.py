"""Model replies that outlive a run: a bucketed reply store, and a provider that asks only what the store lacks."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parselab.operators import prompts
from parselab.session import written

BUCKETS = 64
PORTION_ROWS = 100_000


class ReplyStore:
    """Replies by ``request_id`` below ``path``, in a folder that all executors and later runs reach.

    The table is bucketed by ``request_id``: joins and groups on it move the other side only, in every run. Failed requests
    are kept with their error; of several rows of a request one with a reply counts. The number of buckets is part of
    the folder's name, so a store is never read with another one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark = spark
        self.buckets = buckets
        self.folder = f"{path.rstrip('/')}/buckets-{buckets}"
        self.name = f"replies_{md5(self.folder.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (request_id STRING, response STRING, error STRING) USING parquet"
            f" CLUSTERED BY (request_id) SORTED BY (request_id) INTO {buckets} BUCKETS LOCATION '{self.folder}'"
        )
        spark.catalog.refreshTable(self.name)

    def rows(self) -> DataFrame:
        """All stored rows: request_id, response, error."""
        return self.spark.table(self.name)

    def append(self, replies: DataFrame) -> None:
        replies.select("request_id", "response", "error").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def replies(self) -> DataFrame:
        """request_id, response, error: one row per request, a reply (the least text) before an error. Nothing is shuffled."""
        best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "response", "error")).alias("best")
        return self.rows().groupBy("request_id").agg(best).select("request_id", "best.response", "best.error")

    def missing(self, requests: DataFrame, retry_failed: bool = True) -> DataFrame:
        """The distinct requests without a stored row; with ``retry_failed`` those with errors only as well."""
        stored = self.rows().filter("error IS NULL") if retry_failed else self.rows()
        return prompts.distinct_requests(requests).join(stored.select("request_id"), "request_id", "left_anti")


def answer(
    requests: DataFrame,
    store: ReplyStore,
    make_client: Callable[[], Callable[..., str]],
    retry_failed: bool = True,
    portion_rows: int = PORTION_ROWS,
    **calling,
) -> DataFrame:
    """Ask what the store lacks, and give the stored row of each request: request_id, response, error.

    What is missing is written first, sorted by request; then it is asked in portions of about ``portion_rows``, ranges of the
    hash, and each portion is appended to the store as soon as it is through. So a run that was stopped and is started again asks
    at most one portion twice, and a lost executor costs the calls of its running tasks. After the calls nothing is
    shuffled, so no finished call is lost with shuffle files. ``calling``: ``attempts``, ``in_flight``, ``wait``,
    ``longest_wait`` of ``prompts.call_model``.
    """
    keyed = requests if "request_id" in requests.columns else prompts.with_request_id(requests)
    missing = store.missing(keyed, retry_failed).repartition(store.buckets, "request_id").sortWithinPartitions("request_id")
    missing = written(missing, "requests")
    for low, high in _ranges(-(-missing.count() // portion_rows)):
        portion = missing.filter(F.col("request_id") >= low)
        portion = portion.filter(F.col("request_id") < high) if high else portion
        store.append(prompts.call_model(portion, make_client, **calling))
    return store.replies().join(keyed.select("request_id").distinct(), "request_id", "left_semi")


def responder(store: ReplyStore, make_client: Callable[[], Callable[..., str]], **options) -> Callable[[DataFrame, int], DataFrame]:
    """What ``augment.generate_variants`` asks in each round: ``answer`` over the store; failed requests have no row."""

    def respond(requests: DataFrame, round_no: int) -> DataFrame:
        return answer(requests, store, make_client, **options).filter("error IS NULL").select("request_id", "response")

    return respond


def _ranges(count: int, digits: int = 8) -> list[tuple[str, str | None]]:
    """``count`` even ranges of a hexadecimal hash, low ends included; the last one has no high end."""
    ends = [format(16**digits * i // count, f"0{digits}x") for i in range(count)]
    return list(zip(ends, [*ends[1:], None], strict=False))
