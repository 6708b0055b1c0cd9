"""Prompt tables and the join that brings stored replies back.

A model call is a table of requests, keyed by a hash of system text and prompt, and a table of responses.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parselab.functions import fixed
from parselab.functions.text import fill

SEPARATOR = "\x1f"  # between system text and prompt in what is hashed


def _missing(column: str) -> Column:
    return F.col(f"`{column}`")


def parse_prompts(logs: DataFrame, log: str = "Content") -> DataFrame:
    return logs.withColumn("prompt", fill(fixed.PARSE_PROMPT, log=F.col(log)))


def error_prompts(diff: DataFrame) -> DataFrame:
    """System and user text that ask what went wrong in the reasoning."""
    return diff.withColumns(
        {
            "system_prompt": F.lit(fixed.ERROR_SYSTEM),
            "prompt": fill(
                fixed.ERROR_USER,
                log=_missing("Content"),
                reasoning=_missing("Think-Process"),
                template=_missing("EventTemplate"),
            ),
        }
    )


def classify_prompts(diff: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Ask for one type of the taxonomy. The option list is one value, read as a scalar subquery."""
    from parselab.operators.taxonomy import option_text

    options = option_text(taxonomy)
    return diff.withColumns(
        {
            "system_prompt": F.lit(fixed.CLASSIFY_SYSTEM),
            "prompt": fill(
                fixed.CLASSIFY_USER,
                options=options.select("options").scalar(),
                count=options.select("types").scalar(),
                log=_missing("Content"),
                reasoning=_missing("Think-Process"),
                template=_missing("EventTemplate"),
            ),
        }
    )


def taxonomy_prompt(corpus: DataFrame) -> DataFrame:
    """Ask for a taxonomy of the summaries in a one-row ``corpus``."""
    return corpus.select(
        F.lit(fixed.TAXONOMY_SYSTEM).alias("system_prompt"),
        fill(fixed.TAXONOMY_USER, summaries=F.col("corpus")).alias("prompt"),
    )


def attach_document(df: DataFrame, document: DataFrame) -> DataFrame:
    """Add the text of a one-row taxonomy document to every row, as a scalar subquery."""
    return df.withColumn("document", document.select("document").scalar())


def _seed_fields() -> dict[str, Column]:
    return {
        "log": F.col("Original_Log"),
        "template": F.col("Correct_Template"),
        "summary": F.col("error_summary"),
        "type": F.col("Error_Type"),
    }


def _by_strategy(one: Column, two: Column, three: Column) -> Column:
    return F.when(F.col("strategy") == 1, one).when(F.col("strategy") == 2, two).otherwise(three)


def augment_prompts(
    seeds: DataFrame, document: DataFrame, count: int = fixed.VARIANTS_PER_SEED, types: int = 6
) -> DataFrame:
    """Prompt per seed by its strategy; the third one carries the whole taxonomy document."""
    fields = {**_seed_fields(), "count": F.lit(count)}
    semantic = fill(
        fixed.AUGMENT_SEMANTIC,
        document=document.select("document").scalar(),
        types=F.lit(types),
        number=F.col("Error_Number"),
        **fields,
    )
    return seeds.withColumns(
        {
            "system_prompt": F.lit(fixed.AUGMENT_SYSTEM),
            "prompt": _by_strategy(
                fill(fixed.AUGMENT_SUBSTITUTE, **fields),
                fill(fixed.AUGMENT_REWRITE, **fields),
                semantic,
            ),
        }
    )


def topup_prompts(
    seeds: DataFrame,
    variants: DataFrame,
    document: DataFrame,
    n: int = fixed.VARIANTS_PER_SEED,
) -> DataFrame:
    """Ask for the shortfall of each seed that has fewer than ``n`` variants, naming those it has.

    A seed's variants are cut at ``n`` before they are gathered, in the same shuffle.
    """
    place = F.row_number().over(W.partitionBy("seed_id").orderBy("round", "pos", "input"))
    few = variants.select("seed_id", "round", "pos", "input").withColumn("place", place).filter(F.col("place") <= n)
    made = few.groupBy("seed_id").agg(F.array_sort(F.collect_list(F.struct("round", "pos", "input"))).alias("made"))
    listed = made.select(
        "seed_id",
        F.size("made").alias("have"),
        F.array_join(F.transform("made", lambda v: F.concat(F.lit("- "), v["input"])), "\n").alias("existing"),
    )
    asked = seeds.join(listed, "seed_id", "left").filter(F.coalesce("have", F.lit(0)) < n)
    fields = {
        **_seed_fields(),
        "count": F.lit(n) - F.coalesce("have", F.lit(0)),
        "existing": F.coalesce("existing", F.lit("")),
    }
    semantic = fill(
        fixed.TOPUP_SEMANTIC,
        document=document.select("document").scalar(),
        number=F.col("Error_Number"),
        **fields,
    )
    return asked.withColumns(
        {
            "system_prompt": F.lit(fixed.TOPUP_SYSTEM),
            "prompt": _by_strategy(
                fill(fixed.TOPUP_SUBSTITUTE, **fields), fill(fixed.TOPUP_REWRITE, **fields), semantic
            ),
        }
    ).drop("have", "existing")


def with_request_id(prompts: DataFrame) -> DataFrame:
    """``request_id``: a hash of all that the model reads, the system text (where there is one) and the prompt."""
    whole = F.col("prompt")
    if "system_prompt" in prompts.columns:
        whole = F.concat(F.coalesce("system_prompt", F.lit("")), F.lit(SEPARATOR), "prompt")
    return prompts.withColumn("request_id", F.md5(whole))


def distinct_requests(prompts: DataFrame) -> DataFrame:
    """Each request once: equal prompts under the same system text are asked once and share the reply."""
    keyed = prompts if "request_id" in prompts.columns else with_request_id(prompts)
    named = [c for c in ("request_id", "system_prompt", "prompt") if c in keyed.columns]
    return keyed.select(*named).dropDuplicates(["request_id"])


def attach_responses(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Rows with their reply: ``answered`` tells a missing reply from an empty one.

    Only the hash goes through the join; prompts stay behind. A request has one reply, shared by all rows that ask it:
    of several stored ones the least text counts, and a text before none.
    """
    keyed = prompts if "request_id" in prompts.columns else with_request_id(prompts)
    narrow = keyed.drop("prompt", "system_prompt")
    replies = responses.groupBy("request_id").agg(F.min("response").alias("response"), F.lit(True).alias("answered"))
    return narrow.join(replies, "request_id", "left").withColumns(
        {
            "answered": F.coalesce("answered", F.lit(False)),
            "response": F.col("response"),
        }
    )


def call_model(
    requests: DataFrame,
    make_client: Callable[[], Callable[..., str]],
    attempts: int = 5,
    in_flight: int = 1,
    wait: float = 0.0,
    longest_wait: float = 60.0,
) -> DataFrame:
    """Run a user-supplied text function over the prompts, in Arrow batches.

    ``make_client`` runs once per partition. A client is called with the system text and the prompt where the table has
    ``system_prompt``, else with the prompt; a task keeps up to ``in_flight`` calls going, from as many threads. Before the next
    attempt it waits ``wait`` seconds, then twice as long each time, shortened at random by up to half so that tasks do not
    call in step. A prompt that still fails after ``attempts`` gives a NULL response and its error text; the job goes
    on. Write the result out before using it twice, so that no prompt is asked again; ``provider`` keeps replies over runs.
    """
    schema = T.StructType(
        [f for f in requests.schema.fields if f.name not in ("response", "error")]
        + [T.StructField("response", T.StringType()), T.StructField("error", T.StringType())]
    )
    texts = [c for c in ("system_prompt", "prompt") if c in requests.columns]

    def ask(client: Callable[..., str], request: tuple) -> tuple[str | None, str | None]:
        error = None
        for attempt in range(attempts):
            if attempt and wait:
                time.sleep(min(longest_wait, wait * 2 ** (attempt - 1)) * random.uniform(0.5, 1))
            try:
                return client(*request), None
            except Exception as failure:  # any client error becomes a column
                error = str(failure)
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                asked = batch[texts].itertuples(index=False, name=None)
                answers = list(pool.map(lambda request: ask(client, request), asked))
                yield batch.assign(response=[a for a, _ in answers], error=[e for _, e in answers])

    return requests.mapInPandas(run, schema)
