"""Whole runs: score logs, explain and label errors, merge error types, choose seeds, build a tuning set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parselab.functions import fixed
from parselab.operators import augment, labels, merge, prompts, ranking, scoring, seeds, summaries, taxonomy
from parselab.session import cut_lineage
from parselab.sources import files


def score_logs(
    logs: DataFrame,
    responses: DataFrame,
    path: str,
    key: str = "row_id",
    sample_size: int | None = None,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Prompt, join the replies, score, write the outcomes and the run summary; returns the summary."""
    files.require(logs, fixed.LOG_COLUMNS)
    sampled = ranking.sample_rows(logs, key, sample_size, seed)
    replied = prompts.attach_responses(prompts.parse_prompts(sampled), responses)
    scored = scoring.score(replied)
    files.write_outcomes(scored, f"{path}/outcomes")
    written = logs.sparkSession.read.parquet(f"{path}/outcomes")
    summary = scoring.run_summary(written, "logs", path)
    files.write_run_summary(summary, f"{path}/summary")
    return summary


def explain_errors(
    diff: DataFrame, responses: DataFrame, path: str, mode: str = "observed", fmt: str = "parquet"
) -> DataFrame:
    """Append the error summaries of the wrong rows to the summary table; returns this run's."""
    files.require(diff, fixed.DIFF_COLUMNS)
    found = cut_lineage(summaries.summarise_errors(diff, responses, mode))
    files.append_table(found.select(*fixed.SUMMARY_COLUMNS), path, fmt)
    return found


def taxonomy_request(
    texts: DataFrame, key: str, model: str, sample_size: int | None = 500, seed: int = fixed.SEED
) -> tuple[DataFrame, DataFrame]:
    """The one prompt that asks for a taxonomy of the summaries, and the figures of its sample."""
    files.require(texts, ["error_summary"])
    cap = fixed.SUMMARY_CAP["reasoner" if "reasoner" in model.lower() else "chat"]
    corpus = summaries.summary_corpus(texts, key, sample_size=sample_size, cap=cap, seed=seed)
    figures = summaries.summary_overview(texts, sample_size=sample_size, cap=cap)
    return prompts.taxonomy_prompt(corpus), figures


def label_rows(
    diff: DataFrame, responses: DataFrame, types: DataFrame, path: str, fmt: str = "parquet"
) -> DataFrame:
    """Label the wrong rows and overwrite the label table; returns the labels."""
    files.require(diff, fixed.DIFF_COLUMNS)
    found = cut_lineage(labels.label_errors(diff, responses, types))
    files.overwrite_table(found.select(*fixed.LABEL_COLUMNS), path, fmt)
    return found


def merge_types(
    types: DataFrame,
    labelled: DataFrame,
    threshold: float = fixed.SIMILARITY_THRESHOLD,
    mode: str = "observed",
) -> dict[str, DataFrame]:
    """Pairs, plan, rewritten labels, effect and the types that remain.

    ``types`` has ``pos, title, description, examples, vector``. Without a similar pair the plan is
    empty and labels and types come back as they are.
    """
    pairs = cut_lineage(merge.similar_pairs(types, threshold))
    counts = merge.type_counts(labelled)
    plan = cut_lineage(merge.merge_plan(merge.pair_counts(pairs, types, counts)))
    resolved = merge.resolve_plan(plan, mode)
    return {
        "pairs": pairs,
        "plan": plan,
        "labels": merge.apply_merge(labelled, resolved),
        "effect": merge.merge_effect(counts, resolved),
        "types": taxonomy.surviving_types(types, plan),
    }


def select_seeds(
    labelled: DataFrame,
    texts: DataFrame,
    n: int,
    key: str = "row_id",
    order: str = "row_id",
    mode: str = "observed",
    **options,
) -> DataFrame:
    """Round robin over the strata, then the summary of each seed."""
    files.require(labelled, fixed.LABEL_COLUMNS)
    files.require(texts, fixed.SUMMARY_COLUMNS)
    # The chosen rows are few: written once, they are not drawn again for each join.
    chosen = cut_lineage(seeds.round_robin(labelled, n, key, **options))
    return seeds.attach_summaries(chosen, texts, order, mode)


def tuning_set(
    chosen: DataFrame,
    responder: Callable[[DataFrame, int], DataFrame],
    document: DataFrame,
    n: int = fixed.VARIANTS_PER_SEED,
    mode: str = "observed",
) -> DataFrame:
    """Seeds and their variants as tuning rows. ``chosen`` has ``seed_id`` and the seed columns."""
    files.require(chosen, fixed.SEED_COLUMNS)
    usable = chosen.filter(F.col("Original_Log").isNotNull() & F.col("Correct_Template").isNotNull())
    variants = augment.generate_variants(augment.assign_strategy(usable), responder, document, n)
    return augment.tuning_union(chosen, variants, mode)
