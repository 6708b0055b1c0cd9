"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parselab.functions import fixed, replies, templates, text
from parselab.operators import augment, labels, merge, passages, prompts, provider, ranking, scoring, seeds, summaries, taxonomy, vectors
from parselab.session import cut_lineage, new_path
from parselab.sources import files
from parselab.streaming import live
from workload import derived as data

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PAIR_FLOOR = 0.30
SWEEP = (0.30, 0.35, 0.40, 0.45)


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _int(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


# Sources and sinks: written below the shared folder, read back whole.


def _written_logs(spark: SparkSession, d: str) -> str:
    """Logs as CSV with line ends and quotes inside the cells."""
    path = new_path(spark, "logs")
    two_lines = F.concat("Content", F.lit('\nsecond "quoted" line, '), "event_type")
    rows = data.logs(spark, d).select(
        two_lines.alias("Content"),
        F.when(F.expr("row_id % 19 <> 0"), F.col("EventTemplate")).otherwise("NA").alias("EventTemplate"),
    )
    files.overwrite_csv(rows, path)
    return path


@query
def scan_logs(spark, d):
    return files.read_logs(spark, _written_logs(spark, d), na=True)


@query
def required_columns(spark, d):
    return files.required_columns(
        data.summaries(spark, d), [*fixed.SUMMARY_COLUMNS, "Error_Type", "Error_Number"]
    )


@query
def taxonomy_scan(spark, d):
    found = taxonomy.read_taxonomy(data.markdown(spark, d), by=["doc_id"])
    return _int(found, "number").select("doc_id", "number", "title")


def _blocks(spark, d, mode="observed"):
    return taxonomy.read_taxonomy_blocks(data.markdown(spark, d), by=["doc_id"], mode=mode)


@query
def taxonomy_blocks(spark, d):
    return _blocks(spark, d).select(
        "doc_id", "letter", "title", "description", F.array_join("examples", "|").alias("examples")
    )


@query
def taxonomy_blocks_intended(spark, d):
    """As the reader is meant: a block's text may hold single number signs."""
    return _blocks(spark, d, "intended").select(
        "doc_id", "letter", "title", "description", F.array_join("examples", "|").alias("examples")
    )


@query
def sink_partitioned(spark, d):
    path = new_path(spark, "outcomes")
    files.write_outcomes(data.scored(spark, d), path)
    return spark.read.parquet(path).withColumnRenamed("Think-Process", "reasoning")


@query
def sink_append(spark, d):
    path = new_path(spark, "summaries")
    rows = data.summaries(spark, d)
    for copy in (0, 1):
        files.append_csv(rows.filter(F.col("seq") % 2 == copy).select(*fixed.SUMMARY_COLUMNS), path)
    return files.read_csv(spark, path, fixed.SUMMARY_COLUMNS, na=True)


@query
def sink_overwrite(spark, d):
    path = new_path(spark, "labels")
    rows = data.labels(spark, d).select(*fixed.LABEL_COLUMNS)
    for _ in range(2):
        files.overwrite_csv(rows, path)
    schema = files.text_schema(fixed.LABEL_COLUMNS[:3]).add("Error_Number", T.IntegerType())
    return files.read_csv(spark, path, schema)


def _merged_types(spark, d):
    types = _blocks(spark, d)
    return taxonomy.surviving_types(types, data.document_merges(types), ["doc_id"])


@query
def taxonomy_doc_out(spark, d):
    path = new_path(spark, "documents")
    named = taxonomy.reletter(data.taxonomy(spark, d))
    files.write_blocks(taxonomy.taxonomy_blocks(named, threshold=0.85), path)
    return _document_lines(spark, path)


def _document_lines(spark, path):
    """All lines of a written document with their place; its files are in order by name, and end with a line end."""
    text = F.expr("substr(value, 1, length(value) - 1)")
    lines = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line")
    )
    place = F.row_number().over(W.orderBy("file", "at"))  # over one document
    return lines.select(place.cast("bigint").alias("place"), "line")


@query
def analysis_document(spark, d):
    """The first document of a run, over a stored reply."""
    overview = summaries.summary_overview(data.summaries(spark, d))
    reply = _document(spark, d).withColumnRenamed("document", "response")
    return taxonomy.analysis_document(reply, overview, "summaries", "model")


@query
def sink_tuning_json(spark, d):
    path = new_path(spark, "tuning")
    files.write_tuning(
        augment.tuning_rows(data.seeds(spark, d), "Original_Log", "Correct_Template"), path
    )
    return spark.read.schema(files.text_schema(fixed.TUNING_COLUMNS)).json(path)


@query
def run_summary(spark, d):
    path = new_path(spark, "run")
    files.write_run_summary(scoring.run_summary(data.scored(spark, d), "logs", "out"), path)
    back = spark.read.schema(
        "status string, processed long, correct long, accuracy double, input_file string, output_dir string"
    ).json(path)
    return back.withColumn("accuracy", F.round("accuracy", 6))


# Projections and filters.


@query
def drop_null_rows(spark, d):
    kept = summaries.drop_null_rows(data.summaries(spark, d), ["original_log", "error_summary"])
    return kept.select("seq", "error_summary")


@query
def drop_empty_rows(spark, d):
    return summaries.drop_empty_rows(data.seeds(spark, d), ["Original_Log", "error_summary"]).select(
        "seed_id", "error_summary"
    )


@query
def clean_summaries(spark, d):
    return summaries.clean_summaries(data.summaries(spark, d)).select("seq", "error_summary")


@query
def outcome_split(spark, d):
    return data.scored(spark, d).select("row_id", "Prediction", "outcome")


@query
def prompt_template(spark, d):
    return prompts.parse_prompts(data.logs(spark, d)).select("row_id", "prompt")


@query
def prompt_error(spark, d):
    return prompts.error_prompts(data.diff(spark, d)).select("row_id", "system_prompt", "prompt")


@query
def prompt_classify(spark, d):
    asked = prompts.classify_prompts(data.diff(spark, d), data.taxonomy(spark, d))
    return asked.select("row_id", "prompt")


def _document(spark, d):
    named = taxonomy.reletter(data.taxonomy(spark, d))
    return taxonomy.document_text(taxonomy.taxonomy_blocks(named))


@query
def prompt_augment(spark, d):
    asked = prompts.augment_prompts(data.seeds(spark, d), _document(spark, d), 7, types=10)
    return asked.select("seed_id", "strategy", "prompt")


@query
def prompt_topup(spark, d):
    made = cut_lineage(data.first_variants(spark, d))
    asked = prompts.topup_prompts(data.seeds(spark, d), made, _document(spark, d), 3)
    return asked.select("seed_id", "strategy", "prompt")


@query
def tuning_rows(spark, d):
    missing = data.seeds(spark, d).withColumn(
        "Correct_Template", F.when(F.expr("seed_id % 23 <> 0"), F.col("Correct_Template"))
    )
    observed = augment.tuning_rows(missing, "Original_Log", "Correct_Template")
    intended = augment.tuning_rows(missing, "Original_Log", "Correct_Template", "intended")
    columns = ["seed_id", *fixed.TUNING_COLUMNS]
    return observed.select(F.lit("observed").alias("mode"), *columns).unionByName(
        intended.select(F.lit("intended").alias("mode"), *columns)
    )


@query
def tuning_rename(spark, d):
    rows = augment.tuning_rows(data.seeds(spark, d), "Original_Log", "Correct_Template")
    return augment.tuning_rename(rows.select("seed_id", *fixed.TUNING_COLUMNS))


@query
def column_order(spark, d):
    return seeds.seed_columns(data.seeds(spark, d))


@query
def not_identical(spark, d):
    made = data.first_variants(spark, d).join(
        data.logs(spark, d).select(F.col("row_id").alias("seed_id"), "Content"), "seed_id"
    )
    return augment.not_identical(made, "input", "Content").select("seed_id", "pos", "input")


@query
def line_candidates(spark, d):
    return augment.line_candidates(data.spread_table(spark, d, "documents"), "text", ["doc_id"])


# Text extraction.


@query
def strip_markers(spark, d):
    nested = F.concat(F.lit("<s<unk>>"), "response", F.lit("<|user|><</s>s>"))
    return data.answered_logs(spark, d).select("row_id", text.strip_markers(nested).alias("output"))


@query
def inject_marker(spark, d):
    return data.answered_logs(spark, d).select(
        "row_id", text.inject_marker(F.col("response")).alias("output")
    )


@query
def extract_template(spark, d):
    """Over raw output, where the wildcard line tier is live."""
    found = data.answered_logs(spark, d).filter("response IS NOT NULL").withColumn(
        "found", text.extract_template(F.col("response"))
    )
    return found.select("row_id", "found.template", "found.tier")


@query
def extract_tiers(spark, d):
    return scoring.tier_report(data.scored(spark, d))


@query
def clean_reasoning(spark, d):
    return data.summary_replies(spark, d).select(
        "row_id", text.clean_reasoning(F.col("response")).alias("cleaned")
    )


@query
def summary_by_marker(spark, d):
    return data.summary_replies(spark, d).select(
        "row_id", text.summary_by_marker(F.col("response")).alias("error_summary")
    )


@query
def summary_fallback(spark, d):
    """Last paragraph of every document."""
    return data.spread_table(spark, d, "documents").select(
        "doc_id", text.last_paragraph(F.col("text")).alias("paragraph")
    )


@query
def summary_final(spark, d):
    rows = data.written_diff(spark, d)
    replied = summaries.error_replies(rows, data.summary_responses(rows))
    return summaries.both_summaries(replied).select("row_id", "observed", "intended")


@query
def json_slice(spark, d):
    return data.label_replies(spark, d).select(
        "row_id", replies.json_object_slice(text.strip(F.col("reply"))).alias("slice")
    )


def _labelled(spark, d):
    rows, types = data.written_diff(spark, d), data.taxonomy(spark, d)
    stored = data.label_responses(prompts.with_request_id(prompts.classify_prompts(rows, types)))
    return labels.label_errors(rows, stored, types)


@query
def label_validate(spark, d):
    return _labelled(spark, d).select("row_id", *fixed.LABEL_COLUMNS)


def _variants_of(spark, d, strategy, **options):
    asked = data.variant_replies(data.seeds(spark, d).filter(F.col("strategy") == strategy))
    return augment.parse_variants(asked, **options)


@query
def variants_substitution(spark, d):
    return _variants_of(spark, d, 1)


@query
def variants_rewrite(spark, d):
    return _variants_of(spark, d, 2)


@query
def variants_semantic(spark, d):
    return _variants_of(spark, d, 3, keep_error_type=True)


@query
def letter_number(spark, d):
    """Letters and numbers of all documents' types."""
    found = _blocks(spark, d).select("doc_id", "letter")
    number = templates.letter_number(F.col("letter"))
    return found.select("doc_id", "letter", number.alias("number"), templates.number_letter(number).alias("again"))


@query
def template_match(spark, d):
    checked = data.scored(spark, d).filter("Prediction <> ''")
    return checked.select(
        "row_id",
        templates.matches(F.col("Content"), F.col("EventTemplate")).alias("gold_matches"),
        templates.matches(F.col("Content"), F.col("Prediction")).alias("prediction_matches"),
    )


# Joins.


@query
def label_lookup(spark, d):
    found = labels.label_lookup(
        data.labels(spark, d), data.taxonomy(spark, d).select("number", "title"), "Error_Number"
    )
    return found.select("row_id", "Error_Number", "title")


def _seeds(spark, d, n=3000):
    return seeds.round_robin(data.labels(spark, d), n, "row_id")


@query
def seed_summary_join(spark, d):
    """All labelled rows with their last summary, in both readings of a missing one."""
    chosen, texts = data.labels(spark, d), data.summaries(spark, d)
    observed, intended = [
        seeds.attach_summaries(chosen, texts, "seq", mode).select("row_id", F.col("error_summary").alias(mode))
        for mode in ("observed", "intended")
    ]
    return observed.join(intended, "row_id")


def _pairs(spark, d, threshold, **options):
    return merge.similar_pairs(data.vector_types(spark, d), threshold, **options)


def _rounded(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("sim", F.round("sim", 6))


@query
def similar_pairs(spark, d):
    return _rounded(_pairs(spark, d, 0.35))


def _plan(spark, d):
    return merge.similar_plan(data.vector_types(spark, d), merge.type_counts(data.vector_labels(spark, d)), PAIR_FLOOR)


@query
def pair_counts(spark, d):
    counts = merge.type_counts(data.vector_labels(spark, d))
    return _rounded(merge.counted_pairs(data.vector_types(spark, d), counts, PAIR_FLOOR))


@query
def remap_labels(spark, d):
    resolved = merge.resolve_plan(_plan(spark, d))
    return merge.apply_merge(data.vector_labels(spark, d), resolved).select(
        "row_id", "Error_Number", "Error_Type"
    )


@query
def surviving_types(spark, d):
    return _merged_types(spark, d).select("doc_id", "letter", "title")


@query
def response_join(spark, d):
    """Replies from a bucketed store: only the keys of the requests are shuffled."""
    rows = data.written_diff(spark, d)
    store = provider.ReplyStore(spark, new_path(spark, "store"), buckets=8)
    store.append(data.summary_responses(rows).withColumn("error", F.lit(None).cast("string")))
    joined = prompts.attach_responses(prompts.error_prompts(rows), store.replies())
    return joined.select("row_id", "request_id", "answered", F.coalesce("response", F.lit("")).alias("response"))


@query
def decontaminate(spark, d):
    """Logs of which none, up to case and spacing, is among the wrong rows that a tuning run was made of."""
    rows = data.logs(spark, d)
    tuning = data.diff(spark, d).select(F.upper(F.concat(F.lit(" "), "Content")).alias("Content"))
    return scoring.decontaminate(rows, tuning).select("row_id", "Content")


@query
def passage_leaks(spark, d):
    """Documents that hold a benchmark passage, or a short item of it, word for word."""
    return passages.passage_leaks(data.table(spark, d, "documents"), data.short_and_long_items(spark, d))


@query
def plan_closure(spark, d):
    return merge.resolve_plan(_plan(spark, d), "intended")


@query
def doc_broadcast_join(spark, d):
    joined = prompts.attach_document(data.diff(spark, d), _document(spark, d))
    return joined.select("row_id", F.concat_ws("\n", "Content", "document").alias("text"))


# Aggregations.


@query
def parsing_accuracy(spark, d):
    return scoring.accuracy(data.scored(spark, d), ["system"]).withColumn("accuracy", F.round("accuracy", 6))


@query
def coverage(spark, d):
    return scoring.coverage(data.answered_logs(spark, d), by=["system"])


@query
def label_distribution(spark, d):
    return labels.label_distribution(data.labels(spark, d))


@query
def number_distribution(spark, d):
    return labels.number_distribution(data.labels(spark, d))


@query
def merge_effect(spark, d):
    counts = merge.type_counts(data.vector_labels(spark, d))
    return merge.merge_effect(counts, merge.resolve_plan(_plan(spark, d)))


@query
def summary_overview(spark, d):
    return summaries.summary_overview(data.summaries(spark, d))


@query
def seed_stats(spark, d):
    chosen = seeds.attach_summaries(data.labels(spark, d), data.summaries(spark, d), "seq", "intended")
    return seeds.seed_stats(chosen)


@query
def selection_distribution(spark, d):
    return seeds.selection_distribution(_seeds(spark, d))


@query
def summary_corpus(spark, d):
    return summaries.summary_corpus(data.summaries(spark, d), "seq")


@query
def augment_totals(spark, d):
    variants = data.first_variants(spark, d).withColumn("place", F.col("pos"))
    return augment.augment_totals(augment.tuning_union(data.seeds(spark, d), variants))


@query
def strata(spark, d):
    return seeds.strata(data.labels(spark, d))


@query
def failure_codes(spark, d):
    return labels.failure_codes(_labelled(spark, d))


@query
def grouping_accuracy(spark, d):
    return scoring.grouping_accuracy(data.scored(spark, d), ["system"]).withColumn(
        "grouping_accuracy", F.round("grouping_accuracy", 6)
    )


@query
def template_inventory(spark, d):
    return scoring.template_inventory(data.logs(spark, d))


@query
def inconsistent_templates(spark, d):
    return scoring.inconsistent_templates(data.scored(spark, d), ["system"])


# Windows.


@query
def stratified_shuffle(spark, d):
    shuffled = seeds.stratified_shuffle(data.labels(spark, d), "row_id")
    return _int(shuffled, "rank").select("row_id", "Error_Number", "rank")


@query
def round_robin_seeds(spark, d):
    return _int(_seeds(spark, d), "slot").select("row_id", "Error_Number", "slot")


@query
def dedup_keep_last(spark, d):
    return seeds.dedup_keep_last(data.summaries(spark, d), ["original_log", "correct_template"], "seq")


@query
def reletter(spark, d):
    named = taxonomy.reletter(_merged_types(spark, d), ["doc_id"])
    return _int(named, "number").select("doc_id", "number", "letter", "title")


@query
def running_accuracy(spark, d):
    return scoring.running_accuracy(data.scored(spark, d), chunk=64).withColumn(
        "accuracy", F.round("accuracy", 6)
    )


@query
def top_n_variants(spark, d):
    return augment.top_n_variants(data.first_variants(spark, d), 2).select("seed_id", "pos", "input", "output")


@query
def merge_target(spark, d):
    plan = _plan(spark, d)
    return plan.select("from_type", "to_type", F.col("seq.i").alias("first_i"), F.col("seq.j").alias("first_j"))


# Samples and limits.


@query
def sample_rows(spark, d):
    return ranking.sample_rows(data.logs(spark, d), "row_id", 500).select("row_id", "Content")


@query
def capped_sample(spark, d):
    valid = summaries.clean_summaries(data.summaries(spark, d))
    return _int(ranking.capped_sample(valid, "seq", None, 300), "position").select("seq", "position")


@query
def max_samples(spark, d):
    variants = data.first_variants(spark, d).withColumn("place", F.col("pos") + 1)
    rows = augment.tuning_union(data.seeds(spark, d), variants)
    return ranking.max_samples(rows, ["origin", "seed_id", "place"]).select("origin", "seed_id", "input", "output")


@query
def volume_cap(spark, d):
    return ranking.volume_cap(data.seeds(spark, d), "seed_id", data.diff(spark, d)).select(
        "seed_id", "Original_Log"
    )


@query
def frequent_types(spark, d):
    return ranking.frequent_types(data.labels(spark, d), "Error_Type", 5).select("row_id", "Error_Type")


# Set operators.


@query
def tuning_union(spark, d):
    variants = data.first_variants(spark, d).withColumn("place", F.col("pos") + 1)
    return augment.tuning_union(data.seeds(spark, d), variants)


@query
def topup_union(spark, d):
    chosen, made = data.seeds(spark, d), cut_lineage(data.first_variants(spark, d))
    document = _document(spark, d)
    asked = prompts.with_request_id(prompts.topup_prompts(chosen, made, document, 3))
    return augment.topup_only(
        chosen, made, data.variant_responder(asked, 1), document, 3, 1
    ).select("seed_id", "round", "pos", "input", "output")


@query
def distinct_variants(spark, d):
    return augment.distinct_variants(data.first_variants(spark, d)).select("seed_id", "pos", "input", "output")


# Embeddings and similarity.


@query
def embed_text(spark, d):
    return taxonomy.embed_text(_blocks(spark, d)).select("doc_id", "letter", "embed_text")


@query
def embed_attach(spark, d):
    types = data.vector_types(spark, d)
    joined = merge.embed_attach(types.drop("vector"), types, "pos")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return joined.select(
        "pos", "title", F.size("vector").alias("dims"), F.round(F.sqrt(norm), 6).alias("norm")
    )


def _measuring_client():
    """Stands in for an embedding model: a text becomes its length and its number of spaces."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" "))] for t in texts]

    return embed


@query
def embed_provider(spark, d):
    texts = taxonomy.embed_text(_blocks(spark, d)).select("doc_id", "letter", "embed_text")
    found = merge.call_embedder(texts, _measuring_client)
    return found.select("doc_id", "letter", F.col("vector")[0].alias("chars"), F.col("vector")[1].alias("spaces"))


@query
def cosine_pairs(spark, d):
    """All pairs, whatever their similarity; in smaller blocks, as every product is a row."""
    return _rounded(_pairs(spark, d, -math.inf, block_rows=512))


@query
def lsh_pairs(spark, d):
    """With bands enough that a miss is one in a million; at this threshold the join then forms all products."""
    return _rounded(vectors.hashed_pairs(data.vector_types(spark, d), 0.40, recall=1 - 1e-6, bits=8))


@query
def near_copies(spark, d):
    """Near copies by hashing, with bands enough that a miss is one in a million at the threshold."""
    return _rounded(vectors.hashed_pairs(data.copied_types(spark, d), 0.90, recall=1 - 1e-6, bits=8))


@query
def threshold_sweep(spark, d):
    return merge.threshold_sweep(_pairs(spark, d, min(SWEEP)), SWEEP)


# Variant generation.


@query
def assign_strategy(spark, d):
    return data.seeds(spark, d).select("seed_id", "strategy")


@query
def topup_rounds(spark, d):
    made = augment.generate_variants(data.seeds(spark, d), data.variant_responder, _document(spark, d), 4)
    return made.select("seed_id", "place", "input", "output")


def _slot_values(spark, d):
    return augment.slot_values(data.logs(spark, d), ["system"])


@query
def substitute_variables(spark, d):
    chosen = data.seeds(spark, d).join(
        data.logs(spark, d).select(F.col("row_id").alias("seed_id"), "system"), "seed_id"
    )
    made = augment.substitute_variables(chosen, _slot_values(spark, d), 3, ["system"])
    return made.select("seed_id", "place", "input", "output")


@query
def slot_values(spark, d):
    return _slot_values(spark, d)


# Streaming and the model step.


def _arriving(spark, d):
    path = new_path(spark, "arriving")
    data.answered_logs(spark, d).repartition(4).write.parquet(path)
    schema = spark.read.parquet(path).schema
    return live.read_stream(spark, path, schema)


@query
def stream_scoring(spark, d):
    path, checkpoint = new_path(spark, "scored"), new_path(spark, "progress")
    live.stream_scoring(_arriving(spark, d), path, checkpoint, once=True).awaitTermination()
    return spark.read.parquet(path).select("row_id", "system", "Prediction", "outcome")


@query
def stream_accuracy(spark, d):
    scored = scoring.score(_arriving(spark, d))
    checkpoint = new_path(spark, "progress")
    live.stream_accuracy(scored, checkpoint, once=True).awaitTermination()
    return live.latest_accuracy(spark, checkpoint).withColumn("accuracy", F.round("accuracy", 6))


def _echo_client():
    """Stands in for a model: quotes the log of the prompt under its system text's length, and fails on some."""

    def answer(system: str, prompt: str) -> str:
        log = prompt.split('"')[1]
        if log.endswith("7"):
            raise ValueError("no answer")
        return f"{len(system)} TEMPLATE: {log.upper()}"

    return answer


@query
def model_provider(spark, d):
    """A first run over a third of the logs, then a run over all that asks the rest; equal texts go under two system prompts."""
    system = F.when(F.expr("row_id % 2 = 0"), fixed.ERROR_SYSTEM).otherwise(fixed.CLASSIFY_SYSTEM)
    asked = prompts.parse_prompts(data.logs(spark, d)).withColumn("system_prompt", system)
    asked = prompts.with_request_id(asked).select("row_id", "request_id", "system_prompt", "prompt")
    store = provider.ReplyStore(spark, new_path(spark, "store"), buckets=8)
    provider.answer(asked.filter("row_id % 3 = 0"), store, _echo_client, in_flight=4)
    replies = provider.answer(asked, store, _echo_client, in_flight=4, retry_failed=False)
    return asked.select("row_id", "request_id").join(replies, "request_id").select("row_id", "response", "error")
