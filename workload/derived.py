"""Log-parsing tables derived from the driver's parquet; one row per event unless noted.

Stored model replies are a function of the log text, as a reply is of its prompt. One system holds over
a third of the rows; one row in eight repeats a text, so that prompts are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parselab.functions.templates import number_letter
from parselab.functions.text import lines
from parselab.operators import augment, prompts, scoring
from parselab.session import cut_lineage

TYPES = 26


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The driver's tables are one file each; their rows are dealt out over the cores first."""
    return table(spark, d, name).repartition(spark.sparkContext.defaultParallelism)


def logs(spark: SparkSession, d: str) -> DataFrame:
    return spread_table(spark, d, "events").selectExpr(
        "event_id AS row_id",
        "user_id",
        "event_type",
        "CASE WHEN user_id % 3 = 0 THEN 'sys0' ELSE concat('sys', user_id % 5) END AS system",
        "CASE WHEN event_id % 8 = 3 THEN concat('user 7 ', event_type, ' value=100 k=1') ELSE"
        " concat('user ', user_id, ' ', event_type, ' value=', cast(round(value * 100) AS bigint),"
        " ' k=', get_json_object(props, '$.k')) END AS Content",
        "concat('user <*> ', event_type, ' value=<*> k=<*>') AS EventTemplate",
    )


OUTPUT_RULE = r"""
CASE
  WHEN event_type = 'signup' OR row_id % 10 <= 4 THEN concat('The number is variable.\nTEMPLATE: ', EventTemplate, '\ndone')
  WHEN row_id % 10 = 5 THEN concat('Reasoning.\nTEMPLATE: "', EventTemplate, '"<|im_end|>')
  WHEN row_id % 10 = 6 THEN concat('So the line is\n  output: user ', user_id, ' ', event_type, ' value=<*> k=<*>  \nend')
  WHEN row_id % 10 = 7 THEN concat('Template: user <*> ', event_type, '\nTEMPLATE: ', EventTemplate)
  WHEN row_id % 10 = 8 THEN concat('My final template user ', user_id, '\ndone')
  WHEN row_id % 100 = 99 THEN NULL
  WHEN row_id % 100 = 89 THEN ''
  ELSE concat('not sure about ', Content)
END"""


def answered_logs(spark: SparkSession, d: str) -> DataFrame:
    """Logs with the stored output of the parsing model."""
    return logs(spark, d).withColumn("response", F.expr(OUTPUT_RULE))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score(answered_logs(spark, d))


def diff(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).filter("outcome = 'diff'").select(
        "row_id", "system", "Content", "Think-Process", "EventTemplate"
    )


def written_diff(spark: SparkSession, d: str) -> DataFrame:
    """The wrong rows as the file one stage leaves to the next."""
    return cut_lineage(diff(spark, d))


def kind(text: str = "Content") -> Column:
    """Which of eight replies a log gets."""
    return F.expr(f"cast(conv(substr(md5({text}), 1, 4), 16, 10) AS int) % 8")


def label_of(number: str) -> Column:
    return F.expr(f"CASE WHEN {number} = 0 THEN 'Invalid_Label' ELSE concat('Type ', {number}) END")


def labels(spark: SparkSession, d: str, types: Column | int = TYPES) -> DataFrame:
    size = F.lit(types) if isinstance(types, int) else types
    number = F.when(F.expr("row_id % 7 = 0"), 0).otherwise(1 + F.expr("user_id * user_id + row_id") % size)
    return logs(spark, d).select(
        "row_id",
        F.col("Content").alias("Original_Log"),
        F.col("EventTemplate").alias("Correct_Template"),
        number.cast("int").alias("Error_Number"),
    ).withColumn("Error_Type", label_of("Error_Number"))


def vector_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels over as many types as there are vectors."""
    return labels(spark, d, table(spark, d, "embeddings").agg(F.count(F.lit(1))).scalar())


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summary per log; some are missing, some rows come twice and the later text counts."""
    return logs(spark, d).selectExpr(
        "*", "explode(sequence(0, CASE WHEN row_id % 13 = 0 THEN 1 ELSE 0 END)) AS copy"
    ).selectExpr(
        "row_id * 2 + copy AS seq",
        "concat(' ', Content, '  ') AS original_log",
        "EventTemplate AS correct_template",
        "CASE WHEN row_id % 11 = 0 THEN NULL"
        " WHEN row_id % 17 = 0 THEN '  too short '"
        " ELSE concat('  Template for ', event_type, ' split wrongly at ',"
        " element_at(split(Content, '='), -1), ' copy ', copy) END AS error_summary",
    )


def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """Ten lettered types, one per label of the embedding table."""
    return table(spark, d, "embeddings").groupBy((F.col("label") + 1).alias("number")).agg(
        F.count(F.lit(1)).alias("n")
    ).select(
        "number",
        number_letter(F.col("number")).alias("letter"),
        (F.col("number") - 1).alias("pos"),
        F.concat(F.lit("Type "), "number").alias("title"),
        F.concat(F.lit("Seen in "), "n", F.lit(" vectors")).alias("description"),
        F.expr("transform(array('a', 'b', 'c'), x -> concat('example ', number, x))").alias("examples"),
    )


def vector_types(spark: SparkSession, d: str) -> DataFrame:
    """A type per vector: a taxonomy that grows with the embedding table."""
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("pos"),
        F.concat(F.lit("Type "), F.col("vec_id") + 1).alias("title"),
        F.col("embedding").alias("vector"),
    )


def short_and_long_items(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items, what stands before their first to sixth space, and empty items."""
    items = table(spark, d, "benchmark").select("item_id", "text")
    shorts = items.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6)))).selectExpr(
        "item_id * 10 + k + 1000000 AS item_id", "substring_index(text, ' ', k) AS text"
    )
    return items.unionByName(shorts).unionByName(items.selectExpr("item_id + 2000000 AS item_id", "'' AS text"))


def copied_types(spark: SparkSession, d: str) -> DataFrame:
    """Every vector, and a copy of it in which every seventh number is a third as large."""
    near = F.transform("vector", lambda x, at: F.when(at % 7 == 0, x.cast("double") / 3).otherwise(x.cast("double")))
    types = vector_types(spark, d).repartition(spark.sparkContext.defaultParallelism)  # as spread_table does
    own = types.select((F.col("pos") * 2).alias("pos"), F.col("vector").cast("array<double>").alias("vector"))
    return own.unionByName(types.select((F.col("pos") * 2 + 1).alias("pos"), near.alias("vector")))


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """A taxonomy document per document: each text line becomes a block, letters repeat after Z."""
    blocks = F.transform(
        lines(F.col("text")),
        lambda line, at: F.concat(
            F.lit("#### "), F.char(65 + at.cast("bigint") % 26), F.lit(". "), line,
            F.lit("\n- "), line, F.lit("\nmore\n- Example errors: inline\n  - \""), line,
            F.lit("\"\n"),
        ),
    )
    return spread_table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("# Types\n\n"), F.array_join(blocks, "\n")).alias("text")
    )


LABEL_REPLY = r"""
CASE
  WHEN kind = 0 AND n % 2 = 0 THEN concat('{"label": 99, "error_type": "First", "label": ', n, ', "error_type": "Named ', n, '"}')
  WHEN kind = 0 THEN concat('{"label": ', n, ', "error_type": "Named ', n, '"}')
  WHEN kind = 1 THEN concat('{"label": "', n, '", "error_type": "x"}')
  WHEN kind = 2 THEN concat('I think it is ', n)
  WHEN kind = 3 THEN concat('{"label": ', n, ', "error_type": }')
  WHEN kind = 4 THEN '{"label": 99, "error_type": "Type 99"}'
  WHEN kind = 5 THEN concat('{"label": ', n, '}')
  WHEN kind = 6 THEN concat('Sure.\n{"label": ', n, '.0, "error_type": "Unknown"}\nDone')
  WHEN length(Content) % 3 = 0 THEN '  '
  WHEN length(Content) % 3 = 1 THEN NULL
  ELSE 'no row'
END"""

SUMMARY_REPLY = r"""
CASE kind
  WHEN 0 THEN concat('Some analysis.\n\nerror_summary: The Value was missed in ', Content)
  WHEN 1 THEN concat('error_summary: first\n\nerror_summary: "Second   ', Content, '"  ')
  WHEN 2 THEN concat('Para one.\n \nPara two ', Content)
  WHEN 3 THEN concat('Intro\n\n```\ncode ', Content, '\n```\n\ntail ', Content)
  WHEN 4 THEN concat('So $\\boxed{', Content, '}$ and \\boxed{x}')
  WHEN 5 THEN concat('error_summary: ', repeat(Content, 60))
  WHEN 6 THEN ''
  ELSE concat('## Step 1: look\n## Step 12: see\nI think</think>\n\nFinal ', Content)
END"""

VARIANT_REPLY = r"""
CASE
  WHEN strategy = 1 THEN CASE kind
    WHEN 0 THEN concat('["', c, ' x1", "', c, ' x2", "', c, ' x3"]')
    WHEN 1 THEN concat('Here you go:\n["', c, ' x1", "', c, ' x2"]\nDone.')
    WHEN 2 THEN concat('["', c, '", "', c, ' x1", " \'', c, '\' "]')
    WHEN 3 THEN concat('["', c, ' x1", 5, null, {"example": "x"}, true, "', c, ' x2"]')
    WHEN 4 THEN concat('["', c, ' x1", oops]\n```\n', c, ' x9\n/* note')
    WHEN 5 THEN concat('["', c, ' x1"]')
    WHEN 6 THEN concat('["', c, ' x1", "', c, ' x1", "', c, ' x2"]')
    ELSE '' END
  ELSE CASE kind
    WHEN 0 THEN concat('[{"example": "', c, ' y1", "template": "', t, ' y1"}, {"example": " ', c, ' y2", "template": "', t, ' y2 ", "error_type": 3}]')
    WHEN 1 THEN concat('Sure:\n[{"example": "first", "template": 5, "example": "', c, ' y1", "template": "', t, ' y1"}]\nBye')
    WHEN 2 THEN concat('[{"example": "', c, '", "template": "', t, '"}, {"example": "', c, ' y1", "template": "', t, ' y1"}]')
    WHEN 3 THEN concat('[{"example": "', c, ' y1", "template": "', t, ' y1"}, "text", 7, {"example": "only"}]')
    WHEN 4 THEN concat('[{"example": "', c, ' y1", "template": 5}]')
    WHEN 5 THEN concat('{"example": "', c, ' y1", "template": "', t, ' y1"}\n{"example": "', c, ' y2", "template": null}\n{"example": "', c, '", "template": "', t, '"}')
    WHEN 6 THEN concat('[{"example": "', c, ' y1", "template": "', t, ' y1"}, {"example": "', c, ' y1", "template": "', t, ' y1"}]')
    ELSE concat(c, ' y1\nshort\n```\n/* note\n  ', c, ' y2  ') END
END"""


def label_replies(spark: SparkSession, d: str) -> DataFrame:
    """Logs with the stored label reply; ``no row`` marks a failed call."""
    return diff(spark, d).withColumn("kind", kind()).withColumn(
        "n", F.expr("1 + length(Content) % 10")
    ).withColumn("reply", F.expr(LABEL_REPLY))


def label_responses(asked: DataFrame) -> DataFrame:
    """Reply table for classify prompts."""
    replies = asked.withColumn("kind", kind()).withColumn("n", F.expr("1 + length(Content) % 10"))
    return (
        replies.select("request_id", F.expr(LABEL_REPLY).alias("response"))
        .filter("response IS NULL OR response <> 'no row'")
    )


def summary_responses(rows: DataFrame) -> DataFrame:
    """Reply table for the error prompts of wrong rows; every ninth log text length had a failed call."""
    asked = prompts.with_request_id(prompts.error_prompts(rows)).withColumn("kind", kind())
    return (
        asked.filter("length(Content) % 9 <> 0")
        .select("request_id", F.expr(SUMMARY_REPLY).alias("response"))
    )


def summary_replies(spark: SparkSession, d: str) -> DataFrame:
    return logs(spark, d).withColumn("kind", kind()).withColumn("response", F.expr(SUMMARY_REPLY))


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """Every log as a seed."""
    base = labels(spark, d).withColumn("seed_id", F.col("row_id"))
    text = F.expr("CASE WHEN row_id % 5 <> 0 THEN concat('Wrong split at ', row_id) ELSE '' END")
    return augment.assign_strategy(base.withColumn("error_summary", text))


def variant_replies(asked: DataFrame, round_no: int = 0) -> DataFrame:
    """Add ``response`` to seeds: a first reply by kind, then one further variant for even kinds."""
    named = asked.withColumns(
        {"kind": kind("Original_Log"), "c": F.col("Original_Log"), "t": F.col("Correct_Template")}
    )
    if round_no == 0:
        return named.withColumn("response", F.expr(VARIANT_REPLY)).drop("kind", "c", "t")
    more = f"""CASE WHEN kind % 2 = 1 THEN ''
      WHEN strategy = 1 THEN concat('["', c, ' r{round_no}"]')
      ELSE concat('[{{"example": "', c, ' r{round_no}", "template": "', t, ' r{round_no}"}}]') END"""
    return named.withColumn("response", F.expr(more)).drop("kind", "c", "t")


def variant_responder(asked: DataFrame, round_no: int) -> DataFrame:
    return variant_replies(asked, round_no).select("request_id", "response")


def first_variants(spark: SparkSession, d: str, **options) -> DataFrame:
    """Variants of every seed from its first reply."""
    return augment.parse_variants(variant_replies(seeds(spark, d)), **options).withColumn("round", F.lit(0))


def document_merges(types: DataFrame) -> DataFrame:
    """A merge plan per document: every third type goes into the document's type A."""
    return types.filter("pos % 3 = 2").select(
        "doc_id", F.col("title").alias("from_type"), F.lit("A").alias("to_type")
    )
