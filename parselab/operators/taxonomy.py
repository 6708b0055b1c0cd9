"""The error taxonomy: two readers for its markdown document, re-lettering, and the document writer.

Every function takes ``by``, the columns that tell several documents apart; a document is one row
of text and is parsed inside that row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parselab.functions import fixed
from parselab.functions.templates import letter_number, number_letter
from parselab.functions.text import lines, strip


def read_taxonomy(docs: DataFrame, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """``number, title, pos`` from the heading lines; the last title of a number wins, its first place stays."""
    line = docs.select(*by, F.posexplode_outer(lines(F.col(text))).alias("pos", "line"))
    heads = line.withColumn("line", strip(F.col("line"))).filter(
        F.col("line").startswith(fixed.HEADING) & F.col("line").contains(". ")
    )
    rest = heads.select(
        *by, "pos", strip(F.replace(F.col("line"), F.lit(fixed.HEADING), F.lit(""))).alias("rest")
    ).filter(F.col("rest").contains(". "))
    named = rest.select(
        *by,
        "pos",
        strip(F.substring_index("rest", ". ", 1)).alias("letter"),
        strip(F.substr(F.col("rest"), F.instr("rest", ". ") + 2)).alias("title"),
    ).filter(F.col("letter").rlike(r"^\p{L}$"))
    return named.groupBy(*by, letter_number(F.col("letter")).alias("number")).agg(
        F.max_by("title", "pos").alias("title"), F.min("pos").alias("pos")
    )


def _is_example_head(line: Column) -> Column:
    one, two = fixed.EXAMPLE_HEADS
    return line.startswith(one) | line.startswith(two)


def _quoted(line: Column) -> Column:
    body = F.substr(line, F.lit(4))
    return F.when(line.endswith('"'), F.substring(body, 1, F.greatest(F.length(body) - 1, F.lit(0)))).otherwise(body)


def _inline_examples(line: Column) -> Column:
    """Examples that stand on the heading line itself."""
    rest = strip(F.regexp_replace(line, "^- Example(?: error)?s:", ""))
    quoted = F.regexp_extract_all(rest, F.lit('"([^"]*)"'), F.lit(1))
    plain = F.when(rest != "", F.array(rest)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(quoted) > 0, quoted).otherwise(plain)


def read_taxonomy_blocks(
    docs: DataFrame, text: str = "text", by: Sequence[str] = (), mode: str = "observed"
) -> DataFrame:
    """``letter, pos, title, description, examples`` from the blocks of a document.

    ``observed`` drops a block that holds a ``#`` and the examples on the heading line; ``intended``
    keeps both.
    """
    pattern = fixed.BLOCK[mode]
    matched = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    # The outer form: an inner explode adds a filter on its array, which would search every text again.
    found = docs.select(*by, matched.alias("matched")).select(
        *by, F.posexplode_outer("matched").alias("pos", "block")
    ).filter("pos IS NOT NULL")
    parts = found.select(
        *by,
        "pos",
        F.regexp_extract("block", pattern, 1).alias("letter"),
        strip(F.regexp_extract("block", pattern, 2)).alias("title"),
        F.transform(lines(strip(F.regexp_extract("block", pattern, 3))), strip).alias("body"),
    )
    # No line ends the examples, so they are all that follows the first example heading.
    head = F.array_position(F.transform("body", _is_example_head), True).cast("int")
    parts = parts.withColumn("head", head)
    before = F.when(F.col("head") > 0, F.slice("body", 1, F.col("head") - 1)).otherwise(F.col("body"))
    after = F.when(F.col("head") > 0, F.slice("body", F.col("head") + 1, F.size("body")))
    described = F.transform(
        F.filter(before, lambda line: line.startswith("- ") | ~line.startswith("-")),
        lambda line: F.when(line.startswith("- "), F.substr(line, F.lit(3))).otherwise(line),
    )
    examples = F.coalesce(
        F.transform(F.filter(after, lambda line: line.startswith('- "')), _quoted),
        F.array().cast("array<string>"),
    )
    if mode == "intended":
        inline = F.when(F.col("head") > 0, _inline_examples(F.element_at("body", F.greatest("head", F.lit(1)))))
        examples = F.concat(F.coalesce(inline, F.array().cast("array<string>")), examples)
    blocks = parts.select(
        *by,
        "pos",
        "letter",
        F.struct(
            "title", strip(F.array_join(described, " ")).alias("description"), examples.alias("examples")
        ).alias("block"),
    )
    return (
        blocks.groupBy(*by, "letter")
        .agg(F.min("pos").alias("pos"), F.max_by("block", "pos").alias("block"))
        .select(*by, "letter", "pos", "block.*")
    )


def option_text(taxonomy: DataFrame) -> DataFrame:
    """One row: the numbered options of a taxonomy and their number."""
    letter = F.coalesce(number_letter(F.col("number")), F.col("number").cast("string"))
    option = F.concat(F.col("number").cast("string"), F.lit(" ("), letter, F.lit("): "), "title", F.lit("\n"))
    return taxonomy.agg(
        F.array_sort(F.collect_list(F.struct("pos", option.alias("option")))).alias("options"),
        F.count(F.lit(1)).alias("types"),
    ).select(F.array_join("options.option", "").alias("options"), "types")


def embed_text(taxonomy: DataFrame) -> DataFrame:
    """The text that stands for a type: title, description and its first two examples."""
    return taxonomy.withColumn(
        "embed_text", F.concat_ws(" ", "title", "description", F.slice("examples", 1, 2))
    )


def surviving_types(taxonomy: DataFrame, plan: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    merged = plan.select(*by, F.col("from_type").alias("title")).distinct()
    return taxonomy.join(merged, [*by, "title"], "left_anti")


def reletter(taxonomy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Numbers 1.. in the old order; letters for the first 26."""
    place = W.partitionBy(*by).orderBy("pos")
    numbered = taxonomy.drop("letter", "number").withColumn("number", F.row_number().over(place))
    return numbered.withColumn("letter", number_letter(F.col("number")))


def taxonomy_blocks(
    taxonomy: DataFrame, by: Sequence[str] = (), threshold: float = fixed.SIMILARITY_THRESHOLD
) -> DataFrame:
    """The merged document as rows ``block, text`` in order: the header is block 0, then one per type.

    Joined by line ends the rows of a document are its text. A document of any length is never
    held in one row.
    """
    named = F.coalesce(F.col("letter"), F.col("number").cast("string"))
    listed = F.array_join(F.transform("examples", lambda e: F.concat(F.lit('  - "'), e, F.lit('"\n'))), "")
    text = F.concat(
        F.lit("#### "), named, F.lit(". "), "title", F.lit("\n- "), "description", F.lit("\n"),
        F.when(F.size("examples") > 0, F.concat(F.lit("- Example errors:\n"), listed)).otherwise(""),
    )
    body = taxonomy.select(*by, F.col("number").alias("block"), text.alias("text"))
    header = F.lit(fixed.MERGED_HEADER.format(threshold=threshold))
    if by:
        heads = taxonomy.select(*by).distinct()
    else:
        heads = taxonomy.sparkSession.range(1)
    return heads.select(*by, F.lit(0).alias("block"), header.alias("text")).unionByName(body)


def analysis_document(
    reply: DataFrame, overview: DataFrame, source: str, model: str
) -> DataFrame:
    """The first taxonomy document: run figures, then the model's text (``reply``, one row)."""
    figures = overview.select(
        *[F.col(c).cast("string") for c in ("sampled", "total", "valid")],
        F.lit(source).alias("source"),
        F.lit(model).alias("model"),
    )
    from parselab.functions.text import fill

    values = {c: F.col(c) for c in ("sampled", "total", "valid", "source", "model")}
    return figures.withColumn("reply", reply.select("response").scalar()).select(
        F.concat(fill(fixed.ANALYSIS_HEADER, **values), "reply").alias("document")
    )


def document_text(blocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One text per document, for a prompt. A document has one block per type."""
    return blocks.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("block", "text"))).alias("blocks")
    ).select(*by, F.concat(F.array_join("blocks.text", "\n"), F.lit("\n")).alias("document"))
