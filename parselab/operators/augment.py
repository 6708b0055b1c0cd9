"""Variants of seeds, from model replies or from observed slot values, and the tuning table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parselab.functions import fixed, replies, templates
from parselab.functions.text import strip
from parselab.operators import prompts as asking
from parselab.operators.ranking import ranked
from parselab.session import cut_lineage, written


SEEDS = 50_000  # of one task in the rounds, so that its sorts do not grow with the table


def hash_number(text: Column) -> Column:
    """The first 32 bits of the md5 of a text, as a number."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def assign_strategy(seeds: DataFrame, key: str = "seed_id", seed: int = fixed.SEED) -> DataFrame:
    """One of the three strategies per seed."""
    number = hash_number(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    return seeds.withColumn("strategy", (F.pmod(number, F.lit(3)) + 1).cast("int"))


def line_candidates(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """One row per line that may be a log."""
    found = replies.line_candidates(strip(F.col(text)), F.lit(None).cast("string"))
    exploded = df.select(*keep, found.alias("found")).select(
        *keep, F.posexplode_outer("found").alias("pos", "line")
    )
    return exploded.filter(F.col("pos").isNotNull()).select(
        *keep, "pos", F.col("line.input").alias("candidate")
    )


def parse_variants(
    df: DataFrame, response: str = "response", keep_error_type: bool = False
) -> DataFrame:
    """``seed_id, pos, input, output`` for every variant in a reply, by the strategy of its seed.

    Needs ``seed_id, strategy, Original_Log, Correct_Template``. A reply that is no valid array
    is read line by line. A variant equal to its source log is dropped where JSON was read.
    """
    original, template = F.col("Original_Log"), F.col("Correct_Template")
    read = df.withColumn("_text", strip(F.coalesce(F.col(response), F.lit(""))))
    read = read.withColumn("_array", replies.json_array_slice(F.col("_text")))
    read = read.withColumn("_json", replies.parse_single(F.col("_array")))
    read = read.withColumn("_items", F.try_variant_get("_json", "$[0]", "array<variant>"))
    has_array, items = F.col("_array") != "", F.col("_items")
    by_line = replies.line_candidates(F.col("_text"), template)
    rewritten = replies.rewrite_variants(items, original)
    loose = replies.rewrite_variants(replies.loose_objects(F.col("_text")), original)
    found = (
        F.when(has_array & items.isNull(), by_line)
        .when(
            F.col("strategy") == 1,
            F.when(has_array, replies.substitution_variants(items, original, template)).otherwise(by_line),
        )
        .when(has_array & replies.badly_typed(items), by_line)
        .when(has_array, rewritten)
        .when(F.size(loose) > 0, loose)
        .otherwise(by_line)
    )
    # The outer form: an inner explode adds a filter on its array, which would parse every reply again.
    exploded = read.withColumn("_found", found).select(
        "seed_id", F.posexplode_outer("_found").alias("pos", "variant")
    )
    out = exploded.filter(F.col("pos").isNotNull()).select("seed_id", "pos", "variant.*")
    return out if keep_error_type else out.drop("error_type")


def not_identical(variants: DataFrame, input_col: str, source_col: str) -> DataFrame:
    return variants.filter(~F.col(input_col).eqNullSafe(F.col(source_col)))


def top_n_variants(variants: DataFrame, n: int = fixed.VARIANTS_PER_SEED) -> DataFrame:
    """The first ``n`` variants of each seed, by round and place."""
    place = W.partitionBy("seed_id").orderBy("round", "pos")
    return variants.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= n)


def topup_union(variants: DataFrame, further: DataFrame, round_no: int) -> DataFrame:
    """Add a further round of variants behind the ones there are."""
    return variants.unionByName(further.withColumn("round", F.lit(round_no)))


def distinct_variants(variants: DataFrame) -> DataFrame:
    """Each text of a seed once, at its first place."""
    return (
        variants.groupBy("seed_id", "input")
        .agg(
            F.min_by(F.struct("output", "round", "pos"), F.struct("round", "pos")).alias("first")
        )
        .select("seed_id", "input", "first.*")
    )


def generate_variants(
    seeds: DataFrame,
    responder: Callable[[DataFrame, int], DataFrame],
    document: DataFrame,
    n: int = fixed.VARIANTS_PER_SEED,
) -> DataFrame:
    """Ask, parse, and ask again for what is missing, until a seed has ``n`` variants or gets none.

    ``responder`` turns a request table, in which each prompt stands once, into ``request_id, response`` for a round:
    a stored reply table or a model step. Seeds with equal prompts share the reply. Each further round adds at least one variant to each seed it asks for, so
    ``n`` rounds are enough for every seed. Every round is checkpointed and never asked twice. Rows are dealt by key to one task
    per ``SEEDS`` seeds: adaptive execution would join tasks by their compressed bytes, and these texts grow tenfold in memory.
    """
    parts = max(1, -(-seeds.count() // SEEDS))

    def dealt(df: DataFrame, key: str = "seed_id") -> DataFrame:
        return df.repartition(parts, key)

    def ask(prompts: DataFrame, round_no: int) -> DataFrame:
        # The request table is written out: the responder reads its prompts, the replies join its keys.
        keyed = dealt(written(asking.with_request_id(prompts), "requests"), "request_id")
        replied = asking.attach_responses(keyed, responder(keyed.dropDuplicates(["request_id"]), round_no))
        return cut_lineage(parse_variants(replied))

    made = ask(asking.augment_prompts(seeds, document, n), 0).withColumn("round", F.lit(0))
    open_seeds, open_made = dealt(seeds), dealt(made)
    for round_no in range(1, n + 1):
        added = ask(asking.topup_prompts(open_seeds, open_made, document, n), round_no)
        if added.isEmpty():
            break
        made = topup_union(made, added, round_no)
        # A seed that got nothing is given up; only the others' variants are looked at again. Who answered in this round
        # has answered in all, so the joins of earlier rounds are not gone through again.
        answered = dealt(added.select("seed_id")).distinct()
        open_seeds = dealt(seeds).join(answered, "seed_id", "left_semi")
        open_made = dealt(made).join(answered, "seed_id", "left_semi")
    return top_n_variants(dealt(made), n)


def topup_only(
    seeds: DataFrame, variants: DataFrame, replies_of: DataFrame, document: DataFrame, n: int, round_no: int
) -> DataFrame:
    """One further round over stored replies, for a run that keeps its own loop."""
    prompts = asking.with_request_id(asking.topup_prompts(seeds, variants, document, n))
    return topup_union(variants, parse_variants(asking.attach_responses(prompts, replies_of)), round_no)


def tuning_rows(df: DataFrame, source: str, target: str, mode: str = "observed") -> DataFrame:
    """Instruction, input, output. Missing fields read ``nan`` as observed; ``intended`` drops the row."""
    if mode == "intended":
        df = df.na.drop(subset=[source, target])
    return df.withColumns(
        {
            "instruction": F.lit(fixed.INSTRUCTION),
            "input": F.coalesce(F.col(source).cast("string"), F.lit("nan")),
            "output": F.coalesce(F.col(target).cast("string"), F.lit("nan")),
        }
    )


def tuning_union(seeds: DataFrame, variants: DataFrame, mode: str = "observed") -> DataFrame:
    """Originals first, then variants; duplicates stay. Row order is ``origin, seed_id, place``."""
    originals = tuning_rows(seeds, "Original_Log", "Correct_Template", mode).select(
        F.lit("original").alias("origin"), "seed_id", F.lit(0).alias("place"), *fixed.TUNING_COLUMNS
    )
    made = variants.withColumn("instruction", F.lit(fixed.INSTRUCTION)).select(
        F.lit("variant").alias("origin"), "seed_id", "place", *fixed.TUNING_COLUMNS
    )
    return originals.unionByName(made)


def tuning_rename(tuning: DataFrame) -> DataFrame:
    return tuning.withColumnsRenamed(fixed.TUNING_NAMES)


def augment_totals(tuning: DataFrame) -> DataFrame:
    return tuning.agg(
        F.count_if(F.col("origin") == "original").alias("originals"),
        F.count_if(F.col("origin") == "variant").alias("variants"),
        F.count(F.lit(1)).alias("total"),
    )


def slot_values(
    logs: DataFrame, by: Sequence[str] = (), log: str = "Content", template: str = "EventTemplate"
) -> DataFrame:
    """Values seen at each wildcard of a template, with their counts; slots are numbered from 1."""
    held = logs.filter(templates.wildcard(F.col(template))).select(
        *by,
        F.col(template).alias("template"),
        F.posexplode_outer(templates.read_slots(F.col(log), F.col(template))).alias("at", "value"),
    )
    found = held.filter(F.col("at").isNotNull()).withColumn("slot", F.col("at") + 1)
    return found.groupBy(*by, "template", "slot", "value").agg(F.count(F.lit(1)).alias("rows"))


def substitute_variables(
    seeds: DataFrame,
    values: DataFrame,
    n: int = fixed.VARIANTS_PER_SEED,
    by: Sequence[str] = (),
    template: str = "Correct_Template",
    seed: int = fixed.SEED,
) -> DataFrame:
    """``n`` variants per seed without a model: each wildcard gets a value seen at the same slot.

    The values of a slot are numbered over many tasks, and a seed joins the one number its hash picks,
    so no pool of values is ever held in one row.
    """
    by = list(by)
    slot_key = [*by, "template", "slot"]
    values = cut_lineage(values)  # read three times below
    pool = ranked(values.select(*slot_key, "value"), "value", slot_key, seed)
    pool = pool.withColumn("pick", F.col("rank")).drop("rank")
    sizes = values.groupBy(*slot_key).agg(F.count(F.lit(1)).alias("size"))
    of_template = sizes.groupBy(*by, "template").agg(F.map_from_entries(F.collect_list(F.struct("slot", "size"))).alias("sizes"))
    asked = seeds.filter(templates.wildcard(F.col(template))).select(*by, "seed_id", F.col(template).alias("template"))
    wanted = (
        asked.join(of_template, [*by, "template"])  # before seeds become places and slots
        .withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .select(*by, "seed_id", "template", "place", F.explode("sizes").alias("slot", "size"))
    )
    number = hash_number(F.concat_ws("|", F.lit(str(seed)), "seed_id", "place", "slot"))
    picked = wanted.withColumn("pick", F.pmod(number, F.col("size")) + 1).join(pool, [*slot_key, "pick"])
    return (
        picked.groupBy("seed_id", "place", "template")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "value"))).alias("chosen"))
        .select(
            "seed_id",
            "place",
            templates.refill(F.col("template"), F.col("chosen.value")).alias("input"),
            F.col("template").alias("output"),
        )
    )
