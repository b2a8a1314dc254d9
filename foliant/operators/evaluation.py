"""Evaluation sets: cases from facts, predicted against gold, failures by cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def structured_cases(rows: DataFrame, key: str, subject: str, fields: dict[str, str]) -> DataFrame:
    """A question for each field of each row (`%s` is the subject), its answer, and the row as the one relevant record."""
    from .gold import questions

    held = questions(rows, [key], subject, fields)
    return held.select(F.concat_ws(":", F.lit("structured"), F.col(key).cast("string"), "field").alias("query_id"), "question", "answer", F.array(F.col(key).cast("string")).alias("relevant"))


def semantic_cases(chunks: DataFrame, key: str, title: str, text: str) -> DataFrame:
    """A question about each chunk's title, or its first words."""
    topic = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, 8), " "))
    held = chunks.filter(F.coalesce(topic, F.lit("")) != "")
    return held.select(F.concat_ws(":", F.lit("semantic"), F.col(key).cast("string")).alias("query_id"), F.concat(F.lit("Explain "), topic, F.lit(".")).alias("question"), F.left(text, F.lit(200)).alias("answer"), F.array(F.col(key).cast("string")).alias("relevant"))


def hybrid_cases(structured: DataFrame, semantic: DataFrame, on: str) -> DataFrame:
    """Both kinds of cases about one subject as one."""
    a = structured.select(on, F.col("question").alias("qa"), F.col("relevant").alias("ra"))
    b = semantic.select(on, F.col("question").alias("qb"), F.col("relevant").alias("rb"))
    return a.join(b, on).select(on, F.concat_ws(" ", "qa", "qb").alias("question"), F.array_union("ra", "rb").alias("relevant"))


def case_issues(cases: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Cases with what is wrong: no question, nothing relevant, a relevant id that the corpus lacks, a repeated question."""
    from pyspark.sql import Window

    each = cases.select("query_id", F.explode_outer("relevant").alias("_r"))
    lost = each.join(corpus.select(F.col(key).cast("string").alias("_r")), "_r", "left_anti").filter("_r is not null").groupBy("query_id").agg(F.count("*").alias("_lost"))
    held = cases.join(lost, "query_id", "left").withColumn("_n", F.count("*").over(Window.partitionBy("question")))
    issues = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("question"), F.lit("")) == "", "no_question"),
            F.when(F.coalesce(F.size("relevant"), F.lit(0)) <= 0, "nothing_relevant"),
            F.when(F.col("_lost") > 0, "unknown_id"),
            F.when(F.col("_n") > 1, "repeated_question"),
        )
    )
    return held.withColumn("issues", F.array_join(issues, ",")).drop("_lost", "_n")


def record_matches(page_a: Column, page_b: Column, name_a: Column, name_b: Column, field_a: Column, field_b: Column, value_a: Column, value_b: Column) -> Column:
    """Page, name, field and (where the gold has one) number agree."""
    from ..functions.numeric import numeric_match

    return (page_a == page_b) & (F.lower(name_a) == F.lower(name_b)) & (field_a == field_b) & (value_b.isNull() | F.coalesce(numeric_match(value_a, value_b), F.lit(False)))


def against_gold(actual: DataFrame, gold: DataFrame, on: list[str], fields: list[str]) -> DataFrame:
    """(field, compared, correct, missing, accuracy) of actual values against gold ones; gold without a value isn't compared."""
    a = actual.select(*on, *[F.col(f).alias(f"a_{f}") for f in fields])
    joined = gold.join(a, on, "left")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("gold"), F.col(f"a_{f}").cast("double").alias("actual")) for f in fields])
    long = joined.select(F.inline(pairs)).filter("gold is not null")
    good = F.coalesce(F.abs(F.col("gold") - F.col("actual")) <= 1e-6, F.lit(False))
    return long.groupBy("field").agg(F.count("*").alias("compared"), F.count_if(good).alias("correct"), F.count_if(F.col("actual").isNull()).alias("missing"), F.round(F.avg(good.cast("double")), 6).alias("accuracy"))


def shared_numbers(left: DataFrame, right: DataFrame, page: str, numbers: str) -> DataFrame:
    """Rows of one page with a registry number in common: joined on page and number, each pair once."""
    a = left.select(F.col(page), F.col("id").alias("left_id"), F.explode(F.array_distinct(numbers)).alias("number"))
    b = right.select(F.col(page), F.col("id").alias("right_id"), F.explode(F.array_distinct(numbers)).alias("number"))
    return a.join(b, [page, "number"]).groupBy(page, "left_id", "right_id").agg(F.count("*").alias("shared"))


def failure_cause(answered: Column, gold_ok: Column, structured_ok: Column, retrieved: Column, ranked: Column) -> Column:
    """Why a case failed, first cause first."""
    return (
        F.when(answered, "none")
        .when(~gold_ok, "gold_mismatch")
        .when(~structured_ok, "structured_data")
        .when(~retrieved, "candidate_generation")
        .when(~ranked, "ranking")
        .otherwise("answer_generation")
    )


def summarize(cases: DataFrame, kind: str, measures: list[str], cause: str) -> tuple[DataFrame, DataFrame]:
    """(means by kind and over all, counts by cause)."""
    means = cases.rollup(kind).agg(F.count("*").alias("cases"), *[F.round(F.avg(m), 6).alias(m) for m in measures])
    return means, cases.groupBy(cause).agg(F.count("*").alias("cases"))


def statistics(cases: DataFrame, intent: str, agents: str, question: str) -> DataFrame:
    """(dimension, value, cases) by intent and agent, and how many questions are different."""
    by_intent = cases.groupBy(F.col(intent).alias("value")).agg(F.count("*").alias("cases")).select(F.lit("intent").alias("dimension"), "value", "cases")
    by_agent = cases.select(F.explode(agents).alias("value")).groupBy("value").agg(F.count("*").alias("cases")).select(F.lit("agent").alias("dimension"), "value", "cases")
    unique = cases.agg(F.count_distinct(question).alias("cases")).select(F.lit("unique_questions").alias("dimension"), F.lit(None).cast("string").alias("value"), "cases")
    return by_intent.unionByName(by_agent).unionByName(unique)


def formula_inventory(formulas: DataFrame, expression: str, executable: list[str]) -> DataFrame:
    """executable (a known pattern), registry_only (has an expression) or unsupported."""
    known = F.lit(False)
    for p in executable:
        known = known | F.col(expression).rlike(p)
    state = F.when(F.coalesce(known, F.lit(False)), "executable").when(F.coalesce(F.trim(expression), F.lit("")) != "", "registry_only").otherwise("unsupported")
    return formulas.withColumn("support", state)
