"""Retrieval quality, percentiles by index, costs and router reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grades of relevance.
GRADES = {"REQUIRED": 3, "SUPPORTING": 2, "OPTIONAL": 1, "IRRELEVANT": 0}


def grade(level: Column) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in GRADES.items() for x in (F.lit(k), F.lit(v))])[level], F.lit(0))


def recall_at(found: Column, relevant: Column, k: int) -> Column:
    return F.when(F.size(relevant) > 0, F.size(F.array_intersect(F.slice(found, 1, k), relevant)) / F.size(F.array_distinct(relevant))).otherwise(0.0)


def precision_at(found: Column, relevant: Column, k: int) -> Column:
    """Over what was returned, which may be fewer than k."""
    top = F.slice(found, 1, k)
    return F.when(F.size(top) > 0, F.size(F.array_intersect(top, relevant)) / F.size(top)).otherwise(0.0)


def reciprocal_rank(found: Column, relevant: Column) -> Column:
    places = F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(places) > 0, 1.0 / F.array_min(places)).otherwise(0.0)


def hit_at(found: Column, relevant: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(F.slice(found, 1, k), relevant), F.lit(False)).cast("double")


def ndcg_at(found: Column, grades: Column, k: int) -> Column:
    """grades: map of id to grade; the ideal order is over all of them."""

    def gain(values: Column) -> Column:
        return F.aggregate(F.transform(F.slice(values, 1, k), lambda g, i: g / F.log2(i + F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)

    got = gain(F.transform(found, lambda x: F.coalesce(F.element_at(grades, x), F.lit(0)).cast("double")))
    best = gain(F.transform(F.sort_array(F.map_values(grades), asc=False), lambda g: g.cast("double")))
    return F.when(best > 0, got / best).otherwise(0.0)


def overlap_accuracy(expected: Column, predicted: Column) -> Column:
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(expected, predicted)) / F.size(F.array_distinct(expected))).otherwise(1.0)


def retrieval_metrics(cases: DataFrame, found: str = "retrieved", relevant: str = "relevant", default_grade: int = 3, places: int = 6) -> DataFrame:
    """Cases with recall, precision, hits, mrr and ndcg beside them."""
    f, r = F.col(found), F.col(relevant)
    grades = F.map_from_arrays(F.array_distinct(r), F.transform(F.array_distinct(r), lambda _: F.lit(default_grade)))
    out = {f"recall_{k}": recall_at(f, r, k) for k in (1, 3, 5, 10)}
    out |= {"precision_5": precision_at(f, r, 5), "hit_5": hit_at(f, r, 5), "mrr": reciprocal_rank(f, r), "ndcg_10": ndcg_at(f, grades, 10)}
    return cases.withColumns({k: F.round(v, places) for k, v in out.items()})


def mean_metrics(cases: DataFrame, names: list[str], by: list[str] | None = None, places: int = 6) -> DataFrame:
    """Means that skip nulls, 0 where there is nothing; with `by`, one row for each group and one for all."""
    means = [F.round(F.coalesce(F.avg(n), F.lit(0.0)), places).alias(n) for n in names]
    return (cases.rollup(*by) if by else cases.groupBy()).agg(F.count("*").alias("cases"), *means)


def collapse_to_span(found: Column, relevant: Column) -> Column:
    """Relevant ids as one span: the first hit stands for all."""
    return F.transform(found, lambda x: F.when(F.array_contains(relevant, x), F.lit("span")).otherwise(x.cast("string")))


def percentile_by_index(values: Column, p: float) -> Column:
    """sorted[min(int(n * p / 100), n - 1)]; 0 for nothing."""
    ordered = F.sort_array(values)
    n = F.size(ordered)
    return F.when(n > 0, F.get(ordered, F.least(F.floor(n * p / 100), n - 1).cast("int"))).otherwise(0.0)


def latest_values(rows: DataFrame, by: str, value: str, order: str, keep: int = 1000) -> DataFrame:
    """The last `keep` values of each group, as an array."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).groupBy(by).agg(F.sort_array(F.collect_list(value)).alias("values"))


def histogram(rows: DataFrame, by: str, value: str, order: str, keep: int = 1000) -> DataFrame:
    """count, sum, avg, p50 and p95 over the last `keep` values of each group."""
    held = latest_values(rows, by, value, order, keep)
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    return held.select(
        by,
        F.size("values").cast("long").alias("n"),
        F.round(total, 4).alias("total"),
        F.round(total / F.size("values"), 4).alias("mean"),
        F.round(percentile_by_index(F.col("values"), 50), 6).alias("p50"),
        F.round(percentile_by_index(F.col("values"), 95), 6).alias("p95"),
    )


def upper_median(values: Column) -> Column:
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def request_category(intent: Column, agents: Column, gate: Column, follow_up: Column, cached: Column) -> Column:
    """Ordered rules for what kind of request something was."""
    return (
        F.when(gate != "PASS", "gate_rejected")
        .when(follow_up, "follow_up")
        .when(F.size(agents) > 1, "hybrid")
        .when(F.array_contains(agents, "formula"), "formula")
        .when(F.array_contains(agents, "semantic"), F.when(cached, "semantic_cached").otherwise("semantic"))
        .when(F.array_contains(agents, "structured"), "structured")
        .otherwise("other")
    )


def request_cost(latency_ms: Column, embedding_tokens: Column, db_calls: Column, per_second: float = 1e-4, per_token: float = 1.3e-7, per_call: float = 1e-6) -> Column:
    return latency_ms / 1000 * per_second + embedding_tokens * per_token + db_calls * per_call


def cost_rollup(costs: DataFrame, by: str, cost: str, cached: str) -> DataFrame:
    """Per category and over all: requests, total and mean cost, share of cache hits."""
    return costs.rollup(by).agg(
        F.count("*").alias("requests"),
        F.round(F.sum(cost), 6).alias("total_cost"),
        F.round(F.avg(cost), 8).alias("mean_cost"),
        F.round(F.avg(F.col(cached).cast("double")), 6).alias("cache_rate"),
    )


def confusion(cases: DataFrame, expected: str, predicted: str) -> DataFrame:
    return cases.groupBy(expected, predicted).agg(F.count("*").alias("n"))


def best_mode(rows: DataFrame, mode: str, value: str) -> DataFrame:
    """The mode of the greatest mean, the first by name of equals."""
    means = rows.groupBy(mode).agg(F.round(F.avg(value), 9).alias("mean"))
    return means.orderBy(F.desc("mean"), F.asc(mode)).limit(1)
