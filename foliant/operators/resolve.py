"""Entity resolution that never guesses: more than one best match is ambiguous."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import GENERIC_NAMES, normalize_name
from ..functions.text import name_tokens


def _best(matches: DataFrame, query: str, key: str, margin: float = 0.05) -> DataFrame:
    """One row per query: its best match, or AMBIGUOUS where another entity comes within the margin."""
    per = matches.groupBy(query, key).agg(F.max(F.struct("score", "strategy")).alias("m")).select(query, key, "m.score", "m.strategy")
    w = Window.partitionBy(query).orderBy(F.desc("score"), F.asc(key))
    held = per.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w)).filter("_n = 1")
    close = F.coalesce(F.col("score") - F.col("_next") < margin, F.lit(False))
    return held.select(query, F.when(~close, F.col(key)).alias(key), F.round("score", 6).alias("score"), "strategy", F.when(close, "AMBIGUOUS").otherwise("RESOLVED").alias("status"))


def _two(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of the entities that look alike the two of least key: more can't change which is best, nor whether it is alone."""
    w = Window.partitionBy(*by).orderBy("_k")
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n <= 2").drop("_n")


def overlaps(queries: DataFrame, registry: DataFrame, least: float) -> DataFrame:
    """(_q, _k, score) by 0.8 times the share of a name's special words that the query has, from `least` on.

    Sets of words are compared, not rows.  A match has `need` of a name's n words, so it has one of
    the n - need + 1 words that are rarest among names; only those are joined.
    """
    sets = _two(registry.select("_k", F.array_sort("_set").alias("_set")).filter(F.size("_set") > 0), ["_set"])
    asked = queries.filter(F.size("_set") > 0).select("_q", F.array_sort("_set").alias("_asked"))
    distinct = sets.select("_set").distinct()
    rare = distinct.select(F.explode("_set").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    ranked = distinct.select("_set", F.explode("_set").alias("token")).join(rare, "token").groupBy("_set").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "token"))), lambda s: s["token"]).alias("order"))
    need = F.ceil(F.size("_set") * least / 0.8 - 1e-9).cast("int")
    index = ranked.select("_set", F.explode(F.slice("order", F.lit(1), F.size("_set") - need + 1)).alias("token"))
    pairs = asked.select("_asked").distinct().select("_asked", F.explode("_asked").alias("token")).join(index, "token").select("_asked", "_set").distinct()
    score = 0.8 * F.size(F.array_intersect("_asked", "_set")) / F.size("_set")
    scored = pairs.withColumn("score", score).filter(F.col("score") >= least)
    return asked.join(scored, "_asked").join(sets, "_set").select("_q", "_k", "score")


def resolve(queries: DataFrame, registry: DataFrame, query: str, text: str, key: str, name: str, aliases: str | None = None, number: str | None = None, least: float = 0.5, margin: float = 0.05) -> DataFrame:
    """Queries to entities by ranked strategies: number 1.0, exact name 1.0, alias 0.95, token set 0.9, phrase 0.85, token overlap.

    All are equi-joins: on numbers, on normalised names, on sorted token sets, on every
    run of words of the query, and on rare words of names that aren't generic.  A query
    without a match is NOT_FOUND.
    """
    q = queries.select(F.col(query).alias("_q"), normalize_name(text).alias("_text"))
    r = registry.select(F.col(key).alias("_k"), normalize_name(name).alias("_name"), *([F.col(aliases).alias("_aliases")] if aliases else []), *([F.col(number).alias("_number")] if number else []))
    words = F.array(*[F.lit(w) for w in GENERIC_NAMES])
    found = []

    def add(pairs: DataFrame, score: float, strategy: str) -> None:
        found.append(pairs.select("_q", "_k", F.lit(score).alias("score"), F.lit(strategy).alias("strategy")))

    if number:
        from ..functions.identity import normalize_cas

        asked = q.select("_q", normalize_cas(F.col("_text")).alias("_number")).filter("_number is not null")
        add(asked.join(_two(r.select("_k", "_number"), ["_number"]), "_number"), 1.0, "number")
    add(q.join(_two(r.select("_k", F.col("_name").alias("_text")), ["_text"]), "_text"), 1.0, "exact")
    if aliases:
        each = r.select("_k", F.explode("_aliases").alias("_alias")).select("_k", normalize_name(F.col("_alias")).alias("_text"))
        add(q.join(_two(each.distinct(), ["_text"]), "_text"), 0.95, "alias")
    tokens = lambda c: F.array_sort(name_tokens(F.col(c)))
    special = lambda c: F.size(F.array_except(name_tokens(F.col(c)), words)) > 0
    add(q.filter(special("_text")).select("_q", tokens("_text").alias("_set")).join(_two(r.select("_k", tokens("_name").alias("_set")), ["_set"]), "_set"), 0.9, "token_set")
    split = F.split("_text", " ")
    starts = F.sequence(F.lit(0), F.size(split) - 1)
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.size(split) - i, F.lit(8))), lambda n: F.array_join(F.slice(split, i + 1, n), " "))))
    phrases = q.select("_q", F.explode(F.array_distinct(runs)).alias("_name")).join(_two(r.filter(special("_name")).select("_k", "_name"), ["_name"]), "_name")
    longest = F.rank().over(Window.partitionBy("_q").orderBy(F.desc(F.length("_name"))))
    add(phrases.withColumn("_r", longest).filter("_r = 1"), 0.85, "phrase")
    own = lambda c: F.array_except(name_tokens(F.col(c)), words).alias("_set")
    shared = overlaps(q.select("_q", own("_text")), r.select("_k", own("_name")), least)
    found.append(shared.select("_q", "_k", "score", F.lit("token_overlap").alias("strategy")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = _best(every, "_q", "_k", margin)
    out = q.select("_q").join(best, "_q", "left").withColumn("status", F.coalesce("status", F.lit("NOT_FOUND")))
    return out.select(F.col("_q").alias(query), F.col("_k").alias(key), "score", "strategy", "status")


def alias_owner(names: DataFrame, registry: DataFrame, name: str, key: str, aliases: str) -> DataFrame:
    """The entity that alone has an alias."""
    each = registry.select(key, F.explode(aliases).alias("_a")).select(key, normalize_name(F.col("_a")).alias("_a")).distinct()
    single = each.withColumn("_n", F.count("*").over(Window.partitionBy("_a"))).filter("_n = 1")
    return names.join(single, normalize_name(name) == F.col("_a")).select(name, key)
