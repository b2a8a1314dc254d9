"""Loading knowledge: gated synchronisation, text for rows, embedding of what is pending."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import content_hash
from ..functions.text import append_uncovered
from .reconcile import upsert

#: Texts embedded at a time.
BATCH = 16


def sync(target: DataFrame, source: DataFrame, key: str, content: str, derived: list[str], reason: Column) -> tuple[DataFrame, DataFrame]:
    """(the target after the records that pass, one row of statistics)."""
    held = source.withColumn("_reason", reason)
    good = held.filter("_reason = 'ok'").drop("_reason")
    old = target.select(F.col(key).alias("_k"), content_hash(F.col(content)).alias("_old"))
    compared = held.join(old, F.col(key) == F.col("_k"), "left")
    same = F.col("_old") == content_hash(F.col(content))
    ok = F.col("_reason") == "ok"
    stats = compared.agg(
        F.count_if(ok & F.col("_k").isNull()).alias("inserted"),
        F.count_if(ok & F.col("_k").isNotNull() & ~same).alias("updated"),
        F.count_if(ok & F.col("_k").isNotNull() & same).alias("unchanged"),
        F.count_if(~ok).alias("rejected"),
    )
    return upsert(target, good, key, content, derived), stats


def enrich_rows(chunks: DataFrame, cells: DataFrame, table: str, row: str, column: str, text: str, content: str = "content", derived: str = "embedding") -> DataFrame:
    """Chunks of rows with the visible cell texts that they lack, in column order; a changed text loses its embedding."""
    seen = cells.groupBy(table, row).agg(F.transform(F.sort_array(F.collect_list(F.struct(column, text))), lambda s: s[text]).alias("_cells"))
    joined = chunks.join(seen, [table, row], "left")
    fresh = F.when(F.col("_cells").isNull(), F.col(content)).otherwise(append_uncovered(F.concat(F.array(content), F.col("_cells"))))
    changed = ~fresh.eqNullSafe(F.col(content))
    return joined.select(*[F.col(c) for c in chunks.columns if c not in (content, derived)], F.when(~changed, F.col(derived)).alias(derived), fresh.alias(content)).select(chunks.columns)


def embed_pending(chunks: DataFrame, key: str, content: str, derived: str, embed: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> DataFrame:
    """(key, embedding) of accepted chunks without one; `embed` gets up to `batch` texts at a time."""
    import pandas as pd

    kind = dict(chunks.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({key: part[key], derived: embed(part[content].tolist())})

    pending = chunks.filter((F.col("validation_status") == "accepted") & F.col(derived).isNull() & F.col(content).isNotNull())
    return pending.select(key, content).mapInPandas(run, f"{key} {kind}, {derived} array<double>")


def corpus_counts(chunks: DataFrame, derived: str = "embedding") -> DataFrame:
    accepted = chunks.filter("validation_status = 'accepted'")
    return accepted.agg(F.count("*").alias("accepted"), F.count(derived).alias("embedded"))


def row_chunk_ids(rows: DataFrame, table: str, index: str) -> DataFrame:
    return rows.withColumn("chunk_id", F.format_string("row_%s_%03d", F.col(table), F.col(index)))
