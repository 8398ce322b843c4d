"""Changes of tables as new tables: merges, edits, deletions, audit entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.operators.windows import best_per

#: Up to this many ids are left to Spark, which broadcasts them.
IDS = 10_000


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Current rows without the incoming keys, and the newest incoming row of each key. Applying
    the same rows again changes nothing."""
    fresh = best_per(incoming, keys, order)
    return current.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def replace_group(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of a group replaced by the incoming ones of that group."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def merge_changes(current: DataFrame, changes: DataFrame, key: str, unique: str) -> DataFrame:
    """Creates, updates and deletes (column ``op``) applied; clashes of ``unique`` are refused.

    Updates keep old values where the new one is null. Adds ``status``.
    """
    columns = [c for c in current.columns if c != key]
    both = current.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns], F.lit(True).alias("_was")).join(changes, key, "full_outer")
    there = F.col("_was").isNotNull()
    wanted = {c: F.when(F.col("op").isNull(), F.col(f"_o_{c}")).otherwise(F.coalesce(F.col(c), F.col(f"_o_{c}"))) for c in columns}
    merged = both.select(key, "op", there.alias("_there"), *[F.col(f"_o_{c}") for c in columns], *[v.alias(c) for c, v in wanted.items()])
    holders = merged.filter("op is null or op != 'delete'").groupBy(unique).agg(F.count(F.lit(1)).alias("_n"))
    out = merged.join(holders, unique, "left")
    clash = F.col("op").isin("create", "update") & (F.col("_n") > 1)
    status = F.when(F.col("op").isNull(), "kept").when(F.col("op") == "delete", F.when(F.col("_there"), "deleted").otherwise("missing")).when(clash, "clash")
    status = status.when(F.col("_there"), "updated").otherwise("created")
    out = out.withColumn("status", status)
    back = [F.when(F.col("status") == "clash", F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return out.select(key, *back, "status").filter("status != 'deleted' and status != 'missing'")


def audit_entries(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each changed field: key, field, old and new value as text. Null new values change
    nothing."""
    text = lambda df, p: df.select(key, *[F.col(c).cast("string").alias(f"{p}{c}") for c in fields])
    both = text(old, "o_").join(text(new, "n_"), key)
    changed = [F.when(F.col(f"n_{c}").isNotNull() & ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}")), F.struct(F.lit(c).alias("field"), F.col(f"o_{c}").alias("old_value"), F.col(f"n_{c}").alias("new_value"))) for c in fields]
    return both.select(key, F.explode(F.array_compact(F.array(*changed))).alias("x")).select(key, "x.*")


def delete_group(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table without the rows of the groups in ``gone``."""
    return {n: df.join(gone.select(key).distinct(), key, "left_anti") for n, df in tables.items()}


def marked(rows: DataFrame, ids: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Rows of the given ids with new values, the others as they are. Of more than IDS the
    distinct ones of a partition are hashed, so that the rows, which may be wide, pass by them and are not sorted."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    if ids.limit(IDS + 1).count() > IDS:
        hit = hit.hint("shuffle_hash")
    out = rows.join(hit, key, "left")
    return out.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def repaired_jobs(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Files left in processing: completed if all pages are there, else pending; jobs: failed."""
    done = pages.groupBy("file_id").agg(F.count(F.lit(1)).alias("_done"))
    out = jobs.join(done, "file_id", "left")
    processing = F.when(F.coalesce("_done", F.lit(0)) >= F.col("page_count"), "completed").otherwise("pending")
    status = F.when(F.col("status") == "processing", processing).when(F.col("status").isin("running", "queued"), "failed").otherwise(F.col("status"))
    return out.select("file_id", "page_count", status.alias("status"))
