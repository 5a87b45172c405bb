"""Changes to tables as DataFrame algebra: each returns the whole new state of the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.versions import newest


def conform(df: DataFrame, like: DataFrame, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Columns and types of ``like``; missing columns get their default or null, extra ones are dropped."""
    defaults = defaults or {}
    out = []
    for field in like.schema.fields:
        if field.name in df.columns:
            value: Column = F.col(f"`{field.name}`")
        else:
            value = F.lit(defaults.get(field.name))
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)


def evolve(old: DataFrame, new: DataFrame, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Both sets of rows under the union of their columns: additive schema changes fill with defaults or null."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.fillna({k: v for k, v in (defaults or {}).items() if v is not None})


def upsert(base: DataFrame, new: DataFrame, key: str, mode: str = "replace", defaults: Mapping[str, object] | None = None) -> DataFrame:
    """New rows put into ``base`` by key.

    replace: a row with a known key is replaced whole, so columns that ``new`` lacks go back to their defaults.
    merge: null and missing columns of ``new`` keep the old value. Keys of ``new`` are unique; its null keys are appended.
    """
    if mode == "replace":
        return base.join(new.select(key).where(F.col(key).isNotNull()), key, "left_anti").select(*base.columns).unionByName(conform(new, base, defaults))
    if mode != "merge":
        raise ValueError("mode is 'replace' or 'merge'")
    fresh = conform(new, base).select(F.col(key).alias("_key"), F.lit(True).alias("_new"), F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("_n"))
    joined = base.withColumn("_old", F.lit(True)).join(fresh, F.col(key) == F.col("_key"), "full_outer")
    start = {c: F.when(F.col("_old").isNull(), F.lit((defaults or {}).get(c)).cast(base.schema[c].dataType)) for c in base.columns}
    return joined.select(*[F.coalesce(F.col(f"_n.`{c}`"), F.col(f"`{c}`"), start[c]).alias(c) for c in base.columns])


def update(base: DataFrame, changes: DataFrame, key: str | Sequence[str], columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """Rows whose key is in ``changes`` get its values (nulls included); ``where`` limits the rows of ``base``."""
    keys = [key] if isinstance(key, str) else list(key)
    fresh = changes.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    hit = F.coalesce("_hit", F.lit(False)) & (F.lit(True) if where is None else where)
    joined = base.join(fresh, keys, "left")
    return joined.select(*[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def update_versions(base: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], scope: str = "latest", time: str = "created_at", tie: str = "id") -> DataFrame:
    """Values of ``changes`` for the latest row of a key (scope 'latest') or for all its rows ('all')."""
    if scope == "all":
        return update(base, changes, key, columns)
    touched = base.join(changes.select(key), key, "left_semi")
    heads = newest(touched, key, 1, time, tie).select(tie, key)
    pointed = heads.join(changes, key).select(tie, *columns)
    return update(base, pointed, tie, columns)


def delete(base: DataFrame, keys: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Without the rows whose key is in ``keys``; rows of null key stay."""
    return base.join(keys, [key] if isinstance(key, str) else list(key), "left_anti").select(*base.columns)


def replace_children(base: DataFrame, new: DataFrame, parent: str, parents: DataFrame | None = None) -> DataFrame:
    """Delete, then regenerate: all rows of the given parents (by default those in ``new``) go, the new ones come."""
    gone = (new if parents is None else parents).select(parent).distinct()
    return delete(base, gone, parent).unionByName(conform(new, base))


def explode_children(df: DataFrame, parent: str, values: str, out: str, index: str = "ordinal") -> DataFrame:
    """One row per element of a list column, with its place."""
    return df.select(parent, F.posexplode(values).alias(index, out))


def fan_out(keys: DataFrame, key: str, tasks: Sequence[str], out: str = "task") -> DataFrame:
    """One row per key and task."""
    return keys.select(key, F.explode(F.array(*[F.lit(t) for t in tasks])).alias(out))


def patch_json(value: Column | str, name: str, new: Column | str | None) -> Column:
    """A JSON object with one field set, or removed where the new value is null or blank; all other fields stay as they are.

    What is no JSON object, malformed or null, counts as {}.
    """
    source = F.col(value) if isinstance(value, str) else value
    held = F.try_variant_get(F.try_parse_json(source), "$", "map<string,variant>")
    others = F.map_filter(F.coalesce(held, F.expr("cast(map() as map<string,variant>)")), lambda k, _: k != name)
    fresh = F.lit(None).cast("string") if new is None else F.nullif(F.trim(F.col(new) if isinstance(new, str) else new), F.lit(""))
    return F.to_json(F.when(fresh.isNull(), others).otherwise(F.map_concat(others, F.create_map(F.lit(name), fresh.cast("variant")))))


def transition(queue: DataFrame, changes: DataFrame, key: str, now: Column) -> DataFrame:
    """A queue after changes of status (key, status, error).

    'started' sets the time of starting, 'completed' and 'failed' that of the end and the error; any other status is only set.
    Keys of ``changes`` are unique; tasks that it lacks, or gives a null status, stay as they are.
    """
    joined = queue.join(changes.select(key, F.col("status").alias("_to"), F.col("error").alias("_error")), key, "left")
    ended = F.col("_to").isin("completed", "failed")
    new = {
        "status": F.coalesce("_to", "status"),
        "started_at": F.when(F.col("_to") == "started", now).otherwise(F.col("started_at")),
        "completed_at": F.when(ended, now).otherwise(F.col("completed_at")),
        "error": F.when(ended, F.col("_error")).otherwise(F.col("error")),
    }
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in queue.columns])


def with_reasons(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows with ``reasons``: the names of the rules that they break (empty for sound rows)."""
    named = [F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*named)))


def store_transcripts(videos: DataFrame, transcripts: DataFrame, new: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """New transcripts appended, and the videos with their flag and time of fetching set: both states of one change."""
    touched = new.where(F.col("video_id").isNotNull()).select("video_id").distinct()
    changes = touched.select("video_id", F.lit(True).alias("has_transcript"), now.alias("transcript_fetched_at"))
    return update(videos, changes, "video_id", ["has_transcript", "transcript_fetched_at"]), transcripts.unionByName(conform(new, transcripts, {"language": "en"}))


def write_back_ids(rows: DataFrame, records: DataFrame, key: Sequence[str], out: str = "embedding_id") -> DataFrame:
    """Record ids put into their source rows by a deterministic key (never by position)."""
    return update(rows, records.select(*key, F.col("record_id").alias(out)), list(key), [out])


def sweep(df: DataFrame, column: str, stale: Sequence[str], value: str, older_than: Column) -> DataFrame:
    """Rows left in one of the ``stale`` values since before a time get ``value``."""
    hit = F.col(column).isin(*stale) & F.coalesce(older_than, F.lit(False))
    return df.withColumn(column, F.when(hit, F.lit(value)).otherwise(F.col(column)))
