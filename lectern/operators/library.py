"""The library of jobs: listing, grouping, patches, storage and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import labels
from ..functions.naming import (
    is_generic_title, owner_of, retitled_part, safe_name, whole_title,
)
from ..functions.text import strip

LISTING = [
    "id", "status", "stage", "source", "origin_url", "title", "provider", "error",
    "collection", "created_at", "updated_at",
]


def meta_field(name: str) -> Column:
    """A text field of the JSON ``meta`` column."""
    return F.get_json_object("meta", f"$.{name}")


def meta_topics() -> Column:
    """The topics array of ``meta``."""
    return F.from_json(F.get_json_object("meta", "$.topics"), "array<string>")


def latest_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` jobs."""
    return jobs.orderBy(F.col("created_at").desc()).limit(n)


def pending_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs that survived a restart and go back to the queue, oldest first."""
    return jobs.where(F.col("status").isin("queued", "running")).orderBy("created_at")


def awaiting_downloads(jobs: DataFrame, n: int | None = None) -> DataFrame:
    """Links an agent should fetch; with ``n``, those among the latest ``n`` jobs only."""
    waiting = (F.col("stage") == "awaiting_download") & (F.col("status") == "waiting")
    looked_at = jobs if n is None else latest_jobs(jobs, n)
    return looked_at.where(waiting).select("id", "source", "referer", "transkript")


def unclaimed(jobs: DataFrame, in_flight: DataFrame) -> DataFrame:
    """Pending jobs nobody is working on."""
    return pending_jobs(jobs).join(in_flight.select("id"), "id", "left_anti")


def collections_by_recency(jobs: DataFrame) -> DataFrame:
    """Collection names, most recently used first."""
    return (
        jobs.where(F.col("collection").isNotNull() & (F.col("collection") != ""))
        .groupBy("collection")
        .agg(F.max("created_at").alias("last_used"))
        .orderBy(F.col("last_used").desc())
    )


def canonical_collection(names: DataFrame, existing: DataFrame) -> DataFrame:
    """Final collection of each job.

    ``names`` has id, title and the model's ``name`` (NULL when blank or failed);
    ``existing`` has collection and last_used. A name equal to a known one but for
    case takes the most recent spelling; no name falls back to the title.
    """
    known = existing.groupBy(F.lower("collection").alias("_key")).agg(
        F.max_by("collection", "last_used").alias("_known")
    )
    # jobs without a name get keys of their own, so they do not meet in one task
    keyed = names.withColumn(
        "_key", F.coalesce(F.lower("name"), F.concat(F.lit("\x00"), F.col("id")))
    )
    return keyed.join(known, "_key", "left").select(
        "id",
        F.coalesce(
            F.when(F.col("name").isNotNull(), F.coalesce("_known", "name")),
            strip(F.coalesce("title", F.lit(""))),
        ).alias("collection"),
    )


def parts_of(jobs: DataFrame) -> DataFrame:
    """Part jobs with the id of their parent job."""
    parents = jobs.where(meta_field("is_combined") == "true").select(
        F.col("id").alias("parent_id"), F.col("title").alias("parent_title")
    )
    parts = jobs.withColumn("parent_id", meta_field("part_of")).where(
        F.col("parent_id").isNotNull()
    )
    return parts.join(parents, "parent_id")


def ordered_topics(jobs: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct topics per group: parts in order, then the parent; with ``cap``, the first ones.

    Topics are made distinct by an aggregate and ranked before they are gathered.
    """
    parts = jobs.select(
        meta_field("part_of").alias("parent_id"), F.lit(0).alias("_stage"), "id", "created_at",
        meta_topics().alias("_t"),
    ).where(F.col("parent_id").isNotNull())
    own = jobs.where(meta_field("is_combined") == "true").select(
        F.col("id").alias("parent_id"), F.lit(1).alias("_stage"), "id", "created_at",
        meta_topics().alias("_t"),
    )
    rows = parts.unionByName(own).select(
        "parent_id", "_stage", "created_at", "id", F.posexplode("_t").alias("_pos", "topic")
    ).where(F.coalesce(F.col("topic"), F.lit("")) != "")
    first = rows.groupBy("parent_id", "topic").agg(
        F.min(F.struct("_stage", -F.unix_micros(F.col("created_at").cast("timestamp")), "id", "_pos")
              ).alias("_at")
    )
    rank = F.row_number().over(Window.partitionBy("parent_id").orderBy("_at"))
    top = first.withColumn("_rn", rank)
    if cap is not None:
        top = top.where(F.col("_rn") <= cap)
    cells = F.sort_array(F.collect_list(F.struct("_rn", "topic")))
    return top.groupBy("parent_id").agg(F.transform(cells, lambda c: c["topic"]).alias("topics"))


def backfill_candidates(jobs: DataFrame) -> DataFrame:
    """Combined jobs whose title says nothing and that have topics to title them by."""
    combined = jobs.where(meta_field("is_combined") == "true").where(
        is_generic_title(F.col("title"))
    )
    topics = ordered_topics(jobs).withColumnRenamed("parent_id", "id")
    return combined.join(topics, "id").where(F.size("topics") > 0).select("id", "title", "topics")


def rename_group(jobs: DataFrame, renames: DataFrame) -> DataFrame:
    """Rename groups: the parent and each part, which keeps its own suffix.

    ``renames`` has parent_id, base and collection (NULL leaves it unchanged).
    """
    group = F.when(meta_field("is_combined") == "true", F.col("id")).otherwise(
        meta_field("part_of")
    )
    # jobs outside any group get keys of their own, so they do not meet in one task
    alone = F.concat(F.lit("\x00"), F.col("id"))
    keyed = jobs.withColumn("parent_id", F.coalesce(group, alone)).join(renames.select(
        "parent_id", "base", F.col("collection").alias("_collection")
    ), "parent_id", "left")
    fresh = F.when(F.col("id") == F.col("parent_id"), whole_title(F.col("base"))).otherwise(
        retitled_part(F.col("title"), F.col("base"))
    )
    return keyed.withColumn(
        "title", F.when(F.col("base").isNotNull(), fresh).otherwise(F.col("title"))
    ).withColumn("collection", F.coalesce("_collection", "collection")).select(*jobs.columns)


def apply_patches(jobs: DataFrame, patches: DataFrame) -> DataFrame:
    """Partial updates in ``seq`` order; a field set to NULL explicitly becomes NULL.

    ``patches`` has id, seq, at and ``fields``, a map of column to text value.
    ``updated_at`` becomes the time of the last patch.
    """
    columns = [c for c in jobs.columns if c not in ("id", "updated_at")]
    latest = []
    for c in columns:
        has = F.map_contains_key("fields", c)
        # the value sits in a struct so that an explicit NULL still counts
        cell = F.struct(F.element_at("fields", c).alias("v"))
        latest.append(F.max_by(cell, F.when(has, F.col("seq"))).alias(f"_{c}"))
        latest.append(F.count_if(has).alias(f"_n_{c}"))
    last = patches.groupBy("id").agg(F.max_by("at", "seq").alias("_at"), *latest)
    joined = jobs.join(last, "id", "left")
    types = {f.name: f.dataType for f in jobs.schema.fields}
    out = [F.col("id")]
    for c in jobs.columns:
        if c == "id":
            continue
        if c == "updated_at":
            out.append(F.coalesce("_at", "updated_at").alias("updated_at"))
        else:
            changed = F.coalesce(F.col(f"_n_{c}") > 0, F.lit(False))
            out.append(
                F.when(changed, F.col(f"_{c}.v").cast(types[c])).otherwise(F.col(c)).alias(c)
            )
    return joined.select(*out).select(*jobs.columns)


def attach_files(jobs: DataFrame, uploads: DataFrame) -> DataFrame:
    """Waiting jobs whose file arrived: the path becomes the source, the link is kept.

    ``uploads`` has id, path and title.
    """
    joined = jobs.join(uploads.select(
        "id", F.col("path").alias("_path"), F.col("title").alias("_title")
    ), "id", "left")
    hit = F.col("_path").isNotNull() & (F.col("stage") == "awaiting_download")
    hit = F.coalesce(hit, F.lit(False))
    changes = {
        "origin_url": F.col("source"), "source": F.col("_path"),
        "title": F.nullif(strip(F.coalesce("_title", F.lit(""))), F.lit("")),
        "status": F.lit("queued"), "stage": F.lit("queued"),
    }
    return joined.select(
        *[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
          for c in jobs.columns]
    )


def set_collection(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Move jobs to a collection; a blank name clears it."""
    wanted = changes.select("id", F.struct(strip("collection").alias("v")).alias("_c"))
    joined = jobs.join(wanted, "id", "left")
    value = F.when(F.col("_c").isNotNull(), F.nullif(F.col("_c.v"), F.lit("")))
    return joined.withColumn(
        "collection", F.when(F.col("_c").isNotNull(), value).otherwise(F.col("collection"))
    ).select(*jobs.columns)


def register_jobs(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Append new jobs as queued; ``new`` has id, source, provider, created_at."""
    rows = new.withColumns({
        "status": F.lit("queued"), "stage": F.lit("queued"), "updated_at": F.col("created_at"),
    })
    return jobs.unionByName(rows, allowMissingColumns=True)


def remove_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Drop jobs by id."""
    return jobs.join(ids.select("id"), "id", "left_anti")


def ready_jobs(jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Finished jobs that do have the given output (``outputs`` has id)."""
    return jobs.where(F.col("status") == "done").join(outputs.select("id"), "id", "left_semi")


def result_envelope(jobs: DataFrame, notes: DataFrame) -> DataFrame:
    """The message sent for each finished job, and the note's excerpt."""
    finished = jobs.where(F.col("status").isin("done", "error")).join(
        notes.select("id", "markdown"), "id", "left"
    )
    done = F.struct(
        F.col("id").alias("job_id"), F.lit("done").alias("status"), "title", "markdown",
        F.try_parse_json("meta").alias("meta"),
    )
    failed = F.struct(F.col("id").alias("job_id"), F.lit("error").alias("status"), "error")
    keep_nulls = {"ignoreNullFields": "false"}
    payload = F.when(F.col("status") == "done", F.to_json(done, keep_nulls)).otherwise(
        F.to_json(failed, keep_nulls)
    )
    excerpt = F.when(
        F.col("status") == "done",
        strip(F.substring_index("markdown", labels.DETAIL_HEADING, 1)),
    )
    return finished.select("id", payload.alias("payload"), excerpt.alias("excerpt"))


def keys_without(keys: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """The distinct values of ``column`` in ``keys`` that ``known`` lacks; NULL counts as a value."""
    mine, theirs = keys.select(column).distinct(), known.select(F.col(column).alias("_k")).distinct()
    return mine.join(theirs, F.col(column).eqNullSafe(F.col("_k")), "left_anti")


def orphan_outputs(files: DataFrame, jobs: DataFrame, strict: bool = False) -> DataFrame:
    """Stored files that belong to no known job, with their size."""
    owned = files.withColumn("owner", owner_of(F.col("name"), strict))
    known = jobs.select(F.col("id").alias("owner"))
    return owned.join(known, "owner", "left_anti").select("name", "bytes", "owner")


def storage_report(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Bytes, file count and sorted file names per owner, and whether the owner is a known job.

    A job has a handful of files.
    """
    per_owner = files.groupBy(owner_of(F.col("name")).alias("owner")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files"),
        F.sort_array(F.collect_list("name")).alias("names"),
    )
    known = jobs.select(F.col("id").alias("owner"), F.col("status"))
    return per_owner.join(known, "owner", "left").withColumn(
        "orphan", F.col("status").isNull()
    )


def reclaimable_uploads(uploads: DataFrame, jobs: DataFrame) -> DataFrame:
    """Upload bytes that may be freed: those of finished jobs only."""
    done = jobs.where(F.col("status") == "done").select(F.col("id").alias("owner"))
    return (
        uploads.withColumn("owner", F.substring_index("name", ".", 1))
        .join(done, "owner", "left_semi")
        .groupBy("owner")
        .agg(F.sum("bytes").alias("bytes"))
    )


def export_layout(jobs: DataFrame, notes: DataFrame) -> DataFrame:
    """Library path of every finished job that has a note; no two jobs share one.

    The newest job keeps a contested path; the others get their id's first six
    characters appended. Where that is taken too, by another job with the same six or
    by a title that reads alike, the whole id is appended, and a digest if even that is.
    """
    done = jobs.where(F.col("status") == "done").join(notes.select("id"), "id", "left_semi")
    folder = safe_name(F.coalesce(F.nullif("collection", F.lit("")), F.lit(labels.UNASSIGNED)), 60)
    name = safe_name(F.coalesce(F.nullif("title", F.lit("")), F.col("id")))
    placed = done.select(
        "id", "created_at", folder.alias("folder"), name.alias("name")
    )
    first = placed.groupBy("folder", "name").agg(
        F.max_by("id", F.struct("created_at", "id")).alias("_first")
    )
    appended = lambda c: F.concat("name", F.lit(" ("), c, F.lit(")"))
    whole = safe_name(F.col("id"))
    digest = F.substring(F.sha2(F.concat_ws("/", "folder", "name", "id"), 256), 1, 16)
    options = placed.join(first, ["folder", "name"]).select(
        "id", "folder", F.explode(F.when(F.col("id") == F.col("_first"), F.array(
            F.struct(F.lit(0).alias("step"), F.col("name").alias("label")))).otherwise(F.array(
                F.struct(F.lit(1).alias("step"), appended(safe_name(F.substring("id", 1, 6))).alias("label")),
                F.struct(F.lit(2).alias("step"), appended(whole).alias("label")),
                F.struct(F.lit(3).alias("step"), appended(F.concat(whole, F.lit(" "), digest)).alias("label")),
            ))).alias("o")).select("id", "folder", "o.*")
    # a label that only one job could take, at any step, is free for it
    claims = options.groupBy("folder", "label").agg(F.count_distinct("id").alias("_claims"))
    free = (F.col("step") == 0) | (F.col("_claims") == 1) | (F.col("step") == 3)
    chosen = options.join(claims, ["folder", "label"]).where(free).groupBy("id", "folder").agg(
        F.min_by("label", "step").alias("label"))
    return chosen.select("id", "folder", F.concat("folder", F.lit("/"), "label", F.lit(".md")).alias("path"))
