"""Catalog joins: flags, worklists, titles, references that do not resolve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def with_titles(plans: DataFrame, narratives: DataFrame) -> DataFrame:
    """Plans or uploads with their narrative's title; an orphan keeps a null title."""
    return plans.join(narratives.select("narrative_id", "title"), "narrative_id", "left")


def scripted_narratives(narratives: DataFrame, scripts: DataFrame) -> DataFrame:
    return narratives.join(scripts, "narrative_id")


def with_flags(media: DataFrame, signals: dict[str, DataFrame], key: str) -> DataFrame:
    """A boolean column per signal table. Keys are made distinct first, so rows never multiply."""
    out = media
    for name, table in signals.items():
        present = table.select(key).distinct().withColumn(name, F.lit(True))
        out = out.join(present, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def pending_work(
    entities: DataFrame, done: DataFrame, keys: Sequence[str], required: Sequence[DataFrame] = (), force: bool = False
) -> DataFrame:
    """Entities with every prerequisite and no result yet; `force` ignores the results."""
    out = entities
    for table in required:
        out = out.join(table.select(*keys).distinct(), list(keys), "left_semi")
    return out if force else out.join(done.select(*keys).distinct(), list(keys), "left_anti")


def in_listed_order(owners: DataFrame, owner: str, ids: str, members: DataFrame, member: str) -> DataFrame:
    """Explode a list of ids and join the members, keeping the place as `pos`; ids without a member drop out."""
    listed = owners.select(owner, F.posexplode(ids).alias("pos", member))
    return listed.join(members, member)


def face_label(cluster_id: Column, label: Column) -> Column:
    """A person's label, else `Face #n`. An empty label counts as none."""
    return F.coalesce(F.when(label != "", label), F.concat(F.lit("Face #"), cluster_id.cast("string")))


def with_face_labels(faces: DataFrame, clusters: DataFrame) -> DataFrame:
    named = clusters.select("cluster_id", F.col("label").alias("__label"))
    return faces.join(named, "cluster_id", "left").withColumn("person", face_label(F.col("cluster_id"), F.col("__label"))).drop("__label")


def unresolved(references: DataFrame, catalog: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct references the catalog does not hold."""
    return references.select(*keys).distinct().join(catalog.select(*keys), list(keys), "left_anti")


def not_uploaded(plans: DataFrame, uploads: DataFrame) -> DataFrame:
    """Rendered plans without an upload; an empty render path means not rendered."""
    rendered = plans.filter(F.coalesce(F.col("render_path"), F.lit("")) != "")
    return rendered.join(uploads.select("narrative_id"), "narrative_id", "left_anti")


def review_decisions(proposals: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """Proposals with their new status: listed ones approved, others rejected; all approved when nobody decided."""
    if decisions is None:
        return proposals.withColumn("status", F.lit("approved"))
    chosen = decisions.select("narrative_id").distinct().withColumn("__yes", F.lit(True))
    status = F.when(F.col("__yes"), "approved").otherwise("rejected")
    return proposals.join(chosen, "narrative_id", "left").withColumn("status", status).drop("__yes")
