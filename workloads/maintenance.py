"""Table maintenance: the resulting table is what is checked."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cinelake.operators import maintenance, relations
from cinelake.session import ensure_checkpoint_dir
from cinelake.sources import documents
from cinelake.sources.tables import CatalogTables
from workloads.registry import query
from workloads.views import Catalog


def _scratch(c: Catalog) -> CatalogTables:
    return CatalogTables(c.spark, f"{ensure_checkpoint_dir(c.spark)}/tables/{uuid.uuid4().hex}")


@query("src04_catalog_tables", """select cast(media_id as varchar) as id, file_path, coalesce(case status when 'analyzed' then 'analyzed' end, 'ingested') as status, duration_seconds from media""")
def catalog_tables(c: Catalog):
    tables = _scratch(c)
    rows = c.media.select(F.col("media_id").cast("string").alias("id"), "file_path", "duration_seconds", F.when(F.col("status") == "analyzed", "analyzed").alias("status"))
    tables.append("media_files", rows)
    return tables.read("media_files").select("id", "file_path", "status", "duration_seconds")


@query("src05_append", "select event_id, event_type, user_id from events")
def append(c: Catalog):
    rows = c.events.select("event_id", "event_type", "user_id")
    return maintenance.append_rows(rows.filter("event_type <> 'signup'"), rows.filter("event_type = 'signup'"), ["event_id"])


@query("src05_key_conflicts", """select l_orderkey, 'repeated' as reason from lineitem group by 1 having count(*) > 1 union all select distinct l_orderkey, 'taken' from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')""")
def conflicts(c: Catalog):
    target = c.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return maintenance.key_conflicts(target, c.lineitem.select("l_orderkey"), ["l_orderkey"])


LATEST = "latest as (select narrative_id, arg_max([in_s, level_db], [pos, clip_id, in_s, level_db, out_s]) as r from plan_clips group by narrative_id)"


@query("src06_upsert_replace", f"""with {LATEST} select narrative_id, coalesce(r[1], target_s) as target_s, case when r is null then status else 'replaced' end as status from narratives left join latest using (narrative_id)
    union all select narrative_id, r[1], 'replaced' from latest where narrative_id not in (select narrative_id from narratives)""")
def upsert(c: Catalog):
    source = c.plan_clips.select("narrative_id", F.col("in_s").alias("target_s"), F.lit("replaced").alias("status"), F.struct("pos", "clip_id", "in_s", "level_db", "out_s").alias("at"))
    return maintenance.upsert_replace(c.narratives.select("narrative_id", "target_s", "status"), source, ["narrative_id"], "at")


@query("src07_upsert_merge", """select doc_id, case when l.doc_id is not null then coalesce(case when toxic = 1 then 'toxic' end, lang) else lang end as lang, coalesce(quality, -1) as quality from documents left join labels l using (doc_id)""")
def merge(c: Catalog):
    target = c.documents.select("doc_id", "lang", F.lit(-1).alias("quality"))
    source = c.labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("lang"), "quality")
    return maintenance.upsert_merge(target, source, ["doc_id"])


@query("src08_insert_if_absent", "select doc_id, quality from labels union all select doc_id, -1 from documents where doc_id not in (select doc_id from labels)")
def insert_absent(c: Catalog):
    return maintenance.insert_if_absent(c.labels.select("doc_id", "quality"), c.documents.select("doc_id", F.lit(-1).alias("quality")), ["doc_id"])


@query("src09_keyed_update", "select narrative_id, case when u.narrative_id is null then title when date_part('year', uploaded_at) < 1998 then '(cleared)' else 'uploaded' end as title, status from narratives left join uploaded u using (narrative_id)")
def update(c: Catalog):
    patch = c.uploaded.select("narrative_id", F.when(F.year("uploaded_at") >= 1998, "uploaded").alias("title"))
    out = maintenance.keyed_update(c.narratives.select("narrative_id", "title", "status"), patch, ["narrative_id"], maintenance.UPDATABLE["narratives"])
    return out.withColumn("title", F.coalesce("title", F.lit("(cleared)")))


@query("src09_affected_rows", "select count(*) as affected from narratives where narrative_id in (select narrative_id from plan_clips)")
def affected(c: Catalog):
    return maintenance.affected_rows(c.narratives, c.plan_clips.select("narrative_id"), ["narrative_id"])


@query("src10_keyed_delete", "select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def delete(c: Catalog):
    return maintenance.keyed_delete(c.documents.select("doc_id", "lang"), c.labels, ["doc_id"])


@query("src10_replace_all", "select cast(media_id as varchar) as media_id, start_s as start_time, end_s as end_time, caption from captions")
def replace_all(c: Catalog):
    tables = _scratch(c)
    rows = c.captions.select(F.col("media_id").cast("string").alias("media_id"), F.col("start_s").alias("start_time"), F.col("end_s").alias("end_time"), "caption")
    tables.replace_all("captions", rows.withColumn("caption", F.upper("caption")))
    tables.replace_all("captions", rows)
    return tables.read("captions").select("media_id", "start_time", "end_time", "caption")


@query("src11_evolve", "select cluster_id, label, false as reviewed, nullif(label, '') as shown from clusters")
def evolve(c: Catalog):
    rows = c.clusters.select("cluster_id", "label", F.nullif("label", F.lit("")).alias("shown"))
    once = maintenance.evolve(maintenance.evolve(rows, "reviewed", "boolean", False), "shown", "string", "none")
    return maintenance.evolve(once, "reviewed", "boolean", True)


@query("src_reference_rejects", "select distinct media_id from segments where media_id not in (select doc_id from labels)")
def rejects(c: Catalog):
    return maintenance.orphans(c.segments, "media_id", c.labels, "doc_id").select("media_id").distinct()


@query("udf05_review_decisions", "select narrative_id, case when narrative_id in (select narrative_id from uploaded) then 'approved' else 'rejected' end as status from narratives")
def decisions(c: Catalog):
    return relations.review_decisions(c.narratives.select("narrative_id"), c.uploaded.select("narrative_id"))


@query("src13_written_lines", "select event_type, 'event ' || event_id || ' of user ' || user_id as line from events union all select event_type, '' from events where event_id % 100 = 0")
def written_lines(c: Catalog):
    """Documents written line by line, and read again."""
    folder = f"{ensure_checkpoint_dir(c.spark)}/documents/{uuid.uuid4().hex}"
    line = F.concat(F.lit("event "), F.col("event_id"), F.lit(" of user "), F.col("user_id"))
    lines = c.events.select("event_type", "event_id", F.lit(0).alias("part"), line.alias("line"))
    breaks = c.events.filter("event_id % 100 = 0").select("event_type", "event_id", F.lit(1).alias("part"), F.lit("").alias("line"))
    documents.write_lines(lines.unionByName(breaks), "event_type", ["event_id", "part"], "line", folder)
    return c.spark.read.text(folder).select("event_type", F.col("value").alias("line"))
