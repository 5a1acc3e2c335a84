"""Catalog-shaped views over the given tables. The same SQL runs in Spark and in the checking engine."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    "media": """select doc_id as media_id, concat(source,'/',lang,'/',cast(doc_id as string),'.mp4') as file_path, text as content,
        30.0E0 as fps, n_chars/10.0E0 as duration_seconds, case when doc_id % 7 = 0 then 'analyzed' else 'ingested' end as status from documents""",
    "segments": """select conv_id as media_id, turn as pos, turn*12.0E0 as start_s, turn*12.0E0 + 4 + length(text) % 12 as end_s, text,
        role as speaker from conversations""",
    "shots": """select conv_id as media_id, turn as shot_pos, turn*25.0E0 as start_s, (turn+1)*25.0E0 as end_s from conversations""",
    "captions": """select conv_id as media_id, turn*17.0E0 as start_s, turn*17.0E0 + 20 as end_s, text as caption from conversations
        where role = 'assistant'""",
    "audio_events": """select user_id % 100 as media_id, cast(event_id % 100 as double) as ts_s, event_type as class, value as probability,
        event_id as pos from events""",
    "detections": """select user_id as media_id, cast(3*(extract(day from ts)-1) as bigint) as frame_number,
        cast(case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 when 'signup' then 4 end as bigint) as track_id,
        event_type as class, value as cx, value*2 as cy, 10.0E0 + event_id % 7 as w, 20.0E0 as h, value as confidence, event_id as pos
        from events""",
    "faces": """select user_id as media_id, cast(30*(extract(day from ts)-1) as bigint) as frame_number, event_id as face_index,
        case when event_type = 'error' then null else event_id % 7 end as cluster_id from events""",
    "face_clusters": """select cast(r_regionkey as bigint) as cluster_id, case when r_regionkey % 2 = 0 then r_name end as label from region""",
    "activities": """select event_id as id, ts, case when event_type = 'error' then null else 18.0E0 + (user_id % 5)*0.01E0 end as lat,
        case when event_type = 'error' then null else 98.0E0 end as lon from events""",
    "vectors": """select label as media_id, vec_id as frame_number, embedding from embeddings""",
    "narratives": """select o_orderkey as narrative_id, concat('n', cast(o_orderkey as string)) as title, 10.0E0 + o_orderkey % 90 as target_s,
        case o_orderstatus when 'F' then 'approved' when 'O' then 'proposed' else 'rejected' end as status from orders""",
    "plan_clips": """select l_orderkey as narrative_id, cast(l_linenumber % 2 + 1 as bigint) as track, l_partkey as clip_id, l_quantity as in_s,
        l_quantity + 1 + l_discount*100 as out_s, 2 - l_tax*400 as level_db, l_suppkey as pos from lineitem""",
    "clip_media": """select p_partkey as clip_id, cast(p_size as double) as duration_seconds from part where p_brand <> 'Brand#7'""",
    "jobs": """select event_id as job_id, user_id % 9 as stage, case event_type when 'error' then 'error' when 'click' then 'running'
        when 'view' then 'pending' else 'done' end as status, cast(extract(day from ts) as bigint) as run_id, value as duration_seconds from events""",
    "queue": """select user_id as group_id, case event_type when 'error' then 'dead' when 'click' then 'retry' when 'view' then 'pending'
        when 'signup' then 'in_flight' else 'completed' end as status, ts as created_at from events""",
    "rendered": """select o_orderkey as narrative_id from orders where o_orderstatus in ('F','O')""",
    "uploaded": """select o_orderkey as narrative_id, o_orderdate as uploaded_at from orders where o_orderstatus = 'F'""",
    # Clusters are nations; every document is a clip of one of them.
    "members": """select concat('c', cast(doc_id % 25 as string)) as cluster_id, cast(floor(doc_id/25) as bigint) as pos, doc_id as media_id
        from documents""",
    "clusters": """select concat('c', cast(n_nationkey as string)) as cluster_id, case n_regionkey when 0 then null when 1 then '' else n_name end as label,
        case when n_regionkey = 2 then null else concat('about ', n_name) end as description, n_regionkey = 4 as excluded,
        concat('2024-01-', lpad(cast(n_nationkey + 1 as string), 2, '0')) as time_start, concat('2024-02-', lpad(cast(n_nationkey + 1 as string), 2, '0')) as time_end
        from nation""",
    # What a narrative lists: two clusters, one that does not exist, or text that is no list.
    "plans_of": """select o_orderkey as narrative_id, case o_orderstatus when 'P' then 'broken[' else
        concat('["c', cast(o_custkey % 25 as string), '", "c', cast(o_orderkey % 40 as string), '"]') end as cluster_ids_json from orders""",
    "scripts": """select o_orderkey as narrative_id, concat('{"scenes": [{"narration": "', o_orderpriority, '"}, {"title": "x"}, {"narration": "',
        o_orderstatus, '"}]}') as script_json from orders where o_orderstatus <> 'P'""",
    "edit_plans": """select o_orderkey as narrative_id, case o_orderstatus when 'P' then '' else '{}' end as edl_json,
        case when o_orderstatus in ('F','O') then concat('r/', cast(o_orderkey as string)) else '' end as render_path from orders where o_orderpriority <> '5-LOW'""",
    "gates": """select distinct user_id % 9 as stage, case user_id % 3 when 0 then 'auto' when 1 then 'notify' else 'pause' end as mode from events""",
}


def _sql_for(name: str, sql: str, done: list[str]) -> None:
    for view in VIEWS:
        if view not in done and view != name and re.search(rf"\b{view}\b", sql):
            _sql_for(view, VIEWS[view], done)
            if view not in done:
                done.append(view)


def with_views(sql: str) -> str:
    """A query with the views it names put in front."""
    needed: list[str] = []
    _sql_for("", sql, needed)
    heads = ", ".join(f"{v} as ({VIEWS[v]})" for v in needed)
    body = sql.strip()
    match = re.match(r"with\s+(recursive\s+)?", body, re.IGNORECASE)
    if not needed:
        return body
    if match:
        return f"with {match.group(1) or ''}{heads}, {body[match.end():]}"
    return f"with {heads} {body}"


class Catalog:
    """The tables of one folder and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, sql: str) -> DataFrame:
        used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
        sql = sql.replace("{", "{{").replace("}", "}}")
        for t in used:
            sql = re.sub(rf"\b(from|join)\s+{t}\b", rf"\1 {{{t}}}", sql)
        return self.spark.sql(sql, **{t: self.table(t) for t in used})

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @cached_property
    def boxes(self) -> DataFrame:
        """Detections with their box as an array."""
        from pyspark.sql import functions as F

        return self.detections.withColumn("bbox_xywh", F.array("cx", "cy", "w", "h"))
