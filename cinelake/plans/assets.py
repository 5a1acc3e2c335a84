"""Music, voice-over and b-roll a plan asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.functions.checks import asset_priority, asset_sources
from cinelake.operators.topk import top_k
from cinelake.plans.edit_plans import explode_edl
from cinelake.sources.documents import FETCH_LIST_HEAD, fetch_list_line

# Plan list -> (kind shown, column that describes the request), in the order requests are made.
KINDS = {"music": ("Music", "mood"), "voiceovers": ("Voiceover", "text"), "broll_requests": ("B-Roll", "description")}


def asset_requests(plans: DataFrame) -> DataFrame:
    """(narrative_id, kind_pos, pos, kind, description, start_time, duration)."""
    out = None
    for i, (part, (kind, column)) in enumerate(KINDS.items()):
        rows = explode_edl(plans, part).select(
            "narrative_id", F.lit(i).alias("kind_pos"), "pos", F.lit(kind).alias("kind"), F.coalesce(column, F.lit("")).alias("description"),
            F.coalesce("start_time", F.lit("00:00:00.000")).alias("start_time"), F.coalesce("duration", F.lit(0.0)).alias("duration"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def resolve_assets(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """Requests with the path found for them, null where there is none. resolved: narrative_id, kind, pos, path.

    Found paths compress so well that Spark may take millions of them for a small table and broadcast them, so a merge join is asked for.
    """
    return requests.join(resolved.withColumnRenamed("path", "resolved_path").hint("merge"), ["narrative_id", "kind", "pos"], "left")


def fetch_list(requests: DataFrame) -> DataFrame:
    """Unresolved requests with where to look and how urgent they are."""
    open_ones = requests.filter("resolved_path is null") if "resolved_path" in requests.columns else requests
    return open_ones.withColumns({"sources": asset_sources(F.col("kind")), "priority": asset_priority(F.col("kind"), F.col("duration"))})


def fetch_list_lines(requests: DataFrame) -> DataFrame:
    """(narrative_id, kind_pos, pos, line): the Markdown list, its head first (kind_pos -1)."""
    rows = fetch_list(requests).select("narrative_id", "kind_pos", "pos", fetch_list_line(F.col("kind"), F.col("description"), F.col("start_time"), F.col("duration")).alias("line"))
    head = F.array(*[F.lit(x) for x in FETCH_LIST_HEAD])
    heads = rows.select("narrative_id").distinct().select("narrative_id", F.lit(-1).alias("kind_pos"), F.posexplode(head).alias("pos", "line"))
    return heads.withColumn("pos", F.col("pos").cast("bigint")).unionByName(rows)


def best_variant(files: DataFrame) -> DataFrame:
    """The file to take per asset: HD first, then the widest; a missing width is 0, the first listed wins ties."""
    hd = F.coalesce(F.col("quality") == "hd", F.lit(False))
    return top_k(files, ["asset_id"], [hd.desc(), F.coalesce("width", F.lit(0)).desc(), F.col("pos").asc()], 1).drop("rank")
