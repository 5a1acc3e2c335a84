"""Activity clusters: media close in time and space, split where the pictures change."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.functions.timecode import parse_iso
from cinelake.operators.ordered import vector_breaks
from cinelake.operators.skew import salted_lookup
from cinelake.operators.timespace import SPACE_LIMIT_M, TIME_LIMIT_S, time_space_components

DAY_S = 86_400.0


def raw_activities(clips: DataFrame, time_s: float = TIME_LIMIT_S, space_m: float = SPACE_LIMIT_M) -> DataFrame:
    """(id, ts_s, lat, lon, activity) for clips with a time; `activity` is the smallest id of the cluster.

    clips: id, ts_s (seconds), lat, lon. A clip has a position only when both coordinates are there.
    """
    timed = clips.filter(F.col("ts_s").isNotNull()).select("id", "ts_s", "lat", "lon")
    rows, nodes = time_space_components(timed, "id", "ts_s", "lat", "lon", time_s, space_m)
    named = nodes.groupBy("component").agg(F.min("first_id").alias("activity"))
    lookup = nodes.join(named, "component").select("node", "n_rows", "activity")
    return salted_lookup(rows.select("id", "ts_s", "lat", "lon", "node"), lookup, ["node"], "n_rows").drop("node", "n_rows")


def refine_by_vectors(members: DataFrame, vectors: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Split each activity where two clips in a row have mean vectors further apart than the threshold.

    vectors: id, mean_vector. Adds `part`, from 0.
    """
    with_vectors = members.join(vectors.select("id", "mean_vector"), "id", "left")
    cut = with_vectors.withColumn("__day", F.floor(F.col("ts_s") / DAY_S).cast("bigint"))
    out = vector_breaks(cut, ["activity"], "__day", ["ts_s", "id"], "mean_vector", threshold, "part")
    return out.drop("__day", "mean_vector")


def envelopes(members: DataFrame, keys: tuple[str, ...] = ("activity",)) -> DataFrame:
    """Time range, mean position and size of each cluster. Latitude and longitude are averaged on their own."""
    return members.groupBy(*keys).agg(
        F.min("ts_s").alias("time_start_s"), F.max("ts_s").alias("time_end_s"), F.avg("lat").alias("gps_center_lat"),
        F.avg("lon").alias("gps_center_lon"), F.count("*").alias("n_clips"), F.min("id").alias("first_id"),
    )


def cluster_activities(clips: DataFrame, vectors: DataFrame | None = None, time_s: float = TIME_LIMIT_S, space_m: float = SPACE_LIMIT_M, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(members, clusters). A cluster's id is a hash of its smallest member id, the same on every run.

    Members stay rows (cluster_id, id, ts_s, ...): ordered by (ts_s, id) they are the cluster's clip list.
    """
    members = raw_activities(clips, time_s, space_m)
    if vectors is None:
        members = members.withColumn("part", F.lit(0).cast("bigint"))
    else:
        members = refine_by_vectors(members, vectors, threshold)
    clusters = envelopes(members, ("activity", "part")).withColumn("cluster_id", F.sha2(F.col("first_id").cast("string"), 256))
    labelled = salted_lookup(members, clusters.select("activity", "part", "cluster_id", "n_clips"), ["activity", "part"], "n_clips")
    return labelled.drop("n_clips", "activity", "part"), clusters.drop("activity", "part")


def merge_clusters(clusters: DataFrame, members: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge the clusters named in each request.

    clusters: cluster_id, time_start, time_end (ISO texts), ...; members: cluster_id, pos, media_id; requests:
    request_id, pos, cluster_id. The survivor has the most clips, the first in the request on ties; it takes all
    clips in request order without repeats and the widest time range, and keeps its own label and position.
    Times are compared as points in time; missing and empty ones are skipped. Requests with fewer than two ids, an unknown one or a
    time that cannot be read are rejected. Returns (merged, rejects); merged rows are
    (request_id, survivor_id, time_start, time_end, clips as rows via `merged_members`).
    """
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n_clips"))
    known = clusters.select("cluster_id", "time_start", "time_end").join(sizes, "cluster_id", "left").fillna(0, ["n_clips"])
    asked = requests.join(known.withColumn("__known", F.lit(True)), "cluster_id", "left")
    agg = asked.groupBy("request_id").agg(
        F.count("*").alias("n_ids"), F.count_if(F.col("__known").isNull()).alias("n_unknown"),
        F.max_by("cluster_id", F.struct(F.col("n_clips").alias("n"), (-F.col("pos")).alias("p"))).alias("survivor_id"),
        F.min_by("time_start", parse_iso(F.col("time_start"))).alias("time_start"), F.max_by("time_end", parse_iso(F.col("time_end"))).alias("time_end"),
        F.count_if((F.coalesce("time_start", F.lit("")) != "") & parse_iso(F.col("time_start")).isNull() | (F.coalesce("time_end", F.lit("")) != "") & parse_iso(F.col("time_end")).isNull()).alias("n_unread"),
    )
    fine = (F.col("n_ids") >= 2) & (F.col("n_unknown") == 0) & (F.col("n_unread") == 0)
    reason = F.when(F.col("n_ids") < 2, "at least 2 cluster ids required").when(F.col("n_unknown") > 0, "unknown cluster id").otherwise("unreadable time")
    merged = agg.filter(fine).select("request_id", "survivor_id", "time_start", "time_end")
    return merged, agg.filter(~fine).select("request_id", reason.alias("reason"))


def merged_members(members: DataFrame, requests: DataFrame, merged: DataFrame) -> DataFrame:
    """(survivor_id, media_id, place): the clips of a merged cluster, each at its first place."""
    part = requests.join(merged.select("request_id", "survivor_id"), "request_id").select("survivor_id", "cluster_id", F.col("pos").alias("__r"))
    return members.join(part, "cluster_id").groupBy("survivor_id", "media_id").agg(
        F.min(F.struct(F.col("__r").alias("request_pos"), F.col("pos").alias("pos"))).alias("place")
    )
