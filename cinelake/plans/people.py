"""Face clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.functions.vectors import normalise
from cinelake.operators.cosine import cosine_clusters
from cinelake.operators.summaries import mean_vectors
from cinelake.operators.text import joined_in_order
from cinelake.operators.topk import top_k


def cluster_faces(faces: DataFrame, eps: float = 0.5, min_samples: int = 3, block_rows: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(faces with cluster_id, null for noise; clusters with unit centroid, up to five samples and size).

    faces: row_id (their order), media_id, frame_number, face_index, embedding.
    """
    known = faces.filter(F.col("embedding").isNotNull())
    labels = cosine_clusters(known, "row_id", "embedding", eps, min_samples, block_rows).withColumnRenamed("label", "cluster_id")
    labelled = faces.drop("cluster_id").join(labels, "row_id", "left")
    members = labelled.filter(F.col("cluster_id").isNotNull())
    centres = mean_vectors(members, ["cluster_id"], "embedding").select(
        "cluster_id", normalise(F.col("mean_vector")).alias("representative_embedding")
    )
    sample = F.concat_ws(":", F.col("media_id").cast("string"), F.col("frame_number").cast("string"))
    samples = top_k(members.select("cluster_id", "row_id", sample.alias("sample")), ["cluster_id"], [F.col("row_id").asc()], 5)
    listed = samples.groupBy("cluster_id").agg(joined_in_order(F.col("rank"), F.col("sample"), ",").alias("sample_image_paths"))
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("n_faces"))
    return labelled, centres.join(listed, "cluster_id").join(sizes, "cluster_id")
