"""Vectors: codecs, search, face clusters, user models."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from cinelake.functions.vectors import decode_vectors, encode_vectors
from cinelake.operators.scoring import score_batches, score_in_order
from cinelake.operators.vector_search import exact_top_k, recall
from cinelake.plans import people, search
from cinelake.session import cut_lineage, ensure_checkpoint_dir
from cinelake.sources.index_store import read_index, write_index
from workloads.registry import query
from workloads.views import Catalog


@query("src12_decode_vectors", "select vec_id, len(embedding)::bigint as n, round(list_sum(embedding::double[]), 5) as total from embeddings")
def decode(c: Catalog):
    back = c.embeddings.select("vec_id", decode_vectors(encode_vectors(F.col("embedding"))).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("vec_id", F.size("v").cast("bigint").alias("n"), F.round(total, 5).alias("total"))


#: Every row asks; all rows answer.
TOPK = """with q as (select vec_id as q, list_transform(embedding, lambda x: x::double / sqrt(list_inner_product(embedding::double[], embedding::double[]))) as v from embeddings),
    s as (select q, vec_id, list_inner_product(v, embedding::double[]) as score from q, embeddings)
    select q, vec_id, rank, round(score, 5) as score from (select *, row_number() over (partition by q order by score desc, vec_id) as rank from s) where rank <= 10"""


def _asking(c: Catalog):
    return c.embeddings.select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))


@query("top04_exact_search", TOPK)
def exact(c: Catalog):
    queries = _asking(c)
    return exact_top_k(c.embeddings, "vec_id", "embedding", queries, "q", "qv", 10).withColumn("score", F.round("score", 5))


@query("top05_inverted_lists")
def inverted(c: Catalog):
    """Recall of the approximate search through an index written to disk and read back: for 1 and 8 probes, and doubled until it reaches 0.9.

    Every row whose id is divisible by 100 asks; all rows are indexed."""
    queries = _asking(c).filter("q % 100 = 0")
    path = f"{ensure_checkpoint_dir(c.spark)}/index/{uuid.uuid4().hex}"
    indexed, centres = search.build_index(c.embeddings.select("vec_id", "embedding"), "embedding")
    write_index(indexed, centres, path)
    index = read_index(c.spark, path)
    truth = cut_lineage(search.search(c.embeddings, "vec_id", "embedding", queries, "q", "qv", 10))
    n_lists, nprobe, out = index[1].count(), 1, []
    while True:
        found = search.search(c.embeddings, "vec_id", "embedding", queries, "q", "qv", 10, index, nprobe)
        out.append((recall(truth, found, "q", "vec_id").first()[0], nprobe))
        if nprobe >= 8 and (out[-1][0] is None or out[-1][0] >= 0.9 or nprobe >= n_lists):
            return c.spark.createDataFrame(out, "recall double, nprobe int")
        nprobe = 8 if nprobe == 1 else 2 * nprobe


@query("top05_all_lists", TOPK)
def all_lists(c: Catalog):
    """Probing every list of the index finds what exact search finds."""
    queries = _asking(c)
    indexed, centres = search.build_index(c.embeddings.select("vec_id", "embedding"), "embedding")
    found = search.search(c.embeddings, "vec_id", "embedding", queries, "q", "qv", 10, (indexed, centres), nprobe=1_000_000)
    return found.select("q", "vec_id", "rank", F.round("score", 5).alias("score"))


FACES = """recursive v as (select vec_id as i, list_transform(embedding, lambda x: x::double / sqrt(list_inner_product(embedding::double[], embedding::double[]))) as u from embeddings),
    e as (select a.i as a, b.i as b from v a, v b where 1 - list_inner_product(a.u, b.u) <= 0.6 or a.i = b.i), core as (select a as i from e group by a having count(*) >= 3),
    ce as (select a, b from e where a in (select i from core) and b in (select i from core)), r as (select i, i as root from core union select ce.b, r.root from r join ce on ce.a = r.i),
    root as (select i, min(root) as root from r group by i), lab as (select i, dense_rank() over (order by root) - 1 as label from root),
    out as (select i, label from lab union all select e.a, min(lab.label) from e join lab on lab.i = e.b where e.a not in (select i from core) group by e.a)"""


@query("job17_face_clusters", f"with {FACES} select vec_id as row_id, coalesce(out.label, -1)::bigint as cluster_id from embeddings left join out on i = vec_id")
def face_clusters(c: Catalog):
    faces = c.embeddings.select(F.col("vec_id").alias("row_id"), F.col("label").alias("media_id"), F.col("vec_id").alias("frame_number"), F.lit(0).alias("face_index"), "embedding")
    labelled, _ = people.cluster_faces(faces, eps=0.6, min_samples=3)
    return labelled.select("row_id", F.coalesce("cluster_id", F.lit(-1).cast("bigint")).alias("cluster_id"))


@query("agg09_face_centroids", f"""with {FACES}, m as (select out.label as label, i, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as d from out join embeddings on i = vec_id), a as (select label, d, avg(x) as x from m group by all),
    c as (select label, list(x order by d) as v from a group by label), s as (select label, string_agg(k, ',' order by i) as samples from (select out.label, i, cast(embeddings.label as varchar) || ':' || cast(vec_id as varchar) as k, row_number() over (partition by out.label order by i) as rn from out join embeddings on i = vec_id) where rn <= 5 group by label)
    select label::bigint as cluster_id, samples as sample_image_paths, round(v[1] / sqrt(list_inner_product(v, v)), 5) as first_value, (select count(*) from out o where o.label = c.label) as n_faces from c join s using (label)""")
def centroids(c: Catalog):
    faces = c.embeddings.select(F.col("vec_id").alias("row_id"), F.col("label").alias("media_id"), F.col("vec_id").alias("frame_number"), F.lit(0).alias("face_index"), "embedding")
    _, clusters = people.cluster_faces(faces, eps=0.6, min_samples=3)
    return clusters.select("cluster_id", "sample_image_paths", F.round(F.col("representative_embedding")[0], 5).alias("first_value"), "n_faces")


def _length_model():
    return lambda pdf: pd.DataFrame({"doc_id": pdf["doc_id"], "n": pdf["text"].str.len().astype("int64")})


@query("udf01_score_batches", "select doc_id, length(text) as n from documents")
def batches(c: Catalog):
    return score_batches(c.documents.select("doc_id", "text"), _length_model, "doc_id bigint, n bigint", batch_rows=100)


def _running_model():
    seen = {"n": 0}

    def run(chunks):
        for pdf in chunks:
            places = range(seen["n"], seen["n"] + len(pdf))
            seen["n"] += len(pdf)
            yield pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "place": list(places)})

    return run


@query("udf02_score_in_order", "select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as place from events")
def in_order(c: Catalog):
    return score_in_order(c.events.select("user_id", "event_id"), "user_id", "event_id", _running_model, "user_id bigint, event_id bigint, place bigint")
