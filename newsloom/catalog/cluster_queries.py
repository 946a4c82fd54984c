"""Embedding, neighbour search and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.catalog.base import Tables, query
from newsloom.functions.numbers import norm
from newsloom.operators.approximate import recall_of
from newsloom.operators.neighbours import knn
from newsloom.plans.cluster import cluster_categories, density_cluster
from newsloom.plans.embed import embed_hashed, embed_with, reduce_dimensions

EPS, SAMPLES, SIZE = 1.29, 6, 8


def letter_model(texts: list[str]) -> list[list[float]]:
    return [[float(len(x)), float(x.count("e")), float(x.count(" "))] for x in texts]


@query("emb1_model_batches", """SELECT doc_id, CAST(length(text) AS DOUBLE) AS d0,
 CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS d1,
 CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS d2 FROM documents""")
def _(t: Tables):
    scored = embed_with(t.raw("documents"), "text", letter_model)
    return scored.select("doc_id", *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(3)])


@query("emb1_hashed_terms", r"""SELECT doc_id, CAST(256 AS INT) AS dims,
 CASE WHEN regexp_matches(text, '[\p{L}\p{N}_]{2}') THEN 1.0 ELSE 0.0 END AS length FROM documents""")
def _(t: Tables):
    scored = embed_hashed(t.raw("documents"), "text")
    return scored.select("doc_id", F.size("embedding").alias("dims"), F.round(norm(F.col("embedding")), 3).alias("length"))


@query("clu1_reduced_vectors", "SELECT vec_id, CAST(15 AS INT) AS dims FROM embeddings")
def _(t: Tables):
    return reduce_dimensions(t.raw("embeddings")).select("vec_id", F.size("reduced").alias("dims"))


SQL_PAIRS = """pairs AS (SELECT a.label, a.vec_id, b.vec_id AS neighbour,
 list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
 FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
 near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS rank FROM pairs)"""


@query("clu2_nearest_neighbours", f"WITH {SQL_PAIRS} SELECT label, vec_id, neighbour, round(d, 6) AS distance, rank FROM near "
       f"WHERE rank <= {SAMPLES}")
def _(t: Tables):
    found = knn(t.raw("embeddings"), SAMPLES, "label", key="vec_id")
    return found.select(
        "label", "vec_id", "neighbour", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank")
    )


@query("clu2_approximate", f"WITH {SQL_PAIRS} SELECT label, count(*) AS neighbours, true AS found FROM near "
       f"WHERE rank <= {SAMPLES} GROUP BY label")
def _(t: Tables):
    # Neighbours of every vector by multi-probe hashing, held against the exact ones: at least nine in ten are found.
    exact = knn(t.raw("embeddings"), SAMPLES, "label", key="vec_id")
    near = knn(t.raw("embeddings"), SAMPLES, "label", key="vec_id", method="lsh", bucket=64, tables=12)
    found = recall_of(near, exact, "label", "vec_id")
    return found.select("label", F.col("n").alias("neighbours"), (F.col("recall") >= 0.9).alias("found"))


@query("join8_most_similar", f"WITH {SQL_PAIRS} SELECT label, vec_id, neighbour FROM near WHERE rank = 1")
def _(t: Tables):
    return knn(t.raw("embeddings"), 1, "label", key="vec_id").select("label", "vec_id", "neighbour")


SQL_CLUSTERS = f"""WITH RECURSIVE {SQL_PAIRS},
 core AS (SELECT label, vec_id FROM near WHERE rank = {SAMPLES} AND d <= {EPS}),
 edges AS (SELECT p.label, p.vec_id AS a, p.neighbour AS b FROM pairs p JOIN core x ON x.vec_id = p.vec_id
   JOIN core y ON y.vec_id = p.neighbour WHERE p.d <= {EPS}),
 reach(label, vec_id, seen) AS (SELECT label, vec_id, vec_id FROM core UNION
   SELECT r.label, r.vec_id, e.b FROM reach r JOIN edges e ON e.a = r.seen),
 comp AS (SELECT label, vec_id, min(seen) AS root FROM reach GROUP BY 1, 2),
 sized AS (SELECT label, root, count(*) AS n FROM comp GROUP BY 1, 2),
 ids AS (SELECT label, root, row_number() OVER (PARTITION BY label ORDER BY root) - 1 AS cluster_id FROM sized WHERE n >= {SIZE})
 SELECT e.label, e.vec_id, coalesce(i.cluster_id, -1) AS cluster_id FROM embeddings e LEFT JOIN comp c ON c.vec_id = e.vec_id
 LEFT JOIN ids i ON i.label = c.label AND i.root = c.root"""


@query("clu3_density_clusters", SQL_CLUSTERS)
def _(t: Tables):
    return density_cluster(
        t.raw("embeddings"), "label", eps=EPS, min_samples=SAMPLES, min_cluster_size=SIZE, key="vec_id"
    )


@query("clu5_all_categories", SQL_CLUSTERS.replace(
    "SELECT e.label, e.vec_id,", "SELECT CAST(e.label AS VARCHAR) AS political_category, e.vec_id AS id,"
) + " WHERE e.label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 30)")
def _(t: Tables):
    articles = t.raw("embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("political_category"), "embedding"
    )
    return cluster_categories(articles, reduce=False, eps=EPS, min_samples=SAMPLES, min_cluster_size=SIZE)
