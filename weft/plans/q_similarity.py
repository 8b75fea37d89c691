"""Catalog entries: retrieval, consolidation, majority vote."""

from pyspark.sql import functions as F

from weft.operators import similarity as sim
from weft.plans.catalog import query

CENTROIDS_SQL = """x AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding) AS v FROM embeddings),
c AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS v FROM x GROUP BY label, pos),
q AS (SELECT label AS query_id, list(v ORDER BY pos) AS qv FROM c GROUP BY label),
qn AS (SELECT query_id, list_transform(qv, lambda v: v / sqrt(list_reduce(list_transform(qv, lambda t: t * t),
                                                   lambda acc, t: acc + t, 0.0))) AS qv FROM q),
s AS (SELECT qn.query_id, e.vec_id,
             list_reduce(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), qn.qv), lambda t: t[1] * t[2]),
                         lambda acc, t: acc + t, 0.0) AS s
      FROM embeddings e, qn)"""


def _topk(m, threshold):
    emb = m.raw("embeddings")
    qs = sim.label_centroids(emb).select(F.col("label").alias("qid"), F.col("centroid").alias("qvec"))
    return sim.vector_topk(emb, qs, k=10, threshold=threshold)


TOPK_SQL = """WITH {ctes}
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, CAST(s AS DECIMAL(18,6)) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank
  FROM s {where}) WHERE rank <= 10"""


@query("vector_topk", TOPK_SQL.format(ctes=CENTROIDS_SQL, where="WHERE s >= 0.7"))
def q_vector_topk(m):
    """J10 with the declared cut-off 0.7; queries are the label centroids."""
    return _topk(m, sim.SIMILARITY_THRESHOLD)


@query("vector_topk_uncut", TOPK_SQL.format(ctes=CENTROIDS_SQL, where=""))
def q_vector_topk_uncut(m):
    """J10 without a cut-off (plain top-k per query)."""
    return _topk(m, None)


@query("consolidate_near_duplicates", """
WITH p AS (
  SELECT b.vec_id AS vec_id, min(a.vec_id) AS partner
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE list_reduce(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])),
                                   lambda t: t[1] * t[2]), lambda acc, t: acc + t, 0.0) >= 0.95
  GROUP BY b.vec_id)
SELECT e.vec_id, least(e.vec_id, coalesce(p.partner, e.vec_id)) AS canonical_id
FROM embeddings e LEFT JOIN p ON e.vec_id = p.vec_id""")
def q_consolidate(m):
    """J11 (exact copies + LSH candidates + exact check). The oracle is
    brute force over all pairs, affordable only at small scale."""
    return sim.consolidate_near_duplicates(m.raw("embeddings"))


@query("consolidate_heads", """
WITH h AS (
  SELECT vec_id, list_transform(v, lambda x: x / n) AS head FROM (
    SELECT vec_id, v, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3] + v[4] * v[4]) AS n
    FROM (SELECT vec_id, CAST(embedding[1:4] AS DOUBLE[]) AS v FROM embeddings))),
p AS (
  SELECT b.vec_id AS vec_id, min(a.vec_id) AS partner FROM h a JOIN h b ON a.vec_id < b.vec_id
  WHERE a.head[1] * b.head[1] + a.head[2] * b.head[2] + a.head[3] * b.head[3] + a.head[4] * b.head[4] >= 0.95
  GROUP BY b.vec_id)
SELECT h.vec_id, least(h.vec_id, coalesce(p.partner, h.vec_id)) AS canonical_id
FROM h LEFT JOIN p ON h.vec_id = p.vec_id""")
def q_consolidate_heads(m):
    """J11 on the unit vectors of the first four dimensions, where many
    vectors do merge."""
    v = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    e = m.raw("embeddings").select("vec_id", v.alias("v"))
    norm = F.sqrt(sum((F.col("v")[i] * F.col("v")[i] for i in range(1, 4)), F.col("v")[0] * F.col("v")[0]))
    return sim.consolidate_near_duplicates(e.select("vec_id", F.transform("v", lambda x: x / norm).alias("embedding")))


@query("consolidate_planted", """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  UNION ALL SELECT vec_id + 1000000, list_concat([-CAST(embedding[1] AS DOUBLE)], CAST(embedding[2:] AS DOUBLE[])) FROM embeddings
  UNION ALL SELECT vec_id + 2000000, CAST(embedding AS DOUBLE[]) FROM embeddings),
p AS (
  SELECT b.vec_id AS vec_id, min(a.vec_id) AS partner FROM v a JOIN v b ON a.vec_id < b.vec_id
  WHERE list_dot_product(a.e, b.e) >= 0.95 GROUP BY b.vec_id)
SELECT v.vec_id, least(v.vec_id, coalesce(p.partner, v.vec_id)) AS canonical_id FROM v LEFT JOIN p ON v.vec_id = p.vec_id""")
def q_consolidate_planted(m):
    """J11 on whole vectors: each given one, a copy with one dimension turned
    round (near where that dimension is small) and an exact copy."""
    e = m.raw("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    turned = F.transform("embedding", lambda x, i: F.when(i == 0, -x).otherwise(x))
    planted = e.select((F.col("vec_id") + 1_000_000).alias("vec_id"), turned.alias("embedding")).unionByName(
        e.select((F.col("vec_id") + 2_000_000).alias("vec_id"), "embedding"))
    return sim.consolidate_near_duplicates(e.unionByName(planted))


@query("majority_vote", """
SELECT source, arg_max(quality, struct_pack(votes := votes, neg := -quality)) AS quality,
       max(votes) AS votes
FROM (SELECT d.source, l.quality, count(*) AS votes
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.source, l.quality)
GROUP BY source""")
def q_majority_vote(m):
    """Majority quality label per document source."""
    lab = m.raw("labels").join(m.raw("documents").select("doc_id", "source"), "doc_id")
    return sim.majority_vote(lab, "source", "quality")


@query("neighbor_label_vote", TOPK_SQL.format(ctes=CENTROIDS_SQL, where="").replace(
    "SELECT query_id, rank, vec_id, score FROM (", """SELECT query_id, arg_max(label, struct_pack(votes := votes, neg := -label)) AS label,
       max(votes) AS votes FROM (
  SELECT t.query_id, e.label, count(*) AS votes FROM (
SELECT query_id, rank, vec_id, score FROM (""", 1) + """) t JOIN embeddings e ON t.vec_id = e.vec_id
  GROUP BY t.query_id, e.label) GROUP BY query_id""")
def q_neighbor_label_vote(m):
    """A18 over J10: majority label of each query's 10 nearest vectors."""
    emb = m.raw("embeddings")
    top = _topk(m, None)
    lab = top.join(emb.select("vec_id", "label"), "vec_id")
    return sim.majority_vote(lab, "query_id", "label")
