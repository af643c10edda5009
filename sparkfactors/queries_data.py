"""Registered queries over archives, lattices, wide values and reports of many labelings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .checkpoints import cut, scratch
from .operators import graph, lattice, linalg, models
from .operators.wide_pca import wide_pca
from .plans import experiments, factor_reports
from .queries import ARI, BYARI, CEN, EDGES, EXPR, FIT, LONG, NEAR, RUNS, SNEAR, SPOTS, SUP, edges_of, given_loadings, query, r6
from .sources import adapters as ad
from .sources import containers, stacking

# Archives: what the vectors hold, written as archives and read back by byte range.


def _archives(spark, sf):
    e = ad.table(spark, sf, "embeddings").select(F.col("vec_id").alias("spot_id"), F.col("label").cast("long").alias("domain_id"), F.transform("embedding", lambda v: v.cast("double")).alias("h"))
    folder = scratch(spark)
    containers.write_arrays(e.repartition(3, "spot_id"), folder)
    return folder


@query("npz_domain_scan", "SELECT vec_id AS spot_id, label::BIGINT AS domain_id FROM embeddings")
def _(spark, sf):
    folder = _archives(spark, sf)
    ids, labels = (containers.read_array(spark, folder, m, 200) for m in ("spot_id", "domain_id"))
    return ids.withColumnRenamed("value", "spot_id").join(labels.withColumnRenamed("value", "domain_id"), ["path", "row"]).select("spot_id", "domain_id")


@query("npz_matrix", "SELECT j - 1 AS j, round(sum(embedding[j]::DOUBLE), 6) AS total, round(sum(embedding[j]::DOUBLE * embedding[j]::DOUBLE), 6) AS squares FROM embeddings, range(1, 65) t(j) GROUP BY j")
def _(spark, sf):
    rows = containers.read_array(spark, _archives(spark, sf), "h", 150).select(F.posexplode("value").alias("j", "v"))
    return r6(rows.groupBy(F.col("j").cast("long").alias("j")).agg(F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares")), "total", "squares")


@query("gallery_labels", "SELECT name, label::BIGINT AS domain_id, count(*)::BIGINT AS n FROM embeddings, (VALUES ('first'), ('second')) v(name) GROUP BY name, label")
def _(spark, sf):
    e = ad.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("domain_id"))
    specs = []
    for name in ("first", "second"):
        folder = scratch(spark)
        # A run's folder holds one archive with its labels.
        containers.write_arrays(e.coalesce(1), folder)
        specs.append(f"{name}={folder}")
    return containers.gallery_labels(spark, specs).groupBy("name", "domain_id").agg(F.count("*").alias("n"))


# Lattices: vectors in rows of 16 on a hexagonal lattice, moved by up to a fifth of a step, with holes.
HEX = """hx AS (SELECT vec_id AS spot_id, vec_id % 4 AS section_id, vec_id // 4 // 16 AS "row", 2 * (vec_id // 4 % 16) + vec_id // 4 // 16 % 2 AS col FROM embeddings WHERE embedding[3] > -0.1),
st AS (SELECT * FROM (VALUES (-1, -1), (-1, 1), (0, -2), (0, 2), (1, -1), (1, 1)) o(dr, dc)),
hedge AS (SELECT a.spot_id AS src, b.spot_id AS dst FROM hx a, st JOIN hx b ON b.section_id = a.section_id AND b."row" = a."row" + dr AND b.col = a.col + dc)"""


def hex_spots(spark, sf):
    i = F.floor(F.col("vec_id") / 4)
    row = F.floor(i / 16)
    jitter = lambda k: F.least(F.greatest(F.get("embedding", k).cast("double"), F.lit(-1e0)), F.lit(1e0)) * 20
    e = ad.table(spark, sf, "embeddings").where(F.get("embedding", 2) > F.lit(-0.1).cast("float"))
    return e.select(F.col("vec_id").alias("spot_id"), (F.col("vec_id") % 4).alias("section_id"), (((i % 16) + (row % 2) / 2) * 100 + jitter(0)).alias("x"), (row * 100 * (3**0.5 / 2) + jitter(1)).alias("y"))


@query("grid_graph", f"WITH {HEX} SELECT src, dst FROM hedge")
def _(spark, sf):
    return lattice.spatial_graph(hex_spots(spark, sf), 6, pitch=100.0)


@query("grid_rings", f"WITH {HEX}, two AS (SELECT DISTINCT a.src, b.dst FROM hedge a JOIN hedge b ON a.dst = b.src WHERE a.src <> b.dst) SELECT src, dst, 1 AS ring FROM hedge UNION ALL SELECT src, dst, 2 FROM two ANTI JOIN hedge USING (src, dst)")
def _(spark, sf):
    return lattice.lattice_graph(lattice.lattice_keys(hex_spots(spark, sf), 100.0), 6, 2)


# The leading component: SQL turns a vector by the covariance until it rests.
LEAD = """cnt AS (SELECT count(DISTINCT spot_id)::DOUBLE AS n FROM sup), ids AS (SELECT DISTINCT spot_id FROM sup), gs AS (SELECT DISTINCT gene_id FROM sup),
full_ AS (SELECT spot_id, gene_id, coalesce(value, 0) AS v FROM ids CROSS JOIN gs LEFT JOIN sup USING (spot_id, gene_id)),
cen AS (SELECT spot_id, gene_id, v - avg(v) OVER (PARTITION BY gene_id) AS v, dense_rank() OVER (ORDER BY gene_id) AS g FROM full_),
cov AS (SELECT a.g AS i, b.g AS j, sum(a.v * b.v) AS c FROM cen a JOIN cen b USING (spot_id) GROUP BY 1, 2),
mat AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(c ORDER BY j) AS r FROM cov GROUP BY i) q),
turn AS (SELECT 0 AS k, list_transform(m, lambda r, i: 1e0 + i / 7e0) AS v FROM mat
  UNION ALL SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT k, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM turn, mat WHERE k < 3000) q),
last_ AS (SELECT v FROM turn WHERE k = 3000), dir AS (SELECT list_transform(v, lambda x: x * CASE WHEN list_max(v) < -list_min(v) THEN -1e0 ELSE 1e0 END) AS v FROM last_)"""


@query("pca_leading", f"WITH RECURSIVE {SUP}, {LEAD} SELECT spot_id, round(sum(c.v * d.v[c.g]), 3) AS score FROM cen c, dir d GROUP BY spot_id")
def _(spark, sf):
    x = ad.supplier_counts(spark, sf)
    got = wide_pca(x, x.select("spot_id").distinct(), 1, oversample=30)
    return got.scores.select(F.col("id").alias("spot_id"), F.round(F.get("h", 0), 3).alias("score"))


# Sections stacked: vectors as spots of sections, values in expr and, for odd sections, in raw.
STACKED = f"""{SPOTS}, st_ids AS (SELECT spot_id AS vec, section_id, row_number() OVER (ORDER BY section_id, spot_id) - 1 AS spot_id FROM spots)"""


def stacked(spark, sf):
    e = ad.table(spark, sf, "embeddings").select(F.concat(F.lit("s"), F.pmod("vec_id", F.lit(4))).alias("section"), F.col("vec_id").alias("local_id"), F.transform("embedding", lambda v: v.cast("double")).alias("h"))
    spots = e.select("section", "local_id", F.get("h", 0).alias("x"), F.get("h", 1).alias("y"))
    rows = e.select("section", "local_id", F.posexplode(F.slice("h", 3, 62)).alias("gene_id", "value")).where("value > 0").withColumn("gene_id", F.col("gene_id").cast("long"))
    raw = rows.where(F.col("section").isin("s1", "s3")).withColumn("value", F.col("value") * 100)
    return stacking.stack_tables(spots, rows, raw, n_neighs=6, coord_type="generic")


@query("stacked_values", f"WITH {STACKED}, {EXPR} SELECT i.spot_id, gene_id, round(value * CASE WHEN section_id % 2 = 1 THEN 100 ELSE 1 END, 6) AS value FROM expr JOIN st_ids i ON i.vec = expr.spot_id")
def _(spark, sf):
    return r6(stacked(spark, sf).expr, "value")


@query("stacked_graph", f"WITH {STACKED}, {SNEAR} SELECT a.spot_id AS src, b.spot_id AS dst FROM snear JOIN st_ids a ON a.vec = src JOIN st_ids b ON b.vec = dst")
def _(spark, sf):
    return stacked(spark, sf).edges


@query("stacked_sections", "SELECT vec_id % 4 AS section_id, 's' || vec_id % 4 AS section, count(*)::BIGINT AS n, vec_id % 2 = 1 AS used_raw FROM embeddings GROUP BY ALL")
def _(spark, sf):
    return stacked(spark, sf).sections


# Reports over many labelings: each method and seed against the truth, the seed as a dataset.
ACC = f"""{RUNS}, pairs AS (SELECT method, seed, e.label AS t, r.label AS p FROM runs r JOIN embeddings e ON vec_id = spot_id),
{BYARI.format(g='method, seed')}, tt AS (SELECT method, seed, t, sum(n) AS n FROM c GROUP BY ALL), pp AS (SELECT method, seed, p, sum(n) AS n FROM c GROUP BY ALL),
hh AS (SELECT method, seed, any_value(z.n) AS n, -sum(tt.n / z.n * ln(tt.n / z.n)) AS ht FROM tt JOIN z USING (method, seed) GROUP BY ALL),
hp AS (SELECT method, seed, -sum(pp.n / z.n * ln(pp.n / z.n)) AS hp FROM pp JOIN z USING (method, seed) GROUP BY ALL),
mi AS (SELECT method, seed, sum(c.n / z.n * ln(c.n * z.n / (tt.n * pp.n))) AS mi FROM c JOIN tt USING (method, seed, t) JOIN pp USING (method, seed, p) JOIN z USING (method, seed) GROUP BY ALL),
em AS (SELECT method, seed, sum(x / n * (ln(n) + ln(x) - ln(a) - ln(b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(a - x + 1) - lgamma(b - x + 1) - lgamma(n - a - b + x + 1))) AS emi
FROM (SELECT method, seed, tt.n AS a, pp.n AS b, z.n AS n, unnest(range(greatest(1, tt.n + pp.n - z.n)::BIGINT, least(tt.n, pp.n)::BIGINT + 1))::DOUBLE AS x FROM tt JOIN pp USING (method, seed) JOIN z USING (method, seed)) q GROUP BY ALL)"""


def run_pairs(spark, sf):
    e = ad.table(spark, sf, "embeddings").select(F.col("vec_id").alias("spot_id"), F.col("label").cast("long").alias("t"))
    r = ad.runs(spark, sf).join(e, "spot_id")
    return r.select(F.concat(F.lit("seed"), "seed").alias("dataset"), F.col("method").alias("variant"), "t", F.col("label").alias("p"))


@query("domain_accuracy", f"WITH {ACC} SELECT 'seed' || seed AS dataset, method AS variant, round({ARI}, 6) AS ari, round(mi / ((ht + hp) / 2), 6) AS nmi, round((mi - emi) / ((ht + hp) / 2 - emi), 6) AS ami FROM s JOIN hh USING (method, seed) JOIN hp USING (method, seed) JOIN mi USING (method, seed) JOIN em USING (method, seed)")
def _(spark, sf):
    return r6(factor_reports.domain_accuracy(run_pairs(spark, sf)), "ari", "nmi", "ami")


# Factors: six entries of the vectors as scores, beside the loadings that other queries use.
FACT = f"""{SPOTS}, {NEAR}, {EDGES}, {LONG}, {CEN}, {FIT}, mo AS (SELECT k, count(*)::DOUBLE AS n, sum(v * v) AS m2, sum(v * v * v * v) AS m4 FROM cen GROUP BY k),
cr AS (SELECT a.k, sum(a.v * b.v) AS x FROM edges JOIN cen a ON a.spot_id = src JOIN cen b ON b.spot_id = dst AND a.k = b.k GROUP BY a.k),
gw AS (SELECT count(*)::DOUBLE AS w FROM edges), g1 AS (SELECT sum(m * m) AS s1 FROM (SELECT count(*)::DOUBLE AS m FROM edges GROUP BY least(src, dst), greatest(src, dst)) q),
g2 AS (SELECT sum(d * d) AS s2 FROM (SELECT count(*)::DOUBLE AS d FROM (SELECT src AS i FROM edges UNION ALL SELECT dst FROM edges) q GROUP BY i) r),
rd AS (SELECT i AS k, max(r) AS red FROM (SELECT a.k AS i, b.k AS j, abs(corr(a.v, b.v)) AS r FROM vals a JOIN vals b USING (spot_id) WHERE a.k <> b.k GROUP BY 1, 2) q GROUP BY i),
rk AS (SELECT k, gene_id, w, row_number() OVER (PARTITION BY k ORDER BY w DESC, gene_id) AS r FROM w),
ld AS (SELECT k, sum(w) FILTER (WHERE r <= 10) / sum(w) AS mass, string_agg(gene_id::VARCHAR, ',' ORDER BY r) FILTER (WHERE r <= 10) AS genes FROM rk GROUP BY k),
it AS (SELECT mo.k, n * x / (w * m2) AS i, -1 / (n - 1) AS e, red, mass, genes,
  sqrt((n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * w * w) - n * m4 / (m2 * m2) * ((n * n - n) * s1 - 2 * n * s2 + 6 * w * w)) / ((n - 1) * (n - 2) * (n - 3) * w * w) - 1 / ((n - 1) * (n - 1))) AS sd
  FROM mo JOIN cr USING (k) JOIN rd USING (k) JOIN ld USING (k), gw, g1, g2)"""


def factor_rows(spark, sf):
    return ad.embedding_points(spark, sf).select(F.col("id").alias("spot_id"), F.slice("h", 3, 6).alias("h"))


@query("factor_interpretability", f"WITH {FACT} SELECT k AS factor, round(i, 6) AS coherence, round(e, 6) AS null_mean, round(sd, 6) AS null_std, round((i - e) / sd, 4) AS z, round(mass, 6) AS enrichment, round(red, 6) AS max_redundancy, genes FROM it")
def _(spark, sf):
    out = factor_reports.factor_interpretability(factor_rows(spark, sf), given_loadings(spark), edges_of(spark, sf), 6)
    out = r6(out, "coherence", "null_mean", "null_std", "enrichment", "max_redundancy")
    return out.withColumns({"z": F.round("z", 4), "genes": F.array_join("top_genes", ",")}).drop("top_genes")


@query("factor_coherence", f"WITH {FACT} SELECT k AS factor, round(mass, 6) AS top_gene_mass, round(i, 6) AS spatial_coherence, round(red, 6) AS max_redundancy FROM it")
def _(spark, sf):
    out = factor_reports.factor_coherence(factor_rows(spark, sf), given_loadings(spark), edges_of(spark, sf), 6)
    return r6(out, "top_gene_mass", "spatial_coherence", "max_redundancy")


# Solves on two factors, which SQL writes out: the first two entries' positive parts as scores.
TWO = """sc AS (SELECT vec_id AS spot_id, greatest(embedding[3]::DOUBLE, 0e0) AS a, greatest(embedding[4]::DOUBLE, 0e0) AS b FROM embeddings),
gm AS (SELECT sum(a * a) AS g11, sum(a * b) AS g12, sum(b * b) AS g22 FROM sc), rhs AS (SELECT gene_id, sum(value * a) AS b1, sum(value * b) AS b2 FROM expr JOIN sc USING (spot_id) GROUP BY gene_id),
un AS (SELECT *, (g22 * b1 - g12 * b2) / (g11 * g22 - g12 * g12) AS u1, (g11 * b2 - g12 * b1) / (g11 * g22 - g12 * g12) AS u2 FROM rhs, gm),
sol AS (SELECT gene_id, CASE WHEN u1 >= 0 AND u2 >= 0 THEN u1 WHEN u1 < 0 THEN 0e0 ELSE greatest(b1 / g11, 0e0) END AS w1, CASE WHEN u1 >= 0 AND u2 >= 0 THEN u2 WHEN u1 < 0 THEN greatest(b2 / g22, 0e0) ELSE 0e0 END AS w2 FROM un)"""


def two_scores(spark, sf):
    return ad.embedding_points(spark, sf).select(F.col("id").alias("spot_id"), F.transform(F.slice("h", 3, 2), lambda v: F.greatest(v, F.lit(0e0))).alias("h"))


@query("nnls_loadings", f"WITH {EXPR}, {TWO} SELECT gene_id, round(w1, 6) + 0e0 AS w1, round(w2, 6) + 0e0 AS w2 FROM sol")
def _(spark, sf):
    rows = two_scores(spark, sf)
    x = ad.embedding_expr(spark, sf).join(rows, "spot_id").groupBy("gene_id").agg(*linalg.sum_vector("h", 2, F.col("value"))).select("gene_id", F.array("x0", "x1").alias("b"))
    w = linalg.nnls_rows(x, "gene_id", linalg.gram_of(rows, "h", 2))
    return r6(w.select("gene_id", F.get("w", 0).alias("w1"), F.get("w", 1).alias("w2")), "w1", "w2")


REFIT = """lw AS (SELECT g AS gene_id, (g % 7 + 1) / 10e0 AS a, (g % 5 + 1) / 10e0 AS b FROM range(62) t(g)), lg AS (SELECT sum(a * a) AS g11, sum(a * b) AS g12, sum(b * b) AS g22 FROM lw),
lr AS (SELECT vec_id AS spot_id, coalesce(b1, 0e0) AS b1, coalesce(b2, 0e0) AS b2 FROM embeddings LEFT JOIN (SELECT spot_id, sum(value * a) AS b1, sum(value * b) AS b2 FROM expr JOIN lw USING (gene_id) GROUP BY spot_id) q ON spot_id = vec_id)"""


@query("lstsq_refit", f"WITH {EXPR}, {REFIT} SELECT spot_id, round(greatest((g22 * b1 - g12 * b2) / (g11 * g22 - g12 * g12), 0e0), 6) AS h1, round(greatest((g11 * b2 - g12 * b1) / (g11 * g22 - g12 * g12), 0e0), 6) AS h2 FROM lr, lg")
def _(spark, sf):
    part = lambda m: ((F.col("id") % m + 1) / 10e0)
    w = spark.range(62).select(F.col("id").alias("gene_id"), F.array(part(7), part(5)).alias("w"))
    h = experiments.project_scores(ad.embedding_expr(spark, sf), ad.embedding_spots(spark, sf), w, 2)
    return r6(h.select("spot_id", F.get("h", 0).alias("h1"), F.get("h", 1).alias("h2")), "h1", "h2")


@query("pca_scores", f"WITH RECURSIVE {SUP}, {LEAD} SELECT spot_id, round(sum(c.v * d.v[c.g]), 3) AS score FROM cen c, dir d GROUP BY spot_id")
def _(spark, sf):
    x = cut(ad.supplier_counts(spark, sf))
    points = models.dense_rows(x.withColumnRenamed("value", "v"), x.select("spot_id").distinct(), x.agg(F.max("gene_id")).first()[0] + 1)
    return linalg.pca(points, 1)[0].select(F.col("id").alias("spot_id"), F.round(F.get("h", 0), 3).alias("score"))


def _encode_sql(d: int = 2, n: int = 62, seed: int = 3) -> str:
    """The random projection as a table, and the encoder in SQL."""
    f = 2 * n + 3
    p = np.random.default_rng(seed).normal(0, f**-0.5, (f, d))
    ends = ", ".join(f"({j}, {float(p[-3, j])!r}, {float(p[-2, j])!r}, {float(p[-1, j])!r})" for j in range(d))
    rows = ", ".join(f"({g}, {j}, {float(p[g, j])!r}::DOUBLE, {float(p[n + g, j])!r}::DOUBLE)" for g in range(n) for j in range(d))
    return f"""pr AS (SELECT * FROM (VALUES {rows}) v(gene_id, j, po, pn)), pe AS (SELECT * FROM (VALUES {ends}) v(j, px, py, ps)),
own AS (SELECT s.spot_id, pe.j, coalesce(sum(value * po), 0e0) AS o, coalesce(sum(value * pn), 0e0) AS q FROM spots s CROSS JOIN pe LEFT JOIN expr ON expr.spot_id = s.spot_id LEFT JOIN pr ON pr.gene_id = expr.gene_id AND pr.j = pe.j GROUP BY s.spot_id, pe.j),
mean_q AS (SELECT src AS spot_id, j, avg(q) AS m FROM snear JOIN own ON own.spot_id = dst GROUP BY src, j)
SELECT spot_id, j::BIGINT AS j, round(o - avg(o) OVER (PARTITION BY j) + coalesce(m, 0e0) - avg(q) OVER (PARTITION BY j) + (x - avg(x) OVER (PARTITION BY j)) * px + (y - avg(y) OVER (PARTITION BY j)) * py + section_id / 3e0 * ps, 6) + 0e0 AS v
FROM own JOIN spots USING (spot_id) JOIN pe USING (j) LEFT JOIN mean_q USING (spot_id, j)"""


@query("encode_graph", f"WITH {SPOTS}, {SNEAR}, {EXPR}, {_encode_sql()}")
def _(spark, sf):
    spots = ad.embedding_spots(spark, sf)
    h = models.encode(ad.embedding_expr(spark, sf), spots, graph.knn_directed(spots, 6), 62, 2, 3)
    return r6(h.select("spot_id", F.posexplode("h").alias("j", "v")).withColumn("j", F.col("j").cast("long")), "v")
