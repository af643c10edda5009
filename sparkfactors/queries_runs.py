"""More registered queries: planted data, runs around the model, experiments and guards, each beside DuckDB SQL where
SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import graph, prep
from .plans import experiments, gates, ledger, reports, runner
from .queries import ARI, CONT, D2, EDGES, EXPR, INFO, LAB, LONG, NEAR, NORM, PAIR, PERM, REC, SPOTS, SUMS, SUP, U, edges_of, i64, pairs, query, r6, vals
from .sources import adapters as ad
from .sources import synthetic

# Planted data. SQL repeats the hashes of a small instance.
EXP = "(-ln(1e0 - " + U + "))"


def _normal(text: str) -> str:
    radius, angle = EXP.format(text + " || ':r'"), U.format(text + " || ':a'")
    return f"(sqrt(2 * {radius}) * cos(2 * pi() * {angle}))"


PLANTED = f"""sp AS (SELECT s AS spot_id, s // 40 AS section_id, {U.format("'3:x:' || s")} AS x, {U.format("'3:y:' || s")} AS y FROM range(80) t(s)),
z AS (SELECT spot_id, k, CASE WHEN k < 2 OR section_id = (k - 2) % 2 THEN {EXP.format("'3:Z:' || spot_id || ':' || k")} ELSE 0e0 END AS v FROM sp, range(3) t(k)),
w AS (SELECT g AS gene_id, k, {EXP.format("'3:W:' || g || ':' || k")} AS w FROM range(20) u(g), range(3) t(k)),
val AS (SELECT spot_id, gene_id, sum(v * w) + 0.5e0 * {_normal("'3:N:' || spot_id || ':' || gene_id")} AS value FROM z JOIN w USING (k) GROUP BY spot_id, gene_id)"""


def planted(spark):
    return synthetic.generate(spark, 2, 40, 20, 2, 1, 0.5, 4, 6, 3)


@query("planted_values", f"WITH {PLANTED} SELECT spot_id, gene_id, round(value, 6) AS value FROM val WHERE value > 0")
def _(spark, sf):
    return r6(planted(spark).expr, "value")


@query("planted_domains", f"""WITH {PLANTED}, d AS (SELECT spot_id, section_id, x * {_normal("'3:D:' || section_id || ':0'")} + y * {_normal("'3:D:' || section_id || ':1'")} AS a FROM sp)
SELECT spot_id, ((row_number() OVER (PARTITION BY section_id ORDER BY a, spot_id) - 1) * 4 // count(*) OVER (PARTITION BY section_id))::BIGINT AS domain_id FROM d""")
def _(spark, sf):
    return planted(spark).domains


@query("order_bins", "SELECT p_partkey AS spot_id, p_brand AS brand, ((row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) - 1) * 4 // count(*) OVER (PARTITION BY p_brand))::BIGINT AS bin FROM part")
def _(spark, sf):
    p = ad.table(spark, sf, "part").select(F.col("p_partkey").alias("spot_id"), F.col("p_brand").alias("brand"), "p_retailprice")
    return i64(runner.order_bins(p, ("brand",), "p_retailprice", 4).select("spot_id", "brand", "bin"), "bin")


# Runs around the model.
def _manifest(spark, sf, **settings):
    genes, spots = 26, ad.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("spot_id"))
    x, done = runner.preprocess(ad.supplier_counts(spark, sf), spots, genes, **settings)
    return done.join(x.agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n")))


@query("preprocess_driver", f"WITH {SUP}, {NORM} SELECT true AS applied, 'normalize_total+log1p' AS method, 1e4::DOUBLE AS target_sum, false AS hvg_applied, 26::BIGINT AS n_genes_used, round(sum(ln(1 + value / t * 1e4)), 4) AS total, count(*)::BIGINT AS n FROM sup JOIN tot USING (spot_id)")
def _(spark, sf):
    return _manifest(spark, sf)


@query("preprocess_untouched", f"WITH {SUP} SELECT false AS applied, 'none' AS method, NULL::DOUBLE AS target_sum, false AS hvg_applied, 26::BIGINT AS n_genes_used, round(sum(value), 4) AS total, count(*)::BIGINT AS n FROM sup")
def _(spark, sf):
    return _manifest(spark, sf, already_normalized=True)


HVG = f"""{EXPR}, nn AS (SELECT count(*)::DOUBLE AS n FROM embeddings), mo AS (SELECT gene_id, sum(value) / n AS mean, greatest(sum(value * value) / n - sum(value) / n * (sum(value) / n), 0e0) AS var FROM expr, nn GROUP BY gene_id, n),
lg AS (SELECT gene_id, ln(1 + mean) AS m, ln(greatest(var, 1e-12) / mean) AS d FROM mo WHERE mean > 0), bn AS (SELECT *, least(floor((m - (SELECT min(m) FROM lg)) / greatest((SELECT max(m) - min(m) FROM lg), 1e-12) * 20), 19) AS bin FROM lg),
sc AS (SELECT gene_id, CASE WHEN stddev_samp(d) OVER w IS NULL THEN 1e0 WHEN stddev_samp(d) OVER w = 0 THEN 0e0 ELSE (d - avg(d) OVER w) / stddev_samp(d) OVER w END AS score FROM bn WINDOW w AS (PARTITION BY bin))"""


@query("hvg_dispersion", f"WITH {HVG} SELECT gene_id, round(score, 6) AS score FROM sc")
def _(spark, sf):
    return r6(prep.dispersion_genes(ad.embedding_expr(spark, sf), ad.embedding_spots(spark, sf).agg(F.count("*")), 62), "score")


@query("zscore_flat", f"""WITH {LONG}, f AS (SELECT spot_id, k, CASE WHEN k = 0 THEN 1e0 ELSE v END AS v FROM vals), m AS (SELECT *, avg(v) OVER (PARTITION BY k) AS m, stddev_pop(v) OVER (PARTITION BY k) AS sd FROM f)
SELECT 'one' AS flat, spot_id, k::BIGINT AS k, round((v - m) / CASE WHEN sd = 0 THEN 1e0 ELSE sd END, 6) + 0e0 AS v FROM m UNION ALL SELECT 'zero', spot_id, k, round(CASE WHEN sd = 0 THEN 0e0 ELSE (v - m) / sd END, 6) + 0e0 FROM m""")
def _(spark, sf):
    v = vals(spark, sf).withColumn("v", F.when(F.col("k") == 0, 1e0).otherwise(F.col("v")))
    one, zero = (prep.zscore(v, "k", flat).select(F.lit(flat).alias("flat"), "spot_id", "k", "v") for flat in ("one", "zero"))
    return r6(one.unionByName(zero), "v")


TRUE = PAIR.replace("WHERE method = 'wild' AND seed = 1", "WHERE method = 'wild' AND seed = 1 AND spot_id % 7 <> 0")


def _truth(spark, sf):
    p = pairs(spark, sf)
    truth = p.select("spot_id", F.when(F.col("spot_id") % 7 == 0, " NaN ").otherwise(F.col("t").cast("string")).alias("gt"))
    return truth, p.select("spot_id", F.col("p").alias("label"))


@query("truth_ari", f"WITH {TRUE}, {CONT}, {SUMS} SELECT round({ARI}, 6) AS ari, (SELECT count(*) FROM pairs)::BIGINT AS n_labeled FROM s")
def _(spark, sf):
    return r6(runner.truth_ari(*_truth(spark, sf)), "ari")


@query("truth_suite", f"""WITH {TRUE}, {CONT}, {INFO}, {SPOTS}, {NEAR}, {EDGES}, e AS (SELECT src, dst, a.t <> b.t AS gt, a.p <> b.p AS pr FROM edges JOIN pairs a ON a.spot_id = src JOIN pairs b ON b.spot_id = dst),
f AS (SELECT spot_id, bool_or(gt) AS gt, bool_or(pr) AS pr FROM (SELECT src AS spot_id, gt, pr FROM e UNION ALL SELECT dst, gt, pr FROM e) q GROUP BY spot_id),
n AS (SELECT count(*) FILTER (WHERE gt)::DOUBLE AS g, count(*) FILTER (WHERE pr)::DOUBLE AS p, count(*) FILTER (WHERE gt AND pr)::DOUBLE AS tp FROM f),
m AS (SELECT t, c.n, a.n AS a, b.n AS b, row_number() OVER (PARTITION BY t ORDER BY c.n DESC, p) AS r FROM c JOIN a USING (t) JOIN b USING (p)),
pt AS (SELECT pairs.spot_id AS id, p AS label, j, embedding[j + 1]::DOUBLE AS v FROM pairs JOIN embeddings ON vec_id = spot_id, range(4) u(j)),
dd AS (SELECT x.id, x.label, y.label AS other, sqrt(sum((x.v - y.v) * (x.v - y.v))) AS d FROM pt x JOIN pt y ON x.j = y.j AND x.id <> y.id GROUP BY x.id, y.id, x.label, y.label),
am AS (SELECT id, label, other, avg(d) AS d FROM dd GROUP BY id, label, other), ab AS (SELECT id, coalesce(max(d) FILTER (WHERE label = other), 0e0) AS a, min(d) FILTER (WHERE label <> other) AS b FROM am GROUP BY id),
ce AS (SELECT label, j, avg(v) AS m, count(*) AS n FROM pt GROUP BY label, j), al AS (SELECT j, avg(v) AS m FROM pt GROUP BY j),
ch AS (SELECT (SELECT sum(ce.n * (ce.m - al.m) ** 2) FROM ce JOIN al USING (j)) / (SELECT count(DISTINCT label) - 1 FROM pt) AS bt, (SELECT sum((pt.v - ce.m) ** 2) FROM pt JOIN ce USING (label, j)) / (SELECT count(DISTINCT id) - count(DISTINCT label) FROM pt) AS wi)
SELECT round(mi / ((ht + hp) / 2), 6) AS nmi, (SELECT round(sum(2 * n / (a + b) * a) / sum(a), 6) FROM m WHERE r = 1) AS dice, (SELECT round(avg((b - a) / greatest(a, b)), 6) FROM ab) AS silhouette, (SELECT round(bt / wi, 6) FROM ch) AS ch,
(SELECT round(tp / p, 6) FROM n) AS precision, (SELECT round(tp / g, 6) FROM n) AS recall, (SELECT round(2 * tp / (p + g), 6) FROM n) AS f1 FROM info""")
def _(spark, sf):
    points = ad.embedding_points(spark, sf).select("id", F.slice("h", 1, 4).alias("h"))
    return r6(runner.truth_suite(*_truth(spark, sf), points, edges_of(spark, sf)), "nmi", "dice", "silhouette", "ch", "precision", "recall", "f1")


@query("boundary_quality", f"""WITH RECURSIVE {PAIR}, {SPOTS}, {NEAR}, {EDGES}, e AS (SELECT src, dst, a.t <> b.t AS gt, a.p <> b.p AS pr FROM edges JOIN pairs a ON a.spot_id = src JOIN pairs b ON b.spot_id = dst),
f AS (SELECT spot_id, bool_or(gt) AS gt, bool_or(pr) AS pr FROM (SELECT src AS spot_id, gt, pr FROM e UNION ALL SELECT dst, gt, pr FROM e) q GROUP BY spot_id),
n AS (SELECT count(*) FILTER (WHERE gt)::DOUBLE AS g, count(*) FILTER (WHERE pr)::DOUBLE AS p, count(*) FILTER (WHERE gt AND pr)::DOUBLE AS tp FROM f),
re AS (SELECT spot_id AS a, spot_id AS b FROM pairs UNION SELECT a, dst FROM re JOIN e ON src = b WHERE NOT pr), co AS (SELECT a AS spot_id, min(b) AS c FROM re GROUP BY a),
sz AS (SELECT p AS label, c, count(*) AS size FROM co JOIN pairs USING (spot_id) GROUP BY 1, 2), ct AS (SELECT sum(m)::DOUBLE / sum(s) AS v FROM (SELECT max(size) AS m, sum(size) AS s FROM sz GROUP BY label) q)
SELECT round(tp / p, 6) AS precision, round(tp / g, 6) AS recall, round(2 * tp / (p + g), 6) AS f1, g::BIGINT AS n_true, p::BIGINT AS n_found, round(v, 6) AS contiguity FROM n, ct""")
def _(spark, sf):
    p = pairs(spark, sf)
    out = runner.boundary_quality(edges_of(spark, sf), p.select("spot_id", F.col("t").alias("label")), p.select("spot_id", F.col("p").alias("label")))
    return r6(out, "precision", "recall", "f1", "contiguity")


BAR = "pairs AS (SELECT e.vec_id AS spot_id, quality::VARCHAR AS t, e.label AS p FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id WHERE l.doc_id % 3 = 1)"


@query("donor_safe_join", f"""WITH {BAR}, {CONT}, {INFO}, {SUMS}, o AS (SELECT (SELECT count(DISTINCT vec_id) FROM embeddings) AS n, (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM labels) l JOIN embeddings ON vec_id = doc_id) AS overlap)
SELECT 'Br1' AS donor, 'ok' AS status, overlap::BIGINT AS overlap, round(overlap / n::DOUBLE, 6) AS coverage, (SELECT count(*) FROM pairs)::BIGINT AS n_joined, (SELECT count(DISTINCT t) FROM pairs)::BIGINT AS n_layers, round({ARI}, 6) AS ari, round(mi / ((ht + hp) / 2), 6) AS nmi FROM o, s, info
UNION ALL SELECT 'Br9', 'blocked: other donor', overlap, round(overlap / n::DOUBLE, 6), NULL, NULL, NULL, NULL FROM o UNION ALL SELECT 'Br2', 'blocked: coverage', overlap, round(overlap / n::DOUBLE, 6), NULL, NULL, NULL, NULL FROM o""")
def _(spark, sf):
    spots = ad.table(spark, sf, "embeddings").select(F.concat(F.lit("B"), "vec_id").alias("barcode"), "label")
    layers = ad.table(spark, sf, "labels").select(F.concat(F.lit("B"), "doc_id").alias("barcode"), F.concat(F.lit("Br"), F.pmod("doc_id", F.lit(3)), F.lit("_x")).alias("sample_id"), F.col("quality").cast("string").alias("layer"))
    out = None
    for donor, least in (("Br1", 0.001), ("Br9", 0.001), ("Br2", 1.001)):
        one = runner.donor_safe_join(spots, layers, donor, least).withColumn("donor", F.lit(donor))
        out = one if out is None else out.unionByName(one)
    return r6(out, "coverage", "ari", "nmi")


@query("chaos_null", f"""WITH {SPOTS}, {LAB}, {PERM}, al AS (SELECT -1 AS b, spot_id, label FROM lab UNION ALL SELECT b, spot_id, label FROM sh),
dd AS (SELECT a.spot_id AS i, b.spot_id AS j, sqrt({D2}) AS d FROM spots a JOIN spots b ON a.spot_id <> b.spot_id), base AS (SELECT avg(m) AS m FROM (SELECT min(d) AS m FROM dd GROUP BY i) q),
ow AS (SELECT x.b, x.label, x.spot_id, min(d) AS d FROM dd JOIN al x ON x.spot_id = i JOIN al y ON y.spot_id = j AND x.b = y.b AND x.label = y.label GROUP BY ALL),
ca AS (SELECT b, avg(d) / (SELECT m FROM base) AS v FROM (SELECT b, label, avg(d) AS d FROM ow GROUP BY b, label) q GROUP BY b), r AS (SELECT max(v) FILTER (WHERE b < 0) AS chaos, avg(v) FILTER (WHERE b >= 0) AS nm FROM ca)
SELECT round(chaos, 6) AS chaos, round(nm, 6) AS null_mean, round(nm - chaos, 6) AS delta FROM r""")
def _(spark, sf):
    s = ad.embedding_spots(spark, sf)
    return r6(runner.chaos_null(s, ad.labels(s), 8, 5), "chaos", "null_mean", "delta")


@query("loading_sparsity", "SELECT round(avg((embedding[g + 3] <= 0)::INT::DOUBLE), 6) AS zero_share FROM embeddings, range(62) t(g) WHERE vec_id < 62")
def _(spark, sf):
    p = ad.embedding_points(spark, sf).where("id < 62").select(F.col("id").alias("k"), F.posexplode(F.slice("h", 3, 62)).alias("gene_id", "w"))
    return r6(runner.loading_sparsity(p.withColumn("w", F.greatest("w", F.lit(0e0)))), "zero_share")


@query("accuracy_ambiguity", f"WITH {REC} SELECT dataset, round(avg(ari), 5) AS ari, round(avg(nmi), 5) AS ambiguity FROM rec WHERE dataset <> 'de' GROUP BY dataset")
def _(spark, sf):
    d = ad.table(spark, sf, "documents").groupBy(F.col("lang").alias("dataset"), F.pmod("doc_id", F.lit(5)).alias("v"), F.pmod("doc_id", F.lit(3)).alias("s"))
    rec = d.agg((F.avg("n_chars") / 1e4).alias("ari"), (F.avg("doc_id") / 1e3).alias("nmi")).groupBy("dataset").agg(F.avg("ari").alias("ari"), F.avg("nmi").alias("ambiguity"))
    known = rec.select("dataset", F.when(F.col("dataset") != "de", F.col("ambiguity")).alias("ambiguity"))
    return runner.accuracy_ambiguity(rec.select("dataset", "ari"), known).withColumns({x: F.round(x, 5) for x in ("ari", "ambiguity")})


@query("grid_summary", "SELECT lam, n_iter, tol, round(avg(c), 6) AS corr_mean, round(avg(a), 6) AS ari_mean, round(avg(i), 6) AS iterations_mean FROM (SELECT (l_linenumber % 3)::DOUBLE AS lam, (l_quantity % 4)::BIGINT AS n_iter, l_tax::DOUBLE AS tol, l_discount::DOUBLE AS c, CASE WHEN l_linenumber > 1 THEN l_tax::DOUBLE END AS a, l_orderkey AS i FROM lineitem) q GROUP BY lam, n_iter, tol")
def _(spark, sf):
    li = ad.table(spark, sf, "lineitem")
    rows = li.select(
        (F.col("l_linenumber") % 3).cast("double").alias("lam"), (F.col("l_quantity") % 4).cast("long").alias("n_iter"), F.col("l_tax").cast("double").alias("tol"), F.col("l_discount").cast("double").alias("factor_corr"),
        F.when(F.col("l_linenumber") > 1, F.col("l_tax").cast("double")).alias("domain_ari"), F.col("l_orderkey").alias("iterations"),
    )
    return r6(experiments.grid_summary(rows), "corr_mean", "ari_mean", "iterations_mean")


# The ledger: rows and texts made of parts and nations.
LEDGER = """row AS (SELECT p_partkey AS n, p_name AS claim, CASE p_partkey % 5 WHEN 0 THEN 'PR #' || p_partkey WHEN 1 THEN 'test_fit' WHEN 2 THEN 'GSE' || p_size ELSE 'soon' END AS current,
CASE p_partkey % 3 WHEN 0 THEN 'None' WHEN 1 THEN '-' ELSE 'plots' END AS missing, CASE WHEN p_partkey % 4 = 0 THEN 'Planned' ELSE 'done' END AS status FROM part)"""


def _ledger(spark, sf):
    k = F.col("p_partkey")
    current = F.when(k % 5 == 0, F.concat(F.lit("PR #"), k)).when(k % 5 == 1, "test_fit").when(k % 5 == 2, F.concat(F.lit("GSE"), F.col("p_size"))).otherwise("soon")
    missing = F.when(k % 3 == 0, "None").when(k % 3 == 1, "-").otherwise("plots")
    status = F.when(k % 4 == 0, "Planned").otherwise("done")
    row = ad.table(spark, sf, "part").select((k + 2).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", "p_name", F.lit("x"), current, missing, status), F.lit(" |")).alias("value"))
    top = spark.createDataFrame([(1, "| Claim | Required | Current | Missing | Status |"), (2, "|---|:--:|---|---|---|"), (0, "prose")], "line_no long, value string")
    return ledger.parse_ledger(row.unionByName(top))


@query("ledger_rows", f"WITH {LEDGER} SELECT (n + 2)::BIGINT AS line_no, trim(claim) AS claim, 'x' AS required_evidence, current AS current_evidence, missing AS missing_evidence, status FROM row")
def _(spark, sf):
    return _ledger(spark, sf)


@query("ledger_violations", f"""WITH {LEDGER}, o AS (SELECT n + 2 AS line_no, status, NOT regexp_matches(current, '#[0-9]|test_|GSE[0-9]') AS a, missing = 'plots' AS b FROM row WHERE status <> 'Planned')
SELECT line_no::BIGINT AS line_no, status, 'no evidence' AS violation FROM o WHERE a UNION ALL SELECT line_no, status, 'evidence missing' FROM o WHERE b""")
def _(spark, sf):
    return ledger.check_ledger(_ledger(spark, sf))


@query("scorecard_points", f"WITH {REC} SELECT variant AS method, round((avg(nmi) + min(ari)) / 2, 6) AS x, round(avg(ari), 6) AS y FROM rec GROUP BY variant")
def _(spark, sf):
    d = ad.table(spark, sf, "documents").groupBy(F.col("lang").alias("dataset"), F.concat(F.lit("s"), F.pmod("doc_id", F.lit(5))).alias("method"), F.pmod("doc_id", F.lit(3)).alias("s"))
    rec = d.agg((F.avg("n_chars") / 1e4).alias("ari"), (F.avg("doc_id") / 1e3).alias("coherence_delta")).withColumns({"nmi": F.lit(0e0), "ami": F.lit(0e0)})
    summary = reports.method_summary(rec, rec.groupBy("method").agg(F.min("ari").alias("stability")))
    return r6(reports.scorecard_points(summary), "x", "y")


@query("pivot_sections", "SELECT section_id, round(s0, 6) AS s0, round(s1, 6) AS s1 FROM (SELECT n_regionkey::BIGINT AS section_id, avg(s_acctbal) FILTER (WHERE s_suppkey % 2 = 0) AS s0, avg(s_acctbal) FILTER (WHERE s_suppkey % 2 = 1) AS s1 FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) q")
def _(spark, sf):
    s = ad.table(spark, sf, "supplier").join(ad.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    per = s.groupBy(F.col("n_regionkey").cast("long").alias("section_id"), F.concat(F.lit("s"), F.pmod("s_suppkey", F.lit(2))).alias("variant")).agg(F.avg("s_acctbal").cast("double").alias("ari"))
    return r6(reports.pivot_sections(per), "s0", "s1")


@query("holdout", "WITH h AS (SELECT vec_id AS spot_id, row_number() OVER (ORDER BY " + U.format("'4:' || vec_id") + ", vec_id) AS r, count(*) OVER () AS n FROM embeddings) SELECT spot_id, r <= greatest(1, round(0.2 * n)) AS test FROM h")
def _(spark, sf):
    train, test, _ = gates.holdout(ad.embedding_spots(spark, sf), 0.2, 4)
    return train.withColumn("test", F.lit(False)).unionByName(test.withColumn("test", F.lit(True)))


# Experiments: fits, which SQL can't repeat to the end; tests hold them on small fixtures.
SMALL = experiments.Config(n_spots_per_section=40, n_genes=20, n_iter=5)


@query("seed_stability")
def _(spark, sf):
    return r6(experiments.seed_stability(spark, SMALL, (0, 1)), "factor_corr", "domain_ari")


@query("loso_transfer")
def _(spark, sf):
    s = ad.embedding_spots(spark, sf)
    return r6(experiments.loso_transfer(ad.embedding_expr(spark, sf), graph.knn_directed(s, 6), s, ad.labels(s), 62, n_iter=3), "ari", "nmi")


@query("oversmoothing")
def _(spark, sf):
    s = ad.embedding_spots(spark, sf)
    return r6(experiments.oversmoothing(ad.embedding_expr(spark, sf), edges_of(spark, sf), s, 62, [0.1, 1.0, 10.0], n_iter=3), "coherence", "signal")


@query("reference_ambiguity")
def _(spark, sf):
    return r6(experiments.reference_ambiguity(ad.embedding_expr(spark, sf), ad.embedding_spots(spark, sf), 62, 10), "ambiguity")


@query("nmf_contrast")
def _(spark, sf):
    return r6(experiments.nmf_contrast(ad.embedding_expr(spark, sf), ad.embedding_spots(spark, sf), vals(spark, sf).where("k < 3"), 62, n_iter=5, genes=30), "correlation", "gap")
