"""Registered queries over the test tables, each beside DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut
from .functions import concordance, factors, spatial
from .operators import graph, models, prep
from .operators.kmeans import kmeans
from .plans import gates, reports
from .sources import adapters as ad
from .sources import readers

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Common table expressions. U: a hashed number in [0, 1) of a text.
U = "(('0x' || substr(md5({}), 1, 12))::BIGINT)::DOUBLE / 281474976710656e0"
SPOTS = "spots AS (SELECT vec_id AS spot_id, vec_id % 4 AS section_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label::VARCHAR AS gt FROM embeddings)"
EXPR = "expr AS (SELECT vec_id AS spot_id, g AS gene_id, embedding[g + 3]::DOUBLE AS value FROM embeddings, range(62) t(g) WHERE embedding[g + 3] > 0)"
LAB = "lab AS (SELECT spot_id, gt AS label FROM spots)"
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
NEAR = f"near AS (SELECT src, dst, d2, r FROM (SELECT a.spot_id AS src, b.spot_id AS dst, {D2} AS d2, row_number() OVER (PARTITION BY a.spot_id ORDER BY {D2}, b.spot_id) AS r FROM spots a JOIN spots b ON a.spot_id <> b.spot_id) q WHERE r <= 6)"
SNEAR = NEAR.replace("near AS", "snear AS").replace("a.spot_id <> b.spot_id)", "a.spot_id <> b.spot_id AND a.section_id = b.section_id)")
EDGES = "edges AS (SELECT src, dst FROM near UNION SELECT dst, src FROM near)"
BOTH = "both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"
G = f"{SPOTS}, {LAB}, {NEAR}, {EDGES}"
LONG = "vals AS (SELECT vec_id AS spot_id, k, embedding[k + 3]::DOUBLE AS v FROM embeddings, range(6) t(k))"
POS = "pos AS (SELECT spot_id, k, greatest(v, 0e0) AS v FROM vals)"
SUP = "sup AS (SELECT l_suppkey AS spot_id, regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS gene_id, sum(l_quantity)::DOUBLE AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
ENDS = "ends AS (SELECT src, dst, a.label AS ls, b.label AS ld FROM edges JOIN lab a ON a.spot_id = src JOIN lab b ON b.spot_id = dst)"
RUNS = (
    "runs AS (SELECT method, seed, vec_id AS spot_id, CASE WHEN "
    + U.format("method || ':' || seed || ':' || vec_id")
    + " < p THEN (label + 1 + seed) % 10 ELSE label END::BIGINT AS label FROM embeddings, (VALUES ('mild', 0.2e0), ('wild', 0.5e0)) m(method, p), range(3) s(seed))"
)


def edges_of(spark, sf):
    return graph.knn_undirected(ad.embedding_spots(spark, sf), 6)


def vals(spark, sf) -> DataFrame:
    """Long scores: six entries of the vectors."""
    p = ad.embedding_points(spark, sf)
    return p.select(F.col("id").alias("spot_id"), F.posexplode(F.slice("h", 3, 6)).alias("k", "v")).withColumn("k", F.col("k").cast("long"))


def pos(spark, sf):
    return vals(spark, sf).withColumn("v", F.greatest("v", F.lit(0e0)))


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 0e0, 6) for c in cols})


def i64(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# Sources and checks.
@query("load_expr_coo", f"WITH {EXPR} SELECT gene_id, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM expr GROUP BY gene_id")
def _(spark, sf):
    return r6(ad.embedding_expr(spark, sf).groupBy("gene_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")


@query("stack_sections", """WITH s AS (SELECT n_regionkey AS sec, s_suppkey AS l, s_acctbal AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey),
n AS (SELECT sec, count(*) AS n, max(l) AS m FROM s GROUP BY sec)
SELECT s.sec::BIGINT AS section_id, (l + coalesce((SELECT sum(n) FROM n p WHERE p.sec < s.sec), 0))::BIGINT AS spot_id, round(x, 6) AS x FROM s""")
def _(spark, sf):
    s = ad.table(spark, sf, "supplier").join(ad.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    s = s.select(F.col("n_regionkey").alias("section_id"), F.col("s_suppkey").alias("local_id"), F.round("s_acctbal", 6).alias("x"))
    return readers.stack_sections([(s.where(F.col("section_id") == i), None, None) for i in range(5)])[0].select("section_id", "spot_id", "x")


@query("validate_inputs", f"""WITH {G}, {EXPR} SELECT 'coordinates' AS "check", count(*) FILTER (WHERE x IS NULL OR y IS NULL OR isnan(x) OR isnan(y))::BIGINT AS n FROM spots
UNION ALL SELECT 'section', count(*) FILTER (WHERE section_id IS NULL OR section_id < 0) FROM spots UNION ALL SELECT 'spot_ids', count(*) - count(DISTINCT spot_id) FROM spots
UNION ALL SELECT 'values', count(*) FILTER (WHERE value IS NULL OR isnan(value)) FROM expr
UNION ALL SELECT 'edge_ends', count(*) FROM (SELECT src AS s FROM edges UNION ALL SELECT dst FROM edges) q WHERE s NOT IN (SELECT spot_id FROM spots)
UNION ALL SELECT 'self_loops', count(*) FROM edges WHERE src = dst UNION ALL SELECT 'repeated_edges', count(*) - count(DISTINCT (src, dst)) FROM edges
UNION ALL SELECT 'cross_section', count(*) FROM edges JOIN spots a ON a.spot_id = src JOIN spots b ON b.spot_id = dst WHERE a.section_id <> b.section_id
UNION ALL SELECT 'section_gaps', max(section_id) + 1 - count(DISTINCT section_id) FROM spots""")
def _(spark, sf):
    return i64(readers.input_violations(ad.embedding_spots(spark, sf), ad.embedding_expr(spark, sf), edges_of(spark, sf), strict=True), "n")


@query("raw_count_check", f"WITH {SUP} SELECT coalesce(max(value) > 50, false) OR bool_and(value = round(value)) AS raw FROM sup")
def _(spark, sf):
    return prep.looks_raw(ad.supplier_counts(spark, sf))


GT = "gt AS (SELECT doc_id AS spot_id, quality::VARCHAR AS gt FROM documents LEFT JOIN labels USING (doc_id)), tr AS (SELECT count(gt) AS n_labeled, count(DISTINCT gt) AS n_classes FROM gt)"


@query("gt_na_filter", f"WITH {GT} SELECT n_labeled >= 2 AS gt_present, n_classes::BIGINT AS n_classes, n_labeled::BIGINT AS n_labeled FROM tr")
def _(spark, sf):
    return gates.ground_truth(ad.document_truth(spark, sf))


@query("eval_policy", f"""WITH {GT} SELECT CASE WHEN n_labeled >= 2 AND n_classes >= 2 THEN 'A' ELSE 'B' END AS dataset_class, 'inferred' AS source, n_labeled >= 2 AND n_classes >= 2 AS emitted FROM tr""")
def _(spark, sf):
    return gates.eval_policy(gates.ground_truth(ad.document_truth(spark, sf))).drop("reason")


@query("registry_by_tier", "SELECT * FROM (VALUES ('A', 11::BIGINT), ('B', 3), ('extended', 2)) t(tier, n)")
def _(spark, sf):
    return readers.registry(spark).groupBy("tier").agg(F.count("*").alias("n"))


@query("card_id", "SELECT string_agg(c, '+' ORDER BY c) AS card_id FROM (SELECT DISTINCT 'card' || source AS c FROM documents) q")
def _(spark, sf):
    return readers.card_ids(ad.table(spark, sf, "documents").select(F.concat(F.lit("/data/card"), "source", F.lit("/x.h5ad")).alias("path")))


# Preprocessing.
NORM = "tot AS (SELECT spot_id, sum(value) AS t FROM sup GROUP BY spot_id)"


@query("normalize_total_log1p", f"WITH {SUP}, {NORM} SELECT spot_id, gene_id, round(ln(1 + value / t * 1e4), 6) AS value FROM sup JOIN tot USING (spot_id)")
def _(spark, sf):
    return r6(prep.SCHEMES["cp_target"](ad.supplier_counts(spark, sf)), "value")


@query("total_log1p", f"WITH {SUP}, {NORM} SELECT spot_id, gene_id, round(ln(1 + value / t * (SELECT median(t) FROM tot)), 6) AS value FROM sup JOIN tot USING (spot_id)")
def _(spark, sf):
    return r6(prep.total_log1p(ad.supplier_counts(spark, sf)), "value")


@query("hvg_variance", f"""WITH {EXPR}, m AS (SELECT gene_id, round(sum(value * value) / n - (sum(value) / n) * (sum(value) / n), 9) AS var FROM expr, (SELECT count(*)::DOUBLE AS n FROM embeddings) q GROUP BY gene_id, n)
SELECT gene_id, round(var, 6) AS var, row_number() OVER (ORDER BY var DESC, gene_id)::BIGINT AS rank FROM m ORDER BY rank LIMIT 20""")
def _(spark, sf):
    return r6(prep.top_variance_genes(ad.embedding_expr(spark, sf), ad.embedding_spots(spark, sf).agg(F.count("*")), 20), "var")


@query("zscore_cols", f"WITH {LONG} SELECT spot_id, k, round((v - avg(v) OVER w) / greatest(stddev_pop(v) OVER w, 1e-6), 6) + 0e0 AS v FROM vals WINDOW w AS (PARTITION BY k)")
def _(spark, sf):
    return r6(prep.zscore(vals(spark, sf), "k", "floor"), "v")


@query("positive_basis", f"WITH {LONG} SELECT spot_id, k, round((v - min(v) OVER w) / stddev_pop(v) OVER w, 6) AS v FROM vals WHERE k < 4 WINDOW w AS (PARTITION BY k)")
def _(spark, sf):
    return r6(prep.positive_basis(vals(spark, sf), 4), "v")


LOAD = "load AS (SELECT gene_id, spot_id % 5 AS k, sum(value) AS w FROM sup GROUP BY 1, 2)"


def loadings(spark, sf):
    return ad.supplier_counts(spark, sf).groupBy("gene_id", F.pmod("spot_id", F.lit(5)).cast("long").alias("k")).agg(F.sum("value").alias("w"))


@query("gauge", f"WITH {SUP}, {LOAD} SELECT gene_id, k, round(w / sqrt(sum(w * w) OVER (PARTITION BY k)), 6) AS w FROM load")
def _(spark, sf):
    w = loadings(spark, sf)
    return r6(prep.canonical_gauge(w.select(F.col("gene_id").alias("spot_id"), "k", F.col("w").alias("v")), w)[1], "w")


@query("variance_explained", f"WITH {LONG}, s AS (SELECT k, var_pop(v) AS v FROM vals GROUP BY k) SELECT k, round(v / (SELECT sum(v) FROM s), 6) AS share FROM s")
def _(spark, sf):
    return r6(prep.variance_explained(vals(spark, sf)), "share")


@query("section_gate", f"WITH {SPOTS}, {LONG} SELECT spot_id, k, round(CASE WHEN k < 2 OR (k - 2) % 4 = section_id THEN v ELSE 0e0 END, 6) + 0e0 AS v FROM vals JOIN spots USING (spot_id)")
def _(spark, sf):
    return r6(prep.section_gate(vals(spark, sf), ad.embedding_spots(spark, sf), 2), "v")


# Graphs.
@query("knn_undirected", f"WITH {SPOTS}, {NEAR}, {EDGES} SELECT src, dst FROM edges")
def _(spark, sf):
    return edges_of(spark, sf)


@query("knn_directed_section", f"WITH {SPOTS}, {SNEAR} SELECT src, dst, r::BIGINT AS rank, round(d2, 6) AS d2 FROM snear")
def _(spark, sf):
    return r6(i64(graph.knn(ad.embedding_spots(spark, sf), 6), "rank"), "d2")


@query("nn_distance", f"WITH {SPOTS}, {NEAR} SELECT src, round(sqrt(d2), 6) AS d FROM near WHERE r = 1")
def _(spark, sf):
    return graph.knn(ad.embedding_spots(spark, sf), 1, by_section=False).select("src", F.round(F.sqrt("d2"), 6).alias("d"))


@query("degree_sym", f"WITH {SPOTS}, {NEAR}, {EDGES}, {BOTH} SELECT src AS spot_id, count(*)::BIGINT AS degree FROM both_ways GROUP BY src")
def _(spark, sf):
    return graph.degree(graph.symmetrise(edges_of(spark, sf)), ad.embedding_spots(spark, sf))


@query("neighbor_sum", f"WITH {SPOTS}, {NEAR}, {EDGES}, {LONG} SELECT src AS spot_id, k, round(sum(v), 6) + 0e0 AS v FROM edges JOIN vals ON dst = spot_id GROUP BY src, k")
def _(spark, sf):
    return r6(graph.neighbour_sum(edges_of(spark, sf), vals(spark, sf), "k"), "v")


@query("neighbor_mean", f"WITH {SPOTS}, {SNEAR}, {LONG} SELECT src AS spot_id, k, round(avg(v), 6) + 0e0 AS v FROM snear JOIN vals ON dst = spot_id GROUP BY src, k")
def _(spark, sf):
    return r6(graph.neighbour_mean(graph.knn_directed(ad.embedding_spots(spark, sf), 6), vals(spark, sf), "k", ad.embedding_spots(spark, sf)), "v")


def _hop(i):
    return f"""h{i + 1} AS (SELECT p.spot_id, p.k, 0.5e0 * p.v + 0.5e0 * coalesce(m.v, 0e0) AS v FROM h{i} p
LEFT JOIN (SELECT src, k, avg(v) AS v FROM both_ways JOIN h{i} ON dst = spot_id GROUP BY src, k) m ON m.src = p.spot_id AND m.k = p.k)"""


@query("smooth_2hop", f"WITH {SPOTS}, {NEAR}, {EDGES}, {BOTH}, {LONG}, h0 AS (SELECT * FROM vals), {_hop(0)}, {_hop(1)} SELECT spot_id, k, round(v, 6) + 0e0 AS v FROM h2")
def _(spark, sf):
    return r6(graph.smooth(edges_of(spark, sf), vals(spark, sf), "k"), "v")


SAME = "same AS (SELECT src, dst FROM ends WHERE ls = ld)"
REACH = "reach AS (SELECT spot_id AS v, spot_id AS r FROM spots UNION SELECT dst, r FROM reach JOIN {} ON v = src WHERE r < dst)"
COMP = "comp AS (SELECT v AS spot_id, min(r) AS component FROM reach GROUP BY v)"
SAME2 = "same2 AS (SELECT src, dst FROM same UNION SELECT dst, src FROM same)"
PARTS = f"WITH RECURSIVE {G}, {ENDS}, {SAME}, {SAME2}, {REACH.format('same2')}, {COMP}, parts AS (SELECT label, component, count(*) AS size FROM comp JOIN lab USING (spot_id) GROUP BY 1, 2)"


@query("components", f"WITH RECURSIVE {SPOTS}, {SNEAR}, two AS (SELECT src, dst FROM snear WHERE r <= 2), two2 AS (SELECT src, dst FROM two UNION SELECT dst, src FROM two), {REACH.format('two2')}, {COMP} SELECT spot_id, component FROM comp")
def _(spark, sf):
    s = ad.embedding_spots(spark, sf)
    return graph.components(graph.knn_directed(s, 2), s)


@query("domain_components", f"{PARTS} SELECT label, component, size::BIGINT AS size FROM parts")
def _(spark, sf):
    return graph.domain_components(edges_of(spark, sf), ad.labels(ad.embedding_spots(spark, sf)))


@query("contiguity", f"{PARTS} SELECT round(sum(m)::DOUBLE / sum(n), 6) AS contiguity, sum(c)::BIGINT AS components, round(sum(c)::DOUBLE / count(*), 6) AS fragmentation FROM (SELECT label, max(size) AS m, sum(size) AS n, count(*) AS c FROM parts GROUP BY label) q")
def _(spark, sf):
    d = graph.domain_components(edges_of(spark, sf), ad.labels(ad.embedding_spots(spark, sf)))
    per = d.groupBy("label").agg(F.max("size").alias("m"), F.sum("size").alias("n"), F.count("*").alias("c"))
    return r6(per.agg((F.sum("m") / F.sum("n")).alias("contiguity"), F.sum("c").alias("components"), (F.sum("c") / F.count("*")).alias("fragmentation")), "contiguity", "fragmentation")


@query("boundary_spots", f"WITH {G}, {ENDS} SELECT src AS spot_id FROM ends WHERE ls <> ld UNION SELECT dst FROM ends WHERE ls <> ld")
def _(spark, sf):
    return graph.boundary_mask(edges_of(spark, sf), ad.labels(ad.embedding_spots(spark, sf)))


@query("edge_purity", f"WITH {G}, {ENDS} SELECT round(avg((ls = ld)::INT::DOUBLE), 6) AS purity FROM ends")
def _(spark, sf):
    return r6(graph.edge_purity(edges_of(spark, sf), ad.labels(ad.embedding_spots(spark, sf))), "purity")


@query("laplacian_form", f"WITH {SPOTS}, {NEAR}, {EDGES}, {BOTH}, {LONG} SELECT round(sum((a.v - b.v) * (a.v - b.v)) / 2, 6) AS form FROM both_ways JOIN vals a ON a.spot_id = src JOIN vals b ON b.spot_id = dst AND a.k = b.k")
def _(spark, sf):
    return r6(graph.laplacian_form(edges_of(spark, sf), vals(spark, sf), "k"), "form")


@query("edge_dropout", f"WITH {SPOTS}, {NEAR}, {EDGES} SELECT src, dst FROM edges WHERE {U.format(chr(39) + '3:' + chr(39) + ' || src || ' + chr(39) + ':' + chr(39) + ' || dst')} >= 0.3")
def _(spark, sf):
    return graph.edge_dropout(edges_of(spark, sf), 0.3, 3)


@query("edge_subset", f"WITH {SPOTS}, {NEAR}, {EDGES} SELECT src, dst FROM edges JOIN spots a ON a.spot_id = src JOIN spots b ON b.spot_id = dst WHERE a.section_id < 2 AND b.section_id < 2")
def _(spark, sf):
    return graph.edge_subset(edges_of(spark, sf), ad.embedding_spots(spark, sf).where("section_id < 2"))


@query("budget_alloc", """WITH s AS (SELECT source AS component, count(*) AS size FROM documents GROUP BY source),
i AS (SELECT *, size / (SELECT sum(size)::DOUBLE FROM s) * (47 - (SELECT count(*) FROM s)) AS ideal FROM s)
SELECT component, size::BIGINT AS size, (1 + floor(ideal) + CASE WHEN row_number() OVER (ORDER BY ideal - floor(ideal) DESC, component) <= 47 - (SELECT count(*) FROM s) - (SELECT sum(floor(ideal)) FROM i) THEN 1 ELSE 0 END)::BIGINT AS budget FROM i""")
def _(spark, sf):
    return graph.apportion(ad.table(spark, sf, "documents").groupBy(F.col("source").alias("component")).agg(F.count("*").alias("size")), 47)


# Agreement of labelings: the truth and a run of the wilder method.
PAIR = f"{RUNS}, pairs AS (SELECT label_t AS t, r.label AS p, spot_id FROM runs r JOIN (SELECT vec_id AS spot_id, label::BIGINT AS label_t FROM embeddings) e USING (spot_id) WHERE method = 'wild' AND seed = 1)"
CONT = "c AS (SELECT t, p, count(*)::DOUBLE AS n FROM pairs GROUP BY t, p), a AS (SELECT t, sum(n) AS n FROM c GROUP BY t), b AS (SELECT p, sum(n) AS n FROM c GROUP BY p), tot AS (SELECT sum(n) AS n FROM c)"
INFO = """info AS (SELECT (SELECT sum(c.n / tot.n * ln(c.n * tot.n / (a.n * b.n))) FROM c JOIN a USING (t) JOIN b USING (p), tot) AS mi,
(SELECT -sum(a.n / tot.n * ln(a.n / tot.n)) FROM a, tot) AS ht, (SELECT -sum(b.n / tot.n * ln(b.n / tot.n)) FROM b, tot) AS hp)"""
ARI = """(s.c2 - s.a2 * s.b2 / s.t2) / nullif(0.5e0 * (s.a2 + s.b2) - s.a2 * s.b2 / s.t2, 0e0)"""
SUMS = "s AS (SELECT (SELECT sum(n * (n - 1) / 2e0) FROM c) AS c2, (SELECT sum(n * (n - 1) / 2e0) FROM a) AS a2, (SELECT sum(n * (n - 1) / 2e0) FROM b) AS b2, (SELECT n * (n - 1) / 2e0 FROM tot) AS t2)"
EMI = """emi AS (SELECT sum(x / n * (ln(n) + ln(x) - ln(a) - ln(b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(a - x + 1) - lgamma(b - x + 1) - lgamma(n - a - b + x + 1))) AS emi
FROM (SELECT a.n AS a, b.n AS b, tot.n AS n, unnest(range(greatest(1, a.n + b.n - tot.n)::BIGINT, least(a.n, b.n)::BIGINT + 1))::DOUBLE AS x FROM a, b, tot) q)"""


def pairs(spark, sf):
    e = ad.table(spark, sf, "embeddings").select(F.col("vec_id").alias("spot_id"), F.col("label").cast("long").alias("t"))
    return ad.runs(spark, sf).where("method = 'wild' AND seed = 1").select("spot_id", F.col("label").alias("p")).join(e, "spot_id")


@query("contingency", f"WITH {PAIR}, {CONT} SELECT t, p, c.n::BIGINT AS n, a.n::BIGINT AS a, b.n::BIGINT AS b FROM c JOIN a USING (t) JOIN b USING (p)")
def _(spark, sf):
    return concordance.contingency(pairs(spark, sf)).drop("total")


@query("ari", f"WITH {PAIR}, {CONT}, {SUMS} SELECT round({ARI}, 6) AS ari FROM s")
def _(spark, sf):
    return r6(concordance.ari(pairs(spark, sf)), "ari")


@query("nmi", f"WITH {PAIR}, {CONT}, {INFO} SELECT round(mi / ((ht + hp) / 2), 6) AS nmi FROM info")
def _(spark, sf):
    return r6(concordance.nmi(pairs(spark, sf)), "nmi")


@query("mutual_info", f"WITH {PAIR}, {CONT}, {INFO} SELECT round(mi, 6) AS mi, round(ht, 6) AS ht, round(hp, 6) AS hp FROM info")
def _(spark, sf):
    return r6(concordance.information(pairs(spark, sf)).select("mi", "ht", "hp"), "mi", "ht", "hp")


@query("emi", f"WITH {PAIR}, {CONT}, {EMI} SELECT round(emi, 6) AS emi FROM emi")
def _(spark, sf):
    return r6(concordance.expected_information(pairs(spark, sf)), "emi")


@query("ami", f"WITH {PAIR}, {CONT}, {INFO}, {EMI} SELECT round((mi - emi) / ((ht + hp) / 2 - emi), 6) AS ami FROM info, emi")
def _(spark, sf):
    return r6(concordance.ami(pairs(spark, sf)), "ami")


@query("accuracy_table", f"WITH {PAIR}, {CONT}, {SUMS}, {INFO}, {EMI} SELECT round({ARI}, 6) AS ari, round(mi / ((ht + hp) / 2), 6) AS nmi, round((mi - emi) / ((ht + hp) / 2 - emi), 6) AS ami FROM s, info, emi")
def _(spark, sf):
    return r6(concordance.accuracy(pairs(spark, sf)), "ari", "nmi", "ami")


@query("weighted_dice", f"WITH {PAIR}, {CONT}, m AS (SELECT t, c.n, a.n AS a, b.n AS b, row_number() OVER (PARTITION BY t ORDER BY c.n DESC, p) AS r FROM c JOIN a USING (t) JOIN b USING (p)) SELECT round(sum(2 * n / (a + b) * a) / sum(a), 6) AS dice FROM m WHERE r = 1")
def _(spark, sf):
    return r6(concordance.weighted_dice(pairs(spark, sf)), "dice")


@query("majority_relabel", f"WITH {PAIR}, {CONT} SELECT p, t FROM (SELECT p, t, row_number() OVER (PARTITION BY p ORDER BY n DESC, t) AS r FROM c) q WHERE r = 1")
def _(spark, sf):
    return concordance.majority_relabel(pairs(spark, sf))


@query("boundary_prf", f"""WITH {PAIR}, {SPOTS}, {NEAR}, {EDGES}, e AS (SELECT src, dst, a.t <> b.t AS gt, a.p <> b.p AS pr FROM edges JOIN pairs a ON a.spot_id = src JOIN pairs b ON b.spot_id = dst),
f AS (SELECT spot_id, bool_or(gt) AS gt, bool_or(pr) AS pr FROM (SELECT src AS spot_id, gt, pr FROM e UNION ALL SELECT dst, gt, pr FROM e) q GROUP BY spot_id),
n AS (SELECT count(*) FILTER (WHERE gt)::DOUBLE AS g, count(*) FILTER (WHERE pr)::DOUBLE AS p, count(*) FILTER (WHERE gt AND pr)::DOUBLE AS tp FROM f)
SELECT round(tp / p, 6) AS precision, round(tp / g, 6) AS recall, round(2 * tp / (p + g), 6) AS f1 FROM n""")
def _(spark, sf):
    e, p = edges_of(spark, sf), pairs(spark, sf)
    mask = lambda c: graph.boundary_mask(e, p.select("spot_id", F.col(c).alias("label")))
    return r6(concordance.boundary_scores(mask("t"), mask("p")), "precision", "recall", "f1")


BYARI = """c AS (SELECT {g}, t, p, count(*)::DOUBLE AS n FROM pairs GROUP BY ALL), a AS (SELECT {g}, sum(n * (n - 1) / 2) AS a2 FROM (SELECT {g}, t, sum(n) AS n FROM c GROUP BY ALL) q GROUP BY ALL),
b AS (SELECT {g}, sum(n * (n - 1) / 2) AS b2 FROM (SELECT {g}, p, sum(n) AS n FROM c GROUP BY ALL) q GROUP BY ALL), z AS (SELECT {g}, sum(n * (n - 1) / 2) AS c2, sum(n) AS n FROM c GROUP BY ALL),
s AS (SELECT *, n * (n - 1) / 2 AS t2 FROM z JOIN a USING ({g}) JOIN b USING ({g}))"""


@query("per_section_ari", f"WITH {PAIR.replace('spot_id FROM runs', 'spot_id, spot_id % 4 AS section_id FROM runs')}, {BYARI.format(g='section_id')} SELECT section_id, round({ARI}, 6) AS ari FROM s")
def _(spark, sf):
    return r6(concordance.ari(pairs(spark, sf).withColumn("section_id", F.pmod("spot_id", F.lit(4)).cast("long")), ("section_id",)), "ari")


PST = f"pairs AS (SELECT a.method, a.seed AS s1, b.seed AS s2, a.label AS t, b.label AS p FROM runs a JOIN runs b USING (method, spot_id) WHERE a.seed < b.seed), {BYARI.format(g='method, s1, s2')}"


@query("pairwise_stability", f"WITH {RUNS}, {PST} SELECT method, round(avg({ARI}), 6) AS stability FROM s GROUP BY method")
def _(spark, sf):
    return r6(concordance.pairwise_stability(ad.runs(spark, sf)), "stability")


# Space.
CEN = "cen AS (SELECT spot_id, k, v - avg(v) OVER (PARTITION BY k) AS v FROM vals)"


@query("morans_i", f"WITH {SPOTS}, {NEAR}, {EDGES}, {LONG}, {CEN} SELECT k, round((SELECT count(*) FROM spots) / (SELECT count(*)::DOUBLE FROM edges) * x / ss, 6) AS i FROM (SELECT a.k, sum(a.v * b.v) AS x FROM edges JOIN cen a ON a.spot_id = src JOIN cen b ON b.spot_id = dst AND a.k = b.k GROUP BY a.k) q JOIN (SELECT k, sum(v * v) AS ss FROM cen GROUP BY k) r USING (k)")
def _(spark, sf):
    return r6(spatial.morans_i(vals(spark, sf), edges_of(spark, sf), "k"), "i")


GENES = f"all_v AS (SELECT spot_id, g AS k, coalesce(value, 0e0) AS v FROM spots CROSS JOIN range(62) t(g) LEFT JOIN expr USING (spot_id) WHERE expr.gene_id = g OR expr.gene_id IS NULL)"
DENSE = "vals AS (SELECT vec_id AS spot_id, k, greatest(embedding[k + 3]::DOUBLE, 0e0) AS v FROM embeddings, range(62) t(k))"
GMOR = f"{SPOTS}, {NEAR}, {EDGES}, {DENSE}, {CEN}, mor AS (SELECT k AS gene_id, (SELECT count(*) FROM spots) / (SELECT count(*)::DOUBLE FROM edges) * x / ss AS i FROM (SELECT a.k, sum(a.v * b.v) AS x FROM edges JOIN cen a ON a.spot_id = src JOIN cen b ON b.spot_id = dst AND a.k = b.k GROUP BY a.k) q JOIN (SELECT k, sum(v * v) AS ss FROM cen GROUP BY k) r USING (k))"


def gene_morans(spark, sf):
    return spatial.sparse_morans(ad.embedding_expr(spark, sf), edges_of(spark, sf), ad.embedding_spots(spark, sf).agg(F.count("*")))


@query("gene_morans", f"WITH {GMOR} SELECT count(*)::BIGINT AS n, round(avg(i), 6) AS mean, round(median(i), 6) AS median, round(stddev_pop(i), 6) AS std, round(max(i), 6) AS max, round(quantile_cont(i, 0.9), 6) AS p90, round(avg((i > 0.1)::INT::DOUBLE), 6) AS frac FROM mor")
def _(spark, sf):
    return r6(spatial.moran_summary(gene_morans(spark, sf)), "mean", "median", "std", "max", "p90", "frac")


@query("top_svg", f"WITH {GMOR} SELECT gene_id, round(i, 6) AS i FROM mor ORDER BY round(i, 9) DESC, gene_id LIMIT 10")
def _(spark, sf):
    return r6(gene_morans(spark, sf).orderBy(F.round("i", 9).desc(), "gene_id").limit(10), "i")


COH = """coh AS (SELECT avg(i) AS coherence FROM (SELECT c.label, sum((x.ind - c.p) * (y.ind - c.p)) * (SELECT count(*) FROM spots) / (SELECT count(*)::DOUBLE FROM edges) / ((SELECT count(*) FROM spots) * c.p * (1 - c.p)) AS i
FROM (SELECT label, count(*)::DOUBLE / (SELECT count(*) FROM lab) AS p FROM lab GROUP BY label) c, edges, LATERAL (SELECT (label = c.label)::INT AS ind FROM lab WHERE spot_id = src) x, LATERAL (SELECT (label = c.label)::INT AS ind FROM lab WHERE spot_id = dst) y GROUP BY c.label, c.p) q)"""


@query("coherence", f"WITH {G}, {COH} SELECT round(coherence, 6) AS coherence FROM coh")
def _(spark, sf):
    return r6(spatial.coherence(ad.labels(ad.embedding_spots(spark, sf)), edges_of(spark, sf)), "coherence")


@query("pas", f"WITH {SPOTS}, {LAB}, {NEAR} SELECT round(avg((f < 0.5)::INT::DOUBLE), 6) AS pas FROM (SELECT src, avg((a.label = b.label)::INT::DOUBLE) AS f FROM near JOIN lab a ON a.spot_id = src JOIN lab b ON b.spot_id = dst GROUP BY src) q")
def _(spark, sf):
    s = ad.embedding_spots(spark, sf)
    return r6(spatial.pas(ad.labels(s), graph.knn_directed(s, 6, by_section=False)), "pas")


@query("chaos", f"WITH {SPOTS}, nn AS (SELECT a.gt, sqrt(min({D2}) FILTER (WHERE a.gt = b.gt)) AS own, sqrt(min({D2})) AS any FROM spots a JOIN spots b ON a.spot_id <> b.spot_id GROUP BY a.spot_id, a.gt) SELECT round((SELECT avg(m) FROM (SELECT avg(own) AS m FROM nn WHERE own IS NOT NULL GROUP BY gt) q) / avg(nn.any), 6) AS chaos FROM nn")
def _(spark, sf):
    s = ad.embedding_spots(spark, sf)
    return r6(spatial.chaos(s, ad.labels(s)), "chaos")


@query("silhouette", """WITH p AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS h FROM embeddings),
d AS (SELECT a.id, a.label = b.label AS same, b.label AS l, avg(list_distance(a.h, b.h)) AS d FROM p a JOIN p b ON a.id <> b.id GROUP BY a.id, a.label, b.label),
s AS (SELECT id, coalesce(max(d) FILTER (WHERE same), 0) AS a, min(d) FILTER (WHERE NOT same) AS b FROM d GROUP BY id) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s""")
def _(spark, sf):
    return r6(spatial.silhouette(ad.embedding_points(spark, sf)), "silhouette")


@query("calinski_harabasz", """WITH v AS (SELECT vec_id AS id, label, j, embedding[j]::DOUBLE AS v FROM embeddings, range(1, 65) t(j)), m AS (SELECT *, avg(v) OVER (PARTITION BY label, j) AS c, avg(v) OVER (PARTITION BY j) AS g FROM v)
SELECT round((sum((c - g) * (c - g)) / (count(DISTINCT label) - 1)) / (sum((v - c) * (v - c)) / (count(DISTINCT id) - count(DISTINCT label))), 6) AS ch FROM m""")
def _(spark, sf):
    return r6(spatial.calinski_harabasz(ad.embedding_points(spark, sf)), "ch")


# Factors.
CORR = "SELECT a.k AS i, b.k AS j, least(abs(corr(a.v, b.v)), 1e0) AS r FROM vals a JOIN vals b USING (spot_id) GROUP BY 1, 2"


@query("abs_corr", f"WITH {LONG} SELECT i, j, round(r, 6) AS r FROM ({CORR}) q")
def _(spark, sf):
    return r6(factors.abs_corr(vals(spark, sf), vals(spark, sf)), "r")


@query("factor_redundancy", f"WITH {LONG} SELECT round(avg(r), 6) AS redundancy FROM ({CORR}) q WHERE i <> j")
def _(spark, sf):
    return r6(factors.redundancy(vals(spark, sf)), "redundancy")


@query("matched_corr_k3", f"WITH {LONG}, m AS (SELECT a.k AS i, b.k - 3 AS j, abs(corr(a.v, b.v)) AS r FROM vals a JOIN vals b USING (spot_id) WHERE a.k < 3 AND b.k >= 3 GROUP BY 1, 2) SELECT round(max(x.r + y.r + z.r) / 3, 6) AS mfc FROM m x JOIN m y ON y.i = 1 AND y.j <> x.j JOIN m z ON z.i = 2 AND z.j NOT IN (x.j, y.j) WHERE x.i = 0")
def _(spark, sf):
    v = vals(spark, sf)
    return spark.createDataFrame([(round(factors.matched_factor_correlation(v.where("k < 3"), v.where("k >= 3")), 6),)], "mfc double")


@query("section_overlap", f"WITH {LONG}, {POS} SELECT k, spot_id % 4 AS section_id, round(sum(v) / sum(sum(v)) OVER (PARTITION BY k), 6) AS share FROM pos GROUP BY 1, 2")
def _(spark, sf):
    return r6(factors.section_overlap(pos(spark, sf), ad.embedding_spots(spark, sf)), "share")


@query("shared_private_sep", f"WITH {LONG}, {POS}, s AS (SELECT k, sum(v) / sum(sum(v)) OVER (PARTITION BY k) AS share FROM pos GROUP BY k, spot_id % 4) SELECT avg(n)::DOUBLE AS sections FROM (SELECT count(*) FILTER (WHERE share > 0.05e0) AS n FROM s GROUP BY k) q")
def _(spark, sf):
    return factors.shared_private_separation(pos(spark, sf), ad.embedding_spots(spark, sf))


FIT = "w AS (SELECT g AS gene_id, k, (g + k) % 7 / 10e0 AS w FROM range(62) t(g), range(6) u(k))"


def given_loadings(spark):
    return spark.range(62).select(F.col("id").alias("gene_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).select("gene_id", F.col("k").cast("long").alias("k"), (F.pmod(F.col("gene_id") + F.col("k"), F.lit(7)) / 10e0).alias("w"))


@query("recon_error", f"WITH x AS (SELECT vec_id AS spot_id, g AS gene_id, greatest(embedding[g + 3], 0)::DOUBLE AS value FROM embeddings, range(62) t(g)), {LONG}, {POS}, {FIT} SELECT round(sqrt(sum((value - f) * (value - f))) / sqrt(sum(value * value)), 6) AS error FROM x JOIN (SELECT spot_id, gene_id, sum(v * w) AS f FROM pos JOIN w USING (k) GROUP BY 1, 2) q USING (spot_id, gene_id)")
def _(spark, sf):
    return r6(factors.reconstruction_error(ad.embedding_expr(spark, sf), pos(spark, sf), given_loadings(spark)), "error")


@query("objective_split", f"""WITH x AS (SELECT vec_id AS spot_id, g AS gene_id, greatest(embedding[g + 3], 0)::DOUBLE AS value FROM embeddings, range(62) t(g)), {SPOTS}, {NEAR}, {EDGES}, {BOTH}, {LONG}, {POS}, {FIT},
o AS (SELECT (SELECT sum((value - f) * (value - f)) FROM x JOIN (SELECT spot_id, gene_id, sum(v * w) AS f FROM pos JOIN w USING (k) GROUP BY 1, 2) q USING (spot_id, gene_id)) AS recon,
(SELECT sum((a.v - b.v) * (a.v - b.v)) / 2 FROM both_ways JOIN pos a ON a.spot_id = src JOIN pos b ON b.spot_id = dst AND a.k = b.k) AS smooth)
SELECT round(recon, 6) AS recon, round(smooth, 6) AS smooth, round(0.5e0 * smooth / (recon + 0.5e0 * smooth), 6) AS fraction FROM o""")
def _(spark, sf):
    rr = factors.squared_residual(ad.embedding_expr(spark, sf), pos(spark, sf), given_loadings(spark)).select(F.col("rr").alias("recon"))
    s = graph.laplacian_form(edges_of(spark, sf), pos(spark, sf), "k").scalar()
    out = rr.select("recon", s.alias("smooth")).withColumn("fraction", F.try_divide(0.5 * F.col("smooth"), F.col("recon") + 0.5 * F.col("smooth")))
    return r6(out, "recon", "smooth", "fraction")


ETA = "SELECT k, covariate, (sum(n * (m - g) * (m - g)) / max(ss)) AS eta2 FROM (SELECT k, covariate, c, count(*) AS n, avg(v) AS m, any_value(g) AS g, any_value(ss) AS ss FROM e GROUP BY ALL) q GROUP BY k, covariate"
COV = "e AS (SELECT k, covariate, CASE covariate WHEN 'label' THEN label::VARCHAR ELSE (spot_id % 4)::VARCHAR END AS c, v, avg(v) OVER (PARTITION BY k, covariate) AS g, var_pop(v) OVER (PARTITION BY k, covariate) * count(*) OVER (PARTITION BY k, covariate) AS ss FROM vals JOIN embeddings ON vec_id = spot_id, (VALUES ('label'), ('section')) t(covariate))"


@query("covariate_matrix", f"WITH {LONG}, {COV} SELECT k, covariate, round(eta2, 6) AS eta2 FROM ({ETA}) q")
def _(spark, sf):
    s = ad.embedding_spots(spark, sf).select("spot_id", F.col("gt").alias("label"), F.col("section_id").cast("string").alias("section"))
    return r6(factors.eta_squared(vals(spark, sf), s.unpivot("spot_id", ["label", "section"], "covariate", "g")), "eta2")


@query("binned_nmi", f"""WITH {LONG}, q AS (SELECT k, list_distinct([quantile_cont(v, 0.2), quantile_cont(v, 0.4), quantile_cont(v, 0.6), quantile_cont(v, 0.8)]) AS e FROM vals GROUP BY k),
pairs AS (SELECT vals.k, label AS t, len(list_filter(e, lambda x: x <= v)) AS p FROM vals JOIN q USING (k) JOIN embeddings ON vec_id = spot_id), c AS (SELECT k, t, p, count(*)::DOUBLE AS n FROM pairs GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY k, t) AS a, sum(n) OVER (PARTITION BY k, p) AS b, sum(n) OVER (PARTITION BY k) AS z FROM c)
SELECT k, round(sum(n / z * ln(n * z / (a * b))) / ((-sum(n / z * ln(a / z)) - sum(n / z * ln(b / z))) / 2), 6) AS nmi FROM m GROUP BY k""")
def _(spark, sf):
    b = factors.quantile_bins(vals(spark, sf), 5).join(ad.labels(ad.embedding_spots(spark, sf)), "spot_id")
    return r6(concordance.nmi(b.select("k", F.col("label").alias("t"), F.col("bin").alias("p")), ("k",)), "nmi")


@query("domain_entropy", "WITH s AS (SELECT label, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM embeddings GROUP BY label) SELECT count(*)::BIGINT AS n_domains, round(-sum(p * ln(p)), 6) AS entropy FROM s")
def _(spark, sf):
    return r6(factors.domain_stats(ad.labels(ad.embedding_spots(spark, sf))), "entropy")


TOP = "top AS (SELECT k, gene_id, w, row_number() OVER (PARTITION BY k ORDER BY w DESC, gene_id) AS r FROM load)"


@query("top_genes", f"WITH {SUP}, {LOAD}, {TOP} SELECT k, r::BIGINT AS rank, gene_id, round(w, 6) AS w FROM top WHERE r <= 4")
def _(spark, sf):
    return r6(factors.top_genes(loadings(spark, sf), 4), "w")


@query("gene_union", f"WITH {SUP}, {LOAD}, {TOP} SELECT gene_id, row_number() OVER (ORDER BY k, r)::BIGINT AS place FROM (SELECT gene_id, k, r, row_number() OVER (PARTITION BY gene_id ORDER BY k, r) AS f FROM top WHERE r <= 4) q WHERE f = 1")
def _(spark, sf):
    return factors.gene_union(factors.top_genes(loadings(spark, sf), 4))


@query("top_gene_mass", f"WITH {SUP}, {LOAD}, {TOP} SELECT k, round(sum(w) FILTER (WHERE r <= 4) / sum(w), 6) AS mass FROM top GROUP BY k")
def _(spark, sf):
    return r6(factors.top_gene_mass(loadings(spark, sf), 4), "mass")


# Nulls and gates.
HASH5 = U.format("'5:' || b || ':' || spot_id")
PERM = f"z AS (SELECT b, spot_id, row_number() OVER (PARTITION BY b ORDER BY spot_id) AS i, row_number() OVER (PARTITION BY b ORDER BY {HASH5}, spot_id) AS j, label FROM lab, range(8) t(b)), sh AS (SELECT x.b, x.spot_id, y.label FROM z x JOIN z y ON x.b = y.b AND x.i = y.j)"


@query("permuted_labels", f"WITH {SPOTS}, {LAB}, {PERM} SELECT b, spot_id, label FROM sh")
def _(spark, sf):
    return i64(spatial.permuted(ad.labels(ad.embedding_spots(spark, sf)), 8, 5), "b")


PASN = f"WITH {SPOTS}, {LAB}, {NEAR}, {PERM}, al AS (SELECT -1 AS b, spot_id, label FROM lab UNION ALL SELECT * FROM sh), pas AS (SELECT b, avg((f < 0.5)::INT::DOUBLE) AS pas FROM (SELECT a.b, src, avg((a.label = c.label)::INT::DOUBLE) AS f FROM near JOIN al a ON a.spot_id = src JOIN al c ON c.spot_id = dst AND a.b = c.b GROUP BY 1, 2) q GROUP BY b)"


@query("pas_null", f"{PASN} SELECT round(max(pas) FILTER (WHERE b < 0), 6) AS pas, round(avg(pas) FILTER (WHERE b >= 0), 6) AS null_mean, round(avg(pas) FILTER (WHERE b >= 0) - max(pas) FILTER (WHERE b < 0), 6) AS delta FROM pas")
def _(spark, sf):
    s = ad.embedding_spots(spark, sf)
    return r6(gates.pas_null(ad.labels(s), graph.knn_directed(s, 6, by_section=False), 8, 5), "pas", "null_mean", "delta")


MORN = f"""WITH {SPOTS}, {LAB}, {NEAR}, {EDGES}, {PERM}, al AS (SELECT -1 AS b, spot_id, label::DOUBLE AS v FROM lab UNION ALL SELECT b, spot_id, label::DOUBLE FROM sh), cc AS (SELECT b, spot_id, v - avg(v) OVER (PARTITION BY b) AS v FROM al),
m AS (SELECT b, (SELECT count(*) FROM spots) / (SELECT count(*)::DOUBLE FROM edges) * x / ss AS i FROM (SELECT a.b, sum(a.v * c.v) AS x FROM edges JOIN cc a ON a.spot_id = src JOIN cc c ON c.spot_id = dst AND a.b = c.b GROUP BY a.b) q JOIN (SELECT b, sum(v * v) AS ss FROM cc GROUP BY b) r USING (b)),
cal AS (SELECT max(i) FILTER (WHERE b < 0) AS o, avg(i) FILTER (WHERE b >= 0) AS nm, stddev_pop(i) FILTER (WHERE b >= 0) AS ns FROM m)"""


@query("perm_null_morans", f"{MORN} SELECT round(o, 6) AS observed, round(nm, 6) AS null_mean, round(ns, 6) AS null_std, round((o - nm) / ns, 4) AS z, (1e0 + (SELECT count(*) FROM m, cal WHERE b >= 0 AND i >= o)) / 9e0 AS p FROM cal")
def _(spark, sf):
    n = gates.permutation_null(ad.labels(ad.embedding_spots(spark, sf)), edges_of(spark, sf), "morans_i", 8, 5)
    return r6(n, "observed", "null_mean", "null_std").withColumn("z", F.round("z", 4))


@query("perm_null_coherence")
def _(spark, sf):
    n = gates.permutation_null(ad.labels(ad.embedding_spots(spark, sf)), edges_of(spark, sf), "coherence", 8, 5)
    return r6(n, "observed", "null_mean", "null_std").withColumn("z", F.round("z", 4))


@query("claim_gate", f"{MORN} SELECT o - nm >= 0.1 AND (o - nm) / ns >= 3 AS passed FROM cal")
def _(spark, sf):
    n = gates.permutation_null(ad.labels(ad.embedding_spots(spark, sf)), edges_of(spark, sf), "morans_i", 8, 5)
    return gates.claim_gate(n, 0.0).select("passed")


@query("coordinate_leakage")
def _(spark, sf):
    s = ad.embedding_spots(spark, sf)
    return r6(gates.coordinate_leakage(ad.labels(s), s), "ari")


@query("knee", """WITH e AS (SELECT n_regionkey AS pos, n_regionkey * 2 + 1 AS k, 10e0 / (n_regionkey + 1) + n_regionkey AS error FROM (SELECT DISTINCT n_regionkey FROM nation) q),
l AS (SELECT *, lag(error) OVER (ORDER BY pos) AS prev FROM e), o AS (SELECT *, bool_and(prev IS NULL OR (prev > 0 AND (prev - error) / abs(prev) >= 0.05)) OVER (ORDER BY pos) AS ok FROM l) SELECT arg_max(k, pos)::BIGINT AS k FROM o WHERE ok""")
def _(spark, sf):
    n = ad.table(spark, sf, "nation").select(F.col("n_regionkey").alias("pos")).distinct()
    e = n.select("pos", (F.col("pos") * 2 + 1).alias("k"), (10e0 / (F.col("pos") + 1) + F.col("pos")).alias("error"))
    return i64(gates.knee(e), "k")


# Runs and reports. Records: a document's quality by language and source stand for accuracy by dataset and variant.
REC = "rec AS (SELECT lang AS dataset, 's' || (doc_id % 5) AS variant, doc_id % 3 AS seed, avg(n_chars) / 1e4 AS ari, avg(doc_id) / 1e3 AS nmi FROM documents GROUP BY 1, 2, 3)"
CELL = "cell AS (SELECT dataset, variant, metric, avg(value) AS mean FROM (SELECT dataset, variant, 'ari' AS metric, ari AS value FROM rec UNION ALL SELECT dataset, variant, 'nmi', nmi FROM rec) q GROUP BY ALL)"
RANK = "ranked AS (SELECT *, rank() OVER (PARTITION BY dataset, metric ORDER BY mean DESC) + (count(*) OVER (PARTITION BY dataset, metric, mean) - 1) / 2e0 AS rank FROM cell)"


def records(spark, sf):
    d = ad.table(spark, sf, "documents")
    g = d.groupBy(F.col("lang").alias("dataset"), F.concat(F.lit("s"), F.pmod("doc_id", F.lit(5))).alias("variant"), F.pmod("doc_id", F.lit(3)).cast("long").alias("seed"))
    return g.agg((F.avg("n_chars") / 1e4).alias("ari"), (F.avg("doc_id") / 1e3).alias("nmi"))


@query("avg_tie_rank", f"WITH {REC}, {CELL}, {RANK} SELECT dataset, variant, metric, round(mean, 6) AS mean, rank FROM ranked")
def _(spark, sf):
    return r6(reports.average_ranks(reports.cell_means(records(spark, sf), ("ari", "nmi"))), "mean")


@query("mean_rank", f"WITH {REC}, {CELL}, {RANK} SELECT variant, round(avg(rank), 6) AS mean_rank, count(*)::BIGINT AS cells FROM ranked GROUP BY variant")
def _(spark, sf):
    return r6(reports.mean_ranks(reports.cell_means(records(spark, sf), ("ari", "nmi"))), "mean_rank")


@query("mean_std", f"WITH {REC} SELECT dataset, variant, 'ari' AS metric, round(avg(ari), 6) AS mean, round(stddev_pop(ari), 6) AS std, count(*)::BIGINT AS n FROM rec GROUP BY ALL")
def _(spark, sf):
    return r6(reports.mean_std(records(spark, sf), ("dataset", "variant"), ("ari",)), "mean", "std")


@query("leaderboard", f"WITH {REC}, s AS (SELECT variant, avg(ari) AS ari FROM rec GROUP BY variant) SELECT variant, round(ari, 6) AS ari, row_number() OVER (ORDER BY ari DESC, variant)::BIGINT AS rank FROM s")
def _(spark, sf):
    return r6(reports.leaderboard(records(spark, sf).groupBy("variant").agg(F.avg("ari").alias("ari")), "ari"), "ari")


@query("boxplot_series", f"WITH {REC} SELECT variant, round(quantile_cont(ari, 0.25), 6) AS q1, round(median(ari), 6) AS q2, round(quantile_cont(ari, 0.75), 6) AS q3 FROM rec GROUP BY variant")
def _(spark, sf):
    b = reports.box_series(records(spark, sf), ("variant",), "ari")
    return r6(b.select("variant", *(F.get("box", i).alias(f"q{i}") for i in (1, 2, 3))), "q1", "q2", "q3")


SWEEP = "sw AS (SELECT doc_id % 7 / 2e0 AS lam, doc_id AS seed, n_chars / 1e4 AS ari, n_chars % 11 / 1e1 AS sf FROM documents), agg AS (SELECT lam, avg(ari) AS mean_ari, stddev_pop(ari) AS std_ari, arg_min(sf, seed) AS smooth_fraction FROM sw GROUP BY lam)"


def sweep(spark, sf):
    d = ad.table(spark, sf, "documents")
    rows = d.select((F.pmod("doc_id", F.lit(7)) / 2e0).alias("lam"), F.col("doc_id").alias("seed"), (F.col("n_chars") / 1e4).alias("ari"), (F.pmod("n_chars", F.lit(11)) / 1e1).alias("smooth_fraction"))
    return reports.sweep_summary(rows)


@query("sweep_agg", f"WITH {SWEEP} SELECT lam, round(mean_ari, 6) AS mean_ari, round(std_ari, 6) AS std_ari, smooth_fraction FROM agg")
def _(spark, sf):
    return r6(sweep(spark, sf), "mean_ari", "std_ari")


@query("recommend_lam", f"WITH {SWEEP} SELECT lam, round(mean_ari, 6) AS mean_ari, std_ari <= 0.3 AS stable FROM agg ORDER BY std_ari <= 0.3 DESC, mean_ari DESC, lam LIMIT 1")
def _(spark, sf):
    return r6(reports.recommend_lam(sweep(spark, sf), 0.3).select("lam", "mean_ari", "stable"), "mean_ari")


@query("pearson_regression", "SELECT round(corr(s_acctbal, s_nationkey), 6) AS r, round(regr_slope(s_nationkey, s_acctbal), 9) AS slope, round(regr_intercept(s_nationkey, s_acctbal), 6) AS intercept FROM supplier")
def _(spark, sf):
    s = ad.table(spark, sf, "supplier").select(F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return r6(reports.regression(s), "r", "intercept").withColumn("slope", F.round("slope", 9))


@query("coassociation", f"WITH {RUNS}, w AS (SELECT * FROM runs WHERE method = 'wild') SELECT a.spot_id AS i, b.spot_id AS j, round(count(*) / 3e0, 6) AS share FROM w a JOIN w b ON a.seed = b.seed AND a.label = b.label AND a.spot_id < b.spot_id GROUP BY 1, 2")
def _(spark, sf):
    r = ad.runs(spark, sf).where("method = 'wild'").select(F.col("seed").alias("run"), "spot_id", "label")
    return reports.coassociation(r, 3, digits=6)


@query("survival", f"WITH {RUNS}, w AS (SELECT seed, spot_id, r.label AS g, e.label AS label FROM runs r JOIN embeddings e ON vec_id = spot_id WHERE method = 'wild') SELECT a.label::VARCHAR AS label, round(avg((a.g = b.g)::INT::DOUBLE), 6) AS survival FROM w a JOIN w b ON a.seed = b.seed AND a.label = b.label AND a.spot_id <> b.spot_id GROUP BY a.label")
def _(spark, sf):
    r = ad.runs(spark, sf).where("method = 'wild'").select(F.col("seed").alias("run"), "spot_id", "label")
    return r6(reports.survival(ad.labels(ad.embedding_spots(spark, sf)), r, 3), "survival")


@query("ablation_norm_stats", f"""WITH {SUP}, {NORM}, v AS (SELECT 'none' AS scheme, value AS v FROM sup UNION ALL SELECT 'log1p', ln(1 + value) FROM sup UNION ALL SELECT 'cp_target', ln(1 + value / t * 1e4) FROM sup JOIN tot USING (spot_id)
UNION ALL SELECT 'total_log1p', ln(1 + value / t * (SELECT median(t) FROM tot)) FROM sup JOIN tot USING (spot_id)) SELECT scheme, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM v GROUP BY scheme""")
def _(spark, sf):
    x, out = ad.supplier_counts(spark, sf), None
    for name, f in prep.SCHEMES.items():
        one = f(x).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).withColumn("scheme", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return r6(out, "mean", "std")


# Models. The unrolled SQL repeats the updates in long form.
def _unrolled(iters: int, k: int, lam: bool) -> str:
    x = "x AS (SELECT spot_id, gene_id, value FROM expr)"
    base = f"WITH {G}, {BOTH}, {EXPR}, {x}, st AS (SELECT sum(value) / (62e0 * (SELECT count(*) FROM spots)) AS m, sqrt(sum(value * value) / (62e0 * (SELECT count(*) FROM spots))) AS rms FROM x), deg AS (SELECT src AS spot_id, count(*) AS d FROM both_ways GROUP BY src)"
    if lam:
        start = lambda tag, key: "(" + U.format(f"'0:{tag}:' || {key} || ':' || k") + f" + 1e-12) * (sqrt(greatest(m, 1e-12)) / sqrt({k}e0))"
        eps, l = "1e-12", "(SELECT rms FROM st)"
    else:
        start = lambda tag, key: "(0.1e0 + 0.9e0 * (" + U.format(f"'0:{tag}:' || {key} || ':' || k") + ") + 1e-12)"
        eps, l = "1e-9", "0e0"
    base += f", h0 AS MATERIALIZED (SELECT spot_id, k, {start('H', 'spot_id')} AS v FROM spots, range({k}) t(k), st), w0 AS MATERIALIZED (SELECT g AS gene_id, k, {start('W', 'g')} AS v FROM range(62) u(g), range({k}) t(k), st)"
    for i in range(iters):
        base += f""", xw{i} AS MATERIALIZED (SELECT spot_id, k, sum(value * v) AS v FROM x JOIN w{i} USING (gene_id) GROUP BY 1, 2), ww{i} AS MATERIALIZED (SELECT a.k AS i, b.k AS j, sum(a.v * b.v) AS v FROM w{i} a JOIN w{i} b USING (gene_id) GROUP BY 1, 2),
ah{i} AS MATERIALIZED (SELECT src AS spot_id, k, sum(v) AS v FROM both_ways JOIN h{i} ON dst = spot_id GROUP BY 1, 2), dn{i} AS MATERIALIZED (SELECT spot_id, j AS k, sum(h.v * ww.v) AS v FROM h{i} h JOIN ww{i} ww ON h.k = ww.i GROUP BY 1, 2),
h{i + 1} AS MATERIALIZED (SELECT h.spot_id, h.k, h.v * (coalesce(xw.v, 0) + {l} * coalesce(ah.v, 0)) / (dn.v + {l} * coalesce(d, 0) * h.v + {eps}) AS v FROM h{i} h LEFT JOIN xw{i} xw USING (spot_id, k) LEFT JOIN ah{i} ah USING (spot_id, k) LEFT JOIN dn{i} dn USING (spot_id, k) LEFT JOIN deg USING (spot_id)),
xh{i} AS MATERIALIZED (SELECT gene_id, k, sum(value * v) AS v FROM x JOIN h{i + 1} USING (spot_id) GROUP BY 1, 2), hh{i} AS MATERIALIZED (SELECT a.k AS i, b.k AS j, sum(a.v * b.v) AS v FROM h{i + 1} a JOIN h{i + 1} b USING (spot_id) GROUP BY 1, 2),
dw{i} AS MATERIALIZED (SELECT gene_id, j AS k, sum(w.v * hh.v) AS v FROM w{i} w JOIN hh{i} hh ON w.k = hh.i GROUP BY 1, 2),
w{i + 1} AS MATERIALIZED (SELECT w.gene_id, w.k, w.v * coalesce(xh.v, 0) / (dw.v + {eps}) AS v FROM w{i} w LEFT JOIN xh{i} xh USING (gene_id, k) LEFT JOIN dw{i} dw USING (gene_id, k))"""
    return base


@query("gnmf_2iter", _unrolled(2, 3, True) + " SELECT spot_id, k, round(v, 6) AS v FROM h2")
def _(spark, sf):
    fit = models.fit_nmf(ad.embedding_expr(spark, sf), edges_of(spark, sf), ad.embedding_spots(spark, sf), 62, 3, n_iter=2, tol=0)
    return r6(i64(models.long_scores(fit.h), "k"), "v")


@query("gnmf_loadings", _unrolled(2, 3, True) + " SELECT gene_id, k, round(v, 6) AS w FROM w2")
def _(spark, sf):
    fit = models.fit_nmf(ad.embedding_expr(spark, sf), edges_of(spark, sf), ad.embedding_spots(spark, sf), 62, 3, n_iter=2, tol=0)
    return r6(i64(models.long_loadings(fit.w), "k"), "w")


@query("nmf_2iter", _unrolled(2, 3, False) + " SELECT spot_id, k, round(v, 6) AS v FROM h2")
def _(spark, sf):
    fit = models.plain_nmf(ad.embedding_expr(spark, sf), ad.embedding_spots(spark, sf), 62, 3, n_iter=2)
    return r6(i64(models.long_scores(fit.h), "k"), "v")


KM = f"""WITH pts AS (SELECT vec_id AS id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE] AS h FROM embeddings), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {U.format("'0:0:' || id")}, id) - 1 AS c, h FROM pts QUALIFY c < 4)""" + "".join(
    f""", a{i} AS MATERIALIZED (SELECT id, pts.h, c, d2 FROM (SELECT id, pts.h, c, (pts.h[1] - k.h[1]) ** 2 + (pts.h[2] - k.h[2]) ** 2 AS d2, row_number() OVER (PARTITION BY id ORDER BY (pts.h[1] - k.h[1]) ** 2 + (pts.h[2] - k.h[2]) ** 2, c) AS r FROM pts, c{i} k) pts WHERE r = 1),
c{i + 1} AS MATERIALIZED (SELECT c, [avg(h[1]), avg(h[2])] AS h FROM a{i} GROUP BY c)""" for i in range(4)
)


@query("kmeans_3iter", KM.replace("pts.h, c, d2 FROM (SELECT id, pts.h, c,", "h, c, d2 FROM (SELECT id, pts.h, c,") + " SELECT id, c::BIGINT AS label FROM a3")
def _(spark, sf):
    p = ad.embedding_points(spark, sf).select("id", F.slice("h", 1, 2).alias("h"))
    return i64(kmeans(p, 4, n_init=1, max_iter=3).labels.select("id", "label"), "label")


@query("gnmf_domains")
def _(spark, sf):
    out, _ = models.run_domain_detection(ad.embedding_expr(spark, sf), ad.embedding_spots(spark, sf), 62, n_iter=5)
    return out.domains


@query("projection_domains")
def _(spark, sf):
    s = ad.embedding_spots(spark, sf)
    return models.projection_model(ad.embedding_expr(spark, sf), s, graph.knn_directed(s, 6), 62).domains


@query("smooth_domains")
def _(spark, sf):
    return models.spatial_smooth_domains(ad.embedding_expr(spark, sf), edges_of(spark, sf), ad.embedding_spots(spark, sf), 62, components=4)[0]


@query("coordinate_domains")
def _(spark, sf):
    return models.coordinate_domains(ad.embedding_spots(spark, sf))


@query("integration_scores")
def _(spark, sf):
    p = ad.embedding_points(spark, sf)
    before, after = p, p.withColumn("h", F.slice("h", 1, 8))
    labelled = lambda df: df.select("id", "h", F.pmod("id", F.lit(4)).alias("section"), F.col("label").alias("domain"))
    b, a = (cut(spatial.silhouettes(labelled(df), ("section", "domain"))) for df in (before, after))
    scores = reports.integration_scorecard(b.select("section"), a.select("section"), b.select("domain"), a.select("domain"))
    return r6(scores, "mixing", "mixing_gain", "conservation", "conservation_gain", "overall")
