"""Runs from tables to results: resumable stages, metrics with what they cost, and a command line over them."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import concordance, factors, spatial
from ..operators import lattice, linalg, models
from ..operators.wide_pca import wide_pca
from ..sources import readers, sinks
from . import experiments, gates, runner
from .resume import Stages

MODELS = ("projection", "gnmf", "spatial_smooth", "coords")
#: From so many genes on, components come from a range finder instead of a genes x genes matrix.
WIDE = 2000


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run; defaults are fixed values of the surveyed runner."""

    model: str = "projection"
    knn: int = 6
    coord_type: str = "generic"
    pitch: float | None = None
    seed: int = 0
    d: int = 16
    k_shared: int = 4
    k_private: int = 2
    n_domains: int = 5
    n_null_shuffles: int = 10
    already_normalized: bool = False
    target_sum: float = 1e4
    n_hvg: int = 0
    gt_key: str | None = None
    dataset_class: str | None = None
    lam: float = 1.0
    n_iter: int = 200
    tol: float = 1e-4
    smooth_alpha: float = 0.5
    smooth_hops: int = 2
    smooth_components: int = 16

    def __post_init__(self):
        if self.model not in MODELS:
            raise ValueError(f"model {self.model!r} is none of {', '.join(MODELS)}")


def _inputs(spark: SparkSession, source: str, config: RunConfig) -> dict[str, DataFrame]:
    """Tables spots and expr below source; spots get section_id 0 and gt where they have none."""
    spots, expr = readers.read(spark, f"{source}/spots.parquet"), readers.read(spark, f"{source}/expr.parquet")
    key = readers.truth_column(spots, readers.RUNNER_KEYS, config.gt_key)
    gt = F.col(key).cast("string") if key else F.lit(None).cast("string")
    section = F.col("section_id").cast("long") if "section_id" in spots.columns else F.lit(0).cast("long")
    place = [c for c in ("row", "col") if c in spots.columns]
    kept = spots.select(F.col("spot_id").cast("long").alias("spot_id"), section.alias("section_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), gt.alias("gt"), *place)
    values = expr.select(F.col("spot_id").cast("long").alias("spot_id"), F.col("gene_id").cast("long").alias("gene_id"), F.col("value").cast("double").alias("value"))
    return {"spots": kept, "expr": values}


def _fit(config: RunConfig, expr: DataFrame, edges: DataFrame, spots: DataFrame, n_genes: int) -> dict[str, DataFrame]:
    """embedding (id, h), domains (spot_id, label), and for factor models shared and private scores, loadings; for the
    trained one the trace (it, objective)."""
    c, spark = config, spots.sparkSession
    points = lambda df: df.select(F.col("spot_id").alias("id"), "h")
    named = lambda df: df.select("spot_id", F.col("domain_id").alias("label"))
    if c.model == "coords":
        return {"embedding": models.standard_points(spots.select("spot_id", F.array("x", "y").alias("h"))), "domains": named(models.coordinate_domains(spots, c.n_domains, c.seed))}
    if c.model == "spatial_smooth":
        if n_genes < WIDE:
            found, embedding = models.spatial_smooth_domains(expr, edges, spots, n_genes, n_domains=c.n_domains, components=c.smooth_components, alpha=c.smooth_alpha, hops=c.smooth_hops, seed=c.seed)
            return {"embedding": embedding, "domains": named(found)}
        v = models.graph.smooth(edges, expr.select("spot_id", "gene_id", F.col("value").alias("v")), "gene_id", c.smooth_alpha, c.smooth_hops)
        embedding = wide_pca(v.withColumnRenamed("v", "value"), spots, c.smooth_components, seed=c.seed).scores
        found = models.kmeans(embedding, c.n_domains, seed=c.seed).labels
        return {"embedding": embedding, "domains": found.select(F.col("id").alias("spot_id"), F.col("label").cast("long").alias("label"))}
    if c.model == "gnmf":
        out = models.gnmf_domains(expr, edges, spots, n_genes, shared=c.k_shared, private=c.k_private, n_domains=c.n_domains, lam=c.lam, n_iter=c.n_iter, tol=c.tol, seed=c.seed)
        trace = spark.createDataFrame(list(enumerate(map(float, out.fit.trace))), "it int, objective double")
        return {"embedding": points(out.scores), "domains": named(out.domains), "shared": out.shared, "private": out.private, "loadings": out.loadings, "trace": trace}
    out = models.projection_model(expr, spots, edges, n_genes, shared=c.k_shared, private=c.k_private, n_domains=c.n_domains, d=c.d, seed=c.seed)
    return {"embedding": points(out.scores), "domains": named(out.domains), "shared": out.shared, "private": out.private, "loadings": out.loadings}


def _scores(config: RunConfig, spots: DataFrame, edges: DataFrame, fit: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """metrics (name, value) and policy (one row)."""
    spark, domains, values = spots.sparkSession, fit["domains"], {}
    policy = gates.eval_policy(gates.ground_truth(spots.select("spot_id", "gt")), config.dataset_class)
    say = policy.first()
    number = domains.select("spot_id", F.col("label").cast("double").alias("v"), F.lit("d").alias("k"))
    for name, metric, observed in (
        ("morans_i_domain", "morans_i", spatial.morans_i(number, edges, "k").select("i")), ("coherence_label_invariant_domain", "coherence", spatial.coherence(domains, edges)),
    ):
        seen = observed.first()
        values[name] = seen[0] if seen else None
        values[f"{name}_null"] = gates.permutation_null(domains, edges, metric, config.n_null_shuffles, config.seed).first()["null_mean"] if config.n_null_shuffles else None
        values[f"{name}_delta"] = None if None in (values[name], values[f"{name}_null"]) else values[name] - values[f"{name}_null"]
    found = domains.select("label").distinct().count()
    values |= {"domain_clustering_degenerate": float(found <= 1), "n_edges": float(edges.count()), "dataset_class_is_a": float(say["dataset_class"] == "A"), "gt_metrics_gated": float(not say["emitted"])}
    if "shared" in fit:
        active = lambda z: factors.shared_private_separation(z, spots).first()[0]
        values |= {"shared_mean_active_sections": active(fit["shared"]), "private_mean_active_sections": active(fit["private"])}
        k = config.k_shared + config.k_private if config.model == "gnmf" else config.d
        values["factor_rank"] = float(runner.factor_rank(fit["embedding"].withColumnRenamed("id", "spot_id"), k))
        values["loading_sparsity"] = runner.loading_sparsity(fit["loadings"]).first()[0]
    ari = runner.truth_ari(spots.select("spot_id", "gt"), domains).first() if say["emitted"] else None
    values["ari_vs_gt_available"] = float(bool(ari) and ari["ari"] is not None)
    suite = None
    if say["emitted"]:
        suite = runner.truth_suite(spots.select("spot_id", "gt"), domains, fit["embedding"], edges).first()
        pairs = runner.labelled(spots.select("spot_id", "gt"), domains)
        if ari and ari["ari"] is not None:
            values |= {"ari_domain": ari["ari"], "ami_domain": concordance.ami(pairs).first()["ami"]}
    values["domain_metric_suite_available"] = float(suite is not None)
    if suite is not None:
        names = {"nmi": "nmi_domain", "dice": "weighted_dice_domain", "precision": "boundary_precision_domain", "recall": "boundary_recall_domain", "f1": "boundary_f1_domain", "silhouette": "silhouette_domain", "ch": "calinski_harabasz_domain"}
        values |= {new: suite[old] for old, new in names.items()}
    if "trace" in fit:
        trace = [r["objective"] for r in fit["trace"].orderBy("it").collect()]
        values |= {"gnmf_objective_initial": trace[0], "gnmf_objective_final": trace[-1], "gnmf_n_iter_run": float(len(trace) - 1), "gnmf_lam": float(config.lam)} if trace else {}
    return {"metrics": spark.createDataFrame([(k, None if v is None else float(v)) for k, v in values.items()], "name string, value double"), "policy": policy}


def run_dataset(spark: SparkSession, source: str, folder: str, config: RunConfig = RunConfig(), project: str = "run") -> dict[str, object]:
    """Fit and score the dataset below source (spots.parquet, expr.parquet), and write metrics, metadata and outputs
    below folder. Stages are kept in folder/stages: a run that was stopped goes on with the first stage it lacks, another
    setting repeats only what depends on it. Returns where results are, and which stages were computed and reused.
    """
    c, stages = config, Stages(spark, f"{folder}/stages")
    stages.source("source", source)
    pick = lambda *names: {n: asdict(c)[n] for n in names}
    data = stages.run("inputs", ("source",), pick("gt_key"), lambda: _inputs(spark, source, c))
    n_genes = int((data["expr"].agg(F.max("gene_id")).first()[0] or -1) + 1)

    def prepared() -> dict[str, DataFrame]:
        x, done = runner.preprocess(data["expr"], data["spots"], n_genes, already_normalized=c.already_normalized, n_hvg=c.n_hvg, target=c.target_sum)
        return {"expr": x, "record": done}

    ready = stages.run("preprocess", ("inputs",), pick("already_normalized", "n_hvg", "target_sum"), prepared)

    def linked() -> dict[str, DataFrame]:
        if c.coord_type == "generic":
            return {"edges": models.graph.knn_undirected(data["spots"], c.knn, by_section=True)}
        return {"edges": lattice.spatial_graph(data["spots"], c.knn, c.coord_type, c.pitch)}

    edges = stages.run("graph", ("inputs",), pick("knn", "coord_type", "pitch"), linked)["edges"]
    readers.validate_inputs(data["spots"], ready["expr"], edges)
    about = {
        "projection": ("k_shared", "k_private", "d"), "gnmf": ("k_shared", "k_private", "lam", "n_iter", "tol"), "spatial_smooth": ("smooth_alpha", "smooth_hops", "smooth_components"), "coords": (),
    }[c.model]
    fit = stages.run("fit", ("preprocess", "graph"), pick("model", "seed", "n_domains", *about), lambda: _fit(c, ready["expr"], edges, data["spots"], n_genes))
    scored = stages.run("scores", ("inputs", "graph", "fit"), pick("n_null_shuffles", "seed", "dataset_class"), lambda: _scores(c, data["spots"], edges, fit))
    record, policy = ready["record"].first().asDict(), scored["policy"].first().asDict()
    cost = {k: sum(u[k] or 0 for u in stages.usage.values()) for k in ("wall_s", "task_s", "cpu_s", "shuffle_write_mb")}
    peaks = {k: max((u[k] or 0 for u in stages.usage.values()), default=0) for k in ("peak_execution_mb", "driver_heap_mb", "driver_rss_mb")}
    used = spark.createDataFrame([(n, float(v)) for n, v in (("runtime_s", cost["wall_s"]), ("task_seconds", cost["task_s"]), ("cpu_seconds", cost["cpu_s"]), ("shuffle_mb", cost["shuffle_write_mb"]), ("peak_memory_mb", peaks["driver_heap_mb"] + peaks["driver_rss_mb"]))], "name string, value double")
    metadata = {
        "dataset_paths": [source], "seed": c.seed, "runtime_s": cost["wall_s"], "settings": asdict(c), "normalization": record, "policy": policy,
        "stages": {n: {"key": stages.keys[n], "usage": u, "reused": n in stages.reused} for n, u in stages.usage.items()}, "reproducibility_level": "seeded",
    }
    outputs = {k: v for k, v in fit.items() if k != "trace"}
    paths = sinks.write_results(folder, project, "+".join(sorted({source.rstrip("/").split("/")[-1]})), scored["metrics"].unionByName(used), outputs, metadata)
    return {"paths": paths, "computed": stages.computed, "reused": stages.reused}


def further_metrics(spark: SparkSession, source: str, folder: str, config: RunConfig = RunConfig(), project: str = "run") -> dict[str, object]:
    """Null-calibrated PAS and CHAOS of a finished run's domains, beside its own metrics: new values over old."""
    spots, domains = _inputs(spark, source, config)["spots"], spark.read.parquet(f"{folder}/{project}/outputs/domains")
    near = models.graph.knn_directed(spots, config.knn)
    p, ch = gates.pas_null(domains, near, config.n_null_shuffles, config.seed).first(), runner.chaos_null(spots, domains, config.n_null_shuffles, config.seed).first()
    new = [(f"{n}_{k}" if k else n, float(r[c])) for n, r in (("pas", p), ("chaos", ch)) for k, c in (("", n), ("null", "null_mean"), ("delta", "delta")) if r[c] is not None]
    path = f"{folder}/{project}/metrics.json"
    with open(path) as f:
        bundle = json.load(f)
    old = spark.createDataFrame([(k, v) for k, v in bundle["metrics"].items()], "name string, value double")
    merged = sinks.merge_metrics(old, spark.createDataFrame(new, "name string, value double"))
    bundle["metrics"] = {r["name"]: sinks.coerce(r["value"]) for r in merged.collect()}
    sinks.atomic_json(path, bundle)
    return bundle["metrics"]


def _settings(parser: argparse.ArgumentParser) -> None:
    for name, f in RunConfig.__dataclass_fields__.items():
        flag, kind = f"--{name.replace('_', '-')}", {"int": int, "float": float, "float | None": float}.get(f.type, str)
        if f.type == "bool":
            parser.add_argument(flag, action="store_true")
        else:
            parser.add_argument(flag, type=kind, default=f.default)


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="sparkfactors", description="Runs over tables of spots and values.")
    sub = top.add_subparsers(dest="command", required=True)
    for name, text in (("run", "fit and score a dataset"), ("further", "add calibrated metrics to a finished run")):
        p = sub.add_parser(name, help=text)
        p.add_argument("--data", required=True, help="folder with spots.parquet and expr.parquet")
        p.add_argument("--out", required=True, help="folder of results, shared with the executors")
        p.add_argument("--project", default="run")
        _settings(p)
    for name, text in (("seed-stability", "agreement of fits that differ in their seed"), ("robustness-to-k", "stability over numbers of domains"), ("recovery-vs-batch", "recovery of planted factors as noise grows")):
        p = sub.add_parser(name, help=text)
        p.add_argument("--out", required=True, help="folder of the table")
        for f in ("n_sections", "n_spots_per_section", "n_genes", "k_shared", "k_private", "n_domains", "n_iter"):
            p.add_argument(f"--{f.replace('_', '-')}", type=int, default=getattr(experiments.Config, f))
        p.add_argument("--seeds", type=int, nargs="+", default=[0, 1, 2])
        p.add_argument("--noises", type=float, nargs="+", default=[0.5, 5.0, 15.0, 30.0])
        p.add_argument("--ks", type=int, nargs="+")
    p = sub.add_parser("scalability", help="time and memory of fits over planted sizes")
    p.add_argument("--out", required=True)
    p.add_argument("--sizes", nargs="+", default=["60x40", "120x40", "120x80"], help="spots of a section x genes")
    p.add_argument("--n-iter", type=int, default=30)
    return top.parse_args(argv)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """One of the commands of parse; prints what it wrote as JSON."""
    from ..session import configure
    from .measure import growth, measure_scalability, scalability_table

    a = parse(argv)
    spark = spark or configure(SparkSession.builder.appName(f"sparkfactors-{a.command}")).getOrCreate()
    if a.command in ("run", "further"):
        config = RunConfig(**{f: getattr(a, f) for f in RunConfig.__dataclass_fields__})
        done = (run_dataset if a.command == "run" else further_metrics)(spark, a.data, a.out, config, a.project)
        print(json.dumps(done, sort_keys=True, default=str))
        return 0
    if a.command == "scalability":
        rows = measure_scalability(spark, [tuple(map(int, s.split("x"))) for s in a.sizes], n_iter=a.n_iter)
        power = growth(rows).first()["slope"]
        table, note = scalability_table(rows), f"runtime grows as the values to the power {power:.2f}" if power is not None else ""
    else:
        names = ("n_sections", "n_spots_per_section", "n_genes", "k_shared", "k_private", "n_domains", "n_iter")
        config, note = experiments.Config(**{n: getattr(a, n) for n in names}), ""
        if a.command == "seed-stability":
            table = experiments.seed_stability(spark, config, tuple(a.seeds)).orderBy("i", "j")
        elif a.command == "robustness-to-k":
            table = experiments.robustness_to_k(spark, config, tuple(a.ks) if a.ks else None, tuple(a.seeds)).orderBy("k")
        else:
            table = experiments.recovery_vs_batch(spark, config, tuple(a.noises), a.seeds[0]).orderBy("pos")
    sinks.write_table(table, a.out, a.command, note)
    print(json.dumps({"table": f"{a.out}/{a.command}.json"}))
    return 0
