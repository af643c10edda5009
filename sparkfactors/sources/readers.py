"""Reading spots, values, runs and metrics, and checking what was read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.concordance import has_label

#: Where ground truth may stand, first choice first, for the runner and for the slide loader (fixed values).
RUNNER_KEYS = ("layer_guess", "layer_guess_reordered_short", "ground_truth_domain", "ground_truth", "spatial_domain")
LOADER_KEYS = ("layer_guess_reordered_short", "layer_guess_reordered", "layer_guess", "spatialLIBD", "Layer", "layer")


class SchemaError(ValueError):
    """Input or output breaks an invariant."""


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table by its ending: .csv with a header, .json by line, else Parquet."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def truth_column(df: DataFrame, keys: tuple[str, ...] = LOADER_KEYS, explicit: str | None = None) -> str | None:
    """The explicit column, which must exist, or the first of keys that does; None without one."""
    if explicit is not None:
        if explicit not in df.columns:
            raise KeyError(explicit)
        return explicit
    return next((k for k in keys if k in df.columns), None)


def with_truth(df: DataFrame, keys: tuple[str, ...] = LOADER_KEYS, explicit: str | None = None) -> DataFrame:
    """ground_truth_domain: the truth column, as it is, as a string."""
    key = truth_column(df, keys, explicit)
    if key is None:
        raise KeyError("no ground-truth column")
    return df.withColumn("ground_truth_domain", F.col(key).cast("string"))


def load_slide(spark: SparkSession, path: str, source_key: str | None = None) -> DataFrame:
    """A spot table with coordinates x, y and ground_truth_domain."""
    df = read(spark, path)
    if not {"x", "y"} <= set(df.columns):
        raise KeyError("no coordinates x, y")
    return with_truth(df, explicit=source_key)


def prepared_counts(spots: DataFrame, expr: DataFrame, label: str = "ground_truth_domain") -> DataFrame:
    """n_spots, n_genes, n_labeled, n_classes."""
    ok = has_label(F.col(label))
    s = spots.agg(F.count("*").alias("n_spots"), F.count_if(ok).alias("n_labeled"), F.count_distinct(F.when(ok, F.col(label))).alias("n_classes"))
    return s.withColumn("n_genes", expr.agg(F.count_distinct("gene_id")).scalar())


def stack_sections(blocks: list[tuple[DataFrame, DataFrame | None, DataFrame | None]]) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Spots, values and edges of sections (spots with local_id, maybe section_id; the place in the list by default) in
    one id space: ids go up by the number of spots before."""
    spots, exprs, edges, before = [], [], [], 0
    for i, (s, x, e) in enumerate(blocks):
        section = F.col("section_id").cast("long") if "section_id" in s.columns else F.lit(i).cast("long")
        move = lambda c, n=before: (F.col(c) + n).cast("long")
        spots.append(s.select(move("local_id").alias("spot_id"), section.alias("section_id"), *(c for c in s.columns if c not in ("local_id", "section_id"))))
        if x is not None:
            exprs.append(x.select(move("local_id").alias("spot_id"), "gene_id", F.col("value").cast("double").alias("value")))
        if e is not None:
            edges.append(e.select(move("src").alias("src"), move("dst").alias("dst")))
        before += s.count()
    join = lambda parts: reduce(DataFrame.unionByName, parts) if parts else None
    return join(spots), join(exprs), join(edges)


def input_violations(spots: DataFrame, expr: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """check, n: how many rows break each invariant of the inputs."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    known = spots.select("spot_id").distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("spot_id"))
    out = [
        spots.agg(F.lit("coordinates").alias("check"), F.count_if(bad("x") | bad("y")).alias("n")),
        spots.agg(F.lit("section").alias("check"), F.count_if(F.col("section_id").isNull() | (F.col("section_id") < 0)).alias("n")),
        spots.agg(F.lit("spot_ids").alias("check"), (F.count("*") - F.count_distinct("spot_id")).alias("n")),
        expr.agg(F.lit("values").alias("check"), F.count_if(bad("value")).alias("n")),
        ends.join(known, "spot_id", "left_anti").agg(F.lit("edge_ends").alias("check"), F.count("*").alias("n")),
    ]
    if strict:
        a, b = (spots.select(F.col("spot_id").alias(k), F.col("section_id").alias(f"s_{k}")) for k in ("src", "dst"))
        out += [
            edges.agg(F.lit("self_loops").alias("check"), F.count_if(F.col("src") == F.col("dst")).alias("n")),
            edges.agg(F.lit("repeated_edges").alias("check"), (F.count("*") - F.count_distinct("src", "dst")).alias("n")),
            edges.join(a, "src").join(b, "dst").agg(F.lit("cross_section").alias("check"), F.count_if(F.col("s_src") != F.col("s_dst")).alias("n")),
            spots.agg(F.lit("section_gaps").alias("check"), (F.max("section_id") + 1 - F.count_distinct("section_id")).alias("n")),
        ]
    return reduce(DataFrame.unionByName, out)


def validate_inputs(spots: DataFrame, expr: DataFrame, edges: DataFrame, strict: bool = False) -> None:
    if found := input_violations(spots, expr, edges, strict).where("n > 0").collect():
        raise SchemaError(", ".join(f"{x['check']}: {x['n']}" for x in found))


def validate_outputs(scores: DataFrame, loadings: DataFrame, domains: DataFrame) -> None:
    """Finite scores (spot_id, k, v), finite nonnegative loadings (gene_id, k, w), domains (spot_id, domain_id >= 0)."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    n = {
        "scores": scores.where(bad("v")).count(), "loadings": loadings.where(bad("w") | (F.col("w") < 0)).count(),
        "domains": domains.where("domain_id IS NULL OR domain_id < 0").count(),
        "factors": abs(scores.select("k").distinct().count() - loadings.select("k").distinct().count()),
    }
    if any(n.values()):
        raise SchemaError(str(n))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """method, seed, name, value of metrics.json files in folders <method>_seed<N>, nested below "metrics" or flat."""
    files = spark.read.text(f"{root}/*_seed*/metrics.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    folder = F.element_at(F.split("path", "/"), -2)
    parsed = F.coalesce(F.from_json(F.get_json_object("value", "$.metrics"), "map<string,string>"), F.from_json("value", "map<string,string>"))
    rows = files.select(F.regexp_extract(folder, r"^(.+)_seed(\d+)$", 1).alias("method"), F.regexp_extract(folder, r"^(.+)_seed(\d+)$", 2).alias("seed"), F.explode(parsed).alias("name", "value"))
    return rows.where("method <> ''").select("method", F.col("seed").cast("long").alias("seed"), "name", F.col("value").try_cast("double").alias("value"))


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of JSON files that each hold a list, one after the other."""
    df = spark.read.option("multiLine", True).json(paths)
    if "_corrupt_record" in df.columns:
        raise ValueError("not a list of records")
    return df


def card_ids(paths: DataFrame) -> DataFrame:
    """card_id: the folders right above the files of (path), distinct, sorted, joined by +."""
    return paths.agg(F.array_join(F.array_sort(F.collect_set(F.element_at(F.split("path", "/"), -2))), "+").alias("card_id"))


# Registered datasets (fixed values): id, tier, landing page, bytes if known.
REGISTRY = (
    ("cervilla_2026_visium", "A", "https://zenodo.org/records/17999961"), ("cervilla_2026_xenium_cosmx", "A", "https://zenodo.org/records/17986017"),
    ("cervilla_2026_xenium_mt_5k", "A", "https://zenodo.org/records/18000256"), ("dawo_tls_visium", "A", "https://zenodo.org/records/14620362"),
    ("gse175540_rcc_visium", "A", "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=GSE175540"), ("hest1k_cancer_subset", "A", "https://huggingface.co/datasets/MahmoodLab/hest"),
    ("xenium_breast_janesick", "A", "https://www.10xgenomics.com/products/xenium-in-situ/preview-dataset-human-breast"),
    ("gse293199_tnbc_xenium", "A", "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=GSE293199"), ("dlpfc_maynard_2021", "B", "https://figshare.com/articles/dataset/22004273"),
    ("visium_mouse_brain_pair", "B", "https://squidpy.readthedocs.io/en/stable/api/squidpy.datasets.visium_hne_adata.html"),
    ("merfish_hypothalamus_shared", "B", "https://squidpy.readthedocs.io/en/stable/api/squidpy.datasets.merfish.html"), ("wu_2021_breast_visium", "extended", "https://zenodo.org/records/4739739"),
    ("ji_2020_scc_st", "extended", "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=GSE144240"), ("wang_2025_ist_ffpe_xenium", "A", "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=GSE308148"),
    ("wang_2025_ist_ffpe_merscope", "A", "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=GSE308147"), ("wang_2025_ist_ffpe_cosmx", "A", "https://www.ncbi.nlm.nih.gov/geo/query/acc.cgi?acc=GSE308146"),
)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGISTRY), "id string, tier string, landing_url string")


def fetch_plan(dataset: str) -> dict:
    """What fetching a dataset would do; nothing is fetched, as no file's address is verified."""
    row = next((r for r in REGISTRY if r[0] == dataset), None)
    if row is None:
        raise KeyError(dataset)
    return {"id": row[0], "tier": row[1], "from": row[2], "verified": False}
