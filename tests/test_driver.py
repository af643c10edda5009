"""Runs from tables to results, and their command line."""

import json
import random

import pytest

from sparkfactors.plans import driver


@pytest.fixture(scope="module")
def slide(spark, tmp_path_factory):
    """A lattice of three stripes, each with genes of its own; some labels missing."""
    r, folder = random.Random(4), str(tmp_path_factory.mktemp("slide"))
    spots, expr = [], []
    for i in range(10):
        for j in range(9):
            n, stripe = len(spots), j // 3
            spots.append((n, float(j), float(i), "NA" if n % 17 == 0 else f"L{stripe}"))
            expr += [(n, g, float(r.randint(6, 12) if g // 4 == stripe else r.randint(0, 2))) for g in range(12)]
    spark.createDataFrame(spots, "spot_id long, x double, y double, layer_guess string").write.parquet(f"{folder}/spots.parquet")
    spark.createDataFrame([x for x in expr if x[2]], "spot_id long, gene_id long, value double").write.parquet(f"{folder}/expr.parquet")
    return folder


def bundle(out):
    with open(f"{out}/run/metrics.json") as f:
        return json.load(f)["metrics"]


def test_a_run_its_results_and_what_another_setting_repeats(spark, slide, tmp_path):
    out = str(tmp_path)
    config = {"model": "gnmf", "k_shared": 2, "k_private": 1, "n_domains": 3, "n_iter": 12, "n_null_shuffles": 4}
    done = driver.run_dataset(spark, slide, out, driver.RunConfig(**config))
    assert done["computed"] == ["inputs", "preprocess", "graph", "fit", "scores"] and not done["reused"]
    m = bundle(out)
    assert m["ari_domain"] > 0.9 and m["ari_vs_gt_available"] == m["dataset_class_is_a"] == 1.0 and m["domain_clustering_degenerate"] == 0.0
    assert m["morans_i_domain_delta"] > 0.3 and m["gnmf_objective_final"] < m["gnmf_objective_initial"] and m["gnmf_n_iter_run"] <= 12
    assert m["runtime_s"] > 0 and m["peak_memory_mb"] > 0 and m["cpu_seconds"] > 0 and {"nmi_domain", "weighted_dice_domain", "boundary_f1_domain", "silhouette_domain"} <= m.keys()
    assert spark.read.parquet(f"{out}/run/outputs/domains").count() == 90
    again = driver.run_dataset(spark, slide, out, driver.RunConfig(**config))
    assert again["computed"] == [] and bundle(out) == m
    plain = {"model": "coords", "n_domains": 3, "n_null_shuffles": 0, "dataset_class": "B"}
    other = driver.run_dataset(spark, slide, out, driver.RunConfig(**plain), "control")
    assert other["computed"] == ["fit", "scores"] and other["reused"] == ["inputs", "preprocess", "graph"]
    other = driver.run_dataset(spark, slide, out, driver.RunConfig(**plain | {"knn": 4}), "control")
    assert other["computed"] == ["graph", "fit", "scores"] and other["reused"] == ["inputs", "preprocess"]
    more = driver.further_metrics(spark, slide, out, driver.RunConfig(**config))
    assert {"pas", "pas_null", "pas_delta", "chaos", "ari_domain"} <= more.keys() and bundle(out) == more
    with open(f"{out}/run/run_metadata.json") as f:
        meta = json.load(f)
    assert meta["stages"]["graph"]["key"] and meta["normalization"]["method"] == "normalize_total+log1p" and meta["settings"]["knn"] == 6


def test_a_model_by_the_command_line(spark, slide, tmp_path, capsys):
    args = ["run", "--data", slide, "--out", str(tmp_path), "--model", "projection", "--n-domains", "3", "--n-null-shuffles", "0", "--dataset-class", "B"]
    assert driver.main(args, spark) == 0
    said, m = json.loads(capsys.readouterr().out), bundle(tmp_path)
    assert said["paths"]["metrics"].endswith("metrics.json")
    assert m["gt_metrics_gated"] == 1.0 and "ari_domain" not in m and "shared_mean_active_sections" in m


def test_wide_values_take_the_range_finder(spark, slide, tmp_path, monkeypatch):
    monkeypatch.setattr(driver, "WIDE", 1)
    config = driver.RunConfig(model="spatial_smooth", n_domains=3, n_null_shuffles=0, smooth_components=3)
    driver.run_dataset(spark, slide, str(tmp_path), config)
    assert bundle(tmp_path)["ari_domain"] > 0.5 and bundle(tmp_path)["morans_i_domain_null"] is None


def test_tables_of_experiments_by_the_command_line(spark, tmp_path, capsys):
    small = ["--n-spots-per-section", "20", "--n-genes", "12", "--n-iter", "3", "--k-shared", "2", "--n-domains", "2"]
    assert driver.main(["seed-stability", "--out", str(tmp_path), *small, "--seeds", "0", "1"], spark) == 0
    assert driver.main(["scalability", "--out", str(tmp_path), "--sizes", "20x8", "40x8", "--n-iter", "2"], spark) == 0
    tables = {n: json.loads((tmp_path / f"{n}.json").read_text()) for n in ("seed-stability", "scalability")}
    assert len(tables["seed-stability"]["rows"]) == 1 and [r[0] for r in tables["scalability"]["rows"]] == [40, 80] and "power" in tables["scalability"]["note"]
    capsys.readouterr()


def test_settings_are_checked():
    with pytest.raises(ValueError):
        driver.RunConfig(model="other")
    with pytest.raises(SystemExit):
        driver.parse(["run", "--data", "x"])
    a = driver.parse(["run", "--data", "x", "--out", "y", "--already-normalized", "--pitch", "2.5", "--knn", "4"])
    assert (a.already_normalized, a.pitch, a.knn, a.model) == (True, 2.5, 4, "projection")
