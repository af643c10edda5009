"""Usage of work, growth with size and runs that go on."""

import math

import pytest
from pyspark.sql import functions as F

from sparkfactors.plans import measure, resume


def test_usage_counts_the_stages_of_the_block(spark):
    with measure.measured(spark, "outer") as outer:
        spark.range(1000).count()
        with measure.measured(spark, "inner") as inner:
            spark.range(200_000).groupBy((F.col("id") % 977).alias("k")).agg(F.sum("id")).collect()
    spark.range(10).count()
    assert inner.jobs >= 1 and inner.stages >= 2 and inner.tasks >= inner.stages and inner.shuffle_write_mb > 0
    assert outer.jobs > inner.jobs and outer.stages >= inner.stages + 2 and outer.wall_s >= inner.wall_s > 0
    assert inner.cpu_s > 0 and inner.peak_execution_mb > 0 and inner.driver_heap_mb > 1 and inner.driver_rss_mb > 1 and not inner.forgotten_stages
    frame = inner.frame(spark)
    assert frame.count() == inner.stages and frame.agg(F.sum("tasks")).first()[0] == inner.tasks
    assert inner.metrics("x_")["x_tasks"] == inner.tasks


def test_usage_is_kept_when_the_work_fails(spark):
    with pytest.raises(ZeroDivisionError), measure.measured(spark) as u:
        spark.range(10).count()
        raise ZeroDivisionError
    assert u.jobs >= 1


def test_scalability_of_planted_sizes(spark):
    rows = measure.measure_scalability(spark, [(30, 12), (15, 12)], n_iter=2)
    table = measure.scalability_table(rows).collect()
    assert [(r["n_spots"], r["n_genes"]) for r in table] == [(30, 12), (60, 12)]
    assert all(r["runtime_s"] > 0 and r["peak_rss_mb"] > 0 for r in table)
    assert all(r["task_s"] > 0 and r["shuffle_mb"] > 0 for r in rows.collect())


def test_tables_curves_and_growth(spark):
    rows = spark.createDataFrame([(40, 8, 320, 4.0, None), (10, 8, 80, 1.0, float("nan")), (20, 8, 160, 2.0, 7.0)], "n_spots long, n_genes long, n_values long, runtime_s double, peak_rss_mb double")
    assert [tuple(r) for r in measure.scalability_table(rows).collect()] == [(10, 8, 1.0, None), (20, 8, 2.0, 7.0), (40, 8, 4.0, None)]
    curve = measure.scalability_curve(rows, "n_spots").collect()
    assert [r["size"] for r in curve] == [10, 20, 40] and math.isnan(curve[2]["peak_rss_mb"]) and curve[1]["peak_rss_mb"] == 7.0
    fit = measure.growth(rows).first()
    assert abs(fit["slope"] - 1) < 1e-9 and abs(fit["r"] - 1) < 1e-9
    with pytest.raises(ValueError):
        measure.scalability_curve(rows, "other")
    assert [measure.finite_float(x) for x in (1, 2.5, True, "3", None, float("inf"))] == [1.0, 2.5, None, None, None, None]


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path):
    source, ran = f"{tmp_path}/in", []
    spark.range(20).write.parquet(source)

    def go(folder, factor=2, die=None):
        s = resume.Stages(spark, folder)
        s.source("in", source)

        def step(name, build):
            def run():
                if die == name:
                    raise KeyboardInterrupt
                ran.append(name)
                return {"rows": build()}

            return run

        a = s.run("a", ("in",), {}, step("a", lambda: spark.read.parquet(source).withColumn("x", F.col("id") + 1)))["rows"]
        b = s.run("b", ("a",), {"factor": factor}, step("b", lambda: a.withColumn("y", F.col("x") * factor)))["rows"]
        c = s.run("c", ("a", "b"), {}, step("c", lambda: b.agg(F.sum("y").alias("total"))))["rows"]
        return s, c.first()["total"]

    folder = f"{tmp_path}/run"
    with pytest.raises(KeyboardInterrupt):
        go(folder, die="b")
    assert ran == ["a"]
    s, total = go(folder)
    assert (ran, total) == (["a", "b", "c"], 420) and s.reused == ["a"] and s.computed == ["b", "c"]
    s, total = go(folder)
    assert len(ran) == 3 and s.reused == ["a", "b", "c"] and total == 420 and s.usage["c"]["tasks"] > 0
    s, total = go(folder, factor=3)
    assert s.computed == ["b", "c"] and total == 630
    spark.range(1).write.mode("append").parquet(source)
    s, _ = go(folder)
    assert s.computed == ["a", "b", "c"]
    with pytest.raises(FileNotFoundError):
        resume.content_key(spark, f"{tmp_path}/nowhere")
