"""What a piece of work costs: time, work and memory of its Spark stages, and how that grows with the size."""

from __future__ import annotations

import math
import resource
import sys
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..operators import graph, models
from . import reports

MB = 1e6
STAGES = "job string, stage long, name string, tasks long, task_s double, cpu_s double, gc_s double, input_mb double, shuffle_read_mb double, shuffle_write_mb double, spill_mb double, peak_execution_mb double, peak_heap_mb double"


@dataclass
class Usage:
    """Sums over the stages that ran; peaks are of single stages, tasks or processes. Heaps of executors are polled with
    their heartbeats, so short work may have none (null); rss is of the driver's Python, heap of its JVM."""

    name: str
    wall_s: float = 0.0
    jobs: int = 0
    stages: int = 0
    tasks: int = 0
    task_s: float = 0.0
    cpu_s: float = 0.0
    gc_s: float = 0.0
    input_mb: float = 0.0
    shuffle_read_mb: float = 0.0
    shuffle_write_mb: float = 0.0
    spill_mb: float = 0.0
    peak_execution_mb: float = 0.0
    executor_heap_mb: float | None = None
    driver_heap_mb: float = 0.0
    driver_rss_mb: float = 0.0
    forgotten_stages: int = 0
    by_stage: list[tuple] = field(default_factory=list)

    def row(self) -> dict[str, float | int | str | None]:
        return {k: v for k, v in asdict(self).items() if k != "by_stage"}

    def metrics(self, prefix: str = "") -> dict[str, float]:
        """The numbers by name, for a run's metrics."""
        return {f"{prefix}{k}": float(v) for k, v in self.row().items() if isinstance(v, (int, float))}

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row per stage."""
        return spark.createDataFrame([(self.name, *r) for r in self.by_stage], STAGES)


def peak_rss_mb() -> float:
    """The most memory this process had; the unit of the system's figure differs between systems."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / (MB if sys.platform == "darwin" else MB / 1024)


@contextmanager
def measured(spark: SparkSession, name: str = "work") -> Iterator[Usage]:
    """Usage of what runs inside, complete when the block ends. Jobs are told apart by a tag, so blocks can nest; stages
    are read from the driver's status store, which keeps the last spark.ui.retainedStages of them."""
    jsc, tag, usage = spark.sparkContext._jsc.sc(), f"measured-{uuid.uuid4().hex}", Usage(name)
    pools = list(spark.sparkContext._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans())
    heap = [p for p in pools if p.getType().toString() == "Heap memory"]
    for p in heap:
        p.resetPeakUsage()
    spark.sparkContext.addJobTag(tag)
    began = time.perf_counter()
    try:
        yield usage
    finally:
        usage.wall_s = time.perf_counter() - began
        spark.sparkContext.removeJobTag(tag)
        jsc.listenerBus().waitUntilEmpty(30_000)
        usage.driver_heap_mb = sum(p.getPeakUsage().getUsed() for p in heap) / MB
        usage.driver_rss_mb = peak_rss_mb()
        _collect(jsc, tag, usage)


def _collect(jsc, tag: str, usage: Usage) -> None:
    store, tracker, seen = jsc.statusStore(), jsc.statusTracker(), set()
    for job in tracker.getJobIdsForTag(tag):
        usage.jobs += 1
        info = tracker.getJobInfo(job)
        if info.isDefined():
            seen |= set(info.get().stageIds())
    for i in sorted(seen):
        try:
            s = store.lastStageAttempt(i)
        except Exception:  # noqa: BLE001  the store raises what the JVM does for a stage it no longer holds
            usage.forgotten_stages += 1
            continue
        if s.status().toString() == "SKIPPED":
            continue
        peak = s.peakExecutorMetrics()
        heap = peak.get().getMetricValue("JVMHeapMemory") / MB if peak.isDefined() else 0.0
        row = (
            i, s.name(), s.numTasks(), s.executorRunTime() / 1e3, s.executorCpuTime() / 1e9, s.jvmGcTime() / 1e3, s.inputBytes() / MB,
            s.shuffleReadBytes() / MB, s.shuffleWriteBytes() / MB, s.diskBytesSpilled() / MB, s.peakExecutionMemory() / MB, heap or None,
        )
        usage.by_stage.append(row)
        usage.stages += 1
        usage.tasks += row[2]
        for k, v in zip(("task_s", "cpu_s", "gc_s", "input_mb", "shuffle_read_mb", "shuffle_write_mb", "spill_mb"), row[3:10], strict=True):
            setattr(usage, k, getattr(usage, k) + v)
        usage.peak_execution_mb = max(usage.peak_execution_mb, row[10])
        if row[11]:
            usage.executor_heap_mb = max(usage.executor_heap_mb or 0.0, row[11])


def finite_float(value: object) -> float | None:
    """A finite number; None for anything else, bools among it."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return float(value) if math.isfinite(value) else None


SCALE = "n_spots long, n_genes long, n_values long, runtime_s double, peak_rss_mb double, task_s double, cpu_s double, shuffle_mb double, peak_execution_mb double"


def measure_fit(expr: DataFrame, edges: DataFrame, spots: DataFrame, n_genes: int, n_iter: int = 30, k: int = 4, n_domains: int = 4, seed: int = 0) -> tuple:
    """A row of SCALE: one fit of the factor model with its domains, timed until both are computed."""
    n, values = spots.count(), expr.count()
    with measured(spots.sparkSession, "fit") as u:
        out = models.gnmf_domains(expr, edges, spots, n_genes, shared=k - 1, private=1, n_domains=n_domains, n_iter=n_iter, seed=seed)
        out.domains.write.format("noop").mode("overwrite").save()
    heap = u.driver_heap_mb + u.driver_rss_mb
    return n, n_genes, values, u.wall_s, heap, u.task_s, u.cpu_s, u.shuffle_write_mb, u.peak_execution_mb


def measure_scalability(spark: SparkSession, sizes: Sequence[tuple[int, int]], *, n_sections: int = 2, n_iter: int = 30, seed: int = 0) -> DataFrame:
    """A row per size (spots of a section, genes): a planted instance, made and written before the clock starts, and a
    fit of it. peak_rss_mb counts the driver: its JVM's peak heap and its Python."""
    from .experiments import Config, planted

    rows = []
    for n, genes in sizes:
        one = planted(spark, Config(n_sections=n_sections, n_spots_per_section=int(n), n_genes=int(genes), neighbours=6), seed)
        rows.append(measure_fit(one.expr, one.edges, one.spots, int(genes), n_iter, seed=seed))
    return spark.createDataFrame(rows, SCALE)


def measure_shares(expr: DataFrame, spots: DataFrame, n_genes: int, shares: Sequence[float], n_iter: int = 30, neighbours: int = 6, seed: int = 0) -> DataFrame:
    """measure_scalability on data of one's own: a row per share of the spots, picked by hash, so that larger shares hold
    smaller ones."""
    rows, u = [], graph.hash_unit(seed, "share", F.col("spot_id"))
    for share in shares:
        some = cut(spots.where(u < share))
        part = cut(expr.join(some.select("spot_id"), "spot_id", "left_semi"))
        rows.append(measure_fit(part, cut(graph.knn_undirected(some, neighbours)), some, n_genes, n_iter, seed=seed))
    return spots.sparkSession.createDataFrame(rows, SCALE)


def scalability_table(rows: DataFrame) -> DataFrame:
    """n_spots, n_genes, runtime_s, peak_rss_mb in order of size; what is no finite number is null."""
    ok = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c)
    return rows.select(F.col("n_spots").cast("long"), F.col("n_genes").cast("long"), ok("runtime_s"), ok("peak_rss_mb")).orderBy("n_spots", "n_genes")


def scalability_curve(rows: DataFrame, vary: str) -> DataFrame:
    """size, runtime_s, peak_rss_mb by the dimension that varies ('n_spots' or 'n_genes'); a missing memory is NaN."""
    if vary not in ("n_spots", "n_genes"):
        raise ValueError(f"unknown dimension {vary!r}")
    memory = F.col("peak_rss_mb") if "peak_rss_mb" in rows.columns else F.lit(None).cast("double")
    return rows.select(F.col(vary).alias("size"), "runtime_s", F.coalesce(memory, F.lit(float("nan"))).alias("peak_rss_mb")).orderBy("size", "runtime_s")


def growth(rows: DataFrame, value: str = "runtime_s", size: str = "n_values") -> DataFrame:
    """r, slope, intercept of the logarithms: slope is the power of the size with which the value grows (1: in
    proportion)."""
    logs = rows.where((F.col(value) > 0) & (F.col(size) > 0)).select(F.ln(size).alias("x"), F.ln(value).alias("y"))
    return reports.regression(logs)
