"""The npz source against numpy's own reader."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfactors.sources import containers


@pytest.fixture
def arrays():
    r = np.random.default_rng(3)
    return {
        "domain_id": r.integers(-5, 9, 2500).astype(np.int32), "score": r.normal(size=(2500, 7)).astype(np.float32), "name": np.array([f"spot é{i % 40}" for i in range(2500)]),
        "raw": np.array([b"a", b"bc"] * 1250), "flag": r.random(2500) > 0.5, "wide": np.asfortranarray(r.normal(size=(2500, 3))), "deep": r.normal(size=(2500, 2, 3)), "none": np.zeros(0), "big": r.integers(0, 2**40, 2500).astype(np.uint64),
    }


def got(df):
    return [x["value"] for x in df.orderBy("path", "row").collect()]


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_members_equal_numpy(spark, tmp_path, arrays, save):
    save(tmp_path / "a.npz", **{k: v for k, v in arrays.items() if not (save is np.savez_compressed and k == "wide")})
    for name, v in arrays.items():
        if save is np.savez_compressed and name == "wide":
            continue
        df = containers.read_array(spark, str(tmp_path / "a.npz"), name, rows_per_partition=600)
        want = v.astype(str) if v.dtype.kind == "S" else v.astype(float) if v.dtype.kind == "f" else v
        assert got(df) == want.reshape(want.shape[0], -1).tolist() if v.ndim > 1 else got(df) == want.tolist(), name
        assert df.rdd.getNumPartitions() == (1 if save is np.savez_compressed or not len(v) else 5)


def test_rows_and_paths_settle_what_is_read(spark, tmp_path, arrays):
    for n in "ab":
        np.savez(tmp_path / f"{n}.npz", domain_id=arrays["domain_id"] + ord(n))
    df = containers.read_array(spark, str(tmp_path), "domain_id", rows_per_partition=100)
    part = containers.read_array(spark, [str(tmp_path / "b.npz")], "domain_id", 100, (250, 420))
    assert got(part) == (arrays["domain_id"][250:420] + ord("b")).tolist()
    assert part.rdd.getNumPartitions() == 2 and df.rdd.getNumPartitions() == 50
    assert got(df.where("row = 7 AND value > 0")) == [int(arrays["domain_id"][7]) + ord(n) for n in "ab"]
    assert df.count() == 5000 and containers.read_array(spark, str(tmp_path), "domain_id", rows=(5, 3)).count() == 0


def test_packed_arrays_larger_than_a_piece(spark, tmp_path, monkeypatch):
    v = np.arange(3_000_000)
    np.savez_compressed(tmp_path / "a.npz", v=v)
    df = containers.read_array(spark, str(tmp_path / "a.npz"), "v")
    assert df.agg(F.sum("value"), F.sum(F.col("row") * F.col("value"))).first() == (int(v.sum()), int((v * v).sum()))
    assert got(containers.read_array(spark, str(tmp_path), "v", rows=(2999998, 2**40))) == [2999998, 2999999]


def test_domain_scan_takes_the_first_archive_that_has_the_member(spark, tmp_path):
    np.savez(tmp_path / "a.npz", W=np.ones(3))
    np.savez(tmp_path / "c.npz", domain_id=np.array([3, 3]))
    np.savez(tmp_path / "b.npz", domain_id=np.array([1, 2, 1]))
    (tmp_path / "notes.txt").write_text("no archive")
    assert containers.domain_archive(str(tmp_path)).endswith("b.npz")
    assert containers.domain_archive(f"file://{tmp_path}").startswith("file://")
    with pytest.raises(FileNotFoundError):
        containers.domain_archive(str(tmp_path / "a.npz"))
    both = containers.gallery_labels(spark, [f"gnmf={tmp_path}", f"other={tmp_path}/c.npz", f"again={tmp_path}/c.npz"])
    rows = sorted(map(tuple, both.collect()))
    assert rows == [("again", 0, 3), ("again", 1, 3), ("gnmf", 0, 1), ("gnmf", 1, 2), ("gnmf", 2, 1), ("other", 0, 3), ("other", 1, 3)]


def test_what_cannot_be_read_is_said(spark, tmp_path):
    np.savez_compressed(tmp_path / "a.npz", v=np.asfortranarray(np.ones((3, 2))), o=np.array([{}], dtype=object), x=np.ones(2))
    np.savez(tmp_path / "b.npz", x=np.ones((2, 2)))
    for member, text in (("v", "order of columns"), ("o", "no plain type"), ("x", "differs"), ("y", "no archive")):
        with pytest.raises(Exception, match=text):
            containers.read_array(spark, str(tmp_path), member).collect()
    (tmp_path / "c.npz").write_bytes(b"not a zip")
    with pytest.raises(Exception, match="not an archive"):
        containers.read_array(spark, str(tmp_path / "c.npz"), "x").collect()
    with zipfile.ZipFile(tmp_path / "d.npz", "w") as z:
        z.writestr("x.npy", (tmp_path / "b.npz").read_bytes()[:10])
    with pytest.raises(Exception, match="no array"):
        containers.members(str(tmp_path / "d.npz"))
    with pytest.raises(ValueError):
        containers.named_path("no sign")


def test_written_archives_read_back(spark, tmp_path):
    df = spark.range(1000).repartition(3).select(F.col("id").alias("spot_id"), (F.col("id") % 7).alias("domain_id"), F.array(F.col("id") * 0.5, F.lit(1.0)).alias("h"))
    paths = containers.write_arrays(df, f"{tmp_path}/run")
    assert len(paths) == 3
    read = lambda m: containers.read_array(spark, f"{tmp_path}/run", m).withColumnRenamed("value", m)
    back = read("spot_id").join(read("domain_id"), ["path", "row"]).join(read("h"), ["path", "row"]).select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    for p in paths:
        with np.load(p) as z:
            assert z["h"].shape == (len(z["spot_id"]), 2)
