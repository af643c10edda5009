"""Sharding, the Merkle manifest and the filter audit against plain brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sparkfactors.checkpoints import scratch
from sparkfactors.llm import filter_audit, merkle, sharding

WORD = re.compile("[^\x20\x09-\x0d]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


# Sharding.
def test_shards(docs, rows):
    got = sharding.shard_documents(docs, slots=512).collect()
    sized = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, *sized(t)) for d, t in rows)
    assert {(r["law"], r["grown_shard"], r["map_version"]) for r in got} == {("bytes", None, 1)}
    held = defaultdict(list)
    for r in got:
        held[r["shard"]].append(r)
    assert set(held) <= set(range(8))
    for x in held.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
    # Equal records keep together, whatever their number; a virtual slot is in one shard.
    assert all(len({r["shard"] for r in got if r["virtual_slot"] == v}) == 1 for v in {r["virtual_slot"] for r in got})
    again = sharding.shard_documents(docs.repartition(5), slots=512).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_shards_of_many_rows_are_near_equal_and_hot_records_get_places(spark):
    docs = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("é"), (F.col("id") % 97).cast("int"))).alias("text"))
    got = sharding.shard_documents(docs.where("doc_id IS NOT NULL")).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    loads = [r["b"] for r in got]
    assert len(loads) == 8 and max(loads) - min(loads) < 1e-3 * sum(loads) / 8
    assert all(r["m"] + 1 == r["n"] for r in got)
    # A third of all rows is one record, null and null: one slot, whose places are gapless all the same.
    got = sharding.shard_documents(docs).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("u"), F.count_if(F.col("doc_id").isNull()).alias("h")).collect()
    assert sum(r["n"] for r in got) == 20_000 and max(r["h"] for r in got) == 6667
    assert all(r["m"] + 1 == r["n"] == r["u"] for r in got)


def test_map_versions(spark, docs):
    maps = sharding.SlotMaps(spark, scratch(spark))
    first = maps.commit(sharding.even_map(64, 4))
    sizes = [1 + i % 7 for i in range(64)]
    second = maps.commit(sharding.rebalanced(first, sizes))
    third = maps.commit(sharding.rebalanced(second, sizes, shards=5))
    assert maps.load() == third and maps.load(0) == first and maps.load(1) == second
    with pytest.raises(Exception, match="exists"):
        maps.commit(second)
    moved = maps.moves(1, 2).collect()
    assert {r["to_shard"] for r in moved} == {4} and len(moved) < 64 / 4
    loads = [sum(b for b, s in zip(sizes, third.shard, strict=True) if s == k) for k in range(5)]
    assert max(loads) - min(loads) < max(sizes)
    path = scratch(spark)
    sharding.write_shards(docs, maps, 2, 64, path)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and back.select("row.*").columns == docs.columns


def test_a_slot_over_a_fair_share_leaves_the_others_balanced():
    m = sharding.rebalanced(sharding.even_map(9, 3), [1000, 1, 1, 1, 1, 1, 1, 1, 1])
    loads = [sum(b for b, s in zip(m.bytes, m.shard, strict=True) if s == k) for k in range(3)]
    assert sorted(loads) == [4, 4, 1000]
    with pytest.raises(ValueError):
        sharding.even_map(sharding.MOST_SLOTS + 1, 8)


# The Merkle manifest.
def fold(digests):
    """Levels from the leaves to the root."""
    levels = [digests]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[i : i + 16])) for i in range(0, len(x), 16)])
    return levels


def climbed(levels, i, digest):
    proof = ""
    for x in levels[:-1]:
        run = x[i // 16 * 16 : i // 16 * 16 + 16]
        at = i % 16
        proof += "".join(run[:at] + run[at + 1 :])
        digest, i = sha("".join(run[:at] + [digest] + run[at + 1 :])), i // 16
    return digest, proof


def manifest(records):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t))))
    by = defaultdict(list)
    for r in records:
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        by[r["source"]].append((r["doc_id"], leaf(r, r["text"]), leaf(r, lower(r["text"]) if hit and r["text"] is not None else r["text"])))
    for x in by.values():
        x.sort(key=lambda y: (y[0] is not None, y[0] or 0, y[1]))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: fold([y[1] for y in by[s]]) for s in order}
    top = fold([trees[s][-1][0] for s in order])
    for k, s in enumerate(order):
        for i, (d, plain, start) in enumerate(by[s]):
            mid, low = climbed(trees[s], i, start)
            root, high = climbed(top, k, mid)
            yield d, plain, trees[s][-1][0], top[-1][0], sha(low + high), root, root == top[-1][0]


def test_merkle(docs):
    same(merkle.audit_manifest(docs), list(manifest(docs.collect())))


@pytest.mark.parametrize("n_sources", [1, 40])
def test_merkle_levels_and_lone_leaves(spark, n_sources):
    """Runs of one, sources of one row, more sources than a run holds, nodes copied for blocks of few leaves."""
    source = F.when(F.col("id") < 600, F.lit("hot")).otherwise(F.concat(F.lit("é"), F.col("id") % n_sources)) if n_sources > 1 else F.lit(None).cast("string")
    docs = spark.range(640 if n_sources > 1 else 273).select(F.col("id").alias("doc_id"), source.alias("source"), F.lit(None).cast("string").alias("lang"), F.col("id").alias("n_chars"), F.concat(F.lit("Text "), "id").alias("text"))
    want = list(manifest(docs.collect()))
    same(merkle.audit_manifest(docs), want)
    assert not all(x[-1] for x in want)
    records = docs.select("doc_id", "source", merkle.leaf_digest().alias("leaf"), merkle.leaf_digest().alias("start"))
    proved = merkle.prove(merkle.build_manifest(records, ("doc_id",)), ("doc_id",), block=20)
    assert proved.count() == len(want) and proved.where(F.lower(F.hex("folded")) != F.col("root")).count() == 0
    same(proved.select("doc_id", F.sha2(F.lower(F.hex("proof")), 256)), [(x[0], x[4]) for x in want])


def test_merkle_of_one_row_and_none(docs, empty):
    one = docs.where("doc_id = 3").limit(1)
    same(merkle.audit_manifest(one), list(manifest(one.collect())))
    assert merkle.audit_manifest(empty).count() == 0


# The filter audit.
def audit(records, labels):
    fails, parts = defaultdict(Counter), set()
    least = {}
    for r in records:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    seen = []
    for r in records:
        t = r["text"] or ""
        w = WORD.findall(t)
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        f += "E" * (r["doc_id"] is not None and t in least and least[t] < r["doc_id"])
        seen.append((r["lang"] or "", set(f), labels.get(r["doc_id"], (0, 0)) if r["doc_id"] is not None else (0, 0)))
        parts.add(r["lang"] or "")
    removed = defaultdict(int)
    rows = []
    for part in parts:
        mine = [x for x in seen if x[0] == part]
        for o in map("".join, permutations("ABCDE")):
            for k, f in enumerate(o):
                before = set(o[:k])
                now = [x for x in mine if f in x[1] and not x[1] & before]
                removed[part, f] += len(now)
                rows.append([part, o, k + 1, sum(not x[1] & (before | {f}) for x in mine), len(now), sum(f in x[1] and bool(x[1] & before) for x in mine), sum(x[1] == {f} for x in mine), sum(x[2][0] == 1 for x in now), sum(x[2][1] == 1 for x in now)])
    return [(*r, removed[r[0], r[1][r[2] - 1]]) for r in rows]


LABELS = [(i, i % 2, int(i % 7 == 0)) for i in range(40)] + [(2, 1, 1), (None, 1, 1), (10_000, 1, 1)]


def test_filter_audit(spark, docs):
    labels = spark.createDataFrame([(*x, "clash") for x in LABELS], "doc_id long, quality int, toxic int, text string")
    known = defaultdict(lambda: (0, 0))
    for d, q, t in LABELS:
        known[d] = (max(q, known[d][0]), max(t, known[d][1]))
    langs = docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, "").otherwise(F.col("lang")))
    same(filter_audit.audit_filters(langs, labels), audit(langs.collect(), known))


def test_filter_audit_of_hot_copies(spark):
    """A third of the rows share one text; some have null ids, which neither fail E nor make others fail it."""
    text = F.when(F.col("id") % 3 == 0, "The same Words # here").otherwise(F.concat(F.lit("no "), F.col("id") % 700))
    docs = spark.range(3000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("doc_id"), F.lit("en").alias("lang"), text.alias("text"))
    same(filter_audit.audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")), audit(docs.collect(), {}))


def test_filter_audit_of_nothing(spark, docs, empty):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert filter_audit.audit_filters(empty, labels).count() == 0
    assert filter_audit.audit_filters(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0
