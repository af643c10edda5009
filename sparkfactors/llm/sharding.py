"""Sharding by fixed virtual slots: records hash to slots for good, and a small versioned map says which shard holds a slot."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import scratch
from ..operators.ranks import ranked
from . import common as c

#: The map passes through the driver and is broadcast, so its size has a bound that doesn't grow with the data.
MOST_SLOTS = 65_536


def record_hash() -> Column:
    """64 bits of a record's doc_id and text, nulls included."""
    return F.xxhash64(F.col("doc_id"), F.col("doc_id").isNull(), F.col("text"), F.col("text").isNull())


def slot_of(h: Column, slots: int) -> Column:
    """The virtual slot of a record hash; it never changes while the number of slots stays."""
    return F.pmod(h, F.lit(slots)).cast("int")


def text_size() -> Column:
    """UTF-8 bytes of the text, none for null, and one for the record."""
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def slot_bytes(rows: DataFrame, slots: int) -> DataFrame:
    """virtual_slot, bytes of the rows (virtual_slot, size), a row for each slot; partial sums precede the shuffle."""
    held = rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(held, "virtual_slot", "left").select("virtual_slot", F.coalesce("b", F.lit(0)).cast("long").alias("bytes"))


@dataclass(frozen=True)
class SlotMap:
    """One version: the shard and, when it was made, the bytes of every slot."""

    version: int
    shards: int
    shard: tuple[int, ...]
    bytes: tuple[int, ...]


def even_map(slots: int, shards: int) -> SlotMap:
    """Version 0, before anything is known of the data: runs of slots of about equal number."""
    if not 0 < shards <= slots <= MOST_SLOTS:
        raise ValueError(f"shards must be positive and at most slots, slots at most {MOST_SLOTS}")
    return SlotMap(0, shards, tuple(i * shards // slots for i in range(slots)), (0,) * slots)


def rebalanced(m: SlotMap, sizes: list[int], shards: int | None = None, tolerance: float = 1e-4) -> SlotMap:
    """The next version: slots move from the fullest shard to the emptiest until their bytes differ by at most tolerance
    of a fair share, or no move brings them closer. Each move takes the slot nearest to half the difference, so few slots
    (and with them few rows) move. A slot larger than a fair share stays alone with what can't leave; the others are
    balanced all the same. With more shards than before the new ones begin empty, and slots move to them alone.
    """
    shards = shards or m.shards
    if len(sizes) != len(m.shard) or shards < m.shards:
        raise ValueError("sizes must have an entry for each slot, and shards must not shrink")
    place, load, held = list(m.shard), [0] * shards, [[] for _ in range(shards)]
    for slot, (s, b) in enumerate(zip(place, sizes, strict=True)):
        load[s] += b
        held[s].append((b, slot))
    for x in held:
        x.sort()
    fair, open_ = sum(sizes) / shards, set(range(shards))
    takers = range(m.shards, shards) if shards > m.shards else range(shards)
    while open_:
        full, free = max(open_, key=lambda s: (load[s], -s)), min(takers, key=lambda s: (load[s], s))
        gap = load[full] - load[free]
        if gap <= tolerance * fair:
            break
        at = bisect_left(held[full], (gap / 2, -1))
        near = [x for x in held[full][max(at - 1, 0) : at + 1] if 0 < x[0] < gap]
        if not near:
            open_.remove(full)
            continue
        b, slot = best = min(near, key=lambda x: (abs(x[0] - gap / 2), x[1]))
        held[full].remove(best)
        insort(held[free], best)
        load[full], load[free], place[slot] = load[full] - b, load[free] + b, free
    return SlotMap(m.version + 1, shards, tuple(place), tuple(sizes))


class SlotMaps:
    """The versions of a map below a folder that all executors share, a Parquet file each. Versions are added, never
    changed: a reader that holds an old one keeps finding its rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, m: SlotMap) -> SlotMap:
        """Write a version; an error if it is there already, as another editor was first."""
        rows = [(i, s, b, m.shards) for i, (s, b) in enumerate(zip(m.shard, m.bytes, strict=True))]
        df = self.spark.createDataFrame(rows, "virtual_slot int, shard int, bytes long, shards int").coalesce(1)
        df.write.mode("error").parquet(f"{self.path}/version={m.version}")
        return m

    def table(self, version: int | None = None) -> DataFrame:
        """version, virtual_slot, shard, bytes, shards: of one version, or of all."""
        every = self.spark.read.parquet(self.path)
        return every if version is None else every.where(F.col("version") == version)

    def load(self, version: int | None = None) -> SlotMap:
        """A version, the latest by default."""
        if version is None:
            version = self.table().agg(F.max("version")).first()[0]
        rows = self.table(version).orderBy("virtual_slot").collect()
        if not rows:
            raise KeyError(version)
        return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows), tuple(r["bytes"] for r in rows))

    def moves(self, old: int, new: int) -> DataFrame:
        """virtual_slot, bytes, from_shard, to_shard of the slots that an edit moved."""
        a, b = (self.table(v).select("virtual_slot", "shard", "bytes") for v in (old, new))
        b = b.withColumnsRenamed({"shard": "to_shard"})
        return a.drop("bytes").withColumnsRenamed({"shard": "from_shard"}).join(b, "virtual_slot").where("from_shard <> to_shard")


def with_shard(rows: DataFrame, maps: SlotMaps, version: int) -> DataFrame:
    """rows (virtual_slot) with shard. The map has at most MOST_SLOTS rows, so it is broadcast."""
    return rows.join(F.broadcast(maps.table(version).select("virtual_slot", "shard")), "virtual_slot")


def balance(docs: DataFrame, maps: SlotMaps, shards: int, slots: int) -> tuple[DataFrame, SlotMap]:
    """Digests of the documents (doc_id, size, text_crc32, h, virtual_slot, row), written once, and the map edited for
    their bytes; the first version is made where the folder has none."""
    digests = c.materialize(
        docs.select(
            "doc_id",
            text_size().alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
            record_hash().alias("h"),
            slot_of(record_hash(), slots).alias("virtual_slot"),
            # Written, so that it stays as it is: it tells equal records apart, which ranges can then split.
            F.monotonically_increasing_id().alias("row"),
        )
    )
    sizes = [r["bytes"] for r in slot_bytes(digests, slots).orderBy("virtual_slot").collect()]
    return digests, maps.commit(rebalanced(maps.commit(even_map(slots, shards)), sizes))


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = 4096, path: str | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and one), text_crc32, law ('bytes'), shard, slot (the row's place in its
    shard, from 0), grown_shard (null under this law), virtual_slot and map_version, a row per document.

    doc_id and text settle a record's virtual slot; the slots' bytes settle the map of slots to shards, kept in versions
    below path (a scratch folder by default). Shards' bytes are near equal unless single slots outweigh a fair share:
    records alike in doc_id and text share a slot. Null doc_id and null text are values like others (a null text has
    size 1 and crc 0); empty and very long texts count their bytes; repeated rows each have a place; an empty table gives
    an empty one. Only the five columns named are read or returned, so extra columns and their names don't matter.
    """
    maps = SlotMaps(docs.sparkSession, path or scratch(docs.sparkSession))
    digests, m = balance(docs, maps, shards, slots)
    rows = ranked(with_shard(digests, maps, m.version), ("h", "doc_id", "row"), ("shard",), name="slot")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(m.version).alias("map_version"),
    )


def write_shards(docs: DataFrame, maps: SlotMaps, version: int, slots: int, path: str) -> None:
    """docs with all their columns as Parquet below path, a folder shard=... for each shard of a version of the map; a
    virtual slot's rows come from one task, so that a slot moves as few files."""
    inside = docs.select(F.struct("*").alias("row"), slot_of(record_hash(), slots).alias("virtual_slot"))
    out = with_shard(inside, maps, version)
    out.repartition("shard", "virtual_slot").write.partitionBy("shard").parquet(path)
