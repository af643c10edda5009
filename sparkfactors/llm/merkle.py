"""Merkle manifest of a dataset: a tree of digests per source and one over the sources, and proofs by a recursive query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import scratch
from ..operators.ranks import ranked
from . import common as c

#: Nodes that become one digest.
RUN = 16
#: The levels of the tree over the sources are numbered from here, and its tree is this.
TOP, TOP_TREE = 100, -1
#: Leaves in a row that share a copy of the nodes above them: no more rows than these join one row of nodes.
BLOCK = 65_536
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree long, idx long, n long, first long, last long, digest string, children binary, up_tree long, up_level int, up_idx long, place int, level int"


def _field(v: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = v.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(text: Column | None = None) -> Column:
    """The hex digest of a record, with another text if one is given."""
    return F.sha2(F.concat(*(_field(text if f == "text" and text is not None else F.col(f)) for f in FIELDS)), 256)


def is_sampled() -> Column:
    """Whether the audit tampers with a row: 5 divides the crc of its doc_id in decimal; never for null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _link(level: int, n_trees: int) -> list[Column]:
    """Where a node (tree, idx, n nodes on its level) hangs: up_tree, up_level, up_idx and its place among the children
    there, all null for the root. The only node of a source goes on as a leaf of the tree over the sources."""
    nothing = F.lit(None)
    inner = {"up_tree": F.col("tree"), "up_level": F.lit(level + 1), "up_idx": F.floor(F.col("idx") / RUN), "place": F.col("idx") % RUN}
    joins_top = level < TOP and n_trees > 1
    over = {"up_tree": F.lit(TOP_TREE), "up_level": F.lit(TOP + 1), "up_idx": F.floor(F.col("tree") / RUN), "place": F.col("tree") % RUN}
    kinds = {"up_tree": "long", "up_level": "int", "up_idx": "long", "place": "int"}
    return [F.when(F.col("n") > 1, inner[k]).otherwise(over[k] if joins_top else nothing).cast(t).alias(k) for k, t in kinds.items()]


def _above(nodes: DataFrame) -> DataFrame:
    """The next level: each run of up to RUN nodes becomes one, with its children's digests in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"])
    runs = nodes.where("n > 1").groupBy("tree", F.floor(F.col("idx") / RUN).alias("run"))
    up = runs.agg(F.ceil(F.max("n") / RUN).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.array_join(ordered, "").alias("hex"))
    return up.select("tree", F.col("run").cast("long").alias("idx"), F.col("n").cast("long").alias("n"), "first", "last", F.sha2("hex", 256).alias("digest"), F.unhex("hex").alias("children"))


@dataclass(frozen=True)
class Manifest:
    """leaves: tree (number of the source), idx (place there), n, at (place among all leaves), leaf, start (null: leaf), the
    columns carried along, and the link up_tree, up_level, up_idx, place. nodes: NODES, the built levels, linked alike."""

    leaves: DataFrame
    nodes: DataFrame
    n_trees: int


def build_manifest(records: DataFrame, carry: tuple[str, ...] = (), path: str | None = None) -> Manifest:
    """The manifest of records (doc_id, source, leaf, and start, null where it is leaf: hex digests), its levels written below path (a scratch folder
    by default), each from the one before.

    Leaves are put in order by ranges, so that a source of any size is spread over tasks; sources are numbered in order
    of their bytes, null first. Records that agree in doc_id follow the order of their digests.
    """
    spark, path = records.sparkSession, path or scratch(records.sparkSession)
    # Equal records differ by row, so ranges can part them; written first, so that it stays as it is.
    rows = c.materialize(records.withColumn("row", F.monotonically_increasing_id()))
    rows = c.materialize(ranked(rows, ("doc_id", "leaf", "row"), ("source",), "idx", "n", "tree", "at"))
    n_trees = (rows.agg(F.max("tree")).first()[0] or 0) + 1
    leaves = rows.select("tree", "idx", "n", "at", *carry, "leaf", "start", *_link(0, n_trees))

    def climb(below: DataFrame, level: int) -> list[int]:
        built, most = [], below.agg(F.max("n")).first()[0] or 0
        while most > 1:
            level, most = level + 1, -(-most // RUN)
            _above(below).select("*", *_link(level, n_trees)).write.parquet(f"{path}/level={level}")
            built.append(level)
            below = spark.read.schema(NODES).parquet(f"{path}/level={level}")
        return built

    plain = leaves.select("tree", "idx", "n", F.col("at").alias("first"), F.col("at").alias("last"), F.col("leaf").alias("digest"))
    levels = climb(plain, 0)
    nodes = lambda: spark.read.schema(NODES).parquet(path) if levels else spark.createDataFrame([], NODES)
    subroots = nodes().select(*plain.columns).unionByName(plain).where("n = 1")
    levels += climb(c.materialize(subroots.select(F.lit(TOP_TREE).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("n"), "first", "last", "digest")), TOP)
    return Manifest(leaves, nodes(), n_trees)


#: Leaves that hang on one node climb in one row, each with its own digest, as all they meet above is the same. A step
#: joins the row to that node, appends the node's other children to the proof and folds each digest in its place. The
#: first node's children stay apart (lowest): there each leaf has other siblings.
CLIMB = """
WITH RECURSIVE climb AS (
  SELECT block, step, members, lowest, proof, subroot, root, up_tree, up_level, up_idx FROM {leaves}
  UNION ALL
  SELECT c.block, c.step + 1,
    transform(c.members, m -> struct(m.row, m.first, n.up_place AS place,
      unhex(sha2(lower(hex(concat(substring(n.children, 1, 32 * m.place), m.folded, substring(n.children, 32 * m.place + 33)))), 256)) AS folded)),
    if(c.step = 0, n.children, c.lowest),
    if(c.step = 0, c.proof, concat(c.proof, substring(n.children, 1, 32 * c.members[0].place), substring(n.children, 32 * c.members[0].place + 33))),
    if(c.up_level < {top} AND coalesce(n.up_level, {top}) >= {top}, n.digest, c.subroot),
    if(n.up_level IS NULL, n.digest, c.root),
    n.up_tree, n.up_level, n.up_idx
  FROM climb c JOIN {nodes} n ON c.block = n.block AND c.up_tree = n.tree AND c.up_level = n.level AND c.up_idx = n.idx)
SELECT step, members, lowest, proof, subroot, root FROM climb WHERE up_level IS NULL LIMIT ALL"""


def prove(manifest: Manifest, carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """carry, leaf, subroot, root, proof (binary digests of the siblings from the leaf up) and folded (binary: the digest
    that start and the siblings give), a row per leaf.

    A recursive query ascends from all leaves at once. The nodes over very many leaves are read by a copy for each block
    of leaves below them, so no key of the join has more than `block` rows.
    """
    m, block_of = manifest, lambda x: F.floor(F.col(x) / block).cast("long")
    nodes = m.nodes.withColumn("block", F.explode(F.sequence(block_of("first"), block_of("last"))))
    nodes = nodes.select("block", "tree", "level", "idx", "digest", "children", "up_tree", "up_level", "up_idx", F.col("place").alias("up_place"))
    own = F.struct(F.struct(*carry, "leaf").alias("row"), F.col("place").alias("first"), "place", F.unhex(F.coalesce("start", "leaf")).alias("folded"))
    # At most RUN leaves hang on a node.
    hung = m.leaves.withColumn("block", block_of("at")).groupBy("block", "up_tree", "up_level", "up_idx").agg(F.collect_list(own).alias("members"))
    none = F.unhex(F.lit(""))
    leaves = hung.select("*", F.lit(0).alias("step"), none.alias("lowest"), none.alias("proof"), F.lit("").alias("subroot"), F.lit("").alias("root"))
    query = CLIMB.replace("{top}", str(TOP))
    done = c.materialize(m.leaves.sparkSession.sql(query, leaves=leaves, nodes=nodes))
    done = done.select(F.explode("members").alias("m"), "step", "lowest", "proof", "subroot", "root")
    siblings = F.concat(F.expr("substring(lowest, 1, 32 * m.first)"), F.expr("substring(lowest, 32 * m.first + 33)"), F.col("proof"))
    # A leaf without siblings in its source is the subroot, and one without any the root.
    own = lambda x: F.when(F.col(x) == "", F.col("m.row.leaf")).otherwise(F.col(x)).alias(x)
    return done.select(*(F.col(f"m.row.`{x}`").alias(x) for x in carry), "m.row.leaf", own("subroot"), own("root"), F.when(F.col("step") == 0, none).otherwise(siblings).alias("proof"), "m.folded")


def audit_manifest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, a row per document: the manifest of the
    documents, and for each the root that its proof gives after the audit has tampered with a fifth of them (A-Z of their
    texts in lower case), which shows unless a text has none.

    Null columns have a mark of their own in a leaf, and null ids and sources are first in order; empty and very long
    texts are digested whole; rows with equal ids follow the order of their digests, so that repeated rows each have a
    leaf; a table of one row is its own root, an empty one gives an empty result. Only the five fields of a record are
    read, so extra columns and their names don't matter.
    """
    start = F.when(is_sampled(), leaf_digest(c.lower_ascii(F.col("text"))))
    records = docs.select("doc_id", "source", leaf_digest().alias("leaf"), start.alias("start"))
    out = prove(build_manifest(records, ("doc_id",), path), ("doc_id",))
    folded = F.lower(F.hex("folded"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))
