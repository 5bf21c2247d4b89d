"""Merkle trees over a table: one per group, and one over their roots.

Sixteen consecutive digests become the digest of their concatenation, level by level. Every
built node is a row with its parent's name and its siblings' digests, so that a recursive query
can climb from any leaf to the root, collect the proof on its way and fold a leaf as it is found
now into the root that it would give.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.llm.ranks import ranked
from salesmart.llm.stored import drop, settle

FAN = 16
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"

# Parts of a list of siblings' digests, as seen by the one at place i.
_BEFORE = "array_join(slice(children.digest, 1, i), '')"
_AFTER = "array_join(slice(children.digest, i + 2, size(children)), '')"


@dataclass
class Manifest:
    """A built tree: stored tables and the root's digest and name."""

    runs: DataFrame  # tree, node, leaves: up to 16 consecutive leaves, and the node that they become
    nodes: DataFrame  # node, parent, digest, before, after: each node below the root that is no leaf of a run
    subroots: DataFrame  # tree, grp, subroot
    root: str | None
    root_node: str | None


def digest(*values: Column) -> Column:
    """SHA-256 in hex of values, each ``-`` if null, else its length in bytes, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def _levels(start: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Parent-linked rows of all nodes, and each tree's top, from rows of tree, node, rank, of, digest."""
    nodes: list[DataFrame] = []
    tops: DataFrame | None = None
    level = start
    while True:
        top = level.where("of = 1").select("tree", "node", "digest")
        tops = top if tops is None else tops.unionAll(top)
        if level.where("of > 1").isEmpty():
            return nodes, tops
        block = F.floor(F.col("rank") / FAN).alias("rank")
        up = level.where("of > 1").groupBy("tree", block, F.ceil(F.col("of") / FAN).alias("of"))
        up = up.agg(F.array_sort(F.collect_list(F.struct(level["rank"].alias("at"), "digest", "node"))).alias("children"))
        up = settle(up.withColumn("node", F.concat_ws("/", "tree", F.lit(len(nodes) + 2).cast("string"), F.col("rank").cast("string"))), "level")
        child = up.select("node", "children", F.posexplode("children").alias("i", "child"))
        nodes.append(child.select("child.node", F.col("node").alias("parent"), "child.digest", F.expr(_BEFORE).alias("before"), F.expr(_AFTER).alias("after")))
        level = up.select("tree", "node", "rank", "of", F.sha2(F.array_join("children.digest", ""), 256).alias("digest"))


def build(leaves: DataFrame) -> Manifest:
    """Trees over rows of ``key``, ``grp``, ``leaf`` and ``claim``, the leaf as found now or null where unchanged.

    A group's leaves stand in the order of ``key``, nulls first, and groups in the bytewise order
    of ``grp``, nulls first; a group of one leaf is that leaf. Repeated rows are leaves of their own. An
    empty table gives a manifest without a root. Runs of sixteen are made of ranks that many
    tasks count, so no task holds a group; each next level is a sixteenth of the one below.
    """
    placed = ranked(leaves, ["grp"], ["key", "leaf"])
    block = F.floor(F.col("rank") / FAN)
    run = F.array_sort(F.collect_list(F.struct("rank", "key", "leaf", F.coalesce("claim", "leaf").alias("claim"))))
    blocks = settle(placed.groupBy("grp", block.alias("block"), "of").agg(run.alias("leaves")), "blocks")
    groups = ranked(blocks.where("block = 0").select("grp"), [], ["grp"])
    groups = settle(groups.select("grp", F.col("rank").alias("place"), F.col("rank").cast("string").alias("tree"), F.col("of").alias("groups")), "groups")
    node = F.when(F.col("of") == 1, F.concat("tree", F.lit("/0/0"))).otherwise(F.concat_ws("/", "tree", F.lit("1"), F.col("block").cast("string")))
    named = groups.select(F.col("grp").alias("_grp"), "tree")
    runs = settle(blocks.join(named, F.col("grp").eqNullSafe(F.col("_grp"))).select("tree", node.alias("node"), "block", "of", "leaves"), "runs")
    drop(blocks)
    one = F.when(F.col("of") == 1, F.col("leaves")[0]["leaf"]).otherwise(F.sha2(F.array_join("leaves.leaf", ""), 256))
    nodes, tops = _levels(runs.select("tree", "node", F.col("block").alias("rank"), F.ceil(F.col("of") / FAN).alias("of"), one.alias("digest")))
    tops = settle(tops, "tops")
    subroots = tops.join(groups, "tree")
    above, summit = _levels(subroots.select(F.lit("all").alias("tree"), "node", F.col("place").alias("rank"), F.col("groups").alias("of"), "digest"))
    rows = [*nodes, *above]
    linked = rows[0] if rows else runs.sparkSession.createDataFrame([], "node string, parent string, digest string, before string, after string")
    for more in rows[1:]:
        linked = linked.unionAll(more)
    found = summit.first()
    return Manifest(runs, settle(linked, "nodes"), subroots.select("tree", "grp", F.col("digest").alias("subroot")), found and found["digest"], found and found["node"])


# Leaves of one run share all siblings above it, so a row climbs with up to 16 leaves: each is
# folded on its own, what is shared is carried once. Digests travel as bytes and are hashed as hex.
_CLIMB = """
WITH RECURSIVE climb (run, folded, node, above) AS (
    SELECT node, folded, node, X'' FROM {anchor}
    UNION ALL
    SELECT c.run, transform(c.folded, f -> unhex(sha2(concat(n.before, lower(hex(f)), n.after), 256))), n.parent, concat(c.above, unhex(concat(n.before, n.after)))
    FROM climb c JOIN {nodes} n ON c.node = n.node
)
SELECT run, folded, above FROM climb WHERE node = {root}
"""


def verify(manifest: Manifest) -> DataFrame:
    """Per leaf: ``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    The proof is the digest of all siblings on the way from the leaf to the root, from left to
    right and level by level; ``folded_root`` follows from the claimed leaf and these siblings.
    What the recursive query gives is stored before it returns, as its limit of rows, which would
    cut large tables, is lifted for it alone.
    """
    spark = manifest.runs.sparkSession
    schema = "key {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if manifest.root is None:
        return spark.createDataFrame([], schema.format(manifest.runs.schema["leaves"].dataType.elementType["key"].dataType.simpleString()))
    others = "concat(array_join(slice(leaves.leaf, 1, i), ''), array_join(slice(leaves.leaf, i + 2, size(leaves)), ''))"
    first = "concat(array_join(slice(leaves.leaf, 1, i), ''), l.claim, array_join(slice(leaves.leaf, i + 2, size(leaves)), ''))"
    anchor = manifest.runs.select("node", F.expr(f"transform(leaves, (l, i) -> unhex(if(of = 1, l.claim, sha2({first}, 256))))").alias("folded"))
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        climbed = settle(spark.sql(_CLIMB, anchor=anchor, nodes=manifest.nodes.select("node", "parent", "before", "after"), root=manifest.root_node), "climbed")
    finally:
        spark.conf.set(ROW_LIMIT, before)
    proof = F.expr(f"transform(leaves, (l, i) -> sha2(concat({others}, lower(hex(above))), 256))")
    back = climbed.join(manifest.runs.select(F.col("node").alias("run"), "tree", "leaves"), "run")
    each = back.select("tree", F.explode(F.arrays_zip("leaves", "folded", proof.alias("proof"))).alias("l"))
    root, folded = F.lit(manifest.root), F.lower(F.hex("l.folded"))
    return each.join(manifest.subroots, "tree").select(
        F.col("l.leaves.key").alias("key"),
        F.col("l.leaves.leaf").alias("leaf"),
        "subroot",
        root.alias("root"),
        F.col("l.proof").alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == root).alias("verified"),
    )


def audit(docs: DataFrame, changed: dict[str, Column], where: Column, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """The manifest of ``docs``, and what of it still holds if the rows of ``where`` were ``changed``.

    Leaves cover ``fields``, nulls included; other columns don't count. Whole values are hashed,
    whatever their length. A null ``where`` counts as false.
    """
    claim = F.when(where, digest(*(changed.get(c, F.col(c)) for c in fields)))
    leaves = docs.select(F.col(key).alias("key"), F.col(group).cast("string").alias("grp"), digest(*map(F.col, fields)).alias("leaf"), claim.alias("claim"))
    return verify(build(settle(leaves, "leaves"))).withColumnRenamed("key", key)
