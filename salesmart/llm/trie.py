"""Prefix tries of conversations by halving depths, as van Emde Boas laid out trees.

A trie of depth 2h is cut at depth h: the cut prefixes get names, the upper trie ends there and
each name is the root of a lower trie. All tries of one round are cut at once, in rounds of h
from the largest power of two within the depth down to 1, so that each depth is named once, from the name
at its cut and the digest of the h turns since. The name of a prefix is its smallest member. Totals
then go the other way: in rounds from 1 up, what lower tries add up to is grafted onto the cut
node and its ancestors in the upper trie, until the whole trie is one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.llm.ranks import ranked
from salesmart.llm.stored import drop, settle

WORD = "[^\\x20\\x09-\\x0D]+"
GROUP = 20  # conversations that share the first turns of one of them
SHARED = 4  # fewer than so many turns are shared


def tokens(conversations: DataFrame) -> DataFrame:
    """Rows of ``conv_id``, ``pos`` (from 0), ``token`` (digest of role and text), ``words`` and ``of``, the conversation's turns.

    Turns stand in the order of ``turn``, nulls first, ties by their digest. Null roles and texts
    count as empty; rows without ``conv_id`` are left out. Repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", token.alias("token"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return ranked(rows, ["conv_id"], ["turn", "token"]).select("conv_id", F.col("rank").alias("pos"), "token", "words", "of")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their group does: stored rows of turns, and of ``conv_id`` and ``depth``.

    Of conversation c the first h turns, h = crc32(c) % 4, come from conversation c - c % 20: all
    if it has fewer, none if there is none. Its own turns after its first h follow, if any; so a
    conversation may have no turns.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    first = turns.where("pos = 0").select("conv_id", F.col("of").alias("own"), h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    bases = first.where("conv_id = base").select("base", F.col("own").alias("there"))
    convs = settle(first.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("there", F.lit(0)))), "convs")
    lent = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < SHARED)).select(F.col("conv_id").alias("base"), "pos", "token", "words")
    given = convs.where("given > 0").join(lent, "base").where("pos < given").select("conv_id", "pos", "token", "words")
    moved = convs.where("given < h").select("conv_id", (F.col("given") - F.col("h")).alias("by"))
    own = turns.where(F.col("pos") >= h).join(moved, "conv_id", "left").select("conv_id", (F.col("pos") + F.coalesce("by", F.lit(0))).alias("pos"), "token", "words")
    depth = F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return settle(given.unionAll(own), "turns"), settle(convs.select("conv_id", depth.alias("depth")), "depths")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionAll(more)
    return out


def _blocks(turns: DataFrame, half: int) -> list[DataFrame]:
    """Digests of all whole runs of 1, 2, 4 … ``half`` turns that start at multiples of their length: ``conv_id``, ``j``, ``token``."""
    out = [turns.select("conv_id", F.col("pos").alias("j"), "token")]
    for _ in range(half.bit_length() - 1):
        left, right = (F.max(F.when(F.col("j") % 2 == k, F.col("token"))) for k in (0, 1))
        pairs = out[-1].groupBy("conv_id", F.floor(F.col("j") / 2).alias("j")).agg(left.alias("x"), right.alias("y"))
        both = pairs.where("x IS NOT NULL AND y IS NOT NULL").select("conv_id", "j", F.unhex(F.sha2(F.concat("x", "y"), 256)).alias("token"))
        out.append(settle(both, "blocks"))
    return out


def paths(turns: DataFrame, depths: DataFrame) -> DataFrame:
    """Rows of ``conv_id``, ``d`` and ``name``: the smallest conversation that has the same first d turns.

    A round per halving: the runs of h turns after each cut meet the names at the cuts. Those
    equal in cut, name and run are counted and named by an aggregate and joined back, so that
    a prefix that a third of all conversations share is no task's alone. Each round is stored.
    """
    most, root = depths.agg(F.max("depth"), F.min("conv_id")).first()
    names = [depths.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(root).cast("long").alias("name"))]
    half = 1 << max(most or 0, 1).bit_length() - 1
    blocks = _blocks(turns, half)
    for step in reversed(range(len(blocks))):
        h = 1 << step
        runs = blocks[step].where("j % 2 = 0").select("conv_id", (F.col("j") * h).alias("d"), "token")
        met = settle(runs.join(_union(names), ["conv_id", "d"]), "met")
        named = met.groupBy("d", "name", "token").agg(F.min("conv_id").alias("least"))
        found = met.join(named, ["d", "name", "token"]).select("conv_id", (F.col("d") + h).alias("d"), F.col("least").alias("name"))
        names.append(settle(found, "names"))
        drop(met)
        if step:
            drop(blocks[step])
    return _union(names)


def _digest_ends(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending numbers, joined by commas, per ``depth`` and ``name``; a node's numbers stream through, none are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        state = hashlib.sha256()
        for batch in batches:
            out: list[tuple[int, int, str]] = []
            depth, name, conv = (batch.column(c).to_numpy() for c in range(3))
            new = np.flatnonzero(np.r_[True, (depth[1:] != depth[:-1]) | (name[1:] != name[:-1])]) if len(depth) else np.zeros(0, "i8")
            for start, end in zip(new, [*new[1:], len(depth)]):
                node = (int(depth[start]), int(name[start]))
                joined = ",".join(map(str, conv[start:end].tolist())).encode()
                if node == last:
                    state.update(b"," + joined)
                    continue
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = node, hashlib.sha256(joined)
            yield _node_rows(out)
        if last is not None:
            yield _node_rows([(*last, state.hexdigest())])

    dealt = ends.repartition("depth", "name").sortWithinPartitions("depth", "name", "conv_id")
    return dealt.select("depth", "name", "conv_id").mapInArrow(run, "depth bigint, name bigint, ends_sha256 string")


def _node_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    depth, name, digest = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(name, pa.int64()), pa.array(digest, pa.string())], ["depth", "name", "ends_sha256"])


def _graft(own: DataFrame, path: DataFrame, most: int) -> DataFrame:
    """Totals of each node's subtree, as rows of ``d``, ``name`` and what they add: ``leaves``, ``saved``.

    ``own`` has ``d``, ``name``, ``parent``, ``leaves`` and ``saved`` of each node below the root. In the round of h the
    lower tries hang on nodes at odd multiples of h; the path of such a node's smallest member
    leads through the h nodes of the upper trie that gain them.
    """
    added = [own]
    h = 1
    while h < most:
        below = _union(added).where((F.col("d") > 1) & ((F.col("d") - 1) % (2 * h) == h))
        hung = below.groupBy((F.col("d") - 1).alias("cut"), F.col("parent").alias("conv_id")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        upper = path.where("d > 0").withColumn("cut", F.ceil(F.col("d") / h) * h).where(F.col("cut") % (2 * h) == h)
        gains = upper.join(hung, ["cut", "conv_id"]).groupBy("d", "name", "parent").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        added.append(settle(gains, "grafts"))
        h *= 2
    return _union(added)


def prefix_trie(turns: DataFrame, depths: DataFrame) -> DataFrame:
    """The trie of all conversations: one row per distinct prefix, the empty one included.

    ``turns`` has ``conv_id``, ``pos``, ``token`` and ``words``, ``depths`` each conversation's ``depth``. Columns: ``conv_id`` (the
    node's smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. An empty table has no trie. Depth costs rounds, a logarithm of them; no task
    holds a conversation, a node's members or a subtree.
    """
    most = depths.agg(F.max("depth")).first()[0] or 0
    named = paths(turns, depths)
    above = named.select("conv_id", (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    path = settle(named.join(above, ["conv_id", "d"], "left"), "paths")
    members = path.groupBy("d", "name", "parent").agg(F.count("*").alias("n_convs"))
    words = turns.select(F.col("conv_id").alias("name"), (F.col("pos") + 1).alias("d"), "words")
    children = path.where("d > 0 and conv_id = name").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = members.join(words, ["d", "name"], "left").join(children, ["d", "name"], "left")
    none = F.lit(0).cast("long")
    saved: Column = F.when(F.col("d") == 0, none).otherwise((F.col("n_convs") - 1) * F.coalesce("words", none))
    nodes = nodes.withColumns({"n_children": F.coalesce("n_children", none), "saved": saved})
    nodes = settle(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).drop("words"), "nodes")
    totals = _graft(nodes.where("d > 0").select("d", "name", "parent", "leaves", "saved"), path, most)
    totals = settle(totals.groupBy("d", "name", "parent").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")), "totals")
    top = totals.where("d = 1").groupBy((F.col("d") - 1).alias("d"), F.col("parent").alias("name")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    totals = totals.select("d", "name", "n_leaves", "saved_tokens").unionAll(top)
    ends = depths.withColumnRenamed("depth", "d").join(path, ["conv_id", "d"]).select(F.col("d").alias("depth"), "name", "conv_id")
    digests = _digest_ends(ends).withColumnRenamed("depth", "d")
    return (
        nodes.join(totals, ["d", "name"], "left")
        .join(digests, ["d", "name"], "left")
        .select(
            F.col("name").alias("conv_id"),
            F.col("d").alias("depth"),
            F.col("parent").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            F.coalesce("n_leaves", F.col("leaves")).alias("n_leaves"),
            F.coalesce("saved_tokens", F.col("saved")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )
