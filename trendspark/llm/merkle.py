"""Merkle dataset manifest (operator 13): built levels as parent-linked node rows, climbed by a recursive query.

A leaf is the digest of a row's fields. Per group (source) the leaves ascend by id; runs of ``arity`` consecutive
nodes become their digest, level by level, until one is left, the group's subroot. Subroots, ordered by group,
are the leaves of a tree of their own, whose last node is the root. H is the lower-case hex SHA-256 of the
concatenated inputs, digests as hex text.

Building. Leaves get their place by a range sort over (group, id, digest, row number), so a group that holds
most rows is many partitions. The tree is built ``levels`` levels at a time: a block of arity**levels
consecutive nodes (729) is one small task group; it yields its top node for the next round and for each of its nodes
a **node row**: (tree, stage, idx), the link to its ancestor that is the block's top (``up_tree``, ``up_stage``, ``up_idx``; null
at the root), and the ``path`` from it to there, for each level the digests left and right of the run's member on
the way. Rows of all rounds are the stored manifest; its size is a constant times the leaves.

Climb. A recursive Spark query starts at every leaf's own row, with the digest to be proved (the tampered one where the row
is tampered, else the original), and joins the state with the node row it stands on: siblings are appended to the
proof, the digest is folded with them level by level, and the state moves to the parent link. Packing ``levels`` links into one
row makes log(n) / levels steps instead of log(n); every step is one equi-join, and the rows above the first
stage are 1/729 of the leaves. Digests are 32 bytes on the way and hex only inside H.

Nulls in any column: the field is ``-``. A null group is a group, the first; null ids come first in their group.
Equal ids are ordered by leaf digest; repeated rows are leaves of their own next to each other, in the order of their row numbers.
A null id is never tampered. One leaf alone in its group is the group's subroot, one group's subroot is the root; a
proof without siblings is H of nothing. Extra columns are not read. An empty table gives no rows and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspark.llm.common import small, table
from trendspark.operators.common import global_index

ARITY = 3
#: tree number of the tree over the subroots
TOP = -1
PATH = "array<struct<l: binary, r: binary>>"
_BLOCK = ("kind int, tree long, stage int, idx long, digest binary, row long, up_idx long, last boolean, path " + PATH)


def field(c: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*cols: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in cols]), 256)


def _h(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _block(arity: int, levels: int):
    """A function for the sorted nodes of one block: its node rows (kind 0) and its top node (kind 1)."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        first = pdf.iloc[0]
        tree, stage, block = int(first["tree"]), int(first["stage"]), int(first["idx"]) // arity ** levels
        sole = int(first["size"]) <= arity ** levels  # the tree's last round: stop at one node
        now = [bytes(x) for x in pdf["digest"]]
        paths: list[list[dict]] = [[] for _ in now]
        width = 1  # leaves of a node of the present level
        for _ in range(levels):
            if sole and len(now) == 1:
                break
            text = [x.hex().encode() for x in now]
            for i, p in enumerate(paths):
                at = i // width
                lo = at - at % arity
                p.append({"l": b"".join(now[lo:at]), "r": b"".join(now[at + 1: lo + arity])})
            now = [_h(b"".join(text[lo: lo + arity])) for lo in range(0, len(now), arity)]
            width *= arity
        n = len(pdf)
        nodes = pd.DataFrame({"kind": 0, "tree": tree, "stage": stage, "idx": pdf["idx"].to_numpy(), "digest": pdf["digest"].to_numpy(),
                              "row": pdf["row"].to_numpy(), "up_idx": [block] * n, "last": [sole] * n, "path": paths})
        top = pd.DataFrame({"kind": [1], "tree": tree, "stage": stage + 1, "idx": block, "digest": [now[0]], "row": pd.array([None], "Int64"),
                            "up_idx": pd.array([None], "Int64"), "last": sole, "path": [None]})
        return pd.concat([nodes, top], ignore_index=True)

    return build


def _climb_trees(nodes: DataFrame, arity: int, levels: int, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """Node rows of each round, and one (tree, digest) row a tree. ``nodes``: tree, stage, idx, digest, row, size."""
    block = arity ** levels
    build = _block(arity, levels)
    rounds, tops = [], []
    while True:
        group = F.floor(F.col("idx") / F.lit(block))
        out = table(nodes.groupBy("tree", "stage", group.alias("b")).applyInPandas(build, _BLOCK), f"merkle-{tag}")
        rounds.append(out.where("kind = 0").drop("kind"))
        tops.append(out.where("kind = 1 and last").select("tree", "digest"))
        more = out.where("kind = 1 and not last").select("tree", "stage", "idx", "digest", "row")
        if not more.limit(1).count():
            break
        # a further round: each tree's number of nodes is one more than its last place
        size = more.groupBy("tree").agg((F.max("idx") + 1).alias("size"))
        nodes = more.join(size, "tree")
    done = tops[0]
    for t in tops[1:]:
        done = done.unionByName(t)
    return rounds, done


def manifest(docs: DataFrame, key: str, group: str, digest: Column, check: Column, arity: int = ARITY, levels: int = 6
             ) -> tuple[DataFrame, DataFrame, DataFrame, bytes | None]:
    """(leaves, node rows, subroots, root). Leaves: row, key, group, ``leaf`` and ``check`` (the digest to be proved), binary."""
    leaves = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(group).cast("string").alias("g"),
                         F.unhex(digest).alias("leaf"), F.unhex(check).alias("check"))
    leaves = table(leaves, "merkle-leaves")  # row numbers are fixed once written
    at = global_index(leaves.select("g", "k", "leaf", "row"), ["g", "k", "leaf", "row"], "at")
    groups = at.groupBy("g").agg(F.min("at").alias("start"), F.count("*").alias("size"))
    groups = table(global_index(groups, ["g"], "tree"), "merkle-groups")
    n_groups = groups.count()
    if not n_groups:
        return leaves, leaves.limit(0), groups, None
    a, b = at.alias("a"), small(groups, n_groups).alias("b")
    nodes = a.join(b, F.col("a.g").eqNullSafe(F.col("b.g"))).select(
        "tree", F.lit(0).alias("stage"), (F.col("at") - F.col("start")).alias("idx"), F.col("leaf").alias("digest"), "row", "size")
    rounds, subroots = _climb_trees(nodes, arity, levels, "trees")
    subroots = table(subroots, "merkle-subroots")
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("stage"), F.col("tree").alias("idx"), "digest",
                          F.lit(None).cast("long").alias("row"), F.lit(n_groups).cast("long").alias("size"))
    top_rounds, root = _climb_trees(top, arity, levels, "top")
    rows = None
    for r in [*rounds, *top_rounds]:
        over = F.col("tree") == TOP
        link = r.select(
            "tree", "stage", "idx", "row", "path",
            F.when(~F.col("last"), F.col("tree")).when(~over, F.lit(TOP).cast("long")).alias("up_tree"),
            F.when(~F.col("last"), F.col("stage") + 1).when(~over, F.lit(0)).alias("up_stage"),
            F.when(~F.col("last"), F.col("up_idx")).when(~over, F.col("tree")).alias("up_idx"),
            # the node a climb leaves its own tree by is the subroot, stored where the climb enters the top tree
            F.when(over & (F.col("stage") == 0), F.col("digest")).alias("subroot"))
        rows = link if rows is None else rows.unionByName(link)
    return leaves, rows, groups, bytes(root.first()["digest"])


_FOLD = "aggregate({path}, {start}, (h, p) -> unhex(sha2(concat(lower(hex(p.l)), lower(hex(h)), lower(hex(p.r))), 256)))"
_JOIN = "aggregate({path}, {start}, (s, p) -> concat(s, p.l, p.r))"


def proofs(leaves: DataFrame, rows: DataFrame) -> DataFrame:
    """k, leaf, subroot, proof (binary siblings), folded (the root that ``check`` folds to), by the recursive climb."""
    spark = leaves.sparkSession
    own = rows.where(F.col("row").isNotNull()).drop("subroot", "tree", "stage", "idx")
    start = leaves.join(own, "row")
    above = table(rows.where(F.col("row").isNull()).drop("row"), "merkle-above")
    # the number of rows is that of the leaves in each step: Spark's limit on rows of a recursion is for runaway ones
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    empty = "cast('' AS binary)"
    return spark.sql(f"""
        WITH RECURSIVE climb(row, k, leaf, subroot, proof, folded, at_tree, at_stage, at_idx) AS (
            SELECT row, k, leaf, cast(NULL AS binary), {_JOIN.format(path='path', start=empty)}, {_FOLD.format(path='path', start='`check`')},
                   up_tree, up_stage, up_idx
            FROM {{start}}
            UNION ALL
            SELECT c.row, c.k, c.leaf, coalesce(c.subroot, n.subroot), {_JOIN.format(path='n.path', start='c.proof')},
                   {_FOLD.format(path='n.path', start='c.folded')}, n.up_tree, n.up_stage, n.up_idx
            FROM climb c JOIN {{above}} n ON c.at_tree = n.tree AND c.at_stage = n.stage AND c.at_idx = n.idx)
        SELECT row, k, leaf, subroot, proof, folded FROM climb WHERE at_tree IS NULL""", start=start, above=above)


def tampered(key: Column) -> Column:
    """Whether 2 divides the unsigned CRC-32 of the decimal id; null ids are not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def verify(docs: DataFrame, arity: int = ARITY, levels: int = 6) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest of ``docs`` and the proof of each row, with
    newlines deleted from the texts of the tampered rows."""
    cols = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.when(tampered(F.col("doc_id")), F.translate("text", "\n", "")).otherwise(F.col("text"))
    digest, check = leaf_digest(*cols, F.col("text")), leaf_digest(*cols, text)
    leaves, rows, _, root = manifest(docs, "doc_id", "source", digest, check, arity, levels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if root is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, "
                                                     "folded_root string, verified boolean")

    def text_of(c: str) -> Column:
        return F.lower(F.hex(c))

    return proofs(leaves, rows).select(
        F.col("k").alias("doc_id"), text_of("leaf").alias("leaf"), text_of("subroot").alias("subroot"), F.lit(root.hex()).alias("root"),
        F.sha2(text_of("proof"), 256).alias("proof_sha256"), text_of("folded").alias("folded_root"),
        (text_of("folded") == F.lit(root.hex())).alias("verified"))
