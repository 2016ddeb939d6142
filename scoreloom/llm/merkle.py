"""Merkle manifests of a dataset: one tree per group, one tree over the groups, and a proof for every row."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.session import new_folder

DIGEST = 64  # hexadecimal characters of a digest


def hashed(*texts: Column) -> Column:
    """H: lower-case hexadecimal SHA-256 of the inputs joined."""
    return F.sha2(F.concat(*texts), 256)


def field(value: Column) -> Column:
    """One field of a leaf: ``-`` if null, else its bytes in UTF-8 (integers in decimal), counted."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_leaf(*columns: Column) -> Column:
    return hashed(*[field(c) for c in columns])


def _stored(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` (with g, the group) with idx from 0 in their group by ``order``, and n, the rows of the group.

    Rows are range-partitioned on (g, order), so a hot group is spread; only a row per partition and
    group in it is gathered to find where a partition's part of a group starts.
    """
    folder = new_folder(rows.sparkSession, "numbered")
    at = F.monotonically_increasing_id()
    sort = [F.col("g"), *order]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("at", at)
    placed = _stored(placed, folder).withColumn("part", F.shiftright("at", 33))
    here = placed.groupBy("part", "g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    group = Window.partitionBy("g")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = here.select(
        "part", "g", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(group).alias("n"),
    )
    return placed.join(starts, ["part", "g"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Every node with ``others``: the digests of its run's other nodes in order, as bytes; empty for a node alone.

    The nodes are joined with themselves once per sibling: on idx XOR 1 in a binary tree, else on the index at
    each slot offset of the run.
    """
    slot, start = F.col("idx") % arity, F.col("idx") - F.col("idx") % arity
    found = nodes
    for k in range(1, arity):
        sibling = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else start + (slot + k) % arity
        right = nodes.select("g", F.col("idx").alias(f"at{k}"), F.col("digest").alias(f"sibling{k}"))
        found = found.withColumn(f"at{k}", sibling).join(right, ["g", f"at{k}"], "left")
    other = F.sort_array(F.array(*[
        F.struct(F.col(f"at{k}").alias("at"), F.coalesce(f"sibling{k}", F.lit("")).alias("digest")) for k in range(1, arity)]))
    parts = F.transform(other, lambda o: o["digest"])
    return found.withColumn("others", F.unhex(F.array_join(parts, ""))).select(*nodes.columns, "others")


def _around(slot: Column, own: Column, others: Column) -> Column:
    """The digests of a run in order: ``own`` put at its slot between the others."""
    text = F.lower(F.hex(others))
    cut = (slot * DIGEST).cast("int")
    return F.concat(F.substring(text, F.lit(1), cut), own, F.substring(text, cut + 1, F.length(text)))


class Forest:
    """Trees over groups of numbered nodes: the stored levels, a root per group, a path for every leaf.

    ``nodes`` has g, idx (0 to n - 1), n and digest, and may carry more columns. While a group has more than
    one node, each run of ``arity`` consecutive nodes (the last may be shorter, even one node) becomes their H. Every level is
    written to the shared folder; the slot-zero rows of a level emit its parents, so a level costs
    one narrow self-join, and levels shrink by the arity.
    """

    def __init__(self, nodes: DataFrame, arity: int = 2):
        if arity < 2:
            raise ValueError("a tree needs an arity of at least 2")
        spark, folder = nodes.sparkSession, new_folder(nodes.sparkSession, "merkle")
        self.arity, self.levels = arity, []
        left = nodes.agg(F.max("n")).first()[0] or 0
        level = nodes
        while True:
            level = _stored(_with_siblings(level, arity), f"{folder}/level={len(self.levels)}")
            self.levels.append(level)
            if left <= 1:
                break
            left = -(-left // arity)
            level = level.where(f"n > 1 AND idx % {arity} = 0").select(
                "g", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"),
                hashed(_around(F.lit(0), F.col("digest"), F.col("others"))).alias("digest"),
            )
        self.spark = spark

    def roots(self) -> DataFrame:
        """(g, root) of every group; a lone leaf is its own root."""
        found = [level.where("n = 1").select("g", F.col("digest").alias("root")) for level in self.levels]
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        return rows

    def paths(self) -> DataFrame:
        """The leaves with ``path``: the ``others`` of the node itself, of its parent and so on, below the root.

        Built from the top: each level takes over the paths of its parents, so the rows joined double from level to level.
        """
        above = None
        for level in reversed(self.levels):
            own = F.when(F.col("n") > 1, F.array("others")).otherwise(F.array().cast("array<binary>"))
            if above is None:
                level = level.withColumn("path", own)
            else:
                # a root has no parent: its key is null
                parent = F.when(F.col("n") > 1, F.floor(F.col("idx") / self.arity))
                parents = above.select("g", F.col("idx").alias("parent"), F.col("path").alias("rest"))
                rest = F.coalesce("rest", F.array().cast("array<binary>"))
                level = level.withColumn("parent", parent).join(parents, ["g", "parent"], "left").withColumn(
                    "path", F.concat(own, rest)
                ).drop("rest", "parent")
            above = level.drop("others")
        return above


def folded(digest: Column, idx: Column, path: Column, arity: int = 2) -> Column:
    """The root that follows from a digest, its index and the path of its siblings."""
    start = F.struct(digest.alias("h"), idx.cast("long").alias("i"))

    def step(node, others):
        return F.struct(
            hashed(_around(node["i"] % arity, node["h"], others)).alias("h"),
            F.floor(node["i"] / arity).alias("i"),
        )

    return F.aggregate(path, start, step, lambda node: node["h"])


def siblings_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda others: F.lower(F.hex(others))), "")


def manifest(leaves: DataFrame, order: list[Column], arity: int = 2) -> DataFrame:
    """Every leaf with its place, its proof and the root of the dataset.

    ``leaves`` has ``grp`` (text) and ``leaf`` (a digest) and may carry more columns, but none called
    g, idx, n, digest, others, path, subroot, root, top_idx or top_path. In a group, leaves stand by
    ``order``, then by digest; the roots of the groups, by their name in bytes with the null group first, are the
    leaves of the top tree. ``path`` with ``idx`` leads from a leaf to ``subroot``, ``top_path`` with ``top_idx`` from there to ``root``.

    Rows of one group are told apart by index, so the joins have unique keys whatever a group holds. Texts
    are hashed before anything is shuffled. The groups are joined at the end by their name; that side has a row per group.

    Defined results: the null group is a group of its own; nulls in ``order`` come first; rows that repeat are
    leaves of their own; an empty table gives no rows; a single row is its own root, with an empty proof.
    """
    spark = leaves.sparkSession
    named = leaves.withColumn("g", F.coalesce(F.concat(F.lit("s"), F.col("grp")), F.lit("n")))
    narrow = _stored(named.withColumnRenamed("leaf", "digest"), new_folder(spark, "leaves"))
    forest = Forest(numbered(narrow, [*order, F.col("digest")]), arity)
    subroots = forest.roots().select(F.lit("all").alias("g"), F.col("g").alias("name"), F.col("root").alias("digest"))
    top = Forest(numbered(_stored(subroots, new_folder(spark, "subroots")), [F.col("name")]), arity)
    groups = top.paths().join(top.roots(), "g").select(
        F.col("name").alias("g"), F.col("digest").alias("subroot"), F.col("idx").alias("top_idx"),
        F.col("path").alias("top_path"), "root",
    )
    return forest.paths().join(groups, "g").withColumnRenamed("digest", "leaf").drop("g", "n")


def with_proofs(placed: DataFrame, presented: Column, arity: int = 2) -> DataFrame:
    """Rows of ``manifest`` with proof_sha256, and folded_root and verified for the digests that are ``presented``."""
    subroot = folded(presented, F.col("idx"), F.col("path"), arity)
    return placed.withColumn("proof_sha256", hashed(siblings_text(F.col("path")), siblings_text(F.col("top_path")))).withColumn(
        "folded_root", folded(subroot, F.col("top_idx"), F.col("top_path"), arity)
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
