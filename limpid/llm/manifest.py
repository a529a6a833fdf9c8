"""A Merkle tree over the rows of a table, its nodes labelled by the interval of leaf ranks that they cover.

Leaves are ranked inside their group. A node of level l covers at most fanout**l ranks, from ``lo`` up to but without ``hi``.
A parent is the node of the next level whose interval contains the child's; both share the bucket ``lo`` div fanout**(l+1), so
containment is an equality join with a check of the limits, and a parent never meets more than ``fanout`` children. Siblings
are the parts of the parent's interval that are left when the child's is taken out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from limpid.operators.ranking import with_row_number
from limpid.storage import materialize

#: Columns of a leaf, in the order they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return hashed(F.concat(*[field(v) for v in values]))


def group_key(value: Column) -> Column:
    """A group as text that sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def ranked(leaves: DataFrame) -> DataFrame:
    """``leaves(group, key, leaf, ...)`` with ``rank`` in the group (by key, nulls first, then digest) and the group's ``size``.

    Rows get a global row number by ranges; the first row number of a group is then taken off. Groups meet their rows by
    (range of row numbers, group), so no key has more rows than a range.
    """
    placed = with_row_number(leaves, [F.asc("group"), F.asc_nulls_first("key"), F.asc("leaf")])
    width = 1 << 12
    cut = placed.withColumn("range", F.floor(F.col("row") / width))
    met = cut.groupBy("group", "range").agg(F.min("row").alias("low"), F.count(F.lit(1)).alias("n"))
    groups = met.groupBy("group").agg(F.min("low").alias("first"), F.sum("n").alias("size"))
    labels = met.select("group", "range").join(groups, "group")
    return cut.join(labels, ["group", "range"]).select(*leaves.columns, (F.col("row") - F.col("first")).alias("rank"), "size")


def runs_of(digest: str, order: str, *others: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(order, digest, *others)))


def lowest_nodes(leaves: DataFrame, fanout: int) -> DataFrame:
    """Nodes of level 1 with their leaves; a lone leaf of a group is its own node, unhashed."""
    rest = [c for c in leaves.columns if c not in ("group", "size", "rank", "leaf")]
    nodes = leaves.groupBy("group", F.floor(F.col("rank") / fanout).alias("place")).agg(
        F.max("size").alias("size"), runs_of("leaf", "rank", *rest).alias("run"))
    joined = F.array_join(F.transform("run", lambda x: x["leaf"]), "")
    return nodes.select("group", "place", "size", (F.col("place") * fanout).alias("lo"),
                        F.least((F.col("place") + 1) * fanout, F.col("size")).alias("hi"),
                        F.when(F.col("size") == 1, joined).otherwise(hashed(joined)).alias("digest"), "run")


def upper_nodes(nodes: DataFrame, level: int, fanout: int) -> DataFrame:
    """The nodes of ``level`` over those below it, for groups of more than one node there."""
    many = nodes.filter(F.col("size") > fanout ** (level - 1))
    grouped = many.groupBy("group", F.floor(F.col("lo") / fanout ** level).alias("place")).agg(
        F.max("size").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
    return grouped.withColumn("digest", hashed(F.array_join(F.transform("children", lambda x: x["digest"]), "")))


def text_between(children: Column, inside) -> Column:
    return F.array_join(F.transform(F.filter(children, inside), lambda x: x["digest"]), "")


def attach(below: DataFrame, above: DataFrame, level: int, fanout: int) -> DataFrame:
    """``below`` with ``path``: its siblings, left and right, and those of all its ancestors.

    ``above`` are the nodes of ``level`` with their paths; nodes of ``below`` that are a group's top are not met here.
    """
    a = above.select(F.col("group").alias("g"), F.col("place").alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"),
                     F.col("children").alias("kin"), F.col("path").alias("rest"))
    contained = ((F.col("group") == F.col("g")) & (F.floor(F.col("lo") / fanout ** level) == F.col("bucket"))
                 & (F.col("lo") >= F.col("from")) & (F.col("hi") <= F.col("to")))
    own = F.struct(text_between(F.col("kin"), lambda x: x["hi"] <= F.col("lo")).alias("left"),
                   text_between(F.col("kin"), lambda x: x["lo"] >= F.col("hi")).alias("right"))
    return below.join(a, contained).select(*below.columns, F.concat(F.array(own), F.col("rest")).alias("path"))


NO_PATH = "array<struct<left:string,right:string>>"


def tree(leaves: DataFrame, fanout: int) -> tuple[DataFrame, DataFrame]:
    """(tops, lowest) of ranked leaves ``(group, rank, size, leaf, ...)``.

    ``tops`` is ``(group, subroot)``; ``lowest`` are the nodes of level 1 with their leaves as ``run`` and their ``path`` up to the
    subroot of their group.
    """
    levels = [materialize(lowest_nodes(leaves, fanout), "nodes")]
    largest = levels[0].agg(F.max("size")).first()[0] or 0
    while fanout ** len(levels) < largest:
        levels.append(materialize(upper_nodes(levels[-1], len(levels) + 1, fanout), "nodes"))
    found, above = [], None
    for level in range(len(levels), 0, -1):
        nodes = levels[level - 1]
        is_top = F.col("size") <= fanout ** level
        top = nodes.filter(is_top)
        found.append(top.select("group", F.col("digest").alias("subroot")))
        met = top.withColumn("path", F.array().cast(NO_PATH))
        if above is not None:
            met = met.unionByName(attach(nodes.filter(~is_top), above, level + 1, fanout))
        above = materialize(met, "paths") if level > 1 else met
    tops = found[0]
    for other in found[1:]:
        tops = tops.unionByName(other)
    return tops, above


def folded(start: Column, path: Column) -> Column:
    """The root that a digest leads to when it is put between the siblings of every level."""
    return F.aggregate(path, start, lambda acc, p: hashed(F.concat(p["left"], acc, p["right"])))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, fanout: int = 16,
             changed: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: key, leaf, subroot, root, ``proof`` (siblings of every level up to the root, each an
    object with ``left`` and ``right``), folded_root and verified.

    Leaves of a group ascend by key, nulls first, then by digest; groups ascend bytewise, null first. ``changed`` gives other values of
    columns: the leaf of those is folded with the siblings of the true tree, and ``verified`` says whether that gives the root.
    A group of one leaf has that leaf as its subroot, and one group alone gives the root. Repeated rows are leaves each; an empty
    table has no rows and no root. Columns that are not named are left out.
    """
    values = [F.col(f) for f in fields]
    now = [(changed or {}).get(f, F.col(f)) for f in fields]
    rows = docs.select(group_key(F.col(group)).alias("group"), F.col(key).alias("key"), leaf(values).alias("leaf"), leaf(now).alias("now"))
    rows = materialize(rows.withColumn("now", F.when(F.col("now") != F.col("leaf"), F.col("now"))), "leaves")
    tops, lowest = tree(ranked(rows), fanout)
    tops = materialize(tops, "subroots")
    heads = with_row_number(tops.select("group", F.col("subroot").alias("leaf")), [F.asc("group")], "rank")
    heads = heads.select(F.lit("").alias("group"), F.col("group").alias("source"), "leaf", "rank", F.lit(tops.count()).cast("long").alias("size"))
    crown, joints = tree(heads, fanout)
    root = crown.first()
    root = F.lit(root["subroot"] if root else None).cast("string")
    above = leaf_paths(joints).select(F.col("source").alias("group"), F.col("leaf").alias("subroot"), F.col("path").alias("rest"))
    proofs = leaf_paths(met_by_group(lowest, materialize(above, "heads")))
    proof = F.concat("path", "rest")
    start = F.coalesce("now", "leaf")
    out = proofs.select(F.col("key").alias(key), "leaf", "subroot", proof.alias("proof"), start.alias("start"))
    return out.select(key, "leaf", "subroot", root.alias("root"), "proof", folded(F.col("start"), F.col("proof")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def met_by_group(lowest: DataFrame, heads: DataFrame) -> DataFrame:
    """Nodes with the columns of their group, by (group, block of places), so that a hot group is spread over its blocks."""
    block = F.floor(F.col("place") / 1024)
    blocks = lowest.select("group", block.alias("block")).distinct().join(heads, "group")
    return lowest.withColumn("block", block).join(blocks, ["group", "block"])


def leaf_paths(lowest: DataFrame) -> DataFrame:
    """The leaves of nodes of level 1, each with its siblings before those of its ancestors."""
    each = lowest.withColumn("at", F.explode("run"))
    side = lambda inside: F.array_join(F.transform(F.filter("run", inside), lambda x: x["leaf"]), "")
    own = F.struct(side(lambda x: x["rank"] < F.col("at.rank")).alias("left"), side(lambda x: x["rank"] > F.col("at.rank")).alias("right"))
    path = F.when(F.col("size") == 1, F.array().cast(NO_PATH)).otherwise(F.concat(F.array(own), F.col("path")))
    rest = [c for c in lowest.columns if c not in ("run", "path")]
    return each.select(*rest, path.alias("path"), "at.*")
