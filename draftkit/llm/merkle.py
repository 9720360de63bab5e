"""Merkle dataset manifest by sibling-shift self-joins.

Rows are hashed to leaves in the scan; from there on only digests move.
Leaves are numbered inside their group by one range sort.  At every level a
node computes the indices of its siblings (XOR 1 in a binary tree, slot
offsets in others) and equijoins the level with itself on them; the rows of
slot zero, with their siblings beside them, emit the parents.  Groups that
are down to one node leave with it as their subroot; the subroots, in group
order, make the same tree once more.

Proofs go down again: a node's proof is its own siblings followed by its
parent's proof, so each level is one join with a table a sixteenth its size.
A run of siblings is the unit of every shuffle: a group with a third of all
rows is spread over as many tasks as any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftkit.functions.index import dense_index
from draftkit.functions.joins import BROADCAST_MAX_BYTES, measured_bytes
from draftkit.llm.common import column, written

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 byte count,
    a colon and the value."""
    s = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(values: list[Column]) -> Column:
    return digest(*map(framed, values))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, start, lambda acc, s: digest(s["left"], acc, s["right"]))


def sibling_indices(at: Column, arity: int) -> Column:
    """The places that a node's siblings would have, as an array."""
    if arity == 2:
        return F.array(at.bitwiseXOR(F.lit(1).cast("bigint")))
    slot = F.pmod(at, F.lit(arity))
    return F.transform(F.sequence(F.lit(1), F.lit(arity - 1)), lambda o: at - slot + F.pmod(slot + o, F.lit(arity)))


def _with_siblings(nodes: DataFrame, of: DataFrame, arity: int) -> DataFrame:
    """The rows ``of`` a level with _run, _left and _right: their siblings'
    digests before and after them.  Siblings are found by their computed
    index; as siblings share their run, both sides are dealt by (group, run)
    and the join and the grouping after it run inside that one exchange."""
    run = F.floor(F.col("_i") / arity).cast("bigint")
    mine = of.withColumn("_run", run).repartition("_g", "_run")
    other = nodes.select(F.col("_g").alias("_g2"), run.alias("_run2"), F.col("_i").alias("_i2"), F.col("_digest").alias("_d2")).repartition("_g2", "_run2")
    asked = mine.withColumn("_sibling", F.explode(sibling_indices(F.col("_i"), arity)))
    met = asked.join(other, (F.col("_g") == F.col("_g2")) & (F.col("_run") == F.col("_run2")) & (F.col("_sibling") - F.col("_i2") == 0), "left")
    found = F.array_sort(F.collect_list(F.when(F.col("_d2").isNotNull(), F.struct("_i2", "_d2"))))
    out = met.groupBy(*(F.col(f"`{c}`") for c in mine.columns)).agg(found.alias("_found"))

    def side(pick):
        return F.array_join(F.transform(F.filter("_found", pick), lambda s: s["_d2"]), "")

    return (out.withColumn("_left", side(lambda s: s["_i2"] < F.col("_i"))).withColumn("_right", side(lambda s: s["_i2"] > F.col("_i"))).drop("_found"))


def _tree(nodes: DataFrame, arity: int, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of the trees over ``nodes`` (_g, _i, _n nodes in the group,
    _digest) and the groups' roots (_g, _digest); ``most`` is the largest _n."""
    levels = [nodes]
    while most > 1:
        now = levels[-1]
        heads = now.where((F.col("_n") > 1) & (F.pmod("_i", F.lit(arity)) == 0)).select("_g", "_i", "_n", "_digest")
        up = _with_siblings(now.where("_n > 1"), heads, arity)
        levels.append(written(up.select("_g", F.col("_run").alias("_i"), F.ceil(F.col("_n") / arity).cast("bigint").alias("_n"),
                                        digest(F.col("_digest"), F.col("_right")).alias("_digest")), "merkle-level"))
        most = -(-most // arity)
    roots = None
    for now in levels:
        top = now.where("_n = 1").select("_g", "_digest")
        roots = top if roots is None else roots.unionByName(top)
    return levels, roots


def _proofs(levels: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """The lowest level with what ``above`` (_g, _proof and more columns)
    says of its group's root: each node's proof is its siblings, then its
    parent's proof."""
    more = [c for c in above.columns if c not in ("_g", "_proof")]
    up = None
    for k in range(len(levels) - 1, -1, -1):
        now = levels[k]
        out = now.where("_n = 1").join(above, "_g")
        if up is not None:
            mine = _with_siblings(now.where("_n > 1").select("_g", "_i", "_digest"), now.where("_n > 1"), arity)
            step = F.array(F.struct(F.col("_left").alias("left"), F.col("_right").alias("right")))
            got = mine.join(up, (F.col("_g") == F.col("_up_g")) & (F.col("_run") == F.col("_up_i")))
            got = got.withColumn("_proof", F.concat(step, "_up_proof")).select(*out.columns)
            out = out.unionByName(got)
        if k:
            up = written(out.select(F.col("_g").alias("_up_g"), F.col("_i").alias("_up_i"), F.col("_proof").alias("_up_proof"), *more), "merkle-proofs")
    return out


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "source", order_col: str = "doc_id", arity: int = ARITY,
             carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: order_col and group_col under their
    names, leaf, subroot, root and proof (array of (left, right): the
    siblings' digests before and after the node, level by level from the leaf
    to the root, through the group's subroot).  ``carry`` adds columns
    computed from the row in the same scan.  ``fold(leaf, proof)`` gives the
    root back.

    Nulls in any field enter the leaf as ``-``; rows of a null group are a
    group of their own, the first; null order values come first.  Rows with
    the same order value go by their leaf, so repeated rows are neighbours
    and each has a place of its own.  Texts are hashed whole, empty ones too.
    A lone leaf is its group's subroot, a lone subroot is the root.  An empty
    table gives no rows.  Other columns are not read.
    """
    carry = carry or {}
    rows = docs.select(column(docs, order_col).alias("_order"), column(docs, group_col).alias("_group"),
                       leaf([column(docs, f) for f in fields]).alias("_digest"), *(c.alias(f"_c{k}") for k, c in enumerate(carry.values())))
    rows = written(rows, "merkle-hashed")  # the sort reads its input twice; texts are read once
    rows = dense_index(rows, [F.col("_group").asc_nulls_first(), F.col("_order").asc_nulls_first(), "_digest", *(f"_c{k}" for k in range(len(carry)))], "_at")
    groups = written(rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from")), "merkle-groups")
    groups = dense_index(groups, [F.col("_group").asc_nulls_first()], "_g").withColumnRenamed("_group", "_key")
    side = F.broadcast(groups) if measured_bytes(groups) <= BROADCAST_MAX_BYTES else groups
    nodes = rows.join(side, F.col("_group").eqNullSafe(F.col("_key"))).withColumn("_i", F.col("_at") - F.col("_from")).drop("_key", "_at", "_from")
    nodes = written(nodes, "merkle-leaves")
    most, count = groups.agg(F.coalesce(F.max("_n"), F.lit(0)), F.count(F.lit(1))).first()
    levels, subroots = _tree(nodes, arity, most)
    subroots = written(subroots.select(F.lit(0).cast("bigint").alias("_g"), F.col("_g").alias("_i"), F.lit(count).cast("bigint").alias("_n"), "_digest"), "merkle-subroots")
    upper, root = _tree(subroots, arity, count)
    start = root.select("_g", F.col("_digest").alias("_root"), F.array().cast(PROOF).alias("_proof"))
    above = written(_proofs(upper, start, arity).select(F.col("_i").alias("_g"), F.col("_digest").alias("_subroot"), "_root", "_proof"), "merkle-above")
    out = _proofs(levels, above, arity)
    return out.select(F.col("_order").alias(order_col), F.col("_group").alias(group_col), F.col("_digest").alias("leaf"), F.col("_subroot").alias("subroot"),
                      F.col("_root").alias("root"), F.col("_proof").alias("proof"), *(F.col(f"_c{k}").alias(name) for k, name in enumerate(carry)))
