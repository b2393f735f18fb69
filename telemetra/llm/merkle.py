"""Merkle manifest of a table: levels stored as parent-linked rows, proofs by a recursive query.

Rows are leaves, in order, of one tree per label; the trees' roots are the leaves
of a last tree over the labels.  Every two consecutive nodes of a level, or one
at its end, are hashed to a node of the next level.

Levels are built ``STRIDE`` at a time inside blocks of ``2 ** STRIDE`` nodes, so
no group is larger than a block.  What is stored is a row for each node on which
a block starts: its digest, the node above the block as its parent, and its
siblings on the way there, lowest first.  A recursive query then climbs from all
leaves at once: a step joins each leaf to the row of the node it has reached,
appends the siblings as a row of its own and folds its digest with them.  Rows
high in a tree are wanted by very many leaves, so they are stored in several
copies and the leaves dealt among these.  A leaf's appended rows are put together
once, at the end, so that no step shuffles what earlier ones gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from telemetra.session import materialize

STRIDE = 8
#: Rows that start above the leaves have 2 ** COPIES copies from this level on, fewer below.
COPIES = 10
#: Name of the tree over the labels; names of the labels' trees start with '-' or '='.
TOP = "*"


def h(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """``-`` for null, else byte count, colon and value, so that no two rows read the same."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return h(*[field(c) for c in columns])


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The stored rows with their number, from 0, in the order (nulls first): ranges, and their sizes summed."""
    low = F.monotonically_increasing_id()
    kept = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("_part", F.shiftright(low, 33)).withColumn("_at", low.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range
    before = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return kept.join(first, "_part").withColumn(name, F.col("_at") + F.col("_first")).drop("_part", "_at", "_first")


def _block(nodes: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the nodes at a level, and the nodes ``STRIDE`` levels up or at the root.

    ``nodes`` has tree, depth, node (a struct that starts with pos and digest, the latter as bytes).
    """
    steps = F.least(F.lit(STRIDE), F.col("depth") - level).cast("int")
    got = (nodes.groupBy("tree", "depth", F.shiftright("node.pos", STRIDE).alias("block"))
           .agg(F.array_sort(F.collect_list("node")).alias("own"))
           .withColumn("l0", F.transform("own", lambda x: F.lower(F.hex(x["digest"])))))
    for j in range(STRIDE):
        l = F.col(f"l{j}")
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(l) - 1) / 2).cast("int")),
                            lambda i: h(F.get(l, i * 2), F.coalesce(F.get(l, i * 2 + 1), F.lit(""))))
        got = got.withColumn(f"l{j + 1}", F.when(steps > j, pairs).otherwise(l))

    def siblings(node: Column, i: Column) -> Column:
        every = F.array(*[F.unhex(F.get(F.col(f"l{j}"), F.shiftright(i, j).bitwiseXOR(F.lit(1)))) for j in range(STRIDE)])
        return F.struct(node.alias("node"), F.slice(every, 1, steps).alias("siblings"))

    above = F.unhex(F.get(f"l{STRIDE}", F.lit(0)))
    rows = (got.select("tree", "depth", F.col("block").alias("up_pos"), above.alias("above"), steps.alias("steps"),
                       F.explode(F.transform("own", siblings)).alias("x"))
            .select("tree", "depth", F.lit(level).alias("level"), "x.node.*", "x.siblings",
                    (F.lit(level) + F.col("steps")).alias("up_level"), "up_pos", "above"))
    up = got.select("tree", "depth", F.struct(F.col("block").alias("pos"), above.alias("digest")).alias("node"))
    return rows, up


def build(nodes: DataFrame) -> list[DataFrame]:
    """Stored rows of all trees by ``STRIDE`` levels, from their numbered leaves; one job for each."""
    out, level = [], 0
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    while True:
        nodes = materialize(nodes) if level else nodes
        rows, up = _block(nodes, level)
        out.append(materialize(rows))
        level += STRIDE
        if level >= deepest:
            return out
        nodes = up.filter(F.col("depth") > level)


def manifest(docs: DataFrame, ident: str, label: str, leaf: Column, altered: Column) -> DataFrame:
    """(ident, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``leaf`` is the digest of a row and ``altered`` the digest that is folded in
    its place.  Leaves of a tree ascend by ident, null first, then by digest; rows
    that repeat each have a leaf and a proof of their own.  A null label has a tree
    of its own, before all others.  Extra columns are ignored, no rows give none.
    """
    spark = docs.sparkSession
    tree = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("-"))
    told = F.unhex("digest")
    other = F.when(F.col("altered") != F.col("digest"), F.unhex("altered"))
    # digests first, so that texts are read once
    read = materialize(docs.select(tree.alias("tree"), F.col(ident).alias("ident"), leaf.alias("digest"), altered.alias("altered"))
                       .select("tree", "ident", told.alias("digest"), other.alias("altered")))
    leaves = numbered(read, ["tree", "ident", "digest"], "no")
    trees = numbered(leaves.groupBy("tree").agg(F.min("no").alias("first"), F.count(F.lit(1)).alias("n")), ["tree"], "place")
    trees = materialize(trees.withColumn("depth", F.ceil(F.log2("n")).cast("int")))

    pos = F.col("no") - F.col("first")
    low = build(leaves.join(trees.select("tree", "first", "depth"), "tree").select(
        "tree", "depth", F.struct(pos.alias("pos"), "digest", "no", "ident", "altered").alias("node")))
    subroots = materialize(reduce(DataFrame.unionByName, [x.filter("up_level = depth and pos = 0").select("tree", "above") for x in low]))
    depth = F.ceil(F.log2(F.lit(max(trees.count(), 1)))).cast("int")
    top = reduce(DataFrame.unionByName, build(subroots.join(trees, "tree").select(
        F.lit(TOP).alias("tree"), depth.alias("depth"), F.struct(F.col("place").alias("pos"), F.col("above").alias("digest")).alias("node"))))
    root = top.filter("up_level = depth and pos = 0").select(F.lower(F.hex("above")).alias("root")).first()
    root = F.lit(root["root"] if root else None).cast("string")

    def linked(rows: DataFrame, *more: str) -> DataFrame:
        """Rows whose parent is the root of their tree lead on to its leaf in the last tree."""
        last = F.col("up_level") == F.col("depth")
        return rows.join(trees.select("tree", "place"), "tree").select(
            "tree", "level", "pos", "siblings", F.when(last, TOP).otherwise(F.col("tree")).alias("up_tree"),
            F.when(last, 0).otherwise(F.col("up_level")).alias("up_level"),
            F.when(last, F.col("place")).otherwise(F.col("up_pos")).alias("up_pos"), *more)

    over = top.filter("depth > 0").select("tree", "level", "pos", "siblings", F.col("tree").alias("up_tree"), "up_level", "up_pos")
    nodes = reduce(DataFrame.unionByName, [*map(linked, low[1:]), over])
    nodes = materialize(nodes.withColumn("copy", F.explode(F.sequence(F.lit(0), F.expr(_copies("tree", "level")) - 1))))
    first = linked(low[0], "no", "ident", "digest", "altered")
    done = spark.sql(CLIMB, start=first, nodes=nodes)
    text = lambda c: F.lower(F.hex(c))
    at_top = (F.col("tree") == TOP) & (F.col("level") == depth)
    steps = done.select("no", "step", "proof", F.when(at_top, F.col("folded")).alias("folded"), F.lit(None).cast("string").alias("tree"),
                        F.lit(None).cast(docs.schema[ident].dataType).alias("ident"), F.lit(None).cast("binary").alias("digest"))
    own = first.select("no", F.lit(0).alias("step"), F.expr(_joined("siblings")).alias("proof"), F.lit(None).cast("binary").alias("folded"),
                       "tree", "ident", "digest")
    put = (own.unionByName(steps).groupBy("no").agg(
        F.array_sort(F.collect_list(F.struct("step", "proof"))).alias("steps"), *[F.max(c).alias(c) for c in ("folded", "tree", "ident", "digest")]))
    proof = F.aggregate("steps", F.lit(b""), lambda x, s: F.concat(x, s["proof"]))
    return (put.join(subroots, "tree").select(
        F.col("ident").alias(ident), text("digest").alias("leaf"), text("above").alias("subroot"), root.alias("root"),
        h(text(proof)).alias("proof_sha256"), text("folded").alias("folded_root"))
        .withColumn("verified", F.col("folded_root") == root))


def _copies(tree: str, level: str) -> str:
    return f"case when {tree} = '{TOP}' then {1 << COPIES} else shiftleft(1, least({level} div 2, {COPIES})) end"


def _joined(siblings: str) -> str:
    return f"aggregate({siblings}, x'', (x, s) -> concat(x, coalesce(s, x'')))"


def _fold(digest: str, n: str) -> str:
    return f"""case when size({n}.siblings) = 0 then {digest} else
    unhex(aggregate(sequence(0, size({n}.siblings) - 1), lower(hex({digest})), (x, j) -> case
      when {n}.siblings[j] is null then sha2(x, 256)
      when shiftright({n}.pos, j) % 2 = 1 then sha2(concat(lower(hex({n}.siblings[j])), x), 256)
      else sha2(concat(x, lower(hex({n}.siblings[j]))), 256) end)) end"""


#: A leaf's own row is where it starts; its place is then dealt over the copies of the row it meets next.
CLIMB = f"""
with recursive climb as (
  select no, 1 as step, up_tree as tree, up_level as level, up_pos as pos, {_fold('coalesce(s.altered, s.digest)', 's')} as folded, x'' as proof
  from {{start}} s
  union all
  select c.no, c.step + 1, n.up_tree, n.up_level, n.up_pos, {_fold('c.folded', 'n')}, {_joined('n.siblings')}
  from climb c join {{nodes}} n on c.tree = n.tree and c.level = n.level and c.pos = n.pos and c.no % ({_copies('c.tree', 'c.level')}) = n.copy)
select * from climb limit all"""
