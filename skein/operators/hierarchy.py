"""Parent-child links to full hierarchies by pointer doubling (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.runtime import cut


def span_links(spans: DataFrame) -> DataFrame:
    """One row (tree, node, parent) per span, ids in lower case.

    The parent is the span_id of the first CHILD_OF ref into the span's own trace. Of a repeated span the copy
    delivered first decides (null delivery last, then the smallest parent). Rows without ids are left out.
    """
    own = F.filter(F.col("refs"), lambda r: (r["ref_type"] == "CHILD_OF") & (F.lower(r["trace_id"]) == F.lower(F.col("trace_id"))))
    rows = spans.select(
        F.lower("trace_id").alias("tree"), F.lower("span_id").alias("node"),
        F.lower(F.get(own, F.lit(0))["span_id"]).alias("parent"), F.col("ingested_at").alias("_at"),
    ).filter(F.col("tree").isNotNull() & F.col("node").isNotNull())
    return rows.groupBy("tree", "node").agg(
        F.min_by(F.struct("parent"), F.struct(F.col("_at").isNull(), "_at", F.col("parent").isNull(), "parent"))["parent"].alias("parent")
    )


def _doubling(state: DataFrame, step, fold) -> DataFrame:
    """Runs rounds until no node is open (jump not null) or a round finishes none: then the rest hangs on cycles.

    ``step(opened, state)`` moves the open nodes one doubling on, ``fold(moved, opened)`` adds what rides along. Each
    round is checkpointed in the shared folder, so a lost executor costs no earlier round.
    """
    state = cut(state)
    left = state.filter(F.col("jump").isNotNull()).count()
    while left:
        opened, done = state.filter(F.col("jump").isNotNull()), state.filter(F.col("jump").isNull())
        state = cut(fold(step(opened, state).unionByName(done), opened))
        before, left = left, state.filter(F.col("jump").isNotNull()).count()
        if left == before:
            break
    return state


def _linked(named: DataFrame, columns: list[str]) -> DataFrame:
    """id, columns and jump (the parent's id, null without one) of rows with tree, node, parent and id."""
    above = named.select("tree", F.col("node").alias("parent"), F.col("id").alias("jump"))
    start = ["id", *columns, "jump"]
    has = named.filter(F.col("parent").isNotNull()).join(above, ["tree", "parent"], "left").select(*start)
    return has.unionByName(named.filter(F.col("parent").isNull()).withColumn("jump", F.lit(None).cast("bigint")).select(*start))


def _resolved(linked: DataFrame, root: Column, with_path: bool = False) -> DataFrame:
    """id, jump (null but on or below a cycle), root (the value that the topmost node has there), acc (the depth), size of the
    subtree and, if asked for, path (from node to root). Rows of ``linked``: id, jump, node for the path and what ``root`` reads."""
    extra = ["path"] if with_path else []
    top = F.col("jump").isNull()
    state = linked.withColumns({"root": F.when(top, root), "acc": F.when(top, 0).otherwise(1).cast("int"), "size": F.lit(1).cast("bigint"), **({"path": F.array("node")} if with_path else {})})
    state = state.select("id", "jump", "root", "acc", "size", *extra)

    def step(opened: DataFrame, state: DataFrame) -> DataFrame:
        target = state.select(F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("root").alias("_root"), F.col("acc").alias("_acc"), *[F.col(c).alias(f"_{c}") for c in extra])
        return opened.join(target, "jump").select("id", F.col("_jump").alias("jump"), F.col("_root").alias("root"), (F.col("acc") + F.col("_acc")).alias("acc"), "size", *[F.concat(c, f"_{c}").alias(c) for c in extra])

    def fold(moved: DataFrame, opened: DataFrame) -> DataFrame:
        gain = opened.groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("_gain"))
        return moved.join(gain, "id", "left").withColumn("size", F.col("size") + F.coalesce("_gain", F.lit(0))).drop("_gain")

    return _doubling(state, step, fold)


def resolve(links: DataFrame, with_path: bool = False) -> DataFrame:
    """tree, node, root, depth, n_descendants and, if asked for, path (array from root to node).

    ``links``: tree, node (unique within the tree), parent (null, or a node that need not exist: then a root).
    Nodes on a cycle or below one get root '', depth and n_descendants -1 and a null path.

    Each round joins every unfinished node to its current ancestor and doubles the distance it looks up, so a depth of
    d takes about log2(d) rounds; descendant counts ride along (a node adds the count of all nodes that point at it
    over exactly the present distance), so no ancestor pairs are produced. A round that finishes no node proves that
    the rest hangs on cycles: of the unfinished, those with depth up to twice the distance would have finished.

    Rounds carry row numbers instead of ids: they are given once, in a checkpointed table, and stand for (tree, node)
    until the end. Finished nodes aren't joined again. A hot parent is met as one row per child on the way up, which
    AQE splits, and as one partial sum per task on the way down.
    """
    named = cut(links.select("tree", "node", "parent", F.monotonically_increasing_id().alias("id")))
    state = _resolved(_linked(named, ["node"] if with_path else []), F.col("id"), with_path)
    cyclic = F.col("jump").isNotNull()
    names = named.select("id", "tree", "node")
    tops = names.select(F.col("id").alias("root"), F.col("node").alias("_root"))
    rooted = state.filter(F.col("jump").isNull() & (F.col("id") == F.col("root"))).select("root").join(tops, "root")
    whole = state.join(names, "id").join(rooted, "root", "left")
    out = [
        "tree", "node", F.when(cyclic, "").otherwise(F.col("_root")).alias("root"),
        F.when(cyclic, -1).otherwise(F.col("acc")).alias("depth"), F.when(cyclic, -1).otherwise(F.col("size") - 1).alias("n_descendants"),
    ]
    return whole.select(*out, *([F.when(~cyclic, F.reverse("path")).alias("path")] if with_path else []))


def descendants(resolved: DataFrame) -> DataFrame:
    """tree, node, descendant, distance: one row per proper descendant, from the paths of ``resolve(with_path=True)``.

    The result itself has as many rows as the depths add up to; nothing larger is built on the way.
    """
    above = F.slice("path", 1, F.size("path") - 1)
    return resolved.filter(F.col("path").isNotNull() & (F.size("path") > 1)).select(
        "tree", F.col("node").alias("descendant"), "depth", F.posexplode(above).alias("_at", "node")
    ).select("tree", "node", "descendant", (F.col("depth") - F.col("_at")).alias("distance"))


def nested_sets(links: DataFrame, order: str) -> DataFrame:
    """tree, node, left, right, above: nested-set numbers, without walking a tree in one task.

    ``links``: tree, node, parent (null at a root) and ``order``, by which, then by node, siblings go. left is the sum of
    1 + 2 * (sizes of the earlier siblings) over a node and its ancestors; above is the parent's left, -1 at a root. Nodes
    that hang on no node without a parent have 0.

    Two rounds of doubling, for the sizes and for the sums, over row numbers as in ``resolve``; what comes before either is
    checkpointed, so no plan holds another twice.
    """
    named = cut(links.select("tree", "node", "parent", order, F.monotonically_increasing_id().alias("id")))
    linked = cut(_linked(named, ["tree", "node", order, "parent"]).withColumn("whole", F.col("parent").isNull()).drop("parent"))
    sized = _resolved(linked, F.col("whole").cast("int")).filter(F.col("jump").isNull() & (F.col("root") == 1)).select("id", "size")
    before = Window.partitionBy("tree", "jump").orderBy(order, "node").rowsBetween(Window.unboundedPreceding, -1)
    weight = 1 + 2 * F.coalesce(F.sum("size").over(before), F.lit(0))
    weights = cut(linked.join(sized, "id").select("id", "jump", "size", weight.alias("weight")))

    def step(opened: DataFrame, state: DataFrame) -> DataFrame:
        target = state.select(F.col("id").alias("jump"), F.col("jump").alias("_jump"), F.col("acc").alias("_acc"))
        return opened.join(target, "jump").select("id", F.col("_jump").alias("jump"), (F.col("acc") + F.col("_acc")).alias("acc"))

    sums = _doubling(weights.select("id", "jump", F.col("weight").alias("acc")), step, lambda moved, _: moved).select("id", F.col("acc").alias("left"))
    top = F.col("jump").isNull()
    numbers = weights.join(sums, "id").select("id", "left", (F.col("left") + 2 * F.col("size") - 1).alias("right"), F.when(top, -1).otherwise(F.col("left") - F.col("weight")).alias("above"))
    names = named.select("id", "tree", "node")
    return names.join(numbers, "id", "left").select("tree", "node", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("left", "right", "above")])


def reach(links: DataFrame, flag: str) -> DataFrame:
    """tree, node, above, below: whether any proper ancestor, or any proper descendant, has ``flag``.

    Works on cycles too: rounds go on until the distance covers every unfinished node.
    """
    known = links.select("tree", F.col("node").alias("parent"), F.col(flag).alias("_up"))
    f = F.coalesce(F.col(flag), F.lit(False))
    state = links.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("_up").isNotNull(), F.col("parent")).alias("jump"), F.coalesce("_up", F.lit(False)).alias("above"), f.alias("inside"), F.lit(False).alias("below")
    )
    state, distance = cut(state), 1
    while (left := state.filter(F.col("jump").isNotNull()).count()) and distance <= 2 * left:
        up = state.select("tree", F.col("node").alias("jump"), F.col("jump").alias("_jump"), F.col("above").alias("_above"))
        opened, done = state.filter(F.col("jump").isNotNull()), state.filter(F.col("jump").isNull())
        moved = opened.join(up, ["tree", "jump"]).select("tree", "node", F.col("_jump").alias("jump"), (F.col("above") | F.col("_above")).alias("above"), "inside", "below")
        gain = opened.groupBy("tree", F.col("jump").alias("node")).agg(F.max(F.col("inside") | F.col("below")).alias("_gain"))
        state = moved.unionByName(done).join(gain, ["tree", "node"], "left").withColumn("below", F.col("below") | F.coalesce("_gain", F.lit(False))).drop("_gain")
        state, distance = cut(state), distance * 2
    return state.select("tree", "node", "above", "below")
