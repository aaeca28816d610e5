"""Parent-child links to full hierarchies: path, depth, root, descendants and cycles of a forest of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ontoloom.runtime import checkpoint, hot_keys, lookup

#: One node in so many is a splitter; walks to the next splitter are about this long.
SPLIT_EVERY = 8
#: Pointers are joined this often in a job; each job makes them HOPS + 1 times as long.
HOPS = 3


def parent_links(rows: DataFrame, node: str, parent: str, order: str) -> DataFrame:
    """(node, parent): one row per distinct non-null `node`; the parent is that of its row with the smallest `order`."""
    first = F.min(F.struct(F.col(order), F.col(parent).alias("p")))
    return rows.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(first.alias("f")).select("node", F.col("f.p").alias("parent"))


def _advance(ptr: DataFrame, with_paths: bool) -> DataFrame:
    """Open pointers of `ptr`, HOPS times replaced by that of the node they point to, or as far as they get."""
    seg = ["seg"] if with_paths else []
    more = ["concat(seg, coalesce(_seg, cast(array() as array<string>))) as seg"] if with_paths else []
    rest = [c for c in ptr.columns if c not in ("nxt", "d", "low", "stop", "seg")]
    nxt = ptr.selectExpr("node as _k", "-1 as _s", *[f"{c} as _{c}" for c in ("nxt", "d", "low", "stop", *seg)])
    moved = ptr.where("not stop")
    for _ in range(HOPS):
        # pointers that have stopped on the way meet no row and are spread by a salt
        keyed = moved.selectExpr("*", "if(stop, null, nxt) as _to", "if(stop, pmod(hash(node), 65536), -1) as _salt")
        both = keyed.join(nxt, F.expr("_to <=> _k and _salt = _s"), "left")
        moved = both.selectExpr(*rest, "coalesce(_nxt, nxt) as nxt", "d + coalesce(_d, 0) as d", "least(low, _low) as low", "coalesce(_stop, true) as stop", *more)
    return moved


def _written(ptr: DataFrame, replaces: DataFrame | None = None) -> tuple[DataFrame, int]:
    """A written pointer table and the number of its open pointers, counted on the way."""
    seen = Observation()
    out = checkpoint(ptr.observe(seen, F.expr("count_if(not stop) as open")), replaces=replaces)
    return out, seen.get["open"]


def _walk(start: DataFrame, with_paths: bool) -> DataFrame:
    """Follow all pointers until they have stopped.

    start: node, nxt, d (steps), low (smallest node among node and those walked, without nxt), stop (nxt ends the walk)
    and, with_paths, seg (nodes after `node` up to and including nxt); other columns stay. Returns the same columns;
    a pointer that runs on a cycle without a stop comes back with stop = false, nxt on the cycle and low the
    smallest node of the cycle.
    """
    # An open pointer has passed `hops` nodes. Of a way that ends, only the nodes more than `hops` before its end are
    # open, so no such way is longer than hops + open nodes; what is still open beyond that goes round.
    ptr, open_n = _written(start)
    hops, most = 1, None
    while open_n:
        most = min(hops + open_n, most or hops + open_n)
        if hops > most:
            break
        ptr, open_n = _written(ptr.where("stop").unionByName(_advance(ptr, with_paths)), replaces=ptr)
        hops *= HOPS + 1
    else:
        return ptr
    # what is still open runs on cycles: from a node on the cycle the walk has covered the whole cycle
    looped = ptr.where(~F.col("stop"))
    on_cycle = looped.select(F.col("node").alias("nxt"), F.col("low").alias("_l"))
    looped = looped.join(on_cycle, "nxt", "left").withColumn("low", F.coalesce("_l", "low")).drop("_l")
    return checkpoint(ptr.where("stop").unionByName(looped), replaces=ptr)


def resolve(links: DataFrame, with_paths: bool = False, split_every: int = SPLIT_EVERY) -> DataFrame:
    """Solve a table of links (node unique and not null, parent or null) of any shape.

    Deterministic hash splitters cut the ways up into short walks; every node walks to its next splitter
    or root, the splitters alone form a reduced graph that is solved in turn, and its results are
    expanded to all nodes. Ways into cycles, also such without a splitter, get depth -1 and the smallest
    node of the cycle as root.

    Returns node, root, depth (int) and, with_paths, path (array from the root to the node; null for
    nodes whose way up never ends). A parent without a row of its own is a root. Empty input gives
    an empty result; an empty string is a node like any other.
    """
    solved = _solve(links, False, split_every)
    if not with_paths:
        return solved
    # paths are gathered over the ways that end; those that go round would grow without end
    solved = checkpoint(solved)
    paths = _solve(links.join(solved.where("depth >= 0").select("node"), "node", "left_semi"), True, split_every)
    return paths.unionByName(solved.where("depth < 0").withColumn("path", F.lit(None).cast("array<string>")))


def _solve(links: DataFrame, with_paths: bool, split_every: int) -> DataFrame:
    links = checkpoint(links.select("node", "parent"))
    # parents with a thousandth of the rows are splitters too, so that no walk goes on from a hot node; at most HOT_SHARE rows
    hot = hot_keys(links, "parent").withColumnRenamed("parent", "_hot")

    def splits(rows: DataFrame, name: str, flag: str) -> DataFrame:
        joined = rows.join(F.broadcast(hot), F.col(name) == F.col("_hot"), "left")
        return joined.withColumn(flag, (F.pmod(F.xxhash64(name), F.lit(split_every)) == 0) | F.col("_hot").isNotNull()).drop("_hot")

    first = splits(splits(links.where(F.col("parent").isNotNull()), "node", "split"), "parent", "stop")
    seg = [F.array("parent").alias("seg")] if with_paths else []
    walked = _walk(first.select("node", F.col("parent").alias("nxt"), F.lit(1).alias("d"), F.col("node").alias("low"), "stop", "split", *seg), with_paths)
    roots = links.where(F.col("parent").isNull()).select("node")

    # the reduced graph: splitters pointing to splitters; anything else, which has no row here, is an end
    reduced = walked.where(F.col("stop") & F.col("split")).drop("split").withColumn("stop", F.lit(False))
    # splitters whose walk ends in a splitterless cycle count as ends too, and hand that cycle on
    solved = _walk(reduced, with_paths)
    loops = walked.where(~F.col("stop")).select(F.col("node"), F.col("low").alias("cycle"))
    ends = solved.join(loops.withColumnRenamed("node", "nxt"), "nxt", "left").select(
        "node",
        F.when(F.col("cycle").isNotNull(), F.col("cycle")).when(F.col("stop"), F.col("nxt")).otherwise(F.col("low")).alias("root"),
        F.when(F.col("cycle").isNotNull() | ~F.col("stop"), F.lit(-1)).otherwise(F.col("d")).alias("depth"),
        *([F.col("seg")] if with_paths else []),
    )
    ends = checkpoint(ends)
    into = loops.select("node", F.col("cycle").alias("root"), F.lit(-1).alias("depth"), *([F.lit(None).cast("array<string>").alias("seg")] if with_paths else []))
    up = ends.unionByName(into).select(F.col("node").alias("nxt"), F.col("root").alias("_r"), F.col("depth").alias("_d"), *([F.col("seg").alias("_g")] if with_paths else []))
    joined = lookup(walked.where("stop"), up, "nxt")
    path = [F.when(F.coalesce("_d", F.lit(0)) >= 0, F.reverse(F.concat(F.array("node"), "seg", F.coalesce("_g", F.array().cast("array<string>"))))).alias("path")] if with_paths else []
    out = joined.select("node", F.coalesce("_r", "nxt").alias("root"), F.when(F.col("_d") < 0, -1).otherwise(F.col("d") + F.coalesce("_d", F.lit(0))).cast("int").alias("depth"), *path)
    none = [F.lit(None).cast("array<string>").alias("path")] if with_paths else []
    out = out.unionByName(loops.select("node", F.col("cycle").alias("root"), F.lit(-1).alias("depth"), *none))
    return out.unionByName(roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), *([F.array("node").alias("path")] if with_paths else [])))


def descendants(solved: DataFrame) -> DataFrame:
    """(ancestor, node, steps) for every node below every ancestor, from the paths of `resolve(..., with_paths=True)`."""
    return (
        solved.where(F.size("path") > 1)
        .select("node", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "ancestor"), F.size("path").alias("n"))
        .select("ancestor", "node", (F.col("n") - 1 - F.col("i")).alias("steps"))
    )
