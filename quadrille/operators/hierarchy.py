"""Parent-child links to full hierarchies: every ancestor with its distance, roots, paths and cycles.

The method is a contraction. A deterministic hash of the node chooses splitters. Every node is walked to its next splitters
(``local``): a round joins only the ends reached in exactly 2^k steps with what is known so far, and gives all pairs of up to
2^(k+1) steps, so a walk of n steps takes about log2(n) rounds and no pair is formed twice from different halves. The much
smaller graph between splitters is solved (``reduced``), and the exact distances are expanded from the two. A cycle without any
splitter never leaves its local walk, which closes it there and ends; the reduced graph holds none of its nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import as_col
from quadrille.functions.codes import normalize_code
from quadrille.runtime import materialize, materialize_counted, release

#: One node in so many is a splitter.
SPLIT_ONE_IN = 8


def clean_edges(links: DataFrame, parent: str, child: str) -> DataFrame:
    """Distinct (p, c) of two code columns in normal form; null, blank and self links are dropped."""
    two = links.select(normalize_code(parent).alias("p"), normalize_code(child).alias("c"))
    return two.where((F.col("p") != "") & (F.col("c") != "") & (F.col("p") != F.col("c")))


def prerequisite_edges(prereqs: DataFrame, graph: DataFrame) -> DataFrame:
    """Distinct edges from a course to the courses that need it, of the links table and both lists of the export.

    Links with is_coreq true or null are none. Empty tables give no edges; other columns are ignored.
    """
    links = clean_edges(prereqs.where(~F.col("is_coreq")), "prereq_code", "course_code")
    up = clean_edges(graph.select("course_code", F.explode("parents").alias("x")), "x", "course_code")
    down = clean_edges(graph.select("course_code", F.explode("children").alias("x")), "course_code", "x")
    return links.unionByName(up).unionByName(down).distinct()


def is_splitter(node, one_in: int = SPLIT_ONE_IN):
    return F.pmod(F.xxhash64(as_col(node)), F.lit(one_in)) == 0


def _shortest(*parts: DataFrame) -> DataFrame:
    """The least d of each (u, v); partial aggregation runs before the shuffle."""
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("u", "v").agg(F.min("d").alias("d"))


def _chain(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs joined at v of the left and u of the right, with the sum of their lengths."""
    r = right.select(F.col("u").alias("m"), F.col("v").alias("w"), F.col("d").alias("e"))
    return left.join(r, left["v"] == r["m"]).select("u", F.col("w").alias("v"), (F.col("d") + F.col("e")).alias("d"))


def state_of_round():
    """What tells one round from the next: the number of pairs and the sum of their lengths."""
    return F.count(F.lit(1)).alias("n"), F.sum("d").alias("d")


def _close(step: DataFrame) -> DataFrame:
    """Min-plus closure of a small weighted graph by doubling."""
    known, before = materialize_counted(step, "close", *state_of_round())
    while True:
        now, state = materialize_counted(_shortest(known, _chain(known, known)), "close", *state_of_round())
        release(known)
        known = now
        if state == before:
            return known
        before = state


def _walk(step: DataFrame, through) -> tuple[DataFrame, list[DataFrame]]:
    """All pairs joined by a path whose inner nodes pass ``through``, with the least number of steps; and the tables that hold them.

    A pair at a distance from 2^k + 1 to 2^(k+1) has a node at exactly 2^k on a shortest path, so joining the pairs at that
    distance with all shorter ones finds each of them; what is known already is shorter and stays.
    """
    parts = [materialize(step, "walk")]
    known, k = parts[0], 1
    while True:
        far = _chain(known.where((F.col("d") == k) & through(F.col("v"))), known).groupBy("u", "v").agg(F.min("d").alias("d"))
        found, state = materialize_counted(far.join(known, ["u", "v"], "left_anti"), "walk", F.count(F.lit(1)).alias("n"))
        if not state["n"]:
            release(found)
            return known, parts
        parts.append(found)
        known, k = known.unionByName(found), 2 * k


def ancestors(edges: DataFrame, one_in: int = SPLIT_ONE_IN) -> DataFrame:
    """(ancestor, node, steps): each pair joined by a path of one edge or more, with the length of the shortest.

    edges: distinct columns p and c. A node on a cycle is its own ancestor. No edges give no rows; repeated edges change
    nothing; null ends must have been removed (``clean_edges`` does).
    """
    split = lambda node: is_splitter(node, one_in)
    step = edges.select(F.col("p").alias("u"), F.col("c").alias("v"), F.lit(1).alias("d")).distinct()
    local, parts = _walk(step, lambda v: ~split(v))
    into = local.where(split("v"))
    reduced = _close(into.where(split("u")))
    reach = materialize(_shortest(into, _chain(into, reduced)), "reach")
    out = materialize(_shortest(local.where(~split("v")), reach, _chain(reach, local.where(split("u") & ~split("v")))), "ancestors")
    release(*parts, reduced, reach)
    return out.select(F.col("u").alias("ancestor"), F.col("v").alias("node"), F.col("d").alias("steps"))


def trimmed(edges: DataFrame, least: float = 0.3) -> DataFrame:
    """Edges that may lie on a cycle: those out of nodes without parents and into nodes without children are taken off.

    The rounds end once one takes off less than the share ``least``; edges of cycles always stay.
    """
    core = materialize(edges, "core")
    size = core.count()
    while size:
        starts, ends = core.select(F.col("c").alias("p")).distinct(), core.select(F.col("p").alias("c")).distinct()
        now, state = materialize_counted(core.join(starts, "p", "left_semi").join(ends, "c", "left_semi"), "core", F.count(F.lit(1)).alias("n"))
        release(core)
        core, before, size = now, size, state["n"]
        if size > (1 - least) * before:
            break
    return core


def cycles_of(edges: DataFrame) -> DataFrame:
    """(node, cycle) as ``cycles`` gives them, with the closure of the edges alone that may lie on a cycle."""
    core = trimmed(edges)
    out = materialize(cycles(ancestors(core)), "cycles")
    release(core)
    return out


def cycles(closure: DataFrame) -> DataFrame:
    """(node, cycle): each node on a cycle and the least node of its strongly connected component."""
    own = closure.where(F.col("ancestor") == F.col("node")).select("node")
    inside = closure.join(own.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi").join(own, "node", "left_semi")
    back = inside.select(F.col("node").alias("a2"), F.col("ancestor").alias("n2"))
    mutual = inside.join(back, (F.col("ancestor") == F.col("a2")) & (F.col("node") == F.col("n2")))
    return mutual.groupBy("node").agg(F.min("ancestor").alias("cycle"))


def rooted_paths(edges: DataFrame, closure: DataFrame, one_in: int = SPLIT_ONE_IN) -> DataFrame:
    """(node, root, depth, path): each node below its nearest root, the least code of equals.

    A root has no parent. Of several shortest paths that with the least parent at every step is given. Nodes that no root
    reaches, being on or below a rootless cycle, have root, depth and path null. The chosen parents are pointers without
    cycles: each is followed up to the next hash splitter, the pointers between splitters are followed to the roots, and the
    paths of all other nodes are those of their splitter with their own steps behind. Each round joins pointers with those
    they lead to.
    """
    nodes = edges.select(F.col("p").alias("node")).union(edges.select("c")).distinct()
    roots = materialize(nodes.join(edges.select(F.col("c").alias("node")), "node", "left_anti"), "roots")
    near = closure.join(roots.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi")
    best = near.groupBy("node").agg(F.min(F.struct("steps", "ancestor")).alias("b"))
    zero = roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"))
    placed = materialize(best.select("node", F.col("b.ancestor").alias("root"), F.col("b.steps").alias("depth")).unionByName(zero), "placed")
    up = placed.select(F.col("node").alias("p"), F.col("root").alias("r"), (F.col("depth") + 1).alias("k"))
    parent = (
        edges.join(up, "p")
        .join(placed.withColumnRenamed("node", "c"), "c")
        .where((F.col("r") == F.col("root")) & (F.col("k") == F.col("depth")))
        .groupBy("c")
        .agg(F.min("p").alias("up"))
    )
    hop = materialize(
        placed.join(parent.withColumnRenamed("c", "node"), "node", "left").select(
            "node", "root", "depth", F.col("up").alias("at"), F.array("node").alias("path")
        ),
        "hop",
    )
    split = lambda node: F.col(node).isNull() | is_splitter(node, one_in)
    while not hop.where(~split("at")).isEmpty():
        now = materialize(_follow(hop.where(~split("at")), hop).unionByName(hop.where(split("at"))), "hop")
        release(hop)
        hop = now
    reduced = materialize(hop.where(split("node")), "reduced")
    while not reduced.where(F.col("at").isNotNull()).isEmpty():
        now = materialize(_follow(reduced, reduced), "reduced")
        release(reduced)
        reduced = now
    whole = reduced.unionByName(_follow(hop.where(~split("node")), reduced))
    return nodes.join(whole.drop("at"), "node", "left").select("node", "root", "depth", "path")


def _follow(hops: DataFrame, onto: DataFrame) -> DataFrame:
    """Each pointer (node, root, depth, at, path) joined to the pointer of the node it is at, with the two paths put together."""
    above = onto.select(F.col("node").alias("at"), F.col("at").alias("further"), F.col("path").alias("above"))
    path = F.when(F.col("above").isNull(), F.col("path")).otherwise(F.concat("above", "path"))
    return hops.join(above, "at", "left").select("node", "root", "depth", F.col("further").alias("at"), path.alias("path"))
