"""Table, feature and model lineage as node and edge tables.

``edges`` has (src, dst): ``src`` is upstream of ``dst``. Walks start from many
datasets at once; what lies above a dataset is walked once for all starts below it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import csv_to_array, urn_table_key
from ..session import materialize


@dataclass(frozen=True)
class Graph:
    """The distinct links (up, down, own, inner) of a graph, whose ids are hashes of names or, should two names share one, numbers.

    ``first`` (id, name) are the starts and ``own`` marks the links above them; a start without any has a row with
    ``up`` null. ``inner`` marks the links above a node that is itself above another one: what a walk from the
    starts' parents can meet. ``nodes`` (id, name) are all upper ends and the further datasets.
    """

    first: DataFrame
    nodes: DataFrame
    table: DataFrame
    hashed: bool

    @property
    def links(self) -> DataFrame:
        return self.table.where("up is not null").select("up", "down")

    @property
    def own(self) -> DataFrame:
        return self.table.where("own and up is not null").select("up", "down")

    @property
    def inner(self) -> DataFrame:
        return self.table.where("inner and up is not null").select("up", "down")

    @property
    def lonely(self) -> DataFrame:
        return self.table.where("up is null").select(F.col("down").alias("start"))

    @property
    def known(self) -> DataFrame:
        """Starts and upper ends, each once."""
        return self.nodes.unionByName(self.first.join(self.nodes.select("id"), "id", "left_anti"))

    def ids(self, names: DataFrame, **columns: str) -> DataFrame:
        """Distinct rows of ``names`` with the ids of the named columns, under the given new names."""
        if self.hashed:
            return names.select(*[F.xxhash64(old).alias(new) for new, old in columns.items()]).distinct()
        known = self.known
        for new, old in columns.items():
            names = names.join(known.select(F.col("id").alias(f"_{new}"), F.col("name").alias(old)), old)
        return names.select(*[F.col(f"_{new}").alias(new) for new in columns]).distinct()


def _marked(links: DataFrame, first: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links with ``own`` and ``inner``. All three are dealt by the lower end, so links are shuffled once."""
    starts = first.select(F.col("id").alias("down"), F.lit(True).alias("_own"))
    uppers = nodes.select(F.col("id").alias("down"), F.lit(True).alias("_inner")).distinct()
    flags = [F.coalesce(f"_{c}", F.lit(False)).alias(c) for c in ("own", "inner")]
    return links.join(starts, "down", "full").join(uppers, "down", "left").select(*links.columns, *flags)


def numbered(edges: DataFrame, starts: DataFrame, *datasets: DataFrame) -> Graph:
    """The graph of the distinct edges.

    Names are long texts; the walks below shuffle and compare eight-byte ids, and names come
    back in the end. An id is the name's hash, so edges are numbered without a join and names are
    kept of starts and upper ends only, as no walk comes to any other. A second hash of each name tells
    whether two names share an id; then all are numbered one by one instead.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    starts, *datasets = (d.select(F.col("dataset").alias("name")).where("name is not null") for d in (starts, *datasets))
    uppers = reduce(lambda a, b: a.unionByName(b), datasets, edges.select(F.col("src").alias("name")))
    by_hash = [F.xxhash64("name").alias("id"), "name"]
    first, nodes = materialize(starts.select(*by_hash).distinct(), "first"), materialize(uppers.select(*by_hash).distinct(), "nodes")
    links = edges.select(F.xxhash64("src").alias("up"), F.xxhash64("dst").alias("down"), F.hash("src").alias("up_check"), F.hash("dst").alias("down_check"))
    table = materialize(_marked(links.repartition("down").distinct(), first, nodes), "links")
    checks = [table.where("up is not null").select(F.col(c).alias("id"), F.col(f"{c}_check").alias("check")) for c in ("up", "down")]
    checks += [d.select("id", F.hash("name").alias("check")) for d in (first, nodes)]
    seen = reduce(lambda a, b: a.unionByName(b), checks).groupBy("id").agg(F.min("check").alias("a"), F.max("check").alias("b"))
    if seen.where("a <> b").isEmpty():
        return Graph(first, nodes, table.drop("up_check", "down_check"), True)
    names = reduce(lambda a, b: a.unionByName(b), [uppers, starts, edges.select(F.col("dst").alias("name"))]).distinct()
    known = materialize(names.select(F.monotonically_increasing_id().alias("id"), "name"), "nodes")
    first, nodes = materialize(known.join(starts, "name", "left_semi").select("id", "name"), "first"), materialize(known.join(uppers, "name", "left_semi").select("id", "name"), "nodes")
    up, down = (known.select(F.col("id").alias(i), F.col("name").alias(n)) for i, n in (("up", "src"), ("down", "dst")))
    return Graph(first, nodes, materialize(_marked(edges.distinct().join(up, "src").join(down, "dst").select("up", "down"), first, nodes), "links"), False)


def named(df: DataFrame, nodes: DataFrame, columns: Sequence[str], how: str = "left") -> DataFrame:
    """Replace ids by names."""
    for c in columns:
        df = df.withColumnRenamed(c, "_id").join(nodes.select(F.col("id").alias("_id"), F.col("name").alias(c)), "_id", how).drop("_id")
    return df


def _pairs(links: DataFrame, starts: DataFrame, depth: int | None) -> DataFrame:
    """(start, at, hop) by a walk of each node of ``starts`` on its own, a join per level."""
    visited = frontier = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.lit(0).alias("hop"))
    lower = materialize(links.select(F.col("down").alias("at")).distinct(), "lower")
    hop = 1
    while depth is None or hop < depth:
        # nodes with nothing above end here: where none is left, the links are not shuffled for them
        frontier = materialize(frontier.join(lower, "at", "left_semi"), "open")
        if frontier.isEmpty():
            break
        reached = frontier.join(links, frontier["at"] == links["down"]).select("start", F.col("up").alias("at")).distinct()
        fresh = reached.join(visited.select("start", "at"), ["start", "at"], "left_anti")
        frontier = materialize(fresh.withColumn("hop", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        hop += 1
    return visited


SHARED_FROM = 50_000  # nodes of a level from which the two more jobs of sharing pay


def distances(links: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """(start, at, hop): every node upstream of each start (``node``) at its shallowest hop.

    What lies above a node is shared by all nodes below it. While a level is large and its
    parents are at most half as many as its nodes, the level waits and the walk starts from the
    parents, each once; then the waiting levels take over their parents' nodes, one hop further,
    the least hop of each. So many starts over few parents cost one expansion. Where parents do
    not thin out, in cycles and on small levels each node walks for itself; the rows are the same.
    """
    layers, size = [starts], starts.count()
    while size > SHARED_FROM and (depth is None or len(layers) < depth):
        parents = links.join(layers[-1], links["down"] == layers[-1]["node"], "left_semi").select(F.col("up").alias("node")).distinct()
        parents = materialize(parents, "layer")
        above = parents.count()
        if not above or 2 * above > size:
            break
        layers.append(parents)
        size = above
    walk = _pairs(links, layers.pop(), None if depth is None else depth - len(layers))
    for layer in reversed(layers):
        above = walk.select(F.col("start").alias("up"), "at", (F.col("hop") + 1).alias("hop"))
        taken = links.join(layer, links["down"] == layer["node"]).select(F.col("down").alias("start"), "up").join(above, "up").where("at <> start")
        own = layer.select(F.col("node").alias("start"), F.col("node").alias("at"), F.lit(0).alias("hop"))
        walk = materialize(taken.groupBy("start", "at").agg(F.min("hop").alias("hop")).unionByName(own), "walk")
    return walk


def parents_of(graph: Graph, depth: int | None = None) -> DataFrame | None:
    """The starts' parents, where it pays to walk from them instead: many starts over few parents."""
    size = graph.first.count()
    if size <= SHARED_FROM or (depth is not None and depth < 2):
        return None
    parents = materialize(graph.own.select(F.col("up").alias("node")).distinct(), "layer")
    return parents if 0 < 2 * parents.count() <= size else None


LIST = 64  # rows of a parent that go to its children together
ROWS_A_TASK = 400_000  # rows of starts that one task gathers


def handed_down(graph: Graph, rows: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(start, *columns): every start's rows of all its parents' ``rows`` (up, *columns), and of ``extra`` (start, *columns).

    A parent's rows travel in lists of about ``LIST``, so a link is one row of the shuffle. The result
    is dealt by start, in as many partitions as its rows need: what follows by start shuffles no more.
    """
    columns = [c for c in rows.columns if c != "up"]
    rows = materialize(rows, "handed")
    sizes = materialize(rows.groupBy("up").agg(F.count(F.lit(1)).alias("n")), "sizes")
    children = graph.own.groupBy("up").agg(F.count(F.lit(1)).alias("c"))
    total = children.join(sizes, "up").agg(F.sum(F.col("c") * F.col("n"))).first()[0] or 0
    part = F.pmod(F.hash(*columns), F.ceil(F.col("n") / LIST)).alias("part")
    lists = rows.join(sizes, "up").groupBy("up", part).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    out = graph.own.join(lists, "up").select(F.col("down").alias("start"), "rows")
    if extra is not None:
        out = out.unionByName(extra.select("start", F.array(F.struct(*columns)).alias("rows")))
    return out.repartition(max(1, math.ceil(total / ROWS_A_TASK)), "start").select("start", F.inline("rows"))


def with_parents(places: DataFrame, links: DataFrame, nodes: DataFrame, counted: bool = False) -> DataFrame:
    """``places`` with the name of ``at`` (dataset), a row for each parent's name (upstream), and with ``counted`` their number."""
    above = links.join(nodes.select(F.col("id").alias("up"), F.col("name").alias("upstream")), "up").select(F.col("down").alias("at"), "upstream")
    out = places.join(nodes.select(F.col("id").alias("at"), F.col("name").alias("dataset")), "at").join(above, "at", "left")
    if counted:
        out = out.join(links.groupBy(F.col("down").alias("at")).agg(F.count(F.lit(1)).alias("upstream_count")), "at", "left")
        out = out.withColumn("upstream_count", F.coalesce("upstream_count", F.lit(0).cast("long")))
    return out


def lineage_upstream(edges: DataFrame, starts: DataFrame, depth: int | None = None, counted: bool = False) -> DataFrame:
    """Breadth-first walk: one row per (start, hop, dataset, upstream).

    Each dataset is visited once per start, at its shallowest hop, so cycles end. Without
    ``depth`` the walk goes on to its end. With it ``depth`` levels are visited, the parents of
    the last one are listed but not visited, and ``has_more`` marks those rows. Null names are
    left out; a start without edges has one row. ``counted`` adds ``upstream_count``, as ``lineage_hops`` has it.
    Of many starts over few parents, the parents' walks are named and handed down.
    """
    graph = numbered(edges, starts)
    parents = parents_of(graph, depth)
    name = graph.first.select(F.col("id").alias("start"), F.col("name").alias("_start"))
    if parents is None:
        walk = _pairs(graph.links, graph.first.select(F.col("id").alias("node")), depth)
        known = graph.known
        out = with_parents(walk, graph.links, known, counted).join(name, "start")
    else:
        walk = distances(graph.inner, parents, None if depth is None else depth - 1)
        above = with_parents(walk.select(F.col("start").alias("up"), "at", (F.col("hop") + 1).alias("hop")), graph.inner, graph.nodes)
        nothing = {"at": F.lit(None).cast("long"), "hop": F.lit(0), "dataset": F.lit(None).cast("string")}
        near = parents.join(graph.nodes, parents["node"] == graph.nodes["id"]).select(F.col("node").alias("up"), F.col("name").alias("upstream")).withColumns(nothing)
        lonely = graph.lonely.withColumns(nothing | {"upstream": F.lit(None).cast("string")})
        rows = handed_down(graph, above.unionByName(near), lonely).where("at is null or at <> start")
        out = rows.groupBy("start", "dataset", "upstream").agg(F.min("hop").alias("hop")).join(name, "start")
        out = out.withColumn("dataset", F.coalesce("dataset", "_start"))
    out = out.select(F.col("_start").alias("start"), "hop", "dataset", *[c for c in out.columns if c == "upstream_count"], "upstream")
    if counted and parents is not None:
        out = lineage_hops(out)
    return out if depth is None else out.withColumn("has_more", (F.col("hop") == depth - 1) & F.col("upstream").isNotNull())


def lineage_downstream(edges: DataFrame, starts: DataFrame, depth: int | None = None, counted: bool = False) -> DataFrame:
    """The same walk along the edges: one row per (start, hop, dataset, downstream)."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    walk = lineage_upstream(turned, starts, depth, counted)
    return walk.withColumnsRenamed({"upstream": "downstream", "upstream_count": "downstream_count"})


def lineage_hops(walk: DataFrame, other: str = "upstream") -> DataFrame:
    """Every neighbour of every hop, one row each, with the number of the hop's neighbours.

    A hop without neighbours has one row, with none. Nothing is cut and no list is gathered;
    the count is a partial aggregate, so a hub is never one task's work. A walk that was made
    with its counts has them by id already.
    """
    key = ["start", "hop", "dataset"]
    if f"{other}_count" in walk.columns:
        return walk.select(*key, f"{other}_count", other)
    walk = materialize(walk.select(*key, other), "walk")
    totals = walk.groupBy(*key).agg(F.count(other).alias(f"{other}_count"))
    return walk.join(totals, key).select(*key, f"{other}_count", other)


def path_graph(links: DataFrame, starts: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, node, distance): for each target the nodes from which it can be reached and the
    fewest edges to it, of those nodes that a start reaches. Each path from a start to the target
    is made of links between two of its nodes, and each such node is on a path."""
    below, frontier = starts, starts
    while True:  # each node once, whichever start it is reached from
        up = frontier.join(links, frontier["node"] == links["down"]).select(F.col("up").alias("node")).distinct()
        frontier = materialize(up.join(below, "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        below = materialize(below.unionByName(frontier), "below")
    inside = materialize(links.join(below, links["down"] == below["node"], "left_semi"), "inside")
    turned = inside.select(F.col("down").alias("up"), F.col("up").alias("down"))
    ends = targets.join(below, "node", "left_semi")
    return materialize(distances(turned, materialize(ends, "ends")).select(F.col("start").alias("target"), F.col("at").alias("node"), F.col("hop").alias("distance")), "reach")


def _links_of(links: DataFrame, reach: DataFrame) -> DataFrame:
    """(target, down, up, nearer): the links of every target's path graph. None leaves the target:
    a path ends where it meets it."""
    top = reach.select("target", F.col("node").alias("up"), F.col("distance").alias("up_distance"))
    bottom = reach.where("distance > 0").select("target", F.col("node").alias("down"), "distance")
    joined = links.join(top, "up").join(bottom, ["target", "down"])
    return materialize(joined.select("target", "down", "up", (F.col("up_distance") < F.col("distance")).alias("nearer")), "path-links")


COUNT = "decimal(38,0)"


def _counted(graph: DataFrame, ends: DataFrame) -> DataFrame:
    """(target, node, n): the number of paths to the target by a sum over parents, in the order in
    which all parents of a node are known. Nodes on or below a cycle are never known."""
    needed = materialize(graph.groupBy("target", "down").agg(F.count(F.lit(1)).alias("needed")), "needed")
    new = materialize(ends.select("target", F.col("target").alias("node"), F.lit(1).cast(COUNT).alias("n")), "counted")
    known, open_ = new, None
    while True:
        sent = graph.join(new.select("target", F.col("node").alias("up"), "n"), ["target", "up"]).select("target", "down", "n", F.lit(1).alias("got"))
        if open_ is not None:
            sent = sent.unionByName(open_)
        sums = sent.groupBy("target", "down").agg(F.try_sum("n").cast(COUNT).alias("n"), F.sum("got").cast("int").alias("got"))
        sums = materialize(sums.join(needed, ["target", "down"]), "sums")
        new = sums.where("got = needed").select("target", F.col("down").alias("node"), "n")
        if new.isEmpty():
            return known
        open_ = sums.where("got < needed").select("target", "down", "n", "got")
        known = materialize(known.unionByName(new), "counted")


def _path_counts(links: DataFrame, first: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, target, hops, shortest_paths, paths) of every node of ``first``, in ids."""
    reach = path_graph(links, first, ends)
    graph, ends = _links_of(links, reach), reach.where("distance = 0").select("target")
    every = _counted(graph, ends).select("target", "node", F.col("n").alias("paths"))
    shortest = _counted(graph.where("nearer"), ends).select("target", "node", F.col("n").alias("shortest_paths"))
    rows = reach.join(first, "node", "left_semi").join(shortest, ["target", "node"]).join(every, ["target", "node"], "left")
    return rows.select("node", "target", F.col("distance").alias("hops"), "shortest_paths", "paths")


def lineage_path_counts(edges: DataFrame, starts: DataFrame, targets: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row per asked pair with a path: start, target, hops (of a shortest path), shortest_paths
    and paths, without making any path.

    Each number is a sum over the parents of a node, so a ladder of diamonds with a million
    paths costs one row per node and level. ``pairs`` (start, target) restricts the answer.
    Where a cycle lies between start and target ``paths`` is null, as the simple paths through it
    cannot be summed up, and the shortest ones still count. A start that is its own target has
    one path of no hops. A number of more than 38 digits is null.
    """
    names = numbered(edges, starts, targets)
    ends = materialize(names.ids(targets.where("dataset is not null"), node="dataset"), "ends")
    parents = parents_of(names)
    if parents is None:
        rows = _path_counts(names.links, names.first.select(F.col("id").alias("node")), ends).withColumnRenamed("node", "start")
    else:
        figures = ["target", "hops", "shortest_paths", "paths"]
        own = names.first.select(F.col("id").alias("start")).join(ends, F.col("start") == ends["node"], "left_semi").select(
            "start", F.col("start").alias("target"), F.lit(-1).alias("hops"), *[F.lit(1).cast(COUNT).alias(c) for c in figures[2:]]
        )
        sent = handed_down(names, _path_counts(names.inner, parents, ends).select(F.col("node").alias("up"), *figures), own)
        sent = sent.where("start <> target or hops < 0")  # no path leaves its target
        # a path of a parent is one of the start, one hop longer; the start's shortest are those of its nearest parents
        by_hops = sent.groupBy("start", "target", "hops").agg(
            F.try_sum("shortest_paths").cast(COUNT).alias("shortest_paths"), F.try_sum("paths").cast(COUNT).alias("paths"),
            F.count_if(F.col("paths").isNull()).alias("unknown"),
        )
        unknown = (F.sum("unknown") > 0) | (F.count_if(F.col("paths").isNull()) > 0)
        rows = by_hops.groupBy("start", "target").agg(
            (F.min("hops") + 1).alias("hops"), F.min_by("shortest_paths", "hops").alias("shortest_paths"),
            F.when(~unknown, F.try_sum("paths").cast(COUNT)).alias("paths"),
        )
    if pairs is not None:
        rows = rows.join(materialize(names.ids(pairs, start="start", target="target"), "asked"), ["start", "target"], "left_semi")
    first = names.first.select(F.col("id").alias("start"), F.col("name").alias("_start"))
    rows = rows.join(first, "start").drop("start").withColumnRenamed("_start", "start")
    ends = materialize(ends.join(names.nodes, ends["node"] == names.nodes["id"]).select("id", "name"), "targets")
    return named(rows, ends, ("target",), "inner").select("start", "target", "hops", "shortest_paths", "paths")


def _paths(
    links: DataFrame, first: DataFrame, ends: DataFrame, nodes: DataFrame, max_hops: int | None, asked: DataFrame | None, whole: bool = False
) -> DataFrame:
    """(start, target, ids, names): the paths in ids and the names of what is above the start; with ``whole``
    the names include the start's, and a start that is a target has a path of itself."""
    reach = path_graph(links, first, ends)
    graph = _links_of(links, reach)
    at = reach.where("distance > 0").join(first, "node", "left_semi").select(F.col("node").alias("start"), "target", "distance")
    if asked is not None:
        at = at.join(asked, ["start", "target"], "left_semi")
    if max_hops is not None:
        at = at.where(F.col("distance") <= max_hops)
    paths = at.select("start", "target", F.col("start").alias("at"), F.array("start").alias("path"))
    left = reach.select("target", F.col("node").alias("up"), "distance")
    found, hop = [], 0
    if whole:
        itself = reach.where("distance = 0").join(first, "node", "left_semi")
        if asked is not None:
            itself = itself.join(asked, (itself["node"] == asked["start"]) & (itself["target"] == asked["target"]), "left_semi")
        found.append(itself.select(F.col("node").alias("start"), "target", F.col("node").alias("at"), F.array("node").alias("path")))
    while max_hops is None or hop < max_hops:
        steps = paths.join(graph, (paths["at"] == graph["down"]) & (paths["target"] == graph["target"])).select(
            "start", paths["target"], F.col("up").alias("at"), "path"
        ).where(~F.array_contains("path", F.col("at")))
        hop += 1
        if max_hops is not None:
            near = left.where(F.col("distance") <= max_hops - hop).select("target", F.col("up").alias("at"))
            steps = steps.join(near, ["target", "at"], "left_semi")
        steps = materialize(steps.select("start", "target", "at", F.array_append("path", F.col("at")).alias("path")), "paths")
        if steps.isEmpty():
            break
        found.append(steps.where("at = target"))
        paths = steps.where("at <> target")
    if not found:
        found = [paths.limit(0)]
    hits = reduce(lambda a, b: a.unionByName(b), found).select(F.monotonically_increasing_id().alias("n"), "start", "target", F.col("path").alias("ids"))
    hits = materialize(hits, "found")
    # a path is as long as the graph is deep: its names are put together again by path
    parts = F.col("ids") if whole else F.slice("ids", 2, F.size("ids"))
    steps = named(hits.select("n", F.posexplode(parts).alias("k", "node")), nodes, ("node",), "inner")
    texts = steps.groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "node"))), lambda x: x["node"]).alias("names"))
    return hits.join(texts, "n").select("start", "target", "ids", "names")


def lineage_paths_between(
    edges: DataFrame, starts: DataFrame, targets: DataFrame, max_hops: int | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """Every simple path from a start upstream to a target, of at most ``max_hops`` edges if given.

    Paths are made for asked pairs only (``pairs`` of start and target; by default all), along
    the target's path graph: every step can be made longer to a path to that target, so no more
    rows are made at any step than paths come out, but for those that run into a cycle or beyond
    ``max_hops``. A path ends at its target; a cycle is never entered twice.
    """
    names = numbered(edges, starts, targets)
    ends = materialize(names.ids(targets.where("dataset is not null"), node="dataset"), "ends")
    asked = materialize(names.ids(pairs, start="start", target="target"), "asked") if pairs is not None else None
    first = names.first.select(F.col("id").alias("start"), F.col("name").alias("_start"))
    parents = parents_of(names, None if max_hops is None else max_hops + 1)
    if parents is None:
        found = _paths(names.links, names.first.select(F.col("id").alias("node")), ends, names.nodes, max_hops, asked)
    else:
        above = None
        if asked is not None:
            above = names.own.join(asked, F.col("down") == F.col("start")).select(F.col("up").alias("start"), "target").distinct()
            above = materialize(above, "asked")
        longer = _paths(names.inner, parents, ends, names.nodes, None if max_hops is None else max_hops - 1, above, whole=True)
        found = handed_down(names, longer.withColumnRenamed("start", "up")).where(~F.array_contains("ids", F.col("start")))
        if asked is not None:
            found = found.join(asked, ["start", "target"], "left_semi")
    path = F.concat(F.array("_start"), "names")
    out = found.join(first, "start").select(F.col("_start").alias("start"), path.alias("path"))
    return out.select("start", F.element_at("path", -1).alias("target"), F.size("path").alias("nodes"), "path")


def hop_dedupe(hops: DataFrame) -> DataFrame:
    """One hop per table: the first name seen, the deepest depth."""
    return (
        hops.withColumn("table_key", urn_table_key("dataset"))
        .groupBy("start", "table_key")
        .agg(
            F.min_by("dataset", F.struct("hop", "dataset")).alias("dataset"),
            F.max("hop").alias("depth"),
            F.count_distinct("dataset").alias("siblings"),
        )
    )


def lineage_tables(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """``hop_dedupe`` of the walk upstream of every start, without its rows of parents.

    Of many starts over few parents, names are read as tables once per place and not per start.
    """
    graph = numbered(edges, starts)
    parents = parents_of(graph, depth)
    name = graph.first.select(F.col("id").alias("start"), F.col("name").alias("_start"))
    if parents is None:
        walk = _pairs(graph.links, graph.first.select(F.col("id").alias("node")), depth)
        visited = named(walk, graph.known, ("at",)).join(name, "start")
        return hop_dedupe(visited.select(F.col("_start").alias("start"), "hop", F.col("at").alias("dataset")))
    walk = distances(graph.inner, parents, None if depth is None else depth - 1)
    above = walk.select(F.col("start").alias("up"), "at", (F.col("hop") + 1).alias("hop"))
    above = above.join(graph.nodes, above["at"] == graph.nodes["id"]).select("up", "at", "hop", F.col("name").alias("dataset"), urn_table_key("name").alias("table_key"))
    itself = graph.first.select(
        F.col("id").alias("start"), F.lit(None).cast("long").alias("at"), F.lit(0).alias("hop"), F.col("name").alias("dataset"), urn_table_key("name").alias("table_key")
    )
    rows = handed_down(graph, above, itself).where("at is null or at <> start")
    places = rows.groupBy("start", "table_key", "dataset").agg(F.min("hop").alias("hop"))
    tables = places.groupBy("start", "table_key").agg(
        F.min(F.struct("hop", "dataset")).alias("least"), F.max("hop").alias("depth"), F.count(F.lit(1)).alias("siblings")
    )
    return tables.join(name, "start").select(F.col("_start").alias("start"), "table_key", F.col("least.dataset").alias("dataset"), "depth", "siblings")


def collapse_siblings(edges: DataFrame) -> DataFrame:
    """Edges between tables rather than between their platform-specific names."""
    return (
        edges.select(urn_table_key("src").alias("src"), urn_table_key("dst").alias("dst"))
        .filter(F.col("src") != F.col("dst"))
        .distinct()
    )


def lineage_path(
    paths: DataFrame, root_column: Column, features: Column, model: Column, label: Column | None = None
) -> DataFrame:
    """Readable path: root column, hops from the root down, features, model.

    A run without hops gives a path without hops; none are invented.
    """
    down = F.reverse("path")
    hops = F.transform(F.slice(down, 2, F.greatest(F.size(down), F.lit(1))), urn_table_key)
    return paths.withColumn(
        "path_text",
        F.concat_ws(
            " -> ",
            F.concat_ws(".", urn_table_key(F.get(down, F.lit(0))), root_column),
            F.when(F.size(hops) > 0, F.array_join(hops, " -> ")),
            features,
            model,
        ),
    )


# ------------------------------------------------------------------ features and models

def feature_root_map(features: DataFrame, roots: DataFrame) -> DataFrame:
    """(feature, source_column, root_column); the source column is its own root by default."""
    return features.join(roots.select("feature", "root_column").distinct(), "feature", "left").select(
        "feature", "source_column", F.coalesce("root_column", "source_column").alias("root_column")
    )


def column_impact(root_map: DataFrame, feature_models: DataFrame) -> DataFrame:
    """Models that a raw column reaches, with the path through the feature."""
    return root_map.join(feature_models, "feature").select(
        "root_column", "feature", "model",
        F.concat_ws(" -> ", "root_column", "feature", "model").alias("path"),
    )


def props(**pairs: Column) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v.cast("string"))])


def emit_ml_nodes(
    features: DataFrame, root_map: DataFrame, cards: DataFrame, feature_models: DataFrame,
    feature_table: str, platform: str, features_dataset: str, root_dataset: str,
) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables for features, their table, training runs, groups and models.

    Root columns are columns of one raw table, so the list kept on a feature is
    bounded by that table's width.
    """
    feature_urn = F.concat(F.lit(f"urn:li:mlFeature:({feature_table},"), F.col("feature"), F.lit(")"))
    model_urn = F.concat(F.lit(f"urn:li:mlModel:(urn:li:dataPlatform:{platform},"), F.col("model"), F.lit(",PROD)"))
    group_urn = F.concat(F.lit(f"urn:li:mlModelGroup:(urn:li:dataPlatform:{platform},"), F.col("model"), F.lit(",PROD)"))
    run_urn = F.concat(F.lit("urn:li:dataProcessInstance:"), F.col("run_id"))
    table_urn = F.lit(f"urn:li:mlFeatureTable:(urn:li:dataPlatform:{platform},{feature_table})")

    roots = root_map.groupBy("feature").agg(F.array_join(F.array_sort(F.collect_set("root_column")), ",").alias("roots"))
    feature_nodes = features.join(roots, "feature", "left").select(
        feature_urn.alias("urn"), F.lit("mlFeature").alias("type"), F.col("feature").alias("name"),
        props(
            description=F.col("description"), data_type=F.col("data_type"), source_column=F.col("source_column"),
            source_dataset=F.lit(features_dataset), root_columns=F.col("roots"), root_dataset=F.lit(root_dataset),
        ).alias("props"),
    )
    table_node = features.agg(F.count("*").alias("n")).select(
        table_urn.alias("urn"), F.lit("mlFeatureTable").alias("type"), F.lit(feature_table).alias("name"),
        props(source_dataset=F.lit(features_dataset), feature_count=F.col("n")).alias("props"),
    )
    run_nodes = cards.select(
        run_urn.alias("urn"), F.lit("dataProcessInstance").alias("type"),
        F.concat("model", F.lit(" training run")).alias("name"),
        props(training_periods=F.col("training_periods"), training_rows=F.col("training_rows"),
              algorithm=F.col("algorithm"), in_sample_mae=F.col("in_sample_mae")).alias("props"),
    )
    group_nodes = cards.select(
        group_urn.alias("urn"), F.lit("mlModelGroup").alias("type"), F.col("model").alias("name"),
        props(members=F.lit(1)).alias("props"),
    )
    model_nodes = cards.select(
        model_urn.alias("urn"), F.lit("mlModel").alias("type"), F.col("model").alias("name"),
        props(training_periods=F.col("training_periods"), categories=F.col("categories"),
              feature_table=table_urn, algorithm=F.col("algorithm"), version=F.col("version")).alias("props"),
    )
    nodes = reduce(lambda a, b: a.unionByName(b), [feature_nodes, table_node, run_nodes, group_nodes, model_nodes])

    def edge(df, src, dst, kind):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"))

    edges = reduce(
        lambda a, b: a.unionByName(b),
        [
            edge(features, F.lit(features_dataset), feature_urn, "derived_from"),
            edge(features, feature_urn, table_urn, "member_of"),
            edge(feature_models, feature_urn, model_urn, "consumed_by"),
            edge(cards, F.lit(features_dataset), run_urn, "input_of"),
            edge(cards, run_urn, model_urn, "trained"),
            edge(cards, model_urn, group_urn, "member_of"),
        ],
    )
    return nodes, edges


def model_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Models with their recorded properties and how many features feed them."""
    fed = edges.filter(F.col("kind") == "consumed_by").groupBy(F.col("dst").alias("urn")).agg(F.count("*").alias("features"))
    group = edges.filter(F.col("kind") == "member_of").select(F.col("src").alias("urn"), F.col("dst").alias("model_group"))
    return (
        list_models(nodes, columns=("urn", "name", "props"))
        .join(fed, "urn", "left")
        .join(group, "urn", "left")
        .select(
            "urn", "name", F.col("props")["version"].alias("version"), F.col("props")["algorithm"].alias("algorithm"),
            F.col("props")["training_periods"].alias("training_periods"),
            F.col("props")["categories"].alias("categories"), "model_group",
            F.coalesce("features", F.lit(0)).alias("features"),
        )
    )


def feature_context(nodes: DataFrame) -> DataFrame:
    """Features with the columns they are derived from."""
    p = F.col("props")
    return nodes.filter(F.col("type") == "mlFeature").select(
        "urn", "name", p["description"].alias("description"), p["data_type"].alias("data_type"),
        p["source_dataset"].alias("source_dataset"), p["source_column"].alias("source_column"),
        csv_to_array(F.coalesce(p["root_columns"], F.lit(""))).alias("root_columns"),
        p["root_dataset"].alias("root_dataset"),
    )


def list_models(nodes: DataFrame, columns: Sequence[str] = ("urn", "name")) -> DataFrame:
    return nodes.filter(F.col("type") == "mlModel").select(*columns)


def search_nodes(nodes: DataFrame, type: str | None = None, text: str = "*", limit: int | None = None) -> DataFrame:
    """Nodes of a type whose name or entity name holds the text; ``limit`` gives a top page."""
    found = nodes if type is None else nodes.filter(F.col("type") == type)
    if text != "*":
        found = found.filter(F.lower("name").contains(text.lower()) | F.lower("urn").contains(text.lower()))
    found = found.select("urn", "type", "name")
    return found if limit is None else found.orderBy("urn").limit(limit)


def run_cost(runs: DataFrame, prices: Mapping[str, tuple[float, float]], override: tuple[float, float] | None = None) -> DataFrame:
    """Token cost per run. Prices are per million tokens; an unknown model costs NULL."""
    if override:
        price_in, price_out = F.lit(float(override[0])), F.lit(float(override[1]))
    else:
        def rate(i):
            table = F.create_map(*[x for m, p in prices.items() for x in (F.lit(m), F.lit(float(p[i])))])
            return F.try_element_at(table, F.col("llm_model"))

        price_in, price_out = rate(0), rate(1)
    cost = F.col("input_tokens") / F.lit(1e6) * price_in + F.col("output_tokens") / F.lit(1e6) * price_out
    return runs.withColumn("cost_usd", cost)
