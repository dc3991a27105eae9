"""Parent-child links to full hierarchies, by weighted disjoint-set forests.

Each partition unites the ends of its links in a disjoint-set forest whose weights are distances: a union by size, with
path compression that adds the distances up. A set is a piece of one tree with one local root, or, where a union meets
its own set, a piece with a loop. Of a partition's sets only the local roots that are children elsewhere matter to the
others: their links to their own local roots, with the distance as offset, form the next, smaller set of links, in which
several partitions are merged into one. So forests are merged level by level until one holds all that is left, and on
the way back every node looks its local root up in the level above. Paths are made on that way back too: each forest
indexes its parents, walks them from the node to its local root, and the path of that root follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import lookup_join, materialize

#: Links that one forest holds; a partition with more makes several, which are merged like those of others.
FOREST_LINKS = 250_000
#: Forests that are merged into one from level to level.
FAN_IN = 8
#: Levels that keep more than this share of their links are thinned out before they are merged.
SHRINK = 0.75
#: Path entries that a forest hands on at a time.
PATH_ENTRIES = 1_000_000

_FOREST = "node string, root string, depth long, looped boolean"
_WITH_PATHS = _FOREST + ", loop string, path array<string>"


class Forest:
    """Weighted disjoint sets of the nodes of some links (node, up, weight): weight is the distance between the two.

    A link from a node to itself marks the node as looped.
    """

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.boss: list[int] = []  # towards the set's representative
        self.offset: list[int] = []  # depth minus the boss's depth
        self.size: list[int] = []
        self.parent: list[int] = []  # -1: no child here
        self.weight: list[int] = []
        self.path: list[list[str] | None] = []
        self.closes: dict[int, int] = {}  # representative of a set with a loop: a node on the loop
        self.links = 0

    def _node(self, name: str) -> int:
        n = self.number.get(name)
        if n is None:
            n = self.number[name] = len(self.names)
            self.names.append(name)
            self.boss.append(n)
            self.offset.append(0)
            self.size.append(1)
            self.parent.append(-1)
            self.weight.append(0)
            self.path.append(None)
        return n

    def find(self, n: int) -> tuple[int, int]:
        """The representative of n's set, and n's depth minus its depth; all on the way then point to it directly."""
        boss, offset = self.boss, self.offset
        way = []
        while boss[n] != n:
            way.append(n)
            n = boss[n]
        total = 0
        for x in reversed(way):
            total += offset[x]
            boss[x], offset[x] = n, total
        return n, total

    def add(self, name: str, up: str, weight: int, path: list[str] | None = None) -> None:
        a, b = self._node(name), self._node(up)
        self.parent[a], self.weight[a], self.path[a] = b, weight, path
        self.links += 1
        (x, at), (y, to) = self.find(a), self.find(b)
        if x == y:
            self.closes[x] = a
            return
        shift = weight + to - at  # depth of x minus depth of y
        if self.size[x] > self.size[y]:
            x, y, shift = y, x, -shift
        self.boss[x], self.offset[x] = y, shift
        self.size[y] += self.size[x]
        if x in self.closes:
            self.closes[y] = self.closes.pop(x)

    def _tops(self) -> dict[int, tuple[int, int]]:
        """Per set without a loop its local root and the root's depth."""
        return {rep: (n, depth) for n, p in enumerate(self.parent) if p < 0 for rep, depth in (self.find(n),)}

    def roots(self) -> Iterator[pd.DataFrame]:
        """(node, root, depth, looped) of every node with a link."""
        names, find, top, closes = self.names, self.find, self._tops(), self.closes
        nodes, roots, depths, loops = [], [], [], []
        for n, p in enumerate(self.parent):
            if p < 0:
                continue
            rep, depth = find(n)
            looped = rep in closes
            root, base = (p, depth - 1) if looped else top[rep]
            nodes.append(names[n])
            roots.append(names[root])
            depths.append(depth - base)
            loops.append(looped)
        for i in range(0, len(nodes), PATH_ENTRIES):
            part = slice(i, i + PATH_ENTRIES)
            yield pd.DataFrame({"node": nodes[part], "root": roots[part], "depth": depths[part], "looped": loops[part]})

    def rows(self, with_paths: bool) -> Iterator[pd.DataFrame]:
        """(node, root, depth, looped, loop, path) of every node with a link; and one row with `loop`, the smallest name
        on it, for each node of the paths that make up a loop (with_paths only; self-made marks are no loop)."""
        names, parent, top = self.names, self.parent, self._tops()
        out, entries = [], 0
        for n, p in enumerate(parent):
            if p < 0:
                continue
            rep, depth = self.find(n)
            looped = rep in self.closes
            root, base = (p, depth - 1) if looped else top[rep]
            walked, x = [], n
            while with_paths and not looped and x != root:
                walked += self.path[x]
                x = parent[x]
            out.append((names[n], names[root], depth - base, looped, None, walked))
            entries += 1 + len(walked)
            if entries > PATH_ENTRIES:
                yield _frame(out)
                out, entries = [], 0
        for start in self.closes.values() if with_paths else ():
            members, n = [], start
            while True:
                members += self.path[n]
                n = parent[n]
                if n == start:
                    break
            if parent[start] != start or self.weight[start]:
                least = min(members)
                out += [(m, None, None, True, least, []) for m in members]
        yield _frame(out)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["node", "root", "depth", "looped", "loop", "path"])
    return frame.astype({"depth": "Int64"})


def _forests(with_paths: bool, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        for b in batches:
            paths = map(list, b["path"]) if with_paths else repeat(None)
            for name, up, weight, path in zip(b["node"].tolist(), b["up"].tolist(), b["weight"].tolist(), paths):
                forest.add(name, up, weight, path)
                if forest.links == most:
                    yield from forest.rows(True) if with_paths else forest.roots()
                    forest = Forest()
        if forest.links:
            yield from forest.rows(True) if with_paths else forest.roots()

    return run


def _solve(links: DataFrame, with_paths: bool, most: int, forests: int, level: int) -> tuple[DataFrame, list[DataFrame]]:
    """(node, root, depth, looped) of every node of links (node, up, weight, looped), and the rows of loops; with_paths
    both have `path`.

    A looped node comes with itself as `up` and weight 0.
    """
    path = ["path"] if with_paths else []
    made = materialize(links.select("node", "up", "weight", *path).mapInPandas(_forests(with_paths, most), _WITH_PATHS if with_paths else _FOREST), "forest")
    loops = [made.where("loop is not null").select("node", "loop")] if with_paths else []
    held = made.where("loop is null").drop("loop") if with_paths else made
    roots = held.where("not looped").select(F.col("root").alias("node")).distinct()
    entered = materialize(held.join(roots, "node", "left_semi"), "entered")
    n = entered.count()
    if not n:
        return held, loops
    looped = F.col("looped")
    own = [F.when(looped, F.array("node")).otherwise(F.col("path")).alias("path")] if with_paths else []
    up = entered.select("node", F.when(looped, F.col("node")).otherwise(F.col("root")).alias("up"), F.when(looped, 0).otherwise(F.col("depth")).alias("weight"), "looped", *own)
    fewer = 1 if n <= most else max(-(-n // most), -(-forests // FAN_IN))
    gone = None
    if fewer > 1 and n > SHRINK * made.count():
        up, gone = _thinned(up, level, with_paths)
    up = up.coalesce(1) if fewer == 1 else up.repartition(fewer, F.pmod(F.xxhash64("node"), F.lit(fewer)))
    above, more = _solve(up, with_paths, most, fewer, level + 1)
    if gone is not None:
        above = above.unionByName(_below(gone.select("node", F.col("up").alias("root"), F.col("weight").alias("depth"), "looped", *path), materialize(above, "above"), with_paths))
    return _below(held, materialize(above, "above"), with_paths), loops + more


def _thinned(links: DataFrame, level: int, with_paths: bool) -> tuple[DataFrame, DataFrame]:
    """links without some that others can do without, and these: a node with coin 1 whose parent has coin 0 is skipped, and
    its children point to its parent. A quarter of a long chain goes, wherever its links lie."""
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2))
    skip = ~F.col("looped") & (coin("node") == 1) & (coin("up") == 0)
    gone = materialize(links.where(skip), "gone")
    over = gone.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("weight").alias("__weight"), *([F.col("path").alias("__path")] if with_paths else []))
    kept = lookup_join(links.where(~skip), over, ["up"])
    path = [F.when(F.col("__up").isNotNull(), F.concat("path", "__path")).otherwise(F.col("path")).alias("path")] if with_paths else []
    return kept.select("node", F.coalesce("__up", "up").alias("up"), (F.col("weight") + F.coalesce("__weight", F.lit(0))).alias("weight"), "looped", *path), gone


def _below(held: DataFrame, above: DataFrame, with_paths: bool) -> DataFrame:
    """Rows of a level with the roots that their local roots have in the level above."""
    over = above.select(F.col("node").alias("root"), *[F.col(c).alias(f"up_{c}") for c in ("root", "depth", "looped", *(["path"] if with_paths else []))])
    found = lookup_join(held, over, ["root"])
    looped = F.col("looped") | F.coalesce("up_looped", F.lit(False))
    path = [F.concat("path", F.coalesce("up_path", F.array().cast("array<string>"))).alias("path")] if with_paths else []
    return found.select("node", F.coalesce("up_root", "root").alias("root"), (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"), looped.alias("looped"), *path)


def _resolved(links: DataFrame, child: str, parent: str, with_paths: bool, forest_links: int) -> tuple[DataFrame, list[DataFrame]]:
    edges = links.select(F.col(child).alias("node"), F.col(parent).alias("up")).where("node is not null and up is not null")
    edges = edges.groupBy("node").agg(F.min("up").alias("up"))
    path = [F.array("node").alias("path")] if with_paths else []
    first = edges.select("node", "up", F.lit(1).cast("long").alias("weight"), F.lit(False).alias("looped"), *path)
    return _solve(first, with_paths, forest_links, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), 0)


def resolve_roots(links: DataFrame, child: str, parent: str, with_paths: bool = False, forest_links: int = FOREST_LINKS) -> DataFrame:
    """(node, root, depth, path, looped) for every distinct child of links; of several parents the smallest counts.

    root is the last node reached, depth the number of links to it; path holds the nodes from node up to, without,
    root (empty unless with_paths). Nodes on a loop or leading into one have looped = true, root and depth null. Links
    with a null end are left out; no links give no rows.
    """
    rows, _ = _resolved(links, child, parent, with_paths, forest_links)
    sure = lambda c: F.when(~F.col("looped"), F.col(c)).alias(c)
    none = F.array().cast("array<string>")
    return rows.select("node", sure("root"), sure("depth"), (F.when(F.col("looped"), none).otherwise(F.col("path")) if with_paths else none).alias("path"), "looped")


def loop_members(links: DataFrame, looped: DataFrame, child: str, parent: str, forest_links: int = FOREST_LINKS) -> DataFrame:
    """(node, loop): the nodes that lie on a loop, each with the smallest node of its loop as the loop's name.

    looped holds (as `node`) the children that resolve_roots marked; only their links are read. The forest in which a
    union meets its own set walks that loop once.
    """
    own = links.join(looped.select(F.col("node").alias(child)), child, "left_semi")
    _, loops = _resolved(own, child, parent, True, forest_links)
    out = loops[0]
    for more in loops[1:]:
        out = out.unionByName(more)
    return out


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, node, distance): every node below every other, from resolve_roots(..., with_paths=True); loops have none.

    Links are rows, not lists, so a root with a third of all nodes below it stays spread over all tasks.
    """
    up = resolved.where("not looped").select("node", F.posexplode(F.concat(F.col("path"), F.array("root"))).alias("distance", "ancestor"))
    return up.where("distance > 0").select("ancestor", "node", F.col("distance").cast("long").alias("distance"))
