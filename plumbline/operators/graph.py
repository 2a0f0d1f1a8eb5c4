"""Graphs: connected components as forests and joins; spanning forests, loops and minimax paths within one network.

Components run over all edges at once: each task first makes a forest of the edges it reads, up to ``FOREST_EDGES``, so that few are left; where one task
reads them all, that is all. Then rounds of joins: about the logarithm of the longest chain, and an error beyond ``max_rounds``.
Loops and paths are by network: the rows of one network meet in one task, up to a checked number, and networks spread over all tasks.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.tables import by_groups, cut, group_starts


#: Edges of which one task makes a forest.
FOREST_EDGES = 1_000_000


def local_forests(edges: DataFrame, tasks: int) -> DataFrame:
    """``edges`` (u, v) of numbers or texts as stars: each of ``tasks`` ties the nodes of its edges to the least node that they reach in it."""
    texts = edges.schema["u"].dataType.simpleString() == "string"

    def run(batches):
        above: dict = {}

        def top(x):
            root = x
            while (up := above.get(root, root)) != root:
                root = up
            while above.get(x, x) != root:
                above[x], x = root, above[x]
            return root

        for batch in batches:
            for a, b in zip(*(batch.column(c).to_pylist() for c in ("u", "v")), strict=True):
                if texts:  # by their bytes, as Spark orders them
                    a, b = a.encode(), b.encode()
                a, b = top(a), top(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
                    above.setdefault(min(a, b), min(a, b))
        nodes = [x for x in above if top(x) != x]
        plain = (lambda x: x.decode()) if texts else (lambda x: x)
        for start in range(0, len(nodes), 1 << 16):
            part = nodes[start : start + (1 << 16)]
            columns = [pa.array(list(map(plain, c)), kind) for c in (part, map(top, part))]
            yield pa.RecordBatch.from_arrays(columns, ["u", "v"])

    kind = pa.string() if texts else {"int": pa.int32(), "bigint": pa.int64()}[edges.schema["u"].dataType.simpleString()]
    return edges.coalesce(tasks).mapInArrow(run, edges.schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the least node of its component.

    Large-star and small-star in turn: every node's larger neighbours, then all smaller ones, are tied to its
    least neighbour, until nothing changes. Each round sends only a minimum by node over its edges.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "components")
    before = None
    if edges.schema["u"].dataType.simpleString() in ("int", "bigint", "string"):
        tasks = max(1, -(-edges.count() // FOREST_EDGES))
        edges = cut(local_forests(edges, tasks), "components")
        max_rounds = 0 if tasks == 1 else max_rounds
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["x"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        joined = large.join(least, large["u"] == least["x"])
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.filter("u <> v").distinct(), "components")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    else:
        if max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()


def network_components(edges: DataFrame) -> DataFrame:
    """(net, node, root) for every node of ``edges`` (net, a, b): the least node of its component within the network. A network of up to MOST_EDGES
    edges is done in one task, many small ones at a time; larger ones go in rounds over all edges, as ``components``."""
    rows = cut(edges.select("net", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "network-edges")
    kind = rows.schema["u"].dataType.simpleString()
    sizes = rows.groupBy(F.col("net").alias("large")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_EDGES)
    large = cut(sizes.select("large"), "large-networks")
    some = not large.isEmpty()

    def run(table: pa.Table):
        starts = group_starts(table, ["net"])
        g = np.repeat(np.arange(len(starts)), np.diff([*starts, table.num_rows]))
        both = pc.dictionary_encode(pa.chunked_array([*table["u"].chunks, *table["v"].chunks])).combine_chunks()
        # Nodes are numbered in the order of their names (texts by their bytes, as Spark orders them), so that the least number is the least name.
        rank = np.empty(len(both.dictionary), np.int64)
        order = pc.sort_indices(both.dictionary).to_numpy()
        rank[order] = np.arange(len(order))
        ends = np.concatenate([g, g]) * len(order) + rank[both.indices.to_numpy()]
        nodes, ends = np.unique(ends, return_inverse=True)
        u, v = ends.reshape(2, -1)
        root = np.arange(len(nodes))
        while True:
            # Roots of either end are tied to the lesser one, then every node to its root's root.
            a, b = root[u], root[v]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
        names = both.dictionary.take(pa.array(order))
        name = lambda i: names.take(pa.array(nodes[i] % len(order)))
        yield pa.table({"net": table["net"].take(pa.array(starts[nodes // len(order)])), "node": name(np.arange(len(nodes))), "root": name(root)})

    net = rows.schema["net"].dataType.simpleString()
    small = rows.join(large, F.col("net") == F.col("large"), "left_anti") if some else rows
    out = by_groups(small.select("net", "u", "v"), ["net"], run, f"net {net}, node {kind}, root {kind}")
    if some:
        node = lambda c: F.struct("net", F.col(c).alias("s"))
        rest = components(rows.join(large, F.col("net") == F.col("large"), "left_semi").select(node("u").alias("a"), node("v").alias("b")))
        out = out.unionByName(rest.select("node.net", F.col("node.s").alias("node"), F.col("root.s").alias("root")))
    return out


def natural(name) -> list:
    """Sort key of a name: numbers by value."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.findall(r"\d+|\D+", str(name))]


def _loops(rows: list[tuple], signs: list[int]) -> list[tuple]:
    """(edge, number of edges, sums of the values around) of the loop of each edge off the spanning forest. ``rows``: edge_id, a, b and the values. The first value
    counts on both ways alike (a length), the others change their sign with the direction. The forest is grown breadth first from the least name, neighbours in
    natural order, so that loops are the same in any input order. Rows with a null end or a value after the first that is none are left out."""
    rows = sorted((r for r in rows if all(x is not None and x == x for x in (r[1], r[2], *r[4:]))), key=lambda r: (r[0] is None, r[0]))
    around, tree, out = defaultdict(list), {}, []
    key = {x: natural(x) for r in rows for x in r[1:3]}
    for edge, a, b, *v in rows:
        around[a].append((b, edge, v))
        around[b].append((a, edge, [s * x for s, x in zip(signs, v)]))
    used = set()
    for root in sorted(around, key=key.get):
        if root in tree:
            continue
        tree[root] = (None, [0.0] * len(signs), 0)  # parent, sums from the root, depth
        queue = [root]
        for node in queue:
            for to, edge, v in sorted(around[node], key=lambda e: (key[e[0]], e[1])):
                if to not in tree:
                    tree[to] = (node, [x + y for x, y in zip(tree[node][1], v)], tree[node][2] + 1)
                    used.add(edge)
                    queue.append(to)
    for r in rows:
        edge, start, end, *v = r
        if edge in used or start == end:
            continue
        a, b = start, end
        while a != b:  # up to where the two ways to the root meet
            if tree[a][2] >= tree[b][2]:
                a = tree[a][0]
            else:
                b = tree[b][0]
        n = tree[start][2] + tree[end][2] - 2 * tree[a][2] + 1
        sums = [tree[start][1][k] + s * tree[end][1][k] + v[k] - (2 * tree[a][1][k] if s > 0 else 0) for k, s in enumerate(signs)]
        out.append((r, n, sums))
    return out


#: Edges of a network whose loops one task finds.
MOST_EDGES = 500_000


def _per_network(edges: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """Rows that ``make`` gives of each network's name and edges, which have these columns."""

    def run(table: pa.Table):
        starts = group_starts(table, ["net"])
        sizes = np.diff([*starts, table.num_rows])
        if sizes.max() > MOST_EDGES:
            net = table["net"][int(starts[sizes.argmax()])].as_py()
            raise ValueError(f"network {net} has {sizes.max()} edges; one task takes {MOST_EDGES}")
        nets, rows = table["net"].take(pa.array(starts)).to_pylist(), list(zip(*(table[c].to_pylist() for c in columns)))
        out = [row for net, start, size in zip(nets, starts, sizes) for row in make(net, rows[start : start + size])]
        if out:
            kinds = [table["net"].type, *(None,) * (len(out[0]) - 1)]
            yield pa.table([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=names)

    names = StructType.fromDDL(schema).names
    return by_groups(edges.select("net", *columns), ["net"], run, schema)


def loop_closures(edges: DataFrame, base_m: float, per_sqrt_km_m: float) -> DataFrame:
    """(net, loop, n_edges, closure, length_km, tolerance, pass) of levelling: one loop for each edge off the spanning forest. ``edges``: net,
    edge_id, a, b, dh, length_km. Edges with a null end or difference are left out; a network of over MOST_EDGES is an error."""

    def make(net, rows):
        for (edge, a, b, *_), n, (km, closure) in _loops(rows, [1, -1]):
            tolerance = base_m + per_sqrt_km_m * km**0.5
            yield net, f"{a}|{b}|{edge}", n, closure, km, tolerance, abs(closure) <= tolerance

    kind = edges.schema["net"].dataType.simpleString()
    return _per_network(edges, ["edge_id", "a", "b", "length_km", "dh"], make, f"net {kind}, loop string, n_edges int, closure double, length_km double, tolerance double, pass boolean")


def vector_loop_closures(edges: DataFrame, base_m: float, ppm: float) -> DataFrame:
    """(net, loop, n_edges, closure_e, closure_n, length, tolerance, pass) of satellite vectors (net, edge_id, a, b, de, dn), as ``loop_closures``;
    the tolerance grows with the length of the loop."""

    def make(net, rows):
        for (edge, a, b, *_), n, (length, e, north) in _loops(rows, [1, -1, -1]):
            tolerance = base_m + length * ppm * 1e-6
            yield net, f"{a}|{b}|{edge}", n, e, north, length, tolerance, (e * e + north * north) ** 0.5 <= tolerance

    edges = edges.withColumn("length", F.sqrt(F.col("de") * F.col("de") + F.col("dn") * F.col("dn")))
    kind = edges.schema["net"].dataType.simpleString()
    return _per_network(edges, ["edge_id", "a", "b", "length", "de", "dn"], make, f"net {kind}, loop string, n_edges int, closure_e double, closure_n double, length double, tolerance double, pass boolean")


def minimax_paths(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(net, node, worst, total, hops): the way of each node to the nearest anchor whose worst edge is least, then its
    sum, then its number of edges. ``edges``: net, a, b, weight; ``anchors``: net, node. Unreached nodes are left out."""

    def run(net, rows):
        around, heap = defaultdict(list), []
        for a, b, weight, is_start in rows:
            if is_start:
                heap.append((0.0, 0.0, 0, a))
            else:
                around[a].append((b, weight))
                around[b].append((a, weight))
        done: dict = {}
        heapq.heapify(heap)
        while heap:
            worst, total, hops, node = heapq.heappop(heap)
            if node not in done:
                done[node] = (worst, total, hops)
                for to, w in around[node]:
                    if to not in done:
                        heapq.heappush(heap, (max(worst, w), total + w, hops + 1, to))
        return [(net, n, *v) for n, v in done.items()]

    kinds = {c: edges.schema[c].dataType for c in ("net", "a")}
    starts = anchors.select(F.col("net").cast(kinds["net"]).alias("net"), F.col("node").cast(kinds["a"]).alias("a"), F.col("node").cast(kinds["a"]).alias("b"), F.lit(0.0).alias("weight"), F.lit(True).alias("is_start"))
    both = edges.select("net", "a", F.col("b").cast(kinds["a"]).alias("b"), F.coalesce(F.col("weight").cast("double"), F.lit(float("nan"))).alias("weight"), F.lit(False).alias("is_start")).unionByName(starts)
    return _per_network(both, ["a", "b", "weight", "is_start"], run, f"net {kinds['net'].simpleString()}, node {kinds['a'].simpleString()}, worst double, total double, hops int")
