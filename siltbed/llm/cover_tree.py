"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors are unit points, cosine becomes chord length. Equal vectors collapse first. The rest of
a label is split around pivots, level by level, until its cells are blocks of bounded size; pairs
of cells are followed down these levels together, and those that their covering radii keep apart
are dropped with all below them. Pairs of blocks whose farthest points are within the threshold
count whole; where two others meet, their cover trees (nested levels of centres, the radius
halving from level to level) are walked together: a pair of nodes is dropped when the distance
of its centres exceeds both covering radii and the threshold, taken whole when even the
farthest points are within it, and opened otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.llm.batches import groups
from siltbed.llm.components import components, lookup
from siltbed.storage import materialize

#: Vectors of a block, and of a tree's leaf.
BLOCK, LEAF = 1024, 64
#: Cells that a cell is split into at a time, and vectors that their pivots are chosen from.
FAN, SAMPLE = 64, 2048
#: Vectors of a cell that one task deals, and partners that it walks a block with.
DEAL, PARTNERS = 1 << 16, 16
#: Slack of pruning, far above the error of a chord computed from a dot product.
EPS = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the unit vectors of two sets."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


@dataclass
class Node:
    """Points (rows of the block) within ``radius`` of the row ``center``."""

    center: int
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)


def build(x: np.ndarray, least: float, leaf: int = LEAF) -> Node:
    """The cover tree of the unit vectors ``x``; nodes of ``leaf`` points or radius ``least`` stay closed."""
    root = Node(0, float(chord(x[:1], x).max()), np.arange(len(x)))
    open_nodes = [(root, 2.0)]
    while open_nodes:
        node, scale = open_nodes.pop()
        if len(node.points) <= leaf or node.radius <= least:
            continue
        while scale >= node.radius:
            scale /= 2
        # A net of the node's points at this scale; its own centre comes first, so levels nest.
        left, center = node.points, node.center
        while len(left):
            d = chord(x[center : center + 1], x[left])[0]
            inside = d <= scale
            inside |= left == center
            node.children.append(Node(center, float(d[inside].max()), left[inside]))
            left = left[~inside]
            center = int(left[0]) if len(left) else -1
        open_nodes += [(c, scale) for c in node.children]
    return root


class _Sets:
    """Union-find over the positions of two blocks."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, members: list[int]) -> None:
        first = self.root(members[0])
        for m in members[1:]:
            self.up[self.root(m)] = first


class Walk:
    """Counts the links between two blocks (or within one) and joins what they link."""

    def __init__(self, a: np.ndarray, b: np.ndarray | None, copies_a: np.ndarray, copies_b: np.ndarray, cosine: float):
        self.own = b is None
        self.a, self.b = a, a if b is None else b
        self.copies = copies_a, copies_a if b is None else copies_b
        self.cosine, self.far = cosine, float(np.sqrt(2 - 2 * cosine))
        self.links_a = np.zeros(len(a), np.int64)
        self.links_b = self.links_a if self.own else np.zeros(len(self.b), np.int64)
        self.shift = 0 if self.own else len(a)
        self.sets = _Sets(len(a) + (0 if self.own else len(self.b)))

    def _whole(self, rows: np.ndarray, cols: np.ndarray) -> None:
        """All of ``rows`` link with all of ``cols``, which are other points."""
        self.links_a[rows] += self.copies[1][cols].sum()
        self.links_b[cols] += self.copies[0][rows].sum()
        self.sets.join([*rows.tolist(), *(cols + self.shift).tolist()])

    def _record(self, rows: np.ndarray, cols: np.ndarray, hit: np.ndarray, both: bool) -> None:
        self.links_a[rows] += hit @ self.copies[1][cols]
        if both:
            self.links_b[cols] += self.copies[0][rows] @ hit
        left = np.flatnonzero(hit.any(axis=1))
        while len(left):  # one linked set of rows and columns at a time
            in_rows = np.zeros(len(rows), bool)
            in_rows[left[0]] = True
            while True:
                in_cols = hit[in_rows].any(axis=0)
                grown = hit[:, in_cols].any(axis=1)
                if (grown == in_rows).all():
                    break
                in_rows = grown | in_rows
            self.sets.join([*rows[in_rows].tolist(), *(cols[in_cols] + self.shift).tolist()])
            left = left[~in_rows[left]]

    def run(self, root_a: Node, root_b: Node) -> None:
        todo = [(root_a, root_b)]
        while todo:
            p, q = todo.pop()
            same = self.own and p is q
            if not p.children and not q.children:
                for i in range(0, len(p.points), 512):
                    for j in range(0, len(q.points), 512):
                        rows, cols = p.points[i : i + 512], q.points[j : j + 512]
                        hit = (self.a[rows] @ self.b[cols].T) >= self.cosine
                        if same:
                            hit &= rows[:, None] != cols[None]
                        if hit.any():
                            self._record(rows, cols, hit, not same)
                continue
            left = p.children or [p]
            right = q.children or [q]
            if not same and p.children and q.children:  # open the wider one
                left, right = (left, [q]) if p.radius >= q.radius else ([p], right)
            d = chord(self.a[[n.center for n in left]], self.b[[n.center for n in right]])
            reach = np.array([n.radius for n in left])[:, None] + np.array([n.radius for n in right])[None]
            near = d <= reach + self.far + EPS
            whole = d + reach <= self.far - EPS
            if same:
                near = np.triu(near)
                near[np.diag_indices(len(left))] = [len(n.points) > 1 for n in left]
            for i, j in zip(*np.nonzero(near), strict=True):
                if whole[i, j] and not (same and i == j):
                    self._whole(left[i].points, right[j].points)
                else:
                    todo.append((left[i], right[j]))


def choose_pivots(x: np.ndarray, want: int) -> np.ndarray:
    """At most ``want`` rows of ``x`` far from each other; one where all are in one place."""
    chosen = [0]
    d = chord(x[:1], x)[0]
    while len(chosen) < want and d.max() > EPS:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, chord(x[chosen[-1] : chosen[-1] + 1], x)[0])
    return x[chosen]


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _apart(p: Column, q: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(p, q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def _split(placed: DataFrame, level: int, block: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Splits the cells of ``placed`` (cell, node, copies, dim, x) that are too large for a block.

    Returns the rows of the others, the split rows in their new cells and those cells' outlines
    (cell, kid, center, radius); None where all cells are small enough. A cell is dealt to its
    nearest pivots, or by a hash if its vectors have one direction.
    """
    opened = placed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * block)
    opened = materialize(opened, "opened")
    if not (n_open := opened.count()):
        return None
    drawn = F.pmod(F.xxhash64(F.lit(level), "node"), F.lit(1 << 40)) < (F.lit(float(SAMPLE)) / F.col("n") * (1 << 40))

    def choose(group: pa.Table) -> pa.Table:
        n = group.column("n")[0].as_py()
        found = choose_pivots(unit(_matrix(group.column("x"), group.column("dim")[0].as_py())), min(FAN, max(2, -(-n // block))))
        kids = max(2, -(-n // block)) if len(found) == 1 else len(found)
        return pa.table({"cell": group.column("cell").slice(0, 1), "n": pa.array([n], pa.int64()), "kids": pa.array([kids], pa.int64()), "pivots": pa.array([found.tolist()], pa.list_(pa.list_(pa.float64())))})

    picks = placed.join(opened, "cell").filter(drawn).groupBy("cell").applyInArrow(choose, "cell string, n long, kids long, pivots array<array<double>>")
    picks = materialize(picks, "pivots")
    if picks.count() != n_open:
        raise ArithmeticError("a cell without a sample")
    salts = F.ceil(F.col("n") / DEAL)
    dealt = placed.join(opened, "cell").select("cell", F.pmod(F.xxhash64("node"), salts).alias("salt"), F.lit(1).alias("turn"), "node", "copies", "dim", "x", F.lit(None).cast("long").alias("kids"), F.lit(None).cast("array<array<double>>").alias("pivots"))
    heads = picks.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(0).alias("turn"), *(F.lit(None).cast(t).alias(c) for c, t in (("node", "long"), ("copies", "long"), ("dim", "int"), ("x", "array<double>"))), "kids", "pivots")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["cell", "salt"]):  # its first row holds the pivots
            found, kids = np.array(group.column("pivots")[0].as_py(), np.float64), group.column("kids")[0].as_py()
            rows = group.slice(1).combine_chunks()
            for at in range(0, rows.num_rows, 8192):
                part = rows.slice(at, 8192)
                d = chord(unit(_matrix(part.column("x"), found.shape[1])), found)
                to, cell = d.argmin(axis=1), part.column("cell")[0].as_py()
                kid = part.column("node").to_numpy() % kids if len(found) == 1 else to
                cells = pa.array([f"{cell}/{k}" for k in kid.tolist()])
                cols = [cells, part.column("cell"), *(part.column(c) for c in ("node", "copies", "dim", "x")), pa.array(d[np.arange(len(to)), to])]
                yield from pa.table(cols, names=["cell", "parent", "node", "copies", "dim", "x", "d"]).combine_chunks().to_batches()

    both = dealt.unionByName(heads).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "turn")
    moved = materialize(both.mapInArrow(assign, "cell string, parent string, node long, copies long, dim int, x array<double>, d double"), "cells")
    centers = picks.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("kids") - 1)).alias("k"), "pivots")
    centers = centers.select(F.concat_ws("/", "cell", F.col("k").cast("string")).alias("kid"), F.get("pivots", F.least(F.col("k"), F.size("pivots") - 1)).alias("center"))
    radii = moved.groupBy(F.col("parent").alias("cell"), F.col("cell").alias("kid")).agg(F.max("d").alias("radius"))
    outlines = materialize(radii.join(centers, "kid").select("cell", "kid", "center", "radius"), "outlines")
    rest = placed.join(opened.select("cell"), "cell", "left_anti")
    return rest, moved.drop("parent", "d"), outlines


def _follow(pairs: DataFrame, outlines: DataFrame, far: float) -> DataFrame:
    """The pairs of cells (a, b), a <= b, one level down: those whose cells may hold a link."""
    kids = [outlines.select(*(F.col(c).alias(f"{c}{i}") for c in ("cell", "kid", "center", "radius"))) for i in (1, 2)]
    down = pairs.join(kids[0], F.col("a") == F.col("cell1"), "left").join(kids[1], F.col("b") == F.col("cell2"), "left")
    kid1, kid2 = F.coalesce("kid1", "a"), F.coalesce("kid2", "b")
    near = F.coalesce(_apart(F.col("center1"), F.col("center2")) <= F.col("radius1") + F.col("radius2") + F.lit(far + EPS), F.lit(True))
    down = down.filter(near & ((F.col("a") != F.col("b")) | (kid1 <= kid2)))
    return down.select(F.least(kid1, kid2).alias("a"), F.greatest(kid1, kid2).alias("b"))


def near_vectors(vectors: DataFrame, cosine: float = 0.98, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label (not null) and dimension link where the cosine of their directions, in
    double precision, is at least ``cosine``. Vectors that are null, empty or zero, hold null or
    non-finite components or have no label link with nothing and are alone; so is a null vec_id,
    whose component is null. Rows that repeat a vector are copies that link with each other; rows
    that repeat a vec_id with another vector or label are vectors of their own. A component is named
    by the least vec_id in it. An empty table gives an empty result. Other columns aren't read.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").cast("array<double>").alias("x"))
    fits = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    fits = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & fits, F.lit(False))
    rows = rows.withColumn("fits", fits).withColumn("dim", F.size("x"))
    kinds = rows.filter("fits").groupBy("label", "dim", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    kinds = materialize(kinds.withColumn("node", F.monotonically_increasing_id()), "kinds")
    far = float(np.sqrt(2 - 2 * cosine))

    # Cells of bounded size, and the pairs of them that may hold links.
    root = F.concat_ws("#", F.col("label").cast("string"), F.col("dim").cast("string"))
    placed = kinds.select(root.alias("cell"), "node", "copies", "dim", "x")
    pairs = placed.select(F.col("cell").alias("a"), F.col("cell").alias("b")).distinct()
    closed, level = [], 0
    while (parts := _split(placed, level, block)) is not None:
        rest, placed, outlines = parts
        closed.append(rest)
        pairs, level = materialize(_follow(pairs, outlines, far), "pairs"), level + 1
    for rest in closed:
        placed = placed.unionByName(rest)

    def gather(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        x = unit(_matrix(group.column("x"), dim))
        middle = x.mean(axis=0)
        size = np.sqrt(middle @ middle)
        middle = middle / size if size > EPS else x[0]
        nodes, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
        return pa.table({
            "block": group.column("cell").slice(0, 1), "dim": pa.array([dim], pa.int32()),
            "middle": pa.array([middle.tolist()]), "radius": pa.array([float(chord(middle[None], x).max())]),
            "first": pa.array([nodes.min()], pa.int64()), "total": pa.array([copies.sum()], pa.int64()),
            "nodes": pa.array([nodes.astype("<i8").tobytes()]), "copies": pa.array([copies.astype("<i8").tobytes()]),
            "vectors": pa.array([x.astype("<f8").tobytes()])})

    blocks = placed.groupBy("cell").applyInArrow(
        gather, "block string, dim int, middle array<double>, radius double, first long, total long, nodes binary, copies binary, vectors binary")
    blocks = materialize(blocks, "blocks")
    outline = [blocks.select(F.col("block").alias(c), *(F.col(n).alias(f"{n}_{c}") for n in ("middle", "radius", "first", "total"))) for c in ("a", "b")]
    meet = pairs.join(outline[0], "a").join(outline[1], "b")
    meet = meet.withColumn("apart", _apart(F.col("middle_a"), F.col("middle_b"))).withColumn("reach", F.col("radius_a") + F.col("radius_b"))
    meet = meet.filter(F.col("apart") <= F.col("reach") + F.lit(far + EPS)).withColumn("whole", (F.col("a") < F.col("b")) & (F.col("apart") + F.col("reach") <= F.lit(far - EPS)))
    meet = materialize(meet.select("a", "b", "whole", "first_a", "first_b", "total_a", "total_b"), "meet")

    # Two blocks that link whole: every vector of one with every vector of the other.
    side = [F.struct(F.col(p).alias("block"), F.col(f"first_{q}").alias("first"), F.col(f"total_{q}").alias("total")) for p, q in (("a", "b"), ("b", "a"))]
    whole = meet.filter("whole").select(F.explode(F.array(*side)).alias("s")).groupBy("s.block").agg(F.sum("s.total").alias("links"), F.min("s.first").alias("root"))
    wide = placed.join(whole, F.col("cell") == F.col("block")).select("node", "links", "root")
    bridges = meet.filter("whole").select(F.col("first_a").alias("u"), F.col("first_b").alias("v"))

    # A block walks with a bounded number of partners in one group of rows; its own comes first.
    walks = meet.filter("not whole").select("a", "b")
    per = walks.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("chunks"))
    walks = walks.join(per, "a").withColumn("chunk", F.when(F.col("a") == F.col("b"), 0).otherwise(F.pmod(F.xxhash64("b"), "chunks")))
    owners = per.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")).select("a", "chunk", F.col("a").alias("block"), F.lit(0).alias("turn"))
    dealt = walks.filter("a <> b").select("a", "chunk", F.col("b").alias("block"), F.lit(1).alias("turn")).unionByName(owners)
    tasks = max(1, min(4096, owners.count() // 4))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = copies = x = root = None
        for batch in batches:
            for r in range(batch.num_rows):
                raw = {c: batch.column(c)[r].as_py() for c in ("dim", "turn", "chunk", "nodes", "copies", "vectors")}
                n2, c2 = np.frombuffer(raw["nodes"], "<i8"), np.frombuffer(raw["copies"], "<i8")
                x2 = np.frombuffer(raw["vectors"], "<f8").reshape(-1, raw["dim"])
                if raw["turn"] == 0:
                    nodes, copies, x, root = n2, c2, x2, build(x2, far / 8)
                    if raw["chunk"]:
                        continue  # the block has met itself in its first chunk
                    w = Walk(x, None, copies, copies, cosine)
                    w.run(root, root)
                    names, links = nodes, w.links_a
                else:
                    w = Walk(x, x2, copies, c2, cosine)
                    w.run(root, build(x2, far / 8))
                    names, links = np.concatenate((nodes, n2)), np.concatenate((w.links_a, w.links_b))
                some = np.flatnonzero(links)
                roots = np.array([w.sets.root(i) for i in some.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(links[some]), pa.array(names[roots] if len(roots) else names[:0])], names=["node", "links", "root"])

    bodies = dealt.join(blocks.select("block", "dim", "nodes", "copies", "vectors"), "block")
    bodies = bodies.repartition(tasks, "a", "chunk").sortWithinPartitions("a", "chunk", "turn")
    found = bodies.select("a", "chunk", "turn", "dim", "nodes", "copies", "vectors").mapInArrow(walk, "node long, links long, root long")
    found = materialize(found.unionByName(wide), "links")
    group = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(bridges))
    linked = group.join(kinds.select("node", "rep"), "node")
    names = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = lookup(linked, names, ["component"], "node").select("node", "component_id")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    kinds = kinds.join(sums, "node", "left").join(linked, "node", "left")
    kinds = kinds.select("label", "dim", "x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = rows.filter("fits").join(kinds, ["label", "dim", "x"]).select("vec_id", "n_links", "component_id")
    single = rows.filter(~F.col("fits")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
