"""Hard-negative mining with an STR-packed R-tree over integer vectors.

1. Vectors are made integer and dealt to tiles by sort-tile-recursive packing (Leutenegger, Lopez and Edgington, 1997): the rows are cut into slabs at the quantiles of the coordinate that
   varies most, each slab into tiles at the quantiles of the next one.  Ties are broken by a number hashed from vec_id, so copies of one vector are dealt to many tiles.
2. A task packs each tile into an R-tree: the same packing goes on inside the tile down to leaves of ``LEAF`` vectors; a node of ``FANOUT`` children, like a leaf, keeps the least and the greatest
   value of every coordinate, its minimum bounding box.  A tile is one row of bytes.
3. Search: the queries are a stated set, written in blocks of ``ANCHORS_A_BLOCK``; every task holds the blocks one after another against its tiles.  The box and the anchor give an interval for each
   coordinate's product, and their sums an interval of the inner product.  Boxes wait in a queue, the one with the greatest upper bound first; a box is pruned for a
   query if its interval misses the query's window of scores or its upper bound is strictly below the query's kth score so far (equal ones stay, since ties go to the smaller vec_id).
   A queue serves ``TOGETHER`` anchors at once, so what is left of a box is multiplied as one matrix product.
4. First search: the ``positives`` best rows of the anchor's label.  Second search: for each anchor and positive the ``negatives`` best rows of other labels with a score
   from ``low`` to ``high`` percent of the positive's.  A task gives at most the first few of each query; the results of all tasks are ranked by a window whose limit is applied before the shuffle.

Boxes only save work: the result is that of comparing each query with all rows.  In many dimensions without clusters hardly any box is pruned, and the search costs what those
comparisons cost.

Defined cases: rows with a null vec_id, label or vector, or a null or non-finite component, take no part; rows that repeat a vec_id count once, with the smallest (label, vector);
vectors of different lengths are not compared; equal scores are ordered by vec_id; an anchor without other rows of its label, or a window without rows, gives no rows; scores are
exact, by floats up to 2**53 and by whole numbers beyond; an empty table gives no rows.  Only vec_id, embedding and label are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
import io
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyscope.llm.common import discard, fresh_dir, map_arrow, materialize
from supplyscope.llm.files import open_fs, replaced_file

LEAF, FANOUT = 64, 8
TILE_ROWS, TILES_A_TASK = 8192, 16
ANCHORS_A_BLOCK, TOGETHER = 2048, 256


# ---- vectors and tiles -------------------------------------------------------------------------------------------

def integer_vectors(df: DataFrame, label: Column | str = "label", scale: int = 256) -> DataFrame:
    """Rows (vec_id, label, v, dim), one a vec_id: v holds floor(scale * x) of every component."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
                     F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("e").isNotNull()).where(finite)
    whole = good.select("vec_id", F.struct("label", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v")).alias("row"))
    return whole.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v", F.size("row.v").alias("dim"))


def _spread(vectors: DataFrame) -> tuple[int, list[tuple[int, int]]]:
    """(number of rows, (dim, place) of the coordinates by falling variance, two for each length of vectors)."""
    places = vectors.select("dim", F.posexplode("v").alias("place", "x")).groupBy("dim", "place").agg(F.var_pop("x").alias("var"), F.count("*").alias("n"))
    best = places.withColumn("k", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("var"), "place"))).where("k <= 2").orderBy("dim", "k").collect()
    return vectors.count(), [(r["dim"], r["place"]) for r in best]


def tiled(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Adds tile: (rows, number of tiles).  Tiles hold about ``TILE_ROWS`` rows whatever values repeat."""
    rows, chosen = _spread(vectors)
    tiles = max(1, -(-rows // TILE_ROWS))
    slabs = math.ceil(math.sqrt(tiles))
    first, second = F.lit(0), F.lit(0)
    for dim in dict.fromkeys(d for d, _ in chosen):
        places = [p for d, p in chosen if d == dim]
        first = F.when(F.col("dim") == dim, F.col("v")[places[0]]).otherwise(first)
        second = F.when(F.col("dim") == dim, F.col("v")[places[-1]]).otherwise(second)
    tie = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) / float(1 << 30)
    keyed = vectors.withColumns({"a": first + tie(1), "b": second + tie(2)})
    cuts = lambda n: F.array(*[F.lit(i / n) for i in range(1, n)]).cast("array<double>")
    above = lambda edges, x: F.size(F.filter(edges, lambda e: e <= F.col(x)))
    if slabs > 1:  # about the root of the number of tiles: a short list
        edges = keyed.agg(F.percentile_approx("a", cuts(slabs), 10000).alias("edges")).first()["edges"]
        keyed = keyed.withColumn("slab", above(F.array(*[F.lit(float(e)) for e in edges]), "a"))
        per = -(-tiles // slabs)
        inner = keyed.groupBy("slab").agg(F.percentile_approx("b", cuts(per), 10000).alias("edges")).withColumnRenamed("slab", "of_slab") if per > 1 else None
        if inner is not None:  # a row a slab
            keyed = keyed.join(F.broadcast(inner), F.col("slab") == F.col("of_slab")).withColumn("tile", F.col("slab") * per + above("edges", "b"))
        else:
            keyed = keyed.withColumn("tile", F.col("slab"))
    else:
        keyed, per = keyed.withColumn("tile", F.lit(0)), 1
    return keyed.select("tile", "dim", "vec_id", "label", "v"), slabs * per


# ---- the tree of a tile ------------------------------------------------------------------------------------------

def str_order(v: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The rows in the order of sort-tile-recursive packing: runs of ``leaf`` rows are leaves."""
    n, d = v.shape
    by_spread = np.argsort(-v.astype(float).var(axis=0), kind="stable") if d else np.zeros(0, int)
    parts, depth = [np.arange(n)], 0
    while max(map(len, parts), default=0) > leaf and depth < max(1, d):
        after = []
        for rows in parts:  # halve each part at a whole number of leaves
            if len(rows) <= leaf:
                after.append(rows)
                continue
            own = rows[np.argsort(v[rows, by_spread[depth]], kind="stable")] if d else rows
            cut = -(-len(rows) // leaf) // 2 * leaf
            after += [own[:cut], own[cut:]]
        parts, depth = after, depth + 1
    return np.concatenate(parts) if parts else np.zeros(0, int)


def boxes(v: np.ndarray, extreme: np.ufunc) -> list[np.ndarray]:
    """One side of the boxes by level, leaves first, up to the one box of the root."""
    sides = [extreme.reduceat(v, np.arange(0, len(v), LEAF), axis=0)]
    while len(sides[-1]) > 1:
        sides.append(extreme.reduceat(sides[-1], np.arange(0, len(sides[-1]), FANOUT), axis=0))
    return sides


@dataclass
class Tree:
    """An R-tree: vectors in leaf order, and for each level, leaves first, the least and greatest values of its boxes.

    Box i of a level covers the boxes ``FANOUT * i`` up to ``FANOUT * (i + 1)`` of the level below; leaf i covers the rows ``LEAF * i`` up to ``LEAF * (i + 1)``.
    """

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    least: list[np.ndarray]
    most: list[np.ndarray]

    @classmethod
    def pack(cls, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> Tree:
        order = str_order(v)
        ids, labels, v = ids[order], labels[order], v[order]
        return cls(ids, labels, v, boxes(v, np.minimum), boxes(v, np.maximum))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        small = np.int16 if self.v.size == 0 or np.abs(self.v).max() < 1 << 15 else np.int64
        np.savez(out, ids=self.ids, labels=self.labels, v=self.v.astype(small))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        """The boxes follow from the order of the stored vectors."""
        held = np.load(io.BytesIO(data))
        v = held["v"].astype(np.int64)
        return cls(held["ids"], held["labels"], v, boxes(v, np.minimum), boxes(v, np.maximum))


def number_kind(a: np.ndarray, b: np.ndarray) -> type:
    """Floats where all products and sums of two vectors are exact in them, else Python's whole numbers."""
    if not a.size or not b.size:
        return np.float64
    top = max(abs(int(a.min())), abs(int(a.max()))) * max(abs(int(b.min())), abs(int(b.max()))) * a.shape[1]
    return np.float64 if top < 1 << 53 else object


@dataclass
class Windows:
    """Queries of a block: windows of scores, several to an anchor, with the best found so far (score falling, then id)."""

    owner: np.ndarray  # the anchor's place in the block
    low: np.ndarray
    high: np.ndarray
    same_label: bool
    k: int
    scores: list[list[tuple]]  # of each window: (-score, id), at most k, in order

    @classmethod
    def make(cls, owner, low, high, same_label: bool, k: int) -> Windows:
        return cls(np.asarray(owner, dtype=np.int64), low, high, same_label, k, [[] for _ in owner])

    def floor(self, which: np.ndarray) -> list:
        """The least score that can still enter each window."""
        return [max(self.low[w], -self.scores[w][-1][0]) if len(self.scores[w]) == self.k else self.low[w] for w in which.tolist()]


def search(tree: Tree, anchor_ids: np.ndarray, anchor_labels: np.ndarray, anchors: np.ndarray, windows: Windows) -> int:
    """Best-first search of one tree for all windows of a few anchors; returns the number of boxes opened."""
    kind = number_kind(anchors, tree.v)
    a = anchors.astype(kind)
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    upper = [up @ m.T.astype(kind) + down @ s.T.astype(kind) for s, m in zip(tree.least, tree.most)]
    lower = [up @ s.T.astype(kind) + down @ m.T.astype(kind) for s, m in zip(tree.least, tree.most)]
    every = np.arange(len(windows.owner))
    floor = np.array(windows.floor(every), dtype=kind)
    ceiling = np.array(windows.high, dtype=kind)
    opened, top = 0, len(tree.least) - 1
    queue = [(0, top, 0, every)]  # (bound, level, box, windows it may serve)
    while queue:
        _, level, box, which = heapq.heappop(queue)
        own = windows.owner[which]
        which = which[(upper[level][own, box] >= floor[which]) & (lower[level][own, box] <= ceiling[which])]
        if not len(which):
            continue
        opened += 1
        if level:
            own = windows.owner[which]
            for child in range(FANOUT * box, min(FANOUT * (box + 1), len(tree.least[level - 1]))):
                bound = upper[level - 1][own, child]
                fits = (bound >= floor[which]) & (lower[level - 1][own, child] <= ceiling[which])
                if fits.any():
                    heapq.heappush(queue, (-bound[fits].max(), level - 1, child, which[fits]))
            continue
        rows = slice(LEAF * box, LEAF * (box + 1))
        ids, labels, v = tree.ids[rows], tree.labels[rows], tree.v[rows].astype(kind)
        used, place = np.unique(windows.owner[which], return_inverse=True)
        scores = (a[used] @ v.T)[place]
        equal = labels[None, :] == anchor_labels[used][place][:, None]
        allowed = (equal if windows.same_label else ~equal) & (ids[None, :] != anchor_ids[used][place][:, None])
        hits = allowed & (scores >= floor[which][:, None]) & (scores <= ceiling[which][:, None])
        for i in np.flatnonzero(hits.any(axis=1)).tolist():
            w = int(which[i])
            at = np.flatnonzero(hits[i])
            best = sorted([*windows.scores[w], *zip((-scores[i, at]).tolist(), ids[at].tolist())])[:windows.k]
            windows.scores[w] = best
            if len(best) == windows.k:
                floor[w] = max(floor[w], -best[-1][0])
    return opened


# ---- tables ------------------------------------------------------------------------------------------------------

def build_trees(vectors: DataFrame) -> DataFrame:
    """Rows (tile, dim, tree), stored; each tree is packed by one task from its tile's rows."""
    placed, tiles = tiled(vectors)

    def build(part: pa.Table) -> pa.Table:
        v = np.array(part.column("v").to_pylist(), dtype=np.int64).reshape(part.num_rows, -1)
        by_id = np.argsort(part.column("vec_id").to_numpy())
        tree = Tree.pack(part.column("vec_id").to_numpy()[by_id], part.column("label").to_numpy()[by_id], v[by_id])
        return pa.table({"tile": part.column("tile")[:1], "dim": part.column("dim")[:1], "tree": pa.array([tree.to_bytes()], pa.binary())})

    trees = placed.withColumn("tile", F.col("tile").cast("long")).groupBy("tile", "dim").applyInArrow(build, "tile long, dim int, tree binary")
    return materialize(trees.repartition(max(1, -(-tiles // TILES_A_TASK), min(tiles, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))))), "trees")


def _write_blocks(rows: DataFrame, uri: str, n_rows: int, numbers: list[str]) -> int:
    """Write rows (block key vec_id, label, v, dim and number columns) as files of about ``ANCHORS_A_BLOCK`` anchors; returns the number of blocks."""
    blocks = max(1, -(-n_rows // ANCHORS_A_BLOCK))

    def write(part: pa.Table) -> pa.Table:
        block, dim = int(part.column("block")[0].as_py()), int(part.column("dim")[0].as_py())
        held = {c: part.column(c).to_numpy() for c in ("vec_id", "label", *numbers)}
        held["v"] = np.array(part.column("v").to_pylist(), dtype=np.int64).reshape(part.num_rows, -1)
        with replaced_file(f"{uri}/block-{block:06d}-{dim}.npz") as out:
            buffer = io.BytesIO()
            np.savez(buffer, **held)
            out.write(buffer.getbuffer())
        return pa.table({"n": pa.array([part.num_rows], pa.int64())})

    rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("block", "dim").applyInArrow(write, "n long").agg(F.sum("n")).first()
    return blocks


def _search_all(trees: DataFrame, uri: str, k: int, windowed: bool) -> DataFrame:
    """Rows (anchor_id, positive_id, positive_score, found_id, score): at most k of each query and task."""

    def run(batches):
        tiles = [(int(d.as_py()), t.as_py()) for batch in batches for d, t in zip(batch.column("dim"), batch.column("tree"))]
        if not tiles:
            return
        fs, path = open_fs(uri)
        from pyarrow.fs import FileSelector

        for info in sorted(fs.get_file_info(FileSelector(path, allow_not_found=True)), key=lambda i: i.path):
            if not info.path.endswith(".npz"):
                continue
            with fs.open_input_file(info.path) as f:
                block = dict(np.load(io.BytesIO(f.read())))
            dim = int(info.path.rsplit("-", 1)[1][:-4])
            own = [t for d, t in tiles if d == dim]
            if not own:
                continue
            ids, owner = np.unique(block["vec_id"], return_inverse=True)
            one = np.unique(owner, return_index=True)[1]
            labels, v = block["label"][one], block["v"][one]
            groups = []
            for at in range(0, len(ids), TOGETHER):
                mine = np.flatnonzero((owner >= at) & (owner < at + TOGETHER))
                low = block["low"][mine].tolist() if windowed else [-math.inf] * len(mine)
                high = block["high"][mine].tolist() if windowed else [math.inf] * len(mine)
                groups.append((at, mine, Windows.make(owner[mine] - at, low, high, not windowed, k)))
            for data in own:
                tree = Tree.from_bytes(data)
                for at, _, windows in groups:
                    search(tree, ids[at:at + TOGETHER], labels[at:at + TOGETHER], v[at:at + TOGETHER], windows)
            cols: list[list[int]] = [[] for _ in range(5)]
            for at, mine, windows in groups:
                for w, best in zip(mine.tolist(), windows.scores):
                    for score, found in best:
                        row = (block["vec_id"][w], block["positive_id"][w] if windowed else 0, block["positive_score"][w] if windowed else 0, found, -score)
                        for c, x in zip(cols, row):
                            c.append(int(x))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor_id", "positive_id", "positive_score", "found_id", "score"])

    return trees.select("dim", "tree").mapInArrow(run, "anchor_id long, positive_id long, positive_score long, found_id long, score long")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Adds rank and keeps the first k of each key by falling score, then id."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "found_id"))).where(F.col("rank") <= k)


def mine_hard_negatives(df: DataFrame, label: Column | str = "label", anchors: Column | None = None, positives: int = 5, negatives: int = 5,
                        low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors``: the condition on vec_id that makes a row an anchor (default: divisible by 100).  ``low`` and ``high`` bound 100 * negative score / positive score in percent.
    """
    vectors = materialize(integer_vectors(df, label, scale), "vectors")
    trees = build_trees(vectors)
    asked = vectors.where(anchors if anchors is not None else F.col("vec_id") % 100 == 0)
    n = asked.count()
    uri = fresh_dir(df.sparkSession, "anchors")
    _write_blocks(asked, uri, n, [])
    found = materialize(_search_all(trees, uri, positives, False), "found")
    best = materialize(_first(found, ["anchor_id"], positives).select("anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    discard(found)
    # 100 * score is whole, so the window's ends are whole numbers as well
    ends = best.withColumns({"low": F.ceil(F.col("positive_score").cast("decimal(20,0)") * low / 100).cast("long"),
                             "high": F.floor(F.col("positive_score").cast("decimal(20,0)") * high / 100).cast("long")})
    uri = fresh_dir(df.sparkSession, "windows")
    _write_blocks(asked.join(ends, F.col("vec_id") == F.col("anchor_id")).where("low <= high").select("vec_id", "label", "v", "dim", "positive_id", "positive_score", "low", "high"),
                  uri, n, ["positive_id", "positive_score", "low", "high"])
    found = materialize(_search_all(trees, uri, negatives, True), "found")
    return _first(found, ["anchor_id", "positive_id"], negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
