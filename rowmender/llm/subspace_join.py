"""Near-duplicate embeddings by a pigeonhole join over subspaces.

Vectors of length one with a cosine of at least ``cosine`` lie within a squared distance of
``2 - 2 * cosine``. A fixed random rotation spreads that distance over all coordinates,
which are then split into blocks. If every block exceeded its proportional part of the
squared distance, the whole would exceed it; so a pair within the limit lies within
its part in at least one block. Each block is range-joined: its first two coordinates
form a grid whose cells are as wide as the block's radius, so only neighbouring cells meet.
A pair is taken in the first block that brings it together, and its cosine is then computed
in double precision on the vectors themselves.

Equal vectors are one class, and classes are compared. A task compares two chunks of bounded
size and returns numbers of links and one label per class; pairs are folded into these a
batch at a time and never kept. Vectors that
are null, zero, or hold a null or a non-finite component link with nothing; vectors of
different lengths never link. Labels and other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rowmender.llm.common import map_rows, pa_schema, slices, written
from rowmender.operators.components import connected


@dataclass(frozen=True)
class SubspaceSettings:
    cosine: float = 0.95
    block: int = 16
    chunk: int = 32_768  # rows of either side of a task
    tile: int = 1024  # rows compared at once inside a task
    seed: int = 11


NEIGHBOURS = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))  # one half of the nine cells: each pair of cells once


def rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, size])).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


class Geometry:
    """Blocks, budgets and cells for vectors of one length."""

    def __init__(self, size: int, settings: SubspaceSettings):
        self.size, self.turn = size, rotation(size, settings.seed)
        edges = [*range(0, size, settings.block), size]
        self.blocks = list(zip(edges, edges[1:]))
        limit = 2 - 2 * settings.cosine + 1e-9
        self.budgets = [limit * (hi - lo) / size for lo, hi in self.blocks]

    def turned(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.turn

    def cells(self, turned: np.ndarray, block: int) -> np.ndarray:
        lo, hi = self.blocks[block]
        part = np.zeros((len(turned), 2))
        part[:, : min(2, hi - lo)] = turned[:, lo : min(lo + 2, hi)]
        return np.floor(part / self.budgets[block] ** 0.5).astype(np.int64)


def unit(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), "<f4").reshape(len(vectors), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def by_length(vectors: list[bytes]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        out.setdefault(len(v) // 4, []).append(i)
    return out


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, two hashes of the components and the components as bytes; null for those that cannot link."""

    def make():
        def work(cols):
            out = {"vec_id": cols["vec_id"], "h1": [], "h2": [], "v": []}
            for values in cols["embedding"]:
                data = None
                if values and None not in values:
                    x = np.array(values, "<f4") + np.float32(0)
                    norm = float((x.astype(np.float64) ** 2).sum())
                    if np.isfinite(norm) and norm > 0:
                        data = x.tobytes()
                digest = np.frombuffer(xxhash.xxh3_128_digest(data), "<i8").tolist() if data else (None, None)
                out["h1"].append(digest[0])
                out["h2"].append(digest[1])
                out["v"].append(data)
            return out

        return work

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return map_rows(vectors.select("vec_id", "embedding"), make, f"vec_id {kind}, h1 bigint, h2 bigint, v binary")


def cell_counts(classes: DataFrame, settings: SubspaceSettings) -> dict[tuple[int, int, int, int], int]:
    """Rows per (length, block, cell): vectors have length one, so there are few cells whatever the data."""

    def run(batches):
        geometry: dict[int, Geometry] = {}
        counted: dict[tuple, int] = {}
        for batch in slices(batches, 4096):
            vectors = batch.column(0).to_pylist()
            for size, rows in by_length(vectors).items():
                g = geometry.setdefault(size, Geometry(size, settings))
                turned = g.turned(unit([vectors[i] for i in rows]))
                for b in range(len(g.blocks)):
                    found, n = np.unique(g.cells(turned, b), axis=0, return_counts=True)
                    for (x, y), k in zip(found.tolist(), n.tolist()):
                        counted[size, b, x, y] = counted.get((size, b, x, y), 0) + k
        rows = [(*key, n) for key, n in counted.items()]
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["size", "b", "x", "y", "n"])

    found = classes.select("v").mapInArrow(run, "size bigint, b bigint, x bigint, y bigint, n bigint")
    return {tuple(r)[:4]: r["n"] for r in found.groupBy("size", "b", "x", "y").agg(F.sum("n").alias("n")).collect()}


def dealt(classes: DataFrame, counts: dict, settings: SubspaceSettings) -> DataFrame:
    """Every class once per task that needs it: (task, home side or not, node, copies, v)."""
    chunk = settings.chunk
    facing = {key: sum(counts.get((key[0], key[1], key[2] + dx, key[3] + dy), 0) for dx, dy in NEIGHBOURS) for key in counts}
    home = {key: -(-n // chunk) for key, n in counts.items()}
    other = {key: -(-n // chunk) for key, n in facing.items()}
    kind = classes.schema["node"].dataType.simpleString()
    schema = f"task string, b int, home boolean, node {kind}, copies bigint, v binary"
    types = pa_schema(classes.sparkSession, schema)

    def run(batches):
        geometry: dict[int, Geometry] = {}
        for batch in slices(batches):
            nodes, copies, vectors = (batch.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            for size, rows in by_length(vectors).items():
                g = geometry.setdefault(size, Geometry(size, settings))
                turned = g.turned(unit([vectors[i] for i in rows]))
                for b in range(len(g.blocks)):
                    for i, (x, y) in zip(rows, g.cells(turned, b).tolist()):
                        place = xxhash.xxh3_64_intdigest(vectors[i], seed=b)
                        key = (size, b, x, y)
                        row = (nodes[i], copies[i], vectors[i])
                        mine = place % home[key]
                        out += [(f"{size} {b} {x} {y} {mine} {j}", b, True, *row) for j in range(other[key])]
                        for dx, dy in NEIGHBOURS:
                            near = (size, b, x - dx, y - dy)
                            if near in home:
                                theirs = place % other[near]
                                out += [(f"{size} {b} {x - dx} {y - dy} {j} {theirs}", b, False, *row) for j in range(home[near])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), types)], schema=types)

    return classes.select("node", "copies", "v").mapInArrow(run, schema)


def roots(label: np.ndarray) -> None:
    """Point every entry at the end of its chain; labels never exceed their own number."""
    while True:
        further = label[label]
        if (further == label).all():
            return
        label[:] = further


def fold(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i] under the smaller root; only this batch of pairs is held."""
    while len(a):
        roots(label)
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))


def compare(settings: SubspaceSettings, types: pa.Schema):
    """The links between the home rows and the facing rows of a task."""

    def close_pairs(g: Geometry, block: int, x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray):
        lo, hi = g.blocks[block]
        part = lambda t: t[:, lo:hi].astype(np.float32)
        px, py = part(x), part(y)
        room = 0.5 * np.float32(g.budgets[block] + 1e-5)
        hx, hy = 0.5 * (px * px).sum(1), 0.5 * (py * py).sum(1)
        for a in range(0, len(px), settings.tile):
            for b in range(0, len(py), settings.tile):
                near = px[a : a + settings.tile] @ py[b : b + settings.tile].T
                near -= hx[a : a + settings.tile, None]
                near -= hy[None, b : b + settings.tile]
                i, j = np.nonzero(near >= -room)
                i, j = i + a, j + b
                for at in range(0, len(i), 100_000):
                    k, m = i[at : at + 100_000], j[at : at + 100_000]
                    gap = (x[k] - y[m]) ** 2
                    sums = np.stack([gap[:, p:q].sum(1) for p, q in g.blocks], 1)
                    inside = sums <= np.array(g.budgets) + 1e-7
                    first = inside.argmax(1)
                    ok = inside.any(1) & (first == block)
                    k, m = k[ok], m[ok]
                    ok = np.einsum("ij,ij->i", ux[k], uy[m]) >= settings.cosine
                    yield k[ok], m[ok]

    def step(table):
        home = np.array(table.column("home").to_pylist(), bool)
        empty = pa.Table.from_pylist([], schema=types)
        if not home.any() or home.all():
            return empty
        nodes, copies, vectors = (table.column(c).to_pylist() for c in ("node", "copies", "v"))
        block, size = table.column("b")[0].as_py(), len(vectors[0]) // 4
        g = Geometry(size, settings)
        units = unit(vectors)
        turned = g.turned(units)
        mine, theirs = np.flatnonzero(home), np.flatnonzero(~home)
        cell = table.column("task")[0].as_py().split(" ")[2:4]
        own_cell = (g.cells(turned[theirs], block) == np.array(cell, np.int64)).all(1)
        # rows of the home cell face it too: there a pair of classes is taken in one of its two orders only
        rank = {n: r for r, n in enumerate(sorted({nodes[i] for i in range(len(nodes))}))}
        ranks = np.array([rank[n] for n in nodes])
        links = np.zeros(len(nodes), np.int64)
        weight = np.array(copies, np.int64)
        label = np.arange(len(rank))
        for i, j in close_pairs(g, block, turned[mine], turned[theirs], units[mine], units[theirs]):
            a, b = mine[i], theirs[j]
            ok = ~own_cell[j] | (ranks[a] < ranks[b])
            a, b = a[ok], b[ok]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            fold(label, ranks[a], ranks[b])
        roots(label)
        total = np.zeros(len(rank), np.int64)
        np.add.at(total, ranks, links)
        names = sorted(rank, key=rank.get)
        hit = np.flatnonzero((total > 0) | (label != np.arange(len(rank))))
        return pa.Table.from_arrays(
            [pa.array([names[i] for i in hit], types.field(0).type), pa.array(total[hit], pa.int64()), pa.array([names[label[i]] for i in hit], types.field(2).type)],
            schema=types)

    return step


def near_vectors(vectors: DataFrame, settings: SubspaceSettings = SubspaceSettings()) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding)."""
    keys, _ = written(keyed(vectors), "vectors")
    usable = keys.filter("v is not null and vec_id is not null")
    classes, _ = written(
        usable.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "v")).alias("x"), F.count(F.lit(1)).alias("copies")).select(
            "h1", "h2", F.col("x.vec_id").alias("node"), F.col("x.v").alias("v"), "copies"), "classes")
    counts = cell_counts(classes, settings)
    kind = classes.schema["node"].dataType.simpleString()
    schema = f"node {kind}, links bigint, label {kind}"
    types = pa_schema(vectors.sparkSession, schema)
    found, _ = written(dealt(classes, counts, settings).groupBy("task").applyInArrow(compare(settings, types), schema), "links")
    sets = connected(found.filter("node <> label").select(F.col("label").alias("id_1"), F.col("node").alias("id_2")).distinct())
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    table = classes.select("h1", "h2", "node", "copies").join(links, "node", "left").join(sets.withColumnRenamed("id", "node"), "node", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("set_id", "node").alias("component_id"))
    able = F.col("v").isNotNull() & F.col("vec_id").isNotNull()
    own = keys.select("vec_id", F.when(able, F.col("h1")).alias("h1"), F.when(able, F.col("h2")).alias("h2")).join(table, ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return own.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
