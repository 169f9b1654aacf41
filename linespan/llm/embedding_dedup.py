"""Near-dedup of embeddings by product quantisation.

Equal vectors become one class. Unit vectors are dealt into coarse inverted lists, by label and nearest centroid, and in
each list tight balls are formed, so small that all in a ball are linked with each other; most balls hold one vector, and
a mass of near copies becomes a few balls. A ball's centre is coded: its residual from the centroid, subspace by
subspace. Every vector looks into its own list and all those whose border is near enough, reads asymmetric distances from
lookup tables, and for balls that may be in reach the exact cosine decides: a whole ball is in reach, or none of it, or
its members are compared one by one. So links are counted without listing the pairs of a group.

Bounds are kept in every step (a code's error, a ball's radius), so only the choice of lists can miss a link; see
``MARGIN``, and ``exact`` for a choice that can't. Centroids and codebooks are fitted on a bounded sample; every vector is indexed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linespan.llm.common import materialise
from linespan.llm.components import components

COSINE = 0.93
#: Lists are as many as the square root of the rows, and so many at most; subspaces of a code and codes of each.
CELLS, SUBSPACES, CODES = 2_048, 8, 64
#: The sample that centroids and codebooks are fitted on: so many rows, or so many for each list if that is more.
SAMPLE, EACH = 8_192, 32
#: Lists are looked into up to this share of the link distance beyond their border; from 12 dimensions down all that can
#: hold a link, above that 3.5 / sqrt(dimensions) of it: a random direction is that close to the border's normal.
MARGIN = 3.5
#: Rows of a list that are put into balls together; queries and balls that meet in one group.
CHUNK, QUERIES, BALLS = 1_024, 2_048, 16_384
#: Queries whose distances are looked up at once.
BLOCK = 128


@dataclass
class Index:
    """For vectors of one length: centroids (K, d), codebooks (M, C, d / M), the subspaces' bounds."""

    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each row, and squared distances to all."""
        d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.centroids.T + (self.centroids**2).sum(1), 0)
        return d.argmin(1), d

    def probes(self, x: np.ndarray, reach: float) -> list[np.ndarray]:
        """For each row the cells to look into: those whose border with its own is within ``reach``."""
        own, d = self.cells(x)
        length = (self.centroids**2).sum(1)
        at = self.centroids[own]
        apart = np.sqrt(np.maximum(length[own][:, None] + length - 2 * at @ self.centroids.T, 1e-30))
        border = (d - d[np.arange(len(x)), own][:, None]) / (2 * apart)
        border[np.arange(len(x)), own] = 0
        return [np.flatnonzero(b <= reach).astype(np.int32) for b in border]

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (N, M) and the distance of each row from what its code stands for."""
        codes = np.zeros((len(residual), len(self.books)), np.uint8)
        left = np.zeros(len(residual))
        for m, book in enumerate(self.books):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            d = np.maximum((part * part).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1), 0)
            codes[:, m] = d.argmin(1)
            left += ((part - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(left)

    def distances(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances (queries, coded): the sums of table entries that the codes name."""
        out = np.zeros((len(residual), len(codes)))
        for m, book in enumerate(self.books):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            table = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            out += table[:, codes[:, m]]
        return np.sqrt(np.maximum(out, 0))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return np.unique(c, axis=0)


def lists_for(rows: int) -> int:
    return max(1, min(CELLS, int(np.sqrt(rows))))


def fit(sample: np.ndarray, rows: int, seed: int = 5) -> Index:
    """An index from unit vectors; ``rows``: how many there are in all, which sets the number of lists."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    centroids = _kmeans(sample, min(lists_for(rows), len(sample)), rng)
    m = min(SUBSPACES, d)
    cuts = [d * i // m for i in range(m + 1)]
    near = ((centroids**2).sum(1) - 2 * sample @ centroids.T).argmin(1)
    residual = sample - centroids[near]
    return Index(centroids, [_kmeans(residual[:, a:b], min(CODES, len(sample)), rng) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], cuts)


def link_distance(cosine: float) -> float:
    return float(np.sqrt(2 - 2 * cosine))


def balls(x: np.ndarray, weight: np.ndarray, own: np.ndarray, most: float) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, float]]]:
    """Puts points (with a radius of their own each) into balls of radius ``most`` at most.

    Returns for each the row that its ball is named after, and centre and radius by that row. A seed gathers what lies
    near it, the centre moves to the mean, and what doesn't fit around that is left for other balls.
    """
    name = np.arange(len(x))
    made: dict[int, tuple[np.ndarray, float]] = {}
    free = np.ones(len(x), bool)
    for i in range(len(x)):
        if not free[i]:
            continue
        at = np.flatnonzero(free)
        near = at[np.sqrt(np.maximum(((x[at] - x[i]) ** 2).sum(1), 0)) + own[at] <= 2 * most]
        if len(near) > 1:
            centre = np.average(x[near], axis=0, weights=weight[near])
            reach = np.sqrt(((x[near] - centre) ** 2).sum(1)) + own[near]
            fits = reach <= most
            if fits.sum() > 1 and fits[near == i].all():
                near = near[fits]
                name[near], free[near] = near.min(), False
                made[int(near.min())] = centre, float(reach[fits].max())
                continue
        free[i] = False
        made[i] = x[i], float(own[i])
    return name, made


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64) if len(column) else np.zeros((0, 1))


def _columns(df: DataFrame, dropped: tuple[str, ...] = ()) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in dropped)


def _with_cells(df: DataFrame, indexes: dict[int, Index], vector: str, coded: bool = False, reach: float | None = None, margin: float = MARGIN) -> DataFrame:
    """``df`` with cell, or with a row for each cell to look into (``reach``), or with code and error too (``coded``)."""
    shared = df.sparkSession.sparkContext.broadcast(indexes)
    schema = _columns(df) + (", cells array<int>" if reach is not None else ", cell int") + ", code binary, error double" * coded

    def run(parts):
        for whole in parts:
            for k in range(0, len(whole), 1024):
                pdf = whole.iloc[k : k + 1024]
                for dim, own in pdf.groupby(pdf[vector].map(len)):
                    index, x = shared.value[int(dim)], _matrix(own[vector])
                    if reach is not None:
                        yield own.assign(cells=index.probes(x, min(1.0, margin / np.sqrt(dim)) * reach))
                        continue
                    own = own.assign(cell=index.cells(x)[0].astype(np.int32))
                    if coded:
                        codes, error = index.encode(x - index.centroids[own["cell"].to_numpy()])
                        own = own.assign(code=[c.tobytes() for c in codes], error=error)
                    yield own

    out = df.mapInPandas(run, schema)
    return out.select(*df.columns, F.explode("cells").alias("cell")) if reach is not None else out


LIST = ["label", "dim", "cell"]


def _chunked(df: DataFrame, size: int, key: str, out: str) -> DataFrame:
    """``df`` with the number of its list's chunks (``out``_n) and the chunk of each row."""
    sizes = df.groupBy(*LIST).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{out}_n"))
    return df.join(sizes, LIST).withColumn(out, F.pmod(F.xxhash64(key), F.col(f"{out}_n")).cast("int"))


def _gather(rows: DataFrame, most: float) -> DataFrame:
    """(name, ball, centre, radius, size): the ball of each row of (label, dim, cell, name, vec, own, size); centre,
    radius and size are those of the ball where name is the ball's, and null elsewhere."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name", ignore_index=True)
        x, size = _matrix(pdf.vec), pdf["size"].to_numpy()
        name, made = balls(x, size, pdf.own.to_numpy(), most)
        total = np.bincount(name, weights=size, minlength=len(pdf))
        lead = [made.get(i) if name[i] == i else None for i in range(len(pdf))]
        return pd.DataFrame({
            "name": pdf.name, "ball": pdf.name.to_numpy()[name], "label": pdf.label, "dim": pdf.dim,
            "vec": [None if m is None else m[0] for m in lead], "own": [None if m is None else m[1] for m in lead], "size": [0 if m is None else int(total[i]) for i, m in enumerate(lead)],
        })

    label = rows.schema["label"].dataType.simpleString()
    return _chunked(rows, CHUNK, "name", "part").groupBy(*LIST, "part").applyInPandas(run, f"name bigint, ball bigint, label {label}, dim int, vec array<double>, own double, size bigint")


def _look(index_of, cosine: float):
    reach = link_distance(cosine)

    def run(key, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = {"rep": [], "ball": [], "n": [], "whole": []}
        if len(asked) and len(held):
            index = index_of.value[int(asked.dim.iloc[0])]
            x, c = _matrix(asked.vec), _matrix(held.vec)
            codes = np.frombuffer(b"".join(held.code), np.uint8).reshape(len(held), -1)
            radius, error, size, ball = (held[k].to_numpy() for k in ("own", "error", "size", "ball"))
            cell = int(asked["cell"].iloc[0])
            for k in range(0, len(x), BLOCK):
                q = x[k : k + BLOCK]
                maybe = index.distances(q - index.centroids[cell], codes) <= reach + radius + error + 1e-9
                maybe &= asked.ball.to_numpy()[k : k + BLOCK, None] != ball
                i, j = np.nonzero(maybe)
                single = radius[j] == 0
                d = np.sqrt(((q[i] - c[j]) ** 2).sum(1))
                near = np.einsum("ij,ij->i", q[i], c[j]) >= cosine
                whole = np.where(single, near, d + radius[j] <= reach - 1e-9)
                part = ~single & ~whole & (d - radius[j] <= reach + 1e-9)
                take = whole | part
                out["rep"].append(asked.rep.to_numpy()[k : k + BLOCK][i[take]])
                out["ball"].append(ball[j[take]])
                out["n"].append(size[j[take]])
                out["whole"].append(whole[take])
        return pd.DataFrame({k: np.concatenate(v) if v else np.zeros(0, bool if k == "whole" else np.int64) for k, v in out.items()})

    return run


def unit(embedding: list | None) -> np.ndarray | None:
    """The vector at length 1 in doubles; None if it has no direction or a component that is no number."""
    x = np.asarray([] if embedding is None else embedding, dtype=np.float64)
    if not len(x) or not np.isfinite(x).all() or not (top := np.abs(x).max()):
        return None
    x = x / top + 0.0  # so that squares neither vanish nor overflow, and zeros have one sign
    return x / np.sqrt(x @ x)


def _units(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vec and mark (equal for equal labels and vectors); vec and mark are null where nothing can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                labels = b.column("label").to_pylist()
                vecs = [None if label is None else unit(e) for label, e in zip(labels, b.column("embedding").to_pylist(), strict=True)]
                marks = [None if v is None else hashlib.sha256(repr(label).encode() + v.tobytes()).hexdigest() for label, v in zip(labels, vecs, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(vecs, pa.list_(pa.float64())), pa.array(marks, pa.string())], names=["vec_id", "label", "vec", "mark"])

    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    return own.mapInArrow(run, f"vec_id bigint, label {own.schema['label'].dataType.simpleString()}, vec array<double>, mark string")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Two vectors are linked if their labels are equal and not null, their lengths too, and their cosine in doubles is
    ``cosine`` at least. Null, empty and zero vectors and those with null, NaN or infinite components have no links.
    Repeated rows are separate vectors, linked with each other; a null vec_id takes part in links but names no
    component (rows that reach no id have none). Extra columns are ignored; an empty table gives no rows.

    ``exact``: every list that can hold a link is looked into, so none is missed; without it, lists are chosen by ``MARGIN``.
    """
    rows = materialise(_units(vectors), "vectors")
    classes = rows.where(F.col("vec").isNotNull()).groupBy("mark").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    # classes are named by a number of their own, as all rows of one may lack an id
    classes = materialise(classes.withColumns({"dim": F.size("vec"), "rep": F.xxhash64("mark")}), "vector-classes")
    indexes = {}
    for dim, n in [tuple(r) for r in classes.groupBy("dim").count().collect()]:  # a row for each length of vector
        some = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("mark"), "mark").limit(max(SAMPLE, EACH * lists_for(n))).select("vec").collect()
        indexes[dim] = fit(np.array([r.vec for r in some]), n)
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not indexes:
        return alone
    members = _with_cells(classes.select(F.col("rep").alias("name"), "label", "dim", "size", "vec", F.lit(0.0).alias("own")), indexes, "vec")
    limit = link_distance(cosine) / 2 - 1e-9
    first = materialise(_gather(members, limit), "balls")
    belongs = first.select(F.col("name").alias("rep"), "ball")
    now, n = first.where(F.col("name") == F.col("ball")), None
    while (size := now.count()) != n and size > CHUNK:  # balls of different chunks of a list may fit into one
        n = size
        again = _with_cells(now.select("name", "label", "dim", "size", "vec", "own"), indexes, "vec")
        merged = materialise(_gather(again, limit), "balls")
        step = merged.select(F.col("name").alias("_ball"), F.col("ball").alias("_into"))
        belongs = materialise(belongs.join(step, F.col("ball") == F.col("_ball")).select("rep", F.col("_into").alias("ball")), "ball-members")
        now = merged.where(F.col("name") == F.col("ball"))
    held = materialise(_with_cells(now.select("ball", "label", "dim", "size", "vec", "own"), indexes, "vec", coded=True), "coded-balls")
    asked = classes.select("rep", "label", "dim", "vec").join(belongs, "rep")
    # a ball's centre is half a link distance from its members at most
    wide = {"reach": 1.5 * link_distance(cosine), "margin": np.inf} if exact else {"reach": 1.25 * link_distance(cosine)}
    probing = _with_cells(asked, indexes, "vec", **wide)
    # lists that many look into, or that hold many balls, are cut both ways
    asked_n = probing.groupBy(*LIST).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("asked_n"))
    held_n = held.groupBy(*LIST).agg(F.ceil(F.count(F.lit(1)) / BALLS).cast("int").alias("held_n"))
    shape = materialise(asked_n.join(held_n, LIST), "lists")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probing.join(shape, LIST).withColumns({"qc": F.pmod(F.xxhash64("rep"), F.col("asked_n")).cast("int"), "bc": each("held_n")})
    shape = shape.select(*LIST, F.col("asked_n").alias("asked_k"), F.col("held_n").alias("held_k"))
    right = held.join(shape, LIST).withColumns({"bc": F.pmod(F.xxhash64("ball"), F.col("held_k")).cast("int"), "qc": each("asked_k")})
    shared = vectors.sparkSession.sparkContext.broadcast(indexes)
    met = left.groupBy(*LIST, "qc", "bc").cogroup(right.groupBy(*LIST, "qc", "bc")).applyInPandas(_look(shared, cosine), "rep bigint, ball bigint, n bigint, whole boolean")
    met = materialise(met, "ball-links")
    whole = met.where("whole").select("rep", F.col("ball").alias("other"), "n")
    inside = belongs.join(held.select("ball", F.col("size").alias("n")), "ball").select("rep", F.col("ball").alias("other"), "n")
    pairs = met.where("NOT whole").select("rep", "ball").join(classes.select("rep", F.col("vec").alias("x")), "rep").join(belongs.select(F.col("rep").alias("other"), "ball"), "ball").join(classes.select(F.col("rep").alias("other"), F.col("vec").alias("y"), F.col("size").alias("n")), "other")
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    near = pairs.where(dot >= cosine).select("rep", "other", "n")
    linked = materialise(whole.unionByName(inside).unionByName(near), "vector-links")
    total = linked.groupBy("rep").agg((F.sum("n") - 1).alias("n_links"))
    reached = classes.join(components(linked, "rep", "other"), F.col("rep") == F.col("node"), "left").select("mark", "rep", "id", F.coalesce("component", "rep").alias("component"))
    least = reached.groupBy("component").agg(F.min("id").alias("component_id"))  # the smallest id that there is
    done = reached.join(least, "component").join(total, "rep").select(F.col("mark").alias("_mark"), "n_links", "component_id")
    out = rows.join(done, F.col("mark") == F.col("_mark"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
