"""Near-duplicate vectors by an inverted multi-index.

Each half of the vectors has a codebook of its own; pairs of centroids make a grid of cells, and
every vector is listed in its home cell. A vector visits the cells nearest to it, in the order of the
multi-sequence traversal: growing sums of its halves' distances to the two centroids. The number of
cells is set so that vectors just at the threshold are found with the target recall. Each visit is
verified by cosine in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import again, keep
from .components import components

#: Rows of the sample for each centroid, and rows at most; half of them fit the codebooks, half set the
#: number of cells. Every row is indexed.
FIT, SAMPLE = 128, 65_536
#: Distinct vectors that a cell of the grid holds on average: codebooks grow with the root of the rows.
HELD = 512
#: Members and visitors of a cell that meet in one group, at most on average.
MEET = 2_000


def fit_codebook(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means centroids."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([_squares(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)])
        for j in range(len(c)):
            if (home == j).any():
                c[j] = x[home == j].mean(0)
    return c


def _units(rows: list) -> np.ndarray:
    """Unit vectors in double precision."""
    u = np.array(rows, dtype=np.float64)
    u /= np.abs(u).max(1, keepdims=True)
    return u / np.linalg.norm(u, axis=1, keepdims=True)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def _halves(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    half = x.shape[1] // 2
    return _squares(x[:, :half], books[0]), _squares(x[:, half:], books[1])


def visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], cells: int) -> np.ndarray:
    """The numbers of the `cells` nearest grid cells of each unit vector, nearest first."""
    # the r-th cell of the traversal has ranks (i, j) with (i + 1) * (j + 1) <= r
    n, m = min(cells, len(books[0])), min(cells, len(books[1]))
    front = [(i, j) for i in range(n) for j in range(min(m, cells // (i + 1)))]
    fi, fj = np.array([f[0] for f in front]), np.array([f[1] for f in front])
    out = []
    for i in range(0, len(x), 256):
        a, b = _halves(x[i : i + 256], books)
        ia, ib = np.argsort(a, 1, kind="stable")[:, :n], np.argsort(b, 1, kind="stable")[:, :m]
        a, b = np.take_along_axis(a, ia, 1), np.take_along_axis(b, ib, 1)
        order = np.argsort(a[:, fi] + b[:, fj], 1, kind="stable")[:, :cells]
        out.append(np.take_along_axis(ia, fi[order], 1) * len(books[1]) + np.take_along_axis(ib, fj[order], 1))
    return np.concatenate(out)


def _rank_of_home(x: np.ndarray, y: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many cells are nearer to each x than the home cell of its partner y."""
    (a, b), (ya, yb) = _halves(x, books), _halves(y, books)
    i, j = ya.argmin(1), yb.argmin(1)
    at = a[np.arange(len(x)), i] + b[np.arange(len(x)), j]
    b = np.sort(b, 1)
    return np.array([np.searchsorted(b[r], at[r] - a[r], side="left").sum() for r in range(len(x))])


def cells_for_recall(held_out: np.ndarray, books: tuple[np.ndarray, np.ndarray], threshold: float, recall: float, seed: int = 5) -> int:
    """How many cells to visit so that partners of held-out vectors at exactly the threshold are found by one side or the other."""
    rng = np.random.default_rng(seed)
    x = held_out[:2048]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * noise / np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    rank = np.minimum(_rank_of_home(x, y, books), _rank_of_home(y, x, books))
    return int(min(len(books[0]) * len(books[1]), np.quantile(rank, recall, method="higher") + 1))


def _local_components(link: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and each column of a link matrix reaches within it."""
    top = np.iinfo(np.int64).max
    la, lb = a.copy(), b.copy()
    while True:
        nb = np.minimum(lb, np.where(link, la[:, None], top).min(0))
        na = np.minimum(la, np.where(link, nb[None], top).min(1))
        if (na == la).all() and (nb == lb).all():
            return la, lb
        la, lb = na, nb


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, k: int | None = None, recall: float = 0.995) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, label).

    Vectors are compared only when their labels are equal and not null; a link is a cosine of at least
    the threshold. Equal vectors of a label are collapsed first and count as links of one another.
    Large cells are dealt out in blocks of members and visitors. A block returns each vector's number
    of links and, for components, each vector's smallest partner within the block, never its pairs.
    Each half's codebook has k centroids, by default as many as leave HELD distinct vectors to a cell of
    the grid, so that a cell's work doesn't grow with the rows; up to SAMPLE rows fit them.
    A pair is found when either side visits the other's home; it is counted once on both sides.

    Null, empty or zero vectors, those with null or non-finite components, and rows without label or
    vec_id link with nothing: 0 links, component_id is the own vec_id. Rows that repeat a vec_id are
    rows of their own that share a node. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda c: c != 0), F.lit(False))
    as_double = F.transform(x, lambda c: c.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    rows = keep(rows.select("vec_id", "label", F.when(sound, as_double).alias("x")).withColumn("print", F.when(F.col("x").isNotNull(), F.sha2(F.to_json(F.struct("x")), 256))), "vectors")
    distinct = keep(rows.filter("x is not null").groupBy("label", "print").agg(F.min_by("x", "vec_id").alias("x"), F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "distinct")

    k = k or max(16, round((distinct.count() / HELD) ** 0.5))
    size = min(SAMPLE, max(4096, FIT * k))
    sample = distinct.withColumn("dim", F.size("x")).orderBy(F.xxhash64("rep"), "rep").limit(size).select("dim", "x").toPandas()
    books: dict[int, tuple] = {}
    for dim, g in sample.groupby("dim"):
        u = _units(g["x"].tolist())
        # rows of a small sample serve both ends
        fit, held_out = (u[::2], u[1::2]) if len(u) >= 4 * k else (u, u)
        pair = (fit_codebook(fit[:, : dim // 2], k, 1), fit_codebook(fit[:, dim // 2 :], k, 2))
        books[int(dim)] = (pair, cells_for_recall(held_out, pair, threshold, recall))
    index = spark.sparkContext.broadcast(books)
    # vectors travel to cells as narrow as they came
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"

    def place(frames):
        for frame in frames:
            cells = np.empty(len(frame), dtype=object)
            dims = frame["x"].map(len)
            for dim, at in dims.groupby(dims).indices.items():
                u = _units(frame["x"].iloc[at].tolist())
                pair, n = index.value.get(int(dim), (None, 0))
                v = visits(u, pair, n) if pair else np.zeros((len(u), 1), dtype=np.int64)
                for i, j in enumerate(at):
                    cells[j] = v[i].tolist()
            yield frame.assign(dim=dims, cells=cells)[["label", "dim", "rep", "copies", "x", "cells"]]

    placed = keep(distinct.select("label", "rep", "copies", "x").mapInPandas(place, f"label string, dim int, rep long, copies long, x array<{kind}>, cells array<int>"), "placed")
    visiting = placed.select("label", "dim", F.explode("cells").alias("cell"), "rep")
    sizes = visiting.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / MEET).cast("int").alias("nv")).join(
        placed.groupBy("label", "dim", F.element_at("cells", 1).alias("cell")).agg(F.ceil(F.count("*") / MEET).cast("int").alias("nm")), ["label", "dim", "cell"])
    sizes = keep(sizes, "sizes")
    keys = ["label", "dim", "cell"]
    members = (
        placed.withColumn("cell", F.element_at("cells", 1)).join(sizes, keys)
        .withColumn("sm", F.pmod(F.xxhash64("rep"), F.col("nm")).cast("int")).withColumn("sv", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))
    )
    visitors = (
        again(placed).withColumn("home", F.element_at("cells", 1)).withColumn("cell", F.explode("cells")).join(again(sizes), keys)
        .withColumn("sv", F.pmod(F.xxhash64("rep"), F.col("nv")).cast("int")).withColumn("sm", F.explode(F.sequence(F.lit(0), F.col("nm") - 1)))
    )
    group = [*keys, "sm", "sv"]

    def meet(m: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"rep": [], "links": [], "least": []}, dtype="int64")
        if not len(m) or not len(v):
            return none
        mine, theirs = m["rep"].to_numpy(), v["rep"].to_numpy()
        link = _units(v["x"].tolist()) @ _units(m["x"].tolist()).T >= threshold
        link &= theirs[:, None] != mine[None]
        va, mb = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
        if not len(va):
            return none
        link = link[np.ix_(va, mb)]
        home = v["home"].to_numpy()[va]
        # a member counts a visitor only if it doesn't visit the visitor's home itself
        visited = [set(c) for c in m["cells"].iloc[mb]]
        homes, which = np.unique(home, return_inverse=True)
        back = np.array([[h in s for s in visited] for h in homes.tolist()])[which]
        own, other = v["copies"].to_numpy()[va], m["copies"].to_numpy()[mb]
        la, lb = _local_components(link, theirs[va], mine[mb])
        return pd.concat([
            pd.DataFrame({"rep": theirs[va], "links": link @ other, "least": la}),
            pd.DataFrame({"rep": mine[mb], "links": (link & ~back).T @ own, "least": lb}),
        ])

    met = keep(members.select(*group, "rep", "copies", "x", "cells").groupBy(*group).cogroup(visitors.select(*group, "rep", "copies", "x", "home").groupBy(*group)).applyInPandas(meet, "rep long, links long, least long"), "met")
    counted = met.groupBy("rep").agg(F.sum("links").alias("links"))
    reps = distinct.select("label", "print", "rep", "copies")
    # rows that repeat a vec_id under another vector hold their groups together
    several = rows.filter("print is not null").join(reps, ["label", "print"]).select("vec_id", "rep").distinct()
    joined = keep(components(met.select(F.col("rep").alias("a"), F.col("least").alias("b")).union(several.filter("vec_id <> rep")), "a", "b"), "components")
    out = (
        rows.select("vec_id", "label", "print").join(reps, ["label", "print"], "left").join(counted, "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    )
    component = F.coalesce("component", "rep", "vec_id")
    links = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
