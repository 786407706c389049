"""Operator 13: exact top-k inner products by best-first search in M-trees.

Vectors are made whole numbers and dealt to clusters around a bounded number of pivots; a cluster that is too large for
a tree is dealt over several. Each task bulk-loads M-trees: pages hold vectors (leaves) or routing vectors with covering
radii (inner nodes), both with their distance to the page's own routing vector. The pages are a table.

Queries descend from the root, best bound first, some of them together. With ``c`` a page's routing vector, ``r`` its covering radius and ``p``
the routing vector above it, no vector x of the page scores more than ``<q,c> + |q| r``, and the triangle inequality
bounds ``<q,c>`` itself by ``<q,p> + |q| d(p,c)``: entries that this stored distance rules out are never computed. Scores
are whole, so bounds are cut to whole numbers; a page at the k-th score is opened only for a smaller vec_id.

Two rounds: a query first searches the tree that holds it, then, with the k-th score found there, the trees of those
clusters that its bound doesn't rule out. Both rounds deal (tree, block of queries) to tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, partitions

#: Vectors of a tree, about; entries of a page; queries that one task searches in a tree, about.
TREE, PAGE, QUERIES = 8192, 128, 65_536
#: Queries that descend a tree together.
TOGETHER = 256
#: Pivots at most, in number and bytes: they go to every task.
PIVOTS, PIVOT_BYTES = 4096, 16 << 20
#: Scaled components beyond this don't take part.
LARGEST = 2.0**31
_LONG = 2**63 - 1
_NONE = (-(2**63), -(2**63))

_PAGES = "tree long, page long, leaf boolean, ids binary, rows binary, vectors binary, up binary, radius binary, child binary, least binary"
_FOUND = "query long, query_id long, vec_id long, score long"


def dots(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact products of the matrices ``x`` and ``q`` of whole-numbered doubles, held within the range of a long."""
    if not x.size or not q.size:
        return np.zeros((x.shape[0], q.shape[1]), dtype=np.int64)
    if float(np.abs(x).max()) * float(np.abs(q).max()) * len(q) < 2.0**53:
        return (x @ q).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(x) @ whole(q), -_LONG - 1, _LONG).astype(np.int64)


class Tree:
    """An M-tree, bulk-loaded or read from its pages."""

    def __init__(self):
        self.pages: list[dict] = []

    @classmethod
    def load(cls, ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> Tree:
        """Build over vectors in order of ``ids``: seeds are spread over that order, each vector joins the nearest."""
        tree = cls()
        mean = np.floor(x.mean(0)) if len(x) else np.zeros(x.shape[1])
        tree._grow(np.arange(len(ids)), mean, ids, rows, x)
        return tree

    def _grow(self, at: np.ndarray, routing: np.ndarray, ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> int:
        number = len(self.pages)
        self.pages.append({})
        up = np.linalg.norm(x[at] - routing, axis=1)
        if len(at) <= PAGE:
            self.pages[number] = {"leaf": True, "ids": ids[at], "rows": rows[at], "x": x[at], "up": up, "radius": np.zeros(len(at)), "child": np.full(len(at), -1), "least": ids[at]}
            return number
        seeds = at[np.unique(np.linspace(0, len(at) - 1, min(PAGE, 2 * -(-len(at) // PAGE))).astype(np.int64))]
        far = (x[at] ** 2).sum(1)[:, None] - 2 * x[at] @ x[seeds].T + (x[seeds] ** 2).sum(1)
        nearest = far.argmin(1)
        if (nearest == nearest[0]).all():  # copies: runs of the order
            nearest = np.arange(len(at)) * len(seeds) // len(at)
        used = np.unique(nearest)
        groups = [at[nearest == k] for k in used]
        centres = x[seeds[used]]
        radius = np.array([np.linalg.norm(x[g] - c, axis=1).max() for g, c in zip(groups, centres, strict=True)])
        child = np.array([self._grow(g, c, ids, rows, x) for g, c in zip(groups, centres, strict=True)])
        least = np.array([ids[g].min() for g in groups])
        self.pages[number] = {"leaf": False, "ids": least, "rows": least, "x": centres, "up": np.linalg.norm(centres - routing, axis=1), "radius": radius, "child": child, "least": least}
        return number

    def arrays(self) -> Iterator[tuple]:
        for number, p in enumerate(self.pages):
            yield (number, p["leaf"], *(np.ascontiguousarray(p[k], dtype=t).tobytes() for k, t in (("ids", "i8"), ("rows", "i8"), ("x", "f8"), ("up", "f8"), ("radius", "f8"), ("child", "i8"), ("least", "i8"))))

    def add(self, leaf: bool, ids: bytes, rows: bytes, x: bytes, up: bytes, radius: bytes, child: bytes, least: bytes) -> None:
        """The next page, in order of number."""
        i, r, u = np.frombuffer(ids, "i8"), np.frombuffer(rows, "i8"), np.frombuffer(up, "f8")
        page = {"leaf": leaf, "ids": i, "rows": r, "x": np.frombuffer(x, "f8").reshape(len(i), -1), "up": u, "radius": np.frombuffer(radius, "f8"), "child": np.frombuffer(child, "i8"), "least": np.frombuffer(least, "i8")}
        self.pages.append(page)

    def search(self, q: np.ndarray, rows: np.ndarray, k: int, floors: list[tuple[int, int]] | None = None) -> tuple[list[list[tuple[int, int]]], int]:
        """For each query (a row of ``q``) the best ``(score, -vec_id)`` of other rows than its own, at most ``k``, all above
        its floor; and the number of products computed.

        One queue serves the queries together: it is keyed by the best bound that any of them has for a page, and a page is
        computed for those queries only that still need it, on those entries only that one of them needs.
        """
        floors = floors or [_NONE] * len(q)
        best: list[list[tuple[int, int]]] = [[] for _ in q]
        limit = np.array([f[0] for f in floors], dtype=np.int64)
        least = np.array([-f[1] if f != _NONE else _LONG for f in floors], dtype=np.int64)
        length = np.linalg.norm(q, axis=1)
        everyone = np.arange(len(q))
        # the root has no routing vector above it: its entries are bounded by their products alone
        queue = [(0.0, 0, 0, everyone, None, None)]
        computed = 0

        def room(high: np.ndarray, of: np.ndarray, smallest: np.ndarray | int) -> np.ndarray:
            """Whether something within the bound, of that vec_id or a larger one, may enter the queries' best."""
            return ~((high < limit[of]) | ((high == limit[of]) & (smallest >= least[of])))

        while queue:
            bound, smallest, number, asked, above, high = heapq.heappop(queue)
            if above is not None:
                if -bound < limit.min():
                    break
                open_ = room(high, asked, smallest)
                asked, above = asked[open_], above[open_]
            if not len(asked):
                continue
            page = self.pages[number]
            entries = np.arange(len(page["ids"]))
            if above is not None:
                need = room(_above(above[:, None], length[asked, None] * (page["up"] + page["radius"])).T, asked, page["least"][:, None]).T
                some = need.any(1)
                asked, need = asked[some], need[some]
                entries = np.flatnonzero(need.any(0))
            if not len(asked):
                continue
            score = dots(page["x"][entries], q[asked].T)
            computed += score.size
            if page["leaf"]:
                at, of = np.nonzero(score >= limit[asked])
                for s, i, r, who in zip(score[at, of].tolist(), page["ids"][entries[at]].tolist(), page["rows"][entries[at]].tolist(), asked[of].tolist(), strict=True):
                    full = len(best[who]) == k
                    if r != rows[who] and (s, -i) > (best[who][0] if full else floors[who]):
                        (heapq.heappushpop if full else heapq.heappush)(best[who], (s, -i))
                        if len(best[who]) == k:
                            limit[who], least[who] = best[who][0][0], -best[who][0][1]
                continue
            tops = _above(score, length[asked] * page["radius"][entries, None])
            for n, at in enumerate(entries.tolist()):
                first = int(page["least"][at])
                open_ = room(tops[n], asked, first)
                if open_.any():
                    heapq.heappush(queue, (-float(tops[n][open_].max()), first, int(page["child"][at]), asked[open_], score[n][open_], tops[n][open_]))
        return best, computed


def _above(score: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The whole number that no score within ``reach`` of ``score`` exceeds, with room for rounding."""
    return np.floor(score + reach + 1e-9 * (np.abs(score) + reach) + 1e-6)


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """``row, vec_id, dim, v`` of the rows that take part: components ``floor(scale * x)``, as doubles in bytes."""
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) <= LARGEST)))
    rows = good.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            n = x.value_lengths().to_pylist()
            flat = x.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *n])
            v = [flat[i:j].tobytes() for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(n, pa.int32()), pa.array(v, pa.binary())], ["row", "vec_id", "dim", "v"])

    return rows.mapInArrow(pack, "row long, vec_id long, dim int, v binary")


class Pivots:
    """Cluster centres by length of vector; a vector whose length has none is in the cluster ``-1 - dim``."""

    def __init__(self, picked: list[tuple[int, bytes]]):
        self.of_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for dim in {d for d, _ in picked}:
            number = np.array([k for k, (d, _) in enumerate(picked) if d == dim])
            self.of_dim[dim] = number, np.frombuffer(b"".join(v for d, v in picked if d == dim), "f8").reshape(len(number), dim)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and distance to its centre of each row of ``x``."""
        if x.shape[1] not in self.of_dim:
            return np.full(len(x), -1 - x.shape[1]), np.full(len(x), np.inf)
        number, c = self.of_dim[x.shape[1]]
        at = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        return number[at], np.linalg.norm(x - c[at], axis=1)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    dim = batch.column("dim").to_numpy()
    for d in np.unique(dim):
        some = batch.filter(pa.array(dim == d))
        yield some, np.frombuffer(b"".join(some.column("v").to_pylist()), "f8").reshape(len(some), int(d))


def _append(batch: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])


def top_products(vectors: DataFrame, k: int = 5, scale: int = 256, every: int = 50, tree_rows: int = TREE) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row whose vec_id is divisible by ``every`` the ``k`` best other rows.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored. Components are ``floor(scale * x)``; scores
    are their exact inner products (held within a long), ties go to the smaller vec_id. Vectors that are null or hold
    null or non-finite components, rows without a vec_id and vectors with a scaled component beyond 2**31 take no part.
    Only vectors of one length are compared with each other. Empty vectors score 0 with each other. Rows that repeat a
    vec_id are rows of their own: each is a candidate of the others, and each that is a query gives its own result. A
    query with fewer candidates gets all of them. An empty table gives an empty one.

    The pivots are a bounded sample (``PIVOTS`` rows by hash); they only decide which tree holds a vector.
    """
    spark = vectors.sparkSession
    units = cut(whole_vectors(vectors, scale))
    size = units.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("d")).first()
    wanted = max(1, min(PIVOTS, -(-size["n"] // tree_rows), PIVOT_BYTES // (8 * max(1, size["d"] or 1))))
    picked = units.orderBy(F.xxhash64("vec_id", "row"), "row").limit(wanted).select("dim", "v").collect()
    pivots = Pivots([(r["dim"], bytes(r["v"])) for r in picked])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in _by_dim(batch):
                cluster, far = pivots.nearest(x)
                yield _append(some, cluster=pa.array(cluster, pa.int64()), far=pa.array(far))

    dealt = units.mapInArrow(deal, "row long, vec_id long, dim int, v binary, cluster long, far double")
    # at most one cluster a pivot and one a length without pivots
    clusters = dealt.groupBy("cluster").agg(F.count(F.lit(1)).alias("c"), F.max("far").alias("radius")).withColumn("trees", F.ceil(F.col("c") / tree_rows).cast("long"))
    clusters = cut(clusters)
    tree = F.xxhash64("cluster", F.pmod(F.xxhash64("row"), F.col("trees")))
    placed = dealt.drop("far").join(clusters.select("cluster", "trees"), "cluster").withColumn("tree", tree)
    parts = partitions(spark)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> pa.RecordBatch:
            rows, ids, v = zip(*held, strict=True)
            made = Tree.load(np.array(ids, "i8"), np.array(rows, "i8"), np.frombuffer(b"".join(v), "f8").reshape(len(ids), -1))
            columns = list(zip(*((key, *page) for page in made.arrays()), strict=True))
            types = [pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _PAGES.split(", ")])

        for batch in batches:
            for t, *row in zip(*(batch.column(c).to_pylist() for c in ("tree", "row", "vec_id", "v")), strict=True):
                if t != key:
                    if held:
                        yield close()
                    key, held = t, []
                held.append(row)
        if held:
            yield close()

    pages = cut(placed.select("tree", "vec_id", "row", "v").repartition(parts, "tree").sortWithinPartitions("tree", "vec_id", "row").mapInArrow(build, _PAGES))
    queries = cut(placed.where(F.col("vec_id") % every == 0).select("row", "vec_id", "dim", "v", "cluster", "tree"))
    blocks = max(1, -(-queries.count() // QUERIES))
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks))

    def searched(visits: DataFrame) -> DataFrame:
        """Search each ``(tree, near, row, vec_id, v, floor_score, floor_id)``; in a task pages come first, then queries by the tree they are in."""
        over = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else pages.withColumn("block", F.lit(0))
        asked = visits.withColumn("block", block.cast("int"))
        both = over.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        names = ("tree", "block", "kind", "leaf", "ids", "rows", "vectors", "up", "radius", "child", "least", "row", "vec_id", "v", "floor_score", "floor_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, waiting = None, Tree(), []

            def answers() -> pa.RecordBatch:
                rows, ids, v, score, least = zip(*waiting, strict=True)
                floors = [_NONE if s is None else (s, i) for s, i in zip(score, least, strict=True)]
                q = np.frombuffer(b"".join(v), "f8").reshape(len(rows), -1)
                best, _ = held.search(q, np.array(rows, "i8"), k, floors)
                out = [(row, vec_id, -i, s) for row, vec_id, of in zip(rows, ids, best, strict=True) for s, i in of]
                columns = list(zip(*out, strict=True)) if out else [()] * 4
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "query_id", "vec_id", "score"])

            for batch in batches:
                for t, b, kind, *page, row, vec_id, v, score, least in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                    if (t, b) != key or len(waiting) == TOGETHER:
                        if waiting:
                            yield answers()
                        waiting = []
                        if (t, b) != key:
                            key, held = (t, b), Tree()
                    if kind == 0:
                        held.add(*page)
                    elif held.pages:
                        waiting.append((row, vec_id, v, score, least))
            if waiting:
                yield answers()

        ordered = both.select(*names, "page", "near").repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", "kind", "page", "near", "row")
        return ordered.mapInArrow(run, _FOUND)

    nothing = F.lit(None).cast("long")
    first = cut(searched(queries.select("tree", F.col("tree").alias("near"), "row", "vec_id", "v", nothing.alias("floor_score"), nothing.alias("floor_id"))))
    # the k-th of the query's own tree, where there are so many
    kth = first.groupBy("query").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("score", (-F.col("vec_id")).alias("least"))).alias("kth")).where(F.col("c") == k)
    known = queries.join(kth.select(F.col("query").alias("row"), F.col("kth.score").alias("floor_score"), F.col("kth.least").alias("floor_id")), "row", "left")
    bounds = {r["cluster"]: (r["trees"], r["radius"]) for r in clusters.collect()}  # one row a pivot, see above

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, q in _by_dim(batch):
                number, centres = pivots.of_dim.get(q.shape[1], (np.array([-1 - q.shape[1]]), np.zeros((1, q.shape[1]))))
                open_ = np.array([c for c in range(len(number)) if int(number[c]) in bounds], dtype=np.int64)
                number, centres = number[open_], centres[open_]
                radius = np.array([bounds[int(c)][1] for c in number])
                with np.errstate(invalid="ignore"):
                    product, reach = q @ centres.T, np.linalg.norm(q, axis=1)[:, None] * radius
                    high = np.floor(product + reach + 1e-9 * (np.abs(product) + reach) + 1e-6)
                lowest = np.array([-np.inf if s is None else float(s) for s in some.column("floor_score").to_pylist()])
                i, j = np.nonzero(~(high < lowest[:, None]))
                trees = np.array([bounds[int(c)][0] for c in number])[j]
                chosen = some.take(pa.array(i))
                yield _append(chosen.select(["row", "vec_id", "v", "tree", "floor_score", "floor_id"]), cluster=pa.array(number[j], pa.int64()), trees=pa.array(trees, pa.int64()))

    asked = known.mapInArrow(visits, "row long, vec_id long, v binary, tree long, floor_score long, floor_id long, cluster long, trees long")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)))
    asked = asked.withColumn("other", F.xxhash64("cluster", "salt")).where(F.col("other") != F.col("tree"))
    second = searched(asked.select(F.col("other").alias("tree"), F.col("tree").alias("near"), "row", "vec_id", "v", "floor_score", "floor_id"))

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
