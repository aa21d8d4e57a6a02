"""Embedding near-duplicates by sharded small-world graphs, and exact top-k search by MaxScore."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linewright.llm.common import cut, fresh, tidy
from linewright.llm.components import Forest, named_components
from linewright.llm.hnsw import Graph

#: Vectors of a shard, and queries that search it at once. Both bound a task's memory.
SHARD_ROWS, QUERY_ROWS = 100_000, 100_000
#: Least number of shards, so that a small table keeps several tasks busy.
LEAST_SHARDS = 8
#: Queries made at the threshold from a beam of which recall is measured, and products held at
#: once where queries meet every row.
PLANTED, SCAN_PAIRS = 256, 1 << 22


def packed_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float | None = None) -> DataFrame:
    """(id, vec): the vector as little-endian float64 bytes, or floor(scale * x) as int64 bytes.

    vec is null for a vector that is null or empty or holds a null or a non-finite component.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v"):
                row = None
                if v.is_valid and len(v) and not v.values.null_count:
                    x = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                    if np.isfinite(x).all():
                        row = (x if scale is None else np.floor(x * scale).astype("<i8")).tobytes()
                out.append(row)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "vec"])

    return fresh(df, F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(pack, "id long, vec binary")


def _matrix(column: pd.Series, kind: str) -> np.ndarray:
    if not len(column):
        return np.empty((0, 0), kind)
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows of a largest component near 1, by a power of two, so that no digit is lost."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1, keepdims=True))[1]) if len(rows) else rows


def _units(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.einsum("nd,nd->n", rows, rows))[:, None]


def _met(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int, shard_rows: int, query_rows: int) -> DataFrame:
    """The rows of each shard, and after them the queries, of which each goes to every shard.

    A row carries its columns and `asked` (0 for a shard's, 1 for a query), dim, shard and lane.
    A task streams its queries past the shard's rows, so that no row needs to be in several
    tasks. Only while shards are fewer than the session's shuffle partitions, a shard with
    more than query_rows queries is there in several lanes, which share the queries. Vectors
    of different lengths never meet; shards and lanes are dealt by a hash of the row."""
    shards = max(LEAST_SHARDS, -(-n_rows // shard_rows))
    blocks = max(1, -(-n_queries // query_rows))
    lanes = min(blocks, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    place = [F.octet_length("vec").alias("dim")]
    dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "id", "vec"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = rows.select("*", F.lit(0).alias("asked"), *place, dealt(1, shards).alias("shard"), every(lanes).alias("lane"))
    all_ = queries.select("*", F.lit(1).alias("asked"), *place, every(shards).alias("shard"), dealt(2, lanes).alias("lane"))
    met = own.unionByName(all_, allowMissingColumns=True)
    # a partition for each, which a hash of them would not give
    return met.repartitionById(shards * lanes, F.col("shard") * lanes + F.col("lane")).sortWithinPartitions("dim", "shard", "lane", "asked", "id", "vec")


def beside(batches: Iterator[pd.DataFrame], make, query_rows: int) -> Iterator[tuple]:
    """(made, queries): what `make` makes of a shard's rows, once, beside at most query_rows of
    its queries at a time. The batches are of _met: sorted, a shard's rows before its queries."""
    key, rows, held, made = None, [], [], None
    for batch in batches:
        for (dim, shard, lane, asked), part in batch.groupby(["dim", "shard", "lane", "asked"], sort=True):
            if key != (dim, shard, lane):
                if held and made is not None:
                    yield made, pd.concat(held)
                key, rows, held, made = (dim, shard, lane), [], [], None
            if not asked:
                rows.append(part)
                continue
            if rows:
                made, rows = make(pd.concat(rows)), []
            if made is None:
                continue  # queries of a shard without rows
            held.append(part)
            size = sum(map(len, held))
            if size >= query_rows:
                waiting, full = pd.concat(held), size - size % query_rows
                for start in range(0, full, query_rows):
                    yield made, waiting[start : start + query_rows]
                held = [waiting[full:]] if full < size else []
    if held and made is not None:
        yield made, pd.concat(held)


def planted(rows: np.ndarray, least: float, most: int = PLANTED, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(queries, rows' places): unit vectors, each in a random direction just inside the cosine
    `least` of a row drawn at random; the hardest links that there can be, whatever the data hold."""
    rng = np.random.default_rng(seed)
    places = rng.permutation(len(rows))[:most]
    some = rows[places]
    away = rng.normal(size=some.shape)
    away -= np.einsum("nd,nd->n", away, some)[:, None] * some
    away /= np.maximum(np.linalg.norm(away, axis=1), 1e-300)[:, None]
    cosine = min(1.0, least + 1e-3)
    return cosine * some + np.sqrt(1 - cosine * cosine) * away, places


def linked(graph: Graph, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, least: float, width: int, audit: int, target: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, row) places of the pairs found with cosine >= least, a bounded number at a time.

    rows, queries: scaled, not of length 1. own: the row that is the query itself, or -1; it is
    no link and no evidence. The beam starts at `width` and doubles until the search finds
    `target` of the links of two kinds of queries: `audit` drawn at random, which meet every
    row (their links count if there are any), and those planted at the threshold. A query
    whose beam is links to a third searches again with a beam four times as wide, and beyond
    1,024 against every row. All pairs are verified in double precision.
    """
    fast = _units(queries).astype(np.float32)
    near = np.float32(least - 1e-4)
    slice_ = max(1, SCAN_PAIRS // max(1, len(rows)))
    row_squares, query_squares = np.einsum("nd,nd->n", rows, rows), np.einsum("nd,nd->n", queries, queries)

    def verified(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dots = np.concatenate([np.einsum("nd,nd->n", queries[q[s : s + 65536]], rows[r[s : s + 65536]]) for s in range(0, len(q), 65536)] or [np.empty(0)])
        keep = (dots / np.sqrt(query_squares[q] * row_squares[r]) >= least) & (own[q] != r)
        return q[keep], r[keep]

    def scanned(places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start in range(0, len(places), slice_):
            part = places[start : start + slice_]
            q, r = np.nonzero(fast[part] @ graph.vectors.T >= near)
            yield verified(part[q], r)

    def searched(places: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while len(places) and width <= min(1024, len(rows) - 1):
            again = []
            for start in range(0, len(places), 256):
                part = places[start : start + 256]
                found, sims = graph.search(fast[part], width)
                # a beam that links fill by a third may have missed some of a crowd
                full = (sims >= near).sum(1) * 3 >= width
                again.append(part[full])
                q, c = np.nonzero((sims >= near) & ~full[:, None])
                yield verified(part[q], found[q, c])
            places, width = np.concatenate(again), width * 4
        yield from scanned(places)

    order = np.random.default_rng(3).permutation(len(queries))
    drawn, rest = order[:audit], order[audit:]
    true = np.zeros(len(queries), np.int64)
    for q, r in scanned(drawn):
        np.add.at(true, q, 1)
        yield q, r
    made, sources = planted(_units(rows), least)
    made, some = made.astype(np.float32), np.flatnonzero(true)
    while len(rest) and width <= 1024:
        found = graph.search(made, width)[0]
        recall = (found == sources[:, None]).any(1).mean()
        if recall >= target and len(some):
            hit = np.zeros(len(queries), np.int64)
            for q, _ in searched(some, width):
                np.add.at(hit, q, 1)
            recall = (hit[some] / true[some]).mean()
        if recall >= target:
            break
        width *= 2
    yield from searched(rest, width)


def near_duplicates(
    df: DataFrame,
    least: float = 0.9,
    width: int = 16,
    audit: int = 96,
    target: float = 0.99,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: its id, n_links, component_id, kept.

    Equal vectors are one class, searched once and counted by its size. One graph is built for
    each shard of classes and written down, and every class searches every shard. Each task
    returns a number of links for each of its queries and a forest that joins what it found
    linked, not the pairs. A vector that is null, empty, zero, or holds null or non-finite
    components links with nothing; vectors of different lengths don't link. Repeated ids
    are vectors of their own that share a component if they link. An empty table gives no rows.
    """
    packed = packed_vectors(df, id_col, vector_col)
    zero = F.expr("translate(hex(vec), '0', '') = ''")
    packed = cut(packed.withColumn("vec", F.when(~zero, F.col("vec"))))
    valid = packed.where(F.col("vec").isNotNull()).select(F.col("id").alias("doc_id"), "vec", F.md5("vec").alias("name"))
    classes = valid.groupBy("name").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    n = classes.count()
    nodes = classes.select(F.col("node").alias("id"), "copies", "vec")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        graph = Graph(_units(_scaled(_matrix(frame["vec"], "<f8"))).astype(np.float32))
        return frame[["id", "copies", "vec"]].assign(placed=graph.placed())

    shards = max(LEAST_SHARDS, -(-n // shard_rows))
    shard = F.pmod(F.xxhash64(F.lit(1), "id", "vec"), F.lit(shards)).cast("int")
    built = cut(nodes.groupBy(F.octet_length("vec").alias("dim"), shard.alias("shard")).applyInPandas(build, "id long, copies long, vec binary, placed binary"))

    def restore(rows: pd.DataFrame) -> tuple:
        rows = rows.sort_values("id", kind="stable")
        x = _scaled(_matrix(rows["vec"], "<f8"))
        return rows["id"].to_numpy(), rows["copies"].to_numpy().astype(np.int64), x, Graph.restored(_units(x).astype(np.float32), list(rows["placed"]))

    @tidy
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (row_ids, copies, x, graph), queries in beside(batches, restore, query_rows):
            query_ids, y = queries["id"].to_numpy(), _scaled(_matrix(queries["vec"], "<f8"))
            nodes, ends = np.unique(np.concatenate([row_ids, query_ids]), return_inverse=True)
            row_ends, query_ends = ends[: len(x)], ends[len(x) :]
            place = np.full(len(nodes), -1)
            place[row_ends] = np.arange(len(x))
            counts, tree = np.zeros(len(y), np.int64), Forest(len(nodes))
            for q, r in linked(graph, x, y, place[query_ends], least, width, audit, target):
                np.add.at(counts, q, copies[r])
                tree.join(query_ends[q], row_ends[r])
            some = np.flatnonzero(counts)
            low, high = (nodes[e] for e in tree.edges())
            yield pd.DataFrame(
                {
                    "a": np.concatenate([query_ids[some], low]),
                    "b": np.concatenate([query_ids[some], high]),
                    "n": np.concatenate([counts[some], np.zeros(len(low), np.int64)]),
                }
            )

    out = cut(_met(built, nodes.select("id", "vec"), n, n, shard_rows, query_rows).mapInPandas(search, "a long, b long, n long"))
    counts = out.where(F.col("n") > 0).groupBy("a").agg(F.sum("n").alias("links"))
    good = named_components(valid.select("doc_id", "name"), classes, counts, out.where(F.col("n") == 0).select("a", "b")).select("doc_id", "n_links", "component_id")
    bad = packed.where(F.col("vec").isNull()).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(bad).select(F.col("doc_id").alias(id_col), "n_links", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


class Postings:
    """A shard's integer vectors as impact-bounded lists: list (d, +) holds the rows whose
    component d is above 0, list (d, -) those whose component is below."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, heads: int = 32):
        order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[order], rows[order]
        self.highest, self.lowest = rows.max(0), rows.min(0)
        small = float(np.abs(rows).max(initial=0))
        self.limit = 2.0**52 / max(1.0, small * rows.shape[1])
        self.rows = rows
        self.exact = rows.astype(np.float64)  # whole numbers this small are exact as doubles
        self.above, self.below = np.ascontiguousarray((rows > 0).T), np.ascontiguousarray((rows < 0).T)
        by = np.argsort(rows, axis=0, kind="stable")
        self.tops, self.ends = by[-heads:].T, by[:heads].T

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (places, scores) but the query's own; ties to the smaller id."""
        rows = self.exact if np.abs(query).max(initial=0) < self.limit else self.rows
        query = query.astype(rows.dtype)
        wide = query.astype(np.float64)
        bounds = np.maximum(wide * self.highest, wide * self.lowest).clip(0)
        terms = np.argsort(-bounds, kind="stable")
        # left[j]: bound of terms[j:], and a little more than rounding can take from it
        left = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0) * (1 + 1e-12)
        slack = 1e-12 * bounds.sum()
        # a first threshold: the best of those at the heads of the heaviest lists
        heads = np.unique(np.concatenate([self.tops[d] if query[d] > 0 else self.ends[d] for d in terms[:4]]))
        heads = heads[self.ids[heads] != own]
        scores = rows[heads] @ query
        least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf
        least = float(least) - slack
        # rows in no essential list stay below the threshold: their score is at most left[cutoff]
        cutoff = int(np.searchsorted(-left, -least, side="right")) if np.isfinite(least) else len(terms)
        cutoff = min(cutoff, len(terms)) if least > 0 else len(terms)
        if least > 0:
            hit = np.zeros(len(self.ids), bool)
            for d in terms[:cutoff]:
                hit |= self.above[d] if query[d] > 0 else self.below[d]
                if hit.all():
                    break
            places = np.flatnonzero(hit & (self.ids != own))
        else:
            places = np.flatnonzero(self.ids != own)
        essential = terms[:cutoff]
        scores = rows[np.ix_(places, essential)] @ query[essential] if len(places) < len(self.ids) // 2 else (rows[:, essential] @ query[essential])[places]
        # the other lists are probed, heaviest first, for rows that can still get in
        for start in range(cutoff, len(terms), 4):
            alive = scores + left[start] >= least
            places, scores = places[alive], scores[alive]
            some = terms[start : start + 4]
            scores = scores + rows[np.ix_(places, some)] @ query[some]
        best = np.lexsort((places, -scores))[:k]
        return places[best], scores[best].astype(np.int64)


def top_k(
    df: DataFrame,
    every: int = 20,
    k: int = 20,
    scale: float = 64.0,
    shard_rows: int = SHARD_ROWS // 10,
    query_rows: int = QUERY_ROWS // 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows by integer inner product.

    Components become floor(scale * x). Queries are the rows whose id is divisible by
    `every`; a query's own id is no candidate. Ties go to the smaller id, so the result is
    one of a kind if ids are; repeated ids give a row each. Scores must fit a long. Vectors that are null or hold
    null or non-finite components take no part, and queries meet vectors of their own length
    only. Null ids are no queries. With fewer candidates than k all come back; an empty
    table gives no rows.
    """
    packed = cut(packed_vectors(df, id_col, vector_col, scale).where(F.col("vec").isNotNull()))
    queries = packed.where(F.pmod("id", F.lit(every)) == 0)
    n, m = packed.count(), queries.count()

    @tidy
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        post = lambda rows: Postings(rows["id"].to_numpy(), _matrix(rows["vec"], "<i8"))
        for lists, asked in beside(batches, post, query_rows):
            out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
            for own, query in zip(asked["id"].tolist(), _matrix(asked["vec"], "<i8"), strict=True):
                places, scores = lists.top(query, own, k)
                out["query_id"].append(np.full(len(places), own))
                out["vec_id"].append(lists.ids[places])
                out["score"].append(scores)
            yield pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})

    found = _met(packed.where(F.col("id").isNotNull()), queries, n, m, shard_rows, query_rows).mapInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
