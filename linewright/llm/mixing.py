"""Mixing sources to target weights: min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. A flow network leads each
pattern's words (its capacity, once for each repetition) to the quotas of its sources; the
first use of a word costs 0, the second 1, the third 2, and so on, so that words are
repeated as little and as evenly as can be. The flow says how many words of a pattern go to a source in each
repetition; a seeded order of the documents then says which documents those are.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linewright.llm.common import cut, fresh



def quotas(sizes: dict[str | None, int], weights: dict[str | None, float], budget: float, most: float) -> dict[str | None, float]:
    """Shares of the budget by weight, none above `most` times its source's size; what is cut
    off is shared again by weight among the others until none is above."""
    capped: dict[str | None, float] = {}
    while True:
        left = budget - sum(capped.values())
        open_ = [s for s in sizes if s not in capped]
        total = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / total if total else 0.0 for s in open_}
        above = [s for s in open_ if share[s] > most * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: float(most * sizes[s]) for s in above}


def min_cost_flow(capacity: list[int], member: list[list[int]], quota: list[int], repeats: int) -> list[list[list[int]]]:
    """flow[pattern][source][repetition]: words sent, at the least total cost among the largest flows.

    Successive shortest paths with potentials on pattern tiers -> patterns -> sources; the
    network has one node for each pattern and source, whatever the number of documents.
    """
    patterns, sources = len(capacity), len(quota)
    start, end = patterns + sources, patterns + sources + 1
    graph: list[list[list[int]]] = [[] for _ in range(end + 1)]

    def edge(a: int, b: int, room: int, cost: int) -> list[int]:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])
        return graph[a][-1]

    tiers = [[edge(start, p, capacity[p], k) for k in range(repeats)] for p in range(patterns)]
    routes = [[(s, edge(p, patterns + s, repeats * capacity[p], 0)) for s in member[p]] for p in range(patterns)]
    for s in range(sources):
        edge(patterns + s, end, quota[s], 0)
    potential = [0] * (end + 1)
    while True:
        far = [1 << 62] * (end + 1)
        far[start], back = 0, {}
        heap = [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room and (new := d + cost + potential[a] - potential[b]) < far[b]:
                    far[b], back[b] = new, (a, k)
                    heapq.heappush(heap, (new, b))
        if far[end] == 1 << 62:
            break
        potential = [p + (f if f < 1 << 62 else 0) for p, f in zip(potential, far, strict=True)]
        path, b = [], end
        while b != start:
            a, k = back[b]
            path.append(graph[a][k])
            b = a
        sent = min(e[1] for e in path)
        for e in path:
            e[1] -= sent
            graph[e[0]][e[3]][1] += sent
    flow = [[[0] * repeats for _ in range(sources)] for _ in range(patterns)]
    for p in range(patterns):
        # a pattern's words fill its repetitions in turn, source after source
        filled = [capacity[p] - e[1] for e in tiers[p]]
        for s, e in routes[p]:
            words = repeats * capacity[p] - e[1]
            for k in range(repeats):
                used = min(words, filled[k])
                flow[p][s][k] += used
                filled[k] -= used
                words -= used
    return flow


def words_of(text: Column) -> Column:
    """Runs of anything but space and U+0009 to U+000D; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def cycled_weights(names: list[str | None], weights: tuple[float, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Weights by turns for the sources in the order of code points, null last."""
    return {s: weights[k % len(weights)] for k, s in enumerate(sorted(names, key=lambda s: (s is None, s or "")))}


def _placed(docs: DataFrame, source: Column, many: bool, id_col: str, text_col: str, seed: int) -> DataFrame:
    pattern = F.array_sort(F.array_distinct(F.coalesce(source, F.array()))) if many else F.array(source)
    size = words_of(F.col(text_col))
    # a seeded order that any engine can repeat
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    order = F.struct(mark.alias("h"), F.col(id_col).alias("d"), size.alias("n"))
    # a pattern's key is JSON text, for equality of arrays that hold nulls
    key = F.to_json(F.struct(F.transform(pattern, lambda s: F.coalesce(s, F.lit("\x00"))).alias("s")))
    place = F.struct(order.alias("at"), pattern.alias("sources"), key.alias("key"), F.conv(F.left(mark, F.lit(3)), 16, 10).cast("int").alias("range"))
    return docs.select(F.struct(*docs.columns).alias("_row"), place.alias("_p"))


def _copies(docs: DataFrame, weights: dict[str | None, float] | None, share: float, most: int, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(_row, sources, size, source_size, target, copies) for each row of docs."""
    many = dict(docs.dtypes)[source_col].startswith("array")
    every = _placed(docs, F.col(source_col), many, id_col, text_col, seed)
    base = cut(every.select("_p.*").withColumn("size", F.col("at.n")))
    groups = base.groupBy("key").agg(F.first("sources").alias("sources"), F.sum("size").alias("words")).collect()
    sums = {r.key: r.words for r in groups}
    patterns = sorted(sums)
    sources = {r.key: list(r.sources) for r in groups}
    names = sorted({s for p in sources.values() for s in p}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(sums[p] for p in patterns if s in sources[p]) for s in names}
    weights = weights or cycled_weights(names)
    target = quotas(sizes, {s: weights.get(s, 0) for s in names}, share * sum(sums.values()), most) if names else {}
    flow = min_cost_flow([sums[p] for p in patterns], [[names.index(s) for s in sources[p]] for p in patterns], [round(target[s]) for s in names], most)
    want = {p: sum(map(sum, flow[k])) for k, p in enumerate(patterns)}
    rows = [(p, *(divmod(want[p], sums[p]) if sums[p] else (1, 0)), sum(sizes[s] for s in sources[p]), float(sum(target[s] for s in sources[p]))) for p in patterns]
    plan = docs.sparkSession.createDataFrame(rows, "key string, whole long, rest long, source_size long, target double")
    based = base.join(F.broadcast(plan), "key")
    # a pattern's order in 4,096 ranges by its first three hex digits: only the documents of the
    # range in which a quota ends are sorted; words before each range, then before each document of the range in which the rest ends
    ranges = based.groupBy("key", "range").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("key").orderBy("range"))
    ends = (
        ranges.withColumn("upto", upto)
        .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
        .groupBy("key")
        .agg(F.min_by(F.struct("range", (F.col("upto") - F.col("words")).alias("before")), "range").alias("end"))
        .select("key", F.col("end.range").alias("end_range"), F.col("end.before").alias("before"))
    )
    last = based.join(F.broadcast(ends), "key").where(F.col("range") == F.col("end_range"))
    # equal ids and sizes are taken alike: the order is over distinct places
    spot = last.groupBy("key", "at").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    run = F.sum("words").over(Window.partitionBy("key").orderBy("at"))
    # documents are taken as long as they fit; one more, of any place after them, fills the gap best
    chosen = spot.withColumn("end", F.col("before") + run).where(F.col("end") <= F.col("rest"))
    chosen = chosen.groupBy("key").agg(F.max("at").alias("last_at"), F.max("end").alias("filled"))
    # a row per pattern: metadata, as bounded as the plan itself
    limits = cut(plan.join(ends, "key", "left").join(chosen, "key", "left").withColumn("gap", F.col("rest") - F.coalesce("filled", "before")))
    taken = (F.col("range") < F.col("end_range")) | ((F.col("range") == F.col("end_range")) & F.coalesce(F.col("at") <= F.col("last_at"), F.lit(False)))
    off = F.abs(F.col("size") - F.col("gap"))
    closest = base.join(F.broadcast(limits), "key").where(~taken & (F.col("size") > 0) & (off < F.col("gap"))).groupBy("key").agg(F.min_by("at", F.struct(off, F.col("at"))).alias("one_at"))
    limits = cut(limits.join(closest, "key", "left"))
    placed = every.select("_row", "_p.*").withColumn("size", F.col("at.n")).join(F.broadcast(limits), "key")
    extra = F.when(F.col("rest") == 0, 0).when(F.col("end_range").isNull(), 1).otherwise((taken | F.coalesce(F.col("at") == F.col("one_at"), F.lit(False))).cast("int"))
    copies = F.least(F.col("whole") + extra, F.lit(most)).cast("int")
    return placed.withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(copies))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, share: float = 1.0, most: int = 3, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Choose how often each document is used so that each source nears its target.

    `source_col` holds a source, or an array of sources for documents of several. Without
    weights the sources weigh 1, 2, 3 by turns (code point order, null last). Returns, per
    row: the id, sources (its pattern), size (words), source_size and target (sums over its
    sources, those of all rows), copies (0 to `most`) and taken (size times copies). Rows
    that repeat an id and size are used alike; empty and null texts have size 0, take nothing
    and are used once. An empty table gives an empty result. The numbers of patterns and of
    sources are those of the metadata, and only their sums reach the driver.
    """
    narrow = fresh(docs, id_col, text_col, source_col)
    used = _copies(narrow, weights, share, most, seed, id_col, text_col, source_col)
    return used.select(F.col(f"_row.{id_col}").alias(id_col), "sources", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: dict[str | None, float] | None = None, share: float = 1.0, most: int = 3, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of `docs`, each as often as the mix uses it."""
    used = _copies(docs, weights, share, most, seed, id_col, text_col, source_col)
    return used.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_n")).select("_row.*")
