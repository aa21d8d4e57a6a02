"""Quality scores by Bradley-Terry ranking on preference pairs of documents.

A good document is preferred to a bad one. The weights of a document's features are learned
by logistic loss on the feature differences of such pairs; the score is the weighted sum, and
a quantile of the scores of labelled documents, at the share of bad ones, is the threshold.
Every labelled document counts for the features' means and spreads, for the pairs and for the
threshold: executors hold the features and the pairs, and the driver gets sums of them.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm.common import crc_mod, cut, fresh, resident, small_batches, tidy
from linewright.llm.labelled import labelled_documents

#: Opponents that each labelled document draws from the other class.
OPPONENTS = 8
#: Documents of a class whose opponents one generator draws, rows of features that one task
#: sums, tasks whose sums are added in one, and documents of a class up to which it is broadcast.
DRAW_BLOCK, TASK_ROWS, FOLD, BROADCAST_ROWS = 2**14, 50_000, 64, 1_000
#: Parts that the range of a wanted value is cut into, until one value is left.
BINS = 1024
#: Buckets for pairs of neighbouring signs, and words of a window for repetition.
SIGN_BUCKETS, WINDOW = 24, 64
#: Score from which a document counts as good.
ACCEPT = 0.7

_SIGNS = regex.compile(r"[^\p{L}\p{M}\p{N}\s]+")
_UPPER, _DIGIT, _LETTER = regex.compile(r"\p{Lu}+"), regex.compile(r"\p{N}+"), regex.compile(r"\p{L}+")
NAMES = ("words", "letters", "upper", "digits", "signs", "bare signs", "signed words", "one-letter", "short", "long", "word length", "repeated next", "window variety", "variety loss", "line repeats", "line length", "sentence ends", "no words")
WIDTH = len(NAMES) + SIGN_BUCKETS


def features(text: str | None) -> np.ndarray:
    """Shares and rates of a whole text that don't name its language or topic."""
    out = np.zeros(WIDTH)
    text = text or ""
    words = text.split()
    if not words:
        out[len(NAMES) - 1] = 1
        return out
    n, chars = len(words), sum(map(len, words))
    lengths = np.fromiter(map(len, words), np.int64, n)
    signs = _SIGNS.findall(text)
    upper, digits, letters = (sum(map(len, p.findall(text))) for p in (_UPPER, _DIGIT, _LETTER))
    kinds = np.unique(np.fromiter(map(hash, words), np.int64, n), return_inverse=True)[1]
    windows = [len(np.unique(kinds[s : s + WINDOW])) / min(WINDOW, n - s) for s in range(0, n, WINDOW)]
    variety = float(np.average(windows, weights=np.minimum(WINDOW, n - np.arange(0, n, WINDOW))))
    lines = [s for s in text.split("\n") if s.strip()]
    bare = sum(1 for w in words if not w[0].isalnum() and not any(map(str.isalnum, w)))
    out[: len(NAMES)] = (
        np.log1p(n) / 10,
        letters / chars,
        np.sqrt(upper / max(letters, 1)),
        np.sqrt(digits / chars),
        np.sqrt(sum(map(len, signs)) / chars),
        np.sqrt(bare / n),
        np.sqrt(min(1.0, len(signs) / n)),
        (lengths == 1).mean(),
        ((lengths > 1) & (lengths < 5)).mean(),
        (lengths > 12).mean(),
        min(lengths.mean(), 30) / 30,
        np.sqrt((kinds[1:] == kinds[:-1]).mean()) if n > 1 else 0.0,
        variety,
        np.sqrt(1 - min(variety, 1.0)),
        np.sqrt(1 - len(set(lines)) / max(len(lines), 1)),
        np.log1p(n / max(len(lines), 1)) / 10,
        min(1.0, sum(1 for s in signs if s[-1] in ".!?") / n),
        0,
    )
    for sign, count in Counter(signs).items():
        # runs of signs by their first two characters
        out[len(NAMES) + zlib.crc32(sign[:2].encode("utf-8", "surrogatepass")) % SIGN_BUCKETS] += count / n
    out[len(NAMES) :] = np.sqrt(np.minimum(out[len(NAMES) :], 1))
    return out


def slope_and_curve(gap: np.ndarray, w: np.ndarray) -> np.ndarray:
    """First and second derivatives of the sum of log(1 + exp(-w . gap)), one after the other."""
    p = 1 / (1 + np.exp(np.clip(gap @ w, -60, 60)))
    return np.concatenate([-p @ gap, ((gap * (p * (1 - p))[:, None]).T @ gap).ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray], pairs: int, width: int, decay: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights of the least mean loss plus decay |w|^2 / 2, given slope_and_curve of all pairs."""
    w = np.zeros(width)
    for _ in range(steps):
        both = sums(w) / pairs
        step = np.linalg.solve(both[width:].reshape(width, width) + decay * np.eye(width), both[:width] + decay * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def bradley_terry(better: np.ndarray, worse: np.ndarray, decay: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights w that minimise the mean of log(1 + exp(-w . (better - worse))) + decay |w|^2 / 2, by Newton's method."""
    gap = better - worse
    return newton(lambda w: slope_and_curve(gap, w), *gap.shape, decay, steps)


def weighted_quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    """The value below which `share` of the weight lies, midway between its neighbours."""
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(weights[order])
    k = int(np.searchsorted(upto, share * upto[-1] * (1 - 1e-9), side="left"))
    return float((values[min(k, len(values) - 1)] + values[min(k + 1, len(values) - 1)]) / 2)


def values_at(values: DataFrame, place: int) -> tuple[float, float]:
    """The numbers at `place` (from 0) and after it in the order of the one column `value`,
    exactly: the range is cut into bins, and the bin of that place anew."""
    low, high = values.agg(F.min("value"), F.max("value")).first()
    below = 0
    while low < high:
        inside = values.where(F.col("value").between(low, high))
        bin_ = F.least(F.floor((F.col("value") - F.lit(low)) / F.lit(high - low) * BINS), F.lit(BINS - 1))
        for r in inside.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).orderBy("bin").collect():
            if below + r.n > place:
                low, high = r.low, r.high
                break
            below += r.n
    upto, after = values.agg(F.count_if(F.col("value") <= low), F.min(F.when(F.col("value") > low, F.col("value")))).first()
    return low, low if upto > place + 1 or after is None else after


@dataclass
class Ranking:
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; ACCEPT at the threshold, by the odds of winning against a document there."""
        worth = ((rows - self.middle) / self.spread) @ self.weights - self.threshold
        score = 1 / (1 + np.exp(-np.clip(worth + np.log(ACCEPT / (1 - ACCEPT)), -40, 40)))
        # the threshold itself is no matter of rounding
        return np.where(np.abs(score - ACCEPT) < 1e-12, ACCEPT, score)


def held_out_default(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 4) == 2


def _rows(texts: pd.Series) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(len(texts), WIDTH)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, WIDTH)


def _packed(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of features, or of differences where a batch has those of two documents."""
    return _matrix(batch["x"]) if "x" in batch.schema.names else _matrix(batch["good"]) - _matrix(batch["bad"])


def _blocks(rows: DataFrame) -> DataFrame:
    """The rows of each partition, in their order, as matrices."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"rows": pa.array([_packed(batch).tobytes()], pa.binary())})

    return cut(rows.mapInArrow(pack, "rows binary"))


def _total(blocks: DataFrame, sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """What `sums` gives for all rows of all matrices, added in the order of partitions, so
    that reruns agree to the last bit."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [sums(_matrix(batch["rows"])) for batch in batches if batch.num_rows]
        if found:
            place = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int64()), "sums": pa.array([np.sum(found, axis=0).tobytes()], pa.binary())})

    def fold(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("place")
        return pd.DataFrame({"place": parts["place"][:1], "sums": [np.sum([np.frombuffer(x) for x in parts["sums"]], axis=0).tobytes()]})

    parts = blocks.mapInArrow(part, "place long, sums binary")
    if blocks.rdd.getNumPartitions() > FOLD:
        parts = parts.groupBy((F.col("place") / FOLD).cast("long")).applyInPandas(fold, "place long, sums binary")
    return np.sum([np.frombuffer(r.sums) for r in sorted(parts.collect(), key=lambda r: r.place)], axis=0)


def _placed(measured: DataFrame, tasks: int) -> DataFrame:
    """(label, place, x): each class numbered from 0 in the order of doc_id."""
    rows = measured.repartitionByRange(tasks, "label", "doc_id").sortWithinPartitions("label", "doc_id")
    rows = cut(rows.select("label", "x", F.monotonically_increasing_id().alias("at")))
    task = F.shiftright("at", 33).alias("task")
    first, before = [], Counter()
    for r in rows.groupBy(task, "label").agg(F.min("at").alias("at"), F.count("*").alias("n")).orderBy("task", "label").collect():
        first.append((r.task, r.label, r.at - before[r.label]))
        before[r.label] += r.n
    starts = measured.sparkSession.createDataFrame(first, "task long, label int, start long")
    return rows.withColumn("task", task).join(F.broadcast(starts), ["task", "label"]).select("label", (F.col("at") - F.col("start")).alias("place"), "x")


def _drawn(spark: SparkSession, good: int, bad: int, seed: int) -> DataFrame:
    """(n, good, bad): pairs by places; every document meets OPPONENTS of the other class."""
    size, each = DRAW_BLOCK, OPPONENTS

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch["id"].to_pylist():
                rng = np.random.default_rng([seed, block])
                own = [np.repeat(np.arange(block * size, max(block * size, min((block + 1) * size, n))), each) for n in (good, bad)]
                a = np.concatenate([own[0], rng.choice(good, len(own[1]))])
                b = np.concatenate([rng.choice(bad, len(own[0])), own[1]])
                n = block * size * each * 2 + np.arange(len(a))
                for at in range(0, len(a), size):
                    yield pa.RecordBatch.from_pydict({"n": n[at : at + size], "good": a[at : at + size], "bad": b[at : at + size]})

    blocks = -(-max(good, bad) // size)
    return spark.range(0, blocks, 1, min(blocks, 200)).mapInArrow(draw, "n long, good long, bad long")


def _pairs(placed: DataFrame, counts: dict[int, int], seed: int) -> DataFrame:
    """The features of both documents of every pair, in a fixed order within fixed partitions."""
    pairs = _drawn(placed.sparkSession, counts[1], counts[0], seed)
    tasks = math.ceil(OPPONENTS * (counts[0] + counts[1]) / TASK_ROWS)
    # the larger class first, while a pair is but three numbers
    for label in sorted(counts, key=counts.get, reverse=True):
        name = ("bad", "good")[label]
        side = placed.where(F.col("label") == label).select(F.col("place").alias(name), F.col("x").alias(f"{name}_x"))
        if counts[label] <= BROADCAST_ROWS:
            pairs = pairs.join(F.broadcast(side), name)
        else:
            # without the hint Spark takes the drawn pairs for as small as the numbers of their blocks
            pairs = pairs.repartition(tasks, name).join(side.repartition(tasks, name).hint("merge"), name)
    if max(counts.values()) <= BROADCAST_ROWS:
        pairs = pairs.repartition(tasks, "n")
    return pairs.sortWithinPartitions("n").select(F.col("good_x").alias("good"), F.col("bad_x").alias("bad"))


def learn(labelled: DataFrame, seed: int = 1) -> Ranking:
    """The ranking of (doc_id, text, label), one row for each id."""

    @tidy
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "x": [x.tobytes() for x in _rows(batch["text"])]})

    measured = cut(labelled.mapInPandas(measure, "doc_id long, label int, x binary"))
    counts = {0: 0, 1: 0} | {r["label"]: r["count"] for r in measured.groupBy("label").count().collect()}
    n = sum(counts.values())
    if not (counts[0] and counts[1]):
        return Ranking(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0)
    tasks = math.ceil(n / TASK_ROWS)
    placed = cut(_placed(measured, tasks).repartition(tasks, (F.col("place") / DRAW_BLOCK).cast("long")).sortWithinPartitions("label", "place"))
    rows = _blocks(placed.select("x"))
    middle = _total(rows, lambda x: x.sum(0)) / n
    spread = np.sqrt(_total(rows, lambda x: ((x - middle) ** 2).sum(0)) / n) + 1e-6
    gaps = _blocks(_pairs(placed, counts, seed))
    weights = newton(lambda w: _total(gaps, lambda x: slope_and_curve(x / spread, w)), OPPONENTS * n, WIDTH)

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"value": ((_matrix(batch["rows"]) - middle) / spread) @ weights})

    return Ranking(middle, spread, weights, sum(values_at(cut(rows.mapInArrow(worth, "value double")), counts[0] - 1)) / 2)


def scorer(docs: DataFrame, labels: DataFrame, known: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text"):
    """Learn from all labelled documents where `known` (over doc_id) holds; a function of a
    text column that gives its score."""
    small_batches(docs)
    ranking = learn(labelled_documents(docs, labels, label, known, id_col, text_col))

    @tidy
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        resident("quality", tuple)  # nothing of its own: what a reused worker still holds goes
        for texts in batches:
            yield pd.Series(ranking.scores(_rows(texts)) if len(texts) else np.empty(0))

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score each text's quality: id, held_out, score, predicted.

    Learns from all labels of ids that aren't held out (held_out is an expression over the
    id; by default crc32 of the id modulo 4 is 2); only the text is an input. predicted is 1 from a score of 0.7. A null text
    counts as empty; empty texts are scored by the feature that marks them. Repeated rows
    score alike; without labels of both classes every score is 0.7; an empty table gives no rows.
    """
    held_out = held_out_default(id_col) if held_out is None else held_out
    score = scorer(docs, labels, ~held_out, id_col=id_col, text_col=text_col)
    scored = fresh(docs, id_col, held_out.alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.select(id_col, "held_out", "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
