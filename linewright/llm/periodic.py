"""Runs of repeated words, caught online by blocks of powers of two.

A square is a stretch of words followed by itself. Once a block of b = 2^k words that begins at
a multiple of b is complete, it becomes a catcher: it waits for the windows of b words that end
2b to 4b words further on. If the window that an appended word completes equals the block, the
words between them are a possible period q, and a suffix comparison of that distance is open:
with each further word it goes on while words q apart agree, and it goes back before the block
in the same way. Once q words agree, a square has ended; squares of one distance that overlap
are one run. A stretch that agrees at distance q for q words or more holds a whole block of the
level with 2b <= q < 4b (the smallest level, of 2 words, takes all q below 8), so that no
square is missed; each window meets two blocks of a level.

All texts of a batch are caught side by side, level by level: windows are compared by hashes of
words taken from running sums, comparisons advance by doubling steps over the same sums, and
what is reported is compared word by word. A hash that misled would show there, and the batch
is then caught again with other hashes; equal words always have equal hashes, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import small_batches, tidy

#: Words that are caught side by side; a longer text is caught on its own.
BATCH_WORDS = 1 << 18
#: The prime modulus of the hashes.
PRIME = (1 << 31) - 1
#: The least length of a run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 12, 2
#: What separates words: space, tab, LF, VT, FF, CR. Other white space belongs to words.
BLANK = r"[\x20\x09-\x0D]"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Misled(Exception):
    """Two different stretches of words had one hash."""


class Sums:
    """Running sums of words' hashes, each times the base to the power of its place."""

    def __init__(self, words: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        n = len(words)
        # powers by doubling: those of the first half times the power of its size
        self.power = np.ones(n + 1, np.int64)
        done, base = 1, int(rng.integers(1 << 20, PRIME - 1))
        while done <= n:
            more = min(done, n + 1 - done)
            self.power[done : done + more] = self.power[:more] * pow(base, done, PRIME) % PRIME
            done += more
        values = rng.integers(1, PRIME, int(words.max(initial=0)) + 1)[words]
        self.sums = np.concatenate([[0], np.cumsum(values * self.power[:n] % PRIME)])

    def windows(self, size: int, n: int) -> np.ndarray:
        """Hashes of the windows of `size` words that begin at 0, ..., n - size, as if each began at one place."""
        inside = (self.sums[size : n + 1] - self.sums[: n + 1 - size]) % PRIME
        return inside * self.power[n - size :: -1][: len(inside)] % PRIME

    def same(self, at: np.ndarray, distance: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether `size` words from `at` on equal those `distance` further."""
        far = at + distance
        one = (self.sums[at + size] - self.sums[at]) % PRIME
        other = (self.sums[far + size] - self.sums[far]) % PRIME
        return one * self.power[distance] % PRIME == other


def _longest(fits, most: np.ndarray) -> np.ndarray:
    """The greatest size up to `most` that fits, where smaller ones fit too."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        mid = (low + high + 1) >> 1
        good = fits(mid)
        low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
    return low


def _caught(hashes: np.ndarray, start: np.ndarray, size: int, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the block, distance) wherever a window equals a catcher: the block of `size`
    words that begins at a multiple of `size` in its text, from `near` to below `far` words before."""
    window = np.arange(len(hashes))
    inside = window - start[: len(hashes)]
    blocks, distances = [], []
    for back in range(-(-(far - near) // size)):
        block = (inside - near) // size * size - back * size
        some = np.flatnonzero((block >= 0) & (inside - block < far))
        block = block[some] + start[some]
        hit = hashes[block] == hashes[some]
        blocks.append(block[hit])
        distances.append(some[hit] - block[hit])
    return np.concatenate(blocks), np.concatenate(distances)


def _known(runs: np.ndarray, begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether a run (start, end, period), in order of period and start, holds each stretch with its period."""
    n = int(runs[:, 1].max(initial=0)) + 1 + int(begin.max(initial=0))
    at = np.searchsorted(runs[:, 2] * n + runs[:, 0], period * n + begin, side="right") - 1
    return (at >= 0) & (runs[at, 2] == period) & (runs[at, 0] <= begin) & (end <= runs[at, 1]) if len(runs) else np.zeros(len(begin), bool)


def _divisors(most: int) -> Iterator[int]:
    """Primes up to `most`."""
    sieve = np.ones(most + 1, bool)
    for k in range(2, most + 1):
        if sieve[k]:
            yield k
            sieve[k * k :: k] = False


def _primitive(sums: Sums, runs: np.ndarray, begin: np.ndarray, size: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the period of each stretch is its smallest. A smaller one divides it, is shorter
    than half and so belongs to a run that was found before."""
    least = period.copy()
    for prime in _divisors(int(period.max(initial=1))):
        some = np.flatnonzero(least % prime == 0)
        while len(some):
            shorter = least[some] // prime
            some = some[sums.same(begin[some], shorter, size[some] - shorter)]
            least[some] //= prime
            some = some[least[some] % prime == 0]
    other = least < period
    if not _known(runs, begin[other], begin[other] + size[other], least[other]).all():
        raise Misled
    return ~other


def _runs(words: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int, least_words: int) -> np.ndarray:
    """Runs (start, end, period) of texts that lie one after another, longest texts first."""
    sums = Sums(words, seed)
    runs = np.empty((0, 3), np.int64)
    # shorter runs than five words may lie between blocks of two
    size, near, far = 2 if least_words >= 5 else 1, 1, 8
    while True:
        # the texts that have two periods of this level come first
        n = int(np.searchsorted(-(end - start), -max(2 * near, least_words), side="right"))
        if not n:
            break
        block, q = _caught(sums.windows(size, n), start, size, near, far)
        whole = block + q + size <= end[block]
        block, q = block[whole], q[whole]
        if len(block):
            # neighbouring blocks of one distance are caught by one comparison
            order = np.lexsort((block, q))
            block, q = block[order], q[order]
            new = np.concatenate([[True], (q[1:] != q[:-1]) | (block[1:] != block[:-1] + size) | (start[block[1:]] != start[block[:-1]])])
            first, last = block[new], block[np.append(np.flatnonzero(new)[1:], len(block)) - 1] + size
            q = q[new]
            # the block before, or after, isn't equal as a whole: less than one is left to be compared
            back = _longest(lambda m: sums.same(first - m, q, m), np.minimum(first - start[first], size - 1))  # noqa: B023
            on = _longest(lambda m: sums.same(last, q, m), np.minimum(end[first] - q - last, size - 1))  # noqa: B023
            begin, agree = first - back, last - first + back + on
            long = agree >= np.maximum(q, least_words - q)
            begin, agree, q = begin[long], agree[long], q[long]
            # smaller periods first: those of the smallest level divide each other
            for some in [np.flatnonzero(q == k) for k in range(near, far)] if near == 1 else [np.arange(len(q))]:
                if len(some):
                    keep = some[_primitive(sums, runs, begin[some], agree[some] + q[some], q[some])]
                    runs = np.concatenate([runs, np.stack([begin[keep], begin[keep] + agree[keep] + q[keep], q[keep]], 1)])
                    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
        size, near, far = (4, 8, 16) if near == 1 else (2 * size, 2 * near, 2 * far)
    return runs


def _verify(words: np.ndarray, runs: np.ndarray) -> None:
    """Raise unless words a period apart are equal all through every run."""
    for begin, end, q in runs.tolist():
        if not np.array_equal(words[begin : end - q], words[begin + q : end]):
            raise Misled


def find_runs(texts: list[np.ndarray], least_words: int = LEAST_WORDS) -> list[np.ndarray]:
    """Per text of word numbers: its runs (start, length, period) by start, then period.

    A run is a stretch with smallest period q, of `least_words` and two periods at least, that
    no neighbouring word extends.
    """
    order = np.argsort([-len(t) for t in texts], kind="stable")
    sizes = np.array([len(texts[k]) for k in order], np.int64)
    first = np.cumsum(sizes) - sizes
    words = np.concatenate([texts[k] for k in order]) if len(texts) else np.empty(0, np.int64)
    start, end = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
    seed = 0
    while True:
        try:
            runs = _runs(words, start, end, seed, least_words)
            _verify(words, runs)
            break
        except Misled:
            seed += 1
    owner = np.searchsorted(first, runs[:, 0], side="right") - 1 if len(first) else runs[:, 0]
    # of texts that begin at one place all but the last are empty
    out: list[np.ndarray] = [np.empty((0, 3), np.int64)] * len(texts)
    for k in np.unique(owner):
        own = runs[owner == k]
        own = np.stack([own[:, 0] - first[k], own[:, 1] - own[:, 0], own[:, 2]], 1)
        out[order[k]] = own[np.lexsort((own[:, 2], own[:, 0]))]
    return out


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of each word, where each text's begin and the last's end, the words by number)."""
    lists = pc.ascii_split_whitespace(texts)
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    # blanks at a text's ends leave empty words
    upto = np.concatenate([[0], np.cumsum(full)])
    places = upto[np.concatenate([[0], np.cumsum(sizes)])]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), places, coded.dictionary


def _batch(texts: pa.Array, least_words: int) -> pa.StructArray:
    number, places, known = _words(texts)
    n = np.diff(places)
    runs: list[np.ndarray] = []
    begin = 0
    while begin < len(n):
        stop = max(begin + 1, int(np.searchsorted(places, places[begin] + BATCH_WORDS, side="right")) - 1)
        runs += find_runs([number[places[k] : places[k + 1]] for k in range(begin, stop)], least_words)
        begin = stop
    stay = [kept(m, r) for m, r in zip(n.tolist(), runs, strict=True)]
    left = known.take(pa.array(number[np.concatenate(stay)])) if len(stay) else known
    ends = pa.array(np.concatenate([[0], np.cumsum([int(s.sum()) for s in stay])]).astype(np.int32))
    collapsed = pc.binary_join(pa.ListArray.from_arrays(ends, left.cast(pa.string())), " ")
    every = np.concatenate([np.empty((0, 3), np.int64), *runs])
    spans = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], ["start", "length", "period"])
    places = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32))
    return [pa.array(n), pa.ListArray.from_arrays(places, spans), collapsed]


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id, n_words, runs (start, length, period: words, from 0, by start,
    then period) and collapsed: the words that no run holds after its first period, joined by
    one space.

    Words are what blanks (space, tab, LF, VT, FF, CR) separate. A null text, like one of
    blanks, has no words, no runs and an empty collapsed text. Ids may be null or repeat: each
    row is taken on its own. Other columns are left out; an empty table gives no rows. A text
    is caught in one task, in about 60 bytes of memory a word.
    """
    small_batches(docs)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_batch(batch.column("text"), least_words)], ["doc_id", "n_words", "runs", "collapsed"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("doc_id", id_col)


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which, for every tenth id by checksum, the words from a drawn place on repeat
    with a drawn period, joined by spaces; other texts as they are. A null id counts as no digits."""
    checksum = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(checksum / 10).cast("long")
    words = F.regexp_extract_all(text, F.lit(BLANK.replace("[", "[^") + "+"), F.lit(0))

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # as the variable of a lambda the words are found once, not once a word
    repeated = F.get(F.transform(F.array(words), repeat), 0)
    return F.when((checksum % 10 == 0) & text.rlike(BLANK.replace("[", "[^")), repeated).otherwise(text)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the longest (least start, then period, of equals), and sha256 of all runs
    and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        sha(F.array_join(line, "")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
