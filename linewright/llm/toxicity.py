"""Toxicity by the nearest labelled examples in TF-IDF space, through a block-max index.

Examples and documents are TF-IDF vectors over words and pieces of words, in which a term
weighs the more the better it tells the labels apart; each document's k nearest examples by
exact cosine vote, weighted by closeness. Postings are kept in blocks of examples with each
term's largest weight in the block: the postings of a block whose bound cannot reach the k-th
best so far are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linewright.llm.common import crc_mod, cut, fresh, small_batches, tidy
from linewright.llm.labelled import labelled_sample
from linewright.llm.set_join import shingles

#: Labelled examples of each class, at most; terms kept, at most, by their association with
#: the label (log-likelihood ratio r); a term's weight is scaled by r / (r + HALF_RATIO).
EXAMPLES, TERMS, HALF_RATIO = 3000, 20_000, 24.0
NEIGHBOURS, BLOCK, PIECE = 32, 64, 5
#: Terms that more than this share of the examples hold have dense postings. Texts scored at
#: once, blocks read before bounds are compared, and what single precision may be off by.
HEAVY, BATCH, FIRST_BLOCKS, SLACK = 1 / 32, 250, 8, np.float32(1e-5)
#: Words whose terms a worker remembers; emptied when full, which changes no result.
MEMO_WORDS = 200_000
ACCEPT = 0.7

_WORD = regex.compile(r"[\p{L}\p{M}]+")
# the same for texts of the first 256 characters, several times faster
_LATIN_WORD = re.compile("[" + "".join(c for c in map(chr, range(256)) if unicodedata.category(c)[0] in "LM") + "]+")


def words_of(text: str | None) -> list[str]:
    """The text's runs of letters and marks, lower-cased."""
    low = (text or "").lower()
    try:
        low.encode("latin-1")
    except UnicodeEncodeError:
        return _WORD.findall(low)
    return _LATIN_WORD.findall(low)


def terms_of(word: str) -> list[str]:
    """The word, and its runs of PIECE characters with its ends marked."""
    marked = f"^{word}$"
    return [word, *(f"~{marked[k : k + PIECE]}" for k in range(len(marked) - PIECE + 1))]


def term_counts(text: str | None) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(words_of(text)).items():
        for term in terms_of(word):
            out[term] += n
    return out


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges [first, first + size), one after the other."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Index:
    """The examples' postings by term and block, those of terms that many examples hold as dense
    rows. scale: what a term's counts are weighed by."""

    def __init__(self, vocabulary: list[str], scale: np.ndarray, examples: list[dict[int, int]], ids: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        self.place = {t: k for k, t in enumerate(vocabulary)}
        self.pieces = {t[1:]: k for k, t in enumerate(vocabulary) if t.startswith("~")}
        self.scale, self.ids, self.labels, self.weights = scale, ids, labels, weights
        self.curve = (0.0, 1.0, 0.0)
        n = len(examples)
        self.blocks = -(-n // BLOCK)
        self.vectors = [self.vector(np.fromiter(e, np.int64, len(e)), np.fromiter(e.values(), float, len(e))) for e in examples]
        sizes = [len(v[0]) for v in self.vectors]
        # by example, for the exact cosines of what is found
        self.own_first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.own_term = np.concatenate([v[0] for v in self.vectors] or [np.empty(0, np.int64)]).astype(np.int32)
        self.own_weight = np.concatenate([v[1] for v in self.vectors] or [np.empty(0)])
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        heavy = np.flatnonzero(np.bincount(self.own_term, minlength=len(vocabulary)) > max(HEAVY * n, 1))
        self.row = np.full(len(vocabulary), -1, np.int32)
        self.row[heavy] = np.arange(len(heavy))
        dense = self.row[self.own_term] >= 0
        self.dense = np.zeros((self.blocks, len(heavy), BLOCK), np.float32)
        self.dense[owner[dense] // BLOCK, self.row[self.own_term[dense]], owner[dense] % BLOCK] = self.own_weight[dense]
        self.dense_highest = np.ascontiguousarray(self.dense.max(2, initial=0).T)
        term, owner, weight = self.own_term[~dense], owner[~dense], self.own_weight[~dense]
        order = np.lexsort((owner, term))
        term, self.owner, self.weight = term[order].astype(np.int64), owner[order], weight[order].astype(np.float32)
        # an entry for each other term and block: its postings' range and their largest weight
        key = term * max(self.blocks, 1) + self.owner // BLOCK
        self.begin = np.flatnonzero(np.diff(key, prepend=-1))
        self.size = np.diff(self.begin, append=len(key))
        self.block = (self.owner[self.begin] // BLOCK).astype(np.int32)
        self.highest = np.maximum.reduceat(self.weight, self.begin) if len(key) else self.weight
        self.first = np.searchsorted(term[self.begin], np.arange(len(vocabulary) + 1))
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.word_size: list[int] = []
        self.word_terms: list[int] = []

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("memo", "word_size", "word_terms", "vectors")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of length 1."""
        raw = (1 + np.log(counts)) * self.scale[terms]
        norm = np.sqrt((raw * raw).sum())
        return terms, raw / norm if norm else raw

    def vectors_of(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The texts' vectors."""
        if len(self.memo) > MEMO_WORDS:
            self.forget()
        words, sizes, piece = [], [], self.pieces.get
        for text in texts:
            found = words_of(text)
            for word in set(found).difference(self.memo):
                # as terms_of has them
                marked = f"^{word}$"
                known = [at for k in range(len(marked) - PIECE + 1) if (at := piece(marked[k : k + PIECE])) is not None]
                if word in self.place:
                    known.append(self.place[word])
                self.memo[word] = len(self.memo)
                self.word_terms += known
                self.word_size.append(len(known))
            words.append(np.fromiter(map(self.memo.__getitem__, found), np.int64, len(found)))
            sizes.append(len(found))
        wide = max(len(self.memo), 1)
        pairs, often = np.unique(np.repeat(np.arange(len(texts)), sizes) * wide + np.concatenate(words or [np.empty(0, np.int64)]), return_counts=True)
        doc, word = pairs // wide, pairs % wide
        size = np.array(self.word_size, np.int64)
        first = np.cumsum(size) - size
        terms = np.array(self.word_terms, np.int64)[_ranges(first[word], size[word])]
        keys, at = np.unique(np.repeat(doc, size[word]) * len(self.place) + terms, return_inverse=True)
        counts = np.bincount(at, weights=np.repeat(often, size[word]), minlength=len(keys))
        ends = np.searchsorted(keys, np.arange(len(texts) + 1) * len(self.place))
        return [self.vector(keys[a:b] - k * len(self.place), counts[a:b]) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], but: list[np.ndarray] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector (examples, cosines), best first and ties by place: the NEIGHBOURS
        nearest with a cosine above 0, without those of `but`.

        The blocks of the highest bounds are read first, then those that can still hold one of
        the nearest. Sums in single precision pick candidates; their cosines are of double.
        """
        n, docs = len(self.ids), len(vectors)
        if not n or not docs:
            return [(np.empty(0, np.int64), np.empty(0))] * docs
        doc = np.repeat(np.arange(docs), [len(v[0]) for v in vectors])
        term, value = (np.concatenate([v[k] for v in vectors]) for k in (0, 1))
        dense = self.row[term] >= 0
        asked = np.zeros((docs, self.dense.shape[1]), np.float32)
        asked[doc[dense], self.row[term[dense]]] = value[dense]
        doc, term, value = doc[~dense], term[~dense], value[~dense].astype(np.float32)
        spans = self.first[term + 1] - self.first[term]
        entry, doc, value = _ranges(self.first[term], spans), np.repeat(doc, spans), np.repeat(value, spans)
        block = self.block[entry]
        bounds = asked @ self.dense_highest + np.bincount(doc * self.blocks + block, weights=self.highest[entry] * value, minlength=docs * self.blocks).reshape(docs, -1)
        sums = np.zeros((docs, self.blocks * BLOCK), np.float32)

        def read(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)):
                some = np.flatnonzero(wanted[:, b])
                sums[some, b * BLOCK : (b + 1) * BLOCK] += asked[some] @ self.dense[b]
            some = np.flatnonzero(wanted[doc, block])
            size = self.size[entry[some]]
            posting = _ranges(self.begin[entry[some]], size)
            place = np.repeat(doc[some], size) * sums.shape[1] + self.owner[posting]
            sums.ravel()[:] += np.bincount(place, weights=self.weight[posting] * np.repeat(value[some], size), minlength=sums.size).astype(np.float32)
            for k, gone in enumerate(but or ()):
                sums[k, gone] = 0

        least = lambda: np.partition(sums, sums.shape[1] - NEIGHBOURS, axis=1)[:, sums.shape[1] - NEIGHBOURS, None] if sums.shape[1] > NEIGHBOURS else np.zeros((docs, 1), np.float32)
        head = min(FIRST_BLOCKS, self.blocks)
        wanted = (bounds >= np.partition(bounds, self.blocks - head, axis=1)[:, self.blocks - head, None]) & (bounds > 0)
        read(wanted)
        read(~wanted & (bounds > 0) & (bounds >= least() - SLACK))
        out, query = [], np.zeros(len(self.place))
        close = (sums > 0) & (sums >= least() - SLACK)
        for k, (terms, values) in enumerate(vectors):
            found = np.flatnonzero(close[k])
            size = self.own_first[found + 1] - self.own_first[found]
            query[terms] = values
            at = _ranges(self.own_first[found], size)
            cosines = np.add.reduceat(self.own_weight[at] * query[self.own_term[at]], np.cumsum(size) - size) if len(found) else np.empty(0)
            query[terms] = 0
            best = np.lexsort((found, -cosines))[:NEIGHBOURS]
            best = best[cosines[best] > 1e-9]
            out.append((found[best], np.minimum(cosines[best], 1.0)))
        return out

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Share of votes for label 1; an example weighs by closeness and by its class's sampling."""
        if not len(found):
            return 0.0
        weight = self.weights[found] * cosines / (1.05 - cosines)
        return float((weight * self.labels[found]).sum() / weight.sum())

    def calibrate(self, votes: np.ndarray, some: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """A logistic curve through the votes on examples left out one at a time, and the share
        of label 1 among those without a neighbour."""
        lone = ~some
        base = ((weights * labels)[lone].sum() + 0.5 * weights.mean()) / (weights[lone].sum() + weights.mean())
        x, y, w = _odds(votes[some]), labels[some], weights[some]
        a, b = 0.0, 1.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
            g = np.array([(w * (p - y)).sum() + 1e-3 * a, (w * (p - y) * x).sum() + 1e-3 * (b - 1)])
            h = w * p * (1 - p)
            step = np.linalg.solve(np.array([[h.sum(), (h * x).sum()], [(h * x).sum(), (h * x * x).sum()]]) + 1e-3 * np.eye(2), g)
            a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        self.curve = (float(a), float(max(b, 1e-3)), float(base))

    def scores(self, texts: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(score, nearest examples, cosines) of each text."""
        a, b, base = self.curve
        out = []
        for start in range(0, len(texts), BATCH):
            for found, cosines in self.nearest(self.vectors_of(texts[start : start + BATCH])):
                score = 1 / (1 + np.exp(-np.clip(a + b * _odds(self.vote(found, cosines)), -40, 40))) if len(found) else base
                out.append((float(score), found, cosines))
        return out


def _odds(share):
    share = np.clip(share, 0.01, 0.99)
    return np.log(share / (1 - share))


def build_index(docs: DataFrame, labels: DataFrame, known: Column, label: str = "toxic", examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Weigh terms and index at most `examples` labelled documents of each class.

    Copies would vouch for the chance words they share: in the terms' association, examples of
    one label with the same least shingle, as copies and near copies mostly have, count as one
    together. All of them are indexed.
    """
    small_batches(docs)
    sample, totals = labelled_sample(docs, labels, label, known, examples, 6, id_col, text_col)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(mark=[int(t.min() >> np.uint64(1)) if len(t) else None for t in map(shingles, batch["text"])]).astype({"mark": "Int64"})

    alike = Window.partitionBy("label", "mark")
    share = F.when(F.col("mark").isNull(), 1.0).otherwise(1.0 / F.count("*").over(alike))
    sample = cut(sample.mapInPandas(mark, "doc_id long, text string, label int, mark long").withColumn("share", share))
    sums = {r.label: r for r in sample.groupBy("label").agg(F.count("*").alias("n"), F.sum("share").alias("share")).collect()}

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = [(t, y, s) for text, y, s in zip(batch["text"], batch["label"], batch["share"], strict=True) for t in term_counts(text)]
            yield pd.DataFrame(seen, columns=["term", "label", "share"])

    n1, n0 = (max(sums[y].share, 1.0) if y in sums else 1.0 for y in (1, 0))
    of = lambda y: F.sum(F.when(F.col("label") == y, F.col("share")).otherwise(0.0))
    frequency = sample.mapInPandas(spread, "term string, label int, share double").groupBy("term").agg(F.least(of(1), F.lit(n1)).alias("a"), F.least(of(0), F.lit(n0)).alias("b"))
    total = n1 + n0
    seen = F.col("a") + F.col("b")
    part = lambda got, want: F.when(got > 0, got * F.log(got / want)).otherwise(0.0)
    ratio = 2 * (part(F.col("a"), seen * n1 / total) + part(F.col("b"), seen * n0 / total) + part(n1 - F.col("a"), (total - seen) * n1 / total) + part(n0 - F.col("b"), (total - seen) * n0 / total))
    # rounded, so that the order of the sums doesn't matter
    chosen = frequency.withColumn("ratio", F.round(F.greatest(ratio, F.lit(0.0)), 6)).orderBy(F.desc("ratio"), "term").limit(TERMS).collect()
    vocabulary = [r.term for r in chosen]
    scale = np.array([np.log((total + 1) / (r.a + r.b + 0.5)) * max(r.ratio, 1e-6) / (r.ratio + HALF_RATIO) for r in chosen])
    place = {t: k for k, t in enumerate(vocabulary)}

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [{place[t]: n for t, n in term_counts(x).items() if t in place} for x in batch["text"]]
            yield batch[["doc_id", "label", "mark"]].assign(terms=[np.array(list(m), np.int32) for m in made], counts=[np.array(list(m.values()), np.int32) for m in made]).astype({"mark": "Int64"})

    # examples of one label and heaviest term are neighbours, so that few blocks hold what is alike
    lead = F.coalesce(F.array_min("terms"), F.lit(-1))
    rows = sample.mapInPandas(select, "doc_id long, label int, mark long, terms array<int>, counts array<int>").orderBy("label", lead, "doc_id", "terms", "counts").collect()
    targets = np.array([r.label for r in rows], float)
    share = {y: totals.get(y, 0) / max(sums[y].n, 1) if y in sums else 0.0 for y in (0, 1)}
    weights = np.where(targets == 1, share[1], share[0])
    index = Index(vocabulary, scale, [dict(zip(r.terms, r.counts, strict=True)) for r in rows], np.array([r.doc_id for r in rows], np.int64), targets, weights)
    if len(rows):
        same: dict[int | None, list[int]] = {}
        for k, r in enumerate(rows):
            same.setdefault(r.mark, []).append(k)
        # an example is judged without itself and its copies
        gone = [np.array(same[r.mark] if r.mark is not None else [k]) for k, r in enumerate(rows)]
        found = [f for k in range(0, len(rows), BATCH) for f in index.nearest(index.vectors[k : k + BATCH], gone[k : k + BATCH])]
        index.calibrate(np.array([index.vote(*f) for f in found]), np.array([len(f[0]) > 0 for f in found]), targets, weights)
    return index


def held_out_default(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 3) == 1


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score each text's toxicity: id, held_out, score, predicted, evidence.

    Learns from the labels of ids that aren't held out (held_out is an expression over the
    id; by default crc32 of the id modulo 3 is 1); only the text is an input. predicted is 1
    from a score of 0.7. evidence lists
    the three nearest examples (doc_id, cosine, label). A null text counts as empty; a text
    without an index term has no evidence and the rate of label 1 among such examples as its
    score. Repeated rows score alike; without labels every score is 0; an empty table gives
    no rows.
    """
    held_out = held_out_default(id_col) if held_out is None else held_out
    index = build_index(docs, labels, ~held_out, examples=examples, id_col=id_col, text_col=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by examples and TERMS

    @tidy
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            made = index.scores(list(batch["text"]))
            evidence = [[{"doc_id": int(index.ids[f]), "cosine": float(c), "label": int(index.labels[f])} for f, c in zip(m[1][:3], m[2][:3], strict=True)] for m in made]
            yield pd.DataFrame({"id": batch["id"], "held_out": batch["held_out"], "score": [m[0] for m in made], "evidence": evidence})

    rows = fresh(docs, F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    scored = rows.mapInPandas(score, "id long, held_out boolean, score double, evidence array<struct<doc_id:long,cosine:double,label:int>>")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"), "evidence")
