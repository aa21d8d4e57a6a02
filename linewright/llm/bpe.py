"""Byte-pair encoding and decoding of texts, frequent words by a transducer.

Every word of the corpus is counted; the most frequent are merged once, and compiled with their
ids into a minimal acyclic transducer (`lexicon`). Its file is broadcast (its words are
bounded), and workers map it into memory. Encoding looks the distinct words of a batch up there, and merges the others
by rank. So the lexicon's size changes how fast texts are encoded, but no id.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import resident, small_batches, tidy
from linewright.llm.lexicon import Lexicon, compiled, ranges

#: Words that the lexicon takes, the most frequent first, and the bytes of its longest.
LEXICON_WORDS, LEXICON_BYTES = 1 << 16, 48
#: Characters that are encoded at once.
SLICE_CHARS = 1 << 20
#: Merged words that a worker remembers; forgotten when full, which changes no result.
REMEMBERED = 1 << 17
#: Words of more bytes are merged with a heap, the others many at a time.
SHORT, LANES = 48, 1 << 13
#: Stands for a pair that isn't merged.
NO_RANK = 1 << 60


def printable_bytes() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level vocabulary file: its words' pattern, merges, tokens and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        if spec.get("normalizer") or before["type"] != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("ignore_merges") or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("only plain byte-level vocabularies with the library's own word pattern are read")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special strings that take in what is beside them are not read")
        byte_of, vocabulary = printable_bytes(), model["vocab"]
        # fixed value: the word pattern that belongs to this kind of vocabulary file
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+".replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.apart = regex.compile(r"(?<=\P{White_Space})\p{White_Space}")
        self.of_byte = [0] * 256
        for shown, byte in byte_of.items():
            self.of_byte[byte] = vocabulary[shown]
        # ranks by pair of ids, and what each rank's pair becomes
        self.merges: dict[int, int] = {}
        made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocabulary[left] << 32 | vocabulary[right], rank)
            made.append(vocabulary[left + right])
        self.made = np.array(made, np.int64)
        self.pairs = np.array(sorted(self.merges), np.int64)
        self.rank = np.array([self.merges[p] for p in self.pairs.tolist()], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        found = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, found)) + ")") if found else None
        self.bytes_of = {number: bytes(byte_of[c] for c in token) for token, number in vocabulary.items()} | {n: s.encode("utf-8") for s, n in self.special.items()}
        self.remembered: dict[str, list[int]] = {}

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words: the pair of the lowest rank is merged first, the leftmost of equals."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        few = order[: np.searchsorted(sizes[order], SHORT, side="right")]
        for begin in range(0, len(few), LANES):
            lanes = few[begin : begin + LANES].tolist()
            for k, ids in zip(lanes, self._merged_short([words[k] for k in lanes]), strict=True):
                out[k] = ids
        for k in order[len(few) :].tolist():
            out[k] = self._merged_long([self.of_byte[b] for b in words[k]])
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; -1 beside an id stands for no neighbour."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], NO_RANK)

    def _merged_short(self, words: list[bytes]) -> list[list[int]]:
        """Words of similar length in lockstep: each merges its best pair in every round."""
        size = np.array([len(w) for w in words])
        wide = int(size.max(initial=0)) + 1
        ids = np.full((len(words), wide), -1, np.int64)
        column = np.arange(wide)
        ids[column < size[:, None]] = np.array(self.of_byte, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        ranks[ids[:, 1:] < 0] = NO_RANK
        going = np.arange(len(words))
        while len(going):
            own = ranks[going]
            at = own.argmin(1)
            best = own[np.arange(len(going)), at]
            some = best < NO_RANK
            going, at, best = going[some], at[some], best[some]
            # what follows the merged pair moves up by one
            later = column[:-1] > at[:, None]
            row = ids[going]
            row[:, :-1] = np.where(later, row[:, 1:], row[:, :-1])
            row[:, -1] = -1
            row[np.arange(len(going)), at] = self.made[best]
            own = own[some]
            own[:, :-1] = np.where(later[:, :-1], own[:, 1:], own[:, :-1])
            own[:, -1] = NO_RANK
            for place in (at - 1, at):
                inside = np.flatnonzero(place >= 0)
                k = place[inside]
                right = row[inside, k + 1]
                own[inside, k] = np.where(right < 0, NO_RANK, self._ranks(row[inside, k], right))
            ids[going], ranks[going] = row, own
        n = (ids >= 0).sum(1)
        flat, ends = ids[ids >= 0].tolist(), np.cumsum(n).tolist()
        return [flat[e - m : e] for e, m in zip(ends, n.tolist(), strict=True)]

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs and links between neighbours: n log n steps."""
        merges, end = self.merges, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < end and (found := merges.get(ids[k] << 32 | ids[after[k]])) is not None:
                heapq.heappush(heap, (found, k, ids[k], ids[after[k]]))

        for k in range(end - 1):
            offer(k)
        while heap:
            rank, k, left, right = heapq.heappop(heap)
            follower = after[k]
            # the pair may be gone: merged ids are -1
            if ids[k] != left or follower >= end or ids[follower] != right:
                continue
            ids[k], ids[follower] = int(self.made[rank]), -1
            after[k] = after[follower]
            if after[k] < end:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [i for i in ids if i >= 0]

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, some at a time, special strings as words of their own. A long
        text is cut before white space that follows something else: every match ends there."""
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > SLICE_CHARS:
                cut = self.apart.search(text, at + SLICE_CHARS)
                stop = cut.start() if cut else stop
            piece = text[at:stop]
            if self.specials is not None and self.specials.search(piece):
                out = []
                for k, part in enumerate(self.specials.split(piece)):
                    out += [part] if k % 2 else self.word.findall(part)
                yield out
            else:
                yield self.word.findall(piece)
            at = stop


class Encoder(Vocabulary):
    """Encodes with or without a compiled lexicon."""

    def __init__(self, path: str, lexicon: bytes | None = None):
        super().__init__(path)
        self.lexicon = Lexicon(lexicon) if lexicon else None

    def _unseen(self, words: list[str]) -> list[list[int]]:
        """Ids of distinct words that the lexicon lacks."""
        if len(self.remembered) > REMEMBERED:
            self.remembered.clear()
        new = [w for w in words if w not in self.remembered and w not in self.special]
        made = dict(zip(new, self.merge([w.encode("utf-8") for w in new]), strict=True))
        self.remembered.update((w, ids) for w, ids in made.items() if len(w) <= SHORT)
        return [[self.special[w]] if w in self.special else made[w] if w in made else self.remembered[w] for w in words]

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has)."""
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        known, place = coded.dictionary, coded.indices.to_numpy()
        ends = np.frombuffer(known.buffers()[1], np.int64)[: len(known) + 1]
        raw = np.frombuffer(known.buffers()[2] or b"", np.uint8)
        size = np.diff(ends)
        counts, ids, there = np.zeros(len(known), np.int64), np.empty(0, np.int64), np.zeros(len(known), bool)
        if self.lexicon is not None:
            few = np.flatnonzero(size <= LEXICON_BYTES)
            found, n, ids = self.lexicon.find(raw, ends[few], size[few])
            there[few], counts[few] = found, n
        others = np.flatnonzero(~there)
        made = self._unseen(known.take(pa.array(others)).to_pylist())
        starts = np.zeros(len(known), np.int64)
        seen = np.flatnonzero(there)
        starts[seen] = np.cumsum(counts[seen]) - counts[seen]
        lengths = np.array([len(m) for m in made], np.int64)
        counts[others], starts[others] = lengths, len(ids) + np.cumsum(lengths) - lengths
        every = np.concatenate([ids, np.fromiter((i for m in made for i in m), np.int64, int(lengths.sum()))])
        n = counts[place]
        return every[ranges(starts[place], n)].astype(np.int32), n

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has); short texts are encoded together."""
        ids, held, owners = [], [], []
        total = np.zeros(len(texts), np.int64)

        def flush() -> None:
            if held:
                made, n = self.of_words([w for part in held for w in part])
                ids.append(made)
                owner = np.repeat(np.array(owners), [len(p) for p in held])
                np.add.at(total, owner, n)
                held.clear()
                owners.clear()

        words = 0
        for k, text in enumerate(texts):
            for part in self.words(text):
                held.append(part)
                owners.append(k)
                words += len(part)
                if words > SLICE_CHARS // 4:
                    flush()
                    words = 0
        flush()
        return (np.concatenate(ids) if ids else np.empty(0, np.int32)), total


def frequent_words(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS, text_col: str = "text") -> DataFrame:
    """(word, n, ids): the `most` words that occur most often in all texts, ties by the word;
    those that occur once, are special strings or have more than LEXICON_BYTES bytes are left out."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = resident(("bpe", tokenizer, None), lambda: Encoder(tokenizer))
        for batch in batches:
            held: list[str] = []
            for k in range(len(batch)):
                for part in own.words(batch.column(0)[k].as_py()):
                    held += part
                    if len(held) > SLICE_CHARS // 4:
                        yield _counted(held)
                        held = []
            yield _counted(held)

    def _counted(words: list[str]) -> pa.RecordBatch:
        found = pa.array(words, pa.string()).value_counts()
        return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "n"])

    @tidy
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = resident(("bpe", tokenizer, None), lambda: Encoder(tokenizer))
        for batch in batches:
            ids = pa.array(own.merge([w.encode("utf-8") for w in batch.column("word").to_pylist()]), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), ids], ["word", "n", "ids"])

    special = list(Vocabulary(tokenizer).special)
    counted = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL").mapInArrow(count, "word string, n long")
    sums = counted.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") > 1) & (F.octet_length("word") <= LEXICON_BYTES) & ~F.col("word").isin(special))
    return sums.orderBy(F.desc("n"), "word").limit(most).mapInArrow(merge, "word string, n long, ids array<int>")


def compile_lexicon(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS, text_col: str = "text") -> Broadcast[tuple[str, bytes]]:
    """Compile the texts' frequent words, and broadcast the file and its digest. The driver
    holds `most` words of at most LEXICON_BYTES bytes."""
    small_batches(docs)
    words = sorted((r.word.encode("utf-8"), tuple(r.ids)) for r in frequent_words(docs, tokenizer, most, text_col).collect())
    file = compiled(words)
    return docs.sparkSession.sparkContext.broadcast((hashlib.blake2b(file).hexdigest(), file))


def encode(docs: DataFrame, tokenizer: str, lexicon: Broadcast[tuple[str, bytes]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: the id and ids, an array of token ids, as the tokenizer file's library
    gives them without added tokens. A special string inside a text is one token.

    lexicon: from compile_lexicon, of these texts or others; without one every word is merged. A null text is an
    empty one, of no ids; ids of documents may be null or repeat; other columns are left out.
    """
    small_batches(docs)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = lexicon.value if lexicon else (None, None)
        own = resident(("bpe", tokenizer, name), lambda: Encoder(tokenizer, file))
        for batch in batches:
            ids, n = own.texts(batch.column("text").to_pylist())
            places = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(places, pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, ids array<int>").withColumnRenamed("doc_id", id_col)


def decode(tokens: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """Adds text: the ids' bytes one after another, special strings included. Bytes that are no
    UTF-8 become U+FFFD; ids that the vocabulary lacks, and null ones, give nothing; a null
    array gives a null text."""

    def make() -> tuple[np.ndarray, np.ndarray]:
        bytes_of = Vocabulary(tokenizer).bytes_of
        rows = [bytes_of.get(k, b"") for k in range(max(bytes_of) + 1)]
        return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)

    def of_batch(ids: pa.Array) -> pa.Array:
        raw, places = resident(("bpe bytes", tokenizer), make)
        flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = (flat >= 0) & (flat < len(places) - 1)
        flat = np.where(known, flat, 0)
        size = np.where(known, places[flat + 1] - places[flat], 0)
        ends = np.concatenate([[0], np.cumsum(size)])
        body = raw[ranges(places[flat], size)].tobytes()
        edges = ends[np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])]
        texts = [body[a:b].decode("utf-8", "replace") for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return pa.array(texts, pa.string(), mask=ids.is_null().to_numpy(zero_copy_only=False))

    small_batches(tokens)
    return tokens.withColumn("text", F.arrow_udf(of_batch, "string")(F.col(ids_col)))


def digests(tokens: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """Encoded texts as numbers of tokens and sha256 of the ids and of what they decode to."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    shown = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decode(tokens, tokenizer).select(id_col, F.size("ids").cast("long").alias("n_tokens"), sha(shown).alias("ids_sha256"), sha(F.col("text")).alias("decoded_sha256"))
