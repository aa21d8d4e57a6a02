"""Near duplicates on word shingles: a chosen-path similarity join.

Each distinct set of shingles is embedded as a row of minhashes. A run of the join is a tree
over those coordinates: a node picks a few coordinates by a hash of its path, and each of
them leads a set to the child named by its value there, so that similar sets stay together
and others part. A node's bucket is compared by brute force once it is small, and split
further as long as that makes it smaller. Runs repeat until the target recall. Every pair
that shares buckets is compared in one of them only, so that links are counted, not listed.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import cut, fresh, release, resident, small_batches, tidy
from linewright.llm.components import forest, named_components

WORDS, SIMILARITY = 5, 0.8
#: Minhash coordinates of a set, and those that a node of the tree picks by its depth.
COORDINATES, PICKS, DEPTH = 64, 2, 3
#: A larger bucket is split by further coordinates; one that splitting leaves as large is
#: compared in blocks of this many sets, each pair of blocks in a task of its own.
BUCKET = 512
#: A table of at most this many compared documents is broadcast to pick their texts out.
BROADCAST_ROWS = 100_000
#: Rows of small buckets that one task call compares.
GROUP_ROWS = 2_000
#: Words whose hashes a worker remembers; emptied when full, which changes no result.
MEMO_WORDS = 50_000

_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_U64 = np.uint64


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        raw = word.encode("utf-8", "surrogatepass")
        value = (zlib.crc32(raw) << 32 | zlib.adler32(raw)) * 0x9E3779B97F4A7C15 + zlib.crc32(raw, 0x5BD1E995) & 0xFFFFFFFFFFFFFFFF
        self[word] = value
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U64(31))
    x = x * _U64(0x7FB5D329728EA185)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of `words` words, lower-cased; a text
    of fewer words is one run of all its words, one of no word has none."""
    found = _WORD.findall((text or "").lower())
    if not found:
        return np.empty(0, _U64)
    known = resident("set_join", _WordHashes)
    hashes = np.fromiter(map(known.__getitem__, found), _U64, len(found))
    size = min(words, len(hashes))
    out = np.full(len(hashes) - size + 1, len(found) if size < words else 0, _U64)
    for k in range(size):
        out = _mixed(out + hashes[k : len(hashes) - size + 1 + k])
    return np.unique(out)


_FACTORS = ((_mixed(np.arange(1, 2 * COORDINATES + 1, dtype=_U64)) >> _U64(32)).astype(np.uint32) | np.uint32(1)).reshape(2, COORDINATES, 1)


def minhashes(tokens: np.ndarray) -> np.ndarray:
    """For each coordinate the least of the tokens' hashes by that coordinate's function."""
    out = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    high = (tokens >> _U64(32)).astype(np.uint32)
    for start in range(0, len(high), 2048):
        hashes = high[start : start + 2048] * _FACTORS[0]
        hashes ^= hashes >> np.uint32(15)
        hashes *= _FACTORS[1]
        hashes ^= hashes >> np.uint32(13)
        np.minimum(out, hashes.min(1), out=out)
    return out


def survival(similarity: float = SIMILARITY, depth: int = DEPTH, picks: int = PICKS) -> float:
    """Chance that a run's tree keeps a pair of the least similarity together to its leaves."""
    together = 1.0
    for _ in range(depth):
        together = 1 - (1 - similarity * together) ** picks
    return together


def runs_for(recall: float, similarity: float = SIMILARITY) -> int:
    """Runs after which all but 1 - recall of the pairs have met."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity))))


def paths(sketch: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """Keys (sets, leaves) of the nodes that the sets reach `depth` levels below `start`.

    sketch: (sets, coordinates). start: (sets,) keys of the nodes at which they are."""
    keys = start[:, None]
    for level in range(depth):
        children = []
        for pick in range(PICKS):
            # the node's own coordinate: a hash of its path, the same for every set in it
            chosen = (_mixed(keys + _U64(0x51ED27 * (pick + 1) + level)) % _U64(COORDINATES)).astype(np.int64)
            value = np.take_along_axis(sketch, chosen, 1).astype(_U64)
            children.append(_mixed(_mixed(keys + _U64(pick + 1)) ^ value))
        keys = np.concatenate(children, 1)
    return keys


def _first_keys(sketch: np.ndarray, runs: int) -> np.ndarray:
    roots = _mixed(np.arange(1, runs + 1, dtype=_U64))
    out = [paths(sketch, np.full(len(sketch), roots[run]), DEPTH) for run in range(runs)]
    return np.concatenate(out, 1).astype(np.int64)


def _name(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, name, n, sketch): a 128-bit name of the shingle set (null if empty), its size, its minhashes."""

    @tidy
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, n, rows = [], [], []
            for text in batch.column("text"):
                tokens = shingles(text.as_py())
                n.append(len(tokens))
                names.append(_name(tokens) if len(tokens) else None)
                rows.append(minhashes(tokens).tobytes() if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(names, pa.binary()), pa.array(n, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "text_key", "name", "n", "sketch"])

    return docs.mapInArrow(sketch, "doc_id long, text_key long, name binary, n long, sketch binary")


def _buckets(classes: DataFrame, runs: int, split_rounds: int) -> DataFrame:
    """(key, node) for every bucket of two sets or more, after splitting the large ones."""

    @tidy
    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch["sketch"]), np.uint32).reshape(len(batch), COORDINATES)
            keys = _first_keys(sketch, runs)
            yield pd.DataFrame({"key": keys.ravel(), "node": np.repeat(batch["node"].to_numpy(), keys.shape[1])})

    @tidy
    def further(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch["sketch"]), np.uint32).reshape(len(batch), COORDINATES)
            keys = paths(sketch, batch["key"].to_numpy().astype(_U64), 1).astype(np.int64)
            wide = keys.shape[1]
            yield pd.DataFrame({"key": keys.ravel(), "node": np.repeat(batch["node"].to_numpy(), wide), "was": np.repeat(batch["key"].to_numpy(), wide), "size": np.repeat(batch["size"].to_numpy(), wide)})

    rows = cut(classes.select("node", "sketch").mapInPandas(first, "key long, node long"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    rows = cut(rows.join(sizes, "key"))
    done = rows.where(F.col("size") <= BUCKET)
    large = rows.where(F.col("size") > BUCKET)
    for _ in range(split_rounds):
        if large.isEmpty():
            break
        split = large.join(classes.select("node", "sketch"), "node").select("key", "node", "size", "sketch")
        split = cut(split.mapInPandas(further, "key long, node long, was long, size long"))
        counts = split.groupBy("was", "key").agg(F.count("*").alias("now"), F.first("size").alias("size"))
        # splitting pays if no child holds nearly all of its node; else the node is dense and compared as it is
        verdict = counts.groupBy("was").agg((F.max("now") > 0.7 * F.first("size")).alias("dense"))
        verdict = cut(verdict)
        done = done.unionByName(large.join(verdict.where("dense").select(F.col("was").alias("key")), "key", "left_semi"))
        children = split.join(verdict.where("not dense").select("was"), "was", "left_semi").select("key", "node").distinct()
        sizes = children.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
        children = cut(children.join(sizes, "key"))
        done = done.unionByName(children.where(F.col("size") <= BUCKET))
        large = children.where(F.col("size") > BUCKET)
    return done.unionByName(large).select("key", "node", "size")


def _pruned(rows: DataFrame) -> DataFrame:
    """Of buckets that hold exactly the same sets, the one of the least key."""
    # 128 bits: sums of two hashes of the sets' numbers
    prints = [F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(38,0)")).alias(f"print{k}") for k in (1, 2)]
    marks = rows.groupBy("key").agg(*prints, F.count("*").alias("size"))
    kept = marks.groupBy("print1", "print2", "size").agg(F.min("key").alias("key"))
    return rows.select("key", "node").join(kept.select("key", "size"), "key")


def compare(rows: pd.DataFrame, other: pd.DataFrame, key: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the linked pairs of two blocks of a bucket whose first common key is `key`."""
    sets_a = [np.frombuffer(t, _U64) for t in rows["tokens"]]
    sets_b = [np.frombuffer(t, _U64) for t in other["tokens"]]
    keys_a, keys_b = list(rows["keys"]), list(other["keys"])
    n_a, n_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    # the second block as lists of its sets by token, the smallest first common key by key
    tokens, owner = np.concatenate(sets_b), np.repeat(np.arange(len(sets_b)), n_b)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    before = [np.asarray(k)[np.asarray(k) < key] for k in keys_b]
    k_all, k_owner = np.concatenate(before) if before else np.empty(0, np.int64), np.repeat(np.arange(len(before)), [len(k) for k in before])
    k_order = np.argsort(k_all, kind="stable")
    k_all, k_owner = k_all[k_order], k_owner[k_order]
    out_i, out_j = [], []
    for i, mine in enumerate(sets_a):
        able = (np.minimum(n_b, n_a[i]) >= least * np.maximum(n_b, n_a[i])) & (other["node"].to_numpy() > rows["node"].iat[i])
        if not able.any():
            continue
        earlier = np.asarray(keys_a[i])
        earlier = earlier[earlier < key]
        lo, hi = np.searchsorted(k_all, earlier, "left"), np.searchsorted(k_all, earlier, "right")
        for a, b in zip(lo, hi, strict=True):
            able[k_owner[a:b]] = False  # that pair met in a bucket of a smaller key
        if not able.any():
            continue
        lo, hi = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
        spans = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        common = np.bincount(owner[at], minlength=len(sets_b))
        linked = np.flatnonzero(able & (common >= least * (n_a[i] + n_b - common) - 1e-9))
        out_i.append(np.full(len(linked), i))
        out_j.append(linked)
    empty = [np.empty(0, np.int64)]
    return np.concatenate(out_i or empty), np.concatenate(out_j or empty)


def similar_documents(docs: DataFrame, least: float = SIMILARITY, recall: float = 0.999, split_rounds: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, class_id, n_links, component_id, kept.

    Documents of one set of shingles are a class, named by its least id. n_links counts the
    other documents whose sets have a Jaccard similarity of `least` or more, copies included;
    component_id is the least id reachable by links and kept marks it. Documents without a
    word (null and empty texts too) link with nothing. Rows that repeat an id are documents
    of their own; null ids come last in naming a class. An empty table gives no rows.
    """
    return grouped_documents(docs, least, recall, split_rounds, id_col, text_col).select(
        F.col("doc_id").alias(id_col), "class_id", "n_links", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def with_texts(base: DataFrame, members: DataFrame, rows: DataFrame) -> DataFrame:
    """members (node, name, rep, rep_key, buckets, copies), each with the text of one of its rows.

    Rows meet members by id and text, so that rows of one id, or of none, meet those of their own
    text alone. Where rows repeat both, one text of each member is kept.
    """
    met = base.withColumn("text_key", text_key(F.col("text"))).join(members, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_key") == F.col("rep_key"))).select("node", "name", "buckets", "copies", "text")
    again = cut(rows.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"))
    if again.isEmpty():
        return met
    twice = members.join(again, F.col("rep").eqNullSafe(F.col("doc_id")) & (F.col("rep_key") == F.col("text_key"))).select("node").distinct()
    twice = cut(twice)
    twice = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    return met.join(twice, "node", "left_anti").unionByName(met.join(twice, "node", "left_semi").dropDuplicates(["node"]))


def text_key(text: Column) -> Column:
    """A 64-bit name of a text: with the id it tells rows of one id apart."""
    return F.xxhash64(text)


def grouped_documents(docs: DataFrame, least: float = SIMILARITY, recall: float = 0.999, split_rounds: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, class_id, n_links, component_id and group of each row, the group
    being a component's own number; it is null for a document without a word."""
    small_batches(docs)
    base = fresh(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = cut(_sketched(base.withColumn("text_key", text_key(F.col("text")))))
    some = sketched.where(F.col("n") > 0)
    row = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key"))
    classes = some.groupBy("name").agg(row.alias("row"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    # numbered as they are written: nodes are told apart by names, and numbers are what travels
    classes = cut(classes.select("name", F.col("row.doc_id").alias("rep"), F.col("row.text_key").alias("rep_key"), "copies", "sketch", F.monotonically_increasing_id().alias("node")))
    buckets = cut(_pruned(_buckets(classes, runs_for(recall, least), split_rounds)))
    # each compared class's buckets, in order of keys, and its shingles once more from a text of it
    members = buckets.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("key", "size"))).alias("buckets"))
    members = cut(members.join(classes.select("node", "name", "rep", "rep_key", "copies"), "node"))
    picked = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members

    @tidy
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t.as_py()) for t in batch.column("text")]
            right = pa.array([_name(m) == n for m, n in zip(made, batch.column("name").to_pylist(), strict=True)], pa.bool_())
            made = pa.array([m.tobytes() for m in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("buckets"), batch.column("copies"), made], ["node", "buckets", "copies", "tokens"]).filter(right)

    # a row of the class, by its id and text: ids alone may be null or repeat
    sets = with_texts(base, picked, some)
    sets = sets.mapInArrow(tokens, "node long, buckets array<struct<key:long,size:long>>, copies long, tokens binary")
    # block b of a bucket of B blocks meets each block: a row goes to B pairs of blocks; the
    # buckets of one block are compared many to a task
    blocks = F.ceil(F.col("bucket.size") / BUCKET).cast("int")
    block = F.pmod(F.xxhash64("node", "bucket.key"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, block).alias("x"), F.greatest(o, block).alias("y")))
    groups = max(16, -(-buckets.count() // GROUP_ROWS))
    dealt = (
        sets.select("node", "copies", "tokens", F.transform("buckets", lambda b: b.key).alias("keys"), F.explode("buckets").alias("bucket"))
        .select("*", block.alias("block"), F.explode(pairs).alias("pair"))
        .select(F.col("bucket.key").alias("key"), "pair", "block", "node", "keys", "copies", "tokens", F.when(blocks > 1, F.col("bucket.key")).otherwise(F.pmod(F.xxhash64(F.lit(8), "bucket.key"), F.lit(groups))).alias("deal"))
    )

    def brute(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["key", "node"])
        left, right, na, nb = [], [], [], []
        for key, bucket in frame.groupby("key", sort=False):
            x, y = bucket["pair"].iat[0]["x"], bucket["pair"].iat[0]["y"]
            a, b = bucket[bucket["block"] == x], bucket[bucket["block"] == y]
            for p, q in [(a, b)] if x == y else [(a, b), (b, a)]:
                if len(p) and len(q):
                    i, j = compare(p, q, key, least)
                    left.append(p["node"].to_numpy()[i])
                    right.append(q["node"].to_numpy()[j])
                    na.append(q["copies"].to_numpy()[j])
                    nb.append(p["copies"].to_numpy()[i])
        left, right = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (left, right))
        nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([*na, *nb]) if na else None, minlength=len(nodes)).astype(np.int64)
        low, high = forest(left, right)
        release()
        return pd.DataFrame({"a": np.concatenate([nodes, low]), "b": np.concatenate([nodes, high]), "n": np.concatenate([counts, np.zeros(len(low), np.int64)])})

    found = cut(dealt.groupBy("deal", "pair").applyInPandas(brute, "a long, b long, n long"))
    links = found.groupBy("a").agg(F.sum("n").alias("links")).where(F.col("links") > 0)
    return named_components(some.select("doc_id", "text_key", "name"), classes, links, found.where(F.col("n") == 0).select("a", "b")).unionByName(
        sketched.where(F.col("n") == 0).select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    )
