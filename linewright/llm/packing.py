"""Sum-of-squares packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import cut, fresh, release, resident, small_batches, tidy

#: Pieces that one task packs among themselves. Larger groups leave fewer bins part empty:
#: of 8,000 pieces' bins about 0.1 % stay open.
GROUP_PIECES = 8_192

#: Runs of white space that are encoded on their own where the whole text is too much for the pattern.
_RUN = regex.compile(r"\p{White_Space}{1024,}+")


def encoder(tokenizer: str, ranks: str):
    """The byte-level vocabulary as a tiktoken encoding, which gives the same ids as the
    tokenizer file's own library several times faster. `ranks` is the same vocabulary as
    ranks; its pattern and special strings come from the tokenizer file."""

    def make():
        import public_tokenizers
        import tiktoken

        with open(tokenizer, encoding="utf-8") as file:
            spec = json.load(file)
        with open(ranks, "rb") as file:
            known = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=special)

    return resident(("packing", tokenizer, ranks), make)


def token_ids(encode, text: str) -> np.ndarray:
    """The ids of a text, special strings in it included.

    The pattern backtracks over a run of white space, too far in a very long one. Such a run is
    one piece but for its last character, which belongs to what follows (not where the text or
    a special string's neighbour ends there), so it can be encoded apart.
    """
    try:
        return encode.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        out, done = [], 0
        for run in _RUN.finditer(text):
            stop = run.end()
            if stop < len(text) and not any(text.startswith(s, stop) for s in encode.special_tokens_set):
                stop -= 1
            out += [encode.encode_to_numpy(text[done : run.start()], allowed_special="all"), np.array(encode._encode_single_piece(text[run.start() : stop]), "<u4")]
            done = stop
        return np.concatenate([*out, encode.encode_to_numpy(text[done:], allowed_special="all")])


def token_pieces(docs: DataFrame, tokenizer: str, ranks: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids on request).

    A document is its ids and then `end_id`; a null text is an empty one, of one id. Only a
    longer one than the capacity is cut: whole capacities from its end, so that the first
    piece may be shorter. Repeated rows give repeated pieces.
    """

    @tidy
    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []))}
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(token_ids(encode, text or ""), end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    out["doc_id"].append(doc)
                    out["piece"].append(k)
                    out["start"].append(a)
                    out["length"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        out["ids"].append(ids[a:b].astype(np.int64))
            frame = pd.DataFrame(out)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    small_batches(docs)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return fresh(docs, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(cut_up, schema)


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, in the order given.

    open[g] counts the open bins with residual gap g. An item goes into the open bin after
    which the sum of open[g]^2 is smallest (least gap among equals); a new bin is opened only
    when the item fits into none.
    """
    counts = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    never = np.int64(1) << 60
    for at, size in enumerate(sizes.tolist()):
        was, becomes = counts[size:capacity], counts[: max(capacity - size, 0)]
        change = np.where(was > 0, 2 - 2 * was + 2 * becomes, never)
        if len(change) and was[0]:
            change[0] = 1 - 2 * was[0]  # a filled bin isn't open any more
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] < never:
            gap = size + best
            counts[gap] -= 1
            which = stacks[gap].pop()
        else:
            gap, which = capacity, len(used)
            used.append(0)
        bins[at], offsets[at] = which, used[which]
        used[which] += size
        if gap > size:
            counts[gap - size] += 1
            stacks[gap - size].append(which)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Place pieces into sequences; adds sequence_id and offset (gapless from 0).

    A piece that fills a sequence gets one of its own. The others are dealt by a hash into
    groups of about `group_pieces`, whatever their document or source, and each group is
    packed by one task, longest pieces first. Every piece is placed; rows that repeat are
    placed once each.
    """
    kept = cut(pieces)
    part = kept.where(F.col("length") < capacity)
    groups = max(1, -(-part.count() // group_pieces))
    stride = 1 << 33
    names = [f.name for f in kept.schema.fields]

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = pack_sizes(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = frame["_group"].astype(np.int64) * stride + bins
        frame["offset"] = offsets
        release()
        return frame.drop(columns="_group")

    schema = kept.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    key = F.pmod(F.xxhash64(F.lit(3), "doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    packed = part.withColumn("_group", key).groupBy("_group").applyInPandas(place, schema)
    full = kept.where(F.col("length") >= capacity).select(*names, (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    An empty table gives no rows; null and empty texts give a piece of one id; very long
    texts give many pieces of full capacity.
    """
    return pack(token_pieces(docs, tokenizer, ranks, end_id, capacity), capacity)


def sequences(docs: DataFrame, tokenizer: str, ranks: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """The packed ids themselves: sequence_id, ids (whole), documents (doc_id, piece, offset)."""
    placed = pack(token_pieces(docs, tokenizer, ranks, end_id, capacity, with_ids=True), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.transform("parts", lambda p: F.struct(p.doc_id.alias("doc_id"), p.piece.alias("piece"), p.offset.alias("offset"))).alias("documents"))
