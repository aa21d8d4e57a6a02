"""Token counts by a compiled finite-state tokenizer.

A byte-pair vocabulary with word ends is compiled into a deterministic transducer: its states
describe how the symbols of the current word read so far are cut into tokens, and each
transition carries the change in the number of tokens. Transitions are compiled on first use,
many at a time, and kept in arrays; many words are read in lockstep.

Two facts make that exact. (1) Merging in rank order gives a cut whose every adjacent pair of
tokens is what merging those two alone would give, and for each prefix of a word there is one
such cut; so the last token of each prefix is fixed by the last tokens of shorter prefixes.
(2) A token that starts inside the window must continue a prefix of some token, so the state
needs only the last tokens before suffixes that begin a longer token: finitely many.

Long texts are cut into chunks, each read by its own task. A chunk is a map of states: from
the state before it to the state after it and the tokens between. A chunk that leaves the
run of letters or signs in which it begins has one state after it whatever came before;
others are evaluated from each state that the chunk before can end in. Maps compose by an
associative product: first those of a block of chunks, then the blocks of a text.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import cut, fresh, resident, small_batches, tidy

#: Texts of more characters than this are counted chunk by chunk, in several tasks.
CHUNK_CHARS = 1 << 16
#: Characters that a chunk sees before its beginning and after its end, to choose both.
BEFORE, AFTER = 32, 96
#: Chunks whose maps one task composes.
BLOCK_CHUNKS = 256
#: Text that is counted at once; words read in lockstep.
BATCH_BYTES, LANES = 8 << 20, 1 << 15
#: Runs of more bytes are read as stretches of STRETCH bytes side by side, each from the state
#: in which a reading of the WARM bytes before it ends, which is checked.
LONG_RUN, STRETCH, WARM = 1024, 256, 64
#: Transitions that are kept apart until they are many.
RECENT = 1 << 14
#: Compiled states and known pairs of a worker; compiled anew when full, which changes no result.
MAX_STATES, MAX_PAIRS = 200_000, 1_000_000

WORD_END = "</w>"


def _printable_bytes() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one printable character."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted in sorted keys, and whether they are there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


class WordTransducer:
    """Counts the tokens of words. A word is a row of symbols: a byte inside it, and 256 + the
    byte at its end.

    State s holds, for each length k of the suffix read last, the trie's node of that suffix
    (node[s, k], -1 if no longer token begins with it), the last token before it (last[s, k])
    and the number of tokens before it less those in all (less[s, k]).
    """

    def __init__(self, merges: list, vocabulary: dict[str, int]):
        byte_of = _printable_bytes()

        def symbols(token: str) -> str:
            last = token.endswith(WORD_END)
            body = token[: -len(WORD_END)] if last else token
            raw = [byte_of[c] for c in body]
            return "".join(map(chr, raw[:-1])) + chr(raw[-1] + 256 * last) if raw else ""

        self.rank: dict[tuple[str, str], int] = {}
        for place, pair in enumerate(merges):
            left, right = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            self.rank.setdefault((symbols(left), symbols(right)), place)
        self.tokens = sorted({symbols(t) for t in vocabulary if all(c in byte_of for c in t.removesuffix(WORD_END))} - {""})
        # the trie: edges (node * 512 + symbol) in order, the node each leads to, each node's token
        edges: dict[int, int] = {}
        token_of, depth = [-1], [0]
        inner = {0}
        for number, token in enumerate(self.tokens):
            node = 0
            for place, c in enumerate(token, 1):
                inner.add(node)
                node = edges.setdefault(node << 9 | ord(c), len(token_of))
                if node == len(token_of):
                    token_of.append(-1)
                    depth.append(place)
            token_of[node] = number
        self.edges = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[e] for e in self.edges.tolist()], np.int32)
        self.token_of, self.depth = np.array(token_of, np.int32), np.array(depth)
        self.inner = np.isin(np.arange(len(token_of)), list(inner))
        self.wide = max(map(len, self.tokens), default=1)
        self.none = len(self.tokens)  # stands for no token: the word's beginning
        self.restart()

    def restart(self) -> None:
        self.pairs: dict[int, bool] = {}
        self.quick: dict[int, tuple[int, int]] = {}
        self.number: dict[bytes, int] = {}
        self.rows = np.zeros((3, 1024, self.wide + 1), np.int32)
        none = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        # transitions in order, and the latest ones: steps, the states they lead to, their changes
        self.known, self.recent = none, none
        first = np.full((3, 1, self.wide + 1), -1, np.int32)
        first[2], first[:, 0, 0] = 0, (0, self.none, 0)
        self._named(first)

    def _named(self, rows: np.ndarray) -> np.ndarray:
        """The numbers of states (3, states, suffixes); new ones are kept."""
        out = np.empty(rows.shape[1], np.int32)
        kept = rows[0] >= 0
        for k in range(len(out)):
            key = rows[:, k, kept[k]].tobytes()
            known = self.number.get(key)
            if known is None:
                known = self.number[key] = len(self.number)
                if known == self.rows.shape[1]:
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], 1)
                self.rows[:, known] = rows[:, k]
            out[k] = known
        return out

    def key(self, state: int) -> bytes:
        """What names a state in every worker."""
        row = self.rows[:, state]
        return row[:, row[0] >= 0].tobytes()

    def state(self, key: bytes) -> int:
        node, last, less = np.frombuffer(key, np.int32).reshape(3, -1)
        row = np.full((3, 1, self.wide + 1), -1, np.int32)
        row[2] = 0
        row[:, 0, self.depth[node]] = node, last, less
        return int(self._named(row)[0])

    def merged(self, text: str) -> list[str]:
        """The cut by merging in rank order, leftmost first among equals."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _follows(self, left: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token comes right after the one before it, as those two alone are cut."""
        if len(self.pairs) > MAX_PAIRS:
            self.pairs.clear()
        out = np.empty(len(left), bool)
        for k, key in enumerate((left.astype(np.int64) << 32 | token).tolist()):
            known = self.pairs.get(key)
            if known is None:
                before, after = key >> 32, self.tokens[key & 0xFFFFFFFF]
                known = self.merged(self.tokens[before] + after) == [self.tokens[before], after] if before != self.none else self.merged(after) == [after]
                self.pairs[key] = known
            out[k] = known
        return out

    def _advance(self, rows: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States (3, states, suffixes), each after a symbol more, and the changes in the number of tokens."""
        node, last, less = rows
        at, there = _find(self.edges, (node.astype(np.int64) << 9 | symbol[:, None]).ravel())
        grown = np.where(there & (node.ravel() >= 0), self.child[at], -1).reshape(node.shape)
        token = np.where(grown >= 0, self.token_of[grown], -1)
        chosen = np.full(len(symbol), -1)
        # the shortest token that ends here and follows what comes before it is the only one
        for k in range(node.shape[1]):
            some = np.flatnonzero((chosen < 0) & (token[:, k] >= 0))
            some = some[self._follows(last[some, k], token[some, k])] if len(some) else some
            chosen[some] = k
        if (chosen < 0).any():
            raise ValueError(f"the vocabulary has no token for the symbol {int(symbol[chosen < 0][0])}")
        each = np.arange(len(symbol))
        change = less[each, chosen] + 1
        made = np.full((3, *node.shape), -1, np.int32)
        made[:, :, 1:] = grown[:, :-1], last[:, :-1], less[:, :-1] - change[:, None]
        made[0, :, 0], made[1, :, 0], made[2, :, 0] = 0, token[each, chosen], 0
        gone = (made[0] < 0) | ~self.inner[made[0]]
        made[0][gone], made[1][gone], made[2][gone] = -1, -1, 0
        return made, change

    def _compile(self, steps: np.ndarray) -> None:
        """Make the transitions (state * 512 + symbol), none of which is known."""
        symbol = steps & 511
        made, change = self._advance(self.rows[:, steps >> 9], symbol)
        goes, within = np.zeros(len(steps), np.int32), symbol < 256
        goes[within] = self._named(made[:, within])
        new = steps, goes, change.astype(np.int32)
        place = np.searchsorted(self.recent[0], steps)
        self.recent = tuple(np.insert(old, place, more) for old, more in zip(self.recent, new, strict=True))
        if len(self.recent[0]) > RECENT:
            place = np.searchsorted(self.known[0], self.recent[0])
            self.known = tuple(np.insert(old, place, more) for old, more in zip(self.known, self.recent, strict=True))
            self.recent = tuple(part[:0] for part in self.recent)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the states after, the changes in the number of tokens)."""
        wanted = states.astype(np.int64) << 9 | symbols
        after, change, missing = np.zeros(len(wanted), np.int32), np.zeros(len(wanted), np.int32), np.arange(len(wanted))
        for _ in range(2):
            for steps, goes, changes in (self.known, self.recent):
                at, there = _find(steps, wanted[missing])
                found = missing[there]
                after[found], change[found] = goes[at[there]], changes[at[there]]
                missing = missing[~there]
            if not len(missing):
                break
            self._compile(np.unique(wanted[missing]))
        return after, change

    def count(self, words: pa.StringArray) -> np.ndarray:
        """The number of tokens of each word; none is empty."""
        out = np.zeros(len(words), np.int64)
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        sizes = np.diff(ends)
        order = np.argsort(-sizes, kind="stable")
        alone = int((sizes > LONG_RUN).sum())
        for k in order[:alone]:
            out[k] = self.read(0, raw[ends[k] : ends[k + 1]].tobytes(), True)[1]
        for begin in range(alone, len(words), LANES):
            if self._full():
                self.restart()
            lanes = order[begin : begin + LANES]
            size = sizes[lanes]
            starts = np.cumsum(size) - size
            symbols = raw[np.repeat(ends[lanes] - starts, size) + np.arange(size.sum())].astype(np.int64)
            symbols[starts + size - 1] += 256
            states, total = np.zeros(len(lanes), np.int32), np.zeros(len(lanes), np.int64)
            for t in range(int(size[0])):
                n = int(np.searchsorted(-size, -t, side="left"))  # longer words come first
                states[:n], change = self.step(states[:n], symbols[starts[:n] + t])
                total[:n] += change
            out[lanes] = total
        return out

    def _full(self) -> bool:
        return len(self.number) > MAX_STATES or len(self.quick) > MAX_STATES

    def read(self, state: int, raw: bytes, ends: bool = False) -> tuple[int, int]:
        """(the state after, the tokens) of one run of bytes; with `ends` the last is a word's last."""
        symbols = np.frombuffer(raw, np.uint8).astype(np.int64)
        if ends and len(raw):
            symbols[-1] += 256
        if len(raw) <= LONG_RUN:
            return self._one_by_one(state, symbols)
        starts = np.arange(0, len(raw), STRETCH)
        first = np.repeat(self.rows[:, :1], len(starts), 1)
        for t in range(WARM):
            first[:, 1:] = self._advance(first[:, 1:], symbols[starts[1:] - WARM + t])[0]
        first[:, 0] = self.rows[:, state]
        after, tokens = np.empty_like(first), np.zeros(len(starts), np.int64)
        wrong = np.arange(len(starts))
        for _ in range(3):
            after[:, wrong], tokens[wrong] = self._side_by_side(first[:, wrong], symbols, starts[wrong])
            wrong = 1 + np.flatnonzero((after[:, :-1] != first[:, 1:]).any((0, 2)))
            if not len(wrong):
                break
            first[:, wrong] = after[:, wrong - 1]
        # what still depends on how the stretches before it were cut, as repetitions do, comes
        # in order; they have few states
        for k in range(int(wrong[0]) if len(wrong) else len(starts), len(starts)):
            if (after[:, k - 1] != first[:, k]).any() or k in wrong:
                first[:, k] = after[:, k - 1]
                end, tokens[k] = self._one_by_one(int(self._named(first[:, [k]])[0]), symbols[starts[k] : starts[k] + STRETCH])
                after[:, k] = self.rows[:, end]
        return (0 if ends else int(self._named(after[:, [-1]])[0])), int(tokens.sum())

    def _side_by_side(self, rows: np.ndarray, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after, tokens) of stretches, from the states given for them."""
        rows, tokens = rows.copy(), np.zeros(len(starts), np.int64)
        for t in range(STRETCH):
            here = np.flatnonzero(starts + t < len(symbols))
            rows[:, here], change = self._advance(rows[:, here], symbols[starts[here] + t])
            tokens[here] += change
        return rows, tokens

    def _one_by_one(self, state: int, symbols: np.ndarray) -> tuple[int, int]:
        total = 0
        for symbol in symbols.tolist():
            known = self.quick.get(state << 9 | symbol)
            if known is None:
                if self._full():
                    key = self.key(state)
                    self.restart()
                    state = self.state(key)
                made, change = self._advance(self.rows[:, [state]], np.array([symbol]))
                # no state follows a word's end
                known = self.quick[state << 9 | symbol] = (int(self._named(made)[0]) if symbol < 256 else 0), int(change[0])
            state, total = known[0], total + known[1]
        return state, total


#: Kinds of a run that a chunk may end in; what lies between runs ends every word.
LETTERS, SIGNS = "L", "S"
#: The state before a text.
START = b""


class Counter:
    """Counts as the tokenizer file's library does: its special strings first, then NFC, lower
    case, the word pattern, and the transducer for each word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or model.get("end_of_word_suffix") != WORD_END or split.get("behavior") != "Removed":
            raise ValueError("only byte-pair vocabularies with word ends, NFC and lower case are compiled")
        pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.word, self.word_or_end = regex.compile(pattern), regex.compile(pattern + "|\n")
        self.kinds = {LETTERS: regex.compile(r"\p{L}+"), SIGNS: regex.compile(r"[^\p{White_Space}\p{L}\p{N}]+")}
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.longest = max(map(len, specials), default=1)
        self.transducer = WordTransducer(model["merges"], model["vocab"])

    @staticmethod
    def plain(text: str) -> str:
        if text.isascii():
            return text.lower()
        # one character at a time: no other letter decides how a final sigma is lowered
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _special_parts(self, text: str) -> tuple[list[str], int]:
        if self.special is None or "<|" not in text:
            return [text], 0
        parts = self.special.split(text)
        return parts, len(parts) - 1

    def segments(self, segments: list[str]) -> np.ndarray:
        """Tokens of texts without white space."""
        out = np.zeros(len(segments), np.int64)
        parts = segments
        owner = np.arange(len(parts))
        if self.special is not None:
            split = [k for k, s in enumerate(segments) if "<|" in s]
            more = [self.special.split(segments[k]) for k in split]
            out[split] = [len(m) - 1 for m in more]
            parts = segments.copy()
            for k in split:
                parts[k] = ""
            parts += [p for m in more for p in m]
            owner = np.concatenate([owner, np.repeat(np.array(split, np.int64), list(map(len, more)))])
        # all in one pass: no word and no combination of characters goes across an LF
        words = pa.array(self.word_or_end.findall(self.plain("\n".join(parts) + "\n")), pa.string()).dictionary_encode()
        place = words.indices.to_numpy()
        at_end = np.flatnonzero(np.array(pc.equal(words.dictionary, "\n").to_numpy(zero_copy_only=False)))
        is_end = np.isin(place, at_end)
        counts = self.transducer.count(words.dictionary)[place]
        where = np.cumsum(is_end) - is_end
        return out + np.bincount(owner[where[~is_end]], weights=counts[~is_end], minlength=len(segments)).astype(np.int64)

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of an Arrow column without nulls; a segment counts once for all."""
        # str.split() and its like also split at U+001C to U+001F, which are no white space here
        apart = pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        for k in np.flatnonzero(apart):
            out[k] = self.segments([s for s in regex.split(r"\p{White_Space}+", texts[int(k)].as_py()) if s]).sum()
        lists = pc.utf8_split_whitespace(texts.filter(pa.array(~apart)))
        flat = lists.flatten().dictionary_encode()
        upto = np.concatenate([[0], np.cumsum(self.segments(flat.dictionary.to_pylist())[flat.indices.to_numpy()] if len(flat) else [])]).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        out[~apart] = np.diff(upto[ends])
        return out

    def text(self, text: str) -> int:
        return int(self.texts(pa.array([text], pa.string()))[0])

    # chunks of a long text

    def cut_at(self, text: str, near: int) -> int | None:
        """The first place from `near` on, within AFTER - BEFORE characters, where a text may be
        cut, or its end if that comes first: no characters combine across it, and no special
        string or apostrophe is about."""
        for p in range(near, min(near + AFTER - BEFORE, len(text))):
            begin = max(0, p - self.longest)
            crossing = self.special and any(m.start() + begin < p < m.end() + begin for m in self.special.finditer(text[begin : p + self.longest]))
            first = unicodedata.normalize("NFD", text[p])[0]
            if not (crossing or "'" in text[max(0, p - 3) : p + 1] or unicodedata.combining(first) or first in combining_seconds()):
                return p
        return len(text) if near + AFTER - BEFORE > len(text) else None

    def _opened(self, kind: str, state: int, raw: bytes) -> tuple[bytes, int]:
        """The state inside a run whose bytes so far end with raw: whether its last is also a
        word's last shows later."""
        state, tokens = self.transducer.read(state, raw[:-1])
        return kind.encode() + raw[-1:] + self.transducer.key(state), tokens

    def element(self, text: str) -> tuple[str, str, bool, int, bytes]:
        """(kind, head, whole, tokens, after) of a chunk: the run of letters or signs in which it
        begins, whether it is all of the chunk, else the tokens after it and the state at the end."""
        parts, tokens = self._special_parts(text)
        parts = [self.plain(p) for p in parts]
        kind = head = ""
        for name, run in self.kinds.items() if not parts[0].startswith("'") else ():
            if found := run.match(parts[0]):
                kind, head = name, found.group()
        if len(parts) == 1 and len(head) == len(parts[0]):
            return kind, head, True, 0, START
        parts[0] = parts[0][len(head) :]
        words, last = [], ("", "")
        for k, part in enumerate(parts):
            found = list(self.word.finditer(part))
            words += [m.group() for m in found]
            if k == len(parts) - 1 and found and found[-1].end() == len(part):
                # the last run may go on in the next chunk, unless it is a number or a contraction
                for name, run in self.kinds.items():
                    if run.fullmatch(found[-1].group()):
                        last = name, words.pop()
        if words:
            tokens += int(self.transducer.count(pa.array(words, pa.string())).sum())
        after, more = self._opened(last[0], 0, last[1].encode("utf-8")) if last[0] else (START, 0)
        return kind, head, False, tokens + more, after

    def evaluate(self, before: bytes, kind: str, head: str, whole: bool, tokens: int, after: bytes) -> tuple[bytes, int]:
        """The chunk's map at one state: the state after the chunk, and the tokens."""
        if whole and not head:
            return before, 0
        state, raw, had = 0, head.encode("utf-8"), 0
        if before != START:
            inner = self.transducer.state(before[2:])
            if before[:1] == kind.encode():
                state, raw = inner, before[1:2] + raw
            else:
                had = self.transducer.read(inner, before[1:2], True)[1]
        if whole:
            out, more = self._opened(kind, state, raw)
            return out, had + more
        return after, had + tokens + (self.transducer.read(state, raw, True)[1] if raw else 0)

    def end(self, before: bytes) -> int:
        """Tokens that the text's end completes."""
        return self.transducer.read(self.transducer.state(before[2:]), before[1:2], True)[1] if before != START else 0


@functools.cache
def combining_seconds() -> frozenset[str]:
    """Characters that a character before them may combine with although they are of class 0."""
    pairs = (d.split() for d in map(unicodedata.decomposition, map(chr, range(0x110000))) if d and d[0] != "<")
    vowels_and_finals = [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2) | frozenset(map(chr, vowels_and_finals))


def counter(path: str) -> Counter:
    """The compiled tokenizer of this Python worker."""
    return resident(("token_counts", path), lambda: Counter(path))


def composed(maps: pd.DataFrame) -> dict[bytes, tuple[bytes, int]]:
    """The product of consecutive chunks' maps (part, before, after, tokens), in order of parts."""
    product: dict[bytes, tuple[bytes, int]] | None = None
    for _, one in maps.groupby("part", sort=True):
        own = dict(zip(map(bytes, one["before"]), zip(map(bytes, one["after"]), one["tokens"], strict=True), strict=True))
        # a state that no chunk before ends in has no image further on
        product = own if product is None else {b: (own[a][0], n + own[a][1]) for b, (a, n) in product.items() if a in own}
    return product or {}


MAPS = "row long, id long, n_bytes long, part int, before binary, after binary, tokens long"


def _chunked(long: DataFrame, tokenizer: str, chunk_chars: int) -> DataFrame:
    """(id, n_bytes, n_tokens) of texts (row, id, text), chunk by chunk."""
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk_chars))
    piece = lambda s: F.substring(F.col("text"), F.greatest(s - BEFORE, F.lit(0)) + 1, F.least(s, F.lit(BEFORE)) + chunk_chars + AFTER)
    pieces = F.transform(starts, lambda s: F.struct((s / chunk_chars).cast("int").alias("part"), (s + chunk_chars >= F.length("text")).alias("final"), piece(s).alias("piece")))
    names = ["kind", "head", "whole", "tokens", "after"]

    @tidy
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer)
        for batch in batches:
            made = []
            for part, final, text in zip(batch["part"], batch["final"], batch["piece"], strict=True):
                begin = count.cut_at(text, BEFORE) if part else 0
                end = len(text) if final else count.cut_at(text, (BEFORE if part else 0) + chunk_chars)
                made.append((None,) * 5 if begin is None or end is None else count.element(text[begin:end]))
            out = batch[["row", "id", "n_bytes", "part"]].copy()
            for k, name in enumerate(names):
                out[name] = pd.Series([m[k] for m in made], out.index, object)
            yield out.astype({"tokens": "Int64", "whole": "boolean", "id": "Int64"})

    spread = long.select("row", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.inline(pieces)).repartition("row", "part")
    chunks = cut(spread.mapInPandas(read, "row long, id long, n_bytes long, part int, kind string, head string, whole boolean, tokens long, after binary"))
    # where characters combine for too long to cut a text, it is counted whole
    uncut = chunks.where(F.col("kind").isNull()).select("row").distinct()
    chunks = chunks.join(uncut, "row", "left_anti")

    @tidy
    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer)
        for batch in batches:
            columns = [batch[c] for c in ("kind", "head", "whole", "tokens", "end")]
            made = [count.evaluate(bytes(b), *row[:4], bytes(row[4])) for b, *row in zip(batch["before"], *columns, strict=True)]
            out = batch[["row", "id", "n_bytes", "part", "before"]].assign(after=[m[0] for m in made], tokens=[m[1] for m in made])
            yield out.astype({"id": "Int64"})

    # each chunk's map at the state before a text, then at every state in which the chunk before
    # it can end, until there is no further one
    asked = chunks.select("row", "part", F.lit(START).alias("before"))
    maps = None
    while True:
        rows = chunks.withColumnRenamed("after", "end").join(asked, ["row", "part"])
        new = cut(rows.mapInPandas(evaluate, MAPS))
        maps = new if maps is None else maps.unionByName(new)
        after = new.select("row", (F.col("part") + 1).alias("part"), F.col("after").alias("before")).distinct()
        asked = cut(after.join(chunks.select("row", "part"), ["row", "part"], "left_semi").join(maps.select("row", "part", "before"), ["row", "part", "before"], "left_anti"))
        if asked.isEmpty():
            break

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        product = composed(frame)
        one = frame.iloc[[0] * len(product)][["row", "id", "n_bytes"]].reset_index(drop=True).astype({"id": "Int64"})
        return one.assign(part=int(frame["part"].min()), before=list(product), after=[a for a, _ in product.values()], tokens=[n for _, n in product.values()])

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        after, tokens = composed(frame)[START]
        return pd.DataFrame({"id": frame["id"].iloc[:1].astype("Int64"), "n_bytes": frame["n_bytes"].iloc[:1], "n_tokens": [tokens + counter(tokenizer).end(after)]})

    blocks = maps.groupBy("row", F.floor(F.col("part") / BLOCK_CHUNKS).alias("_block")).applyInPandas(block, MAPS)
    done = blocks.groupBy("row").applyInPandas(whole, "id long, n_bytes long, n_tokens long")
    return done.unionByName(_whole(long.join(uncut, "row", "left_semi").select("id", "text"), tokenizer))


def _whole(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(id, n_bytes, n_tokens) of texts (id, text), each in one task."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer)
        for batch in gathered(batches, BATCH_BYTES):
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(own.texts(texts))], ["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, "id long, n_bytes long, n_tokens long")


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about `most` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Count the tokens of each text as the tokenizer file's own library gives them.

    Returns one row per input row: the id, n_bytes (UTF-8), n_tokens, over_limit. A null text
    counts as empty: 0 bytes, 0 tokens. Ids may be null or repeat; each row is counted on its
    own. Texts of more than `chunk_chars` characters (256 at least) are cut and counted in
    several tasks.
    """
    small_batches(docs)
    base = fresh(docs, F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = _whole(base.where(F.length("text") <= chunk_chars), tokenizer)
    # rows are told apart by a number of their own, written down as it is given
    long = cut(base.where(F.length("text") > chunk_chars).withColumn("row", F.monotonically_increasing_id()))
    if not long.isEmpty():
        counted = counted.unionByName(_chunked(long, tokenizer, chunk_chars))
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
