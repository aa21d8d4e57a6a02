"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text; it knows every substring of
that text. A document is parsed greedily into the longest phrases that occur in it: the fewer
phrases for its length, the closer it is to the language's text. The language of the fewest
phrases, normalised by length, wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linewright.llm.common import crc_mod, cut, fresh, resident, small_batches, tidy, unit_hash

#: Labelled text kept for each language: this many characters, of at most SAMPLE_ROWS rows,
#: PIECE_CHARS of each before any gives more.
MODEL_CHARS, SAMPLE_ROWS, PIECE_CHARS = 32_000, 64, 4_000
#: Characters of all languages together: more than 125 languages give less than MODEL_CHARS each.
TOTAL_CHARS = 4_000_000
#: Automata are tables of states and symbols as long as those of a worker take no more bytes
#: than this; the others are lists of steps, which are slower and find the same.
TABLE_BYTES = 64 << 20
#: Languages whose counts are broadcast, at most; with more, rows meet their counts by a shuffle.
BROADCAST_LANGUAGES = 10_000
#: Documents are parsed in windows of this many symbols, side by side; a phrase ends there.
WINDOW = 256
#: Windows parsed at once.
LANES = 8192

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters_of(text: str) -> str:
    """What is compared: lower-cased letters and marks, other runs as one space."""
    return _OTHER.sub(" ", text.lower()).strip()


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """The next state by symbol for each state; symbol 0 is no part of any match."""
    steps: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def twin(p: int, c: int) -> int:
        """The state after p by c whose longest match is just one longer than p's."""
        q = steps[p][c]
        if length[q] == length[p] + 1:
            return q
        made = len(steps)
        steps.append(steps[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = made
        while p >= 0 and steps[p].get(c) == q:
            steps[p][c] = made
            p = link[p]
        return made

    last = 0
    for c in symbols.tolist():
        if c == 0:
            last = 0  # no phrase goes across a text's end
        elif c in steps[last]:
            last = twin(last, c)
        else:
            made = len(steps)
            steps.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in steps[p]:
                steps[p][c] = made
                p = link[p]
            link[made] = twin(p, c) if p >= 0 else 0
            last = made
    return steps


class Automaton:
    """A language's suffix automaton over the letters of its own text, each a symbol from 1;
    0 is any other. after() gives the next states, 0 (the empty match) where there is none."""

    def __init__(self, texts: list[str], shared: dict[str, int], table_bytes: int):
        letters = sorted({c for t in texts for c in t})
        self.symbol_of = np.zeros(len(shared) + 1, np.uint16 if len(letters) < 1 << 16 else np.int32)
        own = {c: k for k, c in enumerate(letters, 1)}
        for c, k in own.items():
            self.symbol_of[shared[c]] = k
        self.size = len(letters) + 1
        steps = suffix_automaton(np.array([k for t in texts for k in (*map(own.__getitem__, t), 0)], np.int64))
        state = np.repeat(np.arange(len(steps)), list(map(len, steps)))
        keys = state * self.size + np.array([c for s in steps for c in s], np.int64)
        goes = np.array([g for s in steps for g in s.values()], np.int64)
        kind = np.uint16 if len(steps) < 1 << 16 else np.int32
        self.bytes = len(steps) * self.size * np.dtype(kind).itemsize
        if self.bytes <= table_bytes:
            self.table = np.zeros(len(steps) * self.size, kind)
            self.table[keys] = goes
        else:
            order = np.argsort(keys)
            self.table, self.keys, self.goes, self.bytes = None, np.append(keys[order], -1), np.append(goes[order], 0), 0

    def after(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        wanted = state * self.size + symbol
        if self.table is not None:
            return self.table[wanted]
        at = np.searchsorted(self.keys[:-1], wanted)
        return np.where(self.keys[at] == wanted, self.goes[at], 0)


class Model:
    """The automata of all languages."""

    def __init__(self, texts: dict[str, list[str]], table_bytes: int = TABLE_BYTES):
        self.languages = sorted(texts)
        shared = {c: k for k, c in enumerate(sorted({c for parts in texts.values() for t in parts for c in t}), 1)}
        # letters by number, 0 being one that no language has
        self.number = np.zeros(0x110000, np.uint16 if len(shared) < 1 << 16 else np.int32)
        self.number[[ord(c) for c in shared]] = list(shared.values())
        self.automata = []
        for name in self.languages:
            self.automata.append(Automaton(texts[name], shared, table_bytes))
            table_bytes -= self.automata[-1].bytes

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns), per letter."""
        coded = [self.number[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] for t in texts]
        sizes = np.array([len(c) for c in coded])
        windows = -(-sizes // WINDOW)
        padded = np.zeros((int(windows.sum()), WINDOW), self.number.dtype)
        flat = padded.reshape(-1)
        first = np.concatenate([[0], np.cumsum(windows)[:-1]]).astype(int)
        for at, c in zip(first, coded, strict=True):
            flat[at * WINDOW : at * WINDOW + len(c)] = c
        owner = np.repeat(np.arange(len(texts)), windows)
        lengths = np.minimum(sizes[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW, WINDOW)
        out = np.zeros((len(texts), len(self.automata)))
        order = np.argsort(-lengths, kind="stable")
        for start in range(0, len(order), LANES):
            lanes = order[start : start + LANES]
            columns = np.ascontiguousarray(padded[lanes].T)
            ends = np.searchsorted(-lengths[lanes], -np.arange(WINDOW), side="left")  # lanes longer than t
            for k, automaton in enumerate(self.automata):
                begins = automaton.after(np.zeros(automaton.size, np.int64), np.arange(automaton.size))
                state, count = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int32)
                for t in range(WINDOW):
                    n = ends[t]
                    if not n:
                        break
                    c = automaton.symbol_of[columns[t, :n]]
                    to = automaton.after(state[:n], c)
                    stuck = to == 0
                    # a phrase begins here; an unknown symbol, which has to be spelled out, counts as two
                    count[:n] += stuck | (state[:n] == 0)
                    count[:n] += c == 0
                    state[:n] = np.where(stuck, begins[c], to)
                out[:, k] += np.bincount(owner[lanes], weights=count, minlength=len(texts))
        return out / np.maximum(sizes, 1)[:, None]


def labelled_texts(docs: DataFrame, known: Column, model_chars: int = MODEL_CHARS, rows: int = SAMPLE_ROWS) -> dict[str, list[str]]:
    """A seeded, bounded sample of labelled text for each language.

    Of the rows with a language where `known` holds, each language's first in a hash order,
    at most `rows` of them that have letters: PIECE_CHARS characters of each, then as many more and so on, until
    model_chars are there. Rows are thinned by the languages' counts first, so that no task
    sorts a language whole.
    """
    labelled = docs.where(known & F.col("lang").isNotNull() & (F.length("text") > 0))
    labelled = labelled.select("lang", "text", unit_hash(F.col("doc_id"), 4).alias("h"))
    counts = cut(labelled.groupBy("lang").count())
    languages = counts.count()
    counts = F.broadcast(counts) if languages <= BROADCAST_LANGUAGES else counts
    # of many languages each gives less, so that what comes to the driver is bounded
    model_chars = max(min(model_chars, TOTAL_CHARS // max(languages, 1)), 1)
    span = F.lit(2.0**64)
    thin = labelled.join(counts, "lang").where((F.col("h").cast("double") / span + 0.5) * F.col("count") <= 8.0 * rows)

    def trim(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: letters_of(t)[:model_chars] if _LETTER.search(t) else "")

    # texts are read whole, and their letters trimmed, by the executors
    trimmed = thin.select("lang", "h", F.pandas_udf(trim, "string")("text").alias("text")).where("text <> ''")
    order = Window.partitionBy("lang").orderBy("h", "text")
    first = trimmed.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows).select("lang", "k", "text").collect()
    texts: dict[str, list[str]] = {}
    rest = [(r.lang, r.text) for r in sorted(first, key=lambda r: (r.lang, r.k))]
    while rest:
        for lang, text in rest:
            had = texts.setdefault(lang, [])
            room = model_chars - sum(map(len, had))
            if text and room > 0:
                had.append(text[: min(room, PIECE_CHARS)])
        rest = [(lang, text[PIECE_CHARS:]) for lang, text in rest if len(text) > PIECE_CHARS]
    return texts


def predictor(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """Learn from the rows of docs that aren't held out; a function of a text column that
    gives (lang_pred, score)."""
    small_batches(docs)
    plain = fresh(docs, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out.alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(labelled_texts(plain, ~F.col("held_out")))  # bounded: model_chars for each language

    @tidy
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        texts = shared.value
        key = hashlib.blake2b(repr(sorted(texts.items())).encode("utf-8", "surrogatepass")).digest()
        model = resident(("language_id", key), lambda: Model(texts))
        for batch in batches:
            # about a megabyte of text at a time
            block = (batch.str.len().fillna(0).cumsum() // 1_000_000).astype(int)
            yield pd.concat([_predicted(part, model) for _, part in batch.groupby(block, sort=False)] or [_predicted(batch, model)])

    predict.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # a filter on the prediction doesn't make it twice
    return F.pandas_udf(predict, "lang_pred string, score double").asNondeterministic()


def held_out_default(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 4) == 2


def identify(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predict each text's language: id, held_out, lang_pred, score.

    Learns from text and language of the rows that aren't held out (crc32 of the id modulo 4
    is 2 by default). lang_pred is a learned language, or `und` if the text is null or has no
    letter, or if nothing could be learned; score is 0 for those, else how much fewer phrases
    the winner needs than the next language (0 a tie, towards 1 the clearer). Ties go to the
    first language by name. Each row is judged by its whole text alone, so repeated rows and
    ids get equal results; an empty table gives no rows.
    """
    held_out = held_out_default(id_col) if held_out is None else held_out
    predict = predictor(docs, held_out, id_col, text_col, lang_col)
    rows = fresh(docs, F.col(id_col), held_out.alias("held_out"), predict(F.col(text_col)).alias("_p"))
    return rows.select(id_col, "held_out", "_p.lang_pred", "_p.score")


def _predicted(part: pd.Series, model: Model) -> pd.DataFrame:
    texts = ["" if t is None else t for t in part]
    clean = [letters_of(t) if _LETTER.search(t) else "" for t in texts]
    some = [k for k, t in enumerate(clean) if t and model.languages]
    names = np.full(len(texts), "und", object)
    score = np.zeros(len(texts))
    if some:
        needed = model.phrases([clean[k] for k in some])
        names[some] = np.array(model.languages, object)[needed.argmin(1)]
        least = needed.min(1)
        second = np.partition(needed, 1, axis=1)[:, 1] if needed.shape[1] > 1 else np.ones(len(some))
        score[some] = np.clip(1 - least / np.maximum(second, 1e-12), 0, 1)
    return pd.DataFrame({"lang_pred": names, "score": score})
