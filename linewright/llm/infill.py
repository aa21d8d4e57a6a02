"""Fill-in-the-middle transformation, with line ends found in 64-bit words of UTF-8.

A batch of texts is one run of bytes, viewed as 64-bit words. Arithmetic on whole words sets
the high bit of each byte that ends a unit (an LF); counting bits word by word and summing up
gives a directory of all units of all texts of the batch. The end of a text's k-th unit is
then a search in that directory for its word, and a select of one bit within it. Characters
are counted in the same way, from the bytes that go on a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import small_batches

#: The same byte eight times, and the marks that a comparison leaves: the bytes' high bits.
ONES, LOW, HIGH = np.uint64(0x0101010101010101), np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
#: What stands before prefix, suffix and middle. A text that holds one of them stays plain.
MARKS = ("<P>", "<S>", "<M>")
CUTS = "n long, prefix_bytes long, middle_bytes long, prefix_chars long, middle_chars long"


def words_of(raw: np.ndarray) -> np.ndarray:
    """Bytes as little-endian 64-bit words, zeros after the last."""
    padded = np.zeros(-(-len(raw) // 8) * 8, np.uint8)
    padded[: len(raw)] = raw
    return padded.view("<u8")


def marked(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of every byte that equals `byte`. No carry leaves a byte, so that every mark is right."""
    other = words ^ (ONES * np.uint64(byte))
    return ~(((other & LOW) + LOW) | other | LOW)


def going_on(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte 10xxxxxx, which goes on a character."""
    return words & ~(words << np.uint64(1)) & HIGH


class Directory:
    """Marks with the number of marks before each word."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marked bytes lie before byte `at`."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        bits = np.append(self.marks, np.uint64(0))[word] & ((np.uint64(1) << (inside << np.uint64(3))) - np.uint64(1))
        return self.before[word] + np.bitwise_count(bits)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th marked byte, from 0; it has to be there."""
        word = np.searchsorted(self.before, k, side="right") - 1
        bits, left = self.marks[word], k - self.before[word]
        for step in range(7):
            # the lowest bit goes while there are marks to be passed
            bits = np.where(left > step, bits & (bits - np.uint64(1)), bits)
        lowest = bits & (~bits + np.uint64(1))
        return (word << 3) + (np.bitwise_count(lowest - np.uint64(1)) >> 3)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, and the places where each begins and the last ends."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return raw, ends - ends[0]


def cut_lines(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> dict[str, np.ndarray]:
    """For each text: n, its lines; and where the prefix and the middle end if cut after
    first % (n + 1) and second % (n + 1) lines, in either order, as bytes and as characters."""
    raw, places = _texts(texts)
    words = words_of(raw)
    feeds, rest = Directory(marked(words, 10)), Directory(going_on(words))
    begin, end = places[:-1], places[1:]
    skipped = feeds.rank(begin)
    whole = feeds.rank(end) - skipped
    # what follows the last LF is a line too
    unended = (end > begin) & (np.append(raw, np.uint8(10))[np.maximum(end - 1, 0)] != 10)
    n = whole + unended
    a, b = first % (n + 1), second % (n + 1)

    def byte_after(lines: np.ndarray) -> np.ndarray:
        out = np.where(lines == 0, begin, end)
        inside = np.flatnonzero((lines > 0) & (lines <= whole))
        out[inside] = feeds.select(skipped[inside] + lines[inside] - 1) + 1
        return out

    one, two = byte_after(np.minimum(a, b)), byte_after(np.maximum(a, b))
    chars = lambda x, y: (y - x) - (rest.rank(y) - rest.rank(x))
    return {"n": n, "prefix_bytes": one - begin, "middle_bytes": two - one, "prefix_chars": chars(begin, one), "middle_chars": chars(one, two)}


def _cuts(text: Column, first: Column, second: Column) -> Column:
    def of_batch(texts, first, second):
        made = cut_lines(texts, first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in made.values()], list(made))

    return F.arrow_udf(of_batch, CUTS)(text, first, second)


def draws(id_: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the id: the first groups of the sha256 of `seed:id`; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, rate: int = 100, spm_rate: int = 50, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n, form, prefix_chars, middle_chars, output.

    A text is cut into n lines (an LF belongs to the line it ends), and after two drawn numbers
    of lines into prefix, middle and suffix. `rate` of 100 texts are transformed, `spm_rate` of
    100 of those suffix first:
    psm: <P>prefix<S>suffix<M>middle; spm: <S>suffix<P>prefix<M>middle. Plain is a text that
    isn't drawn, is empty or holds a mark: its output is itself, prefix_chars and middle_chars
    are null. A null text is an empty one, of 0 lines. Draws depend on the id alone: repeated
    rows give repeated results. Parts may be empty; an empty table gives no rows; other
    columns of the caller are left out.
    """
    small_batches(docs)
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    cut = base.withColumn("cut", _cuts(F.col("text"), F.col("h1"), F.col("h2")))
    holds = F.lit(False)
    for mark in MARKS:
        holds = holds | F.contains(F.col("text"), F.lit(mark))
    plain = (F.col("text") == "") | holds | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    formed = cut.withColumn("form", form)
    # parts are slices of the text's bytes
    raw, a, b = F.col("text").cast("binary"), F.col("cut.prefix_bytes").cast("int"), F.col("cut.middle_bytes").cast("int")
    prefix, middle, suffix = F.substring(raw, F.lit(1), a), F.substring(raw, a + 1, b), F.substring(raw, a + b + 1, F.length(raw))
    mark = {c: F.lit(m).cast("binary") for c, m in zip("psm", MARKS, strict=True)}
    output = (
        F.when(F.col("form") == "plain", raw)
        .when(F.col("form") == "psm", F.concat(mark["p"], prefix, mark["s"], suffix, mark["m"], middle))
        .otherwise(F.concat(mark["s"], suffix, mark["p"], prefix, mark["m"], middle))
    )
    shown = lambda name: F.when(F.col("form") != "plain", F.col(f"cut.{name}")).alias(name)
    return formed.select(F.col("doc_id").alias(id_col), F.col("cut.n").alias("n"), "form", shown("prefix_chars"), shown("middle_chars"), output.cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that transform() was given, from its output and form alone. In a transformed
    text each mark stands once: no mark begins within another, and the text holds none."""
    body = F.substring(output, F.lit(len(MARKS[0]) + 1), F.length(output))
    second = lambda mark: (F.split_part(body, F.lit(mark), F.lit(1)), F.split_part(body, F.lit(mark), F.lit(2)))
    (prefix, rest), (suffix, back) = second(MARKS[1]), second(MARKS[0])
    parts = lambda c: (F.split_part(c, F.lit(MARKS[2]), F.lit(1)), F.split_part(c, F.lit(MARKS[2]), F.lit(2)))
    (psm_suffix, psm_middle), (spm_prefix, spm_middle) = parts(rest), parts(back)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, psm_middle, psm_suffix)).otherwise(F.concat(spm_prefix, spm_middle, suffix))


def digests(transformed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The outputs and the texts rebuilt from them as sha256, beside the numbers."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transformed.select(id_col, "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
