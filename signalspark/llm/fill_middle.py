"""Fill-in-middle transformation: a text's middle is moved to its end, so that a model learns to fill gaps.

Whole batches are worked on at once, on the UTF-8 bytes of the Arrow column. A table gives each byte's class (letter, other
first byte of a code point, further byte); a token starts at a first byte unless letter follows letter in the same text;
running sums of the starts, counted anew for each text, number the tokens, and one ``searchsorted`` finds the bytes at which
all texts of the batch are cut. Only the slices are then joined row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.llm.shared import free_names, slices

# The marks of prefix, suffix and middle; percent of plain texts, and of those cut that have the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, SUFFIX_FIRST = 10, 20

LETTER, FURTHER = 1, 2
CLASS = np.zeros(256, np.uint8)
CLASS[0x80:0xC0] = FURTHER
for first in b"Aa":
    CLASS[first : first + 26] = LETTER


def draws(id_: Column, seed: int = 1, n: int = 4) -> list[Column]:
    """``n`` numbers of 32 bits from the SHA-256 of the seed, a colon and the id (nothing for a null one)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold one of the marks."""
    out = np.zeros(len(offsets) - 1, bool)
    at = np.flatnonzero(data[:-2] == ord("<"))
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], np.frombuffer(b"PSM", np.uint8))]
    row = np.searchsorted(offsets, at, side="right") - 1
    out[row[at + 3 <= offsets[row + 1]]] = True
    return out


def cut_points(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, the bytes behind its prefix and behind its middle, and the code points of both."""
    kind = CLASS[data]
    letter = kind == LETTER
    start = kind != FURTHER
    lead = np.zeros(len(data) + 1, np.int32)
    np.cumsum(start, out=lead[1:])
    inside = letter[1:] & letter[:-1]
    begins = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
    inside[begins - 1] = False  # a text's first byte follows none
    start[1:] &= ~inside
    upto = np.cumsum(start, dtype=np.int32)
    before = np.concatenate([[0], upto])[offsets]  # tokens before each text, from which its own are counted
    n = np.diff(before).astype(np.int64)
    one, two = h1 % (n + 1), h2 % (n + 1)
    # token k of a text starts at the byte where its running sum reaches k + 1; behind the last one the text ends
    points = [np.minimum(np.searchsorted(upto, before[:-1] + k + 1), offsets[1:]) for k in (np.minimum(one, two), np.maximum(one, two))]
    a, b = points
    return n, a, b, lead[a] - lead[offsets[:-1]], lead[b] - lead[a]


def transform(texts: pa.Array, h: list[np.ndarray], plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple[pa.Array, ...]:
    """For a column of texts: tokens, form, code points of prefix and middle (null where plain), output."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    whole = memoryview(texts.buffers()[2] or b"")[low:high]
    offsets = offsets - low
    n, a, b, prefix, middle = cut_points(np.frombuffer(whole, np.uint8), offsets, h[0], h[1])
    uncut = (offsets[1:] == offsets[:-1]) | marked(np.frombuffer(whole, np.uint8), offsets) | (h[2] % 100 >= 100 - plain)
    spm = ~uncut & (h[3] % 100 < suffix_first)
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    parts: list[bytes | memoryview] = []
    for start, x, y, end, as_is, turned in zip(offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), uncut.tolist(), spm.tolist(), strict=True):
        if as_is:
            parts.append(whole[start:end])
        elif turned:
            parts += (s, whole[y:end], p, whole[start:x], m, whole[x:y])
        else:
            parts += (p, whole[start:x], s, whole[y:end], m, whole[x:y])
    sizes = np.diff(offsets) + np.where(uncut, 0, len(p) + len(s) + len(m))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    output = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(parts)))
    form = pa.array(np.where(uncut, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string())
    return pa.array(n), form, pa.array(prefix.astype(np.int64), mask=uncut), pa.array(middle.astype(np.int64), mask=uncut), output.cast(pa.string())


def fill_middle(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 1, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per input row: the id, ``n`` (tokens ``[A-Za-z]+|[^A-Za-z]``), ``form`` (plain, psm or spm), ``prefix_chars`` and
    ``middle_chars`` in code points (null where plain), and ``output``.

    Where a text is cut follows from its id and the seed alone, so repeated rows have equal results and reruns agree; a null
    id draws as an empty one. A null or empty text is plain with 0 tokens and an empty output; so is, unchanged, a text that
    holds a mark. Texts of any length are cut whole; an empty table gives an empty result; other columns are not read.
    Nothing is shuffled.
    """
    names = free_names(df.select(id_column), "n", "form", "prefix_chars", "middle_chars", "output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                own = batch.slice(low, high - low)
                found = transform(own.column(1), [own.column(2 + i).to_numpy() for i in range(4)], plain, suffix_first)
                yield pa.RecordBatch.from_arrays([own.column(0), *found], names=[id_column, *names])

    rows = df.select(F.col(id_column), F.col(text_column), *[h.alias(f"__h{i}") for i, h in enumerate(draws(F.col(id_column), seed))])
    types = ("long", "string", "long", "long", "string")
    return rows.mapInArrow(run, f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda *places: F.concat(*[F.get(part, F.lit(i)) for i in places])
    return F.when(form == "plain", output).when(form == "psm", at(1, 3, 2)).otherwise(at(2, 3, 1))


def digests(transformed: DataFrame) -> DataFrame:
    """Rows of :func:`fill_middle` with SHA-256 digests of the output and of the text rebuilt from it instead of the output."""
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return transformed.withColumns({"output_sha256": sha(F.col("output")), "restored_sha256": sha(restored(F.col("output"), F.col("form")))}).drop("output")


def duckdb_sql() -> str:
    """The digests in DuckDB, with the marks and shares above."""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256(concat('1:', doc_id)) AS x FROM documents),
h AS (
  SELECT *, len(w) AS n, cast('0x' || substr(x, 1, 8) AS bigint) AS h1, cast('0x' || substr(x, 9, 8) AS bigint) AS h2,
         cast('0x' || substr(x, 17, 8) AS bigint) AS h3, cast('0x' || substr(x, 25, 8) AS bigint) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {100 - PLAIN} THEN 'plain'
              WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS prefix, coalesce(array_to_string(w[a + 1:b], ''), '') AS middle, coalesce(array_to_string(w[b + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, cast(n AS bigint) AS n, form, CASE WHEN form <> 'plain' THEN cast(length(prefix) AS bigint) END AS prefix_chars, CASE WHEN form <> 'plain' THEN cast(length(middle) AS bigint) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""
