"""Language identification by rank-order profiles.

Every text is ranked by its most frequent letter n-grams (lengths 1 to 3, inside words, a word's edge counting
as a letter); the out-of-place distance to a language's profile adds, for each n-gram of the text, how far its
rank lies from its rank in the profile, or the largest distance if the profile lacks it. The nearest profile wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from signalspark.llm.shared import free_names

#: Fixed values of the method.
UNKNOWN, PROFILE, LABELLED = "und", 400, 20_000
#: What stands for the edge of a word among the letters: no letter has this number, and a packed n-gram keeps it in front.
EDGE = np.uint64(1)
#: Texts are laid out as code points in runs of up to so many characters.
CHARACTERS = 1 << 21


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what isn't a letter."""
    table = np.zeros(0x110000, np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if category(c)[0] == "L":
            table[i] = ord(c.lower()[0])
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as packed code points (21 bits each), ascending, and their counts."""
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([np.zeros(1, np.uint64), codes, np.zeros(1, np.uint64)])
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]  # one edge between two words
    codes[codes == 0] = EDGE
    if len(codes) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    two = (codes[:-1] << np.uint64(21)) | codes[1:]
    three = (two[:-1] << np.uint64(21)) | codes[2:]
    three = three[codes[1:-1] != EDGE]  # none across two words
    found = np.sort(np.concatenate([codes[codes != EDGE], two, three]))
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[first], np.diff(np.append(first, len(found)))


def top(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, ties by n-gram."""
    if len(values) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    return values[np.lexsort((values, -counts))][:most]


class Profiles:
    """Rank of each n-gram in each language's profile."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.languages = sorted(ranked)
        self.size = size
        self.grams = np.array(sorted({g for x in ranked.values() for g in x}), np.uint64)
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int64)
        for k, language in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, np.array(ranked[language], np.uint64)), k] = np.arange(len(ranked[language]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 minus its share of the largest possible distance."""
        values, counts = grams(text) if text else (np.zeros(0, np.uint64), None)
        if not len(values) or not self.languages:
            return UNKNOWN, 0.0
        ranked = top(values, counts, self.size)
        place = np.searchsorted(self.grams, ranked)
        place[place == len(self.grams)] = 0
        place[self.grams[place] != ranked] = len(self.grams)
        theirs = self.ranks[place]
        apart = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(ranked))[:, None]))
        distance = apart.sum(axis=0)
        best = int(np.argmin(distance))
        return self.languages[best], float(1 - distance[best] / (self.size * len(ranked)))


def learn(df: DataFrame, learn_from: Column, label: str = "lang", text: str = "text", id_column: str = "doc_id", size: int = PROFILE, labelled: int = LABELLED, most_languages: int = 2_000) -> Profiles:
    """Profiles from the rows with ``learn_from``, a label and a text: about ``labelled`` rows of each label at
    most, taken by a hash of the id (the documented bound of the sample). The driver gets ``size`` n-grams of
    each language; more than ``most_languages`` labels are an error."""
    rows = df.select(F.col(id_column).alias("i"), F.col(label).cast("string").alias("l"), F.col(text).alias("t")).where(learn_from & F.col(label).isNotNull() & F.col(text).isNotNull())
    found = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(found) > most_languages:
        raise ValueError(f"{label} has more than {most_languages} values")
    if not found:
        return Profiles({}, size)
    share = F.create_map(*[x for l, n in found.items() for x in (F.lit(l), F.lit(min(1.0, labelled / n)))])
    sample = rows.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < share[F.col("l")] * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            pairs = sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), key=lambda x: x[0])
            for language, own in groupby(pairs, key=lambda x: x[0]):
                texts = [x[1] for x in own]
                at = 0
                while at < len(texts):
                    some, chars = [], 0
                    while at < len(texts) and (not some or chars + len(texts[at]) < CHARACTERS):
                        some.append(texts[at])
                        chars += len(texts[at])
                        at += 1
                    values, counts = grams("\n".join(some))
                    if language in held:
                        values, where = np.unique(np.concatenate([held[language][0], values]), return_inverse=True)
                        counts = np.bincount(where, np.concatenate([held[language][1], counts])).astype(np.int64)
                    held[language] = values, counts
        for language, (values, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(values)), pa.array(values.astype(np.int64)), pa.array(counts)], names=["l", "g", "n"])

    counted = sample.select("l", "t").mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))
    ranked: dict[str, list[int]] = {}
    for r in counted.withColumn("k", rank).where(F.col("k") <= size).select("l", "g", "k").collect():
        ranked.setdefault(r["l"], []).append((r["k"], r["g"]))
    return Profiles({l: [g for _, g in sorted(x)] for l, x in ranked.items()}, size)


def predict(df: DataFrame, profiles: Profiles, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of each row, then the predicted language and a score from 0 to 1 (how near the
    profile is). A text that is null or has no letter, and any text if nothing was learned, gets ``und`` and 0.
    Equal distances go to the smaller language. Repeated rows stay repeated; an empty table gives an empty
    result; only ``keep`` and the text are read. There is no shuffle."""
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias(free_names(df, "text_read")[0]))
    sent = df.sparkSession.sparkContext.broadcast(profiles)
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:-1]) + f"`{names[0]}` string, `{names[1]}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found = [own.predict(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = batch.columns[:-1] + [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1] + list(names))

    return kept.mapInArrow(run, schema)


def remainder(column: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % by
