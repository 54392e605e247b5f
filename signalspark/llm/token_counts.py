"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is cut only where the tokenizer's own pre-split must cut: in front of ASCII white space that follows a
character which is no white space of any kind. No pre-split piece holds white space behind other characters, and
nothing in the pre-split looks further ahead than the white space itself, so the parts' lengths add up to the length
of the whole. Each distinct part of a batch is encoded once; batches are filled up to a number of bytes, so that a few
long texts do not make a batch large.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "{id} long, n_bytes long, n_tokens long, over_limit boolean"

#: Parts: ASCII white space and what follows up to the next of it.
PARTS = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space of Unicode besides these four: a part may not end at one of them.
OTHER_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")


def parts_of(text: str) -> list[str]:
    """Parts whose token counts add up to that of the text."""
    parts = PARTS.findall(text)
    if not OTHER_SPACE.search(text):
        return parts
    out: list[list[str]] = []
    for part in parts:
        if out and OTHER_SPACE.match(out[-1][-1][-1]):
            out[-1].append(part)
        else:
            out.append([part])
    return list(map("".join, out))


def load_encoder(path: str):
    """A function from texts to their token counts; the suffix says which library reads the file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def byte_batches(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Consecutive texts whose UTF-8 bytes together stay under ``most``; a longer text is a batch of its own."""
    batch, held = [], 0
    for text in texts:
        size = len(text.encode("utf-8", "surrogatepass"))
        if batch and held + size > most:
            yield batch
            batch, held = [], 0
        batch.append(text)
        held += size
    if batch:
        yield batch


class Counter:
    """Counts tokens; remembers the counts of up to ``remembered`` short parts."""

    def __init__(self, path: str, splits: bool, batch_bytes: int = 1 << 20, remembered: int = 400_000):
        self.encode, self.splits, self.batch_bytes, self.remembered = load_encoder(path), splits, batch_bytes, remembered
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [n for batch in byte_batches(texts, self.batch_bytes) for n in self.encode(batch)]
        out: list[int] = []
        for batch in byte_batches(texts, self.batch_bytes):
            parts = [parts_of(text) for text in batch]
            if len(self.known) > self.remembered:
                self.known = {}
            new = list(set().union(*parts).difference(self.known))
            long = {}
            for some in byte_batches(new, self.batch_bytes):
                for part, n in zip(some, self.encode(some), strict=True):
                    (self.known if len(part) <= 64 else long)[part] = n
            if long:
                out += [sum(long[x] if len(x) > 64 and x in long else self.known[x] for x in p) for p in parts]
            else:
                get = self.known.__getitem__
                out += [sum(map(get, p)) for p in parts]
        return out


def token_counts(df: DataFrame, tokenizer: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text", splits: bool | None = None) -> DataFrame:
    """One row per input row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` as the library of ``tokenizer`` counts the
    whole text, and whether that exceeds ``limit``. No begin, end or other added token; special strings inside
    a text count as the library's default has it; nothing is truncated or padded.

    ``splits``: whether texts may be cut at white space, which holds for byte-level BPE without a normalizer
    (.json, the default there) and not for sentencepiece (.model).

    A null or empty text has 0 bytes and 0 tokens; a null id stays null; repeated rows stay repeated; an empty
    table gives an empty result; other columns, whatever their names, are not read. A text of any length is
    counted whole. There is no shuffle; a lost task is simply run again.
    """
    splits = not tokenizer.endswith(".model") if splits is None else splits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer, splits)
        for batch in batches:
            column = batch.column(1)
            texts = [x or "" for x in column.to_pylist()]
            counts = counter.counts(texts)
            sizes = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=[id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(df[id_column].cast("long"), df[text_column]).mapInArrow(run, SCHEMA.format(id=id_column))
