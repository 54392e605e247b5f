"""SimHash near-dedup with deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most 4 bits are cut into 3 segments; one segment then differs in
at most one bit. So each segment is indexed in all forms with one bit masked out: the two fingerprints share a
form, the forms are matched by equality, and every match is verified on the whole fingerprint.

Fingerprints that share a form stand together in one sorted partition. There a walk over the group finds
which of them are linked at 4 bits or less and gives the links of a spanning forest: the components are those
of all links, while a group of many near copies gives no more links than it has members. Groups over a bound
are cut first: of the bits that the key leaves open, dealt to five parts, two linked fingerprints have one part in
common, and so on with the bits that are open then, until every group is small: fingerprints are distinct, so a
group with r open bits has no more than 2 ** (r + 1) of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.llm.components import connected
from signalspark.llm.shared import LOWER_TABLE, free_names, written

#: Bits that may differ, words in a shingle, seed of XXH64, and the cuts of the 64 bits.
BITS, WORDS, SEED = 4, 4, 42
SEGMENTS = ((0, 22), (22, 43), (43, 64))
#: Times that a large group is cut at most.
CUTS = 6


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text as an unsigned number; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split() if text else []
    if not found:
        return 0
    line = b" ".join(found)
    if len(found) <= words:
        return xxh64_intdigest(line, SEED)
    starts = np.zeros(len(found) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1, out=starts[1:])
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:-words].tolist(), (starts[words:] - 1).tolist(), strict=True)], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        set_bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id``, ``fp`` (the fingerprint's 64 bits as a signed long) of every row, and the long columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=["id", "fp", *keep])

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), *[F.col(f"`{c}`") for c in keep])
    return rows.mapInArrow(run, "id long, fp long" + "".join(f", `{c}` long" for c in keep))


def bits_of(fp: Column, low: int, high: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))


def variants(fp: Column, segments: tuple[tuple[int, int], ...] = SEGMENTS) -> Column:
    """All keys (segment and masked bit in the upper part, the segment's other bits below) of a fingerprint."""
    keys = [F.lit((low + i) << 32).bitwiseOR(bits_of(fp, low, high).bitwiseAND(F.lit(((1 << (high - low)) - 1) ^ (1 << i)))) for low, high in segments for i in range(high - low)]
    return F.array(*keys)


def forest(fps: np.ndarray, bits: int = BITS, width: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph whose nodes are ``fps`` and whose edges join those that differ in
    at most ``bits`` bits: a walk that takes each fingerprint off the rest once it is reached."""
    rest, out_a, out_b = fps, [], []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step = max(1, width // len(rest))
            some, front = front[:step], front[step:]
            near = np.bitwise_count(some[:, None] ^ rest[None, :]) <= bits
            hit = near.any(axis=0)
            if hit.any():
                out_a.append(some[near[:, hit].argmax(axis=0)])
                out_b.append(rest[hit])
                front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    empty = np.zeros(0, fps.dtype)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def forests(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within each run of equal keys of a partition that is sorted by key; of a run with over
    ``most`` members only its key (a, with b null)."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]  # most groups that have any link
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= BITS]
        found = [(fps[near], fps[near + 1])]
        some = sizes > 2 if most is None else (sizes > 2) & (sizes <= most)
        found += [forest(fps[s : s + n]) for s, n in zip(starts[some], sizes[some], strict=True)]
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        over = keys[starts[sizes > most]] if most is not None else keys[:0]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, over])), pa.concat_arrays([pa.array(b), pa.nulls(len(over), pa.int64())])], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        if len(keys) and keys[0] != keys[-1]:  # the last run may go on in the next batch
            cut = int(np.searchsorted(keys == keys[-1], True))
            yield links(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
        elif most is not None:
            keys, fps = keys[: most + 1], fps[: most + 1]
    if len(keys):
        yield links(keys, fps)


def open_masks(path: int) -> list[int]:
    """The parts (as masks) of the bits that are open after a ``path`` of choices: the segment of the first key, then in
    turn one of the parts that the open bits were dealt to. The path has a digit to the base 7 for each, from 1."""
    digits = []
    while path:
        path, digit = divmod(path, 7)
        digits.append(digit - 1)
    low, high = SEGMENTS[digits.pop()]
    rest = [i for i in range(64) if not low <= i < high]
    parts = np.array_split(rest, BITS + 1)
    while digits:
        gone = set(parts[digits.pop()].tolist())
        rest = [i for i in rest if i not in gone]
        parts = np.array_split(rest, BITS + 1)
    return [sum(1 << int(i) for i in part) for part in parts]


def cut_further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For k, path and fp: the five paths that go on from there, each with the bits of its part."""
    for batch in batches:
        k, path, fp = (batch.column(i).to_numpy() for i in range(3))
        for own in np.unique(path).tolist():
            at = np.flatnonzero(path == own)
            for j, mask in enumerate(open_masks(own)):
                bits = (fp[at].view(np.uint64) & np.uint64(mask)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k[at]), pa.array(np.full(len(at), own * 7 + j + 1)), pa.array(bits), pa.array(fp[at])], names=["k", "path", "bits", "fp"])


def linked(distinct: DataFrame, most: int = 20_000) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column ``fp`` whose components are those of all links
    at :data:`BITS` bits or less.

    Keys with more than ``most`` fingerprints are cut further (:func:`open_masks`), which gives five rows for each of
    their fingerprints and smaller groups, until no group is over the bound. After :data:`CUTS` cuts at most 13 bits are
    open and no group can be large any more."""
    segment = F.lit(len(SEGMENTS))
    for n in range(len(SEGMENTS) - 1, 0, -1):
        segment = F.when(F.shiftright("k", 32) < SEGMENTS[n][0], n).otherwise(segment)
    keyed, found = distinct.select(F.explode(variants(F.col("fp"))).alias("k"), "fp").select("k", segment.cast("long").alias("path"), "fp"), []
    for cuts in range(CUTS + 1):
        bound = most if cuts < CUTS else None
        near = keyed.select("k", "fp").repartition("k").sortWithinPartitions("k").mapInArrow(lambda x, bound=bound: forests(x, bound), "a long, b long")
        found.append(written(near, "near"))
        over = found[-1].where("b is null").select(F.col("a").alias("k"))
        if bound is None or over.isEmpty():
            break
        further = keyed.join(over, "k").select("k", "path", "fp").mapInArrow(cut_further, "k long, path long, bits long, fp long")
        keyed = further.select(F.xxhash64("k", "path", "bits").alias("k"), "path", "fp")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.where("b is not null").distinct()


def component_of(prints: DataFrame) -> DataFrame:
    """``fp``, ``root`` (a fingerprint) and ``component_id`` of every fingerprint of ``prints`` (id, fp)."""
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = written(connected(linked(nodes.select("fp"))), "roots")
    grouped = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(grouped.join(component, "root").select("fp", "root", "component_id"), "component-of-fingerprint")


def components(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: the id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id that
    is reached over links between fingerprints that differ in at most 4 bits, its own included.

    Rows with equal fingerprints are one node, so copies cost one row each whatever their number. A null or
    empty text, or one of white space, has the fingerprint zero and is linked like any other; a null id stays
    null and takes part (its component is the smallest id that isn't null, or null if there is none). Repeated
    rows stay repeated; an empty table gives an empty result; other columns are not read.
    """
    prints = written(fingerprints(df, id_column, text_column), "fingerprints")
    of = component_of(prints)
    return prints.join(of, "fp").select(F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def first_of_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of ``df``, with its columns, for each component: that with the smallest id; of rows equal in it
    the first by fingerprint, then any one. Rows with a null id come last, so one stays only where a component
    has no other; null and empty texts are one component; an empty table stays empty.

    The numbers of the rows to drop are joined as Spark chooses from the size of their file: sent to all tasks while they are
    few, so that no text moves, and merged by number beyond that."""
    (row,) = free_names(df, "row")
    numbered = written(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    prints = written(fingerprints(numbered, id_column, text_column, keep=(row,)).withColumnRenamed(row, "at"), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "at")).alias("best"))
    rooted = written(nodes.join(component_of(prints.select("id", "fp")), "fp"), "rooted")
    first = rooted.groupBy("root").agg(F.min("best")["at"].alias("keep"))
    keep = rooted.select("fp", "root").join(first, "root").select("fp", "keep")
    gone = written(prints.join(keep, "fp").where("at <> keep").select(F.col("at").alias(row)), "gone")
    return numbered.join(gone, row, "left_anti").select(*df.columns)
