"""N-gram Jaccard join with adaptive multi-match prefixes.

A text's set are its distinct word shingles. All sets are put in one order: shingles that many texts hold come last (told
from a count of all shingles in a table of fixed size), otherwise by their numbers. Of a set of n shingles a partner must
hold t = ceil(n * threshold) or more, so the first n - t + l shingles of two linked sets have l in common, for every l.

Every set gets the l that is cheapest by estimate: a longer prefix is more rows to index, but candidates must share
l shingles of it and are fewer to verify. Prefixes meet by shingle. Shingles that few sets have give pairs, which are counted;
pairs with as many as the smaller l of the two asks for are verified on the whole sets. For shingles that many sets have the
prefix is lengthened to the whole set: the sets themselves meet, and a walk over them gives the links of a spanning forest,
never all pairs. Groups too large for a task meet block by block.

Texts with equal sets are one node, so copies cost one row each. The components over all links are those of :mod:`components`.
Sets are known by numbers of 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.llm import shingles
from signalspark.llm.components import connected
from signalspark.llm.shared import slices, written

# Words of a shingle and the least similarity in percent.
WORDS, PERCENT = 4, 85
#: Bits of the number by which shingles are counted, and counters of a block of them.
COUNTERS, BLOCK = 20, 12
#: Sets with a shingle that give pairs; more are hot. Shingles of all sets that a block of a hot group holds.
PAIRS, HOT = 128, 1 << 20
#: What a prefix may ask for, and the model that chooses: bytes of a row of the index, of a pair, of a shingle to verify, and
#: the other texts to expect for a shingle that the counters don't tell from one of its own.
LEAST = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64])
ROW_BYTES, PAIR_BYTES, SHINGLE_BYTES, OTHERS = 24, 24, 8, 0.05
#: Bits of the filter of the sets that are needed (8 MB).
FILTER_BITS = 1 << 26


def set_number(own: np.ndarray) -> int:
    """A set's number: a sum over its shingles, mixed with their count; 0 for none."""
    if not len(own):
        return 0
    total = shingles.mixed(own ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(shingles.mixed(np.array([total ^ np.uint64(len(own) * 0xE7037ED1A0B428DB & (1 << 64) - 1)], np.uint64)).view(np.int64)[0])


def needed(n: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """Shingles that any partner of a set of n must share."""
    return -(-n * percent // 100)


def linked(common: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * common >= percent * (n + m - common)


def texts_to(df: DataFrame, text_column: str, make: Callable[[Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]], Iterator[pa.RecordBatch]], schema: str, *carry: Column, words: int = WORDS) -> DataFrame:
    """Runs ``make`` over batches of ``carry`` and the sets of their texts."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for batch in batches:
            for low, high in slices(batch.column(0)):
                own = batch.slice(low, high - low)
                yield own, list(shingles.sets(own.column(0), words))

    return df.select(F.col(text_column).alias("text"), *carry).mapInArrow(lambda batches: make(pieces(batches)), schema)


def rows_and_counts(pieces: Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """A row for each text (id, k, n), then the task's counters in blocks."""
    counters = np.zeros(1 << COUNTERS, np.int64)
    for batch, own in pieces:
        k, n = np.array([set_number(s) for s in own], np.int64), np.array([len(s) for s in own], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *own])
        counters += np.bincount((every >> np.uint64(64 - COUNTERS)).astype(np.int64), minlength=len(counters))
        yield pa.RecordBatch.from_arrays([pa.array([False] * len(own), pa.bool_()), batch.column(1), pa.array(k), pa.array(n), pa.nulls(len(own), pa.binary())], names=["counts", "id", "k", "n", "numbers"])
    blocks = counters.reshape(-1, 1 << BLOCK)
    some = np.flatnonzero(blocks.any(axis=1))
    none = pa.nulls(len(some), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([True] * len(some), pa.bool_()), none, pa.array(some), none, pa.array([blocks[i].astype(np.int32).tobytes() for i in some], pa.binary())], names=["counts", "id", "k", "n", "numbers"])


def levels(counted: DataFrame) -> np.ndarray:
    """For each counter how many texts its shingles have beyond what chance puts there, from the rows (k, numbers) of all tasks.
    The table has 2 ** COUNTERS numbers whatever the corpus."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[k] = found.get(k, 0) + np.frombuffer(numbers, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["k", "numbers"])

    out = np.zeros((1 << (COUNTERS - BLOCK), 1 << BLOCK), np.int64)
    for r in counted.select("k", "numbers").repartition("k").mapInArrow(summed, "k long, numbers binary").collect():
        out[r["k"]] = np.frombuffer(r["numbers"], np.int64)
    usual = float(np.median(out))
    return np.maximum(out.reshape(-1) - usual - 4 * np.sqrt(usual), 0.0).astype(np.float32)


def prefix(own: np.ndarray, others: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """The prefix of a set and the number of shingles that it asks for. ``others`` has the surplus of every counter."""
    n = len(own)
    t = needed(n, percent)
    surplus = others[own >> np.uint64(64 - COUNTERS)]
    if surplus.any():
        order = np.argsort(np.frexp(surplus)[1] * (surplus > 0), kind="stable")
        own, surplus = own[order], surplus[order]
    least = LEAST[LEAST <= t]
    ends = n - t + least
    few = np.cumsum(np.where(surplus < PAIRS, surplus + OTHERS, 0.0))[ends - 1]
    hot = np.cumsum(surplus >= PAIRS)[ends - 1]
    cost = ROW_BYTES * ends + few * (PAIR_BYTES + SHINGLE_BYTES * n / least) + hot * (SHINGLE_BYTES * n + ROW_BYTES)
    best = int(np.argmin(cost))
    return own[: ends[best]], int(least[best])


def index(df: DataFrame, text_column: str, others: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``shingle``, ``k``, ``n`` and ``least`` for every shingle of the prefix of each set (once in each task)."""
    sent = df.sparkSession.sparkContext.broadcast(others)

    def make(pieces: Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in pieces:
            keys, parts, least = [], [], []
            for own in sets:
                if len(own) and (k := set_number(own)) not in seen:
                    seen.add(k)
                    found, asked = prefix(own, sent.value, percent)
                    keys.append((k, len(own)))
                    parts.append(found)
                    least.append(asked)
            times = [len(p) for p in parts]
            if not parts:
                continue
            k, n = np.array(keys, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(k, times)), pa.array(np.repeat(n, times).astype(np.int32)), pa.array(np.repeat(np.array(least, np.int32), times))], names=["shingle", "k", "n", "least"])

    return texts_to(df, text_column, make, "shingle long, k long, n int, least int", words=words)


def meetings(batches: Iterator[pa.RecordBatch], most: int, percent: int) -> Iterator[pa.RecordBatch]:
    """From the index in the order of shingle and k: pairs (a < b, least) of sets that have a shingle in common and whose sizes
    allow a link; of a shingle that more than ``most`` sets have, each set (a, n in ``least``) with the shingle."""
    kept = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32)]
    hot = None  # a shingle known to be hot, whose rows are still coming

    def found(s: np.ndarray, k: np.ndarray, n: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        nonlocal hot
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])])  # a set that several tasks have sent counts once
        s, k, n, least = s[new], k[new], n[new].astype(np.int64), least[new]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        sizes = np.diff(np.append(starts, len(s)))
        over = (sizes > most) | (s[starts] == hot if hot is not None else False)
        a, b = [], []
        for size in np.unique(sizes[(sizes > 1) & ~over]).tolist():
            at = starts[(sizes == size) & ~over]
            i, j = np.triu_indices(size, 1)
            a.append((at[:, None] + i).reshape(-1))
            b.append((at[:, None] + j).reshape(-1))
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        near = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        a, b = a[near], b[near]
        whole = np.flatnonzero(np.repeat(over, sizes))
        if over[-1]:
            hot = s[-1]
        none = np.zeros(len(whole), bool)
        columns = [np.concatenate([k[a], k[whole]]), np.concatenate([k[b], k[whole]]), np.concatenate([np.minimum(least[a], least[b]), n[whole]]).astype(np.int32), np.concatenate([s[a], s[whole]])]
        pair = np.concatenate([np.ones(len(a), bool), none])
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=~pair), pa.array(columns[2]), pa.array(columns[3], mask=pair)], names=["a", "b", "least", "shingle"])

    for batch in batches:
        kept = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(kept)]
        s = kept[0]
        cut = int(np.searchsorted(s == s[-1], True)) if len(s) else 0  # the last shingle may go on in the next batch
        if cut == 0 and len(s) > 2 * most:  # nothing but one hot shingle: its rows needn't be kept together
            if len(np.unique(kept[1])) > most or hot == s[-1]:
                hot = s[-1]
                cut = len(s) - 1
                while cut and kept[1][cut - 1] == kept[1][-1]:
                    cut -= 1
        if cut:
            yield found(*(x[:cut] for x in kept))
            kept = [x[cut:] for x in kept]
    if len(kept[0]):
        yield found(*kept)


def forest(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (places of two sets) of a spanning forest of the graph whose edges are the links between ``sets``: a walk that takes
    each set off the rest once it is reached. Only sets of fitting sizes are compared."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    _, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    held = np.zeros(int(flat.max(initial=0)) + 1, bool)
    rest = np.ones(len(sets), bool)
    out: list[tuple[int, int]] = []
    for start in range(len(sets)):
        if not rest[start]:
            continue
        rest[start] = False
        front = [start]
        while front:
            f = front.pop()
            low, high = np.searchsorted(sizes, needed(int(sizes[f]), percent)), np.searchsorted(sizes, sizes[f] * 100 // percent, side="right")
            at = low + np.flatnonzero(rest[low:high])
            if not len(at):
                continue
            own = flat[begins[f] : begins[f + 1]]
            held[own] = True
            if 2 * len(at) > high - low:
                common = np.add.reduceat(held[flat[begins[low] : begins[high]]].astype(np.int32), begins[low:high] - begins[low])[at - low]
            else:
                places = np.repeat(begins[at] - np.concatenate([[0], np.cumsum(sizes[at])[:-1]]), sizes[at]) + np.arange(int(sizes[at].sum()))
                common = np.add.reduceat(held[flat[places]].astype(np.int32), np.concatenate([[0], np.cumsum(sizes[at])[:-1]]))
            held[own] = False
            hit = at[linked(common, sizes[f], sizes[at], percent)]
            rest[hit] = False
            front += hit.tolist()
            out += [(int(order[f]), int(order[h])) for h in hit]
    return out


def filter_of(keys: DataFrame) -> np.ndarray:
    """A filter of the numbers in ``k``: a bit for each, FILTER_BITS in all, put together by Spark."""
    place = F.pmod(F.col("k"), F.lit(FILTER_BITS))
    words = keys.select(F.shiftright(place, 5).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 32).cast("int")).alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


def sets_of(df: DataFrame, text_column: str, keys: DataFrame, words: int = WORDS) -> DataFrame:
    """``k`` and ``numbers`` (its shingles, 8 bytes each) of the sets in ``keys`` (and some others, which its filter lets through)."""
    sent = df.sparkSession.sparkContext.broadcast(filter_of(keys))

    def make(pieces: Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sets in pieces:
            found = {}
            for own in sets:
                k = set_number(own) if len(own) else 0
                place = k % FILTER_BITS
                if len(own) and k not in seen and int(sent.value[place >> 5]) >> (place & 31) & 1:
                    seen.add(k)
                    found[k] = own.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["k", "numbers"])

    return texts_to(df, text_column, make, "k long, numbers binary", words=words).dropDuplicates(["k"])


def requests_of(pairs: DataFrame, hot: DataFrame, block: int = HOT) -> DataFrame:
    """Which set (k) is wanted in which group (shingle, i, j). For pairs (a, b) a group has the set a and those to compare it with, its
    ``shingle`` being a and i and j -1. For hot shingles (rows shingle, a, n) a group has all sets of the shingle; they are
    dealt to as many blocks as their size asks for, and two blocks, i and j, are a group."""
    one = F.lit(-1)
    centre = pairs.select("a").distinct().select(F.col("a").alias("k"), F.col("a").alias("shingle"), one.alias("i"), one.alias("j"))
    others = pairs.select(F.col("b").alias("k"), F.col("a").alias("shingle"), one.alias("i"), one.alias("j"))
    blocks = hot.groupBy("shingle").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")
    dealt = hot.join(blocks, "shingle").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return centre.union(others).union(dealt.select("a", "shingle", F.least("own", "other"), F.greatest("own", "other")))


def links_in_groups(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from the sets (group, shingle, i, j, later, k, numbers) in the order of their groups. In a group of pairs the first set
    is compared with each other one as it comes; a group of a hot shingle is walked over as a whole."""
    key, names, held, a, b = None, [], [], [], []

    def walked() -> None:
        for x, y in forest(held, percent) if len(held) > 1 else ():
            a.append(names[x])
            b.append(names[y])

    for batch in batches:
        shingle, i, j, _, k = (batch.column(c).to_pylist() for c in range(1, 6))
        for new, name, numbers in zip(zip(shingle, i, j, strict=True), k, batch.column(6), strict=True):
            own = np.frombuffer(numbers.as_py(), np.uint64)
            if new != key:
                walked()
                key, names, held = new, [], []
            if new[1] < 0 and held:
                common = len(held[0]) + len(own) - len(np.unique(np.concatenate([held[0], own])))
                if linked(common, len(held[0]), len(own), percent):
                    a.append(names[0])
                    b.append(name)
                continue
            names.append(name)
            held.append(own)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a.clear()
        b.clear()
    walked()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(df: DataFrame, text_column: str, counted: DataFrame, words: int = WORDS, percent: int = PERCENT, most: int = PAIRS, block: int = HOT) -> DataFrame:
    """Links (a, b) between the numbers of different sets; their components are those of all links."""
    found = index(df, text_column, levels(counted), words, percent)
    met = found.repartition("shingle").sortWithinPartitions("shingle", "k").mapInArrow(lambda x: meetings(x, most, percent), "a long, b long, least int, shingle long")
    met = written(met, "meetings")
    pairs = met.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("common"), F.max("least").alias("least")).where("common >= least")
    pairs = written(pairs.select("a", "b"), "pairs")
    hot = met.where("b IS NULL").select("shingle", "a", F.col("least").alias("n"))
    wanted = written(requests_of(pairs, hot, block), "wanted")
    # both sides stand by k after one shuffle each
    sent = sets_of(df, text_column, wanted, words).join(wanted, "k")
    grouped = sent.select(F.xxhash64("shingle", "i", "j").alias("group"), "shingle", "i", "j", ((F.col("i") < 0) & (F.col("k") != F.col("shingle"))).alias("later"), "k", "numbers")
    grouped = grouped.repartition("group").sortWithinPartitions("shingle", "i", "j", "later", "k")
    return grouped.mapInArrow(lambda x: links_in_groups(x, percent), "a long, b long").distinct()


def jaccard_join(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, percent: int = PERCENT, most: int = PAIRS, block: int = HOT) -> DataFrame:
    """One row per input row: the id, ``n_shingles`` (distinct shingles of ``words`` words) and ``component_id``, the smallest id
    reached over links between texts whose sets of shingles have a Jaccard similarity of ``percent`` or more, its own included.

    Texts with equal sets are linked. A null, empty or blank text has an empty set and is linked with nothing, not even its
    like; a text of fewer words has one shingle, all of it. A null id stays null and takes part (its component is the smallest
    id that isn't null, or null if there is none). Repeated rows stay repeated; texts of any length are read whole; an empty
    table gives an empty result; other columns are not read.
    """
    rows = texts_to(df, text_column, rows_and_counts, "counts boolean, id long, k long, n long, numbers binary", F.col(id_column).cast("long").alias("id"), words=words)
    first = written(rows, "sets-and-counts", "counts")
    texts = first.where("NOT counts").select("id", "k", "n")
    nodes = texts.where("n > 0").groupBy("k").agg(F.min("id").alias("least"))
    roots = written(connected(links(df, text_column, first.where("counts"), words, percent, most, block)), "roots")
    grouped = nodes.join(roots, nodes.k == roots.node, "left").select("k", "least", F.coalesce("root", "k").alias("root"))
    component = grouped.groupBy("root").agg(F.min("least").alias("component"))
    of = written(grouped.join(component, "root").select("k", "component"), "component-of-set")
    joined = texts.join(of, "k", "left")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), own.alias("component_id"))
