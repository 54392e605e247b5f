"""Language-model scoring: a causal self-attention model on subword ids, beside a word-unigram base.

A word enters the model by its subwords: each subword of the (fixed) tokenizer has a vector of what stands in the
same texts, and a word's vector is the sum of them. Words fall into classes by the direction of that vector. The
network reads the vectors of the words before, in overlapping windows, and predicts the next word's class; a word
that the training texts have then takes its share of its class, and one that they lack is spelled in subwords:

    p(word) = (1 - new) * p(class | words before) * count(word) / count(class), or new * p(spelling)

where ``new`` is the share of words seen once (Good-Turing). The network is trained in numpy on all training texts:
they are dealt to rounds that double in size, so that their number grows with the corpus; in a round every task
trains a copy on its own part, the copies are averaged in Spark, and the next round goes on from there.

Texts are cut and encoded once: they are written in batches, each with its distinct words, their subwords' ids and the
places of the texts' words among them. Counts, vectors, training and scoring read these, and work out what hangs on a word alone
once for each distinct word of a batch.

Counts are those of all training texts. Those of the frequent words (a bounded number) are looked up where a batch
is read; the rare ones' are joined, with the same result, so that no task needs the whole vocabulary. What the driver
and every task hold is bounded by the tokenizer's ids, whatever the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.llm import attention
from signalspark.llm.shared import drop_written, slices, written
from signalspark.llm.token_counts import OTHER_SPACE

#: Stands for the end of a text among the words; no word holds white space.
END = b"\n"
#: Class of the end.
ENDING = attention.CLASSES - 1
#: Characters of the first round of training, each further one twice as long.
ROUND_CHARACTERS = 8_000_000
#: Words whose counts are sent to every task at most; words a task remembers; bytes of texts that make a batch.
FREQUENT, REMEMBERED, GROUP = 200_000, 300_000, 1_000_000
#: Rounds of the batches that teach counts only (null and empty texts) and of those that teach nothing.
EMPTY, HELD_OUT = -1, -2
#: Groups of the subwords by which a spelling goes on.
SPELLERS = 12


class Encoder:
    """Subword ids of words by a public tokenizer's ranks. The end of a text has the id after the last one."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encode = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.end = len(ranks)
        self.opens = np.zeros(self.end + 1, bool)
        self.opens[[i for b, i in ranks.items() if b.startswith(b" ")]] = True

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of words in a row, and how many each has. The words are encoded as one text, in which a token
        with a space opens each of them. A word that holds white space of Unicode could run into the next one,
        so such words, and the end, are encoded one by one."""
        if END in words:
            i = words.index(END)
            (a, n), (b, m) = self.ids(words[:i]), self.ids(words[i + 1 :])
            return np.concatenate([a, [self.end], b]), np.concatenate([n, [1], m])
        text = (b" " + b" ".join(words)).decode("utf-8", "replace") if words else ""
        if not OTHER_SPACE.search(text):
            flat = np.array(self.encode(text), np.int64)
            return flat, np.diff(np.append(np.flatnonzero(self.opens[flat]), len(flat)))
        odd = [i for i, w in enumerate(words) if OTHER_SPACE.search(w.decode("utf-8", "replace"))]
        parts, sizes, at = [], [], 0
        for i in [*odd, len(words)]:
            flat, n = self.ids(words[at:i])
            own = [self.encode(" " + words[i].decode("utf-8", "replace"))] if i < len(words) else []
            parts += [flat, *own]
            sizes += [n, *([len(x)] for x in own)]
            at = i + 1
        return np.concatenate(parts).astype(np.int64), np.concatenate(sizes).astype(np.int64)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """Read once in each worker process."""
    return Encoder(path)


class Index(dict):
    """Numbers words as they are asked for; ``new`` has those not seen before."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


class Met:
    """Subword ids of the words that a worker process has met."""

    def __init__(self, tokenizer: str):
        self.encoder = encoder_of(tokenizer)
        self.clear()

    def clear(self) -> None:
        self.index, self.flat, self.starts = Index(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Like :meth:`Encoder.ids`."""
        if len(self.index) > REMEMBERED:
            self.clear()
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.index.new:
            flat, sizes = self.encoder.ids(self.index.new)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.index.new = []
        first = self.starts[at]
        sizes = self.starts[at + 1] - first
        return self.flat[np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())], sizes


@lru_cache(maxsize=1)
def met_of(tokenizer: str) -> Met:
    """Goes on from task to task: a word's ids do not depend on the task."""
    return Met(tokenizer)


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 in two or four bytes each."""
    return x.astype(np.uint16 if x.max(initial=0) < 1 << 16 else np.uint32).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32).astype(np.int64)


def cut_up(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The distinct words of some texts, joined by spaces, the first of them :data:`END`; the places among these of the texts'
    words, each text followed by its end; and how many each text has. Words are runs of bytes other than white space, A-Z
    lower-cased; a null text is empty."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = found.flatten()
    own = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(found)))
    full = pc.greater(pc.binary_length(words), 0)  # white space at an edge of a text leaves an empty word
    coded, own = words.filter(full).dictionary_encode(), own[np.asarray(full)]
    sizes = np.bincount(own, minlength=len(texts)) + 1
    places = np.zeros(sizes.sum(), np.int64)
    places[np.arange(len(own)) + own] = np.asarray(coded.indices) + 1
    distinct = coded.dictionary.cast(pa.binary())
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), b" ")[0].as_py()
    return END + b" " + joined if joined else END, places, sizes


DOCS = pa.list_(pa.struct([("row", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64())]))
BATCH = "round int, docs array<struct<row:long,id:long,held_out:boolean,n_tokens:long>>, words binary, sizes binary, ids binary, places binary"


def batched(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Batches of the texts of ``row``, ``id``, ``held_out``, ``text`` and ``round``, each of one round: ``docs``; the distinct
    ``words``, joined by spaces; the ``sizes`` of their subwords and these ones' ``ids``; and the ``places`` of :func:`cut_up`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        filled: Counter[int] = Counter()

        def batch_of(number: int) -> pa.RecordBatch:
            filled.pop(number)
            part = pa.Table.from_batches(held.pop(number)).combine_chunks()
            row, i, out, texts = (part.column(k).combine_chunks() for k in range(4))
            words, places, n = cut_up(texts)
            ids, sizes = met_of(tokenizer).ids(words.split(b" "))
            docs = pa.StructArray.from_arrays([row, i, out, pa.array(n)], fields=list(DOCS.value_type))
            blobs = (words, packed(sizes), packed(ids), packed(places))
            columns = [pa.array([number], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), docs), *(pa.array([x], pa.binary()) for x in blobs)]
            return pa.RecordBatch.from_arrays(columns, names=["round", "docs", "words", "sizes", "ids", "places"])

        for batch in batches:
            for low, high in slices(batch.column(3), GROUP // 4):
                part = batch.slice(low, high - low)
                for number in pc.unique(part.column(4)).to_pylist():
                    own = part.filter(pc.equal(part.column(4), number))
                    held.setdefault(number, []).append(own)
                    filled[number] += pc.sum(pc.binary_length(own.column(3))).as_py() or 0
                    if filled[number] >= GROUP:
                        yield batch_of(number)
        for number in list(held):
            yield batch_of(number)

    return rows.select("row", "id", "held_out", "text", "round").mapInArrow(run, BATCH)


def starts_of(sizes: np.ndarray) -> np.ndarray:
    """Place of the first word of each text, and after the last."""
    return np.concatenate([[0], np.cumsum(sizes)])


def firsts(starts: np.ndarray) -> np.ndarray:
    """For each word the place of its text's first word."""
    return np.repeat(starts[:-1], np.diff(starts))


def unpacked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For ``docs``, ``sizes``, ``ids`` and ``places`` first among the columns: the texts (a struct for each), the subwords' ids and sizes of the distinct
    words, the texts' starts and the places of their words; and for every further column its value."""
    for batch in batches:
        for i in range(len(batch)):
            docs, (sizes, ids, places, *more) = batch.column(0)[i].values, (column[i].as_py() for column in batch.columns[1:])
            starts = starts_of(np.asarray(docs.field("n_tokens")))
            places = unpacked(places, starts[-1])
            sizes = unpacked(sizes, places.max() + 1)
            yield docs, unpacked(ids, sizes.sum()), sizes, starts, places, *more


def sums_by(vectors: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For every word (of so many subwords) the sum of its subwords' vectors, first to last. Subwords are added place by place,
    and what a long word has beyond the eighth by itself."""
    first = np.cumsum(sizes) - sizes
    out, left = vectors.take(flat[first], axis=0), np.flatnonzero(sizes > 1)
    for k in range(1, 8):
        out[left] += vectors.take(flat[first[left] + k], axis=0)
        left = left[sizes[left] > k + 1]
    for i in left.tolist():
        out[i] += vectors.take(flat[first[i] + 8 : first[i] + sizes[i]], axis=0).sum(axis=0)
    return out


class Subwords:
    """What is known of the tokenizer's ids: their ``vectors``, the ``centers`` of the classes, the group of each for
    spelling, and the log shares of what follows a group (its last row: the start of a word; the last id: its end)."""

    def __init__(self, vectors: np.ndarray, centers: np.ndarray, group: np.ndarray, spelling: np.ndarray):
        self.vectors, self.centers, self.group, self.spelling = vectors.astype(np.float32), centers.astype(np.float32), group, spelling

    def words(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vector and class of words given by their subwords' ids."""
        if not len(sizes):
            return np.zeros((0, attention.WIDTH), np.float32), np.zeros(0, np.int64)
        sums = sums_by(self.vectors, flat, sizes)
        length = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        return (sums / np.maximum(1.0, length)).astype(np.float32), (sums @ self.centers.T).argmax(axis=1)

    def of_batch(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of a batch's words, whose first is the end."""
        vectors, classes = self.words(flat, sizes)
        vectors[0], classes[0] = 0, ENDING
        return vectors, classes

    def spelled(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Natural log of the probability of the words' spellings."""
        if not len(sizes):
            return np.zeros(0)
        first, last = np.cumsum(sizes) - sizes, np.cumsum(sizes) - 1
        before = np.empty(len(flat), np.int64)
        before[1:] = self.group[flat[:-1]]
        before[first] = SPELLERS
        logs = np.add.reduceat(self.spelling[before, flat].astype(float), first)
        return logs + self.spelling[self.group[flat[last]], -1]


def word_counts(texts: DataFrame) -> DataFrame:
    """``w``, ``n``: how often each word stands in the batches, and :data:`END` once for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for words, places, docs in zip(*(column.to_pylist() for column in batch.columns[:2]), batch.column(2), strict=True):
                found = np.bincount(unpacked(places, sum(docs.values.field("n_tokens").to_pylist()))).tolist()
                words = words.split(b" ")
                held.update(zip(words, map(add, found, map(held.get, words, repeat(0))), strict=True))
                if len(held) > REMEMBERED:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["w", "n"])
                    held = {}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["w", "n"])

    return texts.select("words", "places", "docs").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


def vectors_of(texts: DataFrame, tokenizer: str, width: int = attention.WIDTH) -> np.ndarray:
    """A vector for each id of the tokenizer: what stands in the same texts. Every id has a random direction; a text's
    is the mean over its words' first subwords, and an id's vector the mean over its occurrences less that of all,
    shorter for rare ids. The driver gets one vector for each id."""
    total = encoder_of(tokenizer).end + 1
    directions = np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (total, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((total, width)), np.zeros(total)
        for _, flat, sizes, starts, places in unpacked_batches(batches):
            n = np.diff(starts) - 1  # without the ends
            opening = directions.take(flat[np.cumsum(sizes) - sizes], axis=0)
            opening[0] = 0
            of_text = np.add.reduceat(opening.take(places, axis=0), starts[:-1]) / np.maximum(1, n)[:, None]
            counts = np.bincount(places)
            counts[0] = 0
            for k in range(width):
                of_word = np.bincount(places, np.repeat(of_text[:, k], n + 1))
                of_word[0] = 0
                sums[:, k] += np.bincount(flat, np.repeat(of_word, sizes), total)
            seen += np.bincount(flat, np.repeat(counts, sizes), total)
        held = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(seen[held]), pa.array(list(sums[held]), pa.list_(pa.float64()))], names=["id", "n", "v"])

    each = texts.select("docs", "sizes", "ids", "places").mapInArrow(run, "id long, n double, v array<double>").groupBy("id")
    found = each.agg(F.sum("n").alias("n"), *[F.sum(F.get("v", F.lit(k))).alias(f"v{k}") for k in range(width)]).collect()
    out = np.zeros((total, width))
    if found:
        ids, n, sums = np.array([r["id"] for r in found]), np.array([r["n"] for r in found]), np.array([r[2:] for r in found])
        out[ids] = (sums / n[:, None] - sums.sum(axis=0) / n.sum()) * (n / (n + 20))[:, None]
        out /= max(1e-9, math.sqrt(((out[ids] ** 2).sum(axis=1) * n).sum() / n.sum()))
    return out


def clustered(vectors: np.ndarray, weight: np.ndarray, most: int, steps: int = 20) -> np.ndarray:
    """Centers (unit length) of up to ``most`` directions of the vectors; those that stay without a vector are zero."""
    length = np.sqrt((vectors**2).sum(axis=1))
    held = np.flatnonzero((length > 1e-6) & (weight > 0))
    centers = np.zeros((most, vectors.shape[1]))
    if not len(held):
        return centers
    unit, w = vectors[held] / length[held, None], weight[held] * length[held]
    chosen = [int(np.argmax(w))]  # the heaviest, then always the one that is farthest off, by weight
    near = unit @ unit[chosen[0]]
    while len(chosen) < min(most, len(held)):
        chosen.append(int(np.argmax(w * (1 - near))))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    now = unit[chosen]
    for _ in range(steps):
        own = (unit @ now.T).argmax(axis=1)
        sums = np.stack([np.bincount(own, unit[:, k] * w, len(now)) for k in range(unit.shape[1])], axis=1)
        now = np.where((size := np.sqrt((sums**2).sum(axis=1, keepdims=True))) > 0, sums / np.maximum(size, 1e-12), now)
    centers[: len(now)] = now
    return centers


def tallies(counts: DataFrame, tokenizer: str, subwords: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """From the words' counts: how many running words each class has, and for each group of subwords (the last: the start of
    a word) how many words have each id after it (the last: the end). The driver gets no more rows than these
    two tables have cells."""
    total = encoder_of(tokenizer).end + 1
    cells = (SPELLERS + 1) * (total + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, found = encoder_of(tokenizer), np.zeros(cells + attention.CLASSES, np.int64)
        for batch in batches:
            words = batch.column(0).to_pylist()
            plain = [i for i, w in enumerate(words) if w != END]
            if len(plain) < len(words):
                found[cells + ENDING] += sum(n for n, w in zip(batch.column(1).to_pylist(), words, strict=True) if w == END)
            if not plain:
                continue
            flat, sizes = encoder.ids([words[i] for i in plain])
            found[cells:] += np.bincount(subwords.words(flat, sizes)[1], batch.column(1).to_numpy()[plain], attention.CLASSES).astype(np.int64)
            first, last = np.cumsum(sizes) - sizes, np.cumsum(sizes) - 1
            before = np.empty(len(flat), np.int64)
            before[1:] = subwords.group[flat[:-1]]
            before[first] = SPELLERS
            found[:cells] += np.bincount(before * (total + 1) + flat, minlength=cells)
            found[:cells] += np.bincount(subwords.group[flat[last]] * (total + 1) + total, minlength=cells)
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], names=["cell", "n"])

    out = np.zeros(cells + attention.CLASSES, np.int64)
    table = counts.select("w", "n").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[table.column("cell").to_numpy()] = table.column("n").to_numpy()
    return out[cells:], out[:cells].reshape(SPELLERS + 1, total + 1)


def spelling_of(counts: np.ndarray) -> np.ndarray:
    """Log shares of what follows a group of subwords: its own counts, mixed with those of all by how many
    different ids follow it."""
    every = counts.sum(axis=0) + 0.1
    every = every / every.sum()
    ways = np.maximum(1, (counts > 0).sum(axis=1, keepdims=True))
    return np.log((counts + ways * every) / (counts.sum(axis=1, keepdims=True) + ways)).astype(np.float32)


def designed(texts: DataFrame, counts: DataFrame, tokenizer: str) -> tuple[Subwords, np.ndarray]:
    """The subwords' vectors, classes and spelling, and the classes' counts."""
    vectors = vectors_of(texts, tokenizer)
    weight = (vectors**2).sum(axis=1)
    subwords = Subwords(vectors, clustered(vectors, weight, attention.CLASSES - 1), np.zeros(len(vectors), np.int64), np.zeros((SPELLERS + 1, len(vectors) + 1), np.float32))
    subwords.group = (vectors @ clustered(vectors, weight, SPELLERS).T).argmax(axis=1)
    classes, spelled = tallies(counts, tokenizer, subwords)
    subwords.spelling = spelling_of(spelled)
    return subwords, classes


def frequent(counts: DataFrame, most: int) -> tuple[dict[bytes, int], int]:
    """The words with at least some count, ``most`` of them at most, and that count. Counts are looked at in
    steps of a twelfth of a power of two, so the driver gets a few hundred rows and then these words."""
    step = F.floor(F.log2("n") * 12).cast("int")
    sizes = sorted(((r["s"], r["count"]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True)
    least, held = None, 0
    for s, n in sizes:
        if held + n > most:
            break
        least, held = s, held + n
    if least is None:
        return {}, 1 << 62
    chosen = {bytes(r["w"]): r["n"] for r in counts.where(step >= least).collect()}
    return chosen, least


def rounds_of(texts: DataFrame) -> tuple[int, Column]:
    """How many rounds of training ``text`` makes, and which one takes a row: ``h`` is even between 0 and 2**20."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    rounds = max(1, (chars // ROUND_CHARACTERS + 1).bit_length())
    number = F.lit(0)
    for k in range(1, rounds):
        number = number + (F.col("h") >= ((1 << k) - 1 << 20) // ((1 << rounds) - 1)).cast("int")
    return rounds, number


def trained(texts: DataFrame, rounds: int, subwords: Subwords, bias: np.ndarray) -> np.ndarray:
    """Attention weights learned from all batches, round by round."""
    flat, sent = attention.start(), texts.sparkSession.sparkContext.broadcast(subwords)
    for k in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], begun=flat, rate=1e-2 / (1 + k)) -> Iterator[pa.RecordBatch]:
            adam, own, seen = attention.Adam(rate), begun.copy(), 0
            for _, flat, sizes, starts, places in unpacked_batches(batches):
                vectors, classes = sent.value.of_batch(flat, sizes)
                attention.train(own, bias, vectors.take(places, axis=0), classes.take(places), firsts(starts), adam)
                seen += len(places)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([own.astype(float).tolist()], pa.list_(pa.float64()))], names=["weight", "own"])

        each = texts.where(F.col("round") == k).select("docs", "sizes", "ids", "places").mapInArrow(run, "weight double, own array<double>")
        mean = each.select("weight", F.posexplode("own").alias("at", "x")).groupBy("at").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("x"))
        rows = mean.collect()  # as many as the model has weights
        if rows:
            flat = np.zeros(attention.SIZE, np.float32)
            flat[[r["at"] for r in rows]] = [r["x"] for r in rows]
    return flat


SCORED = "row long, id long, held_out boolean, n_tokens long, logs double, known long, score double, rare array<struct<w:binary,tf:int,seen:double,unseen:double>>"


class Model:
    """What scoring needs: weights, class shares, subwords, counts of the classes, and the logs of the shares of known and
    new words."""

    def __init__(self, flat: np.ndarray, bias: np.ndarray, subwords: Subwords, classes: np.ndarray, once: int, total: int):
        self.flat, self.bias, self.subwords = flat, bias, subwords
        self.in_class = -np.log(np.maximum(classes, 1))
        self.in_class[ENDING] = 0
        new = (once + 1) / (total + 2)
        self.known, self.new = math.log(1 - new), math.log(new)

    def logs(self, flat: np.ndarray, sizes: np.ndarray, starts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs of each word's probability without its count, if it has one, and of each distinct word's if it has none.
        Every text begins a block, so that its windows do not depend on the texts beside it."""
        vectors, classes = self.subwords.of_batch(flat, sizes)
        n = np.diff(starts)
        begins = starts_of(-(-n // attention.BLOCK) * attention.BLOCK)
        at = np.arange(len(places)) + np.repeat(begins[:-1] - starts[:-1], n)
        laid = np.zeros(begins[-1], np.int64)
        laid[at] = places
        logs = attention.score(self.flat, self.bias, vectors.take(laid, axis=0), classes.take(laid), firsts(begins))[at]
        return logs + (self.known + self.in_class[classes])[places], self.new + self.subwords.spelled(flat, sizes)


def scored(texts: DataFrame, near: dict[bytes, int], model: Model) -> DataFrame:
    """For each text of the batches: the number of tokens; over the frequent words (those ``near``) and the end, the sum of log10(c+1),
    how many have a count, and the model's log10 probability; and the other words with their frequencies and
    the sums of natural logs that count if the training texts have them or not."""
    sent = texts.sparkSession.sparkContext.broadcast((near, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, model = sent.value
        for docs, flat, sizes, starts, places, words in unpacked_batches(batches):
            names = words.split(b" ")
            seen, unseen = model.logs(flat, sizes, starts, places)
            counts = np.fromiter(map(near.get, names, repeat(-1)), np.int64, len(names))
            log10s, logs, far = np.log10(np.maximum(counts, 0) + 1.0), np.log(np.maximum(counts, 1)), counts[places] < 0
            logs[0] = 0  # the end is all of its class
            own = np.repeat(np.arange(len(docs)), np.diff(starts))
            near_logs = np.where(far, 0.0, seen + logs[places])
            pairs, where, tf = np.unique(own[far] << 32 | places[far], return_inverse=True, return_counts=True)
            offsets = np.searchsorted(pairs >> 32, np.arange(len(docs) + 1)).astype(np.int32)
            at = pairs & 0xFFFFFFFF
            each = [pa.array([names[i] for i in at.tolist()], pa.binary()), pa.array(tf.astype(np.int32)), pa.array(np.bincount(where, seen[far], len(pairs)).astype(float)), pa.array(unseen[at] * tf)]
            columns = [
                *(docs.field(k) for k in ("row", "id", "held_out", "n_tokens")),
                pa.array(np.add.reduceat(log10s[places], starts[:-1])),
                pa.array(np.add.reduceat((counts > 0).astype(np.int64)[places], starts[:-1])),
                pa.array(np.add.reduceat(near_logs, starts[:-1]) / math.log(10)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(each, names=["w", "tf", "seen", "unseen"])),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "held_out", "n_tokens", "logs", "known", "score", "rare"])

    return texts.select("docs", "sizes", "ids", "places", "words").mapInArrow(run, SCORED)


def score(df: DataFrame, held_out: Column, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", most: int = FREQUENT, train: bool = True) -> DataFrame:
    """One row per input row: the id, ``held_out``, ``n_tokens`` (words and one end), ``n_known`` (tokens that the
    training texts have), ``train_tokens``, ``base_score`` (sum of log10((c+1)/(N+V+1))) and ``score``, the
    model's log10 probability of the text. Rows with ``held_out`` (a boolean column over ``df``) teach nothing.

    A null or empty text is its end alone; texts of any length are scored whole. With no training rows all counts
    are 0 and all words are spelled. Null ids and repeated rows are rows like any other; an empty table gives an
    empty result; other columns are not read.

    ``most`` bounds the words whose counts every task gets, and changes no result; without ``train`` the network stays
    as it starts. Counts, the subwords' vectors and the network are all learned from all training texts.
    """
    hashed = F.pmod(F.xxhash64(F.col(id_column), F.col(text_column)), F.lit(1 << 20))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), hashed.alias("h"))
    rounds, number = rounds_of(rows.where(~F.col("held_out")))
    number = F.when(F.col("held_out"), HELD_OUT).when(F.length("text") > 0, number).otherwise(EMPTY)
    texts = written(batched(rows.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text", number.alias("round")), tokenizer), "batches", "round")
    learned = texts.where(F.col("round") != HELD_OUT)
    counts = written(word_counts(learned), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).first()
    subwords, classes = designed(learned, counts, tokenizer)
    bias = attention.prior(classes)
    flat = trained(learned, rounds, subwords, bias) if train else attention.start()
    near, least = frequent(counts, most)
    ends = counts.where(F.col("w") == F.lit(END)).first() if total["n"] else None
    near[END] = ends["n"] if ends else 0

    kept = written(scored(texts, near, Model(flat, bias, subwords, classes, total["once"], total["n"])), "scored")
    drop_written(texts)
    far = counts.where(F.floor(F.log2("n") * 12).cast("long") < least)
    rare = kept.select("row", F.explode("rare").alias("r")).select("row", "r.w", "r.tf", "r.seen", "r.unseen").join(far, "w", "left")
    found = F.col("n").isNotNull()
    more = F.when(found, F.col("tf") * F.log10(F.col("n") + 1)).otherwise(0.0)
    own = F.when(found, F.col("seen") + F.col("tf") * F.log("n")).otherwise(F.col("unseen")) / math.log(10)
    summed = rare.groupBy("row").agg(F.sum(more).alias("more"), F.sum(F.when(found, F.col("tf")).otherwise(0)).alias("also"), F.sum(own).alias("own"))
    both = kept.drop("rare").join(summed, "row", "left")
    return both.select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * math.log10(total["n"] + total["v"] + 1)).alias("base_score"),
        (F.col("score") + F.coalesce("own", F.lit(0.0))).alias("score"),
    )
