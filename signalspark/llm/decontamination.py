"""Benchmark decontamination on templates.

Text is made canonical first: numbers, units behind numbers, and names (capitalised words inside a sentence)
become typed placeholders, other words are lower-cased. Windows of five such tokens are matched by hash between
documents and benchmark items, so that a question with other numbers or names is found as well. Windows with few
words say too little without their values and are matched with them, as are items shorter than a window. Items that do
not differ but in their values are one template, so that a template with many instances is looked up once.

A document holds an item if windows that stand in one place of it, which may drift by a quarter of the item, cover at
least 0.8 of the item's tokens, and if the values in the slots fit there: one value of the item stands for one value
of the document, and the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalspark.llm.shared import free_names, written

#: Tokens in a window, literal ones among them from which on values are left open, share of an item's tokens to be covered,
#: share of its slots whose values must fit, share of its size (and tokens at least) that an alignment may drift, the
#: placeholders, and the unit words.
WINDOW, LITERAL, COVERED, FITTING, DRIFT, LEAST_DRIFT = 5, 3, 0.8, 0.5, 0.25, 4
NUMBER, NAME, UNIT = "\ue001", "\ue002", "\ue003"
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mi mg g kg gram grams kilogram kilograms lb lbs pound pounds oz "
    "ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years dollar dollars euro euros cent cents percent degree degrees kmh mph hz khz mhz ghz w kw "
    "kwh v volt volts amp amps j kj cal kcal pa kpa bar n kb mb gb tb bit bits byte bytes"
).split()

NUMBERS = r"[$€£¥]?\p{N}+(?:[.,:/]\p{N}+)*%?"
NAMES = r"(?<=[\p{Ll}\p{N},;] )\p{Lu}[\p{L}\p{M}'’-]*"
TOKENS = f"[\\p{{L}}\\p{{M}}]+|[{NUMBER}{NAME}{UNIT}]"


def marked(text: Column) -> Column:
    """The text with each slot's mark in front of its value."""
    text = F.regexp_replace(text, NUMBERS, f"{NUMBER}$0 ")
    text = F.regexp_replace(text, rf"({NUMBER}\S*) +(?i:({'|'.join(sorted(UNITS, key=len, reverse=True))}))(?!\p{{L}})", f"$1 {UNIT}$2 ")
    return F.regexp_replace(text, NAMES, f"{NAME}$0 ")


def tokens(text: Column) -> Column:
    """The canonical tokens of a text. A null text has none; a private-use character of these placeholders in a
    text counts as one."""
    canonical = F.regexp_replace(marked(F.coalesce(text, F.lit(""))), rf"([{NUMBER}{NAME}{UNIT}])\S*", "$1 ")
    return F.regexp_extract_all(F.lower(canonical), F.lit(TOKENS), F.lit(0))


def slots(text: Column) -> Column:
    """(at, value) of each slot: its position among the canonical tokens and its value, lower-cased."""
    found = F.regexp_extract_all(marked(F.coalesce(text, F.lit(""))), F.lit(rf"[{NUMBER}{NAME}{UNIT}]\S*|[\p{{L}}\p{{M}}]+"), F.lit(0))
    placed = F.transform(found, lambda x, i: F.struct(i.alias("at"), F.lower(x).alias("value")))
    return F.filter(placed, lambda x: F.substring(x["value"], 1, 1).isin(NUMBER, NAME, UNIT))


def window_hashes(words: Column, width: int = WINDOW) -> Column:
    """A hash for each window of a token array; none if it is shorter than a window."""
    starts = F.sequence(F.lit(1), F.size(words) - (width - 1))
    return F.when(F.size(words) >= width, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width))))


def spoken(text: Column) -> Column:
    """The tokens of a text as they stand there, lower-cased: those of :func:`tokens` with the values in the slots."""
    found = F.regexp_extract_all(marked(F.coalesce(text, F.lit(""))), F.lit(rf"[{NUMBER}{NAME}{UNIT}]\S*|[\p{{L}}\p{{M}}]+"), F.lit(0))
    return F.transform(found, lambda x: F.lower(F.translate(x, f"{NUMBER}{NAME}{UNIT}", "")))


def exact_hash(words: Column, at: Column, width: Column | int) -> Column:
    """The hash of a window with its values; no hash of :func:`window_hashes` is meant to be equal."""
    return F.xxhash64(F.slice(words, at + 1, width), F.lit(width) if isinstance(width, int) else width)


def templates(items: DataFrame, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """item, text, and the tokens (``words``, and with values ``own``), size and windows of each item with a word, beside its
    template's key (``template``). A window is hash, place, width and kind: those with fewer than :data:`LITERAL` words are
    ``exact``, and so is the one window of an item of two to four tokens. Items with exact windows share a template
    only with items of the same values."""
    text = F.col(text_column)
    rows = items.select(F.col(item_column).alias("item"), text.alias("item_text"), tokens(text).alias("words"), spoken(text).alias("own")).distinct()
    literal = lambda words: F.size(F.filter(words, lambda w: ~w.isin(NUMBER, NAME, UNIT)))
    rows = rows.where(literal(F.col("words")) > 0).withColumn("size", F.size("words"))

    def window(h: Column, i: Column) -> Column:
        exact = literal(F.slice("words", i + 1, WINDOW)) < LITERAL
        return F.struct(F.when(exact, exact_hash(F.col("own"), i, WINDOW)).otherwise(h).alias("h"), i.alias("p"), F.lit(WINDOW).alias("width"), exact.alias("exact"))

    whole = F.array(F.struct(exact_hash(F.col("own"), F.lit(0), F.col("size")).alias("h"), F.lit(0).alias("p"), F.col("size").alias("width"), F.lit(True).alias("exact")))
    placed = F.when(F.col("size") >= WINDOW, F.transform(window_hashes(F.col("words")), window)).when(F.col("size") >= 2, whole)
    rows = rows.withColumn("windows", placed).where("windows IS NOT NULL")
    key = F.when(F.exists("windows", lambda w: w["exact"]), F.xxhash64("words", "own")).otherwise(F.xxhash64("words"))
    return rows.withColumn("template", key)


def windows_of(known: DataFrame) -> DataFrame:
    """template, size, h, p, width, exact: the windows of each template once."""
    return known.select("template", "size", F.explode("windows").alias("x")).select("template", "size", "x.h", "x.p", "x.width", "x.exact").distinct()


def exact_windows(width: int) -> Column:
    """(pos, h) of a document's windows of some width with their values, from its ``words`` and ``own`` tokens; of
    full windows only those with so many slots that they are matched with values."""
    size = F.size("words")
    if width < WINDOW:
        starts = F.when(size >= width, F.sequence(F.lit(0), size - width))
    else:
        few = WINDOW - LITERAL  # a window with more slots than this, so one that holds few + 1 slots in a row
        at = lambda j: F.get(F.col("slot_at"), j)
        close = F.filter(F.sequence(F.lit(0), F.size("slot_at") - (few + 1)), lambda j: at(j + few) - at(j) < WINDOW)
        around = F.transform(close, lambda j: F.sequence(F.greatest(F.lit(0), at(j + few) - (WINDOW - 1)), F.least(at(j), size - WINDOW)))
        starts = F.when((size >= WINDOW) & (F.size("slot_at") > few), F.array_distinct(F.flatten(around)))
    placed = F.transform(starts, lambda i: F.struct(i.alias("pos"), exact_hash(F.col("own"), i, width).alias("h")))
    return F.coalesce(placed, F.array().cast("array<struct<pos:int,h:bigint>>"))


def key_of(id_column: str, text_column: str) -> Column:
    """A document's key, of 128 bits: rows that are equal in id and text share it."""
    return F.struct(F.xxhash64(F.col(id_column), F.col(text_column)).alias("a"), F.xxhash64(F.lit(1), F.col(text_column), F.col(id_column)).alias("b"))


def matches(documents: DataFrame, index: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, doc_key, pos, and the template's window, for each window of a document that a template has."""
    widths = sorted(r["width"] for r in index.where("exact").select("width").distinct().collect())  # four at most
    text = F.col(text_column)
    words = documents.select(F.col(id_column).alias("id"), key_of(id_column, text_column).alias("doc_key"), tokens(text).alias("words"), *[spoken(text).alias("own")] * bool(widths))
    if widths:
        slot_at = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(NUMBER, NAME, UNIT), i)))
        open_ones = F.coalesce(F.transform(window_hashes(F.col("words")), lambda h, i: F.struct(i.alias("pos"), h.alias("h"))), F.array().cast("array<struct<pos:int,h:bigint>>"))
        words = words.withColumn("slot_at", slot_at)
        windows = words.select("id", "doc_key", F.explode(F.concat(open_ones, *map(exact_windows, widths))).alias("x")).select("id", "doc_key", "x.pos", "x.h")
    else:
        windows = words.select("id", "doc_key", F.posexplode(window_hashes(F.col("words"))).alias("pos", "h"))
    small = index.count() * 40 <= BROADCAST_BYTES  # four numbers a row
    return windows.join(F.broadcast(index) if small else index, "h")


#: Size up to which the windows of the benchmark are sent to every task.
BROADCAST_BYTES = 40_000_000


def banded(found: DataFrame) -> DataFrame:
    """Each match with the bands of offsets that it lies in: bands of two drifts' width that overlap by one, so any two
    matches of a template within one drift share a band."""
    drift = F.greatest(F.lit(LEAST_DRIFT), (F.col("size") * DRIFT).cast("int"))
    offset = F.col("pos") - F.col("p")
    bands = [F.struct(F.lit(k).alias("shift"), F.floor((offset + k * drift) / (2 * drift)).alias("at")) for k in (0, 1)]
    return found.withColumn("offset", offset).withColumn("band", F.explode(F.array(*bands)))


def aligned(found: DataFrame) -> DataFrame:
    """doc_key, template, id, size, n_windows, coverage and band of each document and template whose windows in one band cover
    enough of it: the band that covers most."""
    spans = F.flatten(F.transform("at", lambda x: F.sequence(x["p"], x["p"] + x["width"] - 1)))
    pairs = banded(found).groupBy("doc_key", "template", "band").agg(F.min("id").alias("id"), F.min("size").alias("size"), F.collect_set(F.struct("p", "width")).alias("at"))
    covered = pairs.withColumn("coverage", F.size(F.array_distinct(spans)) / F.col("size")).where(F.col("coverage") >= COVERED)
    best = F.max_by(F.struct("id", F.size("at").cast("long").alias("n_windows"), "coverage", "band"), F.struct("coverage", F.size("at"), "band"))
    return covered.groupBy("doc_key", "template").agg(best.alias("b")).select("doc_key", "template", "b.*")


def fitting(found: DataFrame, near: DataFrame, known: DataFrame, documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """For each document and item of ``near``, over the aligned windows: the slots seen, the share of them whose values go
    together (the value of the document that stands most often for theirs, and the other way round, whichever is
    less), and the share with equal values."""
    held = documents.select(key_of(id_column, text_column).alias("doc_key"), F.col(text_column).alias("text")).join(near.select("doc_key").distinct(), "doc_key", "left_semi")
    doc_slots = held.select("doc_key", F.explode(slots(F.col("text"))).alias("s")).select("doc_key", F.col("s.at").alias("pos"), F.col("s.value").alias("own")).distinct()
    item_slots = known.select("template", "item", F.xxhash64("item", "item_text").alias("one"), F.explode(slots(F.col("item_text"))).alias("s")).select("template", "item", "one", F.col("s.at").alias("p"), F.col("s.value").alias("theirs"))
    places = banded(found).join(near.select("doc_key", "template", "band"), ["doc_key", "template", "band"], "left_semi")
    places = places.select("doc_key", "template", "offset", F.explode(F.sequence("p", F.col("p") + F.col("width") - 1)).alias("p")).distinct()
    seen = places.withColumn("pos", F.col("p") + F.col("offset")).join(doc_slots, ["doc_key", "pos"]).join(item_slots, ["template", "p"])
    pair = ["doc_key", "template", "item", "one"]
    counted = seen.groupBy(*pair, "theirs", "own").agg(F.count("*").alias("n"))
    ways = [counted.groupBy(*pair, side).agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.sum(F.when(F.col("theirs") == F.col("own"), F.col("n")).otherwise(0)).alias("equal")).groupBy(*pair).agg((F.sum("most") / F.sum("n")).alias(name), F.sum("n").alias("n_slots"), (F.sum("equal") / F.sum("n")).alias("equal")) for side, name in (("theirs", "to"), ("own", "back"))]
    return ways[0].join(ways[1].select(*pair, "back"), pair).select(*pair, "n_slots", F.least("to", "back").alias("fit"), "equal")


def contaminated(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it holds, and no other rows: the document's id and
    ``doc_key``, the item's id, ``n_windows`` (of the item, matched in one place), ``coverage`` (share of its tokens that they
    cover), ``n_slots`` (aligned slots), ``slot_fit`` (share of them whose values go together) and ``same_values``
    (share with equal values; below 1 in a re-parameterised copy; both null without slots).

    A null or empty text holds nothing. An item of fewer than five tokens is found with its own values only; one of
    a single token, or without any word, is not found. Texts of any length are read whole. Rows equal in id and text
    are one document; a null id stays null. An empty table on either side gives an empty result; other columns are not
    read. The templates' windows are broadcast up to :data:`BROADCAST_BYTES`, by their counted rows, and joined by hash
    beyond; a document's windows are matched where they are made, and only matches are shuffled.
    """
    known = written(templates(items, item_column, item_text), "benchmark-templates")
    found = written(matches(documents, windows_of(known), id_column, text_column), "window-matches")
    near = written(aligned(found), "near-templates")
    each = known.select("template", "item", F.xxhash64("item", "item_text").alias("one")).distinct()
    fit = fitting(found, near, known, documents, id_column, text_column)
    pairs = near.join(each, "template")
    both = pairs.join(fit.drop("item"), ["doc_key", "template", "one"], "left").where(F.coalesce(F.col("fit") >= FITTING, F.lit(True)))
    best = both.groupBy("doc_key", "item").agg(F.max_by(F.struct("id", "n_windows", "coverage", "n_slots", "fit", "equal"), F.struct("coverage", F.coalesce("equal", F.lit(0.0)), "n_windows")).alias("b"))
    return best.select(F.col("b.id").alias(id_column), F.col("item").alias(item_column), "b.n_windows", "b.coverage", F.coalesce("b.n_slots", F.lit(0)).cast("long").alias("n_slots"), F.col("b.fit").alias("slot_fit"), F.col("b.equal").alias("same_values"), "doc_key")


def without(documents: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that hold no item of ``found`` (from :func:`contaminated`), with their columns and all their repeats;
    null and empty texts, and all rows where ``found`` is empty, stay."""
    (name,) = free_names(documents, "key")
    keys = written(found.select(F.col("doc_key").alias(name)).distinct(), "contaminated")
    return documents.join(keys, key_of(id_column, text_column) == keys[name], "left_anti")
