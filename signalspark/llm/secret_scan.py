"""Secret scans: fixed patterns, and zstandard novelty for strings that no pattern names.

A candidate is a long run of letters, digits and signs near a word such as ``key`` or ``auth``, or in one line or statement
with one; runs that are joined by single dots (signed tokens) or stand on lines of their own below each other
(key blocks) are one candidate. Its novelty is the number of bytes that it adds to the compressed form of the text around
it, with a compressor primed by a dictionary of identifiers: names, repeated strings and words of the same text
cost little. A random string costs about what its letters in any other order cost, and no less than the entropy of
its alphabet (half a byte a letter in hex). A compressor finds no repeats in a short name whose words no dictionary has, so
the order of the letters is coded as well: in bits by pairs of neighbouring letters, as the dictionary, ordinary prose and the
text around have them. Candidates that cost much either way are reported. A candidate is
taken whole, however long, and its runs by themselves only if it isn't novel as a whole; where the fixed patterns found
parts of it, the parts that they leave open are scored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from signalspark.llm.license_scan import TEXTS
from signalspark.llm.shared import slices

#: Order of the kinds where spans start together.
KINDS = ("assign", "access", "hex", "novel")

# The patterns, the words of sensitive places, the identifiers that prime the compressor.
WORDS_BEFORE_ASSIGNMENT = ("password", "passwd", "secret", "token", "api_?key")
SENSITIVE = ("key", "secret", "token", "passw", "pwd", "auth", "cred", "bearer", "private", "signature", "session", "cookie", "access", "sas", "salt")
IDENTIFIERS = (
    "return import from class def self public private static void function const let var null true false string "
    "int long float double boolean array list map dict object error exception message request response header body "
    "client server config settings environment production development staging localhost http https www index data "
    "value values name user username account email address database connection default version update create delete "
    "insert select where order group table column example test sample placeholder changeme your_api_key_here "
    "project service handler backup bucket production logs build release candidate docs login session final file path test main "
    "app api web cloud region west east north south store cache queue worker job task event image model view controller "
    "module package manager factory helper utils common core base input output read write start stop open close time date "
    "number count size length first last next previous get set From Header Auth Token User Name Service Handler Manager "
    "Controller Factory Session Request Response Client Config Exception String Value List Email Address Account Login "
    "access_key secret_key api_key auth_token bearer authorization content-type application/json base64 sha256 "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 xxxxxxxx"
)


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(rf"""(?:{"|".join(map(either_case, WORDS_BEFORE_ASSIGNMENT))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run is taken whole, so a shorter one holds no match either
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = "[A-Za-z0-9+/_=~!@#$%^&*-]"
#: A run, further ones behind dots, then whole lines of them; a short line may end it.
CANDIDATE = re.compile(rf"{RUN}{{16,}}(?:\.{RUN}{{4,}})*(?:\r?\n[ \t]*{RUN}{{16,}}(?=[ \t]*(?:\r?\n|\Z)))*(?P<tail>\r?\n[ \t]*{RUN}{{2,15}}(?=[ \t]*(?:\r?\n|\Z)))?")
LONG_RUN = re.compile(f"{RUN}{{16,}}")
#: Characters that a candidate needs for a short line to belong to it.
BLOCK = 40
#: Numbers and times as they stand in names, and ordinary prose: what the pairs of letters are counted in, beside the identifiers.
NUMBERS = "2024-01-15 10:30:00 v2 0042 404 1.0.3 20230704 00 000 127.0.0.1 8080 1234 5678 90"
PROSE = " ".join(text for _, text, _ in TEXTS)
#: Bits for each character from which on the letters stand in no order that text has; weight of a pair that none has.
DISORDER, UNSEEN = 6.0, 0.3
#: Characters of the line or statement before and behind a candidate that are looked through for a sensitive word.
STATEMENT_BEFORE, STATEMENT_AFTER = 160, 80
#: A run that is not novel as a whole is looked at again in pieces of so many characters, so that dull parts hide nothing.
PIECE = 200
NEAR = re.compile("|".join(map(either_case, SENSITIVE)))

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns: each kind leftmost and non-overlapping, kinds independent of each other."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return ordered(found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)])


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def symbols(text: str) -> str:
    """Letters in lower case, 0 for a digit, and a space for all else and where a name in camel case goes on."""
    parted = re.sub("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", text)
    return f" {re.sub('[^a-z0]+', ' ', re.sub('[0-9]', '0', parted.lower())).strip()} "


def pairs(text: str) -> tuple[Counter, Counter]:
    """Pairs of neighbouring symbols, and the first ones of them."""
    s = symbols(text)
    return Counter(zip(s, s[1:], strict=False)), Counter(s[:-1])


def disorder(word: str, counts: list[tuple[Counter, Counter]]) -> float:
    """Bits that a character of the word takes on average, coded by the symbol before it with the pairs of some texts; a digit
    takes as much again as any of ten."""
    s, bits = symbols(word), 0.0
    for a, b in zip(s, s[1:], strict=False):
        both, first = sum(c[0][a, b] for c in counts), sum(c[1][a] for c in counts)
        bits += math.log2((first + 28 * UNSEEN) / (both + UNSEEN)) + (math.log2(10) if b == "0" else 0.0)
    return bits / len(word)


def sensitive(text: str, start: int, end: int, before: int, after: int) -> bool:
    """Whether a sensitive word stands near a run, or in its line or statement."""
    if NEAR.search(text, max(0, start - before), start) or NEAR.search(text, end, end + after):
        return True
    low, high = max(0, start - STATEMENT_BEFORE), min(len(text), end + STATEMENT_AFTER)
    low = max(low, text.rfind("\n", low, start) + 1, text.rfind(";", low, start) + 1)
    ends = [i for i in (text.find("\n", end, high), text.find(";", end, high)) if i >= 0]
    return bool(NEAR.search(text, low, start) or NEAR.search(text, end, min([high, *ends])))


class Novelty:
    """Marginal compressed bytes of a string in its place, and the disorder of its letters."""

    def __init__(self, around: int = 1024, level: int = 3, identifiers: str = IDENTIFIERS):
        import zstandard

        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.press = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.around = around
        self.known = pairs(" ".join((identifiers, NUMBERS, PROSE)))

    def marginal(self, around: bytes, word: str) -> int:
        return len(self.press.compress(around + word.encode())) - len(self.press.compress(around))

    def spans(self, text: str, taken: list[Span], share: float, least: int, before: int, after: int) -> Iterator[Span]:
        at = 0
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            if m["tail"] and m.start("tail") - a < BLOCK:
                b = m.start("tail")
            while at < len(taken) and taken[at][1] <= a:
                at += 1
            near = sensitive(text, a, b, before, after)
            for start, end in left_open(a, b, (taken[i] for i in range(at, len(taken)))):
                if near and self.novel(text, start, end, share, least):
                    yield start, end, "novel"
                    continue
                for run in LONG_RUN.finditer(text, start, end):
                    yield from self.of_run(text, *run.span(), near, run.span() != (start, end), share, least, before, after)

    def of_run(self, text: str, start: int, end: int, near: bool, whole: bool, share: float, least: int, before: int, after: int) -> Iterator[Span]:
        """The novel spans of one run: itself (if ``whole``, as it was not looked at yet), or else its pieces."""
        if whole and near and self.novel(text, start, end, share, least):
            yield start, end, "novel"
        elif end - start > PIECE:
            for low, high in pieces(start, end):
                if (near or sensitive(text, low, high, before, after)) and self.novel(text, low, high, share, least):
                    yield low, high, "novel"

    def novel(self, text: str, start: int, end: int, share: float, least: int) -> bool:
        word = text[start:end]
        if end - start < least or not any(c.isalpha() for c in word):
            return False
        window = text[max(0, start - self.around) : start] + text[end : end + self.around]
        around = (window + "\n").encode("utf-8", "surrogatepass")
        cost = self.marginal(around, word)
        if cost < share * entropy_bytes(word) or not (cost >= share * len(word) or cost >= share * self.marginal(around, shuffled(word))):
            return False
        return disorder(word, [self.known]) >= DISORDER and disorder(word, [self.known, pairs(window)]) >= DISORDER


def entropy_bytes(word: str) -> float:
    """Bytes that a random string of the word's length and letters takes at least; never more than its length."""
    return len(word) * min(1.0, math.log2(len(set(word))) / 8)


def shuffled(word: str) -> str:
    """The word's letters in another order, the same one each time."""
    letters = list(word)
    random.Random(0).shuffle(letters)
    return "".join(letters)


def left_open(start: int, end: int, taken: Iterable[Span]) -> Iterator[tuple[int, int]]:
    """The parts of a run that no span of ``taken``, in order of their starts, touches."""
    for a, b, _ in taken:
        if a >= end:
            break
        if a > start:
            yield start, a
        start = max(start, b)
    if start < end:
        yield start, end


def pieces(start: int, end: int) -> list[tuple[int, int]]:
    """A run cut at every :data:`PIECE` characters; a last piece too short for a candidate goes to the one before."""
    cuts = [*range(start, end - 15, PIECE), end]
    return list(zip(cuts, cuts[1:]))


def scan_text(text: str, novelty: Novelty, share: float = 0.8, least: int = 12, before: int = 40, after: int = 16) -> tuple[list[Span], list[Span]]:
    """The spans of the patterns, and those with the novel ones."""
    base = base_spans(text)
    return base, ordered(base + list(novelty.spans(text, base, share, least, before, after)))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str, spans: list[Span], mark: Callable[[str], str] = lambda kind: f"[{kind} removed]") -> str:
    """The text with each span, or each run of overlapping ones, replaced."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], mark(kind)]
        at = max(at, end)
    return "".join([*out, text[at:]])


def bounded(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts are a few megabytes. What Arrow holds no more goes back, as workers live on."""
    for batch in batches:
        for low, high in slices(batch.column(text)):
            yield batch.slice(low, high - low)
        pa.default_memory_pool().release_unused()


def scan(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """One row per input row: the id, the number of spans of each kind (``n_assign``, ``n_access``, ``n_hex``,
    ``n_novel``), ``base_sha256`` over ``kind:start:end`` of the fixed patterns' spans, and ``spans``, all spans
    in that form. Offsets count code points, the end is exclusive. ``options`` go to :func:`scan_text`.

    A null or empty text has no spans (``spans`` empty, the digest that of nothing). A text of any length is
    scanned whole; a candidate's compression looks at a bounded window around it. Repeated rows stay repeated;
    an empty table gives an empty result; other columns are not read. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in bounded(batches, 1):
            found = [scan_text(x.as_py() or "", novelty, **options) for x in batch.column(1)]
            counts = [pa.array([sum(k == kind for _, _, k in s) for _, s in found], pa.int64()) for kind in KINDS]
            digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *counts, digests, pa.array([joined(s) for _, s in found], pa.string())], names=[id_column, *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    schema = f"{id_column} long, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string"
    return df.select(df[id_column].cast("long"), df[text_column]).mapInArrow(run, schema)


def redact(df: DataFrame, text_column: str = "text", length_column: str | None = "n_chars", **options) -> DataFrame:
    """The rows of ``df`` with the spans of :func:`scan_text` replaced in the text, and the text's length in
    ``length_column`` counted anew where there is such a column. Rows without a span, and null or empty texts, stay as
    they are; no row is dropped; repeated rows are treated alike; an empty table stays empty; other columns, whatever their
    names, are carried along. Spans that overlap are replaced as one, a secret of any length whole."""
    at = df.columns.index(text_column)
    length = df.columns.index(length_column) if length_column in df.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in bounded(batches, at):
            old = batch.column(at).to_pylist()
            new = [x if x is None or not (s := scan_text(x, novelty, **options)[1]) else redacted(x, s) for x in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if length is not None:
                kept = columns[length].to_pylist()
                columns[length] = pa.array([k if x == y else len(y) for x, y, k in zip(old, new, kept, strict=True)], columns[length].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)
