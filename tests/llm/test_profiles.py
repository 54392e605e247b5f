"""The learning of language profiles against a plain count."""

import unicodedata
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from signalspark.llm import language_id


def plain_grams(text):
    """n-grams of 1 to 3 letters, an edge of a word counting as one but not by itself."""
    words, own = [], ""
    for c in text:
        if unicodedata.category(c)[0] == "L":
            own += c.lower()[0]
        elif own:
            words, own = [*words, own], ""
    out = Counter()
    for w in [*words, own] if own else words:
        out.update(w)
        edged = f"\0{w}\0"
        out.update(edged[i : i + 2] for i in range(len(edged) - 1))
        out.update(edged[i : i + 3] for i in range(len(edged) - 2))
    return out


def packed(gram):
    n = 0
    for c in gram:
        n = n << 21 | (1 if c == "\0" else ord(c))
    return n


def test_profiles_by_a_plain_count(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    odd = [(900_010, "İstanbul ǅ ÀÉ x1y", "zz", None, None), (900_002, None, "zz", None, None), (900_003, "nothing learned", None, None, None), (900_004, "", "zz", None, None)]
    df = spark.read.parquet(path).select("doc_id", "text", "lang", F.lit(None).cast("string").alias("l"), F.lit(None).cast("string").alias("t"))
    df = df.union(spark.createDataFrame(odd, df.schema))
    counts = {}
    for row in [(r["doc_id"], r["text"], r["lang"]) for r in pq.read_table(path).to_pylist()] + [r[:3] for r in odd]:
        if row[1] is not None and row[2] is not None and row[0] % 2 == 0:
            counts.setdefault(row[2], Counter()).update(plain_grams(row[1]))
    for size in (400, 50):
        got = language_id.learn(df, F.col("i") % 2 == 0, size=size)
        assert got.languages == sorted(counts)
        for k, language in enumerate(got.languages):
            ranked = sorted(((packed(g), n) for g, n in counts[language].items()), key=lambda x: (-x[1], x[0]))[:size]
            own = {int(g): int(r) for g, r in zip(got.grams, got.ranks[:-1, k], strict=True) if r >= 0}
            assert own == {g: i for i, (g, _) in enumerate(ranked)}, language
