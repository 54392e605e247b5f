"""Batches of texts that are cut and encoded once, from which the language model learns and scores."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from signalspark.llm import lm_scoring

WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SPACES = "".join(map(chr, range(0x21)))
TEXTS = ["The cat  the CAT", None, "", " \t\n", f"a{SPACES}b\x7f\x85c d　É é\n", "x" * 5000, "cat"]


def plain(text):
    return (text or "").encode().lower().split()


def test_distinct_words_and_places_give_the_texts_back():
    for texts in (TEXTS, TEXTS[1:4], []):
        for kind in (pa.string(), pa.large_string()):
            words, places, sizes = lm_scoring.cut_up(pa.array(texts, kind))
            names = words.split(b" ")
            assert names[0] == lm_scoring.END and len(set(names)) == len(names)
            assert [[names[i] for i in x] for x in np.split(places, np.cumsum(sizes))[:-1]] == [[*plain(t), lm_scoring.END] for t in texts]


def test_a_word_is_encoded_once_in_a_process(monkeypatch):
    asked = []
    met, other = lm_scoring.Met(WORDS), lm_scoring.Encoder(WORDS)
    monkeypatch.setattr(met, "encoder", type("", (), {"ids": lambda self, words: asked.extend(words) or other.ids(words)})())
    for words in ([lm_scoring.END, b"hello", b"unbelievably"], [lm_scoring.END, b"unbelievably", b"x" * 300, b"hello"], [b"hello"]):
        for got, want in zip(met.ids(words), other.ids(words), strict=True):
            assert np.array_equal(got, want)
    assert sorted(asked) == sorted([lm_scoring.END, b"hello", b"unbelievably", b"x" * 300])


def test_subwords_are_summed_whatever_their_number():
    random = np.random.default_rng(0)
    vectors, sizes = random.normal(0, 1, (50, 4)), np.array([1, 3, 8, 9, 40, 1, 2])
    flat = random.integers(0, 50, sizes.sum())
    want = [vectors[x].sum(axis=0) for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert np.allclose(lm_scoring.sums_by(vectors, flat, sizes), want)


def test_a_text_scores_alike_beside_any_texts(spark):
    """Windows once lay across the texts of a batch, so a score hung on how many words stood before the text."""
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40").select("doc_id", "text").orderBy("doc_id").collect()
    long = max((r["text"] for r in source if len(r["text"] or "") < 4000), key=len)
    rows = [(1000, long), *((r["doc_id"], r["text"]) for r in source), (1001, long), (1002, "one more word"), (1003, long)]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), F.col("doc_id") >= 1000, WORDS)
    scores = [r["score"] for r in got.where(F.col("doc_id").isin(1000, 1001, 1003)).collect()]
    assert len(scores) == 3 and np.allclose(scores, scores[0], rtol=1e-6, atol=0)
