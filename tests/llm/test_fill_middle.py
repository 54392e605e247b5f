import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
import pyarrow as pa

from signalspark.llm import fill_middle, shared


def by_hand(doc_id, text):
    text = text or ""
    words = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(words)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(words[:a]), "".join(words[a:b]), "".join(words[b:])
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def kernel(ids, texts):
    draws = []
    for i in range(4):
        draws.append(np.array([int(hashlib.sha256(f"1:{d}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for d in ids]))
    return list(zip(*(x.to_pylist() for x in fill_middle.transform(pa.array(texts, pa.string()), draws)), strict=True))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ é<>PSM1\n漢\U0001f600", max_size=40), st.text(max_size=30))))
def test_kernel_against_regular_expressions(texts):
    texts = [x if x is None else x.encode("utf-8", "ignore").decode() for x in texts]
    assert kernel(range(len(texts)), texts) == [by_hand(i, x) for i, x in enumerate(texts)]


def test_sliced_column_of_texts():
    texts = ["ab c", None, "", "é<P>", "xyz", "q"]
    whole = pa.array(texts, pa.string())
    draws = [np.arange(3) * 7919 + k for k in range(4)]
    one = [x.to_pylist() for x in fill_middle.transform(whole.slice(2, 3), draws)]
    assert one == [x.to_pylist() for x in fill_middle.transform(pa.array(texts[2:5], pa.string()), draws)]
    assert list(shared.slices(whole, 4)) == [(0, 3), (3, 4), (4, 6)]


SCHEMA = "doc_id long, text string, n int, form string, output string"


def test_rows_of_a_table(spark):
    long = "Wort é 漢 " * 30_000
    rows = [(1, "one two three", 0, "x", "y"), (1, "one two three", 0, None, None), (2, None, 0, None, None), (3, "", 0, None, None), (None, "no id", 0, None, None), (4, "a <S> mark", 0, None, None), (5, long, 0, None, None)]
    rows += [(i, f"text number {i}, with words", 0, None, None) for i in range(10, 200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((repr(tuple(r)) for r in fill_middle.fill_middle(df).collect()))
    assert got == sorted(repr((i, *by_hand(i, t))) for i, t, *_ in rows)
    digests = fill_middle.digests(fill_middle.fill_middle(df)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((r["doc_id"] or 0, r["output_sha256"], r["restored_sha256"]) for r in digests) == sorted((i or 0, sha(by_hand(i, t)[4]), sha(t or "")) for i, t, *_ in rows)
    assert {r["form"] for r in digests} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    got = fill_middle.fill_middle(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and got.collect() == []
