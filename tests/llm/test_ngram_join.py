import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalspark.llm import ngram_join, shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))


def set_of(text):
    w = words_of(text)
    return frozenset(" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def by_hand(rows):
    """Number of shingles and component of each row (id, text), from all pairs of sets that share a shingle."""
    sets = [set_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            if 100 * len(s & sets[j]) >= 85 * len(s | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((repr((d, len(s), least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))))


def found(df, **options):
    return sorted(repr(tuple(r)) for r in ngram_join.jaccard_join(df, **options).collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abAB É \n\t\x0b\x1c \U0001f600", max_size=40))))
def test_shingles_are_equal_where_their_texts_are(texts):
    own = list(shingles.sets(pa.array(texts, pa.string())))
    numbers = {}
    for text, s in zip(texts, own, strict=True):
        assert len(s) == len(set_of(text))
    for text in texts:
        for x in set_of(text):
            (numbers[x],) = next(shingles.sets(pa.array([x]))).tolist()
    assert len(set(numbers.values())) == len(numbers)
    for text, s in zip(texts, own, strict=True):
        assert set(s.tolist()) == {numbers[x] for x in set_of(text)}


def test_words_over_segments(monkeypatch):
    texts = ["one two " + "x" * 5000 + " three four", "two " + "x" * 5000 + " three four", "x" * 5000, None]
    whole = [s.tolist() for s in shingles.sets(pa.array(texts))]
    monkeypatch.setattr(shingles, "SEGMENT", 64)
    assert [s.tolist() for s in shingles.sets(pa.array(texts))] == whole
    assert whole[1][0] in whole[0] and len(whole[0]) == 2


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_all_pairs(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()]
    assert found(spark.read.parquet(path)) == by_hand(rows)


def near_copies(rng, groups, members, size, edits, vocabulary=3000):
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(size)]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(vocabulary)}"
            rows.append(" ".join(own[: len(own) - rng.randrange(3)]))
    return rows


@pytest.mark.parametrize(("most", "block"), [(128, 1 << 20), (4, 1 << 20), (3, 2000)])
def test_groups_of_near_copies(spark, most, block):
    """Large groups whose sets meet as pairs, in one walk, and block by block; passages that many texts share."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = near_copies(rng, 3, 60, 90, 5) + near_copies(rng, 25, 3, 40, 2) + [f"{passage} {' '.join(f'u{rng.randrange(9999)}' for _ in range(rng.randrange(2, 80)))}" for _ in range(120)]
    texts += [texts[0]] * 30 + ["a b c", "A  b\nc", "a", "a b c d", "", "  ", None, "x y z w v", "x y z w v x y z w v"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, most=most, block=block) == by_hand(rows)


def test_longer_prefixes_ask_for_more():
    own = np.unique(shingles.mixed(np.arange(500, dtype=np.uint64)))
    none = np.zeros(1 << ngram_join.COUNTERS, np.float32)
    some = none + 3
    short, one = ngram_join.prefix(own, none)
    long, more = ngram_join.prefix(own, some)
    assert more > one >= 1 and len(long) - more == len(short) - one == 500 - ngram_join.needed(500)
    hot = none.copy()
    hot[own[:100] >> np.uint64(64 - ngram_join.COUNTERS)] = 1000  # common shingles come last
    assert not set(ngram_join.prefix(own, hot)[0].tolist()) & set(own[:100].tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=12), st.integers(50, 100))
def test_forest_has_the_components_of_all_links(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]

    def parts(edges):
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[find(a)] = find(b)
        return {frozenset(i for i in range(len(sets)) if find(i) == find(j)) for j in range(len(sets))}

    every = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    walk = ngram_join.forest(arrays, percent)
    assert parts(walk) == parts(every) and len(walk) == len(sets) - len(parts(every))


def test_odd_rows(spark):
    schema = "doc_id long, text string, k long, n string, shingle int, numbers string"
    rows = [(7, "one two three four five", 1, "x", 2, "y"), (3, "ONE two three four five", 1, None, 2, None), (7, None, 1, None, 2, None), (None, "one two three four five", 1, None, 2, None), (None, "alone", 1, None, 2, None), (5, "", 1, None, 2, None), (4, "", 1, None, 2, None)]
    got = found(spark.createDataFrame(rows, schema))
    assert got == sorted(map(repr, [(7, 2, 3), (3, 2, 3), (7, 0, 7), (None, 2, 3), (None, 1, None), (5, 0, 5), (4, 0, 4)]))


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
