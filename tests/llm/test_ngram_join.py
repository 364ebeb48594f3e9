import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.llm import ngram_join
from tests.llm.texts import ODD, documents, empty


def shingles(text, size=3):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size=3, threshold=90):
    """{row index: smallest id reachable}."""
    s = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= threshold * len(s[i] | s[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            groups[find(i)] = min(d, groups.get(find(i), d))
    return [(d, len(s[i]), groups.get(find(i)) if s[i] else d) for i, (d, _) in enumerate(rows)]


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    texts = []
    for n in (1, 2, 3, 5, 12, 30, 60, 70, 120, 240, 290, 600):
        for _ in range(2):
            base = [word() for _ in range(n)]
            passage = " ".join(word() for _ in range(20))
            texts.append(" ".join(base))
            for _ in range(14):
                near = [w if rng.random() > rng.choice([0.005, 0.02, 0.04]) else word() for w in base]
                texts.append(" ".join(near) + ("." if rng.random() < 0.1 else ""))
            texts += [" ".join(base)] * 3 + [passage + " " + " ".join(word() for _ in range(n)) for _ in range(4)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("options", [{}, {"block_rows": 4}, {"bands": ((0, 8), (8, 1), (100, 1))}])
def test_components(spark, options):
    docs = documents(spark, corpus() + ODD, extra=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_join.near_duplicates(docs, **options).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute(rows))


@pytest.mark.parametrize("size,threshold", [(5, 80), (2, 60)])
def test_other_sizes(spark, size, threshold):
    docs = documents(spark, corpus(8)[:250])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_join.near_duplicates(docs, size=size, threshold=threshold).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute(rows, size, threshold))
    assert ngram_join.near_duplicates(empty(spark)).collect() == []


def test_hot_ngrams(spark):
    """A passage in most texts, and a large group of near copies: the counters find their n-grams."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, base = [word() for _ in range(25)], [word() for _ in range(80)]
    texts = [" ".join(passage + [word() for _ in range(rng.randint(2, 60))]) for _ in range(150)]
    texts += [" ".join(w if rng.random() > 0.02 else word() for w in base) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    frequent = ngram_join.Frequent()
    frequent.texts = 100
    for _ in range(70):
        frequent.add(np.array([5, 7], np.uint64))
    assert frequent.top()[0].tolist() == [5, 7]
    got = ngram_join.near_duplicates(docs, block_rows=20).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute([*enumerate(texts)]))


@pytest.mark.parametrize("path,shuffled", [(12, False), (60, True)])
def test_components_of_graphs(spark, path, shuffled):
    """Chains, stars with hubs of any place in the order, cycles and random graphs against a search."""
    rng = random.Random(9)
    graphs = [[(i, i + 1) for i in range(path)], [(1000, 1000 + i) for i in range(1, 40)], [(2999, 2900 + i) for i in range(99)]]
    graphs += [[(4000 + i, 4000 + (i + 1) % 30) for i in range(30)] * shuffled, [(5000 + rng.randrange(150), 5000 + rng.randrange(150)) for _ in range(110)], [(7, 7)]]
    names = [*range(8000)]
    if shuffled:  # as the hashes of texts are
        rng.shuffle(names)
    pairs = [(names[a], names[b]) for g in graphs for a, b in g]
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.key: r.label for r in ngram_join.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in root} == root
    assert ngram_join.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_blocks_meet(spark):
    """A cluster of many blocks whose components have to be crossed: groups that share a passage, and near copies on the verge."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(6)]
    texts = []
    for _ in range(6):
        base = passage + [word() for _ in range(34)]
        for _ in range(20):
            texts.append(" ".join(w if rng.random() > 0.03 else word() for w in base))
    got = ngram_join.near_duplicates(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), block_rows=5, threshold=70).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute([*enumerate(texts)], 3, 70))


def test_shared_hashes(spark, monkeypatch):
    """Different texts with the same hash stay apart."""
    real = ngram_join.text_hash
    monkeypatch.setattr(ngram_join, "text_hash", lambda t, seed: real(t, seed) if seed else F.pmod(F.length(t), F.lit(9)).cast("long"))
    docs = documents(spark, corpus(5)[:120] + ODD)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_join.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute(rows))


def test_keep_one(spark, monkeypatch):
    """One row of each component, whatever is broadcast; repeated rows and null ids included."""
    docs = documents(spark, corpus(6)[:200] + ODD, extra=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups, bare = set(), 0
    for d, n, c in brute(rows):
        groups |= {c} if n else set()
        bare += not n
    for few in (ngram_join.FEW, -1):
        monkeypatch.setattr(ngram_join, "FEW", few)
        got = ngram_join.keep_one(docs, size=3, threshold=90)
        assert got.columns == docs.columns
        kept = [(r.doc_id, r.text) for r in got.collect()]
        full = [d for d, t in kept if shingles(t)]
        assert Counter(full) == Counter(groups) and len(kept) == len(full) + bare


def test_local_join():
    rng = random.Random(1)
    base = [rng.sample(range(1000), rng.randint(5, 60)) for _ in range(6)]
    sets = [sorted({x if rng.random() > 0.04 else rng.randrange(1000) for x in b}) for b in base for _ in range(12)]
    links = ngram_join.join_sets(np.concatenate([np.array(s, np.uint64) for s in sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 90)
    root = list(range(len(sets)))
    for pairs in (links, [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len({*sets[i]} & {*sets[j]}) >= 90 * len({*sets[i]} | {*sets[j]})]):
        label = list(range(len(sets)))
        for _ in sets:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        root, before = label, root
    assert root == before
