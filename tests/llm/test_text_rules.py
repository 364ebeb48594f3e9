import hashlib
import itertools
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshwork.llm import decontamination, quality_classifier, quality_rules, token_counts
from tests.llm.texts import ODD, documents, empty

SPACE = "[^\x20\x09-\x0d]+"


def base_counts(text):
    text = text or ""
    words = re.findall(SPACE, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def test_base_counts(spark):
    docs = documents(spark, extra=True)
    got = quality_rules.quality_rules(docs).collect()
    want = Counter((r.doc_id, *base_counts(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept == (not r.base_failed) for r in got)
    assert quality_rules.quality_rules(empty(spark)).collect() == []


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(n))


def line_words(text):
    """(normalised line, words) of the lines of a text that have words."""
    lines = [re.findall(SPACE, re.sub("[A-Z]+", lambda m: m[0].lower(), line)) for line in (text or "").split("\n")]
    return [(" ".join(w), len(w)) for w in lines if w]


def brute_lines(rows, limit):
    """Lines over the limit, as (host, line), of rows (text, host)."""
    docs = {(host or "", tuple(line_words(text))) for text, host in rows}
    return {x for x, n in Counter((host, line) for host, lines in docs for line in {line for line, _ in lines}).items() if n > limit}


def brute_rules(rows, limit):
    """(removed_words, kept) of each row."""
    over, out = brute_lines(rows, limit), []
    for text, host in rows:
        n, *_, failed = base_counts(text)
        removed = sum(words for line, words in line_words(text) if (host or "", line) in over)
        out.append((removed, not failed and not (removed and n - removed < 0.15 * n)))
    return out


@pytest.fixture(scope="module")
def pages():
    """(text, host): template pages, clean pages with a footer, copies, texts that differ only in their line breaks."""
    rng = random.Random(5)
    shared = [f"Shared footer number {i} of this host with some words" for i in range(30)]
    own = ["\n".join(_words(rng, 12) for _ in range(6)) for _ in range(40)]
    mixed = [t + "\n" + shared[i % 2].upper() + " \n\n" for i, t in enumerate(own)]
    only = ["\n".join(rng.sample(shared, 12)) for _ in range(60)]
    template = ["\n".join([*(f"part {i} of one template that all pages have" for i in range(9)), _words(rng, 6)]) for _ in range(60)]
    broken = [re.sub(r"\s+", lambda m: rng.choice(["\n", " "]), only[0]) for _ in range(30)]
    texts = [*mixed, *only, *template, *broken, *[own[1]] * 50, *ODD]
    return [(t, [None, "", "h", "other"][i % 7 % 4]) for i, t in enumerate(texts)]


@pytest.mark.parametrize("limit", [2_000_000, 0, -1])
def test_frequent_lines(spark, pages, limit):
    """The same verdicts, whether the lines are broadcast or joined, as brute force has them."""
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(pages)], "doc_id long, text string, source string").repartition(3)
    for line_limit in (3, 10):
        want = brute_rules(pages, line_limit)
        got = {r.doc_id: (r.removed_words, r.kept) for r in quality_rules.quality_rules(docs, line_limit=line_limit, max_broadcast=limit).collect()}
        assert [got[i] for i in range(len(pages))] == want and 50 < sum(kept for _, kept in want) < 200
        kept = {r.doc_id for r in quality_rules.keep_documents(docs, line_limit=line_limit, max_broadcast=limit).collect()}
        assert kept == {i for i, x in enumerate(want) if x[1]}


@pytest.mark.parametrize("limit", [2_000_000, -1])
def test_lines_are_cut(spark, pages, limit):
    docs = spark.createDataFrame([(i, *x, 1) for i, x in enumerate(pages)], "doc_id long, text string, source string, `line` int").repartition(3)
    over = brute_lines(pages, 10)
    cut = quality_rules.remove_frequent_lines(docs, line_limit=10, max_broadcast=limit)
    assert cut.columns == docs.columns
    got = {r.doc_id: r.text for r in cut.collect()}
    for i, (text, host) in enumerate(pages):
        stay = [x for x in (text or "").split("\n") if not line_words(x) or (host or "", line_words(x)[0][0]) not in over]
        assert got[i] == (None if text is None else "\n".join(stay))
    assert sum(got[i] != pages[i][0] for i in got) > 100
    assert quality_rules.remove_frequent_lines(empty(spark), max_broadcast=limit).collect() == []


def brute_benchmark(text, items, window=10):
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    words, hit, found = find(text), set(), set()
    for i, t in items:
        w = find(t)
        size = min(window, len(w))
        for a in range(len(w) - size + 1 if size else 0):
            for b in range(len(words) - size + 1):
                if words[b : b + size] == w[a : a + size]:
                    hit.update(range(b, b + size))
                    found.add(i)
    ids = sorted(str(i) for i in found if i is not None)
    return len(words), len(hit), ids


ITEMS = [(1, "brown FOX jumps over the lazy dog while seven wizards quietly box"), (2, "one"), (10, "special"), (11, None), (12, ""), (None, "dolor sit"), (2, "two"), (3, "İ￿ 😀😀"), (13, "nobody minds the quick")]


@pytest.mark.parametrize("size", [1 << 20, 900])
def test_benchmark(spark, size):
    docs = documents(spark, extra=True)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontamination.find_benchmark(docs, bench, max_index_bytes=size).collect()
    want = Counter((r.doc_id, *(str(x) for x in brute_benchmark(r.text, ITEMS))) for r in docs.collect())
    assert Counter((r.doc_id, str(r.n_words), str(r.n_hit), str(r["items"])) for r in got) == want
    assert sum(r.n_hit > 0 for r in got) > 8
    assert decontamination.find_benchmark(empty(spark), bench).collect() == []
    assert all(r.n_hit == 0 for r in decontamination.find_benchmark(docs, bench.limit(0)).collect())


def test_index_size():
    """The index keeps within the estimate that parts are made by, and so does what the tasks build of it."""
    rng = random.Random(2)
    texts = [_words(rng, rng.choice([1, 5, 40, 300])) for _ in range(3000)] + ["a b c d e f g h i j k l m " * 2000]
    decontamination.index(texts, 10)  # tables of powers, which stay
    tracemalloc.start()
    found = decontamination.index(texts, 10)
    finder = decontamination.Finder(found, texts)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    words = sum(len(t.split()) for t in texts)
    bound = decontamination._WORD_BYTES * words + sum(map(len, texts))
    assert sum(x.nbytes for x in found.values()) - (len(found) - 1) * found[10].data.nbytes < bound
    assert held < 2 * bound and peak < 5 * bound and len(finder.sizes) == 3


def test_equal_hashes(monkeypatch):
    """Windows of other words with the same hash are told apart."""
    real = decontamination.k.window_hashes
    monkeypatch.setattr(decontamination.k, "window_hashes", lambda w, size: (real(w, size)[0] % np.uint64(3), real(w, size)[1]))
    finder = decontamination.Finder(decontamination.index([t for _, t in ITEMS], 10), [None if i is None else str(i) for i, _ in ITEMS])
    for text in [*ODD, *(t for _, t in ITEMS)]:
        for s in decontamination.k.slices(pa.array([text], pa.string())):
            n, items, _, hit = finder(s)
            assert (n[0], hit.sum(), sorted(i for i in items[0] if i is not None)) == brute_benchmark(text, ITEMS)


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "é keep this, special words also kept"), (2, "special"), (3, None), (4, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "special words")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontamination.remove_spans(docs, bench).collect()}
    assert got == {1: "é keep this,  also kept", 2: "special", 3: None, 4: "clean text"}
    assert decontamination.items_digest(["1", "2"]) == hashlib.sha256(b"1,2").hexdigest()


@pytest.mark.parametrize("model", ["piece_bpe_32k.model", "byte_bpe_50k.json"])
def test_token_counts(spark, model):
    import public_tokenizers as P

    if model.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=str(P.path(model)))
        size = lambda t: len(sp.encode(t))
    else:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(str(P.path(model)))
        size = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    docs = documents(spark, ODD + [" lead", "trail ", "a  b", "▁", " ▁ ", "\n a\n", "many words " * 3000], extra=True)
    got = token_counts.token_counts(docs, model).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), size(r.text or ""), size(r.text or "") > 4096) for r in docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.token_counts(empty(spark), model).collect() == []


def test_small_cache_counts_alike(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 3)
    few, many = token_counts.Lengths("piece_bpe_32k.model", {}), token_counts.Lengths("piece_bpe_32k.model", {"lazy": 1})
    many.cache.clear()
    assert [few(t) for t in ODD] == [len(few.tokenizer.model.encode(t or "")) for t in ODD]


def brute_statistics(text):
    """The features of a text, by plain loops over its bytes."""
    data = (text or "").encode()
    words, n = [w for w in re.split(rb"[\x20\x09-\x0d]+", data) if w], max(len(data), 1)
    share = lambda chars: math.log(sum(c in chars for c in data) / n + 1e-3)
    m, sizes = max(len(words), 1), [len(w) for w in words]
    mean = sum(sizes) / m
    spread = math.sqrt(max(sum(x * x for x in sizes) / m - mean**2, 0))
    letters = sum(c >= 0x80 or chr(c).isalpha() for c in data) / n
    upper = range(0x41, 0x5B)
    return [
        math.log1p(len(words)), math.log1p(mean), math.log1p(spread), share(upper), share(b"0123456789"), share(b"#*$%&|<>@^~_=+{}[]\\/"), share(b"!?"), share(b".,;:"), math.log(letters + 0.02),
        math.log((data.count(b"\n") + 1) / m), math.log(sum(a == b for a, b in itertools.pairwise(words)) / m + 1e-3), math.log(len({*words}) / m + 1e-2),
        math.log((len({*itertools.pairwise(words)}) + 1) / m + 1e-2), math.log(sum(w[0] in upper for w in words) / m + 1e-2),
    ]


def brute_scores(texts, labelled, shrink=50.0, ridge=0.02):
    """Posterior of class 1 from two normal densities with shrunken covariances, by inverses and determinants; labelled: (place, label)."""
    x = np.array([brute_statistics(t) for t in texts])
    sets = [x[[i for i, y in labelled if y == c]] for c in (0, 1)]
    covs = [np.cov(z.T, bias=True) for z in sets]
    total = sum(map(len, sets))
    pooled = sum(len(z) * c for z, c in zip(sets, covs, strict=True)) / total
    density = []
    for z, cov in zip(sets, covs, strict=True):
        keep = len(z) / (len(z) + shrink)
        s = (1 - ridge) * (keep * cov + (1 - keep) * pooled) + ridge * np.diag(np.diag(pooled) + 1e-3)
        away = x - z.mean(axis=0)
        density.append(math.log(len(z) / total) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(s), away))
    return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def test_scores_against_brute_force(spark):
    rng = random.Random(13)
    texts = [*ODD]
    for i in range(160):
        words = _words(rng, rng.randint(1, 60)).split()
        texts.append(rng.choice([" ", "\n", " # ", "\t"] if i % 2 else [" ", ". ", ", "]).join(w.capitalize() if rng.random() < 0.2 else w for w in words) + rng.choice(["", "!", " 12", "é"]))
    labelled = [(i, i % 2) for i in range(len(texts)) if i % 3]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = [(i, y, 0) for i, y in labelled] + [(i, y, 1) for i, y in labelled[:30]] + [(None, 1, 0), (7, 5, 0), (10_000, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.quality_scores(docs, labels).collect()}
    want = brute_scores(texts, labelled)
    assert max(abs(got[i].score - want[i]) for i in range(len(texts))) < 1e-9
    assert all(r.predicted == (r.score >= 0.7) for r in got.values()) and len({r.predicted for r in got.values()}) == 2


def test_quality_scores(spark):
    rng = random.Random(3)
    good = [(2 * i, "\n".join(_words(rng, 15).capitalize() + "." for _ in range(rng.randint(1, 6)))) for i in range(150)]
    bad = [(2 * i + 1, rng.choice(["### ", "!! ", " | "]).join(_words(rng, rng.randint(20, 60)).split())) for i in range(150)]
    docs = spark.createDataFrame(good + bad + [(None, None), (1000, ""), (1001, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (9, 7, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.quality_scores(docs, labels, train=F.col("__key") % 4 < 2).collect()}
    held = [r for i, r in got.items() if i is not None and i < 300 and i % 4 >= 2]
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 303 and got[1000].score == got[1001].score
    assert {r.score for r in quality_classifier.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality_classifier.quality_scores(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert quality_classifier.quality_scores(empty(spark), labels).collect() == []
