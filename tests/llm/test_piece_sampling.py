import math
import time
from collections import Counter

import numpy as np
import pytest

from meshwork.llm import piece_sampling as ps
from tests.llm.texts import ODD, documents, empty

MODEL = "piece_bpe_32k.model"
TEXTS = [*(t or "" for t in ODD), " lead", "trail ", " ", "▁", " ▁ a▁", "\n\n", "a\n b", "日本語 text ☃", "z" * 3000, "☃" * 400 + "x", "퟿ \U0010ffff"]


@pytest.fixture(scope="module")
def p():
    return ps.pieces(MODEL, 1.0)


def rows(known, texts, seeds):
    ids, counts = ps.encode(known, texts, np.array(seeds, np.uint64))
    ends = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_round_trip_and_order(p, monkeypatch):
    first = rows(ps.Words(p), TEXTS, range(len(TEXTS)))
    assert [p.decode(x) for x in first] == TEXTS
    known = ps.Words(p)
    back = [rows(known, [t], [i])[0] for i, t in reversed([*enumerate(TEXTS)])][::-1]
    assert back == first  # batches do not matter
    monkeypatch.setattr(ps, "NODES", 10)
    assert [rows(known, [t], [i])[0] for i, t in enumerate(TEXTS)] == first  # nor does what the worker keeps
    assert rows(known, TEXTS, range(7, 7 + len(TEXTS))) != first


def test_long_words(p, monkeypatch):
    """Windows give what one lattice gives, samples follow the posterior, and time grows as the word does."""
    codes = np.frombuffer(("▁" + "thenationaa" * 60 + "☃ab" * 20).encode("utf-32-le"), np.uint32)
    whole = ps.long_word(p, codes, np.uint64(5))
    for size in (37, 100):
        monkeypatch.setattr(ps, "WINDOW", size)
        assert all((a == b).all() for a, b in zip(whole, ps.long_word(p, codes, np.uint64(5)), strict=True))
    known = ps.Words(p)
    for length in (10, 300):  # the same steps and the same draws as the lattices of short words
        monkeypatch.setattr(ps, "LONG", length)
        ids = [rows(known, [t], [3])[0] for t in TEXTS]
        assert [p.decode(x) for x in ids] == TEXTS
    monkeypatch.setattr(ps, "LONG", 2)
    monkeypatch.setattr(ps, "WINDOW", 3)
    n, want = 4000, ways(p, "there")
    got, total = Counter(map(tuple, rows(known, ["there"] * n, range(n)))), sum(want.values())
    assert set(got) <= set(want) and all(abs(got[x] / n - w / total) < 5 * math.sqrt(w / total * (1 - w / total) / n) + 1e-3 for x, w in want.items())
    monkeypatch.undo()
    seconds = []
    for length in (40_000, 400_000):
        text = "".join(chr(97 + (i * i // 7) % 26) for i in range(length))
        begin = time.process_time()
        assert p.decode(rows(known, [text], [1])[0]) == text
        seconds.append(time.process_time() - begin)
    assert seconds[1] < 25 * seconds[0] and seconds[1] < 20


def ways(p, text):
    """All segmentations of a text of one word, with their weights."""
    weight = {ps_text: w for ps_text, w in zip(([p.text[i] for i in p.ids]), p.weights, strict=True)}
    ident = {p.text[i]: int(i) for i in p.ids}
    word = " " + text

    def walk(at):
        if at == len(word):
            yield (), 1.0
        for end in range(at + 1, len(word) + 1):
            piece = word[at:end].encode()
            if piece in weight:
                for rest, w in walk(end):
                    yield (ident[piece], *rest), w * weight[piece]

    return dict(walk(0))


@pytest.mark.parametrize("text", ["there", "aaa", "nation"])
def test_samples_follow_the_posterior(p, text):
    known, n = ps.Words(p), 20_000
    got = Counter(map(tuple, rows(known, [text] * n, range(n))))
    want = ways(p, text)
    total = sum(want.values())
    assert set(got) <= set(want) and len(want) > 3
    for path, w in want.items():
        share = w / total
        assert abs(got[path] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


def test_dataframe(spark):
    docs = documents(spark, TEXTS + [None], extra=True)
    encoded = ps.encode_pieces(docs, carry=("text",))
    got = encoded.collect()
    assert all(r.lossless for r in got) and len(got) == docs.count()
    assert [r.ids for r in got if r.text is None] == [None, None]
    back = ps.decode_pieces(encoded.drop("text")).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, r.text) for r in docs.collect())
    again = ps.encode_pieces(docs.repartition(7)).collect()
    assert Counter((r.doc_id, tuple(r.ids or ())) for r in again) == Counter((r.doc_id, tuple(r.ids or ())) for r in got)
    assert ps.encode_pieces(empty(spark)).collect() == []
