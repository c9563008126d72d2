"""Context-tree weighting against the recursion that defines it."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import ctw

TEXTS = ["the cat sat on the mat", "the cat ate THE rat", None, "", "\n", "é中\U0001f600 é", "abab" * 50, "the cat sat on the mat", "zq", "a b\x1cc\td\x0be  f"]


def _held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def _symbols(text, depth):
    raw = b"\xff" * depth + (text or "").encode() + b"\xff"
    return [(raw[k - depth : k][::-1], raw[k]) for k in range(depth, len(raw))]


class _Tree:
    """The weighted probability of all bits with one prefix, by recursion over contexts."""

    def __init__(self, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])

    def add(self, context, bit, n=1):
        for d in range(self.depth + 1):
            self.counts[context[:d]][bit] += n

    def log_weighted(self, context=b""):
        a, b = self.counts.get(context, (0, 0))
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(context) == self.depth:
            return own
        below = sum(self.log_weighted(c) for c in [*self.counts] if len(c) == len(context) + 1 and c[:-1] == context and sum(self.counts[c]))
        top = max(own, below)
        return top + math.log((math.exp(own - top) + math.exp(below - top)) / 2)


def _brute_score(rows, depth):
    """log10 of each text: the ratio of weighted probabilities with and without one more bit, bit by bit."""
    trees = defaultdict(lambda: _Tree(depth))
    bits = lambda byte: [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]
    for i, t in rows:
        if not _held(i):
            for context, byte in _symbols(t, depth):
                for prefix, bit in bits(byte):
                    trees[prefix].add(context, bit)
    before, known = {}, {}

    def of(context, prefix, bit):
        if (context, prefix, bit) not in known:
            tree = trees[prefix]
            before.setdefault(prefix, tree.log_weighted())
            tree.add(context, bit)
            known[context, prefix, bit] = tree.log_weighted() - before[prefix]
            tree.add(context, bit, -1)
        return known[context, prefix, bit]

    return [sum(of(context, *x) for context, byte in _symbols(t, depth) for x in bits(byte)) / math.log(10) for _, t in rows]


def _base(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    c = Counter(w for i, t in rows if not _held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t))) for _, t in rows]


@pytest.mark.parametrize("depth,slice_bytes,block", [(2, 16 << 20, 1 << 20), (3, 30, 7), (5, 1, 1 << 20)])
def test_scores_are_those_of_the_definition(spark, monkeypatch, depth, slice_bytes, block):
    """Null and repeated ids, null, empty and other texts; columns with clashing names; many slices and one."""
    for name, value in (("SLICE_BYTES", slice_bytes), ("CHUNK_BYTES", max(8, slice_bytes // 2)), ("BLOCK", block), ("RUN", 16)):
        monkeypatch.setattr(ctw, name, value)
    rows = [*enumerate(TEXTS), (None, "no id at all"), (4, TEXTS[4]), (6, "abab" * 50)]
    assert {_held(i) for i, _ in rows} == {True, False}
    docs = spark.createDataFrame([(i, t, 1, True, 0.5) for i, t in rows], "doc_id long, text string, h int, held boolean, score double").repartition(2)
    found = sorted(map(tuple, ctw.score(docs, depth=depth).collect()), key=lambda r: (repr(r[0]), r[-2]))
    want = sorted(((i, _held(i), *b, s, len((t or "").encode())) for (i, t), b, s in zip(rows, _base(rows), _brute_score(rows, depth))), key=lambda r: (repr(r[0]), r[-1]))
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a[:5] == b[:5] and a[7] == b[7]
        assert np.allclose(a[5:7], b[5:7], rtol=1e-9)
        assert math.isclose(a[8], -a[6] * math.log2(10) / (a[7] + 1))


def test_probabilities_of_next_bytes_sum_to_one():
    rnd = np.random.default_rng(1)
    texts = b"".join(bytes(rnd.choice([97, 98, 99, 32], 40).astype(np.uint8)) for _ in range(5))
    seen = np.concatenate([*ctw.grams(np.frombuffer(texts, np.uint8), np.array([0, len(texts)]), 3)])
    asked = (seen[:20, None] >> 8 << 8 | np.arange(256)).ravel()
    keys, first = np.unique(np.concatenate([seen, asked]), return_index=True)
    n = np.array([(seen == k).sum() for k in keys])
    q, nodes = ctw.subtrees(keys, n, 3)
    value = dict(zip(keys.tolist(), ctw.Top(list(zip(*(x.tolist() for x in nodes)))).log10(keys, q, 3)))
    for row in asked.reshape(-1, 256).tolist():
        assert math.isclose(sum(10 ** value[k] for k in row), 1, rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(60) if _held(k)], "doc_id long, text string")
    for r in ctw.score(docs).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0)
        assert math.isclose(r.bits_per_byte, 8)
    assert ctw.score(docs.limit(0)).count() == 0


def test_scores_of_a_long_text_and_of_held_out_texts(spark, sf):
    """A model of more texts gives shorter codes; a text longer than a slice is scored whole."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = ctw.score(docs)
    held = found.where("held_out").agg(F.avg("bits_per_byte").alias("b")).first().b
    assert held < 3
    long = spark.createDataFrame([(0, "a long text, over and over again; " * 100_000), (1, "x")], "doc_id long, text string")
    r = ctw.score(long).where("doc_id = 0").first()
    assert r.n_bytes == 3_400_000 and r.bits_per_byte < 0.1


def test_log_gamma():
    x = np.concatenate([np.arange(0.5, 60, 0.5), 10.0 ** np.arange(2, 12)])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)
