"""Fill-in-middle and the prefix trie on small tables against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tessella.llm import fim, prefix_trie

TEXTS = [None, "", "a", "<", "<P", "x<P>y", "a<S>", "<M>", "<<P<S<M", "> >S> P>", "é中\U0001f600" * 40, "word " * 4000, "same", "same", *(f"text {k} <" for k in range(40))]
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def _fim(i, text):
    """The row that the contract asks for, by slices of the whole text."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    p, m = sorted((a % (len(t) + 1), b % (len(t) + 1)))
    if not t or re.search("<[PSM]>", t) or c % 100 >= 90:
        return i, len(t), "plain", None, None, sha(t), sha(t)
    form = "spm" if d % 100 < 20 else "psm"
    out = f"<P>{t[:p]}<S>{t[m:]}<M>{t[p:m]}" if form == "psm" else f"<S>{t[m:]}<P>{t[:p]}<M>{t[p:m]}"
    return i, len(t), form, p, m - p, sha(out), sha(t)


@pytest.mark.parametrize("chunk", [1, 7, fim.CHUNK])
def test_outputs_and_what_is_rebuilt_from_them(spark, chunk):
    """Null and repeated ids, null, empty and long texts, texts with sentinels and parts of them, clashing columns."""
    data = [(k, t, 1, "x", 2) for k, t in enumerate(TEXTS)] + [(None, "no id", 1, "x", 2), (14, TEXTS[14], 1, "x", 2)]
    if chunk == 1:
        data = [x for x in data if len(x[1] or "") < 1000]
    docs = spark.createDataFrame(data, "doc_id long, text string, row long, form string, n int").repartition(3)
    found = fim.digests(fim.pieces(docs, chunk=chunk))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((_fim(i, t) for i, t, *_ in data), key=repr)
    whole = fim.assembled(fim.pieces(docs, chunk=chunk)).collect()
    assert sorted((sha(r.text) for r in whole)) == sorted(_fim(i, t)[5] for i, t, *_ in data)
    assert fim.digests(fim.pieces(docs.limit(0))).count() == 0


def test_a_damaged_output_is_not_rebuilt_silently(spark):
    docs = spark.createDataFrame([(k, f"some text number {k}") for k in range(50)], "doc_id long, text string")
    cut = fim.pieces(docs).where("form is null or form = 'psm'").withColumnRenamed("piece", "p").selectExpr("row", "position", "translate(p, 'e', 'a') as piece", "doc_id", "n", "form", "prefix_chars", "middle_chars")
    for r in fim.digests(cut).where("form = 'psm'").collect():
        assert r.restored_sha256 != sha(f"some text number {r.doc_id}")


def _trie(data, block=None):
    own = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    whole = {c: own.get(c - c % 20, [])[: h[c]] + v[h[c] :] for c, v in own.items()}
    members = defaultdict(list)
    for c, v in sorted(whole.items()):
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for q in members:
        if q:
            children[q[:-1]] += 1
    for q, cs in members.items():
        for d in range(len(q) + 1):
            leaves[q[:d]] += not children[q]
            saved[q[:d]] += (len(cs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
    ends = lambda q: sha(",".join(str(c) for c in members[q] if len(whole[c]) == len(q)))
    return sorted(((min(cs), len(q), min(members[q[:-1]]) if q else None, len(cs), children[q], leaves[q], saved[q], ends(q)) for q, cs in members.items()), key=repr)


def _found(spark, data, **more):
    df = spark.createDataFrame([(*x, 1, "y") for x in data], "conv_id long, turn long, role string, text string, depth int, x string")
    turns = prefix_trie.numbered(df)
    return sorted(map(tuple, prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns), **more).collect()), key=repr)


@pytest.mark.parametrize("block", [1, 3, 8])
def test_trie(spark, block):
    """Nulls in every column, repeated rows, ties of turns, copies, one conversation of very many turns."""
    rnd = random.Random(block)
    data = []
    for c in range(70):
        if c in (40,):  # a family without its first conversation
            continue
        opening = [("user", f"question {rnd.randint(0, 2)}"), ("assistant", "an answer  of \t words")] * rnd.randint(0, 3)
        rest = [(rnd.choice(["user", None]), rnd.choice(["go on", None, "", "stop here"])) for _ in range(rnd.randint(1, 12))]
        data += [(c, k if rnd.random() < 0.9 else None, *x) for k, x in enumerate(opening + rest)]
    data += [(c, k, "user", f"shared {k}") for c in range(100, 130) for k in range(20 - c % 2)]
    data += [(200, k, "user", f"long {k % 3}") for k in range(700)]
    data += [(5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "assistant", "tie"), (None, 0, "user", "nobody's"), (-3, 0, "user", "below zero")]
    data.sort(key=lambda _: rnd.random())
    want = [x for x in _trie([(c, *x) for c, *x in data if c != -3])]
    assert _found(spark, [x for x in data if x[0] != -3], block=block) == want


def test_trie_without_conversations_and_with_one(spark):
    assert _found(spark, []) == []
    assert _found(spark, [(None, 1, "user", "x")]) == []
    one = [(21, 0, None, None)]
    assert _found(spark, one) == _trie(one)
