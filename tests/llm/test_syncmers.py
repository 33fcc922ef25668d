import base64
import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import syncmers


def brute_anchor_places(data, k=syncmers.K, s=syncmers.S):
    if len(data) < k:
        return []
    h = [int(syncmers._smers(np.frombuffer(data[i : i + s], np.uint8), s)[0]) for i in range(len(data) - s + 1)]
    out = []
    for i in range(len(data) - k + 1):
        inner = h[i : i + k - s + 1]
        if inner.index(min(inner)) in (0, len(inner) - 1):
            out.append(i)
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=150) | st.text(alphabet="ab", max_size=200).map(str.encode))
def test_anchors_are_the_closed_syncmers(data):
    places = brute_anchor_places(data)
    got = syncmers.anchors(data)
    assert len(got) == (len(places) or bool(data))
    alone = [syncmers.anchors(data[i : i + syncmers.K])[0] for i in places]  # context-free
    assert not places or got.tolist() == alone


def test_chunks(monkeypatch):
    data = bytes(random.Random(1).choices(b"abcdefgh ", k=5000))
    whole = syncmers.anchors(data)
    monkeypatch.setattr(syncmers, "CHUNK", 97)
    assert len(whole) > 300 and syncmers.anchors(data).tolist() == whole.tolist()


def brute_likeness(a, b):
    x, y = ([f[i : i + 4] for i in range(0, len(f), 4)] for f in (a, b))
    if a == b:
        return 1.0
    if not x or not y:
        return 0.0
    seen, pairs = {}, []
    for i, h in enumerate(x):
        n = seen[h] = seen.get(h, -1) + 1
        at = [j for j, g in enumerate(y) if g == h]
        if n < len(at):
            pairs.append((i, at[n]))
    best = []
    for k, (_, j) in enumerate(pairs):
        best.append(1 + max((best[m] for m in range(k) if pairs[m][1] < j), default=0))
    return 2 * max(best, default=0) / (len(x) + len(y))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=30), st.lists(st.sampled_from("abcde"), max_size=30))
def test_likeness(a, b):
    a, b = ("".join(base64.b64encode(c.encode() * 3).decode() for c in x) for x in (a, b))
    assert abs(syncmers.likeness(a, b) - brute_likeness(a, b)) < 1e-12


def test_rows(spark):
    rng = random.Random(2)
    words = ["ab", "cde", "fgh", "ié", "jkl", "😀mn"]
    texts = ["".join(rng.choice(words) + " " for _ in range(rng.randrange(400))) for _ in range(150)]
    rows = [(i * 7 - 300, t) for i, t in enumerate(texts)] + [(None, "first of all"), (5000, None), (5001, ""), (5002, texts[3]), (5003, texts[3]), (5004, "the and " * 300_000), (9, texts[9]), (9, texts[9])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fingerprint string").repartition(6)
    got = syncmers.compare_with_next(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    want = set()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        new = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        fp, new_fp, next_fp = map(syncmers.fingerprint, (t, new, u))
        want.add((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fp, new_fp, syncmers.likeness(fp, new_fp), syncmers.likeness(fp, next_fp)))
    assert {tuple(r) for r in got} == want
    long_ones = [r for r in got if 500 < r.n_chars < 10**6]
    assert sum(r.near_edited for r in long_ones) / len(long_ones) > 0.65 and sum(r.near_next for r in long_ones) / len(long_ones) < 0.2
    assert syncmers.compare_with_next(docs.limit(0)).count() == 0
    assert syncmers.compare_with_next(docs.where("doc_id = 5002")).count() == 1
    assert syncmers.fingerprints(docs).columns == docs.columns


def test_likeness_at_every_length():
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefghij klmnop", k=1200))
    of = lambda a, b: syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(b))
    for n in (300, 380, 399, 400, 401, 419, 450, 533, 700):
        assert of(text[:n], syncmers.edited(text[:n], "short")) > 0.6, n
        assert of(text[: n - 2], text[:n]) > 0.9, n
    assert of(text, text[:399]) > 0.4 and 0.3 < of(text[:390], text[:1000]) < 0.8  # 780 of 1,390
    assert of(text[:399], text[600:1100]) < 0.02 and of("", text[:399]) == 0 and of("", "") == 1


def test_a_repetitive_text_keeps_its_anchors():
    of = lambda a, b: syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(b))
    for text in ("ab" * 3000, "a" * 3000, "the and " * 500):
        places = brute_anchor_places(text.encode()[:600])
        assert max(np.diff([-1, *places])) <= syncmers.K - syncmers.S
        assert of(text, syncmers.edited(text, "something else " * 200)) > 0.6


def test_rows_of_one_id_are_dealt_to_many_parts(spark):
    rows = [(None, f"text {i} of no id " * 3) for i in range(300)] + [(i, f"text {i} of an id " * 3) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = docs.select(F.coalesce("doc_id", F.lit(syncmers.LEAST)).alias("doc"), F.col("text").cast("binary").alias("text"))
    dealt = syncmers._dealt(keyed, 10).where(~F.col("after"))
    per_part = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert sum(per_part) == 500 and max(per_part) < 150
    got = syncmers.compare_with_next(docs).collect()
    assert len(got) == 500
    order = [r for r in sorted(dealt.collect(), key=lambda r: (r.part, r.doc, r.h))]
    assert [(r.doc, r.h) for r in order] == sorted((r.doc, r.h) for r in order)
    want = {(a.doc, hashlib.sha256(syncmers.edited(a.text.decode(), b.text.decode()).encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1])}
    assert {(syncmers.LEAST if r.doc_id is None else r.doc_id, r.edited_sha256) for r in got} == want
