import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from foliant.llm import simhash
from foliant.llm.common import connected_components


def brute_fp(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=4):
    ids = list(range(len(fps)))
    root = dict(zip(ids, ids))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids[:i]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in ids]


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="abAB é\t\n x.", max_size=80))
def test_fingerprint(text):
    assert simhash.simhash(text.encode()) == brute_fp(text)


def test_allocate_is_least():
    rng = random.Random(3)
    for _ in range(30):
        costs = [[0.0] + sorted(rng.random() * 100 for _ in range(5)) for _ in range(3)]
        best = min((sum(c[t + 1] for c, t in zip(costs, ts)), ts) for a in range(-1, 5) for b in range(-1, 5) for c in range(-1, 5) if sum(ts := (a, b, c)) == 2)
        assert abs(simhash.allocate(costs, 2)[0] - best[0]) < 1e-9


def clustered(n, seed, centres=6):
    rng = random.Random(seed)
    c = [rng.getrandbits(64) for _ in range(centres)]
    out = []
    for _ in range(n):
        x = rng.choice(c) if rng.random() < 0.8 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randrange(0, 7)):
            x ^= 1 << b
        out.append(x)
    return list(dict.fromkeys(out))


def roots_of(spark, fps, **kw):
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.links(distinct, **kw)).collect()}
    return [got.get(x, x) for x in signed]


def same_classes(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b)))


def test_links_match_brute_force_also_in_blocks(spark):
    fps = clustered(400, 5)
    want = brute_components(fps)
    assert same_classes(roots_of(spark, fps), want)
    assert same_classes(roots_of(spark, fps, block=16), want)


def test_thresholds_over_zero(spark, monkeypatch):
    fps = clustered(200, 8)
    monkeypatch.setattr(simhash, "ROW_COST", 1e-6)
    groups, thresholds = simhash.plan(spark.createDataFrame([(x,) for x in np.array(fps, np.uint64).view(np.int64).tolist()], "fp long"), 4)
    assert sum(thresholds) == 4 - len(groups) + 1
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert same_classes(roots_of(spark, fps, radius=2), brute_components(fps, 2))


def test_rows(spark):
    rng = random.Random(1)
    base = [rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) + str(rng.randrange(40)) for _ in range(300)]
    texts = [" ".join(base), " ".join(base).upper(), " ".join(base[:150] + ["new"] + base[151:]), None, "", "\n\t", "one", "ONE", "x " * 3000, "one two three four"]
    ids = [30, 10, 20, 5, 6, 7, None, 9, 3, 4]
    docs = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)] + [(30, texts[0], "y")], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    fps = [brute_fp(t) for t in texts]
    classes = brute_components(fps)
    want = [(i, f"{f:016x}", min([k for k, c in zip(ids, classes) if c == classes[n] and k is not None], default=None)) for n, (i, f) in enumerate(zip(ids, fps))]
    assert sorted(map(tuple, got), key=str) == sorted([*want, want[0]], key=str)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})  # a row of each group, also of repeated rows
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long")).withColumn("doc_key", F.lit("clash"))
    one = simhash.one_of_each(nameless)
    assert one.columns == nameless.columns and one.count() == len(set(classes))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_chain_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in connected_components(chain).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
