import random
from collections import Counter

from foliant.llm import decontaminate


def shingles(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items, least=0.8):
    """Best similarity of any window of the item's size, wherever it starts."""
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, s in items:
            v = (s or "").lower().split()
            if not v or not w:
                continue
            k = min(5, len(v))
            want = shingles(v, k)
            for start in range(max(1, len(w) - len(v) + 1)):
                own = shingles(w[start : start + len(v)], k)
                both = sum((own & want).values())
                sim = both / max(1, sum(own.values()) + sum(want.values()) - both)
                if sim >= least and sim > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (sim, start)
    return out


def corpus():
    rng = random.Random(4)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op".split()) + str(rng.randrange(60))
    items = [(i, " ".join(word() for _ in range(rng.randrange(20, 70)))) for i in range(25)]
    items += [(90, "tiny item"), (91, None), (92, "  "), (93, "again and again " * 9), (0, items[0][1])]
    docs = []
    for d in range(120):
        w = [word() for _ in range(rng.randrange(1, 200))]
        if d % 3 == 0:
            v = items[rng.randrange(25)][1].split()
            for _ in range(rng.randrange(0, 3)):
                at = rng.choice([0, 1, len(v) - 1, rng.randrange(len(v))])
                v[at : at + 1] = rng.choice([[], [word()], [word(), word()]])
            at = rng.randrange(len(w))
            w[at:at] = v
        docs.append((d, " ".join(w).upper() if d % 2 else "\n".join(w)))
    docs += [(500, None), (501, ""), (502, " \n\t"), (503, "tiny item"), (504, "again and again " * 3000), (None, items[3][1]), (506, "x " + items[4][1]), (506, "y " + items[4][1]), (507, items[5][1]), (507, items[5][1])]
    return docs, items


def test_matches_all_windows(spark):
    docs, items = corpus()
    d = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id long, text string, start string")
    b = spark.createDataFrame([(a, x, 1) for a, x in items], "item_id long, text string, n int")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.overlaps(d, b).collect()}
    want = brute(docs, items)
    assert len(want) > 30 and set(got) == set(want)
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 for k in want)
    texts, sizes = {}, dict(items)
    for i, t in docs:
        texts.setdefault(i, []).append((t or "").lower().split())
    for (i, item), (sim, start) in got.items():  # the place that is named has that similarity
        v, k = sizes[item].lower().split(), min(5, len(sizes[item].split()))
        near = [shingles(w[start : start + len(v)], k) for w in texts[i]]
        assert any(abs(sum((x & shingles(v, k)).values()) / max(1, sum((x | shingles(v, k)).values())) - sim) < 1e-12 for x in near)
    kept = decontaminate.without_contaminated(d, b)
    assert kept.columns == d.columns
    bad = {k for k, _ in want}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _ in docs if i not in bad)


def test_without_broadcast_and_empty(spark, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.overlaps(d.limit(0), b).count() == decontaminate.overlaps(d, b.limit(0)).count() == 0
    want = decontaminate.overlaps(d, b).count()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert decontaminate.overlaps(d, b).count() == want
    plan = decontaminate.overlaps(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_worn_and_stretched_passages(spark):
    """The best window lies between those aligned with the item by a shingle."""
    items, docs = [], []
    for i, (n, off, more) in enumerate([(100, 3, 5), (200, 8, 16)]):
        v = [f"w{i}x{j}" for j in range(n)]
        items.append((i, " ".join(v)))
        passage = v[off : n // 2] + [f"new{j}" for j in range(more)] + v[n // 2 : n - off]
        docs += [(10 * i + j, " ".join([f"a{x}" for x in range(before)] + passage + [f"z{x}" for x in range(after)])) for j, (before, after) in enumerate([(40, 40), (0, 40), (40, 0), (0, 0)])]
    docs.append((50, " ".join(docs[0][1].split() * 2)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert {(0, 0), (10, 1)} <= set(want)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.overlaps(d, b).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k][0]) < 1e-12 for k in want)


def test_blocks_miss_no_fingerprint_within_the_radius():
    rng = random.Random(5)
    for radius, m in ((18, 6), (18, 5), (7, 4), (3, 8)):
        blocks, masks = decontaminate._blocks(m), [set(x) for x in decontaminate._masks(radius, m)]
        assert sum(n for _, n in blocks) == 64
        for _ in range(3000):
            differ = sum(1 << b for b in rng.sample(range(64), rng.randrange(radius + 1)))
            assert any((differ >> first) & (2**n - 1) in near for (first, n), near in zip(blocks, masks))
