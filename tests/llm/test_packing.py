import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliant.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
OWN = packing.ChunkTokenizer(PATH)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["It's", " ", "é", "É", "é", "\n", "12", "x1y", "...", "WORLD'LL", " ", "\x85", "ß", "İ", "Σ", "ΑΣ ", "中文", "<|endoftext|>", "\t", "-", "_a_", "ﬁ", "ǅ"]), max_size=12).map("".join)))
def test_ids_are_the_tokenizers(text):
    want = WHOLE.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(OWN.ids(text.encode()), "<u4").tolist() == want


def padding(totals):
    return sum(0 if t & (t - 1) == 0 else 2048 - t for t in totals) / sum(totals)


def test_tiers_hold_each_piece_once_with_little_padding():
    rng = random.Random(2)
    lengths = [min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(5000)]
    sequences = packing.pack_lengths(lengths)
    assert sorted(i for _, s in sequences for i in s) == list(range(5000))
    totals = [sum(lengths[i] for i in s) for _, s in sequences]
    assert all(total == tier or total < tier == 2048 for total, (tier, _) in zip(totals, sequences))
    tiers = Counter(tier for tier, _ in sequences)
    assert all(tiers[t] > 50 for t in packing.TIERS)
    for tier, s in sequences:  # a piece is in its own tier's window or fills the gap of a longer one
        assert all(packing.tier_of(lengths[i]) <= tier for i in s)
    assert padding(totals) < 0.002


def test_tiers_are_packed_each_and_fill_longer_gaps():
    assert [packing.tier_of(n) for n in (1, 256, 257, 512, 513, 1024, 1025, 2048)] == [256, 256, 512, 512, 1024, 1024, 2048, 2048]
    assert sorted(packing.pack_lengths([300, 212, 300, 212])) == [(512, [0, 1]), (512, [2, 3])]
    assert packing.pack_lengths([2000, 48, 300]) == [(2048, [0, 1]), (2048, [2])]  # a gap is filled from the shortest tier
    assert packing.pack_lengths([700, 800, 500]) == [(2048, [1, 0, 2])]  # windows of 1,024 that stay open go together
    assert packing.pack_lengths([]) == []


def test_step_groups_are_balanced():
    rng = random.Random(3)
    sequences = [(rng.choice(packing.TIERS), rng.random() * 1e6) for _ in range(4000)]
    load, ids = defaultdict(float), Counter()
    for g, (tier, cost) in zip(packing.step_groups(sequences), sequences):
        load[g] += cost
        ids[g] += tier
    assert max(load.values()) < 1.05 * min(load.values()) and max(ids.values()) < 1.1 * packing.STEP_IDS
    assert packing.step_groups([]) == []


def test_rows(spark):
    texts = ["one two three", "", None, "word " * 5000, "word " * 2047, "one two three", "a b " * 128 ]
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, start string")
    got = packing.pack(docs).collect()
    ids = {i if i else None: WHOLE.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    for doc, rows in by_doc.items():
        rows.sort(key=lambda r: r.start)
        assert [r.start for r in rows] == list(np.cumsum([0] + [r.length for r in rows[:-1]])) and sum(r.length for r in rows) == len(ids[doc])
    for rows in by_seq.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(np.cumsum([0] + [r.length for r in rows[:-1]])) and sum(r.length for r in rows) <= 2048
    assert set(by_doc) == set(ids)
    assert packing.pack(docs.limit(0)).count() == 0


def test_kept_ids_are_bounded(monkeypatch):
    """Chunks and words share one table of at most CACHE entries, none of them long; ids are those of the tokenizer."""
    monkeypatch.setattr(packing, "CACHE", 100)
    tok = packing.ChunkTokenizer(PATH)
    text = " ".join(f"Word{i}, word{i} won't {'y' * 70 if i % 50 == 0 else i}" for i in range(400))
    ids = np.frombuffer(tok.ids(text.encode()), "<u4").tolist()
    assert ids == tok.whole.encode(text, add_special_tokens=False).ids
    others = [x for x in vars(tok).values() if isinstance(x, dict) and x is not tok.alphabet]
    assert len(tok) + sum(map(len, others)) == 100
    assert all(len(x) < 64 for x in tok)
