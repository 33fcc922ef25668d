"""The prefix trie against a plain trie of tuples and against SQL: shared, copied, absent, odd and hot conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from foliant.llm import prefix_trie, queries

SF = "/root/testdata/sf0.001"


def plain_trie(rows):
    """Nodes as whole tuples of turns; families are found by dictionary, leaves and savings by walking up."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()
            convs[conv].append(((turn is not None, turn or 0, role.encode(), digest), (role, text)))
    turns = {c: [t for _, t in sorted(x, key=lambda y: y[0])] for c, x in convs.items()}
    members = defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        whole = turns.get(c - c % 5, [])[:h] + turns[c][h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        children[node[:-1]] += bool(node)
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1].encode()) if node else 0
    least = {node: own[0][0] for node, own in members.items()}
    ends = {node: hashlib.sha256(",".join(str(c) for c, last in own if last).encode()).hexdigest() for node, own in members.items()}
    return sorted((least[n], len(n), least[n[:-1]] if n else None, len(members[n]), children[n], leaves[n], saved[n], ends[n]) for n in members)


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int")
    return sorted(map(tuple, prefix_trie.prefix_trie(df).collect()))


def drawn(seed, n, longest=12, words=2):
    """Conversations of few words, so that many begin alike."""
    pick = random.Random(seed)
    ids = pick.sample(range(3 * n), n)
    return [(c, t, pick.choice(["user", "assistant"])[: t % 2 * 9 + 4], pick.choice(["a", "é😀", "", "long " * 9][:words])) for c in ids for t in range(pick.randrange(1, longest))]


def test_like_a_plain_trie(spark):
    rows = drawn(1, 70)
    assert trie_of(spark, rows) == plain_trie(rows)


def test_odd_rows(spark):
    rows = drawn(2, 25, words=4)
    rows += [(None, 0, "user", "no conversation"), (500, None, None, "null first"), (500, 3, "user", None), (500, 3, "user", ""), (500, 3, "a", "tie")]
    rows += [(505, 1, "user", "twice")] * 4 + [(506, 1, "user", "twice")] * 3 + [(7001, 0, "user", "base absent")]
    rows += [(c, t, "user", "same") for c in (900, 901, 902, 903, 904, 905) for t in range(12)]
    random.Random(3).shuffle(rows)
    got = trie_of(spark, rows)
    assert got == plain_trie(rows)
    assert any(r[0] == 7001 and r[1] == 1 for r in got) == (zlib.crc32(b"7001") % 9 == 0)


def test_long_and_many_alike(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    monkeypatch.setattr(prefix_trie, "CHAIN", 7)
    rows = [(c, t, "user", "hello") for c in range(60) for t in range(2)]
    rows += [(1000, t, "user", f"turn {t % 50} " * 30) for t in range(400)] + [(1003, t, "user", f"turn {t % 50} " * 30) for t in range(20)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_empty_and_single(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "x")]) == []
    one = [(5, 0, "user", "x")]
    assert trie_of(spark, one) == plain_trie(one)
    turnless = [(6, 0, "user", "own first turn goes, and 5 is not there")]
    assert zlib.crc32(b"6") % 9 > 0
    assert trie_of(spark, turnless) == plain_trie(turnless) == [(6, 0, None, 1, 0, 1, 0, hashlib.sha256(b"6").hexdigest())]


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(queries.OP13_SQL)
    got = queries.op13_prefix_trie(spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"] and [str(t) for t in want.types] == ["BIGINT"] * 7 + ["VARCHAR"]
    rows = con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall()) == plain_trie(rows)
