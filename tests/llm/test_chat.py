import random

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import chat


def labelled(n=60):
    rng = random.Random(3)
    rows = []
    for c in range(n):
        t = 0
        if c % 5 == 0:
            rows.append((c, 0, "system", "You are kind."))
            t = 1
        for k in range(rng.randrange(1, 4)):
            rows.append((c, t + 2 * k, "user", " ".join("why" for _ in range(rng.randrange(2, 9))) + "?"))
            rows.append((c, t + 2 * k + 1, "assistant", "\n".join("so it is " * rng.randrange(3, 30) + "." for _ in range(rng.randrange(1, 5)))))
    return rows


def model(spark):
    return chat.fit(spark.createDataFrame(labelled(), "conv_id long, turn long, role string, text string"))


def score(m, texts, states):
    before, total = chat.START, 0
    for e, t in zip(m.emissions(texts), states):
        total += int(m.moves[before, t] + e[t])
        before = t
    return total


def test_markers():
    assert [chat.marker(x)[0] for x in ("User: hi", "[assistant] x", "### System", "Q: a", "a fine day", "AI:", "**Human**: x", "me", "<|user|> x", "users: x", "A: b")] == [2, 3, 1, 2, 0, 3, 2, 0, 2, 0, 3]
    line = "Human: hello"
    assert line[chat.marker(line)[1] :] == "hello"


def test_path_is_the_best(spark):
    m = model(spark)
    rng = random.Random(7)
    for _ in range(20):
        texts = ["\n".join(rng.choice(["User: why?", "so it is", "AI: ok.", "", "what?"]) for _ in range(rng.randrange(1, 3))) for _ in range(2)]
        s = m.emissions(texts)
        got = m.path(s, chat.START)
        best = {chat.START: 0}
        for e in s:
            best = {t: max(v + int(m.moves[a, t] + e[t]) for a, v in best.items()) for t in range(chat.STATES)}
        assert score(m, texts, got) == max(best.values())
        assert m.transfer(s)[chat.START].max() == max(best.values())


def test_raw_transcripts(spark):
    m = model(spark)
    text = "System: You are kind.\nHuman: why why why?\nAI: so it is so it is so it is.\nso it is so it is so it is so it is.\nUser: why why?\nso it is so it is so it is so it is so it is so it is so it is."
    rows = [(1, None, text), (None, 0, None), (2, 0, ""), (3, 0, "why?"), (3, 0, "why?"), (4, 0, "so it is " * 50_000)]
    got = chat.parse(spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, text string, role string"), m).collect()
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.first_line)
    assert [r.role for r in one][:4] == ["system", "user", "assistant", "user"] and sum(r.n_lines for r in one) == 6
    assert one[1].rendered == "<|im_start|>user\nwhy why why?<|im_end|>\n" and all(r.begins and r.ends for r in one)
    assert sorted((r.conv_id or 0, r.n_lines) for r in got if r.conv_id != 1) == [(0, 1), (2, 1), (3, 1), (3, 1), (4, 1)]
    assert chat.parse(spark.createDataFrame([], "conv_id long, turn long, text string"), m).count() == 0


def test_turns_do_not_follow_the_rows(spark):
    """The same lines in one row, in a row each, and cut anywhere give the same transcript."""
    m = model(spark)
    lines = ["User: why why?", "AI: so it is so it is so it is so it is.", "so it is so it is so it is.", "", "Human: why?", "Assistant: so it is so.", "so it is"] * 3
    cut = [lines[:2], lines[2:3], lines[3:9], lines[9:]]
    rows = [(1, 0, "\n".join(lines))] + [(2, i, x) for i, x in enumerate(lines)] + [(3, i, "\n".join(x)) for i, x in enumerate(cut)]
    got = sorted(chat.parse(spark.createDataFrame(rows, "conv_id long, turn long, text string"), m).collect(), key=lambda r: (r.conv_id, r.turn, r.first_line))
    whole = {c: "".join(r.rendered for r in got if r.conv_id == c) for c in (1, 2, 3)}
    roles = {c: [r.role for r in got if r.conv_id == c and r.begins] for c in (1, 2, 3)}
    assert whole[1].count("<|im_start|>") == whole[1].count("<|im_end|>") >= 12
    assert roles[1] == roles[2] == roles[3]
    squeeze = lambda x: "".join(x.split())
    assert squeeze(whole[1]) == squeeze(whole[2]) == squeeze(whole[3])


def test_one_transcript_in_blocks(spark, monkeypatch):
    m = model(spark)
    rng = random.Random(9)
    texts = [rng.choice(["why why?", "so it is " * 9, "User: x\nso", "hm", "AI: y"]) for _ in range(600)]
    rows = [(7, i, t) for i, t in enumerate(texts)] + [(8, 0, "why?"), (9, 1, "AI: z")] + [(None, None, f"why {i}?") for i in range(200)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(6)
    whole = sorted(map(tuple, chat.parse(docs, m).collect()), key=str)
    monkeypatch.setattr(chat, "BLOCK_ROWS", 40)
    hot, cuts = chat._cuts(docs.select(F.coalesce("conv_id", F.lit(chat.LEAST)).alias("id"), F.coalesce("turn", F.lit(chat.LEAST)).alias("seq"), F.xxhash64("text").alias("h")))
    assert hot.count() == 2 and len(cuts) >= 18
    got = chat.parse(docs, m).collect()
    states = []
    for r in sorted((r for r in got if r.conv_id == 7), key=lambda r: (r.turn, r.first_line)):
        k = chat.ROLES.index(r.role)
        states += [k if r.begins else chat.N + k] + [chat.N + k] * (r.n_lines - 1)
    assert score(m, texts, states) == score(m, texts, m.path(m.emissions(texts), chat.START))
    rendered = "".join(r.rendered for r in sorted((r for r in got if r.conv_id == 7), key=lambda r: (r.turn, r.first_line)))
    assert rendered.count("<|im_start|>") == rendered.count("<|im_end|>") and len(got) == len(whole)


def test_very_many_long_transcripts_without_a_broadcast(spark, monkeypatch):
    """Two thousand transcripts that are cut in blocks, whose states are joined by a shuffle, are decoded as whole ones are."""
    m = model(spark)
    rows = [(i, k, t) for i in range(2000) for k, t in enumerate(["why?", "User: x", "so it is", f"AI: {i % 7}", "hm"])]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    key = lambda r: (r.conv_id, r.turn, r.first_line)
    whole = [(key(r), r.role, r.begins) for r in sorted(chat.parse(docs, m).collect(), key=key)]
    monkeypatch.setattr(chat, "BLOCK_ROWS", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parsed = chat.parse(docs, m)
        assert "BroadcastHashJoin" not in parsed._jdf.queryExecution().executedPlan().toString()
        got = [(key(r), r.role, r.begins) for r in sorted(parsed.collect(), key=key)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == whole


def recovery(spark, folder):
    """Of held-out conversations: roles of rows' first lines, and turns' first lines: precision and recall."""
    from foliant.llm import queries

    got = queries.op4_chat_format(spark, folder).where(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 == 2)
    true = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", F.col("role").alias("true"))
    first = got.where("first_line = 0").join(true, ["conv_id", "turn"])
    roles, begun, n = first.agg(F.avg((F.col("role") == F.col("true")).cast("double")), F.avg(F.col("begins").cast("double")), F.count(F.lit(1))).first()
    begins = got.where("begins").agg(F.avg((F.col("first_line") == 0).cast("double"))).first()[0]
    return roles, begun, begins, n


def test_query_recovers_turns_and_roles(spark):
    roles, begun, begins, n = recovery(spark, "/root/testdata/sf0.01")
    assert n > 80 and roles > 0.75 and begun > 0.7 and begins > 0.7  # six turns in ten have a marker
