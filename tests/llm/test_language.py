import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliant.llm import language

WORDS = {"en": "the and that with from have this which their would", "de": "der die und nicht mit eine sich auch werden über", "fr": "les des une dans pour que être qui avec était", "es": "los las una para que con está por según también"}


def rows(n):
    return [(i, " ".join(WORDS[x].split()[(i * 3 + k * k) % 10] for k in range(12)), x) for i, x in ((i, list(WORDS)[i % 4]) for i in range(n))]


def test_held_out_rows_are_told_apart(spark):
    docs = spark.createDataFrame(rows(240), "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [i for i in got if got[i].held_out]
    assert len(held) > 30 and all(got[i].lang_pred == list(WORDS)[i % 4] for i in held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edge_rows(spark):
    edge = [(1000, None, "en"), (1001, "", "de"), (1002, "12 +-", "fr"), (None, "les des une dans", None), (1003, "the and " * 200_000, None), (3, rows(4)[3][1], "es"), (3, rows(4)[3][1], "es")]
    docs = spark.createDataFrame(rows(120) + edge, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = [r for r in language.identify(docs).collect() if r.doc_id is None or r.doc_id >= 1000 or r.doc_id == 3]
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0)
    assert by[None][0] == "fr" and by[1003][0] == "en" and sum(r.doc_id == 3 for r in got) == 3
    assert language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_rejection_keeps_columns(spark):
    docs = spark.createDataFrame(rows(8), "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("old"))
    out = language.predict(docs, None)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and {r.lang_pred for r in out.collect()} == {"und"}


def plain_vote(model, text):
    """One-versus-one votes over the features, written out."""
    x = language.features(text)

    def choose(classes, pairs):
        if len(classes) == 1:
            return classes[0], 1.0
        chance = lambda i, j: 1 / (1 + math.exp(-max(-50, min(50, language.STEEP * float(x @ pairs[i, j][:-1] + pairs[i, j][-1])))))
        wins, sure = Counter(), {k: 1.0 for k in range(len(classes))}
        for i in range(len(classes)):
            for j in range(i + 1, len(classes)):
                p = chance(i, j)
                wins[i if p >= 0.5 else j] += 1
                sure[i] *= p
                sure[j] *= 1 - p
        best = sorted(sure, key=lambda k: (-wins[k], -sure[k], k))[0]
        return classes[best], sure[best]

    family, p = choose(*model.families)
    lang, q = choose(*model.members[family])
    return lang, p * q


def test_predictions_are_the_plain_votes(spark):
    """Eight languages of three families, each told by plain votes, family first."""
    more = WORDS | {"nl": "het een van niet zijn voor met maar ook naar", "it": "il che non per una sono con anche come più", "pl": "nie się jest na to że do jak ale czy", "cs": "není jsem že ale jak tak bylo jako když nebo"}
    docs = spark.createDataFrame([(i, " ".join(more[x].split()[(i * 3 + k * k) % 10] for k in range(12)), x) for i, x in ((i, list(more)[i % 8]) for i in range(320))], "doc_id long, text string, lang string")
    model = language.fit(docs.where(~language.held_out("doc_id")))
    assert sorted(model.families[0]) == ["germanic", "romance", "slavic"] and sorted(model.members["slavic"][0]) == ["cs", "pl"]
    got = language.predict(docs, model).where(language.held_out("doc_id")).collect()
    for r in got:
        lang, score = plain_vote(model, r.text.encode())
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9
    assert len(got) > 50 and sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)


def test_accuracy_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred <> 'und'")
    right, n = both.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.count(F.lit(1))).first()
    assert n > 200 and right > 0.97


def test_each_language_is_sampled_on_its_own(spark):
    """Thousands of equal rows without an id take no place from another language."""
    de = [(i, x, "de") for i, (_, x, lang) in enumerate(rows(2400)) if lang == "de"]
    docs = spark.createDataFrame([(None, "the and that with from have this", "en")] * 6000 + de, "doc_id long, text string, lang string")
    chosen = language.sample(docs, 30, "text", "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("texts")).collect()
    assert {r.lang for r in chosen} == {"en", "de"} and all(r.n == r.texts <= 30 for r in chosen)
    assert {r.lang_pred for r in language.identify(docs).collect()} == {"en", "de"}


def test_keep_known(spark):
    docs = spark.createDataFrame([*rows(160), (900, None, "en"), (901, "12 34", "de"), (902, "", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("own")).withColumn("lang_pred", F.lit("own"))
    model = language.fit(docs)
    kept = language.keep_known(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(160)) and {r.score for r in kept.collect()} == {"own"}
    only = language.keep_known(docs, model, ("fr", "es")).collect()
    assert {r.doc_id % 4 for r in only} == {2, 3}
    assert language.keep_known(docs, model, least_score=1.1).count() == 0 and language.keep_known(docs, None).count() == 160


def test_two_hundred_languages_in_one_job(spark):
    """Languages outside the families, told by their own words: 19,900 machines in groups of a single job."""
    word = lambda i, k: hashlib.md5(f"{i}-{k}".encode()).hexdigest()[:7].translate(str.maketrans("0123456789", "ghijklmnop"))
    docs = spark.createDataFrame([(n, " ".join(word(i, (k + n) % 5) for k in range(8)), f"x{i:03d}") for i in range(200) for n in range(4 * i, 4 * i + 4)], "doc_id long, text string, lang string")
    context = spark.sparkContext
    context.setJobGroup("fit", "fit")
    model = language.fit(docs)
    jobs = len(context.statusTracker().getJobIdsForGroup("fit"))
    assert len(model.families[0]) == 200 and len(model.families[1]) == 200 * 199 // 2
    assert jobs < 60
    right = sum(model.predict(r.text.encode())[0] == r.lang for r in docs.limit(100).collect())
    assert right >= 95
    context.setLocalProperty("spark.jobGroup.id", None)


def test_machine_separates(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(200, language.DIM)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] > 0, 1.0, -1.0)
    w = language.machine(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).all()
    assert language.machine(x[:1], np.array([1.0]))[-1] > 0


def test_only_texts_go_to_python(spark, tmp_path):
    """A text is sent once, other columns stay, and what comes back is a language and a score, not the rows."""
    docs = spark.createDataFrame(rows(160), "doc_id long, text string, lang string").withColumns({"text": F.repeat(F.concat("text", F.lit(" ")), F.lit(20)), "other": F.repeat(F.lit("x"), F.lit(5000))})
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    frame, moved = language.keep_known(docs, language.fit(docs)), {}
    assert {(r.doc_id, len(r.other)) for r in frame.collect()} == {(i, 5000) for i in range(160)}
    nodes = [frame._jdf.queryExecution().executedPlan()]
    for node in nodes:
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        for name in ("pythonDataSent", "pythonDataReceived"):
            if node.metrics().contains(name):
                moved[name] = moved.get(name, 0) + node.metrics().apply(name).value()
    assert size < moved["pythonDataSent"] < 1.5 * size and moved["pythonDataReceived"] < 0.2 * size


def test_vectors_of_chunks_and_slices():
    x = np.random.default_rng(2).normal(size=(7, language.DIM)).astype(np.float32)
    column = pa.array([row.tobytes() for row in x], pa.binary())
    for chunks in ([column], [column.slice(2, 3)], [column.slice(0, 2), column.slice(5)]):
        rows = [i for c in chunks for i in range(7) if x[i].tobytes() in c.to_pylist()]
        assert np.array_equal(language.vectors_of(pa.chunked_array(chunks)), x[rows])
