"""Operator 7: hierarchical language identification.

Linear support vector machines, trained one against one on hashed byte n-grams, first tell language families apart and
then the languages within the family. All machines are fitted in one job: classes are dealt to blocks, and a group has the
sample of two blocks and fits every pair between them. The model is a few rows of weights; prediction reads each whole
text once, where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import sliced, unused, written

#: The family of a language code. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
    "sinitic": ("zh", "zh-hans", "zh-hant", "yue"),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

#: Distinct texts of each language that the model is fitted on, at most, and languages, the most frequent ones; what is
#: predicted covers all rows.
TRAIN_PER_LANG, MAX_LANGS = 500, 200
#: Texts that the machines of families are fitted on, of each family, in equal parts of its languages.
TRAIN_PER_FAMILY = 1000
#: Classes of a block; a fitting group holds the sample of two blocks.
BLOCK = 8
#: How fast a class's chance grows with the margin, at which the rows of a fit lie about 1 from the border.
STEEP = 4.0
#: Least score of a text whose language is taken as known.
LEAST_SCORE = 0.4
#: Hashed features: 256 single bytes, then byte pairs and byte triples.
PAIRS, TRIPLES = 1024, 2816
DIM = 256 + PAIRS + TRIPLES
UND = "und"
PREDICTED = "lang_pred string, score double"


def _byte_table() -> np.ndarray:
    """Lower-cases A-Z; ASCII other than letters becomes a blank."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    other = [b for b in range(128) if not chr(t[b]).isalpha()]
    t[other] = 32
    return t


TABLE = _byte_table()
CHUNK = 1 << 20


def features(text: bytes) -> np.ndarray:
    """The whole text's feature vector, of length 1: logarithms of the hashed counts."""
    counts = np.zeros(DIM)
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    for at in range(0, max(len(data) - 2, 1), CHUNK):
        x = TABLE[data[at : at + CHUNK + 2]].astype(np.uint32)
        a, b, c = x[:-2], x[1:-1], x[2:]
        counts[:256] += np.bincount(b, minlength=256)
        counts[256 : 256 + PAIRS] += np.bincount(((a * 257 + b) * np.uint32(2654435761) >> 12) % PAIRS, minlength=PAIRS)
        counts[256 + PAIRS :] += np.bincount((((a * 257 + b) * 257 + c) * np.uint32(2654435761) >> 10) % TRIPLES, minlength=TRIPLES)
    counts[32] = 0  # blanks
    out = np.log1p(counts)
    return out / max(np.sqrt(out @ out), 1e-9)


def _vectors(texts: DataFrame) -> DataFrame:
    """(lang, h, x) of (lang, h, text as binary); x has the features as 32-bit floats."""

    def run(batches):
        for batch in sliced(batches):
            xs = [features(text).astype(np.float32).tobytes() for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(xs, pa.binary())], ["lang", "h", "x"])

    return texts.mapInArrow(run, "lang string, h long, x binary")


def vectors_of(column: pa.ChunkedArray) -> np.ndarray:
    """The rows' features as one matrix, which lies in Arrow's memory if the column is one chunk, and is copied once if not."""
    parts = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        first = np.frombuffer(offsets, np.int32)[chunk.offset]
        parts.append(np.frombuffer(data, np.float32, len(chunk) * DIM, int(first)).reshape(len(chunk), DIM))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def sample(rows: DataFrame, per_lang: int, text_col: str, lang_col: str) -> DataFrame:
    """(lang, h, text as binary): of each of the most frequent languages per_lang distinct texts, chosen by their hash h.

    Each language is bounded on its own, and a text counts once however often it is repeated.
    """
    named = rows.where(F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text")).withColumn("h", F.xxhash64("text"))
    known = named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS)
    texts = written(named.select("lang", "h").join(F.broadcast(known.select("lang")), "lang").distinct(), "language-texts")
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"))  # MAX_LANGS rows at most
    share = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = texts.join(F.broadcast(sizes), "lang").where(share < 4.0 * per_lang / F.col("texts"))  # four times as many, however many tasks there are
    least = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= per_lang)
    chosen = written(least.select("lang", "h"), "training-texts")  # per_lang * MAX_LANGS rows at most
    return named.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "h", "text")


class Model:
    """One-versus-one machines for families and, for each family, for its languages; (classes, {(i, j): weights})."""

    def __init__(self, families: tuple, members: dict[str, tuple]):
        self.families, self.members = families, members

    @staticmethod
    def _choose(machines: tuple, x: np.ndarray) -> tuple[str, float]:
        classes, pairs = machines
        if len(classes) == 1:
            return classes[0], 1.0
        votes, sure = np.zeros(len(classes)), np.ones(len(classes))
        for (i, j), w in pairs.items():
            p = 1 / (1 + np.exp(-np.clip(STEEP * (x @ w[:-1] + w[-1]), -50, 50)))  # of class i
            votes[i if p >= 0.5 else j] += 1
            sure[i] *= p
            sure[j] *= 1 - p
        best = max(range(len(classes)), key=lambda k: (votes[k], sure[k], -k))
        return classes[best], float(sure[best])

    def predict(self, text: bytes) -> tuple[str, float]:
        x = features(text)
        family, sure = self._choose(self.families, x)
        lang, p = self._choose(self.members[family], x)
        return lang, sure * p


#: The solver's passes over its rows, at most, the weight of a row's loss, and the change that ends it.
PASSES, COST, ENOUGH = 10, 1.0, 0.01


def machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept of a linear SVM with squared hinge loss for rows x of y 1 or -1.

    Dual coordinate descent (Hsieh, Chang, Lin, Keerthi, Sundararajan, 2008); rows are taken in a fixed random order.
    """
    w, bias, alpha = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(len(x))
    loose = 0.5 / COST
    norms = np.einsum("ij,ij->i", x, x) + 1.0 + loose
    order = np.random.default_rng(len(x)).permutation(len(x))
    for _ in range(PASSES):
        most = 0.0
        for i in order.tolist():
            slope = y[i] * (float(w @ x[i]) + bias) - 1.0 + loose * alpha[i]
            if alpha[i] == 0.0 and slope >= 0.0:
                continue
            most = max(most, abs(slope))
            new = max(alpha[i] - slope / norms[i], 0.0)
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w += np.float32(step) * x[i]
            bias += step
        if most < ENOUGH:
            break
    return np.append(w, bias)


def _fitted(rows: DataFrame, classes: DataFrame) -> list:
    """(level, i, j, weights) of all pairs of classes of a level; classes has (lang, level, class), rows (lang, n, x).

    n is a text's place among its language's, by its hash; a level's class has a limit on it, `most`. A row is sent to the
    groups of its class's block with every block of the level.
    """
    blocks = classes.groupBy("level").agg(F.floor(F.max("class") / BLOCK).cast("int").alias("last"))
    own = rows.join(F.broadcast(classes.join(blocks, "level")), "lang").where("n < most")  # two rows a language, MAX_LANGS languages
    block = F.floor(F.col("class") / BLOCK).cast("int")
    dealt = own.select("level", "class", "x", block.alias("own"), F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    dealt = dealt.select("level", "class", "x", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def pairs(group: pa.Table) -> pa.Table:
        x, of = vectors_of(group["x"]), group["class"].to_numpy()
        level, a, b = (group[c][0].as_py() for c in ("level", "a", "b"))
        held, out = sorted(set(of.tolist())), []
        for i in held:
            for j in held:
                if i < j and (i // BLOCK, j // BLOCK) == (a, b):
                    two = np.flatnonzero((of == i) | (of == j))
                    own = x if len(two) == len(x) else x[two]
                    out.append({"level": level, "i": i, "j": j, "w": machine(own, np.where(of[two] == i, 1.0, -1.0)).astype(np.float64).tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("level", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("w", pa.binary())]))

    fits = dealt.groupBy("level", "a", "b").applyInArrow(pairs, "level int, i int, j int, w binary")
    return fits.collect()  # the model


def fit(rows: DataFrame, per_lang: int = TRAIN_PER_LANG, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model for the languages of rows; None if there are none. Rows without a language or a letter teach nothing."""
    rows = rows.where(F.col(lang_col).isNotNull())
    n = F.row_number().over(Window.partitionBy("lang").orderBy("h")) - 1
    vectors = written(_vectors(written(sample(rows, per_lang, text_col, lang_col), "training-sample")).withColumn("n", n), "training-vectors")
    langs = sorted(r[0] for r in vectors.select("lang").distinct().collect())  # MAX_LANGS at most
    if not langs:
        return None
    family = {x: FAMILY_OF.get(x.lower(), x) for x in langs}
    members = {f: [x for x in langs if family[x] == f] for f in sorted(set(family.values()))}
    levels = [list(members), *members.values()]
    part = {x: -(-TRAIN_PER_FAMILY // len(members[family[x]])) for x in langs}
    classes = [(x, 0, levels[0].index(family[x]), part[x]) for x in langs] if len(members) > 1 else []
    classes += [(x, k, i, per_lang) for k, held in enumerate(levels) if k and len(held) > 1 for i, x in enumerate(held)]
    machines: list[dict] = [{} for _ in levels]
    if classes:
        for r in _fitted(vectors, rows.sparkSession.createDataFrame(classes, "lang string, level int, class int, most int")):
            machines[r.level][r.i, r.j] = np.frombuffer(r.w, np.float64)
    found = list(zip(levels, machines))
    return Model(found[0], dict(zip(members, found[1:])))


def _predicted(text: Column, model: Model | None) -> Column:
    """(lang_pred, score) of the text. Only the text goes to Python and only these come back; the rows stay where they are."""

    @F.arrow_udf(PREDICTED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [(UND, 0.0) if model is None or not x.is_valid else model.predict(x.as_py()) for x in batch]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["lang_pred", "score"])

    return run(F.when(text.rlike(r"\p{L}"), text).cast("binary"))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, in place of columns of such names; und and 0.0 where there is no letter or no model."""
    rows = docs.drop("lang_pred", "score")
    (found,) = unused(rows, "found")
    return rows.withColumn(found, _predicted(F.col(text_col), model)).select(*rows.columns, f"{found}.lang_pred", f"{found}.score")


def keep_known(docs: DataFrame, model: Model | None, languages: tuple[str, ...] | None = None, least_score: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is in a language that the model knows, with all their columns.

    A row goes if its text is null or has no letter, if the score of the predicted language is under least_score, or if
    that language is not one of languages (None: any that was learned). Without a model only the letter counts.
    """
    if model is None:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    (found,) = unused(docs, "found")
    lang, score = F.col(f"{found}.lang_pred"), F.col(f"{found}.score")
    known = (lang != UND) & (score >= least_score)
    rows = docs.withColumn(found, _predicted(F.col(text_col), model))
    return rows.where(known if languages is None else known & lang.isin(*languages)).select(*docs.columns)


def held_out(id_col: str = "doc_id"):
    """Rows that no model is fitted on: CRC-32 of the id as text is 2 modulo 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, by a model fitted on the rows that are not held out.

    A null text, or one without a letter, is und with score 0; a very long one is read whole. An empty table gives no
    rows. Repeated rows and rows without an id are kept, and predicted alike; rows without a language are predicted but
    not learned from. Of classes with equal votes the one of the larger product of chances wins, then the first by name.
    Other columns of docs are left out, whatever their names.
    """
    model = fit(docs.where(~held_out(id_col)), per_lang, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), _predicted(F.col(text_col), model).alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")
