"""Operator 4: chat formatting of raw transcripts by a hidden Markov model.

The states are the roles' first and further lines; each line shows a speaker marker, or none, and its shape. Where the
rows of a transcript end tells nothing: turns begin where Viterbi's path says so, and are rendered alike. Counts over all
labelled rows make the model. Transcripts are dealt out by their id, those of very many rows in blocks. A transcript in
blocks is decoded exactly: the best scores from any state to any other over each of its blocks give the states at the
blocks' ends, and then each block decodes its own lines. Scores are whole numbers, so that the way they are added up
changes nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import sliced, written

ROLES = ("system", "user", "assistant")
#: A state for a role's first line, then one for its further lines; the last state is that before a transcript.
N = len(ROLES)
START, STATES = 2 * N, 2 * N + 1
NEVER = -(10**15)
#: Names that speaker markers have, by role.
NAMES = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "question", "customer", "prompter", "me", "q"),
    "assistant": ("assistant", "ai", "bot", "answer", "agent", "model", "a"),
}
ROLE_OF = {name: i for i, names in enumerate(NAMES.values()) for name in names}
MARKER = re.compile(r"[ \t]*(?:(\[|<\|?|\*\*|#{1,4} ?)?(" + "|".join(sorted(ROLE_OF, key=len, reverse=True)) + r")(\]|\|?>|\*\*)?(:|>|-|$|(?<=[\]>*])))[ \t]?", re.I)
#: Values of each feature: marker (none or a role's), length class, last sign.
FEATURES = (1 + N, 8, 4)
#: Turns with their role's marker that are added to the labelled ones, as a share of these.
PRIOR = 0.1
LEAST = -(2**63)
#: Rows of a transcript that are decoded as one; one of more rows is cut into blocks of about so many, or of more where
#: there would be over MAX_BLOCKS of them in all.
BLOCK_ROWS, MAX_BLOCKS = 1000, 20_000


def marker(line: str) -> tuple[int, int]:
    """1 + the role that the line's speaker marker names, and where its text begins; 0, 0 without a marker."""
    m = MARKER.match(line)
    if not m or not (m[4] or m[3] or (m[1] and m[1][0] == "#")):
        return 0, 0
    if m[4] == "" and not m[1]:
        return 0, 0  # a bare word is no marker
    return 1 + ROLE_OF[m[2].lower()], m.end()


def line_features(text: str | None) -> list[tuple[int, ...]]:
    out = []
    for line in (text or "").split("\n"):
        size = len(line.strip())
        out.append((marker(line)[0], min(7, size.bit_length()), "?.:".find(line.rstrip()[-1]) + 1 if size else 0))
    return out


class Model:
    """Whole-number log probabilities: moves[s, t], and shows[f][t, v] of feature f's value v in state t."""

    def __init__(self, moves: np.ndarray, shows: list[np.ndarray]):
        self.moves, self.shows = moves, shows

    def emissions(self, texts: list[str | None]) -> np.ndarray:
        """(lines x states) scores of the texts' lines."""
        x = np.array([f for t in texts for f in line_features(t)], np.int64).reshape(-1, len(FEATURES))
        return sum(self.shows[f][:, x[:, f]] for f in range(len(FEATURES))).T

    def transfer(self, scores: np.ndarray) -> np.ndarray:
        """The best score from each state before the lines to each state of the last line."""
        out = np.full((STATES, STATES), NEVER, np.int64)
        np.fill_diagonal(out, 0)
        for e in scores:
            out = np.maximum((out[:, :, None] + self.moves).max(axis=1) + e, NEVER)
        return out

    def path(self, scores: np.ndarray, entry: int, end: int | None = None) -> list[int]:
        """The best states of the lines, from the state before them to that of the last one if it is given."""
        return best_path((self.moves + e for e in scores), entry, end)


def best_path(steps, entry: int, end: int | None) -> list[int]:
    """Viterbi over matrices of scores from state to state."""
    best, back = np.full(STATES, NEVER, np.int64), []
    best[entry] = 0
    for step in steps:
        x = best[:, None] + step
        back.append(x.argmax(axis=0))
        best = np.maximum(x.max(axis=0), NEVER)
    state = int(best.argmax()) if end is None else end
    out = []
    for b in reversed(back):
        out.append(state)
        state = int(b[state])
    return out[::-1]


def fit(rows: DataFrame, id_col: str = "conv_id", seq_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Model:
    """The model of labelled turns, a row a turn; rows of other roles are left out. Counts start at one, markers are given PRIOR."""

    def counted(batches):
        counts: dict[tuple[int, int, int], int] = {}
        for batch in sliced(batches):
            for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = ROLES.index(role)
                for i, line in enumerate(line_features(text)):
                    state = r if i == 0 else N + r
                    for f, v in enumerate(line):
                        counts[state, f, v] = counts.get((state, f, v), 0) + 1
        cols = list(zip(*((*k, n) for k, n in counts.items()))) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), pa.array(cols[3], pa.int64())], ["state", "f", "v", "n"])

    known = rows.where(F.col(role_col).isin(*ROLES))
    found = known.select(role_col, text_col).mapInArrow(counted, "state int, f int, v int, n long").groupBy("state", "f", "v").agg(F.sum("n").alias("n")).collect()  # a few hundred at most
    shown = [np.ones((STATES, size)) for size in FEATURES]
    for state, f, v, n in found:
        shown[f][state, v] += n
    lines = shown[0].sum(axis=1) - FEATURES[0]
    for r in range(N):  # markers are believed also where the labelled turns have none
        shown[0][r, 1 + r] += PRIOR * shown[0][r].sum()
    more = F.coalesce(F.instr(text_col, "\n") > 0, F.lit(False))
    turns = written(known.groupBy(F.col(id_col).alias("id"), F.col(seq_col).alias("seq")).agg(F.min(role_col).alias("role"), F.max(more).alias("more")), "labelled-turns")
    after = turns.select("id", (F.col("seq") - 1).alias("seq"), F.col("role").alias("next"))
    before = turns.select("id", (F.col("seq") + 1).alias("seq"))
    follow = turns.join(after, ["id", "seq"]).groupBy("role", "more", "next").count().collect()
    start = turns.join(before, ["id", "seq"], "left_anti").groupBy("role").count().collect()
    long = {r.role: r["count"] for r in turns.where("more").groupBy("role").count().collect()}
    moved = np.zeros((STATES, STATES))
    moved[:, :N] = moved[range(N), range(N, 2 * N)] = moved[range(N, 2 * N), range(N, 2 * N)] = 1
    for a, more, b, n in follow:
        moved[ROLES.index(a) + N * more, ROLES.index(b)] += n
    for r, n in start:
        moved[START, ROLES.index(r)] += n
    for r, role in enumerate(ROLES):  # lines that go on
        moved[r, N + r] += long.get(role, 0)
        moved[N + r, N + r] += max(0, lines[N + r] - long.get(role, 0))
    with np.errstate(divide="ignore"):
        moves = np.where(moved > 0, np.round(1000 * np.log(moved / moved.sum(axis=1, keepdims=True))), NEVER).astype(np.int64)
    shows = [np.round(1000 * np.log(s / s.sum(axis=1, keepdims=True))).astype(np.int64) for s in shown]
    return Model(moves, shows)


def segments(texts: list[str | None], states: list[int], closed: bool) -> list[list[tuple[int, int, str, bool, bool, str]]]:
    """For each text the (first line, lines, role, begins, ends, rendered) of the turns, or parts of turns, in it.

    rendered is the turn's canonical form, of which a part has its share: joined in order they are the transcript's.
    closed tells whether the last line ends its turn.
    """
    out, at = [], 0
    for text in texts:
        lines = (text or "").split("\n")
        starts = sorted({0, *(i for i in range(len(lines)) if states[at + i] < N)})
        found = []
        for a, b in pairwise([*starts, len(lines)]):
            state = states[at + a]
            ends = states[at + b] < N if at + b < len(states) else closed
            body = "\n".join([lines[a][marker(lines[a])[1] if state < N else 0 :], *lines[a + 1 : b]])
            if state < N:
                body = f"<|im_start|>{ROLES[state]}\n" + body.lstrip()
            body = body.rstrip() + "<|im_end|>\n" if ends else body + "\n"
            found.append((a, b - a, ROLES[state % N], state < N, ends, body))
        out.append(found)
        at += len(lines)
    return out


def _groups(batches, keys: int):
    """(key, rows) of each run of rows that agree in their first columns."""
    held, key = [], None
    for batch in sliced(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if held:
                    yield key, held
                held, key = [], row[:keys]
            held.append(row)
    if held:
        yield key, held


def _cuts(rows: DataFrame) -> tuple[DataFrame | None, list[tuple[int, int, int]]]:
    """The ids of over BLOCK_ROWS rows, and where their blocks begin: MAX_BLOCKS places (id, seq, h) in order at most."""
    hot = written(rows.groupBy("id").count().where(F.col("count") > BLOCK_ROWS), "long-transcripts")
    n = hot.agg(F.sum("count")).first()[0]
    if not n:
        return None, []
    blocks = min(MAX_BLOCKS, -(-n // BLOCK_ROWS))
    places = rows.join(hot.select("id"), "id", "left_semi").select("id", "seq", "h").repartitionByRange(blocks, "id", "seq", "h")
    found = places.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("id", "seq", "h")).alias("x")).collect()
    return hot.select("id"), sorted((r.x.id, r.x.seq, r.x.h) for r in found)


def parse(pieces: DataFrame, model: Model, id_col: str = "conv_id", seq_col: str = "turn", text_col: str = "text") -> DataFrame:
    """(id, seq, first_line, n_lines, role, begins, ends, rendered) of every turn, or part of one, in every row of pieces.

    A transcript is the lines of the rows of one id in order of seq, rows of one seq by a hash of their text; a turn may
    begin at any line and run over many rows, in each of which it has a part. The names are those of pieces. A null id,
    or seq, is one like any other and comes first; a null or empty text is one empty line; repeated rows are lines of
    their own; of equally good paths the one of the states first in order is taken. An empty table has no turns, and
    other columns of pieces are left out, whatever their names.
    """
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(LEAST))
    rows = pieces.select(key(id_col).alias("id"), key(seq_col).alias("seq"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    hot, cuts = _cuts(rows)
    cut_ids = np.array([c[0] for c in cuts], np.int64)

    @F.pandas_udf("int")
    def block_of(ids, seqs, hs):
        low, high = (np.searchsorted(cut_ids, ids.to_numpy(), side=side) for side in ("left", "right"))
        out = high.astype("int32")
        for i in np.flatnonzero(low < high).tolist():
            out[i] = bisect_right(cuts, (ids[i], seqs[i], hs[i]), int(low[i]), int(high[i]))
        return type(ids)(out)

    rows = rows.withColumn("block", block_of("id", "seq", "h") if cuts else F.lit(0))
    order = ["id", "block", "seq", "h"]

    def summed(batches):
        for (i, block), held in _groups(batches, 2):
            scores = model.emissions([r[4] for r in held])
            cols = [[i], [block], [model.transfer(scores[:1]).ravel().tolist()], [model.transfer(scores[1:]).ravel().tolist()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["id", "block", "first", "others"])

    def met(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        steps = (np.array(m).reshape(STATES, STATES) for pair in zip(table["first"].to_pylist(), table["others"].to_pylist()) for m in pair)
        states = best_path(steps, START, None)  # of each block's first and last line
        firsts, lasts = states[::2], states[1::2]
        cols = [pa.array([START, *lasts[:-1]], pa.int32()), pa.array(lasts, pa.int32()), pa.array([s < N for s in firsts[1:]] + [True])]
        return pa.table([table["id"], table["block"], *cols], ["id", "block", "entry", "last", "closed"])

    if hot is None:
        found = rows.withColumns({"entry": F.lit(START), "last": F.lit(None).cast("int"), "closed": F.lit(True)})
    else:
        own = rows.join(hot, "id", "left_semi").select(*order, "text").repartition("id", "block").sortWithinPartitions(*order)
        sums = own.mapInArrow(summed, "id long, block int, first array<long>, others array<long>")
        states = written(sums.groupBy("id").applyInArrow(met, "id long, block int, entry int, last int, closed boolean"), "block-states")
        found = rows.join(states, ["id", "block"], "left")  # a row for each block: as many as long transcripts need, so Spark decides
        found = found.withColumns({"entry": F.coalesce("entry", F.lit(START)), "closed": F.coalesce("closed", F.lit(True))})

    kinds = {"id": pa.int64(), "seq": pa.int64(), "first_line": pa.int64(), "n_lines": pa.int64(), "role": pa.string(), "begins": pa.bool_(), "ends": pa.bool_(), "rendered": pa.string()}

    def decode(batches):
        out, size = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds.values())], list(kinds))
        for (i, _), held in _groups(batches, 2):
            texts, (entry, last, closed) = [r[4] for r in held], held[0][5:8]
            states = model.path(model.emissions(texts), entry, last)
            for r, found in zip(held, segments(texts, states, closed)):
                out += [(i, r[2], *x) for x in found]
                size += len(r[4] or "")
            if size > 1 << 22:
                yield flush()
                out, size = [], 0
        yield flush()

    dealt = found.select(*order, "text", "entry", "last", "closed").repartition("id", "block").sortWithinPartitions(*order)
    out = dealt.mapInArrow(decode, "id long, seq long, first_line long, n_lines long, role string, begins boolean, ends boolean, rendered string")
    null = lambda c: F.nullif(c, F.lit(LEAST))
    return out.select(null("id").alias(id_col), null("seq").alias(seq_col), *out.columns[2:])
