"""Operator 3: hierarchical multi-length packing.

Each document is tokenised once, where it lies. A document longer than the longest window is cut into full windows and
a rest; everything else stays whole, so a piece's ids, and their CRC, are final before anything is packed and only five
numbers a piece are shuffled. Pieces are dealt evenly to shards. In a shard each piece is routed to the smallest context
tier that holds it, and the tiers are packed from the longest down: a tier's longest piece opens a window of the tier's
size, whose gap is filled with the largest pieces of its own and of shorter tiers that fit. A window of a shorter tier is
a sequence if it is full to the last id; what is left of the shorter tiers then goes to windows of the longest. Sequences
are dealt to step groups that have near equal numbers of each tier and near equal attention costs.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import sliced

#: The context sizes a document can be routed to; the last is the window that sequences are padded to.
TIERS = (256, 512, 1024, 2048)
#: Id that ends a document.
END_ID = 1
#: Documents whose pieces a shard packs.
SHARD_DOCS = 5_000
#: Ids in the sequences of a step group.
STEP_IDS = 32 * TIERS[-1]
#: Distinct chunks and words whose ids a worker keeps, in one table, and the bytes of the longest.
CACHE, LONGEST = 400_000, 63


class ChunkTokenizer(dict):
    """Chunk of bytes without ASCII white space -> its ids as little-endian 32-bit numbers.

    The tokenizer drops white space before it looks at words, so a text's ids are those of its chunks in turn. A chunk of
    Latin letters, whose lower-casing and normal form need no context, is split into words and each word goes through the
    BPE model once; any other chunk goes through the whole tokenizer. A word is a chunk of one word, so both are kept alike.
    """

    #: Fixed values of the vocabulary file: its pre-tokenizer's pattern.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN = re.compile("[\x21-\x7e\xa1-\xac\xae-įı-ɏ]+")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.pattern = self.whole.model, regex.compile(self.WORDS)
        # byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        self.alphabet = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def word(self, word: str) -> bytes:
        key = word.encode()
        found = self.get(key)
        if found is None:
            tokens = self.model.tokenize(key.decode("latin-1").translate(self.alphabet))
            found = self.keep(key, np.array([t.id for t in tokens], "<u4").tobytes())
        return found

    def keep(self, key: bytes, ids: bytes) -> bytes:
        if len(self) < CACHE and len(key) <= LONGEST:
            self[key] = ids
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            words = self.pattern.findall(text.lower())
            if words == [text]:
                return self.word(text)
            return self.keep(chunk, b"".join(map(self.word, words)))
        return self.keep(chunk, np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes())

    def ids(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or b"").split()))


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkTokenizer:
    """A worker's tokenizer, whose caches outlive its tasks."""
    return ChunkTokenizer(path)


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, window: int, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows of long documents, and rests or whole documents."""
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        tok, end = _tokenizer(tokenizer), np.array([END_ID], "<u4").tobytes()
        for batch in sliced(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tok.ids(text) + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    for c, x in zip(out, (doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n)):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], fields)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, ", ".join(f"{f} long" for f in fields))


class Pool:
    """The pieces of one tier that wait, by length; of equal ones the last put in is the first out."""

    def __init__(self):
        self.at: dict[int, list[int]] = {}
        self.sizes: list[int] = []

    def put(self, length: int, piece: int) -> None:
        if length not in self.at:
            insort(self.sizes, length)
        self.at.setdefault(length, []).append(piece)

    def take(self, most: int) -> int | None:
        """The largest piece of at most so many ids."""
        k = bisect_right(self.sizes, most) - 1
        if k < 0:
            return None
        waiting = self.at[self.sizes[k]]
        piece = waiting.pop()
        if not waiting:
            del self.at[self.sizes.pop(k)]
        return piece


def tier_of(length: int, tiers: tuple[int, ...] = TIERS) -> int:
    """The smallest tier that holds a piece of the length, which is at most the longest tier."""
    return tiers[bisect_left(tiers, length)]


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[int]]]:
    """(tier, indexes of lengths) of each sequence: full to the tier's last id, but for those of the longest tier."""
    pools = {t: Pool() for t in tiers}
    for i, length in enumerate(lengths):
        pools[tier_of(length, tiers)].put(length, i)

    def window(first: int, size: int, fillers: list[Pool]) -> tuple[list[int], int]:
        pieces, gap = [first], size - lengths[first]
        while gap:
            piece = next((p for p in (pool.take(gap) for pool in fillers) if p is not None), None)
            if piece is None:
                break
            pieces.append(piece)
            gap -= lengths[piece]
        return pieces, gap

    sequences, left = [], Pool()
    for k in range(len(tiers) - 1, -1, -1):
        fillers = [pools[t] for t in reversed(tiers[: k + 1])]
        while (first := pools[tiers[k]].take(tiers[k])) is not None:
            pieces, gap = window(first, tiers[k], fillers)
            if gap and k < len(tiers) - 1:
                for i in pieces:
                    left.put(lengths[i], i)
            else:
                sequences.append((tiers[k], pieces))
    while (first := left.take(tiers[-1])) is not None:
        sequences.append((tiers[-1], window(first, tiers[-1], [left])[0]))
    return sequences


def step_groups(sequences: list[tuple[int, float]], ids: int = STEP_IDS) -> list[int]:
    """A group for each (tier, cost): tier by tier and by falling cost each group gets one in turn, the cheapest group first."""
    n = max(1, -(-sum(t for t, _ in sequences) // ids))
    out, spent = [0] * len(sequences), [0.0] * n
    order = sorted(range(len(sequences)), key=lambda i: (-sequences[i][0], -sequences[i][1], i))
    for at in range(0, len(order), n):
        for i, group in zip(order[at : at + n], sorted(range(n), key=lambda g: (spent[g], g))):
            out[i] = group
            spent[group] += sequences[i][1]
    return out


def _packed(tiers: tuple[int, ...]):
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    names = [*fields, "sequence_id", "offset", "tier", "step_group"]

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        table = table.sort_by([(f, "ascending") for f in ("length", "doc_id", "start", "ids_crc32")])  # a task that runs again packs alike
        shard, lengths = TaskContext.get().partitionId() << 32, table["length"].to_pylist()
        sequences = pack_lengths(lengths, tiers)
        groups = step_groups([(t, float(sum(lengths[i] ** 2 for i in s))) for t, s in sequences])
        order, extra = [], [[], [], [], []]
        for k, ((tier, s), group) in enumerate(zip(sequences, groups)):
            offset = 0
            for i in s:
                order.append(i)
                for c, x in zip(extra, (shard + k, offset, tier, shard + group)):
                    c.append(x)
                offset += lengths[i]
        kept = table.select(fields).take(pa.array(order))
        yield from pa.table([*kept.columns, *(pa.array(c, pa.int64()) for c in extra)], names).to_batches(max_chunksize=10_000)

    return run


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group) of every piece.

    A null or empty text is the one id that ends every document; a very long one becomes as many windows as it fills and
    a rest. Repeated rows, and rows without an id, are packed like any other; of pieces of one length the last in order
    of id and place is taken first. An empty table has no pieces. Other columns of docs are left out, whatever their
    names. tier is the context size whose window the piece was packed in: a sequence of a shorter tier fills it to the
    last id, one of the longest is padded to it. step_group numbers the groups within a shard.
    """
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    spread = pieces(docs, tiers[-1], tokenizer or _default_tokenizer(), id_col, text_col).repartition(shards)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
    return spread.mapInArrow(_packed(tiers), schema)
