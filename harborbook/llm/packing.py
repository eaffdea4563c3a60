"""Harmonic packing of token ids into sequences of one capacity.

Class j takes pieces of up to ``capacity`` / j ids, and each of its sequences holds exactly j of them.  Documents may be cut, so
whole sequences are cut off first, and what is left is cut to the slots of the classes, the largest that fits first; then
nothing is lost in a slot.  By default only classes whose slots fill a sequence to its end are used.

Tasks fill the sequences of each class by themselves.  Fewer than j pieces of each class are left in a task; these, and
nothing else, are moved together over fewer tasks, round by round, until they fit into one.  That lays them end to end.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborbook.llm.bpe import parts, splitter
from harborbook.llm.tables import shared_folder

CAPACITY = 1024
#: Left-over ids that a task of a later round takes on average (eight times what a task may leave, if that is more), words
#: whose ids are remembered, characters of such a word, and bytes of ids in a batch that a task hands on.
MERGED, REMEMBERED, SHORT, BATCH_BYTES = 1 << 21, 400_000, 64, 1 << 23
#: Characters of texts whose words are told apart together, and documents taken up at once.
TOGETHER, DOCS = 1 << 20, 256
#: Fixed value: the pattern of words of the byte-level pre-tokenizer.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fixed value: printable bytes stand for themselves, the others follow behind 255.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: b for b in PRINTABLE} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


class Encoder:
    """Ids (little-endian unsigned 32-bit) of whole texts by the file of a tokenizer.

    A byte-level tokenizer encodes each word by itself, so the words of many texts are told apart first, and each is encoded
    once while it is remembered.  Texts with an added token in them, and texts for other tokenizers, are encoded as they are.
    """

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        made = json.loads(content)
        first = made.get("pre_tokenizer") or {}
        plain = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
        self.by_word = bool(plain and not made.get("normalizer") and not made.get("truncation") and not made.get("post_processor"))
        self.added = [t["content"] for t in made.get("added_tokens", [])]
        self.starts, self.known, self.model = splitter(BYTE_LEVEL), {}, self.tokenizer.model

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, word: str) -> None:
        # What the pre-tokenizer makes of one word: a character for each byte.
        self.known[word] = np.array([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(BYTES))], "<u4").tobytes()

    def _texts(self, texts: list[str]) -> list[bytes]:
        whole = "".join(texts)
        starts, before = self.starts(whole, np.cumsum([0, *map(len, texts)]))
        starts, before = [*starts.tolist(), len(whole)], before.tolist()
        words = [whole[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        known = self.known
        new = [w for w in set(words) if w not in known]
        for word in new:
            self._learn(word)
        ids = [known[w] for w in words]  # before any is forgotten
        room = REMEMBERED - len(known) + len(new)
        for w in [w for w in new if len(w) > SHORT] + [w for w in new if len(w) <= SHORT][max(0, room) :]:
            del known[w]
        return [b"".join(ids[a:b]) for a, b in zip(before[:-1], before[1:], strict=True)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = [[] if self.by_word and not any(a in t for a in self.added) else [self._whole(t)] for t in texts]
        units = [(i, part) for i, t in enumerate(texts) if not out[i] for part in parts(t)]
        first, held = 0, 0
        for k, (_, part) in enumerate(units):
            held += len(part)
            if held >= TOGETHER or k == len(units) - 1:
                for (i, _), ids in zip(units[first : k + 1], self._texts([u for _, u in units[first : k + 1]]), strict=True):
                    out[i].append(ids)
                first, held = k + 1, 0
        return [b"".join(x) for x in out]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(content: str) -> Encoder:
    """One per Python worker and tokenizer."""
    if content not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[content] = Encoder(content)
    return _ENCODERS[content]


def slots(capacity: int, spare: int = 0) -> dict[int, int]:
    """Slot -> pieces of a sequence, for the classes whose sequences have at most ``spare`` ids beyond their slots; each slot
    once, the largest first."""
    sizes = sorted({capacity // j for j in range(1, capacity + 1)}, reverse=True)
    return {s: capacity // s for s in sizes if capacity % s <= spare or s == 1}


def cuts(length: int, sizes: list[int]) -> list[int]:
    """``length`` as a sum of slots, the largest first."""
    out = [sizes[0]] * (length // sizes[0])
    rest = length % sizes[0]
    for s in sizes[1:]:
        out += [s] * (rest // s)
        rest %= s
    return out


def _powers(length: int) -> list[int]:
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


class Sequences:
    """Collects pieces (document row, start, length, ids) to sequences, and rows of both to batches."""

    def __init__(self, classes: dict[int, int], first_id: int, id_type: pa.DataType):
        self.classes, self.next, self.type = classes, first_id, id_type
        self.open: dict[int, list] = {s: [] for s in classes}
        self.rows: list[tuple] = []
        self.bytes = 0

    def put(self, pieces: list[tuple], done: bool) -> None:
        """Rows of the pieces, one after the other in a sequence if ``done``."""
        offset = 0
        for doc, start, ids, total in pieces:
            length = len(ids) // 4
            self.rows.append((doc, start, length, ids, total, self.next if done else None, offset if done else None, not done))
            offset += length
            self.bytes += len(ids)
        self.next += done

    def add(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        held = self.open[size]
        held.append(piece)
        if len(held) == self.classes[size]:
            self.put(held, True)
            held.clear()

    def end_to_end(self, capacity: int) -> None:
        """All open pieces one after the other, cut where a sequence ends; the last is cut to powers of two."""
        pieces = [p for held in self.open.values() for p in held]
        total = sum(len(p[2]) // 4 for p in pieces)
        room, sequence = [capacity] * (total // capacity) + _powers(total % capacity), []
        at, free = 0, room[0] if room else 0
        for doc, start, ids, whole in pieces:
            while ids:
                part, ids = ids[: 4 * free], ids[4 * free :]
                sequence.append((doc, start, part, whole))
                start, free = start + len(part) // 4, free - len(part) // 4
                if not free:
                    self.put(sequence, True)
                    sequence, at = [], at + 1
                    free = room[at] if at < len(room) else 0
        for held in self.open.values():
            held.clear()

    def leave(self) -> None:
        for held in self.open.values():
            self.put(held, False)
            held.clear()

    def batch(self) -> pa.RecordBatch:
        types = (self.type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        columns = [pa.array([r[k] for r in self.rows], t) for k, t in enumerate(types)]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(columns, names=["doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open"])


def _first_id(turn: int) -> int:
    """Sequences of each round and task have numbers of their own."""
    return turn << 54 | TaskContext.get().partitionId() << 30


def _cut(batches: Iterator[pa.RecordBatch], content: str, end: int, classes: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """First round: documents to pieces and to the sequences that this task fills."""
    encode, sizes, last, out = _encoder(content), list(classes), np.array([end], "<u4").tobytes(), None
    for batch in batches:
        out = out or Sequences(classes, _first_id(0), batch.column("doc").type)
        for k in range(0, len(batch), DOCS):
            part = batch.slice(k, DOCS)
            encoded = encode([t or "" for t in part.column("text").to_pylist()])
            for doc, ids in zip(part.column("doc").to_pylist(), encoded, strict=True):
                ids += last
                start, total = 0, len(ids) // 4
                for size in cuts(total, sizes):
                    out.add((doc, start, ids[4 * start : 4 * (start + size)], total))
                    start += size
                    if out.bytes >= BATCH_BYTES:
                        yield out.batch()
    if out:
        out.leave()
        yield out.batch()


def _fill(batches: Iterator[pa.RecordBatch], turn: int, capacity: int, classes: dict[int, int], last: bool) -> Iterator[pa.RecordBatch]:
    """A later round: what was left to sequences; the last round leaves nothing."""
    out = None
    for batch in batches:
        out = out or Sequences(classes, _first_id(turn), batch.column("doc").type)
        for piece in zip(*(batch.column(c).to_pylist() for c in ("doc", "start", "ids", "doc_tokens")), strict=True):
            out.add(piece)
            if out.bytes >= BATCH_BYTES:
                yield out.batch()
    if out:
        out.end_to_end(capacity) if last else out.leave()
        yield out.batch()


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    end: int = 0,
    capacity: int = CAPACITY,
    spare: int = 0,
    doc_id: str | Column = "doc_id",
    text: str | Column = "text",
) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of every piece of the documents.

    A document is the ids of its whole text by the tokenizer file ``tokenizer``, without special tokens, then ``end``; null
    and empty texts have that alone.  ``ids`` are little-endian unsigned 32-bit integers, ``start`` counts the document's ids
    before the piece and ``offset`` those of its sequence.  Sequences have at most ``capacity`` ids; with ``spare`` 0 each is
    full or has a power of two of ids.  A larger ``spare`` allows sequences that lack so many ids, and cuts less.

    Each row is a document, also rows with equal or null ids; ids of any type are handed on.  An empty table has no pieces.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    classes = slots(capacity, spare)
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    base = docs.select(as_column(doc_id).alias("doc"), as_column(text).alias("text"))
    kind = base.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, open boolean"

    def round_of(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Written: what lies in sequences, and what is left."""
        path = f"{shared_folder(spark)}/pieces-{uuid.uuid4().hex}"
        df.write.partitionBy("open").parquet(path)
        made = spark.read.schema(df.schema).parquet(path)
        return made.where("NOT open"), made.where("open")

    done, left = round_of(base.mapInArrow(lambda b: _cut(b, content.value, end, classes), schema))
    out, turn = done, 0
    # A task leaves less than one sequence of each class, so every round has an eighth of the tasks at most.
    merged = max(MERGED, 8 * len(classes) * capacity)
    while ids := left.agg(F.sum("length")).first()[0]:
        turn, tasks = turn + 1, -(-ids // merged)
        moved = left.select("doc", "start", "ids", "doc_tokens").repartition(tasks)
        done, left = round_of(moved.mapInArrow(lambda b, t=turn, n=tasks: _fill(b, t, capacity, classes, n == 1), schema))
        out = out.union(done)
    return out.select(F.col("doc").alias("doc_id"), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
