"""Byte-level BPE encoding and decoding with recursive queries over token positions.

Inside a task the distinct words of a batch become rows (word, position, token) of an in-process DuckDB table.  A
recursive query joins neighbours with the merge table and contracts, word by word, the leftmost pair of least rank until
no pair is left.  In long words it also contracts the pairs of that rank further right that do not overlap: no merge makes
a pair of lower rank (``Merges`` checks this of a vocabulary), so they would be next anyway.  Decoding joins token rows
with the vocabulary and aggregates the bytes of each text in the order of their positions.

The vocabulary is the only thing that is broadcast; its size is fixed.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from harborbook.llm.texts import powers, text_buffer

#: Token rows that one recursive query starts from, its steps for long words before its last state is taken up by a new
#: one, characters or tokens that are worked on together, words whose ids are remembered, and bytes of a short word.
ROWS, STEPS, TOGETHER, REMEMBERED, SHORT = 100_000, 24, 1 << 19, 250_000, 64
#: Characters after which a long text is cut at the next space between words.
PART = 1 << 19


@dataclass
class Merges:
    """A vocabulary as token bytes by id and as pairs (left, right, token they make).

    Two neighbours that make a token have come about inside its bytes exactly as if these were encoded alone, since no
    token ever reached across their ends.  So one pair of each token can occur: the last two tokens on the way to it.
    """

    tokens: list[bytes]
    at_once: bool = field(init=False)
    pairs: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        rank = {t: i for i, t in enumerate(self.tokens) if t}
        made = [(*pair, i) for t, i in rank.items() if (pair := self._last_pair(t, rank))]
        self.pairs = np.array(made, np.int32).reshape(-1, 3)
        self.at_once = bool((self.pairs[:, 2] > self.pairs[:, :2].max(axis=1)).all()) if made else True

    @staticmethod
    def _last_pair(token: bytes, rank: dict[bytes, int]) -> tuple[int, int] | None:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            low, at = min((rank.get(parts[i] + parts[i + 1], len(rank)), i) for i in range(len(parts) - 1))
            if low == len(rank):
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else None


def read_ranks(path: str) -> list[bytes]:
    """Tokens by id from lines of base64 and rank."""
    with open(path, "rb") as lines:
        ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in lines if line.strip())}
    return [ranks.get(i, b"") for i in range(max(ranks, default=-1) + 1)]


#: One step contracts the leftmost pair of least rank of every word.  A row knows the token right of it and where that
#: stands, so that a step needs no order.
CONTRACT = """
WITH RECURSIVE state(word, pos, tok, next, next_pos, step) AS (
    SELECT word, pos, tok, lead(tok) OVER w, lead(pos) OVER w, 0
    FROM start WINDOW w AS (PARTITION BY word ORDER BY pos)
    UNION ALL
    (
        WITH ranked AS MATERIALIZED (
            SELECT s.*, m.rank FROM state s LEFT JOIN merges m ON m.a = s.tok AND m.b = s.next
        ),
        lowest AS (
            SELECT word, min(rank) AS rank, arg_min(pos, rank::BIGINT << 32 | pos) AS pos,
                   arg_min(next_pos, rank::BIGINT << 32 | pos) AS next_pos
            FROM ranked WHERE rank IS NOT NULL GROUP BY word
        ),
        hit AS MATERIALIZED (
            SELECT l.*, r.next AS after, r.next_pos AS after_pos
            FROM lowest l JOIN ranked r ON r.word = l.word AND r.pos = l.next_pos
        )
        SELECT r.word, r.pos,
               CASE WHEN r.pos = h.pos THEN h.rank ELSE r.tok END,
               CASE WHEN r.pos = h.pos THEN h.after WHEN r.next_pos = h.pos THEN h.rank ELSE r.next END,
               CASE WHEN r.pos = h.pos THEN h.after_pos ELSE r.next_pos END,
               r.step + 1
        FROM ranked r JOIN hit h ON h.word = r.word
        WHERE r.pos <> h.next_pos AND r.step < {steps}
    )
)
SELECT word, pos, tok, step FROM state
"""

#: The same for long words: a step also contracts the pairs of that rank further right which do not overlap.
CONTRACT_LONG = """
WITH RECURSIVE state(word, pos, tok, step) AS (
    SELECT word, pos, tok, 0 FROM start
    UNION ALL
    SELECT word, pos, CASE WHEN taken THEN low ELSE tok END, step + 1
    FROM (
        SELECT *, coalesce(lag(taken) OVER (PARTITION BY word ORDER BY pos), false) AS gone
        FROM (
            SELECT *, hit AND (row_number() OVER (PARTITION BY word, run, hit ORDER BY pos)) % 2 = 1 AS taken
            FROM (
                SELECT *, coalesce(rank = low, false) AS hit,
                       sum(CASE WHEN rank = low THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) AS run
                FROM (
                    SELECT n.*, m.rank, min(m.rank) OVER (PARTITION BY n.word) AS low
                    FROM (SELECT *, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS next FROM state) n
                    LEFT JOIN merges m ON m.a = n.tok AND m.b = n.next
                )
                WHERE low IS NOT NULL AND step < {steps}
            )
        )
    )
    WHERE NOT gone
)
SELECT word, pos, tok, step FROM state
"""

DECODE = """
SELECT t.text, list(v.piece ORDER BY t.pos) AS pieces
FROM ids t JOIN vocabulary v ON v.tok = t.tok GROUP BY t.text ORDER BY t.text
"""


class Engine:
    """The tables of one task, and the ids of words seen before."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.split, self.by_class = merges, splitter(pattern), pattern == CLASS_PATTERN
        self.known: dict[str, bytes] = {}
        self.byte = np.zeros(256, np.int32)
        for i, t in enumerate(merges.tokens):
            if len(t) == 1:
                self.byte[t[0]] = i
        self.lengths = np.array([len(t) for t in merges.tokens] + [0], np.int64)
        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = merges.pairs
        self._table("merge_rows", a=pairs[:, 0], b=pairs[:, 1], rank=pairs[:, 2])
        self.sql.execute("CREATE TABLE merges AS FROM merge_rows")
        self._table("pieces", tok=np.arange(len(merges.tokens), dtype=np.int32), piece=pa.array(merges.tokens, pa.binary()))
        self.sql.execute("CREATE TABLE vocabulary AS FROM pieces")

    def _table(self, name: str, **columns) -> None:
        self.sql.register(name, pa.table({k: pa.array(v) for k, v in columns.items()}))

    def _contract(self, words: list[bytes], long: bool) -> list[bytes]:
        """Ids of each word as little-endian 32-bit integers."""
        lengths = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        done: list[bytes] = [b""] * len(words)
        steps = SHORT if not long else max(1, min(STEPS, 20 * ROWS // max(len(word), 1)))
        query = (CONTRACT_LONG if long and self.merges.at_once else CONTRACT).format(steps=steps)
        while len(word):
            self._table("start", word=word, pos=pos, tok=tok)
            out = self.sql.sql(query).to_arrow_table()
            word, pos, tok, step = (out.column(c).to_numpy() for c in ("word", "pos", "tok", "step"))
            last = np.zeros(len(words), np.int32)
            np.maximum.at(last, word, step)
            kept = np.flatnonzero(step == last[word])
            kept = kept[np.lexsort((pos[kept], word[kept]))]
            word, pos, tok = word[kept], pos[kept], tok[kept].astype(np.int32)
            open_ = last[word] >= steps  # stopped by the number of steps, perhaps not at its end
            ready_word, ready_tok = word[~open_], tok[~open_].astype("<u4").tobytes()
            at = np.flatnonzero(np.diff(ready_word, prepend=-1))
            for w, a, b in zip(ready_word[at].tolist(), at.tolist(), [*at[1:].tolist(), len(ready_word)][: len(at)], strict=True):
                done[w] = ready_tok[4 * a : 4 * b]
            word, pos, tok = word[open_], pos[open_], tok[open_]
        return done

    def _learn(self, words: list[str], into: dict[str, bytes]) -> None:
        raw = [(w, w.encode()) for w in words]
        for long in (False, True):
            kind = [x for x in raw if (len(x[1]) > SHORT) == long]
            for a, b in _portions([len(x[1]) for x in kind], ROWS):
                ids = self._contract([x[1] for x in kind[a:b]], long)
                into.update(zip([x[0] for x in kind[a:b]], ids, strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        whole = "".join(texts)
        starts, before = self.split(whole, np.cumsum([0, *map(len, texts)]))
        first, which = distinct_words(whole, starts)
        ends = np.append(starts[1:], len(whole))[first].tolist()
        words = [whole[a:b] for a, b in zip(starts[first].tolist(), ends, strict=True)]
        known = self.known
        found: dict[str, bytes] = {}
        self._learn([w for w in words if w not in known], found)
        ids = [known[w] if w in known else found[w] for w in words]
        known.update((w, x) for w, x in found.items() if len(w) <= SHORT and len(known) < REMEMBERED)
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        counts, place = sizes[which], (np.cumsum(sizes) - sizes)[which]
        total = np.concatenate([[0], np.cumsum(counts)])
        out = flat[np.repeat(place - total[:-1], counts) + np.arange(total[-1])]
        return out, np.diff(total[before])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of texts of ``counts`` ids each end to end, and how many each has; none for an id that the vocabulary lacks."""
        text = np.repeat(np.arange(len(counts)), counts)
        tok = np.minimum(ids.astype(np.int64), len(self.lengths) - 1)
        bodies = [np.zeros(0, np.uint8)]
        for k in range(0, len(tok), TOGETHER):  # also within a long text
            part = slice(k, k + TOGETHER)
            self._table("ids", text=text[part], pos=np.arange(len(tok[part])), tok=tok[part])
            pieces = self.sql.sql(DECODE).to_arrow_table().column("pieces").combine_chunks()
            lists = pieces.chunk(0) if isinstance(pieces, pa.ChunkedArray) and pieces.num_chunks else pieces
            if len(lists):
                bodies.append(text_buffer(lists.flatten().cast(pa.large_binary()))[0])
        return np.concatenate(bodies), np.bincount(text, self.lengths[tok], len(counts)).astype(np.int64)


def distinct_words(whole: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An occurrence of each distinct word, and for every word which of them it equals.

    Words are told apart by two independent 64-bit hashes; if the first is ever not enough, by the words themselves.
    """
    code = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    edge, hashes = np.append(starts, len(code)), []
    for base in (0x5851F42D4C957F2D, 0xD1342543DE82EF95):
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(code * powers(base, len(code)), out=total[1:])
        back = powers(pow(base, -1, 1 << 64), len(code) + 1)
        hashes.append((total[edge[1:]] - total[edge[:-1]]) * back[edge[:-1]] + np.diff(edge).astype(np.uint64))
    _, first, which = np.unique(hashes[0], return_index=True, return_inverse=True)
    if (hashes[1] == hashes[1][first][which]).all():
        return first, which
    words = [whole[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    place: dict[str, int] = {}
    which = np.array([place.setdefault(w, len(place)) for w in words])
    return np.unique(which, return_index=True)[1], which


def splitter(pattern: str):
    """Starts of the words of texts that lie end to end, and the number of words before each text.

    The usual pattern is followed for all texts of a batch at once by the classes of characters; others match by match.
    """
    if pattern == CLASS_PATTERN:
        return class_starts
    compiled = regex.compile(pattern)

    def starts(whole: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [[m.start() for m in compiled.finditer(whole, a, b)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return np.array([x for f in found for x in f], np.int64), np.cumsum([0, *map(len, found)])

    return starts


_SAFE = regex.compile(r"(?<=\S) (?=\S)")


def parts(text: str) -> Iterator[str]:
    """A long text in parts that have the words of the whole: a single space between others starts a word in any case."""
    start = 0
    while len(text) - start > PART and (found := _SAFE.search(text, start + PART)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


#: Fixed value: the pattern that ``class_starts`` follows.
CLASS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER, _LETTER, _NUMBER, _BLANK = range(4)


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    for kind, name in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(name, every):
            out[m.start() : m.end()] = kind
    return out


def class_starts(whole: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words are runs of one class, but a single blank before a run goes with it if it is a space, the other blanks of a
    run stay together, and some endings after an apostrophe stand alone."""
    code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    size = len(code)
    if not size:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    edge = np.zeros(size + 4, bool)  # where a text starts or ends
    edge[bounds] = True
    kind = np.full(size + 4, 255, np.uint8)
    kind[:size] = _classes()[code]
    start = edge.copy()
    start[1:size] |= kind[1:size] != kind[: size - 1]
    run = start.copy()
    blank = kind[:size] == _BLANK
    last = np.flatnonzero(blank & run[1 : size + 1] & ~edge[1 : size + 1])  # a blank before something of its text
    start[last] = True
    joined = last[code[last] == 0x20] + 1
    start[joined] = False
    quote = np.flatnonzero(run[:size] & (code == 0x27) & start[:size])
    quote = quote[~edge[quote + 1] & (kind[quote + 1] == _LETTER)]
    letters = np.concatenate([code, np.zeros(4, np.uint32)])
    one, two = letters[quote + 1], letters[quote + 2]
    two = np.where(edge[quote + 2], 0, two)
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
    start[quote[single | double] + 1] = False
    start[quote[single] + 2] = True
    start[quote[double] + 3] = True
    found = np.flatnonzero(start[:size])
    return found, np.searchsorted(found, bounds)


_ENGINES: dict[str, Engine] = {}


def _engine(shared, name: str, pattern: str) -> Engine:
    """One per Python worker and vocabulary."""
    if name not in _ENGINES:
        _ENGINES.clear()
        _ENGINES[name] = Engine(shared.value, pattern)
    return _ENGINES[name]


def _shared(docs: DataFrame, tokens: list[bytes], pattern: str):
    """The vocabulary as a broadcast, and a name of its content."""
    name = hashlib.sha256(pattern.encode() + b"\0".join(base64.b64encode(t) for t in tokens)).hexdigest()
    return docs.sparkSession.sparkContext.broadcast(Merges(tokens)), name


def _portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def _mapped(docs: DataFrame, column: str, into: dict[str, str], work) -> DataFrame:
    """``docs`` with the columns ``into`` that ``work`` makes of ``column`` a batch at a time."""
    others = [c for c in docs.columns if c not in into]
    names = [f"c{i}" for i in range(len(others))]
    base, source = docs.select(others).toDF(*names), names[others.index(column)]
    made = [f"m{i}" for i in range(len(into))]
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in base.schema] + [f"{m} {t}" for m, t in zip(made, into.values(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, columns in work(batch.column(source)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*names, *made])

    return base.mapInArrow(run, ", ".join(fields)).toDF(*others, *into)


def _binary(body: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive stretches of ``body`` as values."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))])


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, *, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (token ids as little-endian unsigned 32-bit integers, end to end) and ``n_tokens``.

    Each match of ``pattern`` is encoded by itself, over the whole text; null and empty texts have no ids.  The
    vocabulary must have all 256 single bytes.  Columns named ``ids`` or ``n_tokens`` are replaced.
    """
    shared, name = _shared(docs, tokens, pattern)

    def work(texts: pa.Array):
        engine = _engine(shared, name, pattern)
        values = [t or "" for t in texts.to_pylist()]
        for a, b in _portions([len(t) for t in values], TOGETHER):
            ids, counts = engine.encode(values[a:b])
            yield a, b, [_binary(ids, 4 * counts), pa.array(counts, pa.int64())]

    return _mapped(docs, text, {"ids": "binary", "n_tokens": "bigint"}, work)


def decode(docs: DataFrame, tokens: list[bytes], pattern: str, *, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded``: the bytes that the ids stand for, empty for null."""
    shared, name = _shared(docs, tokens, pattern)

    def work(column: pa.Array):
        engine = _engine(shared, name, pattern)
        body, starts = text_buffer(column.fill_null(b"").cast(pa.large_binary()))
        for a, b in _portions((np.diff(starts) // 4).tolist(), TOGETHER):
            part = body[starts[a] : starts[b]].tobytes()
            out, lengths = engine.decode(np.frombuffer(part, "<u4"), np.diff(starts[a : b + 1]) // 4)
            yield a, b, [_binary(out, lengths)]

    return _mapped(docs, ids, {"decoded": "binary"}, work)


def round_trip(docs: DataFrame, tokens: list[bytes], pattern: str, *, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``encode`` and ``decode``, by one engine in each task."""
    shared, name = _shared(docs, tokens, pattern)

    def work(texts: pa.Array):
        engine = _engine(shared, name, pattern)
        values = [t or "" for t in texts.to_pylist()]
        for a, b in _portions([len(t) for t in values], TOGETHER):
            ids, counts = engine.encode(values[a:b])
            out, lengths = engine.decode(ids, counts)
            yield a, b, [_binary(ids, 4 * counts), pa.array(counts, pa.int64()), _binary(out, lengths)]

    return _mapped(docs, text, {"ids": "binary", "n_tokens": "bigint", "decoded": "binary"}, work)
