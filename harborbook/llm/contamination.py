"""Passages of a benchmark in documents, also with words replaced, by spaced-seed hashing.

A seed is the hash of five words at the places that a mask keeps; words at the other places may differ.  Seeds of documents
and of benchmark items are joined, and around every hit the two texts are compared word by word.  The masks are such that
any ``WINDOW`` aligned words (or any whole shorter item of ``LEAST`` words or more) with at most a fifth of them replaced
have a seed in common, so none is missed.  An item of fewer words has one seed, the hash of all its words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborbook.llm.tables import drop, written
from harborbook.llm.texts import rolled, steps, word_hashes

MASKS = ("101111", "1110011", "11001011")
WINDOW, LEAST, SAME = 20, 8, 0.8
#: Slots of the filter that spares the join most seeds without a partner.  Its size is fixed; where a large benchmark fills
#: it, more seeds go through the join, with the same results.
SLOTS = 1 << 22

_SEEDS = "words binary, seed array<bigint>, at array<int>"


def _seeds(words: np.ndarray, before: np.ndarray, short: Iterable[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word, seed) of every mask at every place where it stays within a text; the lengths ``short`` are masks too."""
    end = np.repeat(before[1:], np.diff(before))  # of the text of each word
    for k, mask in [*enumerate(MASKS), *[(len(MASKS) + n, "1" * n) for n in short]]:
        places = [i for i, c in enumerate(mask) if c == "1"]
        count = max(0, len(words) - len(mask) + 1)
        at = np.flatnonzero(np.arange(count) + len(mask) <= end[:count])
        mixed = np.full(len(at), k + 1, np.uint64)
        for p in places:
            mixed = rolled(np.column_stack([mixed, words[at + p]]).ravel(), 2)[::2]
        yield at, mixed


def _slot(seed: np.ndarray) -> np.ndarray:
    return (seed >> np.uint64(11)).astype(np.int64) % SLOTS


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and seeds of benchmark items."""
    for batch in batches:
        for row, body, starts in steps(batch.column("text")):
            words, _, _, before = word_hashes(body, starts)
            sizes = np.diff(before)
            found = list(_seeds(words, before, range(1, LEAST)))
            at, seed = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            length = np.concatenate([np.full(len(a), max(0, k - len(MASKS) + 1)) for k, (a, _) in enumerate(found)])
            which = np.searchsorted(before, at, side="right") - 1
            # Short items have the seed of all their words, and only these have such seeds.
            own = length == np.where(sizes < LEAST, sizes, 0)[which]
            order = np.flatnonzero(own)[np.argsort(which[own], kind="stable")]
            at, seed, which = at[order], seed[order], which[order]
            ends = np.searchsorted(which, np.arange(len(sizes) + 1)).tolist()
            out = [
                (words[a:b].tobytes(), seed[x:y].view(np.int64).tolist(), (at[x:y] - a).tolist())
                for a, b, x, y in zip(before[:-1].tolist(), before[1:].tolist(), ends[:-1], ends[1:], strict=True)
            ]
            columns = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, len(sizes)), *columns], names=["id", "words", "seed", "at"])


def _segments(batches: Iterator[pa.RecordBatch], used: np.ndarray, short: list[int]) -> Iterator[pa.RecordBatch]:
    """Stretches of documents around seeds that pass the filter, with the words ``WINDOW`` to either side."""
    for batch in batches:
        out = []
        for row, body, starts in steps(batch.column("text")):
            words, _, _, before = word_hashes(body, starts)
            found = [(a[k], s[k]) for a, s in _seeds(words, before, short) for k in [np.flatnonzero(used[_slot(s)])]]
            if not found:
                continue
            at = np.concatenate([a for a, _ in found])
            seed = np.concatenate([s for _, s in found])
            order = np.argsort(at, kind="stable")
            at, seed = at[order], seed[order]
            which = np.searchsorted(before, at, side="right") - 1
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) > WINDOW) | (np.diff(which) > 0)
            first = np.flatnonzero(new)
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
                doc = int(which[a])
                begin = max(int(before[doc]), int(at[a]) - WINDOW)
                end = min(int(before[doc + 1]), int(at[b - 1]) + 8 + WINDOW)
                out.append((row + doc, begin - int(before[doc]), words[begin:end].tobytes(), seed[a:b].view(np.int64).tolist(), (at[a:b] - begin).tolist()))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        rows, *columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), *columns], names=["id", "start", "words", "seed", "at"])


def compare(segment: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(equal words, first, end) of the aligned words around the best window, or None if no window is equal enough.

    ``item`` word j lies beside ``segment`` word j + shift.
    """
    size = min(WINDOW, len(item))
    low, high = max(0, shift), min(len(segment), len(item) + shift)
    if not size or high - low < size:
        return None
    same = segment[low:high] == item[low - shift : high - shift]
    total = np.concatenate([[0], np.cumsum(same)])
    in_window = total[size:] - total[:-size]
    good = np.flatnonzero(in_window >= (size if size < LEAST else np.ceil(SAME * size - 1e-9)))
    if not len(good):
        return None
    first, end = int(good[0]), int(good[-1]) + size
    return int(total[end] - total[first]), low + first, low + end


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, out = [], []
        rows = zip(batch.column("words").to_pylist(), batch.column("item_words").to_pylist(), batch.column("shift").to_pylist(), batch.column("start").to_pylist(), strict=True)
        for k, (segment, item, shift, start) in enumerate(rows):
            if hit := compare(np.frombuffer(segment, np.uint64), np.frombuffer(item, np.uint64), shift):
                keep.append(k)
                out.append((hit[0], start + hit[1], start + hit[2]))
        taken = [batch.column(c).take(pa.array(keep, pa.int64())) for c in ("id", "item")]
        yield pa.RecordBatch.from_arrays([*taken, *[pa.array([o[k] for o in out], pa.int64()) for k in range(3)]], names=["id", "item", "equal", "first", "end"])


def contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_equal, first_word, end_word): each pair of a document and an item that share a passage.

    A passage is ``WINDOW`` aligned words, or a whole item that has fewer, of which four fifths are equal (A-Z as a-z); of an
    item of fewer than ``LEAST`` words all are equal.  Of several places the one with most equal words is reported, then the
    first.  Null and empty texts match nothing.  Rows with one id (null too) are one document or one item; ids of any type are
    handed on.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.select(F.col(doc_id).alias("x")).schema["x"].dataType.simpleString(), benchmark.select(F.col(item_id).alias("x")).schema["x"].dataType.simpleString()
    # An item is a row: also those with one id, or none, are looked for by their own texts.
    items = benchmark.select(F.struct(F.col(item_id).alias("item"), F.xxhash64(item_text).alias("hash")).alias("id"), F.col(item_text).alias("text"))
    item = f"struct<item:{item_kind},hash:bigint>"
    items = written(items.mapInArrow(_items, f"id {item}, {_SEEDS}"), "items")
    seeds = items.select(F.col("id").alias("item"), F.explode(F.arrays_zip("seed", "at")).alias("s"))
    seeds = written(seeds.select("item", "s.seed", F.col("s.at").alias("item_at")).distinct(), "seeds")
    slot = F.shiftrightunsigned("seed", 11) % SLOTS
    used = np.zeros(SLOTS, bool)
    used[[r[0] for r in seeds.select(slot.alias("slot")).distinct().collect()]] = True  # SLOTS numbers at most
    shared = spark.sparkContext.broadcast(np.packbits(used))
    sizes = items.select((F.octet_length("words") / 8).cast("int").alias("n")).where(f"n > 0 AND n < {LEAST}").distinct()
    short = sorted(r["n"] for r in sizes.collect())  # LEAST numbers at most

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _segments(batches, np.unpackbits(shared.value).astype(bool), short)

    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    segments = base.mapInArrow(find, f"id {kind}, start bigint, {_SEEDS}").withColumn("segment", F.xxhash64("id", "start", "words"))
    segments = written(segments, "segments")
    hits = segments.select("segment", F.explode(F.arrays_zip("seed", "at")).alias("s")).select("segment", "s.seed", "s.at")
    hits = hits.join(seeds, "seed").select("segment", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    pairs = hits.join(segments.select("segment", "id", "start", "words").dropDuplicates(["segment"]), "segment")
    known = items.select(F.col("id").alias("item"), F.col("words").alias("item_words")).dropDuplicates(["item"])
    found = pairs.join(known, "item").select("id", "item", "start", "words", "item_words", "shift")
    found = found.mapInArrow(_verify, f"id {kind}, item {item}, equal bigint, first bigint, end bigint").withColumn("item", F.col("item.item"))
    best = found.groupBy("id", "item").agg(F.max(F.struct("equal", (-F.col("first")).alias("f"), "end")).alias("b"))
    best = written(best, "passages")
    drop(items, seeds, segments)
    return best.select(
        F.col("id").alias("doc_id"),
        F.col("item").alias("item_id"),
        F.col("b.equal").alias("n_equal"),
        (-F.col("b.f")).alias("first_word"),
        F.col("b.end").alias("end_word"),
    )
