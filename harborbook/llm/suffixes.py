"""Bytes covered by strings of ``LENGTH`` bytes that also start earlier, from a distributed merge of sorted suffixes.

Every window of ``LENGTH`` bytes has an anchor, its ``GRAM``-byte string of least hash, at the same place in every copy of the
window.  So only suffixes at anchors are sorted: from the anchor to the end of the last window that it serves, beside the
bytes before it.  A task sorts the suffixes of a stretch of text into one run per part of the anchors' hashes, drops exact
copies, and writes the run front-coded.  The runs of a part meet in one group and are combined by a loser tree that
knows the common prefix of each contender with the last winner and compares only behind it.  The merged order has the
common prefix of all neighbours; with the same for the bytes before the anchors it tells equal windows, of which all but
the first are covered.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborbook.llm.tables import written
from harborbook.llm.texts import _mix, powers, steps

LENGTH, GRAM = 100, 16
LEFT = LENGTH - GRAM  # bytes before an anchor at most
#: Bytes of text behind one run, and behind one part.
RUN, PART = 1 << 22, 12 << 20
LAST = 2**63 - 1


def _anchors(body: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, hash of the anchor) of runs of windows with one anchor, within texts."""
    size = len(body)
    if size < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    # Products of uneven 64-bit numbers per place; a gram's hash is the difference of two running sums, moved to place 0.
    base = 0x5851F42D4C957F2D
    total = np.zeros(size + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(base, size), out=total[1:])
    count = size - GRAM + 1
    gram = _mix((total[GRAM:] - total[:count]) * powers(pow(base, -1, 1 << 64), count))
    del total
    bits = np.uint64(max(1, (count - 1).bit_length()))
    low = (gram >> bits << bits) | np.arange(count, dtype=np.uint64)
    reach, have = LEFT + 1, 1  # least key of windows of ``have`` grams, doubled until ``reach``
    while have < reach:
        step = min(have, reach - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    anchor = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)  # of the window at each place
    windows = np.arange(len(anchor))
    text = np.searchsorted(starts, windows, side="right") - 1
    whole = windows + LENGTH <= starts[text + 1]
    windows, anchor, text = windows[whole], anchor[whole], text[whole]
    new = np.ones(len(windows), bool)
    new[1:] = (np.diff(anchor) != 0) | (np.diff(text) != 0)
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(windows)) - 1
    return windows[first], windows[end], anchor[first], gram[anchor[first]]


def _matrix(body: np.ndarray, at: np.ndarray, lengths: np.ndarray, width: int, step: int) -> np.ndarray:
    """Bytes from ``at`` on, forwards or backwards, plus one so that 0 is free for what lies beyond."""
    column = np.arange(width)
    rows = body[np.clip(at[:, None] + step * column, 0, len(body) - 1)] + np.uint8(1)  # UTF-8 has no byte 255
    rows[column >= lengths[:, None]] = 0
    return rows


def _common(rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        out[1:] = np.minimum(out[1:], np.minimum(lengths[1:], lengths[:-1]))
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one value; bytes of equal weight lie together, since most high ones are 0."""
    raw = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=6).compress(struct.pack(f"<{len(raw)}q", *map(len, raw)) + b"".join(raw))


def _unpack(data: bytes, kinds: tuple) -> list[np.ndarray]:
    whole = zstandard.ZstdDecompressor().decompress(data)
    sizes = struct.unpack_from(f"<{len(kinds)}q", whole)
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes, kinds, strict=True):
        planes = np.frombuffer(whole, np.uint8, size, at).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


_KINDS = (np.uint8, np.uint8, np.uint8, np.uint8, np.uint8, np.int64, np.int64, np.int64, np.int64, np.int64, np.int64, np.int64)


def _runs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, run); a run holds sorted suffixes, and the places of exact copies left out of it."""
    for batch in batches:
        ids, keys = (batch.column(c).to_numpy() for c in ("id", "key"))
        for row, body, starts in steps(batch.column("text"), RUN):
            first, last, anchor, gram = _anchors(body, starts)
            if not len(first):
                continue
            text = np.searchsorted(starts, anchor, side="right") - 1
            part = ((gram >> np.uint64(17)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
            out_part, out_run = [], []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
                mine = order[a:b]
                at, f, doc = anchor[mine], first[mine], text[mine]
                right, left = last[mine] + LENGTH - at, at - f
                rows = np.hstack([_matrix(body, at, right, LENGTH, 1), _matrix(body, at - 1, left, LEFT, -1)])
                place_id, place_key, start = ids[row + doc], keys[row + doc], f - starts[doc]
                sort = np.lexsort((start, place_id, rows.view(f"S{LENGTH + LEFT}").ravel()))
                rows, right, left, place_id, place_key, start = (x[sort] for x in (rows, right, left, place_id, place_key, start))
                copy = np.zeros(len(rows), bool)
                copy[1:] = (rows[1:] == rows[:-1]).all(axis=1)
                # Equal rows with the same place are one document that is there twice; neither is earlier.
                origin = np.maximum.accumulate(np.where(copy, 0, np.arange(len(rows))))
                later = copy & ((place_id != place_id[origin]) | (start != start[origin]))
                keep = ~later
                kept = rows[keep]
                prefix = _common(kept[:, :LENGTH], right[keep])
                column = np.arange(LENGTH)
                tail = kept[:, :LENGTH][(column >= prefix[:, None]) & (column < right[keep][:, None])]
                before = kept[:, LENGTH:][np.arange(LEFT) < left[keep][:, None]]
                out_part.append(int(part[mine[0]]))
                span = (right + left)[later]
                out_run.append(_pack(
                    prefix.astype(np.uint8), right[keep].astype(np.uint8), left[keep].astype(np.uint8), tail, before,
                    place_id[keep], place_key[keep], start[keep],
                    place_id[later], place_key[later], start[later], start[later] + span,
                ))
            yield pa.RecordBatch.from_arrays([pa.array(out_part, pa.int32()), pa.array(out_run, pa.binary())], names=["part", "run"])


def _behind(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    while a[known] == b[known]:
        known += 1
    return known


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge front-coded sorted runs: (run, place in the run, common prefix with the one before) in order.

    A run has, for each string, the length of the prefix shared with the string before it and the bytes behind.  Of two
    contenders the one that shares more with the last winner is less; only if both share as much, bytes behind that are
    compared, and the loser remembers how far it agrees with the one that beat it.
    """
    k = len(runs)
    leaves = 1 << max(0, (k - 1).bit_length())
    text: list[bytes | None] = [None] * leaves  # the contender of each run; None when it has run out
    share, at = [0] * leaves, [0] * leaves
    for r, (_, tails) in enumerate(runs):
        text[r] = tails[0] if tails else None
    losers = [0] * leaves
    winners = [0] * (2 * leaves)

    def less(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); ties go to the lower run."""
        x, y = text[a], text[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        n = _behind(x, y, share[a])
        if n == len(x) == len(y):
            won, lost = (a, b) if a < b else (b, a)
        elif n == len(x) or (n < len(y) and x[n] < y[n]):
            won, lost = a, b
        else:
            won, lost = b, a
        share[lost] = n
        return won, lost

    for leaf in range(leaves):
        winners[leaves + leaf] = leaf
    for node in range(leaves - 1, 0, -1):
        winners[node], losers[node] = less(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if leaves > 1 else 0
    out_run, out_at, out_share = [], [], []
    while (now := text[best]) is not None:
        out_run.append(best)
        out_at.append(at[best])
        out_share.append(share[best])
        prefixes, tails = runs[best]
        i = at[best] = at[best] + 1
        if i < len(tails):
            share[best] = n = prefixes[i]
            text[best] = now[:n] + tails[i]
        else:
            text[best] = None
        node = (leaves + best) >> 1
        while node:
            rival = losers[node]
            # The common cases of ``less`` in place.
            if text[best] is not None and text[rival] is not None and share[best] != share[rival]:
                if share[rival] > share[best]:
                    best, losers[node] = rival, best
            else:
                best, losers[node] = less(best, rival)
            node >>= 1
    return out_run, out_at, out_share


def _pieces(body: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    raw, ends = body.tobytes(), np.cumsum(lengths).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(lengths) else []


def _covered(key, table):
    """Spans of the windows of a part that start earlier elsewhere."""
    runs, columns, known = [], [], []
    for blob in table.column("run").to_pylist():
        prefix, right, left, tail, before, *places = _unpack(blob, _KINDS)
        runs.append((prefix.tolist(), _pieces(tail, right.astype(np.int64) - prefix)))
        columns.append((right.astype(np.int64), left.astype(np.int64), before, *places[:3]))
        known.append(np.stack(places[3:], axis=1))
    run, at, share = (np.array(x, np.int64) for x in merge_runs(runs))
    del runs
    offsets = np.cumsum([0, *[len(c[0]) for c in columns]])
    order = offsets[run] + at
    right, left, place_id, place_key, start = (np.concatenate([c[k] for c in columns])[order] for k in (0, 1, 3, 4, 5))
    # Bytes before the anchors, nearest first, in the merged order.
    count = len(order)
    sizes = np.concatenate([c[1] for c in columns])
    before = np.concatenate([c[2] for c in columns])
    begin = (np.cumsum(sizes) - sizes)[order]
    # Only suffixes that share enough with a neighbour on both sides together can have an equal window.
    near = np.maximum(share, np.append(share[1:], 0))
    chosen = np.flatnonzero(near + left >= LENGTH)
    spans = _equal_windows(chosen, share, right, left, before, begin, place_id, start) if count else None
    rows = [np.concatenate(known)] if known else []
    if spans is not None:
        item, low, high = spans  # windows low..high before the anchor
        anchor = start[item] + left[item]
        rows.append(np.stack([place_id[item], place_key[item], anchor - high, anchor - low + LENGTH], axis=1))
    rows = np.concatenate(rows)
    return pa.table({n: pa.array(rows[:, k]) for k, n in enumerate(("id", "key", "start", "end"))})


def _equal_windows(chosen, share, right, left, before, begin, place_id, start):
    """(suffix, least, greatest) numbers of bytes before the anchor for which the window is not the first of its kind."""
    if not len(chosen):
        return None
    # Least common prefix between neighbours among the chosen ones.
    between = np.stack([chosen[:-1] + 1, chosen[1:] + 1], axis=1).ravel()
    groups = np.minimum.reduceat(np.append(share, 0), between)[::2] if len(chosen) > 1 else share[:0]
    share = np.concatenate([[0], groups])
    right, left, begin, place_id, start = (x[chosen] for x in (right, left, begin, place_id, start))
    column = np.arange(LEFT)
    body = np.append(before, np.uint8(0))
    rows = body[np.minimum(begin[:, None] + column, len(body) - 1)]
    rows[column >= left[:, None]] = 0
    back = np.argsort(rows.view(f"S{LEFT}").ravel(), kind="stable")
    back_share = _common(rows[back], left[back])
    anchor = start + left
    least = LENGTH - right
    hits_item, hits_offset = [], []
    for offset in range(LEFT + 1):
        mine = np.flatnonzero((least <= offset) & (offset <= left))
        if len(mine) < 2:
            continue
        by_right = np.cumsum(share < LENGTH - offset)
        by_left = np.empty(len(rows), np.int64)
        by_left[back] = np.cumsum(back_share < offset) if offset else 0
        kind = by_right[mine] * (len(rows) + 2) + by_left[mine]
        sort = np.lexsort((anchor[mine], place_id[mine], kind))
        kind, mine = kind[sort], mine[sort]
        new = np.ones(len(mine), bool)
        new[1:] = kind[1:] != kind[:-1]
        origin = mine[np.maximum.accumulate(np.where(new, np.arange(len(mine)), 0))]
        later = (place_id[mine] != place_id[origin]) | (anchor[mine] != anchor[origin])
        hits_item.append(mine[later])
        hits_offset.append(np.full(int(later.sum()), offset))
    if not hits_item:
        return None
    item, offset = np.concatenate(hits_item), np.concatenate(hits_offset)
    sort = np.lexsort((offset, item))
    item, offset = item[sort], offset[sort]
    if not len(item):
        return None
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    return chosen[item[first]], offset[first], offset[np.append(first[1:], len(item)) - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, spans = [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("spans"), strict=True):
            raw = (text or "").encode()
            gone = 0
            parts, at, number = [], 0, 0
            if found.is_valid:
                ends = np.array([(s["start"], s["end"]) for s in found.as_py()], np.int64)
                ends = ends[np.argsort(ends[:, 0], kind="stable")]
                reach = np.maximum.accumulate(ends[:, 1])
                new = np.flatnonzero(np.append(True, ends[1:, 0] > reach[:-1]))
                for a, b in zip(ends[new, 0].tolist(), reach[np.append(new[1:], len(ends)) - 1].tolist(), strict=True):
                    parts.append(raw[at:a])
                    at, gone, number = b, gone + b - a, number + 1
            kept.append(b"".join([*parts, raw[at:]]))
            removed.append(gone)
            spans.append(number)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([len(k) + r for k, r in zip(kept, removed, strict=True)], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every text as UTF-8 without bytes of 100-byte strings seen earlier.

    Earlier is a smaller id, null being the greatest, or an earlier byte of the same document; strings are judged on the
    input.  A string stands within one text.  Null is empty.  Rows with one id are one document for the order of places;
    rows that are equal in id and text are not earlier than each other.
    """
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("id", F.coalesce("doc_id", F.lit(LAST)))
    # Rows are told apart by a hash of the text where ids repeat; elsewhere the id does.
    repeated = not base.groupBy("id").count().where("count > 1").isEmpty()
    base = base.withColumn("key", F.xxhash64("text") if repeated else F.lit(0).cast("bigint"))
    size = F.octet_length("text").cast("bigint")
    long = base.where(size >= LENGTH)
    names = long.select("id", "key", size.alias("size"), F.unhex(F.sha2("text", 256)).alias("name"))
    names = written(names, "names")
    total = names.agg(F.sum("size")).first()[0] or 0
    parts = max(1, math.ceil(total / PART))
    firsts = names.groupBy("name").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last")
    firsts = written(firsts.select("name", "first"), "firsts")
    copies = names.join(firsts, "name").where("id != first").select("id", "key", F.lit(0).cast("bigint").alias("start"), F.col("size").alias("end"))
    copies = written(copies.distinct(), "copies")

    own = long.join(copies.select("id", "key"), ["id", "key"], "left_anti").select("id", "key", "text")
    runs = own.mapInArrow(lambda b: _runs(b, parts), "part int, run binary")
    spans = runs.groupBy("part").applyInArrow(_covered, "id bigint, key bigint, start bigint, end bigint")
    spans = spans.union(copies).groupBy("id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = written(spans.select(F.col("id").alias("of"), F.col("key").alias("of_key"), "spans"), "spans")
    found = base.join(spans, (F.col("id") == F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    found = found.select(F.col("doc_id").alias("id"), "text", "spans")
    out = found.mapInArrow(_cut, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("id", "doc_id")
