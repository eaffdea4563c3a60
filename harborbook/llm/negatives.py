"""Hard negatives: rows of another class that are nearly as close to an anchor as its positives.

Components become integers, and every score is their exact inner product.  It is computed in a residue number system: for
each of a few primes the matrices of residues are multiplied in float32, whose sums of ``DEPTH`` products stay below 2^24
and are exact; Chinese remaindering puts the signed score together.  How many primes are needed follows from the largest
component of the table.

Anchors are a stated set of queries against all rows.  Both lie in tables of blocks, every block of rows meets every block
of anchors, and a task keeps the best few rows of each anchor while its blocks pass by.  A window selects among what the
tasks kept.  The first pass finds the positives, whose scores bound the negatives that the second pass looks for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborbook.llm.tables import written

#: Products that are added up in float32, and primes of which ``DEPTH`` products of two residues stay below 2^24.
DEPTH = 64
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)
#: Rows of a block, anchors of a block, and anchors that are compared with a block of rows at once.
ROWS, ANCHORS, AT_ONCE = 4096, 4096, 256
_MOST = 2**62
_LOW, _HIGH = -(2**63), 2**63 - 1


def primes_for(bound: int) -> tuple[int, ...]:
    """The first primes whose product tells all integers from -bound to bound apart."""
    product = 1
    for k, p in enumerate(PRIMES):
        product *= p
        if product > 2 * bound:
            return PRIMES[: k + 1]
    raise ValueError("inner products may not fit into 64 bits")


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    """The residue of least absolute value."""
    half = p // 2
    return (x + half) % p - half


def exact_scores(a: np.ndarray, b: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """Inner products (int64) of the integer rows of ``a`` with those of ``b``, within what ``primes`` tell apart."""
    residues = []
    for p in primes:
        x, y = _balanced(a, p).astype(np.float32), _balanced(b, p).astype(np.float32)
        total = np.zeros((len(a), len(b)), np.int64)
        for k in range(0, a.shape[1], DEPTH):
            total += (x[:, k : k + DEPTH] @ y[:, k : k + DEPTH].T).astype(np.int64)
        residues.append(total % p)
    # Mixed radix with digits of least absolute value, so the sign needs no correction.
    out, weight, digits = np.zeros((len(a), len(b)), np.int64), 1, []
    for k, p in enumerate(primes):
        digit = residues[k]
        for q, d in zip(primes[:k], digits, strict=True):
            digit = (digit - d) * pow(q, -1, p) % p
        digit = _balanced(digit, p)
        digits.append(digit)
        # The last weights may be beyond 64 bits; the sum is right modulo 2^64 all the same.
        out += digit * np.array(weight % 2**64, np.uint64).astype(np.int64)
        weight *= p
    return out


class Best:
    """The ``most`` best (score, id) of each of ``count`` places: higher scores first, then smaller ids."""

    def __init__(self, count: int, most: int):
        self.score, self.id = np.full((count, most), _LOW), np.full((count, most), _HIGH)

    def beaten(self, places: slice, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which scores would get in, with a row of ``scores`` for each of ``places``."""
        last, last_id = self.score[places, -1:], self.id[places, -1:]
        return (scores > last) | ((scores == last) & (ids < last_id))

    def add(self, place: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        if not len(place):
            return
        most = self.score.shape[1]
        touched, local = np.unique(place, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(touched)), most), local])
        score = np.concatenate([self.score[touched].ravel(), score])
        id = np.concatenate([self.id[touched].ravel(), id])
        # The order of falling scores is that of their complements, also for the least integer.
        order = np.lexsort((id, ~score, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = order[rank < most]
        self.score[touched], self.id[touched] = score[kept].reshape(-1, most), id[kept].reshape(-1, most)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, score, id) of all that is there."""
        place, k = np.nonzero(self.id < _HIGH)
        return place, self.score[place, k], self.id[place, k]


_BLOCK = "ids binary, labels binary, components binary, low binary, high binary, positives binary"


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, width: int, kind: str, scale: float) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, vector, found) as blocks of plain arrays."""

    def block(part: pa.Table) -> pa.RecordBatch:
        vectors = part.column("vector").combine_chunks()
        lengths = np.diff(vectors.offsets.to_numpy())
        matrix = np.zeros((len(part), width), kind)
        which = np.arange(width) < lengths[:, None]
        matrix[which] = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(kind)
        columns = [part.column(c).to_numpy().astype(np.int64) for c in ("id", "label")]
        columns = [*columns, matrix]
        if "found" in part.column_names:
            found = part.column("found").to_pylist()
            most = max(map(len, found))
            # Places without a positive have a range that holds nothing.
            low, high, positive = np.full((len(part), most), _HIGH), np.full((len(part), most), _LOW), np.full((len(part), most), _HIGH)
            for i, row in enumerate(found):
                for k, x in enumerate(row):
                    low[i, k], high[i, k], positive[i, k] = x["low"], x["score"], x["row"]
            columns += [low, high, positive]
        else:
            columns += [np.zeros((0, 0), np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=[c.split()[0] for c in _BLOCK.split(", ")])

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, rows - count)
            batch = batch.slice(len(part))
            held.append(part)
            count += len(part)
            if count == rows:
                yield block(pa.Table.from_batches(held))
                held, count = [], 0
    if count:
        yield block(pa.Table.from_batches(held))


def _values(batch: pa.RecordBatch, name: str, k: int, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(batch.column(name)[k].as_buffer(), kind)


def _near(batches: Iterator[pa.RecordBatch], width: int, kind: str, primes: tuple[int, ...], most: int, negatives: bool) -> Iterator[pa.RecordBatch]:
    """The ``most`` best rows of each anchor, of its label or, for ``negatives``, of other labels and for each positive."""
    state: dict[bytes, tuple] = {}
    for batch in batches:
        for k in range(len(batch)):
            name = batch.column("a_ids")[k].as_buffer().to_pybytes()
            if name not in state:
                ids, labels = np.frombuffer(name, "<i8"), _values(batch, "a_labels", k)
                low, high, positives = (_values(batch, f"a_{c}", k).reshape(len(ids), -1) if negatives else None for c in ("low", "high", "positives"))
                state[name] = ids, labels, low, high, positives, Best(len(ids) * (low.shape[1] if negatives else 1), most)
            ids, labels, low, high, _, best = state[name]
            anchors = _values(batch, "a_components", k, kind).reshape(len(ids), width).astype(np.int64)
            row_ids, row_labels = _values(batch, "ids", k), _values(batch, "labels", k)
            rows = _values(batch, "components", k, kind).reshape(len(row_ids), width).astype(np.int64)
            for a in range(0, len(ids), AT_ONCE):
                part = slice(a, min(a + AT_ONCE, len(ids)))
                scores = exact_scores(anchors[part], rows, primes)
                same = labels[part, None] == row_labels
                if not negatives:
                    i, j = np.nonzero(same & (ids[part, None] != row_ids) & best.beaten(part, scores, row_ids))
                    best.add(a + i, scores[i, j], row_ids[j])
                    continue
                for n in range(low.shape[1]):
                    places = slice(part.start * low.shape[1] + n, part.stop * low.shape[1], low.shape[1])
                    fits = ~same & (scores >= low[part, n : n + 1]) & (scores <= high[part, n : n + 1])
                    i, j = np.nonzero(fits & best.beaten(places, scores, row_ids))
                    best.add((a + i) * low.shape[1] + n, scores[i, j], row_ids[j])
    for ids, _, _, high, positives, best in state.values():
        place, score, row = best.rows()
        if negatives:
            columns = [np.repeat(ids, high.shape[1])[place], positives.ravel()[place], high.ravel()[place], row, score]
            names = ["anchor", "positive", "positive_score", "row", "score"]
        else:
            columns, names = [ids[place], row, score], ["anchor", "row", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def mine_hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    low: tuple[int, int] = (4, 5),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` marks.

    A component x counts as floor(``scale`` * x), a score is the integer inner product.  The positives of an anchor are the
    first ``positives`` other rows of its label, and the negatives of each are the first ``negatives`` rows of other labels
    that score at most as much as the positive and at least the share ``low`` (numerator, denominator) of it: higher scores
    first, ties by the smaller id.

    Rows without id, label or vector, or with a component that is null or not finite take no part.  Rows of one id are one
    row, the first by label and vector.  Shorter vectors count as continued by zeros, empty ones score 0.  Scores that might
    not fit into 64 bits are an error.  An anchor without a positive, or a positive without a negative, has no row; an empty
    table gives none.  ``anchor`` and ``label`` see the columns of ``vectors``; ids and labels are integers.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    base = vectors.select(
        F.col(vec_id).cast("bigint").alias("id"),
        F.col(label).cast("bigint").alias("label"),
        F.col(vector).cast("array<double>").alias("vector") if dict(vectors.dtypes)[vector] != "array<float>" else F.col(vector).alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        finite.alias("finite"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND finite")
    first = F.min(F.struct("label", "vector", "anchor")).alias("r")
    rows = written(base.groupBy("id").agg(first).select("id", "r.*"), "vectors")

    extent = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    facts = rows.agg(F.max(F.size("vector")).alias("width"), F.max(extent).alias("extent"), F.count_if("anchor").alias("anchors")).first()
    width, largest = max(1, facts["width"] or 0), int(scale * (facts["extent"] or 0)) + 1
    if width * largest**2 >= _MOST:
        raise ValueError("inner products may not fit into 64 bits")
    primes = primes_for(width * largest**2)
    kind = "<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<i8"

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return written(df.mapInArrow(lambda b: _blocks(b, size, width, kind, scale), _BLOCK), name)

    def anchor_blocks(df: DataFrame, name: str) -> DataFrame:
        made = blocks(df.repartition(max(1, -(-facts["anchors"] // ANCHORS))), ANCHORS, name)
        return made.toDF(*[f"a_{c}" for c in made.columns])

    def best(row_blocks: DataFrame, anchor_blocks: DataFrame, most: int, keys: list[str], schema: str) -> DataFrame:
        # Every block of anchors, which are the queries, meets every block of rows.
        met = row_blocks.select("ids", "labels", "components").crossJoin(anchor_blocks)
        found = met.mapInArrow(lambda b: _near(b, width, kind, primes, most, len(keys) > 1), schema)
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    row_blocks = blocks(rows.select("id", "label", "vector"), ROWS, "blocks")
    anchors = rows.where("anchor").select("id", "label", "vector")
    near = best(row_blocks, anchor_blocks(anchors, "anchors"), positives, ["anchor"], "anchor bigint, row bigint, score bigint")
    # The least integer at or above the share, without rounding.
    least = -F.expr(f"floor(-(cast(score AS decimal(38,0)) * {low[0]}) / {low[1]})").cast("bigint")
    found = near.select("anchor", F.struct(least.alias("low"), "score", "row").alias("f")).groupBy("anchor").agg(F.collect_list("f").alias("found"))
    asking = anchors.join(found, F.col("id") == F.col("anchor")).select("id", "label", "vector", "found")
    schema = "anchor bigint, positive bigint, positive_score bigint, row bigint, score bigint"
    out = best(row_blocks, anchor_blocks(asking, "asking"), negatives, ["anchor", "positive"], schema)
    return out.select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("row").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
