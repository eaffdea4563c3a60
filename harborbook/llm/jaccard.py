"""Documents linked by the Jaccard similarity of their word shingles, with a token-group matrix.

1. Documents with equal shingle sets are one node.
2. Two linked sets share a shingle among the first quarter (and one) of each, in any common order (prefix filter).  Here
   shingles that very many documents have come last, others by their hash; so a passage that is everywhere brings
   nobody together.  The shared shingles of these prefixes are the tokens.
3. Similar nodes are partitioned into groups: nodes are compared with the least and the greatest node of each of their
   tokens, and what links makes a component.  Where tokens with more nodes than a group would bring together many more
   pairs than there are tokens, their nodes are at once compared with a few others of the token too.  While that many
   pairs of nodes of different components are left, and fewer of them each time, they are compared with a few others of
   the largest component of the token, and components grow.  They are cut into groups of about ``GROUP`` nodes.
4. The matrix has a row (token, group) for each token that stands in several components.  Through it, every node of the
   smaller component queries the groups of the other ones.  The number of tokens they share and the sizes bound the
   overlap; so does, for groups that are left, the union of their sets.  Only groups that may hold a link are opened
   and compared with the query.  Nodes of one component need no comparison.
5. Links make the final components.

Both sides of a join between nodes, tokens, groups or sets grow with the documents, so these are merge joins at every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborbook.llm.components import components
from harborbook.llm.tables import drop, written
from harborbook.llm.texts import shingle_sets, steps, word_hashes

WORDS, PERCENT, GROUP = 5, 75, 48
#: Shingles that come last in the order at most, and how often in a batch and in all one has to occur for that.  Only the
#: order of shingles depends on this, not the result.
COMMON, IN_BATCH, IN_ALL = 200_000, 6, 24
LAST = 2**40
#: A node of crowded tokens is compared with so many nodes at most in a turn; crowds are left to the matrix once they hold so many pairs
#: for each token of a node, or a turn leaves more than this share of them.  The result does not depend on these.
PICKS, PAIRS, LEFT = 8, 16, 0.75
#: Pairs, each for every token it shares, that the matrix settles sooner than the dozen small jobs of one more turn.
WORTH_A_TURN = 1 << 24
#: Bits of the filter that picks the texts whose sets are wanted, before the exact join.
BITS = 1 << 23


def _batch_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, body, starts in steps(texts):
        words, _, _, before = word_hashes(body, starts)
        yield from shingle_sets(words, before, WORDS)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several different sets of a batch have."""
    for batch in batches:
        seen, held, size = set(), [], 0
        parts = []

        def flush() -> None:
            if held:
                token, count = np.unique(np.concatenate(held), return_counts=True)
                often = count >= IN_BATCH
                parts.append((token[often], count[often]))

        for s in _batch_sets(batch.column("text")):
            name = hash(s.tobytes())
            if len(s) and name not in seen:
                seen.add(name)
                held.append(s)
                size += len(s)
            if size > 4_000_000:
                flush()
                held, size = [], 0
        flush()
        if parts:
            token, count = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count.astype(np.int64))], names=["token", "n"])


def _prefix(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The part of a sorted set in which it shares a shingle with every set it is linked with."""
    size = len(shingles)
    keep = size - -(-PERCENT * size // 100) + 1
    if len(common):
        late = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles
        if late.any():
            shingles = np.concatenate([shingles[~late], shingles[late]])
    return shingles[:keep]


def _signatures(batches: Iterator[pa.RecordBatch], common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Size of each set, a 128-bit name of its content, its prefix."""
    for batch in batches:
        sizes, names, prefixes = [], [], []
        for s in _batch_sets(batch.column("text")):
            sizes.append(len(s))
            names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            prefixes.append(_prefix(s, common))
        ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
        flat = np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), lists], names=["id", "n", "name", "prefix"])


def _sets(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array(np.flatnonzero(wanted[batch.column("slot").to_numpy()]))
        if len(rows):
            sets = [s.tobytes() for s in _batch_sets(batch.column("text").take(rows))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), pa.array(sets, pa.binary())], names=["node", "set"])


def _needed(n, m):
    """Tokens that linked sets of n and m shingles share at least, as SQL.

    Common shingles up to the end of the earlier prefix are tokens of both; behind it are at most 75 % of the larger set,
    less one.  Together they must make up three sevenths of both sizes.
    """
    return f"((3 * ({n} + {m}) + 6) div 7 - (3 * greatest({n}, {m}) + 3) div 4 + 1)"


def _least_needed(n, low, high):
    """The least ``_needed`` of n and any size from low to high, as SQL.

    It grows up to n.  Behind n it falls by 9/28 a size, but for its two roundings, which differ by less than 45/28 in all;
    so a size needs less than a later one only if that is the next, and then one less.
    """
    return f"least({_needed(n, low)}, {_needed(n, high)}, {_needed(n, f'greatest({low}, {high} - 1)')})"


def _enough(shared: int, union: int) -> bool:
    return 100 * shared >= PERCENT * union


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes whose sets are similar enough."""
    for batch in batches:
        keep = []
        for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(p) and len(q) and _enough(min(len(p), len(q)), max(len(p), len(q))):
                shared = len(np.intersect1d(p, q, assume_unique=True))
                if _enough(shared, len(p) + len(q) - shared):
                    keep.append(k)
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], names=["a", "b"])


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets by the upper half of each hash: as many equal halves as equal hashes, or more, so what bounds one bounds the other."""
    for batch in batches:
        halves = [(np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch.column("set")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(halves, pa.binary())], names=["node", "half"])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries (a) and groups whose union holds enough of the query."""
    for batch in batches:
        keep = []
        for k, (x, y) in enumerate(zip(batch.column("x"), batch.column("union"), strict=True)):
            p, q = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
            if len(p) and len(q) and 100 * int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) >= PERCENT * len(p):
                keep.append(k)
        rows = pa.array(keep, pa.int64())
        yield batch.select(["a", "na", "label", "chunk"]).take(rows)


def _union(key, rows):
    sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows.column("half")]
    union = np.unique(np.concatenate(sets)).tobytes()
    return pa.table({"label": pa.array([key[0].as_py()], pa.int64()), "chunk": pa.array([key[1].as_py()], pa.int64()), "union": pa.array([union], pa.binary())})


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""
    x = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.hint("merge").join(x, "a").join(y.hint("merge"), "b").mapInArrow(_linked, "a bigint, b bigint")


def _slot(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(BITS)).alias("slot")


def _used_slots(wanted: DataFrame):
    """Broadcast bits: which slots the ids in ``wanted`` (node) fall into."""
    used = np.zeros(BITS, bool)
    slots = wanted.select(_slot("node")).distinct()
    used[[r[0] for r in slots.collect()]] = True  # BITS numbers at most
    return wanted.sparkSession.sparkContext.broadcast(np.packbits(used))


def _in_slots(batches: Iterator[pa.RecordBatch], used: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = pa.array(np.flatnonzero(used[batch.column("slot").to_numpy()]))
        yield batch.select(["node", "set"]).take(rows)


def _wanted_sets(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the wanted nodes and of few others, from their texts again: most sets are never asked for, so they
    are not kept.  A filter of fixed size spares most other texts the work; the joins that follow drop the rest.
    """
    used = _used_slots(wanted)
    slotted = base.where("id IS NOT NULL").select("id", _slot("id"), "text")
    return slotted.mapInArrow(lambda b: _sets(b, np.unpackbits(used.value).astype(bool)), "node bigint, set binary")


def only_wanted(df: DataFrame, key: str, wanted: DataFrame, *, others: bool = False) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in the one column of ``wanted``, and few more, by a filter of fixed size; with
    ``others`` the rest."""
    used = _used_slots(wanted.toDF("node"))
    slotted = df.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(BITS)))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(used.value).astype(bool) != others
        for batch in batches:
            yield batch.filter(pa.array(bits[batch.column("slot").to_numpy()])).drop_columns(["slot"])

    return slotted.mapInArrow(some, df.schema)


def _end_pairs(postings: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a < b) of a node and the least or the greatest node of its tokens that share enough tokens as such to be linked."""
    lows = postings.select(F.col("low").alias("a"), F.col("node").alias("b"), F.lit(1).alias("as_low"), F.lit(0).alias("as_high"))
    highs = postings.select(F.col("node").alias("a"), F.col("high").alias("b"), F.lit(0).alias("as_low"), F.lit(1).alias("as_high"))
    ends = lows.union(highs).where("a != b").groupBy("a", "b").agg(F.greatest(F.sum("as_low"), F.sum("as_high")).alias("c"))
    x, y = sizes.toDF("a", "na"), sizes.toDF("b", "nb")
    may_link = f"na IS NULL OR nb IS NULL OR (4 * least(na, nb) >= 3 * greatest(na, nb) AND c >= {_needed('na', 'nb')})"
    return ends.join(x.hint("merge"), "a").join(y.hint("merge"), "b").where(may_link).select("a", "b")


def _picked_pairs(in_crowd: DataFrame, turn: int) -> DataFrame:
    """Pairs (a < b, some of them twice) of nodes of crowded tokens (token, node, n, tokens, label, size) and a few of other
    components, out of the largest component of the token first.

    Nodes with the most crowded ``tokens`` were changed least and are linked with most others, so they come first.
    """
    by_size = Window.partitionBy("token").orderBy(F.desc("size"), F.desc("tokens"), F.xxhash64("node"), "node")
    picked = in_crowd.withColumn("at", F.row_number().over(by_size)).where((F.col("at") <= PICKS * (turn + 1)) & (F.col("at") > PICKS * turn))
    picked = picked.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("to_label"))
    pairs = in_crowd.join(picked.hint("merge"), "token").where("label != to_label")
    pairs = pairs.groupBy(F.col("node").alias("a"), "b").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("na"), F.first("nb").alias("nb"))
    pairs = pairs.where("na IS NULL OR nb IS NULL OR 4 * least(na, nb) >= 3 * greatest(na, nb)")
    by_shared = Window.partitionBy("a").orderBy(F.desc("c"), "b")
    pairs = pairs.withColumn("at", F.row_number().over(by_shared)).where(F.col("at") <= PICKS)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _settle_crowds(crowd: DataFrame, base: DataFrame, links: DataFrame, pairs_before: float, most: int) -> tuple[DataFrame, DataFrame]:
    """More links, and the components of all, by comparing nodes of crowded tokens (token, node, n, tokens) with few others.

    A large group of near copies, each linked with a part of the others, is nearly one component after a few turns of
    comparisons in proportion to its nodes; the matrix would compare the rest of its nodes with all of that component.
    The first turn is over: there were ``pairs_before`` pairs of nodes of crowded tokens then.  Ends when there are
    ``most`` pairs of nodes of different components or fewer, too few to be worth a turn, or a turn changed little.
    """
    turn, settled = 1, components(links)
    while True:
        sizes = settled.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
        in_crowd = crowd.join(settled, "node", "left").withColumn("label", F.coalesce("label", "node")).join(sizes, "label", "left")
        in_crowd = written(in_crowd.select("token", "node", "n", "tokens", "label", F.coalesce("size", F.lit(1)).alias("size")), "crowd")
        of_token = in_crowd.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.sum("k").alias("k"), F.max("k").alias("top"))
        pairs_now = of_token.agg(F.sum(F.expr("cast(k AS double) * (k - top)"))).first()[0] or 0
        if pairs_now <= max(most, WORTH_A_TURN) or pairs_now > LEFT * pairs_before:
            drop(in_crowd)
            return links, settled
        pairs = written(_picked_pairs(in_crowd, turn).distinct(), "pairs")
        sets = written(_wanted_sets(base, pairs.select(F.explode(F.array("a", "b")).alias("node"))), "sets")
        more = written(links.union(_compare(pairs, sets)), "links")
        drop(pairs, sets, links, settled, in_crowd)
        turn, pairs_before, links, settled = turn + 1, pairs_now, more, components(more)


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    A document's set has its distinct five-word shingles (A-Z as a-z; fewer words are one shingle).  Documents are linked
    if 100 * intersection >= 75 * union; a component is named by its smallest id.  Null and empty texts and those without a
    word have no shingles and are linked with nothing.  Rows with one id are one document, linked if any of its texts is;
    rows without an id are linked with nothing and have no component.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))

    often = base.mapInArrow(_common, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= IN_ALL)
    often = often.orderBy(F.desc("n"), "token").limit(COMMON).collect()
    common = np.sort(np.array([r["token"] for r in often], np.int64).view(np.uint64))
    shared_common = spark.sparkContext.broadcast(common)
    signatures = base.mapInArrow(lambda b: _signatures(b, shared_common.value), "id bigint, n bigint, name binary, prefix array<bigint>")
    signatures = written(signatures, "signatures")

    named = signatures.where("name IS NOT NULL AND id IS NOT NULL")
    twins = named.groupBy("name").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    twins = written(twins.where("n > 1").select("name", "node"), "twins")
    nodes = named.select("id", "name").join(twins, "name", "left").select("id", "name", F.coalesce("node", "id").alias("node"))
    nodes = written(nodes.distinct(), "nodes")
    drop(twins)
    copies = nodes.where("id != node").select("id", "name")

    # An id with several texts may be a copy by one of them only; it keeps the tokens of the others.
    tokens = named.join(copies, ["id", "name"], "left_anti").select(F.col("id").alias("node"), F.explode("prefix").alias("token"))
    late = spark.createDataFrame([(int(t),) for t in common.view(np.int64)], "token bigint")
    rare = tokens.join(F.broadcast(late), "token", "left_anti")  # COMMON rows at most
    # One shuffle by token: the ends of a token, and after most tokens are gone, its nodes once each.
    of_token = Window.partitionBy("token")
    rare = rare.withColumn("low", F.min("node").over(of_token)).withColumn("high", F.max("node").over(of_token))
    rare = rare.withColumn("held", F.count(F.lit(1)).over(of_token)).where("low != high")
    rare = rare.groupBy("token", "node").agg(*[F.first(c).alias(c) for c in ("low", "high", "held")])
    many = tokens.join(F.broadcast(late), "token").distinct()
    ends = many.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("held"))
    many = many.join(F.broadcast(ends.where("low != high")), "token").select("token", "node", "low", "high", "held")
    postings = written(rare.union(many), "postings")

    # An id with several texts has no one size; nothing is concluded from it then.
    sizes = named.groupBy(F.col("id").alias("node")).agg(F.min("n").alias("n"), F.max("n").alias("most"))
    sizes = sizes.select("node", F.when(F.col("n") == F.col("most"), F.col("n")).alias("n"))
    shared = postings.select("node").distinct().join(sizes, "node")
    shared = written(shared, "nodes")
    held = postings.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.expr(f"if(held > {GROUP}, cast(held AS double), 0)")).alias("pairs")).first()
    most, crowded = PAIRS * held["rows"], (held["pairs"] or 0) > PAIRS * held["rows"]
    pairs = _end_pairs(postings, shared)
    if crowded:
        crowd = postings.where(F.col("held") > GROUP).select("token", "node")
        crowd = crowd.withColumn("tokens", F.count(F.lit(1)).over(Window.partitionBy("node")))
        crowd = written(crowd.join(shared.hint("merge"), "node"), "crowd")
        alone = crowd.withColumns({"label": F.col("node"), "size": F.lit(1)})
        pairs = pairs.union(_picked_pairs(alone, 0)).distinct()
    pairs = written(pairs, "pairs")
    sets = written(_wanted_sets(base, pairs.select(F.explode(F.array("a", "b")).alias("node"))), "sets")
    links = written(_compare(pairs, sets), "links")
    drop(pairs, sets)
    if crowded:
        links, settled = _settle_crowds(crowd, base, links, held["pairs"], most)
        drop(crowd)
    else:
        settled = components(links)

    sized = settled.join(settled.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "label")
    labels = shared.join(sized, "node", "left").withColumn("label", F.coalesce("label", "node")).withColumn("size", F.coalesce("size", F.lit(1)))
    labels = labels.withColumn("chunk", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / GROUP)))
    of_group = Window.partitionBy("label", "chunk")  # about GROUP nodes
    low, high = F.min(F.coalesce("n", F.lit(0))).over(of_group), F.max(F.coalesce("n", F.lit(LAST))).over(of_group)
    labels = written(labels.withColumns({"low": low, "high": high}), "groups")
    drop(shared, links)

    marked = postings.select("token", "node").join(labels.hint("merge"), "node")
    apart = marked.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("token")
    apart = written(apart, "tokens")
    marked = written(marked.join(apart.hint("merge"), "token", "left_semi"), "marked")
    drop(apart, postings)
    to = [F.col(c).alias(f"to_{c}") for c in ("label", "size", "chunk", "low", "high")]
    matrix = marked.select("token", *to).distinct()
    queries = marked.select("token", "node", "n", "label", "size").join(matrix.hint("merge"), "token")
    queries = queries.where("struct(size, label) < struct(to_size, to_label)")
    # Sizes alone rule out most groups, before anything is counted and shuffled.
    queries = queries.where("n IS NULL OR (4 * to_high >= 3 * n AND 3 * to_low <= 4 * n)")
    counts = [F.count(F.lit(1)).alias("c"), F.first("n").alias("n"), F.first("to_low").alias("low"), F.first("to_high").alias("high")]
    queries = queries.groupBy(F.col("node").alias("a"), F.col("to_label").alias("label"), F.col("to_chunk").alias("chunk")).agg(*counts)
    near = queries.withColumn("low", F.greatest("low", F.expr("(3 * n + 3) div 4"))).withColumn("high", F.least("high", F.expr("(4 * n) div 3")))
    bound = f"n IS NULL OR (low <= high AND c >= {_least_needed('n', 'low', 'high')})"
    queries = written(near.where(bound).select("a", F.col("n").alias("na"), "label", "chunk"), "queries")

    drop(marked)
    asked = labels.select("label", "chunk", "node", "n").join(queries.select("label", "chunk").distinct(), ["label", "chunk"], "left_semi")
    asked = written(asked, "asked")
    sets = written(_wanted_sets(base, asked.select("node").union(queries.select("a"))), "sets")
    halves = sets.mapInArrow(_halves, "node bigint, half binary")
    unions = asked.hint("merge").join(halves, "node").select("label", "chunk", "half").groupBy("label", "chunk").applyInArrow(_union, "label bigint, chunk bigint, union binary")
    asking = queries.hint("merge").join(halves.select(F.col("node").alias("a"), F.col("half").alias("x")), "a")
    asking = asking.join(unions.hint("merge"), ["label", "chunk"]).select("a", "na", "label", "chunk", "x", "union")
    opened = asking.mapInArrow(_open, "a bigint, na bigint, label bigint, chunk bigint")
    pairs = opened.join(asked.select("label", "chunk", F.col("node").alias("b"), F.col("n").alias("nb")), ["label", "chunk"])
    pairs = pairs.where("na IS NULL OR nb IS NULL OR 4 * least(na, nb) >= 3 * greatest(na, nb)")
    pairs = written(pairs.select("a", "b"), "pairs")
    # Of the sets, only those of pairs are moved; a filter of fixed size finds most others where they lie.
    used = _used_slots(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    wanted, sets = sets, sets.select("node", "set", _slot("node")).mapInArrow(lambda b: _in_slots(b, np.unpackbits(used.value).astype(bool)), "node bigint, set binary")
    more = written(_compare(pairs, sets), "links")
    drop(wanted, queries, asked, pairs, labels)

    # An id with several texts links their nodes.
    several = nodes.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a != most").select("id", "a")
    own = nodes.join(several.hint("merge"), "id").where("a != node").select("a", F.col("node").alias("b"))
    final = components(settled.select(F.col("label").alias("a"), F.col("node").alias("b")).union(more).union(own))
    drop(settled, more)
    out = nodes.join(final, "node", "left").groupBy("id").agg(F.min(F.coalesce("label", "node")).alias("component"))
    out = out.select(F.col("id").alias("of"), "component")
    return signatures.select("id", "n").join(out, F.col("id") == F.col("of"), "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
