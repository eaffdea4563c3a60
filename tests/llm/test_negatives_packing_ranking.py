"""Hard negatives, packing and ranked search against brute force, on odd inputs and by their registered queries."""

import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harborbook.llm import bpe, negatives, packing, queries, ranking

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows_of(sql):
    return duckdb.sql(sql).fetchall()


# --- hard negatives -----------------------------------------------------------------------------


def hard_negatives(rows, every=100, positives=5, count=5):
    """(anchor, positive, rank, negative, scores) of rows (id, vector, label), by comparing all."""
    first = {}
    for id, vector, label in rows:
        if id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        entry = (label, list(vector))
        first[id] = min(first.get(id, entry), entry)
    ints = {i: [math.floor(256 * float(x)) for x in v] for i, (_, v) in first.items()}
    out = []
    for a in first:
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(ints[a], v, strict=False)) for i, v in ints.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if first[i][0] == first[a][0]][:positives]:
            fit = [i for i in order if first[i][0] != first[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, r, n, score[p], score[n]) for r, n in enumerate(fit[:count], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1, 64, 150])
def test_scores_are_exact(size):
    rng = np.random.default_rng(size)
    for most in (1, 300, 60_000, 100_000_000):
        a, b = rng.integers(-most, most + 1, (7, size)), rng.integers(-most, most + 1, (9, size))
        want = a.astype(object) @ b.astype(object).T
        got = negatives.exact_scores(a, b, negatives.primes_for(size * most**2))
        assert (got.astype(object) == want).all()
    extreme = np.full((1, 64), 510)
    assert negatives.exact_scores(extreme, -extreme, negatives.primes_for(64 * 510**2))[0, 0] == -64 * 510**2


def test_hard_negatives_on_odd_rows(spark, monkeypatch):
    for name in ("ROWS", "ANCHORS", "AT_ONCE"):
        monkeypatch.setattr(negatives, name, 7)
    pick = random.Random(5)
    centre = [[pick.uniform(-1, 1) for _ in range(70)] for _ in range(3)]
    rows = []
    for i in range(-20, 400):
        near = [x + pick.uniform(-0.4, 0.4) for x in centre[pick.randrange(3)]]
        rows.append((i, near, pick.randrange(4)))
    rows += [(400 + i, centre[0], i % 2) for i in range(40)]  # ties
    rows += [(7, centre[1], 3), (8, rows[28][1], rows[28][2])]  # ids that are there twice
    rows += [(900, [float("nan")] * 70, 1), (901, [None] * 70, 1), (902, None, 1), (903, centre[0], None), (904, [float("inf")], 1)]
    rows += [(None, centre[0], 1), (1000, [], 2), (1100, centre[2][:3], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(5)
    clash = df.select("*", F.lit(1).alias("id"), F.lit("x").alias("score"), F.lit(0).alias("rank"), F.lit(2).alias("anchor"))
    got = listed(negatives.mine_hard_negatives(clash, F.col("vec_id") % 10 == 0))
    assert got == hard_negatives(rows, 10)
    assert negatives.mine_hard_negatives(clash.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    large = spark.createDataFrame([(1, [1e9], 1)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(ValueError, match="64 bits"):
        negatives.mine_hard_negatives(large, F.lit(True))


def test_hard_negatives_meet_without_broadcast(spark):
    """The block join that large tables take gives the rows of the broadcast one."""
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    plain = listed(negatives.mine_hard_negatives(df, F.col("vec_id") % 100 == 0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = negatives.mine_hard_negatives(df, F.col("vec_id") % 100 == 0)
        assert listed(out) == plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_op11_equals_brute_force(spark):
    given = rows_of(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet'")
    moved = [(i, v, (x + 1) % 10 if x is not None and i % 7 == 0 else x) for i, v, x in given]
    want = hard_negatives(moved)
    assert want and listed(queries.op11_hard_negatives(spark, SF)) == want


# --- packing ------------------------------------------------------------------------------------


def ids_of(texts):
    known = Tokenizer.from_file(TOKENIZER)
    return [[*known.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def check_pieces(pieces, wanted, capacity):
    """Every id is in one piece, offsets have no gaps, and padding is only what a power of two spares."""
    docs, sequences = {}, {}
    for doc, start, length, ids, total, sequence, offset in pieces:
        assert length == len(ids) > 0
        docs.setdefault(doc, []).append((start, ids, total))
        sequences.setdefault(sequence, []).append((offset, length))
    assert docs.keys() == wanted.keys()
    for doc, parts in docs.items():
        whole = [x for _, ids, _ in sorted(parts) for x in ids]
        assert whole == wanted[doc] and {t for _, _, t in parts} == {len(whole)}
        starts = sorted((s, len(ids)) for s, ids, _ in parts)
        assert [s for s, _ in starts] == np.cumsum([0, *[n for _, n in starts]])[:-1].tolist()
    for parts in sequences.values():
        parts.sort()
        ends = np.cumsum([0, *[n for _, n in parts]]).tolist()
        assert [o for o, _ in parts] == ends[:-1] and ends[-1] <= capacity
    return [sum(n for _, n in p) for p in sequences.values()]


def test_encoder_gives_the_ids_of_the_library(monkeypatch):
    monkeypatch.setattr(bpe, "PART", 50)
    rng = random.Random(3)
    texts = ["".join(rng.choices("  \n\t'stmdrevlaAé1٣!?.\x1c\x85　🙂½ ab", k=rng.randrange(400))) for _ in range(300)]
    texts += ["a <|endoftext|> b", "", "x" * 5000, " \n " * 500, "don't " * 400, "日本語" * 300]
    with open(TOKENIZER, encoding="utf-8") as f:
        encode = packing.Encoder(f.read())
    assert encode.by_word
    monkeypatch.setattr(packing, "TOGETHER", 700)
    monkeypatch.setattr(packing, "REMEMBERED", 30)
    for text, ids, want in zip(texts, encode(texts), ids_of(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want[:-1]
        assert "".join(bpe.parts(text)) == text
    assert len(encode.known) <= 30


def test_packing_on_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGED", 1)
    rng = random.Random(1)
    texts = ["".join(rng.choices("abc de", k=rng.choice([0, 3, 40, 900, 6000]))) for _ in range(300)]
    texts += [None, "", texts[0], texts[0], "word " * 20_000]
    df = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(13)
    clash = df.select("*", F.lit(1).alias("doc"), F.lit(2).alias("ids"), F.lit(3).alias("start"), F.lit(4).alias("open"))
    wanted = {f"n{i}": x for i, x in enumerate(ids_of(texts))}
    for capacity, spare in ((64, 0), (1024, 4)):
        out = packing.pack(clash, TOKENIZER, capacity=capacity, spare=spare).collect()
        pieces = [(*r[:3], np.frombuffer(r["ids"], "<u4").tolist(), *r[4:]) for r in out]
        lengths = check_pieces(pieces, wanted, capacity)
        assert all(capacity - spare <= n or n & (n - 1) == 0 for n in lengths)
        assert sum(n < capacity - spare for n in lengths) <= 10
    assert packing.pack(clash.limit(0), TOKENIZER).count() == 0


def test_rows_with_equal_or_no_ids_are_documents_of_their_own(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id bigint, text string")
    out = packing.pack(df, TOKENIZER).collect()
    assert sorted(r["doc_tokens"] for r in out if r["start"] == 0) == [1, 2, 3, 3]


def test_slots_fill_sequences():
    assert packing.slots(1024) == {1 << k: 1024 >> k for k in range(10, -1, -1)}
    for spare in (0, 3):
        sizes = packing.slots(1000, spare)
        assert all(1000 - s * j <= spare and s * (j + 1) > 1000 for s, j in sizes.items())
        assert all(sum(packing.cuts(n, list(sizes))) == n for n in range(1, 2500))


def test_op12_holds_the_documents(spark):
    given = rows_of(f"SELECT doc_id, text FROM '{SF}/documents.parquet'")
    wanted = dict(zip([d for d, _ in given], ids_of([t for _, t in given]), strict=True))
    out = queries.op12_packing(spark, SF).collect()
    pieces = []
    for r in out:
        ids = wanted[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        pieces.append((r["doc_id"], r["start"], r["length"], ids, r["doc_tokens"], r["sequence_id"], r["offset"]))
    lengths = check_pieces(pieces, wanted, 1024)
    assert all(n == 1024 or n & (n - 1) == 0 for n in lengths)


# --- ranked search ------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(FOLD))


def ranked(docs, items, most=50):
    """(item, rank, document, score) by scoring every document for every item."""
    counts = []
    for id, text in docs:
        found = terms_of(text)
        counts.append((id, len(found), {t: found.count(t) for t in set(found)} if len(found) < 5000 else dict(ranking.Counter(found))))
    n_docs, total = sum(n > 0 for _, n, _ in counts), sum(n for _, n, _ in counts)
    holding = ranking.Counter(t for _, _, c in counts for t in c)
    asked = {}
    for id, text in items:
        asked.setdefault(id, set()).update(terms_of(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for id, n, c in counts:
            if n:
                m = 100 - 50 + (50 * n * n_docs) // total
                weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) for t in terms & c.keys()}
                score = sum(w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weights.items())
                if score > 0:
                    scores.append((-score, id is None, id or 0))
        out += [(item, r, None if unnamed else id, -s) for r, (s, unnamed, id) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=repr)


def test_terms_are_those_of_the_pattern(monkeypatch):
    monkeypatch.setattr(ranking, "AT_ONCE", 20)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices("abZ09é_-. \n\t@[`{\x7f\x80ß\x1c　", k=rng.randrange(200)))
        assert {t.decode(): n for t, n in ranking.count_terms(text).items()} == dict(ranking.Counter(terms_of(text)))
    assert not ranking.count_terms(None)


@pytest.mark.parametrize("postings,first", [(2_000_000, 128), (40, 2), (1, 1)])
def test_ranking_on_odd_texts(spark, monkeypatch, postings, first):
    monkeypatch.setattr(ranking, "POSTINGS", postings)
    monkeypatch.setattr(ranking, "FIRST", first)
    monkeypatch.setattr(ranking, "PAIRS", 60)
    rng = random.Random(7)
    word = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(word, weights, k=rng.randrange(1, 40)))) for i in range(250)]
    docs += [(300 + i, docs[0][1]) for i in range(30)] + [(None, docs[0][1]), (None, docs[0][1]), (5, docs[1][1]), (5, docs[1][1])]
    docs += [(400, None), (401, ""), (402, " .,- "), (403, "W1 w2 " * 3000)]
    items = [(i, " ".join(rng.choices(word, k=rng.randrange(1, 9)))) for i in range(12)]
    items += [(20, ""), (21, None), (None, "w1 w3"), (None, "w4"), (1, "w5 w6 W7"), (22, "unseen"), (23, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)
    df = df.select("*", F.lit(1).alias("id"), F.lit(2).alias("n"), F.lit("x").alias("terms"), F.lit(3).alias("score"))
    asked = spark.createDataFrame(items, "item_id bigint, text string").select("*", F.lit(1).alias("id"))
    most = 3 if first == 2 else 50
    assert listed(ranking.rank_documents(df, asked, most=most)) == ranked(docs, items, most)
    assert ranking.rank_documents(df.limit(0), asked).count() == 0
    assert ranking.rank_documents(df, asked.limit(0)).count() == 0


def test_op13_equals_brute_force(spark):
    docs = rows_of(f"SELECT doc_id, text FROM '{SF}/documents.parquet'")
    items = rows_of(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'")
    assert listed(queries.op13_ranked_search(spark, SF)) == ranked(docs, items)
