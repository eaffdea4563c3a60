"""Each operator against brute force on small odd inputs: nulls, empty and long texts, ties, repeats, clashing columns."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from harborbook.llm import bpe, components, contamination, jaccard, language, licenses, lines, quality, queries, shards, sketches, suffixes
from harborbook.llm.tables import written

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def prose(seed, count):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeéß", k=rng.randrange(2, 8))) for _ in range(count))


BASE = prose(1, 120)
TEXTS = [
    (1, BASE),
    (2, BASE),  # a copy
    (3, BASE + " " + prose(2, 8)),  # nearly one
    (4, prose(3, 30) + "\n" + prose(4, 60) + "\n" + prose(5, 10)),
    (5, prose(6, 9) + "\n" + prose(4, 60) + "\n\n" + prose(7, 5)),
    (6, ""),
    (7, None),
    (8, " \t\n "),
    (9, "ab ab ab " * 200),
    (10, "one two"),
    (11, "One  TWO"),
    (12, prose(8, 4000)),
    (13, "Hello world's 12345!!  \n\n x y"),
    (14, "Some text.\nReleased under the MIT License."),
    (None, prose(9, 40)),
    (None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    """The texts beside columns whose names the operators use themselves."""
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    return df.select("*", F.lit("x").alias("score"), F.lit("y").alias("ids"), F.lit(1).alias("_id"), F.lit(2).alias("id"), F.lit(3).alias("n_runs")).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_bpe_equals_tiktoken_and_round_trips(docs, empty, monkeypatch):
    tokens, pattern = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
    known = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    out = bpe.decode(bpe.encode(docs, tokens, pattern), tokens, pattern)
    rows = out.collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        assert np.frombuffer(row["ids"], "<u4").tolist() == known.encode_ordinary(row["text"] or "")
        assert row["n_tokens"] * 4 == len(row["ids"])
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
    both = bpe.round_trip(docs, tokens, pattern)
    assert both.columns == out.columns
    assert sorted(map(tuple, both.collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    assert bpe.encode(empty, tokens, pattern).count() == 0 == bpe.round_trip(empty, tokens, pattern).count()
    # Long texts are worked on in parts.
    engine = bpe.Engine(bpe.Merges(tokens), pattern)
    for size in (1, 40, 700):
        monkeypatch.setattr(bpe, "PART", size)
        monkeypatch.setattr(bpe, "TOGETHER", 2 * size)
        texts = [r["text"] or "" for r in rows]
        ids, counts = engine.encode(texts)
        ends = np.cumsum(counts)[:-1]
        assert [x.tolist() for x in np.split(ids, ends)] == [known.encode_ordinary(t) for t in texts]
        body, lengths = engine.decode(ids, counts)
        assert [x.tobytes() for x in np.split(body, np.cumsum(lengths)[:-1])] == [t.encode() for t in texts]
    # Partitions of empty texts alone.
    blank = bpe.decode(bpe.encode(docs.where("text IS NULL OR text = ''").repartition(4), tokens, pattern), tokens, pattern)
    assert [(r["n_tokens"], bytes(r["decoded"])) for r in blank.collect()] == [(0, b"")] * 3


def test_word_starts_follow_the_pattern():
    pattern = bpe.regex.compile(bpe.CLASS_PATTERN)
    rng = random.Random(3)
    texts = ["".join(rng.choices("  \n\t'stmdrevlaAé1٣!?.\x1c\x85　🙂½", k=rng.randrange(30))) for _ in range(3000)]
    whole, bounds = "".join(texts), np.cumsum([0, *map(len, texts)])
    found, before = bpe.class_starts(whole, bounds)
    for i, text in enumerate(texts):
        assert (found[before[i] : before[i + 1]] - bounds[i]).tolist() == [m.start() for m in pattern.finditer(text)]


def test_sketches(docs, empty):
    out = by_id(docs.select("doc_id", "text", sketches.sketch(F.col("text")).alias("s")))
    for row in out.values():
        assert len(row["s"]) == min(sketches.SIZE, len(shingles(row["text"])))
        assert row["s"] == sorted(row["s"])
    assert out[1]["s"] == out[2]["s"] and out[10]["s"] == out[11]["s"]
    parts = docs.select(F.lit(1).alias("k"), sketches.sketch(F.col("text")).alias("s"))
    every = set().union(*[set(r["s"]) for r in parts.collect()])
    assert sketches.merge_sketches(parts, "k", "s").first()["s"] == sorted(every)[: sketches.SIZE]
    assert sketches.merge_sketches(parts.limit(0), "k", "s").count() == 0


def test_next_row_in_order(spark, monkeypatch):
    monkeypatch.setattr(sketches, "BLOCK", 3)
    rows = [(i * i, f"t{i}") for i in range(40)]
    out = sketches.with_next(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", ["text"], "next").collect()
    after = {rows[k][0]: rows[k - 1][1] for k in range(40)}
    assert {r["doc_id"]: r["next"]["text"] for r in out} == after


def test_fingerprints_keep_256_hashes_and_move_texts_only(spark, monkeypatch):
    monkeypatch.setattr(sketches, "BLOCK", 3)
    rows = [(i, prose(i, 240)) for i in range(20)]
    given = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = sketches.with_next(given, "doc_id", "text", ["fp"], "next", behind={"fp": sketches.sketch(F.col("text"))})
    found = {r["doc_id"]: r for r in out.select("*", sketches.distinct_shingles(F.col("fp")).alias("n")).collect()}
    assert all(found[i]["n"] == len(shingles(t)) > 192 for i, t in rows)  # exact
    assert all(found[i]["next"]["fp"] == found[(i - 1) % 20]["fp"] for i in found)
    moved = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in moved and "sort_array" not in moved[moved.index("RepartitionByExpression") :]
    executed = out._jdf.queryExecution().executedPlan().toString()
    assert executed.count("hashpartitioning(_to") == 1


def test_suffix_dedup(docs, empty):
    out = by_id(suffixes.remove_repeats(docs))
    seen = set()
    for i, text in sorted((i, t) for i, t in TEXTS if i is not None and t is not None):
        raw = text.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        assert bytes(out[i]["kept"]) == bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        assert out[i]["n_spans"] == sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
    assert out[7]["n_bytes"] == 0 and suffixes.remove_repeats(empty).count() == 0


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(5)
    runs, every = [], []
    for _ in range(7):
        strings = sorted(bytes(rng.choices(b"ab", k=rng.randrange(1, 8))) for _ in range(rng.randrange(0, 30)))
        common = [0] + [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(strings, strings[1:], strict=False)]
        runs.append((common[: len(strings)], [s[c:] for s, c in zip(strings, common, strict=False)]))
        every.append(strings)
    run, at, share = suffixes.merge_runs(runs)
    merged = [every[r][k] for r, k in zip(run, at, strict=True)]
    assert merged == sorted(s for strings in every for s in strings)
    for a, b, n in zip(merged, merged[1:], share[1:], strict=False):
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_contamination_with_replaced_words(spark, docs, empty):
    item = prose(4, 60).split(" ")
    changed = [w if k % 6 else "zzz" for k, w in enumerate(item)]
    bench = spark.createDataFrame([(1, " ".join(changed)), (2, prose(77, 40)), (3, None), (4, ""), (5, "one two")], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in contamination.contaminated(docs, bench).collect()}
    assert found == {(4, 1), (5, 1), (10, 5), (11, 5)}
    assert contamination.contaminated(empty, bench).count() == 0
    assert contamination.contaminated(docs, bench.limit(0)).count() == 0


def passages(docs, items):
    """(document, item) pairs that share a passage, by comparing all alignments."""
    number = {}
    coded = [(i, np.array([number.setdefault(w, len(number)) for w in words(t)])) for i, t in docs]
    out = set()
    for item, text in items:
        b = np.array([number.setdefault(w, len(number)) for w in words(text)])
        if not len(b):
            continue
        size = min(20, len(b))
        least = size if len(b) < 8 else -(-size * 4 // 5)
        for doc, a in coded:
            padded = np.concatenate([np.full(len(b), -1), a, np.full(len(b), -1)])
            beside = np.lib.stride_tricks.sliding_window_view(padded, len(b))
            same, inside = (np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1) for x in (beside == b, beside >= 0))
            full = (inside[:, size:] - inside[:, :-size]) == size
            if (full & (same[:, size:] - same[:, :-size] >= least)).any():
                out.add((doc, item))
    return out


def test_items_without_id_or_of_few_words_are_found(spark):
    a, b = prose(90, 30), prose(91, 12)
    given = [(1, prose(92, 50) + " " + a + " " + prose(93, 9)), (2, b), (None, "x " + b), (4, "yes it is so"), (5, "yes it was so"), (6, "no")]
    items = [(None, a), (None, b), (7, "Yes it is"), (7, "no"), (8, "never"), (9, a + " " + prose(94, 3))]
    found = contamination.contaminated(spark.createDataFrame(given, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    got = sorted(((r["doc_id"], r["item_id"]) for r in found.collect()), key=repr)
    assert got == sorted(passages(given, items), key=repr)
    assert {(1, None), (2, None), (None, None), (4, 7), (6, 7), (1, 9)} == set(got)
    named = spark.createDataFrame([("n1", given[0][1])], "doc_id string, text string")
    assert [r["doc_id"] for r in contamination.contaminated(named, spark.createDataFrame([("i", a)], "item_id string, text string")).collect()] == ["n1"]


def test_op4_equals_all_alignments(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {(r["doc_id"], r["item_id"]) for r in queries.op4_benchmark_decontamination(spark, SF).collect()}
    assert found == passages(docs, items) and found


def test_masks_miss_no_allowed_replacement():
    from itertools import combinations

    masks = [[k for k, c in enumerate(m) if c == "1"] for m in contamination.MASKS]
    for size in range(contamination.LEAST, contamination.WINDOW + 1):
        wrong = size - int(np.ceil(contamination.SAME * size - 1e-9))
        for bad in combinations(range(size), wrong):
            assert any(not {o + k for k in m} & set(bad) for m in masks for o in range(size - m[-1]))


def test_shards(docs, spark, empty):
    out = shards.balanced_shards(docs, 4).collect()
    assert len(out) == len(TEXTS)
    rows = {k: [r for r in out if r["shard"] == k] for k in range(4)}
    assert {len(v) for v in rows.values()} == {4}
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in rows.values())
    for r in out:
        if r["doc_id"] is not None:
            raw = (dict(TEXTS)[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    assert shards.balanced_shards(empty, 4).count() == 0
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 150).cast("string")).alias("text"))
    placed = shards.balanced_shards(many, 8).groupBy("shard").count().collect()
    assert {r["count"] for r in placed} == {50}


def test_license_notices(docs, empty):
    assert [(r["doc_id"], r["license"]) for r in licenses.license_notices(docs).collect()] == [(14, "MIT")]
    assert licenses.license_notices(empty).count() == 0
    with pytest.raises(Exception, match="allowed"):
        licenses._Templates({"x": "w " * (licenses.MOST_WORDS + 1)})


def test_groups_that_fit_stay_whole(spark):
    sizes = {"a": 300, "b": 95, "c": 60, "d": 40, "e": 30, "f": 100, "g": 26}  # shards of 100
    lay = [t for t, n in sizes.items() for _ in range(n)]
    lay += [f"{t} alone" for t in range(800 - len(lay))]
    docs = spark.createDataFrame(list(enumerate(lay)), "doc_id bigint, text string")
    out = shards.balanced_shards(docs, 8).collect()
    assert len(out) == 800 and {(r["shard"], r["slot"]) for r in out} == {(k, i) for k in range(8) for i in range(100)}
    where = {}
    for r in out:
        where.setdefault(lay[r["doc_id"]], set()).add(r["shard"])
    assert {t: len(where[t]) for t in sizes} == {t: 3 if t == "a" else 1 for t in sizes}
    room = [10, 10, 10]
    assert shards._laid_out([(b"x", 6), (b"y", 6), (b"z", 6), (b"v", 12)], room) == [(b"v", [0, 1], [10, 12]), (b"x", [1], [6]), (b"y", [2], [6]), (b"z", [2, 1], [4, 6])]
    assert room == [0, 0, 0]


def test_retrieved_licenses_are_those_of_exact_containment(spark):
    """Templates that share passages, whole, cut, scattered and mixed in long texts, against sets of all shingles."""
    pick = random.Random(11)

    def words(n):
        return [f"w{pick.randrange(400)}" for _ in range(n)]

    shared = words(30)
    known = {f"t{k}": words(n) for k, n in enumerate((5, 6, 9, 17, 40, 200, 900))}
    known |= {"a": words(20) + shared, "b": shared + words(5), "c": shared}
    texts = [[]]
    for name in list(known) * 12:
        body = known[name]
        cut = body[: max(5, int(len(body) * pick.choice((0.6, 0.75, 0.8, 0.9, 1))))]
        at = pick.randrange(len(cut) + 1)
        texts.append(words(pick.randrange(60)) + cut[:at] + pick.choice(([], words(1), words(40))) + cut[at:] + words(pick.randrange(60)))
    texts.append([w for body in known.values() for w in [*words(20), *body]])

    def shingles(body):
        return {tuple(body[k : k + 5]) for k in range(len(body) - 4)}

    want = {}
    for doc, body in enumerate(texts):
        for name, template in known.items():
            both, whole = shingles(body) & shingles(template), shingles(template)
            if len(both) >= 0.75 * len(whole):
                want[doc, name] = round(len(both) / len(whole), 9)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    found = licenses.license_notices(docs, {n: " ".join(t) for n, t in known.items()}).collect()
    assert {(r["doc_id"], r["license"]): round(r["containment"], 9) for r in found} == want
    assert len(found) == len(want) > 60
    assert licenses.license_notices(docs, {}).count() == 0


def test_a_band_names_the_templates_of_a_minimum():
    band = licenses._Band(np.array([7, 3, 7, 9], np.uint64), np.array([0, 0, 1, 2]))
    where, template = band.retrieve(np.array([9, 1, 7, 3], np.uint64))
    assert sorted(zip(where.tolist(), template.tolist(), strict=True)) == [(0, 2), (2, 0), (2, 1), (3, 0)]
    assert band.retrieve(np.array([8], np.uint64))[0].size == 0


def test_licenses_in_their_usual_forms(spark):
    known = licenses.catalogue()
    header = """
/*
 * Copyright 2020 Somebody
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 */"""
    given = [
        (1, header, "Apache-2.0"),
        (2, "It is released under the MIT License, see there", "MIT"),
        (3, "# This program is licensed under\n# the “MIT License”.", "MIT"),
        (4, prose(71, 40), None),
        *((k + 10, prose(k, 30) + "\n" + text.replace("\n", "\n// ") + "\n" + prose(k + 90, 30), name) for k, (name, texts) in enumerate(sorted(known.items())) for text in texts[-1:]),
    ]
    out = licenses.license_notices(spark.createDataFrame([g[:2] for g in given], "doc_id bigint, text string")).collect()
    found = {(r["doc_id"], r["license"]): r for r in out}
    assert len(found) == len(out)  # one variant of each
    assert {i for i, _, name in given if name is not None and (i, name) not in found} == set()
    assert all(i != 4 for i, _ in found)
    assert {"Apache-2.0-text", "GPL-3.0-text", "LGPL-2.1-text", "BSD-2-Clause-text", "MPL-2.0-text", "MIT-text"} <= {name for _, name in found}
    assert [found[1, "Apache-2.0"][c] for c in ("first_word", "end_word")] == [7, 14]  # words of the text, signs too
    disclaimer = known["MIT-text"][-1]
    assert found[10 + sorted(known).index("MIT-text"), "MIT-text"]["containment"] == 1 and "NONINFRINGEMENT" in disclaimer


def test_quality(spark, docs, empty):
    good = [(i, prose(i, 40) + ".", 1) for i in range(300)]
    bad = [(i + 300, " ".join(w + "###" for w in prose(i, 40).split()), 0) for i in range(300)]
    rows = spark.createDataFrame(good + bad, "doc_id bigint, text string, quality int")
    model = quality.learn(rows.drop("quality"), rows.select("doc_id", "quality"))
    scored = quality.score_quality(rows, model).collect()
    assert sum((r["score"] >= 0.7) == bool(r["quality"]) for r in scored) > 590
    out = quality.score_quality(docs, model)
    assert out.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    nothing = quality.learn(empty, rows.select("doc_id", "quality").limit(0))
    assert 0 <= quality.score_quality(docs, nothing).first()["score"] <= 1


def test_line_runs(docs, empty):
    out = by_id(lines.delete_repeated_runs(docs))
    given = dict(TEXTS)
    assert out[5]["text"] == "\n".join([prose(6, 9), "", prose(7, 5)]) and out[5]["n_deleted"] == 1
    assert out[2]["text"] == "" and out[1]["text"] == BASE
    for i in (3, 4, 6, 7, 8, 9, 10, 12, 13):
        assert out[i]["text"] == given[i] and out[i]["n_runs"] == 0
    assert lines.delete_repeated_runs(empty).count() == 0


def test_repeated_rows_are_one_document_to_line_dedup(spark):
    long, short = prose(41, 60), prose(42, 30)
    lay = [
        (1, prose(43, 9) + "\n" + long),  # whole twice, beside a copy of its passage
        (1, prose(43, 9) + "\n" + long),
        (2, prose(44, 9) + "\n" + long + "\n" + prose(45, 9)),
        (3, short + "\n" + prose(46, 70)),  # two that are there twice and share 30 words only
        (3, short + "\n" + prose(46, 70)),
        (4, short + "\n" + prose(47, 70)),
        (4, short + "\n" + prose(47, 70)),
        (None, long),
        (None, long),
    ]
    out = lines.delete_repeated_runs(spark.createDataFrame(lay, "doc_id bigint, text string")).collect()
    expected = [t if i in (1, 3, 4) else prose(44, 9) + "\n" + prose(45, 9) if i == 2 else "" for i, t in lay]
    assert sorted((r["doc_id"] or 9, r["text"]) for r in out) == sorted((i or 9, t) for (i, _), t in zip(lay, expected, strict=True))


def test_language(spark, docs, empty):
    a = [(i, "the of and that with this " * (1 + i % 3) + prose(i, 3), "en") for i in range(80)]
    b = [(i + 100, "der die das und nicht ein " * (1 + i % 3) + prose(i, 3), "de") for i in range(80)]
    rows = spark.createDataFrame(a + b, "doc_id bigint, text string, lang string")
    known = language.learn_dictionaries(rows)
    assert set(known) == {"en", "de"}
    out = language.predict_language(rows, known).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) > 155
    odd = by_id(language.predict_language(docs, known))
    assert all(odd[i]["lang_pred"] == "und" for i in (6, 7, 8)) and odd[10]["lang_pred"] in known
    assert language.predict_language(empty, known).count() == 0
    assert {r["lang_pred"] for r in language.predict_language(docs, {}).collect()} == {"und"}


def test_jaccard_components(docs, empty):
    out = by_id(jaccard.jaccard_components(docs))
    sets = {i: shingles(t) for i, t in TEXTS if i is not None}
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    assert {i: (out[i]["n_shingles"], out[i]["component_id"]) for i in sets} == {i: (len(s), label[i]) for i, s in sets.items()}
    assert label[3] == 1 and label[11] == 10
    assert jaccard.jaccard_components(empty).count() == 0


def test_ids_with_several_texts_link_all_of_them(spark):
    a, b, c, d = (prose(k, 60) for k in (61, 62, 63, 64))
    rows = [(3, a), (5, a), (5, b), (9, b + " " + prose(65, 4)), (13, c), (15, c), (15, d), (19, d), (20, prose(66, 50))]
    rows += [(21, prose(67, 60)), (22, prose(68, 60)), (23, prose(67, 60)), (23, prose(68, 60)), (23, None)]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(out) == len(rows)
    found = {(r["doc_id"], r["component_id"]) for r in out}
    assert found == {(3, 3), (5, 3), (9, 3), (13, 13), (15, 13), (19, 13), (20, 20), (21, 21), (22, 21), (23, 21)}


def test_group_bound_holds_for_every_size_in_the_range(spark):
    sizes = spark.range(1, 121).selectExpr("id AS n", "explode(sequence((3 * id + 3) div 4, (4 * id) div 3)) AS low")
    ranges = sizes.selectExpr("n", "low", "explode(sequence(low, (4 * n) div 3)) AS high")
    every = F.array_min(F.expr(f"transform(sequence(low, high), m -> {jaccard._needed('n', 'm')})"))
    both = ranges.withColumn("bound", F.expr(jaccard._least_needed("n", "low", "high"))).withColumn("least", every)
    assert both.where("bound != least").isEmpty() and both.where(f"least < least({jaccard._needed('n', 'low')}, {jaccard._needed('n', 'high')})").count() > 677


def test_empty_sets_are_linked_with_nothing():
    one, none = np.array([1 << 40, 1 << 41], np.uint64).tobytes(), b""
    columns = {"a": [1, 2, 3], "b": [4, 5, 6], "x": [one, none, none], "y": [one, none, one]}
    pairs = pa.RecordBatch.from_pydict(columns, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("x", pa.binary()), ("y", pa.binary())]))
    assert [b.to_pydict() for b in jaccard._linked([pairs])] == [{"a": [1], "b": [4]}]


def test_large_groups_of_near_copies_are_not_compared_pair_by_pair(spark, monkeypatch):
    rng = random.Random(5)
    base = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(150)]
    rows = []
    for k in range(300):  # three changes: linked only with the few that have one; two of them are not linked
        words = list(base)
        for at in rng.sample(range(150), rng.choices((1, 2, 3), (1, 7, 12))[0]):
            words[at] = f"w{k}x{at}"
        rows.append((k, " ".join(words)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    expected = list(range(len(rows)))
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while any(expected[a] != expected[b] for a, b in pairs):
        for a, b in pairs:
            expected[a] = expected[b] = min(expected[a], expected[b])
    compared = []

    def count_pairs(df, name):
        out = written(df, name)
        compared.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(jaccard, "written", count_pairs)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert [out[k] for k in range(len(rows))] == expected
    assert len(pairs) > 10 * len(rows) and sum(compared) < 25 * len(rows)


def test_components_of_links_dealt_over_tasks(spark):
    rng = random.Random(7)
    links = [(a, a + 3) for a in range(0, 300, 3)] + [(rng.randrange(301, 700), rng.randrange(301, 700)) for _ in range(250)] + [(-5, 900), (900, 901), (7, 7)]
    rng.shuffle(links)
    expected = {x: x for a, b in links if a != b for x in (a, b)}
    while any(expected[a] != expected[b] for a, b in links if a != b):
        for a, b in links:
            if a != b:
                expected[a] = expected[b] = min(expected[a], expected[b])
    df = spark.createDataFrame([*links, *links[:50], *[(b, a) for a, b in links[:50]], (None, 3), (3, None)], "a bigint, b bigint").repartition(9)
    out = components.components(df).collect()
    assert len(out) == len(expected) and {r["node"]: r["label"] for r in out} == expected
    assert components.components(df.where("a = b")).count() == 0


def test_large_groups_of_near_copies_take_few_jobs(spark, monkeypatch):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefgh", k=7)) for _ in range(150)]
    rows = []
    for k in range(300):
        words = list(base)
        for at in rng.sample(range(150), rng.choices((1, 2, 3), (1, 7, 12))[0]):
            words[at] = f"w{k}x{at}"
        rows.append((k, " ".join(words)))
    tables = []

    def count_tables(df, name):
        tables.append(name)
        return written(df, name)

    monkeypatch.setattr(jaccard, "written", count_tables)
    monkeypatch.setattr(components, "written", count_tables)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = {r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert len(out) < 30
    assert len(tables) <= 30 and tables.count("sets") == 2, tables
