"""The pipeline over the smallest tables, stage by stage."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harborbook.llm.queries import table
from harborbook.llm.tables import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        after = docs.count()
        assert 0 < after <= before
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == before
    assert out.where("length(ids) != 4 * n_tokens").isEmpty()


def prose(seed, count):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(count))


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_one_of_a_group_stays_whatever_its_id(spark):
    a, b, c, d = (prose(k, 60) for k in (1, 2, 3, 4))
    given = [(1, a), (1, a), (2, a + " more"), (None, a), (None, b), (None, b), (None, b + " more"), (3, c), (4, c), (4, d), (None, None), (5, "")]
    docs = spark.createDataFrame(given, "doc_id bigint, text string").withColumn("n_chars", F.length("text"))
    out = corpus_pipeline.keep_one_of_group(spark, docs, SF)
    assert out.columns == docs.columns
    left = rows_of(out)
    assert [r for r in left if r not in [(None, b), (None, b + " more")]] == sorted([(1, a), (3, c), (4, d), (None, None), (5, "")], key=repr)
    assert len(left) == 6


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def alike(a, b):
    return bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """The smallest tables with exact and near copies of documents of several lines, and of null and empty texts."""
    folder = tmp_path_factory.mktemp("copies")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    long = [r for r in rows if (r["text"] or "").count("\n") >= 3 and len(r["text"].split()) >= 150]
    assert len(long) >= 10
    rng, more = random.Random(8), []
    for k, r in enumerate(long):
        lines = r["text"].split("\n")
        for n in range(1 + k % 3):
            changed = list(lines)
            at = rng.randrange(len(lines))
            changed[at] += f" changed {n}"
            for text in (r["text"], "\n".join(changed)):
                more.append({**r, "doc_id": 10_000_000 + len(more), "text": text, "n_chars": len(text)})
    more += [{**rows[0], "doc_id": 20_000_000 + k, "text": t, "n_chars": 0} for k, t in enumerate([None, "", "", None])]
    spark.createDataFrame(rows + more, docs.schema).repartition(5).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder), {r["doc_id"]: r["text"] for r in rows + more}


def test_copies_go_on_their_way_through_all_stages(spark, copied):
    folder, given = copied
    docs = table(spark, folder, "documents")
    good = corpus_pipeline.keep_good(spark, docs, folder)
    cut = written(corpus_pipeline.cut_repeated_lines(spark, good, folder), "cut")
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    # Only what was empty before is empty now.
    assert all((texts[i] or "").split() or not (given[i] or "").split() for i in texts)
    sets = {i: shingles(given[i]) for i in texts}
    label = {i: i for i in texts}
    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if label[a] != label[b] and alike(sets[a], sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {i: low if n == high else n for i, n in label.items()}
    one = written(corpus_pipeline.keep_one_of_group(spark, cut, folder), "one")
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(label.values()))
    assert {r["doc_id"]: r["text"] for r in one.collect()} == {i: texts[i] for i in set(label.values())}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, one, folder).collect()}
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} == kept
    planted = [i for i in kept if 10_000_000 <= i < 20_000_000]
    assert not any(alike(shingles(given[i]), shingles(given[j])) for i in planted for j in kept if i != j)
    assert all(r["n_tokens"] or not (given[r["doc_id"]] or "") for r in out)


def test_stages_of_an_empty_table_and_clashing_columns(spark):
    docs = table(spark, SF, "documents").select("*", *[F.lit(k).alias(c) for k, c in enumerate(("_key", "_quality", "_id", "_runs", "_of", "id", "n_runs"))])
    for given in (docs.limit(30), docs.limit(0)):
        now, columns = written(given, "given"), given.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = written(stage(spark, now, SF), "stage")
            assert now.columns == columns, name
            assert now.where("_key != 0 OR _quality != 1 OR _id != 2 OR _runs != 3 OR _of != 4 OR id != 5 OR n_runs != 6").isEmpty(), name
        assert corpus_pipeline.to_tokens(spark, now, SF).count() == now.count()


def test_contaminated_rows_go_whatever_their_id(spark):
    item = table(spark, SF, "benchmark").where("size(split(text, ' ')) >= 20").first()["text"]
    bad, good = prose(5, 30) + " " + item + " " + prose(6, 30), prose(7, 60)
    given = [(1, good), (2, bad), (2, good), (None, bad), (None, good), (None, None)]
    out = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(given, "doc_id bigint, text string"), SF)
    assert rows_of(out) == sorted([(1, good), (2, good), (None, good), (None, None)], key=repr)


def test_rows_that_are_alike_after_the_cut_or_before_it_are_one(spark, tmp_path):
    """What is left of different documents may be equal, and copies of a row may share its id."""
    rest, first, second = prose(21, 40), prose(22, 120), prose(23, 120)
    near = first.replace(first.split(" ")[3], "other", 1)
    given = [(1, f"{first}\n{rest}"), (2, f"{second}\n{rest}"), (3, f"{first}\n{prose(24, 9)}"), (4, f"{near}\n{prose(25, 9)}"), (4, f"{near}\n{prose(25, 9)}")]
    spark.createDataFrame(given, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cut = [(1, rest), (2, rest), (3, f"{first}\n{prose(24, 9)}"), (4, prose(25, 9)), (4, prose(25, 9))]
    out = corpus_pipeline.keep_one_of_group(spark, spark.createDataFrame(cut, "doc_id bigint, text string"), str(tmp_path))
    # 2 is what 1 is now, and 4 was what 3 is.
    assert {r["doc_id"] for r in out.collect()} & {2, 4} == set()
    assert 3 in {r["doc_id"] for r in out.collect()} or 1 in {r["doc_id"] for r in out.collect()}
