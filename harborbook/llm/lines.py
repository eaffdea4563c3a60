"""Later repeats of runs of lines, found by winnowing and deleted.

A window is a run of neighbouring lines that just reaches ``WORDS`` words, seen forwards from each line and backwards from
each line.  Its fingerprint is its line with the least hash, so a run of that many words has the same fingerprints
wherever it stands.  Positions of equal fingerprints are joined; around those that occur more than once matches are
extended both ways over all windows through them, and windows that also start earlier merge to the runs to delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborbook.llm.tables import drop, written
from harborbook.llm.texts import WORD_GAP, bound

WORDS = 50
LAST = 2**63 - 1


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _windows(docs: DataFrame, words: int) -> DataFrame:
    """(place, last, mark, a, b) of every window over (_id, _text, _lines).

    ``place`` is (id, hash of the text, first line), ``mark`` the least hash of a line and where it stands, ``a`` and ``b``
    two hashes of all lines.  Lines count from 0; lines without a word are passed over.  Rows with one id and text are folded
    before they are moved, so they have the windows of one document.
    """

    def hashed(t: Column, line: Column) -> Column:
        count = F.size(F.filter(F.split(t, WORD_GAP), lambda w: w != "")).cast("bigint")
        return F.struct(line.alias("line"), F.xxhash64(t).alias("h"), F.xxhash64(F.lit("second"), t).alias("g"), count.alias("n"))

    each = docs.select("_id", "_text", F.filter(F.transform("_lines", hashed), lambda x: x["n"] > 0).alias("_lines"))
    each = each.groupBy("_id", "_text").agg(F.any_value("_lines").alias("_lines"))
    lines = each.select("_id", "_text", F.inline("_lines"))
    doc = Window.partitionBy("_id", "_text")
    lines = lines.withColumn("_end", F.sum("n").over(doc.orderBy("line"))).withColumn("_start", F.col("_end") - F.col("n"))
    forwards = doc.orderBy("_start").rangeBetween(0, words - 1)
    backwards = doc.orderBy("_end").rangeBetween(1 - words, 0)

    def seen(frame) -> Column:
        return F.struct(
            F.min("line").over(frame).alias("first"),
            F.max("line").over(frame).alias("last"),
            F.sum("n").over(frame).alias("n"),
            F.min(F.struct("h", "line")).over(frame).alias("mark"),
            F.xxhash64(F.collect_list("h").over(frame)).alias("a"),
            F.xxhash64(F.collect_list("g").over(frame)).alias("b"),
        )

    both = lines.select("_id", "_text", seen(forwards).alias("f"), seen(backwards).alias("g"))
    one = F.when(F.col("g")["first"] == F.col("g")["last"], F.array("f")).otherwise(F.array("f", "g"))
    out = both.select("_id", "_text", F.explode(one).alias("w")).where(F.col("w")["n"] >= words)
    place = F.struct("_id", "_text", F.col("w")["first"].alias("first"))
    return out.select(place.alias("place"), F.col("w")["last"].alias("last"), F.col("w")["mark"].alias("mark"), F.col("w")["a"].alias("a"), F.col("w")["b"].alias("b"))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.withColumn("_id", F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST))).withColumn("_text", F.xxhash64(text))


def repeated_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(_id, _text, first, last): runs of lines to delete, by id and hash of the text."""
    base = _keyed(docs.select(doc_id, text), doc_id, text).select("_id", "_text", _lines(F.col(text)).alias("_lines"))
    windows = written(_windows(base, words), "windows")

    mark = F.struct("place._id", "place._text", "mark.line")
    marks = windows.groupBy(F.col("mark.h").alias("h")).agg(F.min(mark).alias("x"), F.max(mark).alias("y"))
    marks = written(marks.where("x != y").select("h"), "marks")
    # Fingerprints and repeated windows grow with the documents, so they are never broadcast.
    found = windows.join(marks.hint("merge"), F.col("mark.h") == F.col("h"), "left_semi")

    origins = found.groupBy("a", "b").agg(F.min("place").alias("origin"), F.max("place").alias("y"))
    origins = written(origins.where("origin != y").select("a", "b", "origin"), "origins")
    later = found.join(origins.hint("merge"), ["a", "b"]).where(F.col("place") > F.col("origin"))
    spans = later.select("place._id", "place._text", "place.first", "last").distinct()

    doc = Window.partitionBy("_id", "_text").orderBy("first", "last")
    reached = F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("_new", F.coalesce(F.col("first") > reached + 1, F.lit(True)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(doc))
    runs = runs.groupBy("_id", "_text", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")
    runs = written(runs, "runs")
    drop(windows, marks, origins)
    return runs


def delete_repeated_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``docs`` without the lines of runs of ``words`` or more words that also stand earlier; ``n_runs`` and ``n_deleted``
    tell how many runs and lines went.

    Earlier is a smaller id (null is the last), or an earlier line of the same document; lines are equal if all their
    characters are.  Runs are judged on the input, not on what is left.  Rows with one id and different texts are ordered
    by a hash of these, rows that are equal in both are one document.  A text without such a run stays as it is, null
    too; one of nothing else becomes empty.  Columns named ``n_runs`` or ``n_deleted`` are replaced.
    """
    # The columns of the user get names that nothing here has.
    names = [f"c{i}" for i in range(len(docs.columns))]
    named = dict(zip(docs.columns, names, strict=True))
    out = _delete_runs(docs.toDF(*names), named[doc_id], named[text], words)
    kept = [F.col(n).alias(c) for c, n in named.items() if c not in ("n_runs", "n_deleted")]
    return out.select(*kept, "n_runs", "n_deleted")


def _delete_runs(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    runs = repeated_runs(docs, doc_id=doc_id, text=text, words=words)
    runs = runs.groupBy("_id", "_text").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_runs"))
    runs = runs.select(F.col("_id").alias("_of"), F.col("_text").alias("_of_text"), "_runs")
    # One plan at every size: the runs grow with the documents, so they are never broadcast.
    same = (F.col("_id") == F.col("_of")) & (F.col("_text") == F.col("_of_text"))
    joined = _keyed(docs, doc_id, text).join(runs.hint("merge"), same, "left")

    number = F.size("_runs")

    def between(lines: Column, k: Column) -> Column:
        begin = F.when(k == 0, 0).otherwise(F.get("_runs", k - 1)["last"] + 1)
        end = F.when(k == number, F.size(lines)).otherwise(F.get("_runs", k)["first"])
        return F.slice(lines, begin + 1, end - begin)

    kept = bound(_lines(F.col(text)), lambda x: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), number), lambda k: between(x, k))), "\n"))
    gone = F.aggregate("_runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    some = F.col("_runs").isNotNull()
    own = [F.when(some, kept).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*own, F.when(some, number).otherwise(0).alias("n_runs"), F.when(some, gone).otherwise(0).alias("n_deleted"))
