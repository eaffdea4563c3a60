"""Language of a text by compression: the language whose dictionary makes the text smallest.

A raw-content zstandard dictionary per language is cut from a bounded sample of passages.  Whole texts are compressed in
blocks, since a dictionary says little about what comes long after it; the sizes of a text's blocks add up.  Only letters
count, in lower case: every other run of characters is one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborbook.llm.texts import held_out, text_buffer

#: Passages per language at most, characters of each, bytes of a dictionary, bytes of a block, level of compression
#: and its shortest match.
PASSAGES, PASSAGE, DICTIONARY, BLOCK, LEVEL, MATCH = 160, 700, 98_304, 4096, 6, 3
#: Below this lead over the second best, as a share of its size, a prediction is marked as rejected.
MARGIN = 0.01

SCHEMA = "lang_pred string, score double, rejected boolean"


def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "\\P{L}+", " ")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def learn_dictionaries(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary per language from the texts that are not held out and have a language and a letter.

    Of every language the ``PASSAGES`` documents with the smallest hashes of their ids are taken, and of each a passage
    at a place that the hash names; nothing else but a count per language reaches the driver.  Common languages come first.
    """
    known = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    known = known.where(F.col("l").isNotNull() & ~held_out(F.col("i")) & has_letter(F.col("t")))
    common = {r["l"]: r["n"] for r in docs.where(F.col(lang).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(lang).cast("string").alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    known = known.withColumn("t", letters_only(F.col("t")))
    room = F.greatest(F.length("t") - PASSAGE + 1, F.lit(1))
    place = (F.pmod(F.xxhash64("i"), room) + 1).cast("int")
    passages = known.select("l", F.xxhash64("i").alias("h"), F.col("t").substr(place, F.lit(PASSAGE)).alias("p"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "p"))
    rows = passages.withColumn("rank", rank).where(F.col("rank") <= PASSAGES).collect()
    content: dict[str, list[bytes]] = {}
    for row in sorted(rows, key=lambda r: (r["l"], r["rank"])):
        content.setdefault(row["l"], []).append(row["p"].encode())
    return {name: b"\n".join(content[name])[:DICTIONARY] for name in sorted(content, key=lambda n: (-common[n], n))}


class _Sizes:
    """Compressed size of a text under each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.compressors = []
        for name in self.names:
            known = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            chosen = dict(source_size=BLOCK, dict_size=len(dictionaries[name]), min_match=MATCH, write_content_size=False)
            chosen = zstandard.ZstdCompressionParameters.from_level(LEVEL, **chosen)
            known.precompute_compress(compression_params=chosen)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=known, compression_params=chosen))

    def predict(self, text: memoryview) -> tuple[str, float, bool]:
        sizes = [0] * len(self.names)
        for at in range(0, len(text), BLOCK):
            block = text[at : at + BLOCK]
            for k, compressor in enumerate(self.compressors):
                sizes[k] += len(compressor.compress(block))
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        if len(order) == 1:
            return self.names[0], 1.0, False
        best, second = sizes[order[0]], sizes[order[1]]
        lead = (second - best) / second
        return self.names[order[0]], min(1.0, 0.5 + 2 * lead), lead < MARGIN


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes], *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0.5 for a tie with the second best, up to 1) and ``rejected``.

    Null texts, texts without a letter, and all texts if nothing was learned are ``und`` with score 0 and rejected; equal
    sizes go to the language that comes first in ``dictionaries``.  Columns of ``docs`` with one of the three names are replaced.
    """
    others = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    names = [f"c{i}" for i in range(len(others))]
    base = docs.select(others).toDF(*names)
    known = base.columns[others.index(text)]
    base = base.withColumn("judged", F.when(has_letter(F.col(known)), letters_only(F.col(known))))
    kept = [f for f in base.schema if f.name != "judged"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(dictionaries)
        for batch in batches:
            judged = batch.column("judged")
            body, starts = text_buffer(judged)
            whole, at, there = memoryview(body), starts.tolist(), judged.is_valid().to_pylist()
            out = [sizes.predict(whole[a:b]) if ok and sizes.names else ("und", 0.0, True) for a, b, ok in zip(at[:-1], at[1:], there, strict=True)]
            columns = [batch.column(f.name) for f in kept]
            made = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns + made, names=[f.name for f in kept] + ["lang_pred", "score", "rejected"])

    out = base.mapInArrow(judge, f"{schema}, {SCHEMA}")
    return out.toDF(*others, "lang_pred", "score", "rejected")
