"""Encoding of a whole corpus with a public tokenizer (problem 8)."""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import lexicon as lx
from skein.runtime import cut, shared_folder

#: Folder of the public tokenizers' files, the same on all machines.
TOKENIZERS = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
#: Words that the lexicon holds: the most frequent of the whole corpus. Bounds the driver's part; not the result.
LEXICON_WORDS = 65_536
#: Distinct words that a task counts before it hands them on.
COUNT_WORDS = 1 << 19
#: Texts that are split at a time, in characters.
SLICE_CHARS = 1 << 21


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts of together about SLICE_CHARS; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > SLICE_CHARS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                words.update(lx.split(text))
        if len(words) > COUNT_WORDS:
            yield out()
            words.clear()
    if words:
        yield out()


def frequent_words(docs: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """Words of all texts with their counts: all that occur at least so often that ``words`` of them at most remain.

    The least count comes from a table of counts (1, 2, ... 1024, then steps of an eighth of a power of two), whose
    size doesn't depend on the data; no task sends words to the driver before that bound holds.
    """
    counted = cut(docs.select(text).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    step = F.when(F.col("n") <= 1024, F.col("n")).otherwise(1024 + F.floor(F.log2(F.col("n") / 1024) * 8)).cast("bigint")
    table = counted.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    kept, least = 0, None
    for row in table:
        kept += row.words
        if kept > words:
            break
        least = row.least
    return counted.filter(F.col("n") >= least) if least is not None else counted.limit(0)


def _write(spark: SparkSession, path: str, data: bytes) -> None:
    """A file in the shared folder, written through Hadoop's file systems: it works on whatever the folder lies on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        for i in range(0, len(data), 1 << 20):
            stream.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        stream.close()


def publish_lexicon(spark: SparkSession, words: list[str], ranks: str) -> tuple[str, bool]:
    """Compiles a lexicon file. Returns where workers find it: (path, False), or (name, True) as a Spark file.

    A shared folder that all machines mount is mapped in place; from any other file system Spark brings the file to
    each executor.
    """
    image = lx.compile_lexicon(words, lx.read_ranks(ranks))
    name = f"lexicon-{hashlib.sha256(image).hexdigest()[:24]}.bin"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    _write(spark, path, image)
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return url.path, False
    spark.sparkContext.addFile(path)
    return name, True


def lexicon_of(docs: DataFrame, text: str = "text", ranks: str | None = None) -> tuple[str, bool, str]:
    ranks = ranks or f"{TOKENIZERS}/{RANKS}"
    words = [r.word for r in frequent_words(docs, text).select("word").collect()]  # at most LEXICON_WORDS
    return (*publish_lexicon(docs.sparkSession, words, ranks), ranks)


def _encoder(at: tuple[str, bool, str]) -> lx.Encoder:
    return lx.encoder(SparkFiles.get(at[0]) if at[1] else at[0], at[2])


def encode(docs: DataFrame, key: str, text: str = "text", ranks: str | None = None, at: tuple[str, bool, str] | None = None) -> DataFrame:
    """``key`` and ids (array<int>) of every row, without special tokens.

    Null and empty texts give the empty list; blank and very long texts are texts like others; special tokens'
    names in a text are ordinary text. Repeated rows are encoded each; other columns are ignored; an empty table
    gives an empty table. A shuffle carries only (word, count) pairs of the counting pass.
    """
    at = at or lexicon_of(docs, text, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(at)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                flat, count = enc.encode(texts[a:b])
                offsets = np.zeros(len(count) + 1, np.int32)
                np.cumsum(count, out=offsets[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, key: str, ranks: str | None = None) -> DataFrame:
    """``key`` and text (string) of rows with ids; a null or empty list gives the empty text."""
    path = ranks or f"{TOKENIZERS}/{RANKS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = {rank: word for word, rank in lx.read_ranks(path).items()}
        for batch in batches:
            texts = [b"".join(map(words.__getitem__, ids or [])).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    rows = encoded.select(key, "ids")
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("text", T.StringType())]))
