"""Packed postings of an inverted index as typed rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.packed import posting, split_items


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        words = batch.column(0)
        urls: list[str] = []
        counts: list[int] = []
        marks: list[int] = []
        sizes = np.zeros(batch.num_rows, np.int64)
        for i, field in enumerate(batch.column(1).to_pylist()):
            items = split_items(field)
            sizes[i] = len(items)
            for item in items:
                url, _, positions, _ = posting(item)
                urls.append(url)
                counts.append(len(positions.split()))
                marks.append(digest(positions))
        if urls:
            yield pa.record_batch(
                [
                    words.take(pa.array(np.repeat(np.arange(len(sizes)), sizes))),
                    pa.array(urls, pa.string()),
                    pa.array(counts, pa.int32()),
                    pa.array(np.array(marks, np.uint64).view(np.int64)),
                ],
                names=["word", "url", "n", "mark"],
            )


def word_pages(index: DataFrame) -> DataFrame:
    """(word, url, n): occurrences of each word on each page of a packed index.

    ``index`` has word and accumulated_value; occurrences are positions, equal
    postings of a word and url count once, postings with other positions add
    up.  Rows without a word or without postings give nothing.  One shuffle, on
    (word, url), serves the merging of repeats and the sum.
    """
    rows = index.select("word", "accumulated_value").where("word is not null and accumulated_value <> ''")
    parsed = rows.mapInArrow(_parse, "word string, url string, n int, mark bigint")
    return parsed.repartition("word", "url").dropDuplicates(["word", "url", "mark", "n"]).groupBy("word", "url").agg(F.sum("n").cast("bigint").alias("n"))
