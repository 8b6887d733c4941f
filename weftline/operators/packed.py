"""Several values packed in one field -> one row per value with its position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.packed import LINKS, Packing, posting, split_values


def _exploder(packing: Packing, url_only: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [split_values(x, packing) for x in batch.column(0).to_pylist()]
            sizes = np.fromiter(map(len, items), np.int64, len(items))
            total = int(sizes.sum())
            if not total:
                continue
            flat = [posting(x)[0] for xs in items for x in xs] if url_only else [x for xs in items for x in xs]
            starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
            rows = pa.array(np.repeat(np.arange(len(items)), sizes))
            kept = [batch.column(i).take(rows) for i in range(1, batch.num_columns)]
            yield pa.record_batch([*kept, pa.array((np.arange(total) - starts).astype(np.int32)), pa.array(flat, pa.string())], names=names)

    return run


def split_packed(df: DataFrame, keep: dict[str, str | Column], field: str | Column, *, packing: Packing = LINKS, postings: bool = False) -> DataFrame:
    """One row (the columns of ``keep``, pos int, item string) per value packed in ``field``.

    ``keep`` names what is carried along, e.g. the row's id.  Null and empty
    fields and fields without a value give no rows; repeated rows and repeated
    values stay; pos counts from 0 within the field.  Other columns of ``df``
    are not read, so clashing names don't matter.  With ``postings`` the item is
    the url of the posting.  A narrow operator: no shuffle, one pass, fields of
    any length.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    source = df.select(col(field).cast("string").alias("__field"), *[col(c).alias(name) for name, c in keep.items()]).where(F.col("__field") != "")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[1:])
    return source.mapInArrow(_exploder(packing, postings, [*keep, "pos", "item"]), f"{kinds}pos int, item string")
