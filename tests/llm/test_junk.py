"""Texts that are no prose come out even if all of their language are alike."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from weftline.llm import queries


def test_junk_in_a_corpus_of_junk(tmp_path):
    menu = "\n".join(f"- the item {i} of the shop" for i in range(20))
    texts = [menu] * 20 + [None, ""]
    pq.write_table(pa.table({"doc_id": list(range(22)), "text": texts}), tmp_path / "documents.parquet")
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", 2).config("spark.ui.enabled", False).getOrCreate()
    assert sorted(r.doc_id for r in queries.p10_found(spark, str(tmp_path)).collect()) == list(range(20))
