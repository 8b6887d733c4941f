"""Loss-bearing tokens are counted from the ids, and their limit binds without splitting texts."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import SparkSession

from weftline.llm import bpe, packing, queries


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", 2).config("spark.ui.enabled", False).getOrCreate()


def test_loss_is_counted_from_ids(spark, tmp_path):
    texts = ["the cat sat on the mat and the dog\nQzxv#9 ÄÖÜß ŵŷẑ", "#!%$ qzxvj 東京都\nand then the people went home", "one line only", "a\n\n\n b", "x\r\ny", "last line ends\n"]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), tmp_path / "documents.parquet")
    encoder = bpe.Encoder(spark)
    piece = {v: k for k, v in encoder.ranks.items()}
    expected = {}
    for r in encoder.encode(spark.read.parquet(str(tmp_path)), "text").collect():
        head, end, inside = len((r.text.partition("\n")[0] + "\n").encode()) if "\n" in r.text else 0, 0, 0
        for i in r.ids:
            end += len(piece[i])
            inside += end <= head
        assert end == len(r.text.encode())
        expected[r.doc_id] = (len(r.ids), len(r.ids) - inside)
    found = {r.doc_id: (r.n_tokens, r.n_loss) for r in queries.p9_containers(spark, str(tmp_path)).collect()}
    assert found == {k: v for k, v in expected.items()}


def test_limit_of_loss_binds_and_splits_nothing(spark):
    rows = [(i, 512, 512) for i in range(8)] + [(8, 2000, 2000), (9, 48, 0), (10, 5000, 4990)]
    placed = packing.fill_containers(spark.createDataFrame(rows, "doc_id long, n_tokens long, n_loss long")).toPandas()
    assert placed.groupby("doc_id").size().to_dict() == {i: 1 for i in range(10)} | {10: 3}
    by = placed.groupby("container")
    assert (by["n_tokens"].sum() <= packing.CAPACITY).all()
    # Only what no container could hold within the limit is over it, without other loss beside it.
    over = placed[placed["container"].map(by["n_loss"].sum()) > packing.LOSS_TOKENS]
    assert not over.empty and ((over["n_loss"] > packing.LOSS_TOKENS) | (over["n_loss"] == 0)).all()
    assert packing.LOSS_TOKENS < packing.CAPACITY
