"""Stretches of mixed pages: one row per run, none lost, and a language for every page."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import SparkSession

from weftline.llm import queries

DE = "Der Hund ist in dem alten Haus und schläft. Die Katze wird heute nicht mit der Maus spielen. Wir sind nach der Arbeit zu dem Fluss gegangen."
EN = "The dog is in the old house and sleeps. The cat will not play with the mouse today. We have gone to the river after the work."
FR = "Le chien est dans la vieille maison et dort. Le chat ne joue pas avec la souris. Nous sommes allés près de la rivière après le travail."
MIXED = f"<html><body><main><h1>Die Katze und der Hund</h1><p>{DE} {EN}</p><p>{FR}</p></main></body></html>"


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    texts = [(t, n) for t, n in ((DE, "de"), (EN, "en"), (FR, "fr"))] * 40
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": [t for t, _ in texts], "lang": [n for _, n in texts]}), out / "documents.parquet")
    pages = [MIXED, "<html><body></body></html>", "<html><body><p>2024</p></body></html>"]
    columns = {"fetch_id": [1, 2, 3], "host": ["a.example"] * 3, "url": [f"http://a.example/{i}" for i in range(3)], "page": pages, "outbound": pa.nulls(len(pages), pa.string())}
    pq.write_table(pa.table(columns), out / "crawl.parquet")
    return str(out)


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", 2).config("spark.ui.enabled", False).getOrCreate()


def test_both_languages_of_a_paragraph_and_the_heading(spark, sf_dir):
    rows = queries.p3_segments(spark, sf_dir).where("fetch_id = 1").orderBy("block_no", "segment").collect()
    assert [(r.block_no, r.lang) for r in rows] == [(0, "de"), (1, "de"), (1, "en"), (2, "fr")]
    assert all(0.5 <= r.confidence <= 1 for r in rows)


def test_every_page_has_a_language(spark, sf_dir):
    rows = {r.fetch_id: r for r in queries.p3_pages(spark, sf_dir).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].lang in ("de", "en", "fr") and rows[1].confidence < 0.9
    assert [(rows[i].lang, rows[i].confidence) for i in (2, 3)] == [("und", 0.0), ("und", 0.0)]
