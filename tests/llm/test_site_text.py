"""Text that recurs on one site is furniture at any length and crawl size; a heading linked from elsewhere is not."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import SparkSession

from weftline.llm import queries

SHORT = "Support the shop and get the newsletter"
LONG = " ".join(["We and the partners of this site store and read data on your device to show you what you like."] * 3)
NUMBERS = "one two three four five six seven eight".split()


def page(i: int, links: str = "", n: int = 2) -> str:
    prose = "".join(f"<p>The {NUMBERS[i]} story is about a {NUMBERS[-i]} that was in the {x} of the old town and the river.</p>" for x in ("north", "south", "east")[:n])
    return f"<html><body><div class='text'><h1>The tale of the {NUMBERS[i]} houses</h1>{prose}<p>{SHORT}</p><p>{LONG}</p></div><div class='side'>{links}</div></body></html>"


@pytest.fixture(scope="module")
def found(tmp_path_factory):
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", 2).config("spark.ui.enabled", False).getOrCreate()

    def run(pages: list[tuple[str, str]]) -> dict[int, list[int]]:
        out = tmp_path_factory.mktemp("sf")
        columns = {"fetch_id": list(range(len(pages))), "host": [h for h, _ in pages], "url": [f"http://{h}/{i}" for i, (h, _) in enumerate(pages)], "page": [p for _, p in pages], "outbound": pa.nulls(len(pages), pa.string())}
        pq.write_table(pa.table(columns), out / "crawl.parquet")
        rows = queries.p5_found(spark, str(out)).where("fetch_id < 8").collect()
        return {i: sorted(r.block_no for r in rows if r.fetch_id == i) for i in range(8)}

    return run


def test_notices_of_a_small_site(found):
    others = [(f"h{i}.example", "<html><body><p>2024</p></body></html>") for i in range(4000)]
    assert found([("a.example", page(i)) for i in range(8)] + others) == {i: [0, 1, 2] for i in range(8)}


def test_heading_that_is_link_text_elsewhere(found):
    links = "<ul>" + "".join(f"<li><a href='/{i}'>The tale of the {NUMBERS[i]} houses</a></li>" for i in range(8)) + "</ul>"
    assert found([("a.example", page(i, links)) for i in range(8)]) == {i: [0, 1, 2] for i in range(8)}
