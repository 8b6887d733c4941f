"""Jobs by name: functions (context, arguments) that report as text.

``spark-submit -m weftline.jobs NAME [ARGUMENT...]`` runs one and prints its report.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession

from weftline.operators.collection import StringSet
from weftline.plans import rank, search
from weftline.sources.catalog import Catalog


class Context:
    """What a job works with: the session, its tables, sets of strings, and the report."""

    def __init__(self, spark: SparkSession):
        self.spark, self.catalog = spark, Catalog(spark)
        self._lines: list[str] = []

    def output(self, text: str) -> None:
        """Add to the job's report."""
        self._lines.append(text)

    @property
    def report(self) -> str:
        return "".join(self._lines)

    def parallelize(self, values: Iterable[str]) -> StringSet:
        return StringSet.parallelize(self.spark, values)

    def from_table(self, name: str, f: Column | Callable[[dict], str | None]) -> StringSet:
        """One string per row of a table of the catalog; nulls are dropped."""
        return StringSet.from_rows(self.spark.table(name), f)


JOBS: dict[str, Callable[[Context, list[str]], None]] = {}


def job(f: Callable[[Context, list[str]], None]) -> Callable[[Context, list[str]], None]:
    JOBS[f.__name__] = f
    return f


def run(spark: SparkSession, name: str, arguments: Iterable[str] = ()) -> str:
    """The report of a job; raises KeyError for an unknown name, and whatever the job raises."""
    context = Context(spark)
    JOBS[name](context, list(arguments))
    return context.report


def _read(context: Context, path: str) -> DataFrame:
    return context.spark.read.parquet(path)


@job
def page_rank(context: Context, arguments: list[str]) -> None:
    """NODES LINKS OUT [THRESHOLD [PERCENT]]: ranks of a graph in Parquet, written to OUT."""
    nodes, links, out, *rest = arguments
    limits = dict(zip(("threshold", "percent"), map(float, rest)))
    done = rank.page_rank(_read(context, nodes), _read(context, links), **limits)
    done.ranks.write.mode("overwrite").parquet(out)
    context.output(f"{done.steps} steps, {done.settled:.2f} % settled\n")


@job
def query(context: Context, arguments: list[str]) -> None:
    """DOCUMENTS ID TEXT WORD...: the best documents of a Parquet table for the words."""
    path, doc, text, *words = arguments
    for r in search.search(_read(context, path), doc, " ".join(words), text).collect():
        context.output(f"{r[doc]}\t{r['score']:.4f}\n")


if __name__ == "__main__":
    print(run(SparkSession.builder.getOrCreate(), sys.argv[1], sys.argv[2:]), end="")
