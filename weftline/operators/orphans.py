"""References to records that do not exist, per reference and per table and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.skew import salted_join
from weftline.sources.tables import cut

#: The states of a parent that count as deleted.
GONE = (404, 410)


def reference_states(parents: DataFrame, children: DataFrame) -> DataFrame:
    """State of every referenced key at the end of every period in which it is referenced.

    ``parents``: parent_table, key, period, at (order of states), state;
    ``children``: parent_table, key, period, one row per reference.  Parent and
    child keys are united in long form with a tag and grouped by (parent_table,
    key, period), combined before the shuffle; then by parent table and key,
    where a key has at most one row per period.  A reference is live if the last
    parent state up to the end of its period is none of GONE (null and other
    states are live).

    Gives parent_table, key, period, n_refs, orphan.  Null tables, keys or
    periods give no row; a table without parents has orphans only.
    """
    by = ["parent_table", "key"]
    parent = F.struct("at", F.col("state").cast("int").alias("state"))
    kind = parents.select(parent.alias("p")).schema["p"].dataType
    tagged = parents.select(*by, "period", parent.alias("parent"), F.lit(0).cast("bigint").alias("refs")).unionByName(
        children.select(*by, "period", F.lit(None).cast(kind).alias("parent"), F.lit(1).cast("bigint").alias("refs"))
    )
    by_period = (
        tagged.where(F.col("parent_table").isNotNull() & F.col("key").isNotNull() & F.col("period").isNotNull())
        .groupBy(*by, "period")
        .agg(F.max("parent").alias("parent"), F.sum("refs").alias("n_refs"))
    )
    history = F.array_sort(F.collect_list(F.struct("period", "parent", "n_refs")))
    by_key = by_period.groupBy(*by).agg(history.alias("h")).where(F.exists("h", lambda x: x["n_refs"] > 0))
    # The last known parent as of each element of the history, by one fold over it.
    rows = "array<struct<period:{p},n_refs:bigint,orphan:boolean>>".format(p=by_period.schema["period"].dataType.simpleString())
    start = F.struct(F.lit(None).cast(kind).alias("last"), F.array().cast(rows).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        last = F.coalesce(x["parent"], acc["last"])
        orphan = last.isNull() | F.coalesce(last["state"].isin(*GONE), F.lit(False))
        row = F.struct(x["period"].alias("period"), x["n_refs"].alias("n_refs"), orphan.alias("orphan"))
        return F.struct(last.alias("last"), F.when(x["n_refs"] > 0, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    return by_key.select(*by, F.explode(F.aggregate("h", start, step, lambda a: a["out"])).alias("x")).select(*by, "x.*")


def orphan_references(parents: DataFrame, children: DataFrame) -> DataFrame:
    """The rows of ``children`` (parent_table, key, period, row_id) whose key has no live parent at the end of the period.

    The join back is salted by the number of references, so one target that
    owns a third of all links is spread over many tasks.
    """
    children = cut(children)
    states = cut(reference_states(parents, children))
    total = states.agg(F.sum("n_refs")).first()[0] or 0
    by = ["parent_table", "key", "period"]
    lost = states.where("orphan").select(*by, "n_refs")
    return salted_join(children, lost, by, "n_refs", total, F.col("row_id")).select("parent_table", "row_id", "key", "period")


def orphan_report(parents: DataFrame, children: DataFrame) -> DataFrame:
    """References, orphan references and orphan keys per parent table and period."""
    lost = F.col("orphan")
    return (
        reference_states(parents, children)
        .groupBy("parent_table", "period")
        .agg(
            F.sum("n_refs").alias("refs"),
            F.sum(F.when(lost, F.col("n_refs")).otherwise(0)).alias("orphan_refs"),
            F.count(F.when(lost, 1)).alias("orphan_targets"),
        )
    )
