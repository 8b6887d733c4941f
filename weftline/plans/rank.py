"""Rank of pages by their links, iterated on written tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.skew import salted_join
from weftline.sources.tables import cut, release

#: Damping factor and base rank; a start rank of 1 for every page.
DAMPING, BASE = 0.85, 0.15
START = 1.0


@dataclass
class Ranking:
    """Ranks (id, rank, prev), steps done, and the share in percent of pages that changed by less than the threshold."""

    ranks: DataFrame
    steps: int
    settled: float
    converged: bool


def weighted_links(links: DataFrame) -> DataFrame:
    """(src, dst, share): repeated links merged, each source's shares sum to 1; null ends are left out.

    The out-degree counts every link, also those that lead to no page.
    """
    merged = links.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = merged.groupBy("src").agg(F.sum("n").alias("degree"), F.count("*").alias("targets"))
    total = merged.count()
    joined = salted_join(merged, out, ["src"], "targets", total, F.col("dst"))
    return joined.select("src", "dst", (F.col("n") / F.col("degree")).alias("share"))


def start(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rank, prev, targets): every page at rank 1 with its number of distinct link targets."""
    targets = edges.groupBy("src").agg(F.count("*").alias("targets"))
    ids = nodes.select("id").where("id is not null").distinct()
    joined = ids.join(targets, F.col("id") == F.col("src"), "left")
    return joined.select("id", F.lit(START).alias("rank"), F.lit(START).alias("prev"), F.coalesce("targets", F.lit(0).cast("bigint")).alias("targets"))


def step(state: DataFrame, edges: DataFrame, n_edges: int) -> DataFrame:
    """One step: each page passes DAMPING of its rank along its links, new rank = BASE + what comes in.

    What goes to no page is lost, as is the rank of pages without links.  A page
    stays if it has links or some come in.
    """
    sent = salted_join(edges, state.select(F.col("id").alias("src"), "rank", "targets"), ["src"], "targets", n_edges, F.col("dst"))
    passed = sent.select(F.col("dst").alias("id"), (DAMPING * F.col("rank") * F.col("share")).alias("v"))
    stay = state.where("targets > 0").select("id", F.lit(0.0).alias("v"))
    summed = passed.unionByName(stay).groupBy("id").agg(F.sum("v").alias("v"))
    return summed.join(state, "id").select("id", (BASE + F.col("v")).alias("rank"), F.col("rank").alias("prev"), "targets")


def page_rank(nodes: DataFrame, links: DataFrame, threshold: float = 1e-4, percent: float = 100.0, max_steps: int = 100, least_steps: int = 1) -> Ranking:
    """Iterate until ``percent`` of the pages changed by less than ``threshold``, at most ``max_steps`` times.

    ``nodes``: id; ``links``: src, dst with repeats.  The state of each step is
    a written table, so plans stay short and lost executors cost one step; the
    table of the step before is deleted.  An empty graph has no ranks.
    """
    edges = cut(weighted_links(links))
    n_edges = edges.count()
    state = cut(start(nodes, edges))
    settled, done = 0.0, False
    steps = 0
    while steps < max_steps and not done:
        new = cut(step(state, edges, n_edges))
        release(state)
        state, steps = new, steps + 1
        n, quiet = state.agg(F.count("*"), F.count_if(F.abs(F.col("rank") - F.col("prev")) < threshold)).first()
        settled = 100.0 * quiet / n if n else 100.0
        done = steps >= least_steps and settled >= percent
    release(edges)
    return Ranking(state.select("id", "rank", "prev"), steps, settled, done)


def fixed_steps(nodes: DataFrame, links: DataFrame, steps: int) -> DataFrame:
    """(id, rank, prev) after exactly ``steps`` steps."""
    return page_rank(nodes, links, threshold=0.0, max_steps=steps).ranks


def residual(ranks: DataFrame, threshold: float = 1e-4) -> DataFrame:
    """Pages, pages that changed by less than the threshold and the largest change, in one pass."""
    d = F.abs(F.col("rank") - F.col("prev"))
    return ranks.agg(F.count("*").alias("pages"), F.count_if(d < threshold).alias("settled"), F.max(d).alias("largest"))
