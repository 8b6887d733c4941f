"""Filling containers of fixed capacity with texts of varying length.

Vector bin packing by the dot-product heuristic: an open container takes, of
the items that fit under every limit, the one whose demands point most in the
direction of what the container has left.  Limits are tokens, segments and
loss-bearing tokens.  Texts longer than the capacity are cut into full
containers and a rest; no other text is split.  A piece with more loss-bearing
tokens than their limit takes all of the limit: beside it only texts without
loss are placed.

Packing runs in groups of about ``GROUP_ROWS`` pieces, formed by the hash of
their place in a written table (not of the id, which may repeat), so any number
of texts packs in parallel and no group outgrows a task; only the last
container of a group is likely to stay partly empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.tables import cut

CAPACITY = 2048
#: So few that a container of short texts reaches it.
SEGMENTS = 32
#: Under the capacity, so that it binds; see above for pieces over it.
LOSS_TOKENS = 1920
GROUP_ROWS = 8192


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_limit: int) -> np.ndarray:
    """Container number of every item; items must each fit an empty container.

    Items of equal demands are one kind; a container repeatedly takes the
    fitting kind of highest dot product of demand and remaining room, both as
    shares of the limits.  Ties go to the kind with more tokens, then loss.
    """
    kinds, kind_of, left = np.unique(np.stack([tokens, loss], 1), axis=0, return_inverse=True, return_counts=True)
    kind_of = kind_of.ravel()
    # Largest first; of kinds with equal tokens the one with more loss first.
    rank = np.lexsort((-kinds[:, 1], -kinds[:, 0]))
    t, s, left = kinds[rank, 0].astype(float), kinds[rank, 1].astype(float), left[rank].copy()
    place = np.empty(len(kinds), np.int64)
    place[rank] = np.arange(len(kinds))
    queues: list[list[int]] = [[] for _ in kinds]
    for i in range(len(tokens) - 1, -1, -1):
        queues[place[kind_of[i]]].append(i)
    out = np.full(len(tokens), -1, np.int64)
    dt, ds, one = t / capacity, s / loss_limit, 1.0 / segments
    remaining, bin_ = len(tokens), 0
    while remaining:
        room_t, room_s, room_n = float(capacity), float(loss_limit), segments
        while room_n:
            # Kinds are sorted by tokens: those that fit are a suffix.
            k0 = int(np.searchsorted(-t, -room_t))
            if k0 == len(t):
                break
            score = dt[k0:] * (room_t / capacity)
            score += ds[k0:] * (room_s / loss_limit)
            score += one * (room_n / segments)
            score[left[k0:] == 0] = -1.0
            if room_s < room_t:
                score[s[k0:] > room_s] = -1.0
            k = int(score.argmax())
            if score[k] < 0:
                break
            k += k0
            out[queues[k].pop()] = bin_
            left[k] -= 1
            room_t -= t[k]
            room_s -= s[k]
            room_n -= 1
            remaining -= 1
        bin_ += 1
        if bin_ % 64 == 0:
            keep = left > 0
            t, s, dt, ds, left = t[keep], s[keep], dt[keep], ds[keep], left[keep]
            queues = [q for q, k in zip(queues, keep) if k]
    return out


def fill_containers(
    sized: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int = LOSS_TOKENS
) -> DataFrame:
    """(container string, doc_id, piece, start, n_tokens, n_loss): every token of every text in one container.

    ``sized``: doc_id, n_tokens, n_loss with n_loss <= n_tokens.  ``piece`` and
    ``start`` tell the part of a split text (0, 0 for whole ones).  Null or zero
    sizes give no row, as there is nothing to place; repeated ids are separate
    items; a null id is kept.  Loss-bearing tokens are a text's last ones.
    """
    if min(capacity, segments, loss_limit) < 1:
        raise ValueError("limits must be positive")
    n, loss = F.col("n_tokens").cast("bigint"), F.col("n_loss").cast("bigint")
    rows = sized.where("n_tokens > 0").select("doc_id", n.alias("total"), F.least(F.greatest(F.coalesce(loss, F.lit(0)), F.lit(0)), n).alias("all_loss"))
    # A text over the capacity is cut every capacity tokens; others stay whole.
    over = F.col("total") > capacity
    starts = F.when(over, F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1, F.lit(capacity).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    pieces = rows.select("*", F.posexplode(starts).alias("piece", "start")).withColumn(
        "n_tokens", F.when(over, F.least(F.lit(capacity), F.col("total") - F.col("start"))).otherwise(F.col("total"))
    )
    first_loss: Column = F.col("total") - F.col("all_loss")
    pieces = pieces.withColumn("n_loss", F.least(F.col("n_tokens"), F.greatest(F.lit(0), F.col("start") + F.col("n_tokens") - first_loss)))
    pieces = cut(pieces.select("doc_id", "piece", "start", "n_tokens", "n_loss"))
    groups = max(1, round(pieces.count() / GROUP_ROWS))
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    pieces = pieces.select(group.alias("grp"), "doc_id", "piece", "start", "n_tokens", "n_loss")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "n_loss", "doc_id", "piece"], kind="stable", ignore_index=True)
        bins = pack(pdf["n_tokens"].to_numpy(), pdf["n_loss"].clip(upper=loss_limit).to_numpy(), capacity, segments, loss_limit)
        pdf.insert(0, "container", [f"{g}-{b}" for g, b in zip(pdf["grp"], bins)])
        return pdf.drop(columns="grp")

    schema = "container string, doc_id bigint, piece int, start bigint, n_tokens bigint, n_loss bigint"
    return pieces.groupBy("grp").applyInPandas(run, schema)


def container_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Items, tokens, loss-bearing tokens and unused tokens of every container."""
    tokens = F.sum("n_tokens")
    return placed.groupBy("container").agg(
        F.count("*").alias("n_segments"), tokens.alias("n_tokens"), F.sum("n_loss").alias("n_loss"), (F.lit(capacity) - tokens).alias("unused")
    )


