"""Stratified samples of exact size, spread over volumes."""

from __future__ import annotations

import random
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quotas(capacities: dict[str, int], n: int, each: bool = False) -> dict[str, int]:
    """Largest-remainder shares of ``n`` within the capacities; ``each``: at least one where there is any.

    The remainder goes round by falling fraction, then name.
    """
    total = sum(capacities.values())
    if n > total:
        raise ValueError("more are asked for than there are")
    if not total:
        return dict.fromkeys(capacities, 0)
    exact = {k: Fraction(n * c, total) for k, c in capacities.items()}
    out = {k: int(x) for k, x in exact.items()}
    ranked = sorted(capacities, key=lambda k: (out[k] - exact[k], str(k)))
    while (rest := n - sum(out.values())) > 0:
        for k in [k for k in ranked if out[k] < capacities[k]][:rest]:
            out[k] += 1
    if each and n >= sum(c > 0 for c in capacities.values()):
        for k in sorted((k for k, c in capacities.items() if c and not out[k]), key=str):
            giver = max((g for g in out if out[g] > 1), key=lambda g: (out[g], str(g)))
            out[giver] -= 1
            out[k] += 1
    return out


def volume_quotas(capacities: dict[str, int], n: int, seed: int = 0) -> dict[str, int]:
    """Equal shares, what small volumes leave going round the others in a seeded order."""
    order = sorted(capacities, key=str)
    random.Random(seed).shuffle(order)
    out = dict.fromkeys(order, 0)
    left = min(n, sum(capacities.values()))
    while left:
        open_ = [v for v in order if out[v] < capacities[v]]
        share = max(1, left // len(open_))
        for v in open_:
            more = min(share, capacities[v] - out[v], left)
            out[v] += more
            left -= more
    return out


def volume_spread_sample(pages: DataFrame, n: int, seed: int = 0, stratum: str = "sample_stratum", volume: str = "volume", key: str = "page_key", guarantee: bool = True) -> DataFrame:
    """Exactly ``n`` pages: quotas by stratum, then by volume, then the least seeded hashes.

    Only the counts per (stratum, volume) reach the driver.
    """
    sizes = [(r[stratum], r[volume], r["n"]) for r in pages.groupBy(stratum, volume).agg(F.count("*").alias("n")).collect()]
    strata: dict = {}
    for s, v, c in sizes:
        strata.setdefault(s, {})[v] = c
    if n >= sum(c for _, _, c in sizes):
        return pages
    by_stratum = quotas({s: sum(v.values()) for s, v in strata.items()}, n, guarantee)
    wanted = [(s, v, q) for s, volumes in strata.items() for v, q in volume_quotas(volumes, by_stratum[s], seed).items() if q]
    table = pages.sparkSession.createDataFrame(wanted, f"__s {dict(pages.dtypes)[stratum]}, __v {dict(pages.dtypes)[volume]}, __q long")
    # Ranks need ids only, and the greatest quota cuts every task's rows before they are shuffled;
    # the pages themselves are joined last.
    rank = F.row_number().over(Window.partitionBy("__s", "__v").orderBy(F.xxhash64(F.lit(seed), key), key))
    ranked = pages.select(key, F.col(stratum).alias("__s"), F.col(volume).alias("__v")).withColumn("__r", rank).where(F.col("__r") <= max(q for _, _, q in wanted))
    table = table.withColumnsRenamed({"__s": "__a", "__v": "__b"})
    chosen = ranked.join(F.broadcast(table), F.col("__s").eqNullSafe(F.col("__a")) & F.col("__v").eqNullSafe(F.col("__b"))).where("__r <= __q")  # as many rows as volumes
    return pages.join(chosen.select(key), key, "left_semi")


def shuffled(rows: DataFrame, seed: int, key: str = "page_key") -> DataFrame:
    """Rows in a seeded order that does not depend on how they are dealt: by the MD5 of seed and key."""
    return rows.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key)


def shard(rows: DataFrame, rank: int, world: int, order: str = "row_ord") -> DataFrame:
    """Every ``world``-th row from ``rank`` on."""
    if not 0 <= rank < world:
        raise ValueError("the rank must be within the world")
    return rows.where(F.pmod(F.col(order), F.lit(world)) == rank)
