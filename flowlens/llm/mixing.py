"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size is the expected number of copies of each of its documents.
Whole copies are certain; one further copy is drawn with the fractional rest as inclusion
probability. The flight moves these fractions along directions in the null space of the
constraints (tokens and documents of a source stay balanced) until they are 0 or 1. It runs in
blocks of rows; the few fractions a block leaves go into blocks of the next level, until one
block a source is left, whose last one or two fractions are landed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm.shared import materialize

#: Units of one flight; bounds a task's memory and the number of levels.
BLOCK = 1024
#: Constraints of the flight, and so the fractions that a block can leave.
BALANCED = 2
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
            most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, source_size)``, one row per source.

    Sources in code point order, null last, weigh ``weights``, repeating, and share ``share`` times all
    sizes by weight. A target stops at ``most`` times its source's size and its excess is shared anew
    among the others: all open targets are one level times their weight, and sources close in the order
    of size over weight, so running sums in that order give the level.
    """
    if share > most:
        raise ValueError("sources can't hold the whole share")
    # Unkeyed windows, over one aggregated row per source.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sizes.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(most))
    closing = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    after = closing.rowsBetween(0, Window.unboundedFollowing)
    before = closing.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
             / F.sum("__w").over(after))
    # The first source, in closing order, whose cap is over the level of those still open sets it for all.
    open_ = named.withColumn("__level", level).withColumn(
        "__level", F.when(F.col("__cap") >= F.col("__level") * F.col("__w"), F.col("__level")))
    whole = closing.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    common = F.first("__level", ignorenulls=True).over(whole)
    return (open_.withColumn("__common", common)
            .select("source", "source_size", F.least("__cap", F.coalesce(F.col("__common") * F.col("__w"), F.col("__cap")))
                    .alias("target")))


def _uniform(*key) -> float:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "big") / 2.0**64


def flight(size: list[float], chance: list[float], draw: Callable[[int], float]) -> list[float]:
    """Move ``chance`` until at most BALANCED of its values are fractions; sums of chance and size * chance stay.

    Three fractions and two constraints leave one direction at least. Going along it up to the first
    bound, one way or the other with odds that keep the expectation, fixes one fraction each time.
    """
    chance, open_, step = list(chance), [], 0
    for new, p in enumerate(chance):
        if not 0.0 < p < 1.0:
            continue
        open_.append(new)
        if len(open_) <= BALANCED:
            continue
        a, b, c = open_
        # The cross product of (1, 1, 1) and the sizes; equal sizes leave the direction (1, -1, 0).
        way = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(way):
            way = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for i, w in zip(open_, way):
            if w > 0:
                up, down = min(up, (1.0 - chance[i]) / w), min(down, chance[i] / w)
            elif w < 0:
                up, down = min(up, chance[i] / -w), min(down, (1.0 - chance[i]) / -w)
        go = up if draw(step) * (up + down) < down else -down
        step += 1
        for i, w in zip(open_, way):
            moved = chance[i] + go * w
            chance[i] = 0.0 if moved < 1e-9 else 1.0 if moved > 1.0 - 1e-9 else moved
        open_ = [i for i in open_ if 0.0 < chance[i] < 1.0]
    return chance


def land(size: list[float], chance: list[float]) -> list[float]:
    """Round the last fractions to whole values, whose sums of sizes and then of rows come nearest."""
    open_ = [i for i, p in enumerate(chance) if 0.0 < p < 1.0]
    tokens, rows = sum(size[i] * chance[i] for i in open_), sum(chance[i] for i in open_)
    choices = [[n >> k & 1 for k in range(len(open_))] for n in range(1 << len(open_))]
    best = min(choices, key=lambda c: (abs(sum(size[i] * x for i, x in zip(open_, c)) - tokens),
                                       abs(sum(c) - rows), c))
    chance = list(chance)
    for i, x in zip(open_, best):
        chance[i] = float(x)
    return chance


def _fly(level: int, seed: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__order", "__unit", "__h"], kind="stable", ignore_index=True)
        start = _uniform(seed, level, int(rows["__order"].iloc[0]), len(rows))
        draws = np.random.Generator(np.random.PCG64(int(start * 2**53))).random(len(rows)).tolist()
        size, chance = rows["__size"].astype(float).tolist(), rows["__chance"].tolist()
        chance = flight(size, chance, draws.__getitem__)
        rows["__chance"] = land(size, chance) if last else chance
        return rows
    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2,
        seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, and ``__text``, the text's hash) per row of ``docs``.

    ``size`` is the number of words, ``copies`` how often the mix takes the document: 0 to ``most``. The
    words taken of a source come near its target, and so does the number of documents. Rows that agree in
    id, source and text are taken together. A null text has size 0; a null source is a source of its own.
    Documents without words are taken as often as chance has it. Draws depend on the rows' content and
    ``seed`` only, so reruns agree. An empty table gives an empty one. Other columns are left out.
    """
    rows = materialize(docs.select(F.col("doc_id"), F.col("source"), F.xxhash64("text").alias("__text"),
                                   word_count(F.col("text")).alias("size")), "mix-rows")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__rows"))
    counted = materialize(per_source, "mix-sources")
    wanted = targets(counted.select("source", "source_size"), weights, share, float(most)).join(
        counted.select(F.col("source").alias("__s"), "__rows"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = materialize(wanted.withColumn("__sure", F.least(F.floor(rate), F.lit(most)).cast("int"))
                         .withColumn("__rest", F.when(rate < most, rate - F.floor(rate)).otherwise(0.0)), "mix-targets")
    joined = rows.join(wanted.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # One unit for rows that agree, its size times their number.
    unit = ["doc_id", "source", "__text"]
    units = joined.where("__rest > 0").groupBy(*unit).agg(
        (F.first("size") * F.count("*")).alias("__size"), F.first("__rest").alias("__chance"), F.first("__rows").alias("__rows"))
    units = units.select(
        F.col("doc_id").alias("__unit"), F.col("source").alias("__source"), F.col("__text").alias("__h"),
        F.xxhash64("doc_id", "source", "__text", F.lit(seed)).alias("__order"),
        F.col("__size").cast("double").alias("__size"), "__chance", F.col("__rows").cast("long").alias("__rows"))
    most_rows = counted.agg(F.max("__rows")).first()[0] or 0
    decided, level = [], 0
    while True:
        # How many blocks a source still has: each leaves BALANCED fractions at most.
        blocks = F.ceil(F.col("__rows") / F.lit(BLOCK))
        last = most_rows <= BLOCK
        flown = materialize(
            units.withColumn("__block", F.pmod(F.xxhash64("__order", F.lit(level)), blocks).cast("long"))
            .groupBy("__source", "__block").applyInPandas(_fly(level, seed, last), units.withColumn("__block", F.lit(0).cast("long")).schema)
            .drop("__block"), "mix-flight")
        whole = F.col("__chance").isin(0.0, 1.0)
        decided.append(flown.where(whole))
        if last:
            break
        units = flown.where(~whole).withColumn("__rows", F.ceil(F.col("__rows") / F.lit(BLOCK)) * BALANCED)
        most_rows, level = -(-most_rows // BLOCK) * BALANCED, level + 1
    drawn = decided[0]
    for more in decided[1:]:
        drawn = drawn.union(more)
    drawn = drawn.select("__unit", "__source", "__h", F.col("__chance").cast("int").alias("__extra"))
    same = (F.col("doc_id").eqNullSafe(F.col("__unit")) & F.col("source").eqNullSafe(F.col("__source"))
            & (F.col("__text") == F.col("__h")))
    return joined.join(drawn, same, "left").select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("__sure") + F.coalesce("__extra", F.lit(0))).alias("copies"), "__text")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, each as often as it is taken; all columns of ``docs``."""
    taken = mix(docs, **how).where("copies > 0").select(
        F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("__text").alias("__t"),
        F.col("copies").alias("__copies")).distinct()
    found = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s"))
                      & (F.xxhash64("text") == F.col("__t")))
    return found.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
