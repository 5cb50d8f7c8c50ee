"""Hard negatives of labelled vectors by exact integer scores, many candidates to a multiplication.

Components become integers. A block of candidates is packed component by component: the block's
values of one component, made non-negative by a bias, stand in separate fields of one wide integer.
An anchor multiplies that integer by its own (biased) component and adds up over the components; a
field then holds the anchor's whole inner product with one candidate, too small to run into the next.
Taking the biases' share off again gives the exact scores.

Anchors and candidates are cut into blocks, and every block of anchors meets every block of candidates
in a cell of its own. A first pass scores the candidates of an anchor's label and keeps its positives, a
second one those of other labels, for the negatives of each positive; each cell keeps its best only.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm.shared import hash128, materialize

#: Components of a block of candidates and of one of anchors: 8,192 and 2,048 vectors of 64 dimensions.
CANDIDATES, ANCHORS = 2**19, 2**17
#: Candidates that are packed into one wide integer.
FIELDS = 1_024
#: Least number of candidate blocks, so that small tables are spread over tasks too.
SPREAD = 16
#: Squared length up to which all scores surely fit a long.
LONGEST = 2.0**62
SCALE = 256



def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, in double precision."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(df: DataFrame, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, values, key) of the rows that take part, equal rows once; see ``mine``."""
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(2.0**31)))
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.pow(F.abs(x) * F.lit(float(scale)) + 1.0, 2.0))
    rows = (df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                      F.col(vector).cast("array<double>").alias("v"))
            .where("vec_id is not null and label is not null and v is not null").where(finite).where(square < LONGEST)
            .select("vec_id", "label", scaled(F.col("v"), scale).alias("values")))
    h1, h2 = hash128("vec_id", "label", F.size("values"), "values")
    return rows.withColumn("h1", h1).withColumn("h2", h2).dropDuplicates(["h1", "h2"])


class Packed:
    """Candidates of a block, packed FIELDS at a time, that answer with exact scores."""

    def __init__(self, values: np.ndarray, most: int) -> None:
        """``most`` is the largest biased component any anchor has."""
        self.bias = int(values.min(initial=0))
        raised = values - self.bias
        self.sums = raised.sum(axis=1).astype(np.uint64)
        need = (values.shape[1] * most * int(raised.max(initial=0))).bit_length()
        # A field is as wide as the largest sum: 32 bits, or whole 64-bit words of which the lowest is enough.
        self.word, self.words = (np.dtype("<u4"), 1) if need <= 32 else (np.dtype("<u8"), -(-need // 64))
        self.packs = []
        for at in range(0, len(values), FIELDS):
            some = raised[at:at + FIELDS]
            fields = np.zeros((some.shape[1], len(some), self.words), self.word)
            fields[:, :, 0] = some.T
            self.packs.append((len(some), [int.from_bytes(column.tobytes(), "little") for column in fields]))

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """Inner products of ``anchor`` with all candidates, in their order."""
        low = int(anchor.min(initial=0))
        raised = [int(x) - low for x in anchor]
        found = []
        for size, components in self.packs:
            total = sum(map(mul, raised, components))
            fields = np.frombuffer(total.to_bytes(size * self.words * self.word.itemsize, "little"), self.word)
            found.append(fields[::self.words].astype(np.uint64))
        # sum(a * c) = sum(a' * c') + low * sum(c') + bias * sum(a), modulo 2^64, and it fits a long.
        off = self.sums * np.uint64(low % 2**64) + np.uint64(self.bias * int(sum(map(int, anchor))) % 2**64)
        return ((np.concatenate(found) if found else np.zeros(0, np.uint64)) + off).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` of ``rows`` with the highest scores, ties by smaller id."""
    if len(rows) > 4 * count:
        cut = np.partition(scores[rows], len(rows) - count)[len(rows) - count]
        rows = rows[scores[rows] >= cut]
    return rows[np.lexsort((ids[rows], -scores[rows]))][:count]


def _blocks(rows: DataFrame, groups: int, columns: list[str], name: str) -> DataFrame:
    """A row per block: equal numbers of components, ``groups`` blocks by hash, and the columns as lists."""
    return (rows.groupBy(F.size("values").alias("size"), F.pmod("h1", F.lit(groups)).alias(name))
            .agg(F.collect_list(F.struct("vec_id", "label", "h1", "h2", "values", *columns)).alias("rows")))


def _matrix(rows: pa.StructArray, size: int) -> np.ndarray:
    return np.asarray(rows.field("values").flatten(), np.int64).reshape(len(rows), size)


def _longs(rows: pa.StructArray, name: str) -> np.ndarray:
    return np.asarray(rows.field(name), np.int64)


def _cells(candidates: DataFrame, anchors: DataFrame, groups: int, anchor_groups: int) -> DataFrame:
    """Each block of candidates beside each of anchors with as many components."""
    many = candidates.select("size", "g", F.col("rows").alias("candidates"),
                             F.explode(F.sequence(F.lit(0).cast("long"), F.lit(anchor_groups - 1).cast("long"))).alias("h"))
    few = anchors.select("size", "h", F.col("rows").alias("anchors"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    return many.join(few.hint("shuffle_merge"), ["size", "g", "h"]).select("size", "candidates", "anchors")


def _cell_rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for n in range(batch.num_rows):
            yield (batch.column("size")[n].as_py(), batch.column("candidates")[n].values, batch.column("anchors")[n].values)


def _positives(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, candidates, anchors in _cell_rows(batches):
            labels, ids, values = _longs(candidates, "label"), _longs(candidates, "vec_id"), _matrix(candidates, size)
            wanted, own, queries = _longs(anchors, "label"), _longs(anchors, "vec_id"), _matrix(anchors, size)
            most = int((queries - queries.min(axis=1, initial=0, keepdims=True)).max(initial=0))
            found = {"anchor": [], "score": [], "row": []}
            for label in np.unique(wanted):
                rows = np.flatnonzero(labels == label)
                if not len(rows):
                    continue
                packed = Packed(values[rows], most)
                for n in np.flatnonzero(wanted == label):
                    scores = packed.scores(queries[n])
                    best = _best(scores, ids[rows], np.flatnonzero(ids[rows] != own[n]), count)
                    found["anchor"].append(np.full(len(best), n))
                    found["score"].append(scores[best])
                    found["row"].append(rows[best])
            found = {name: np.concatenate(parts) if parts else np.zeros(0, np.int64) for name, parts in found.items()}
            yield pa.RecordBatch.from_pydict({
                "h1": _longs(anchors, "h1")[found["anchor"]], "h2": _longs(anchors, "h2")[found["anchor"]],
                "positive_id": ids[found["row"]], "positive_score": found["score"],
                "p1": _longs(candidates, "h1")[found["row"]], "p2": _longs(candidates, "h2")[found["row"]]})
    return run


def _negatives(count: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, candidates, anchors in _cell_rows(batches):
            labels, ids = _longs(candidates, "label"), _longs(candidates, "vec_id")
            wanted, queries = _longs(anchors, "label"), _matrix(anchors, size)
            packed = Packed(_matrix(candidates, size), int((queries - queries.min(axis=1, initial=0, keepdims=True)).max(initial=0)))
            found = {"anchor": [], "positive": [], "score": [], "row": []}
            for n, positives in enumerate(anchors.field("positives")):
                scores = packed.scores(queries[n])
                other = np.flatnonzero(labels != wanted[n])
                inner = scores[other]
                for place, positive in enumerate(positives.as_py()):
                    # low * p <= 100 * s <= high * p, as bounds of s: no product of s leaves a long.
                    least, greatest = -(-low * positive["positive_score"] // 100), high * positive["positive_score"] // 100
                    best = _best(scores, ids, other[(inner >= least) & (inner <= greatest)], count)
                    found["anchor"].append(np.full(len(best), n))
                    found["positive"].append(np.full(len(best), place))
                    found["score"].append(scores[best])
                    found["row"].append(best)
            found = {name: np.concatenate(parts) if parts else np.zeros(0, np.int64) for name, parts in found.items()}
            yield pa.RecordBatch.from_pydict({
                "h1": _longs(anchors, "h1")[found["anchor"]], "h2": _longs(anchors, "h2")[found["anchor"]],
                "place": found["positive"], "negative_id": ids[found["row"]], "negative_score": found["score"],
                "n1": _longs(candidates, "h1")[found["row"]], "n2": _longs(candidates, "h2")[found["row"]]})
    return run


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """Negatives a little less alike than each positive, for the rows where ``anchor`` (over vec_id, label) holds.

    A row's score is its inner product with the anchor after every component x became floor(scale * x).
    An anchor's positives are the ``positives`` other rows of its label with the highest scores; the
    negatives of a positive the ``negatives`` rows of other labels with the highest scores s for which
    low * p <= 100 * s <= high * p, p being the positive's score. Ties go to the smaller vec_id, then to a hash.
    Fewer rows than asked for give all there are; a positive without negatives gives no row.

    No part take rows whose vec_id, label or vector is null, or with a null or non-finite component. Neither do
    vectors so long that scores may leave a long (2^31 in a component, 2^62 in the squared length after
    scaling). Only rows with equally many components meet. Equal rows count once; of rows that share a
    vec_id but nothing else each counts, and none meets the others as its positive. Other columns aren't read.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score, and anchor_hash, which
    tells anchors of one vec_id apart, and positive_rank.
    """
    kept = materialize(usable(rows, vector, label, scale), "vectors")
    kept = kept.withColumn("anchor", F.coalesce(anchor, F.lit(False)))
    # Sums of two columns come to the driver: they say how many blocks there are.
    total, asked = kept.agg(F.coalesce(F.sum(F.size("values") + 8), F.lit(0)),
                            F.coalesce(F.sum(F.when(F.col("anchor"), F.size("values") + 8)), F.lit(0))).first()
    groups, anchor_groups = max(SPREAD, -(-total // CANDIDATES)), max(1, -(-asked // ANCHORS))
    candidates = materialize(_blocks(kept, groups, [], "g"), "candidates")
    chosen = kept.where("anchor")

    found = _cells(candidates, _blocks(chosen, anchor_groups, [], "h"), groups, anchor_groups).mapInArrow(
        _positives(positives), "h1 long, h2 long, positive_id long, positive_score long, p1 long, p2 long")
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("positive_score"), "positive_id", "p1", "p2")
    best = (found.withColumn("positive_rank", F.row_number().over(order)).where(F.col("positive_rank") <= positives)
            .groupBy("h1", "h2")
            .agg(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score"))).alias("positives")))
    asking = materialize(chosen.join(best, ["h1", "h2"]), "anchors")

    found = _cells(candidates, _blocks(asking, anchor_groups, ["positives"], "h"), groups, anchor_groups).mapInArrow(
        _negatives(negatives, low, high), "h1 long, h2 long, place long, negative_id long, negative_score long, n1 long, n2 long")
    order = Window.partitionBy("h1", "h2", "place").orderBy(F.desc("negative_score"), "negative_id", "n1", "n2")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    positive = F.get("positives", F.col("place").cast("int"))
    return ranked.join(asking.select("h1", "h2", F.col("vec_id").alias("anchor_id"), "positives"), ["h1", "h2"]).select(
        "anchor_id", positive["positive_id"].alias("positive_id"), "rank", "negative_id",
        positive["positive_score"].alias("positive_score"), "negative_score",
        positive["positive_rank"].alias("positive_rank"), F.col("h1").alias("anchor_hash"))
