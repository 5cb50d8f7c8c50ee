"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine c are at most eps = sqrt(2 - 2c) apart, and so are their projections.
Vectors of a label are sorted by the grid cells, eps wide, of their leading principal dimensions
and cut into blocks. Blocks are joined with blocks whose first cell is the same or next; pairs
of blocks whose boxes are more than eps apart are skipped, and a pair that is left is split in
halves again and again, skipping distant halves, until the rest is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.shared import components, hash128, materialize

#: Vectors that the principal dimensions are fitted on, the first in the order of a hash of their ids.
SAMPLE = 4_096
LEADING = 8
#: Vectors of a block, and of the pieces that are compared without further splitting.
BLOCK, LEAF = 256, 64
#: Cells and boxes are this much wider, for rounding.
SLACK = 1e-6


def _unit(values: np.ndarray) -> np.ndarray:
    wide = values.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def principal_axes(sample: np.ndarray, leading: int = LEADING) -> np.ndarray:
    """Directions of largest variance, one a column. Any would give the same links."""
    centred = sample - sample.mean(axis=0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return axes[:, ::-1][:, :leading]


def _project(axes: dict[int, np.ndarray], cell: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, places = [], []
            for vector in batch.column("vector"):
                values = np.array(vector.as_py(), np.float64)[None, :]
                place = (_unit(values) @ axes[values.shape[1]])[0]
                places.append(place)
                cells.append(np.floor(place / cell).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("rep", "n", "group", "vector")]
                + [pa.array(cells, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.float64()))],
                names=["rep", "n", "group", "vector", "cells", "place"])
    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut sorted rows into blocks of one group."""
    schema = pa.schema([("block", pa.int64()), ("group", pa.string()), ("first", pa.int64()), ("last", pa.int64()),
                        ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
                        ("reps", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("places", pa.binary()),
                        ("vectors", pa.binary())])

    def out(rows):
        places = np.array([r["place"] for r in rows])
        vectors = np.array([r["vector"] for r in rows], np.float64)
        reps = [r["rep"] for r in rows]
        name = xxhash.xxh64_intdigest(vectors.tobytes(), 0) ^ xxhash.xxh64_intdigest(rows[0]["group"], 1)
        return pa.RecordBatch.from_pylist([{
            "block": name - (1 << 63), "group": rows[0]["group"], "first": rows[0]["cells"][0], "last": rows[-1]["cells"][0],
            "low": places.min(axis=0).tolist(), "high": places.max(axis=0).tolist(), "reps": reps,
            "copies": [r["n"] for r in rows], "places": places.tobytes(), "vectors": vectors.tobytes()}], schema)

    rows: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and (len(rows) == BLOCK or row["group"] != rows[0]["group"]):
                yield out(rows)
                rows = []
            rows.append(row)
    if rows:
        yield out(rows)


def _apart(low_a, high_a, low_b, high_b) -> float:
    gap = np.maximum(0.0, np.maximum(low_b - high_a, low_a - high_b))
    return float((gap * gap).sum())


def linked(units_a: np.ndarray, places_a: np.ndarray, units_b: np.ndarray, places_b: np.ndarray,
           cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of linked vectors; in the pair of a block with itself each pair once."""
    limit = 2.0 - 2.0 * cosine + SLACK
    todo = [(0, len(units_a), 0, len(units_b))]
    while todo:
        a, a_end, b, b_end = todo.pop()
        if same and a >= b_end:
            continue
        pa_, pb = places_a[a:a_end], places_b[b:b_end]
        if _apart(pa_.min(axis=0), pa_.max(axis=0), pb.min(axis=0), pb.max(axis=0)) > limit:
            continue
        if max(a_end - a, b_end - b) > LEAF:
            a_mid, b_mid = (a + a_end + 1) // 2, (b + b_end + 1) // 2
            todo += [(x, y, z, w) for x, y in ((a, a_mid), (a_mid, a_end)) for z, w in ((b, b_mid), (b_mid, b_end))
                     if x < y and z < w]
            continue
        i, j = np.nonzero(units_a[a:a_end] @ units_b[b:b_end].T >= cosine)
        i, j = i + a, j + b
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph on 0 to n - 1."""
    parent, kept = list(range(n)), []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = a, b
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _compare(cosine: float):
    schema = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("copies", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n] for name in batch.schema.names}
                side = []
                for s in ("a", "b"):
                    reps = np.array(row[f"reps_{s}"].as_py())
                    units = _unit(np.frombuffer(row[f"vectors_{s}"].as_buffer()).reshape(len(reps), -1))
                    side.append((reps, np.array(row[f"copies_{s}"].as_py()), units,
                                 np.frombuffer(row[f"places_{s}"].as_buffer()).reshape(len(reps), -1)))
                (reps_a, copies_a, units_a, places_a), (reps_b, copies_b, units_b, places_b) = side
                same = row["block_a"].equals(row["block_b"])
                links = [np.zeros(len(reps_a), np.int64), np.zeros(len(reps_b), np.int64)]
                left, right = [], []
                for i, j in linked(units_a, places_a, units_b, places_b, cosine, same):
                    links[0] += np.bincount(i, copies_b[j], len(reps_a)).astype(np.int64)
                    links[1] += np.bincount(j, copies_a[i], len(reps_b)).astype(np.int64)
                    left.append(i)
                    right.append(j)
                if not left:
                    continue
                i, j = np.concatenate(left), np.concatenate(right)
                shift = 0 if same else len(reps_a)
                forest = _forest(i, j + shift, shift + len(reps_b))
                # Links are counted here, so a row per vector leaves, not one per link.
                rows = [{"rep": int(r), "other": None, "copies": int(c)} for reps, count in zip((reps_a, reps_b), links)
                        for r, c in zip(reps, count) if c]
                rows += [{"rep": int(reps_a[a]), "other": int(reps_b[b - shift]), "copies": 0} for a, b in forest]
                yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def usable(vector: Column) -> Column:
    """Not null, not empty, not all zero, and no null or non-finite component."""
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector.

    Vectors are linked if their labels are equal and not null, they have as many components, and their
    cosine, in double precision, is at least ``cosine``. ``n_links`` counts the other vectors linked
    directly, ``component_id`` is the smallest ``vec_id`` that links lead to, ``kept`` says that it is
    the vector's own. Null vectors, zero vectors and those with null or non-finite components link with
    nothing. Repeated rows of an id are one vector if label and components agree, else one each; a row
    without ``vec_id`` links with nothing and has no component. An empty table gives an empty one. Other
    columns are left out.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    rows = rows.select("vec_id", "label", *hash128("vector"), "vector",
                       (usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).alias("__ok"))
    key = ["label", "__h1", "__h2"]
    single = materialize(rows.groupBy("vec_id", *key, "__ok").agg(F.first("vector").alias("vector")), "vectors")
    # Equal vectors are one, with a number of copies.
    distinct = materialize(
        single.where("__ok").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"),
                                               F.first("vector").alias("vector"))
        .withColumn("group", F.concat_ws("/", F.size("vector").cast("string"), "label")), "distinct-vectors")
    sample = distinct.select("rep", "vector").orderBy(F.xxhash64("rep")).limit(SAMPLE).toArrow()
    fitted: dict[int, list] = {}
    for vector in sample["vector"].to_pylist():
        fitted.setdefault(len(vector), []).append(vector)
    sizes = [r[0] for r in distinct.select(F.size("vector")).distinct().collect()]  # numbers of components
    axes = {d: principal_axes(_unit(np.array(fitted[d], np.float64)) if d in fitted else np.eye(d),
                              min(LEADING, d)) for d in sizes}
    eps = sqrt(2.0 - 2.0 * cosine) + SLACK
    placed = distinct.select("rep", "n", "group", "vector").mapInArrow(
        _project(axes, eps), "rep long, n long, group string, vector array<double>, cells array<long>, place array<double>")
    ordered = placed.repartitionByRange("group", "cells", "rep").sortWithinPartitions("group", "cells", "rep")
    blocks = materialize(ordered.mapInArrow(
        _blocks, "block long, group string, first long, last long, low array<double>, high array<double>, "
                 "reps array<long>, copies array<long>, places binary, vectors binary"), "blocks")
    box = blocks.select("block", "group", "first", "last", "low", "high")
    # Each pair meets once: a block in the cells it covers and the one before them, the other where it begins.
    reach = box.select("group", F.explode(F.sequence(F.col("first"), F.col("last") + 1)).alias("cell"),
                       F.col("block").alias("block_a"), F.col("first").alias("first_a"), F.col("low").alias("low_a"),
                       F.col("high").alias("high_a"))
    begin = box.select("group", F.col("first").alias("cell"), F.col("block").alias("block_b"),
                       F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    gaps = F.zip_with(
        F.zip_with("low_b", "high_a", lambda x, y: x - y), F.zip_with("low_a", "high_b", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    pairs = (reach.join(begin, ["group", "cell"])
             .where((F.col("first_a") < F.col("cell")) | (F.col("block_a") <= F.col("block_b")))
             .where(apart <= 2.0 - 2.0 * cosine + SLACK).select("block_a", "block_b"))
    parts = ["block", "reps", "copies", "places", "vectors"]

    def side(s: str) -> DataFrame:
        return blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in parts])

    compared = (pairs.join(side("a"), "block_a").join(side("b"), "block_b")
                .mapInArrow(_compare(cosine), "rep long, other long, copies long"))
    compared = materialize(compared, "vector-links")
    counts = compared.where("other is null").groupBy("rep").agg(F.sum("copies").alias("links"))
    found = components(compared.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    classes = (distinct.select(*[F.col(c).alias(f"_{c}") for c in key], "rep", "n").join(counts, "rep", "left")
               .join(found, F.col("rep") == F.col("node"), "left")
               .select(*[f"_{c}" for c in key], (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("__links"),
                       F.coalesce("component", "rep").alias("__component")))
    match = F.col("__ok") & (F.col("label") == F.col("_label")) & (F.col("__h1") == F.col("___h1")) & (
        F.col("__h2") == F.col("___h2"))
    component = F.when(F.col("__ok"), F.col("__component")).otherwise(F.col("vec_id"))
    return single.drop("vector").join(classes, match, "left").select(
        "vec_id", F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
