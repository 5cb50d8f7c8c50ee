"""Drop lines that many documents share, with DataFrame functions only.

Lines are exploded as hashes of their normalised form, documents are counted per hash,
and each document then loses the positions whose hash is over the threshold. No line's
text is shuffled on its own: the first shuffles carry 24 bytes a line, the last one joins
each document with its list of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.shared import SPACES, fold_case, hash128, materialize


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A to Z in lower case."""
    return fold_case(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text`` without its shared lines, and ``n_lines``, ``n_dropped``.

    A line is dropped if its key has at least ``min_chars`` code points, is found in at least
    ``min_docs`` documents, and this is not the largest ``doc_id`` holding it (there all its
    lines stay). A null or empty text is one empty line and becomes ''. Documents are told
    apart by ``doc_id``, so repeated rows count once and are treated alike; rows without
    ``doc_id`` count as no document and keep all lines. An empty table gives an empty one.
    Other columns are kept as they are, but for earlier ``n_lines`` and ``n_dropped``, which
    are replaced.
    """
    text = F.col("text")
    # A row is found again by its id and text, so repeated ids with other texts stay apart.
    row = [F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text")]
    long_line = F.length("__key") >= min_chars
    lines = (docs.where("doc_id is not null")
             .select(*row, F.posexplode(_lines(text)).alias("__at", "__line"))
             .select("__id", "__text", "__at", line_key(F.col("__line")).alias("__key"))
             .where(long_line)
             .select("__id", "__text", "__at", *hash128("__key")))
    lines = materialize(lines, "lines")  # texts are split and hashed once, not for every use below
    # Rows come first, because they need one small shuffle; documents are then counted
    # exactly, but only for the few keys that have enough rows.
    frequent = lines.groupBy("__h1", "__h2").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_docs)
    # Both small sides are written, so that their joins stand right on exchanges, where adaptive
    # execution can split a very common line's rows among tasks.
    frequent = materialize(frequent, "frequent-lines")
    holders = lines.join(frequent.select("__h1", "__h2"), ["__h1", "__h2"]).select("__h1", "__h2", "__id").distinct()
    shared = (holders.groupBy("__h1", "__h2").agg(F.count("*").alias("__docs"), F.max("__id").alias("__last"))
              .where(F.col("__docs") >= min_docs).select("__h1", "__h2", "__last"))
    shared = materialize(shared, "shared-lines")
    dropped = (lines.join(shared, ["__h1", "__h2"]).where(F.col("__id") != F.col("__last"))
               .groupBy("__id", "__text").agg(F.collect_set("__at").alias("__drop")))
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    joined = (docs.select(*others, "text", *row)
              .join(dropped.withColumnsRenamed({"__id": "__d", "__text": "__t"}),
                    (F.col("__id") == F.col("__d")) & (F.col("__text") == F.col("__t")), "left")
              .withColumn("__all", _lines(text)))
    places = F.sequence(F.lit(0), F.size("__all") - 1)
    # array_except works on a hash set of integers and keeps the order of its first argument.
    kept = F.transform(F.array_except(places, "__drop"), lambda i: F.get("__all", i))
    result = joined.withColumn("__kept", F.when(F.col("__drop").isNull(), F.col("__all")).otherwise(kept))
    return result.select(
        *others, F.concat_ws("\n", "__kept").alias("text"), F.size("__all").cast("long").alias("n_lines"),
        (F.size("__all") - F.size("__kept")).cast("long").alias("n_dropped"))
