"""Label expressions: text normalisation, binary label, label text, class lookup."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters that stand for a dash in label texts, the last one being
# what a wrongly decoded dash turns into.
DASHES = "\u0096\u2010\u2011\u2012\u2013\u2014\u2015\ufffd"


def standard_label(column: Column) -> Column:
    """Lower case, surrounding spaces removed. Only spaces: a tab stays."""
    return F.trim(F.lower(column))


def binary_label(column: Column, normal_values=("benign", "normal")) -> Column:
    """0 for the normal labels in any case, 1 for everything else including null."""
    return F.when(F.lower(column).isin([v.lower() for v in normal_values]), 0).otherwise(1)


def exact_binary_label(column: Column, normal_value) -> Column:
    """Case-sensitive variant: 0 only for the one given value."""
    return F.when(column == F.lit(normal_value), 0).otherwise(1)


def label_text(label: Column, attack_cat: Column) -> Column:
    """Class text of a record carrying a 0/1 label beside its category."""
    return F.when(label == 0, F.lit("normal")).otherwise(attack_cat)


def normal_when_blank(column: Column) -> Column:
    """Trimmed category, with null and blank read as normal traffic."""
    return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit("Normal"))


def match_key(column: Column) -> Column:
    """Label reduced to what two spellings of the same class share."""
    return F.translate(standard_label(column), DASHES, "-" * len(DASHES))


def match_key_text(label: str) -> str:
    """``match_key`` for a constant."""
    return label.lower().strip(" ").translate(str.maketrans(DASHES, "-" * len(DASHES)))


def class_lookup(column: Column, classes: dict[str, int], default: int) -> Column:
    """Class id of a label; unknown and null labels get ``default``.

    The label lists are constants of a few dozen entries, so a literal map in the scan
    stage does it: no join, and the label is normalised once per row.
    """
    ids = {match_key_text(label): class_id for label, class_id in classes.items()}
    table = F.create_map(*[F.lit(v) for entry in ids.items() for v in entry])
    return F.coalesce(F.try_element_at(table, match_key(column)), F.lit(default)).cast("int")
