"""Expressions that turn model output into an alert: type, flag, severity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowlens.schemas import SEVERITY_POLICIES

NO_MODEL = -1.0


def attack_type(prediction: Column, class_names: dict[int, str]) -> Column:
    """Name of the predicted class; ids outside the list, -1 and null are Unknown."""
    pairs = [F.lit(v) for class_id, name in class_names.items() for v in (float(class_id), name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), prediction.cast("double")), F.lit("Unknown"))


def is_attack(prediction: Column) -> Column:
    return F.coalesce(prediction == F.lit(1.0), F.lit(False))


def severity(attack_type_column: Column, attack_flag: Column, policy="default") -> Column:
    """Level of the first list naming the type, else the fallback for attacks, else NONE.

    ``policy`` is a key of ``SEVERITY_POLICIES`` or a dictionary of the same form.
    """
    rules = SEVERITY_POLICIES[policy] if isinstance(policy, str) else policy
    tests = [F.when(attack_type_column.isin(types), F.lit(level)) for level, types in rules["levels"]]
    return F.coalesce(*tests, F.when(attack_flag, F.lit(rules["fallback"])), F.lit("NONE"))


def cascade(binary: Column, multiclass: Column) -> Column:
    """Second-stage class, forced to 0 where the first stage says normal."""
    return F.when(binary == F.lit(0.0), F.lit(0.0)).otherwise(multiclass)
