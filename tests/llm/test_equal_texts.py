"""Equal texts share a shard, whatever the size of the table."""

import pytest
from pyspark.sql import functions as F

from flowlens.llm.reshard import reshard


def layout(docs, **how):
    found = reshard(docs, **how).rows.collect()
    place, load = {}, [0] * 8
    for r in found:
        place.setdefault(r["text"], set()).add(r["shard"])
        load[r["shard"]] += len(r["text"].encode()) + 1
    for j in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == j) == list(range(sum(r["shard"] == j for r in found)))
    return place, load


@pytest.mark.parametrize("count, copies", [(10, 2), (200, 2), (200, 15), (10_000, 20), (10_000, 900)])
def test_copies_share_a_shard(documents, count, copies):
    rows = [(n, f"text {n // copies if n < count // 2 else -n} ".ljust(40, "x")) for n in range(count)]
    place, load = layout(documents(*rows))
    assert max(map(len, place.values())) == 1
    assert max(load) - min(load) <= max(2 * 41 * copies, 0.02 * sum(load))


def test_only_texts_larger_than_a_shard_are_cut(documents):
    rows = [(n, "hot ".ljust(40, "x") if n % 3 == 0 else f"text {n % 1_000}".ljust(40, "x")) for n in range(9_000)]
    place, load = layout(documents(*rows))
    assert [t[:4] for t, shards in place.items() if len(shards) > 1] == ["hot "]
    assert max(load) - min(load) < 0.02 * sum(load)
    # Small texts in the block of the hot one stay whole, too: all lie in one old shard.
    place, _ = layout(documents(*rows), old_shard=F.lit(0))
    assert [t[:4] for t, shards in place.items() if len(shards) > 1] == ["hot "]
