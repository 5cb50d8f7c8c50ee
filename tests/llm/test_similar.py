"""Near copies by shingle overlap, against all pairs."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as cp
from flowlens.llm import similar, simhash


def edited(rng, words, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"edit{rng.randrange(10 ** 9)}"
    return " ".join(words)


def first_of_groups(rows, least=0.8):
    sets = {d: similar.word_shingles(t) for d, t in rows}
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                alike = len(x & y) >= least * len(x | y) if x or y else True
                if alike and label[b] < label[a]:
                    label[a], changed = label[b], True
    return {d for d in label if label[d] == d}


def test_planted_edited_copies_go(spark, documents):
    rng = random.Random(6)
    rows, wide = [], 0
    for n in range(60):
        words = [f"w{rng.randrange(5_000)}" for _ in range(200 + 7 * n)]
        rows += [(100 * n, " ".join(words)), (100 * n + 1, edited(rng, words, len(words) // 80)),  # about 0.9
                 (100 * n + 2, edited(rng, words, len(words) // 16))]  # about 0.5
        wide += (simhash.text_fingerprint(rows[-3][1]) ^ simhash.text_fingerprint(rows[-2][1])).bit_count() > 4
    centre = [f"c{n}" for n in range(300)]  # a family over one key's size, each edited by itself
    rows += [(10_000 + n, edited(rng, centre, 1 + n % 5)) for n in range(80)]
    rows += [(20_000, None), (20_001, ""), (20_002, "a B c"), (20_003, "A b  c"), (20_003, "A b  c")]
    expected = first_of_groups(rows)
    assert wide > 20 and {100 * n + 1 for n in range(60)} & expected == set()
    docs = documents(*rows, (None, "a b c"), (None, None))
    kept = cp.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(expected)
    assert kept.where("doc_id is null").count() == 2
    assert cp.drop_near_duplicates(spark, documents(), "").count() == 0


def test_a_key_gives_a_forest():
    sign = np.array([[1] * 96, [1] * 90 + [2] * 6, [3] * 96, [3] * 70 + [4] * 26], np.uint8)
    assert similar.forest(sign, np.arange(4), 76.8) == [(0, 1)]
    assert similar.forest(sign, np.arange(4), 57) == [(0, 1), (2, 3)]
    assert len(similar.forest(np.ones((3_000, 96), np.uint8), np.arange(3_000), 57)) == 2_999


def test_cells_compare_by_shingles():
    texts = ["a b c d e f g h i j", "a b c d e f g h i k", "a b c d e f g h i j x", "", None, "q r s t u v"]
    sign = np.ones((6, 96), np.uint8)
    found = similar.links(texts, sign, 5, 0.8, 57)
    assert [(int(a), int(b)) for a, b in found] == [(0, 2)]  # 5 of 7 shingles are too few, 6 of 7 enough
    cell = similar.Shingled(texts, 5)
    for a in (0, 1, 2, 5):
        others = np.array([n for n in (0, 1, 2, 5) if n != a])
        assert cell.similarities(a, others).tolist() == [similar.similarity_of(texts[a], texts[n]) for n in others]


def test_a_family_just_under_the_threshold(spark, documents, monkeypatch):
    """Copies that link with a few others each: all links are found over many blocks, and no step gives all pairs."""
    monkeypatch.setattr(similar, "BLOCK_TEXTS", 40)
    rng = random.Random(9)
    centre = [f"c{n}" for n in range(120)]
    rows = [(n, edited(rng, centre, rng.choice([1, 2, 2, 3]))) for n in range(300)]
    sets = {d: similar.word_shingles(t) for d, t in rows}
    linked = sum(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in sets for b in sets if a < b)
    assert 0 < linked < 300 * 299 / 2 * 0.9
    edges = [tuple(r) for r in similar.similar_edges(documents(*rows)).collect()]
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in edges)
    kept = {r["doc_id"] for r in similar.keep_first_similar(documents(*rows)).collect()}
    assert kept == first_of_groups(rows)
    assert len(edges) < 300 * 2 * 10  # a forest a cell


def test_simhash_finds_candidates_without_any_band(spark, documents, monkeypatch):
    """What SimHash links is confirmed on the shingles; a text that only repeats one line of another is not alike."""
    one = similar._sketch

    def no_bands(words):
        def run(batches):
            for batch in one(words)(batches):
                yield batch.set_column(3, "keys", pa.array([[]] * len(batch), pa.list_(pa.int64())))
        return run
    monkeypatch.setattr(similar, "_sketch", no_bands)
    rng = random.Random(3)
    words = [f"w{n}" for n in range(600)]
    rows = [(1, " ".join(words)), (2, edited(rng, words, 1)), (3, "same " * 3_000 + "a b c d e f"), (4, "same " * 3_000 + "g h i j k l")]
    prints = [simhash.text_fingerprint(t) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= similar.BITS and prints[2] == prints[3]
    kept = similar.keep_first_similar(documents(*rows)).collect()
    assert {r["doc_id"] for r in kept} == {1, 3, 4} == first_of_groups(rows)
