"""Alignments against a plain loop over both tokenizers' outputs."""

import hashlib
from collections import Counter

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from flowlens.llm import queries, token_alignment as ta
from flowlens.llm.shared import materialize

A_FILE, B_FILE = ta.public_files()


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B_FILE)


def plain(models, texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) per text, by definition."""
    a_model, b_model = models
    letters = ta.byte_letters()
    groups, links = [], []
    for text in texts:
        groups.append([])
        links.append([])
        if not text:
            continue
        a = a_model.encode(" " + text, add_special_tokens=False).ids
        b = b_model.encode(text)
        spell_a = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        spell_b = [bytes([int(p[3:-1], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()
                   for i in b for p in [b_model.id_to_piece(i)]]
        if b"".join(spell_a) != (" " + text).encode() or b"".join(spell_b) != (" " + text).encode():
            continue
        ends_a, ends_b, at = {}, {}, 0
        for n, s in enumerate(spell_a):
            at += len(s)
            ends_a[at] = n
        at = 0
        for n, s in enumerate(spell_b):
            at += len(s)
            ends_b[at] = n
        x = y = 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            groups[-1].append((a[x:ends_a[end] + 1], b[y:ends_b[end] + 1]))
            x, y = ends_a[end] + 1, ends_b[end] + 1
            links[-1].append((a[x - 1], b[y - 1]))
    counts = Counter(p for row in links for p in row)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for row, found in zip(groups, links):
        out.append((sum(len(a) for a, _ in row), sum(len(b) for _, b in row), len(row), len(found),
                    sum(counts[p] == top[p[1]] for p in found), sum(counts[p] for p in found),
                    ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in row)))
    return out


def rated(docs, **how):
    rows = ta.rate(materialize(ta.align(docs, **how), "aligned"))
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1,
                   tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"))) for r in rows.collect())


TEXTS = ["The quick brown fox", "the the the", None, "", " ", "\n", "  two  spaces ", "naïve Straße 中文 🙂 русский", "a\x00b\tc\r\n",
         "▁ spelled otherwise", "<s> <unk> <0x41> <|endoftext|> </s>", "it's 12345!!", "word " * 30_000, "x" * 5_000, "The quick brown fox",
         "é", "ﬁ ½ Ⅷ", "　", "[INST] \\n"]


@pytest.mark.parametrize("block", [1, 64, ta.BLOCK])
def test_matches_the_definition(spark, documents, models, block):
    found = rated(documents(*enumerate(TEXTS)).repartition(3), block=block, step=40)
    assert found == list(enumerate(plain(models, TEXTS)))
    assert sum(row[1][0] == 0 for row in found) == 3  # null, empty, and the one with U+2581


def test_odd_tables(spark, documents, models):
    assert rated(documents()) == []
    assert [r[1] for r in rated(documents((None, None), (1, "")))] == [(0, 0, 0, 0, 0, 0, "")] * 2
    twice = documents((1, "same text"), (1, "same text"), (None, "same text")).withColumnsRenamed(
        {"lang": "block", "source": "links", "n_chars": "part"})
    expected = plain(models, ["same text"] * 3)
    assert [r[1] for r in rated(twice)] == expected


def test_pair_counts(spark, documents):
    aligned = materialize(ta.align(documents(*[(n, "one two") for n in range(40)]).repartition(4)), "aligned")
    pairs = ta.pair_counts(aligned).collect()
    assert {(r["count"], r["best"]) for r in pairs} == {(40, True)} and len(pairs) == 2


def test_query(spark, tables, models):
    rows = spark.read.parquet(f"{tables}/documents.parquet").orderBy("doc_id").collect()
    expected = plain(models, [r["text"] for r in rows])
    found = {r["doc_id"]: r for r in queries.op13_token_alignment(spark, tables).collect()}
    assert len(found) == len(rows)
    for row, (*numbers, groups) in zip(rows, expected):
        got = found[row["doc_id"]]
        assert [got[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] == numbers
        assert got["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
