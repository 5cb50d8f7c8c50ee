"""Rank-file encoding against the library's own call on uncut texts and against a plain merge loop."""

import hashlib

import pytest
import regex
from hypothesis import given, settings, strategies as st

from flowlens.llm import queries, rank_bpe as bpe

ENCODING = bpe.load(bpe.public_ranks(), bpe.public_pattern())
TABLE = ENCODING._mergeable_ranks


def merged(text):
    """Ids by the definition: the pair of lowest rank first, match by match."""
    out = []
    for match in regex.findall(bpe.public_pattern(), text):
        parts = [bytes([b]) for b in match.encode()]
        while len(parts) > 1:
            ranked = [(TABLE.get(a + b, 1 << 30), n) for n, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, n = min(ranked)
            if rank == 1 << 30:
                break
            parts[n:n + 2] = [parts[n] + parts[n + 1]]
        out += [TABLE[p] for p in parts]
    return out


WORDS = st.sampled_from(["it's", "'s", "'", "we'll", "Straße", "中文", "русский", "12", "٣", "a1b2", "!?", "▁", "é", "🙂🙃", "½", "Ⅷ", "²3",
                         "<|endoftext|>", "_x", "-", "\x1c", "\x00", "ﬁ", "á"])
SPACES = st.sampled_from(["", " ", "  ", "\n", "\r\n", "\t\t", "\xa0", "\u3000 ", "\u2028" * 260, " " * 300, "\n" * 257 + " ", " " * 256])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(WORDS, SPACES), max_size=40))
def test_cut_texts_have_the_ids_of_whole_ones(parts):
    text = "".join(a + b for a, b in parts)
    assert bpe.encode_text(ENCODING, text, chunk=8) == ENCODING.encode_ordinary(text)
    assert "".join(bpe.safe_pieces(text, 8)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=400))
def test_any_text(text):
    found = bpe.encode_text(ENCODING, text, chunk=4)
    assert found == ENCODING.encode_ordinary(text)
    assert ENCODING.decode_bytes(found) == text.encode()


def test_matches_the_definition():
    for text in ("", " ", "The it's 1234!? \n\n  x", "naïve 中文  　y'll", "aaaa" * 30 + "   ", "\t\t \n z"):
        assert bpe.encode_text(ENCODING, text) == merged(text)


@pytest.mark.parametrize("text", ["a" * 1_000_000, " " * 1_000_000, " " * 999_999 + "x", "\n" * 500_000 + " y ", "word 7 " * 200_000,
                                  "中" * 300_000, "!?" * 300_000])
def test_very_long_texts_round_trip(text):
    assert ENCODING.decode_bytes(bpe.encode_text(ENCODING, text)) == text.encode()


def test_pieces_are_bounded():
    assert max(map(len, bpe.safe_pieces("word, and 12 more\n" * 50_000))) <= bpe.CHUNK


def test_rows(spark, documents):
    texts = [None, "", "it's  here", "it's  here", "x " * 50_000, " " * 400]
    frame = documents(*enumerate(texts))
    frame = frame.withColumnsRenamed({"lang": "data", "source": "c0"})
    out = bpe.decode(bpe.encode(frame, into="n_chars"), "n_chars")
    assert out.columns == ["doc_id", "text", "c0", "n_chars", "data"]
    for row in out.collect():
        assert row["n_chars"] == ENCODING.encode_ordinary((texts[row["doc_id"]] or "")[:300]) or len(texts[row["doc_id"]]) > 300
        assert bytes(row["data"]).decode() == (texts[row["doc_id"]] or "") and row["c0"] == "s"
    assert bpe.encode(documents()).count() == 0
    odd = spark.createDataFrame([(1, [40, None]), (2, None)], "k int, ids array<int>")
    assert [bytes(r["data"]) for r in bpe.decode(odd).orderBy("k").collect()] == [ENCODING.decode_bytes([40]), b""]
    repeated = spark.createDataFrame([("a", 1, 2)], ["text", "n", "m"]).toDF("text", "n", "n")
    assert bpe.encode(repeated).columns == ["text", "n", "n", "ids"]


def test_query(spark, tables):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    found = queries.op11_rank_bpe(spark, tables).collect()
    assert len(found) == len(texts)
    for row in found:
        ids = ENCODING.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()
