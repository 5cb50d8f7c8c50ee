"""Decontamination, toxicity, token files and chat formatting."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from flowlens.llm import chat, decontaminate as dc, id_coder, token_ids, toxicity

ITEMS = [(1, "The first question has these many words in it. The answer is nine ten eleven twelve."),
         (2, "another item without any stop but with plenty of words to be found"),
         (3, "What is it?\nIt is a line of words that answers the question above fully"), (4, None), (5, ""), (6, "...")]


def brute(rows, items):
    out = set()
    for doc, text in rows:
        have = dc.shingles(dc.words_of(text))
        for item, words in items:
            if words and dc.words_of(words):
                q, a = (dc.shingles(p) for p in dc.question_and_answer(words))
                if len(q & have) >= dc.OVERLAP * len(q) and len(a & have) >= dc.OVERLAP * len(a):
                    out.add((doc, item))
    return out


def test_leaks_match_brute_force(spark, documents, tables):
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(5)
    for n, (_, text) in enumerate(items):  # cut, changed, shouted and repeated copies
        words = text.split()
        rows += [(5_000 + n, "filler words " * n + " ".join(words).upper() + " more" * n),
                 (6_000 + n, " ".join(words[: len(words) // 2])),
                 (7_000 + n, " ".join(w if rng.random() > 0.03 else "zzz" for w in words) + "\n" + text)]
    frame = spark.createDataFrame(items + ITEMS, "item_id long, text string")
    rows += [(8_000, None), (8_001, ""), (8_002, " ".join(t or "" for _, t in ITEMS)), (5_000, rows[200][1])]
    found = dc.contaminated(documents(*rows).withColumn("item_id", F.lit(0)), frame).collect()
    # Halves of items can reach the shingle test only for items of one short sentence: brute force decides.
    assert {(r["doc_id"], r["item_id"]) for r in found} == brute(rows, items + ITEMS)
    clean = dc.drop_contaminated(documents(*rows), frame)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in brute(rows, items + ITEMS)}


def test_retrieval_matches_exhaustive_scores():
    rng = random.Random(8)
    vocabulary = [f"w{n}" for n in range(60)]
    items = [(n, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 20)))) for n in range(300)]
    index = dc.Index(items, threshold=0.4)
    for _ in range(200):
        terms = sorted({index.term_of[w] for w in rng.choices(vocabulary, k=15) if w in index.term_of})
        scores = {}
        for t in terms:
            for n, x in zip(*index.postings[t]):
                scores[n] = scores.get(n, 0.0) + x
        expected = {n: s for n, s in scores.items() if s >= 0.4 - 1e-9}
        assert dict(index.retrieve(terms)) == pytest.approx(expected)


def test_several_index_passes_and_empty_tables(spark, documents, monkeypatch):
    frame = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents((1, f"x {ITEMS[0][1]} y"), (2, "clean"), (3, ITEMS[2][1]))
    monkeypatch.setattr(dc, "ITEMS_AT_ONCE", 1)
    assert sorted((r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, frame).collect()) == [(1, 1), (3, 3)]
    assert dc.contaminated(docs, frame.limit(0)).count() == 0 and dc.drop_contaminated(docs, frame.limit(0)).count() == 3
    assert dc.contaminated(documents(), frame).count() == 0


def test_toxicity_finds_held_out_words(spark, documents):
    rng = random.Random(4)
    clean, bad = ["river", "stone", "window", "garden", "letter", "music"], ["vilescum", "dumbrot", "nastyfool"]
    rows, labels = [], []
    for n in range(400):
        words = rng.choices(clean, k=rng.randrange(1, 60))
        if n % 4 == 0:
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        rows.append((n, " ".join(words)))
        labels.append((n, 1, int(n % 4 == 0)))
    rows += [(1_000, None), (1_001, ""), (1_002, "vilescum " * 20_000), (None, "river")]
    marked = spark.createDataFrame(labels + [(None, 1, 1), (77, 1, None)], "doc_id long, quality int, toxic int")
    docs = documents(*rows).withColumn("score", F.lit("mine"))
    found = {r["doc_id"]: r for r in toxicity.score_documents(docs, marked).collect()}
    assert all(found[n]["predicted"] == (n % 4 == 0) for n in range(400))
    assert all(r["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0) for d, r in found.items())
    assert found[1_000]["score"] == found[1_001]["score"] < 0.5 < found[1_002]["score"]
    kept = toxicity.drop_toxic(docs, marked)
    assert kept.columns == docs.columns and kept.count() == 303
    none = toxicity.score_documents(documents((1, "a")), marked.limit(0)).first()
    assert 0 <= none["score"] < 0.5 and toxicity.score_documents(documents(), marked).count() == 0


def test_held_out_labels_are_not_learnt(spark, documents):
    out = [n for n in range(500) if zlib.crc32(str(n).encode()) % 5 == 0]
    marked = spark.createDataFrame([(n, n % 2) for n in out], "doc_id long, toxic int")
    scores = {r["score"] for r in toxicity.score_documents(documents(*[(n, f"w{n % 2}") for n in out]), marked).collect()}
    assert len(scores) == 1


@pytest.mark.parametrize("ids", [
    [], [0], [7] * 3_000, list(range(50_257)), [50_256, 0, 65_535, 65_536], list(range(40)) * 500])
def test_coder_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert (id_coder.decode(id_coder.encode(ids)) == ids).all()


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 5_000), st.integers(1, 60_000))
def test_coder_round_trip_of_random_ids(seed, n, alphabet):
    ids = np.random.default_rng(seed).zipf(1.3, n).clip(max=alphabet).astype(np.uint32)
    assert (id_coder.decode(id_coder.encode(ids)) == ids).all()


def test_coder_blocks_stand_alone(monkeypatch):
    monkeypatch.setattr(id_coder, "BLOCK", 1_000)
    ids = np.random.default_rng(1).integers(0, 90, 2_500).astype(np.uint32)
    data = id_coder.encode(ids)
    one = id_coder.encode(ids[1_000:2_000])
    assert one in data and (id_coder.decode(data) == ids).all()
    spoiled = bytearray(data)
    spoiled[-len(one)] ^= 64
    with pytest.raises(ValueError):
        id_coder.decode(bytes(spoiled))


def test_coder_learns():
    ids = np.tile(np.random.default_rng(2).integers(0, 50_000, 2_000), 60).astype(np.uint32)
    assert len(id_coder.encode(ids)) < 0.35 * 2 * len(ids)


TEXTS = ["", None, " a", "a ", "a  b", "a \n b", "it's  x\t y", "<|endoftext|> b", "é è z", "don't 12 a1", "x" * 50_000,
         "word " * 20_000, "  b", "a\u0085b c"]


def test_token_files_match_the_tokenizer(spark, documents, folder):
    pytest.importorskip("public_tokenizers")
    rows = list(enumerate(TEXTS)) + [(3, "again"), (None, "no id"), (-5, "first")]
    docs = documents(*rows).withColumn("ids", F.lit(1))
    token_ids.write_token_files(docs.repartition(4), folder + "/t", segment_tokens=5_000)
    tokenizer = token_ids._tokenizer(token_ids.public_vocabulary())
    expected = sorted(((d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in rows), key=str)
    read = token_ids.read_token_files(spark, folder + "/t")
    assert sorted(((r["doc_id"], r["ids"]) for r in read.collect()), key=str) == expected
    found = token_ids.document_digests(spark, folder + "/t").orderBy("start").collect()
    order = [r["doc_id"] for r in found]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in found] == [sum(r["n_tokens"] for r in found[:n]) for n in range(len(found))]
    crc = sorted((str(d), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in expected)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in found) == crc


PARTS = ["a", "B", "\u00e9", "e\u0301", "\u0451", "\u4e16", " ", " ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "\x1c", "\x00", "'s", "'ll",
         "'", ",", ".", "-", "1", "23", "<|endoftext|>", "\u0120", "_", "\U0001f600", "don't"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=20).map("".join), max_size=8))
def test_pieces_encode_like_whole_texts(texts):
    pytest.importorskip("public_tokenizers")
    encoder = token_ids._encoder(token_ids.public_vocabulary())
    whole = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert [found.tolist() for found in encoder.encode(texts)] == whole


def test_no_token_files(documents):
    assert token_ids.token_digests(documents()).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool\n%0A", "", "[TURN]"]),
                          st.text(alphabet=list("<>/[]\\sINTSYURa \n%é")) | st.sampled_from(
                              ["</s>[INST] ok [/INST]", "<\\s><s>", "<<SYS>>", "<\\<SYS>>", "<</s>"]))))
def test_rendering_is_reversible(messages):
    text, spans = chat.render(messages)
    assert chat.parse(text) == messages
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in messages if r == "assistant"]


def test_folding_of_events(spark):
    log = [(1, 0, "start", "user", None, None), (1, 1, "delta", None, "hel", None), (1, 2, "delta", None, "lo", None),
           (1, 3, "start", "assistant", None, None), (1, 4, "delta", None, "draft", None), (1, 5, "regenerate", None, None, None),
           (1, 6, "delta", None, "fin", None), (1, 7, "delta", None, "al", None), (1, 8, "edit", None, "hi", 0),
           (1, 9, "edit", None, "out of range", 9), (2, 0, "delta", None, "orphan", None), (2, 0, "delta", None, "orphan", None),
           (3, 0, "start", None, None, None), (None, 1, "start", "user", "x", None)]
    frame = spark.createDataFrame(log, "conv_id long, seq int, kind string, role string, text string, target long")
    out = {r["conv_id"]: chat.parse(r["text"]) for r in chat.format_conversations(frame.repartition(5)).collect()}
    assert out == {1: [("user", "hi"), ("assistant", "final")], 2: [("", "orphanorphan")], 3: [("", "")], None: [("user", "x")]}
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_conversations_come_back(spark):
    rows = [(1, 2, "assistant", "b\n\nc\n"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, None, None), (2, 0, "assistant", None),
            (3, 0, "assistant", "word \n" * 30_000), (3, 1, "tool", "</s>")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit(1))
    found = {r["conv_id"]: r for r in chat.digests(chat.formatted_files(chat.log_of(frame))).collect()}
    order = {1: [("", ""), ("user", "a"), ("user", "a"), ("assistant", "b\n\nc\n")], 2: [("assistant", "")],
             3: [("assistant", "word \n" * 30_000), ("tool", "</s>")]}
    for conv, turns in order.items():
        text = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert found[conv]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (found[conv]["n_turns"], found[conv]["loss_chars"]) == (len(turns), len(loss))
        assert found[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert not re.search("</s>.*</s>", chat.escape("</s>"))
