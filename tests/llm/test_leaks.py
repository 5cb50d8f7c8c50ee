"""No passage that verification would keep is lost to the search, whatever the items share."""

import random

from flowlens.llm import decontaminate as dc


def kept(text, items):
    have = dc.shingles(dc.words_of(text))
    return {n for n, item in items if all(len(p & have) >= dc.OVERLAP * len(p) for p in map(
        dc.shingles, dc.question_and_answer(item)))}


def test_items_of_one_template_are_found_by_their_overlap():
    rng = random.Random(3)
    template = " ".join(f"t{n}" for n in range(60))
    own = [[f"own{n}x{k}" for k in range(9)] for n in range(300)]
    items = [(n, f"{template} {' '.join(w)}") for n, w in enumerate(own)]
    matcher = dc.Matcher(dc.Index(items))
    texts = [f"before {template} {' '.join(own[7][:6])} after", template, f"{template} {' '.join(own[9])}",
             " ".join(rng.sample(template.split(), 60)), " ".join(own[4]), template.split(" ", 30)[-1]]
    for text, found in zip(texts, matcher.matches(texts)):
        assert {m[0] for m in found} == kept(text, items)
    assert len(matcher.matches(texts[:1])[0]) == 300


def test_edited_items_of_few_words_match_brute_force():
    rng = random.Random(11)
    vocabulary = [f"v{n}" for n in range(25)]
    items = [(n, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 45))) + rng.choice(["", ". ", "\n"]) +
              " ".join(rng.choices(vocabulary, k=rng.randrange(0, 12)))) for n in range(80)]
    items += [(100, "a a a a a a a a a a"), (101, "a b " * 20), (102, "one"), (103, "a b a b a b a b a b c")]
    matcher, texts = dc.Matcher(dc.Index(items)), []
    for _, item in items:
        words = item.split()
        for _ in range(4):
            edited = list(words)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(edited))
                edited[at:at + rng.randrange(1, 3)] = rng.choice([[], ["zz"], ["v1"]])
                edited = edited or ["zz"]
            # as long as a passage's step at most, so that it lies whole in the first passage
            texts.append(" ".join(edited[:matcher.index.longest]))
    both = [({m[0] for m in found}, kept(text, items)) for text, found in zip(texts, matcher.matches(texts))]
    assert all(found == expected for found, expected in both)
    assert sum(len(e) for _, e in both) > 150


def test_scores_do_not_depend_on_the_number_of_indexes(spark, documents, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"v{n}" for n in range(40)]
    items = [(n, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 30)))) for n in range(30)] + [(90, "..."), (None, "v1 v2 v3 v4 v5 v6")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(*[(n, f"x {t} y") for n, t in items])

    def found():
        return sorted((r["doc_id"] or -1, r["item_id"] or -1, round(r["score"], 9)) for r in dc.contaminated(docs, frame).collect())

    once = found()
    monkeypatch.setattr(dc, "ITEMS_AT_ONCE", 7)
    assert found() == once and len(once) >= 31
