"""Benchmark decontamination by a BM25 index of the test items and block-max WAND.

Every passage of every training document is a query against the index of test items. BM25
scores are divided by an item's score against itself. An item's threshold is the least part of it
that a passage with enough of its question and answer can score, so that the search loses none that
verification would keep. WAND's bounds skip a passage as soon as no item can reach its threshold; all
items above it are then verified by the overlap of question and answer with the document's words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from flowlens.llm.shared import scratch_path

# Usual BM25 constants.
K1, B = 1.2, 0.75
#: Shingle length and overlap that the verification asks of question and answer.
SHINGLE, OVERLAP = 5, 0.8
#: Part of an item's threshold that the terms which candidates are searched by have to give.
SEARCHED = 0.5
#: Postings in a block with a maximum of its own.
BLOCK = 32
#: Items and characters that one pass over the documents holds in its index; more take more passes.
ITEMS_AT_ONCE, CHARS_AT_ONCE = 20_000, 32_000_000
#: Texts whose passages are compared with the index together.
TEXTS_AT_ONCE = 64
#: Different spellings whose term a task remembers.
WORDS_KEPT = 500_000

MATCH = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double,word_start:long>>"

#: Letters of scripts without spaces between words (Thai to Burmese, Khmer, kana, Chinese): each is a word.
_ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_INNER = re.compile(rf"(?=\w)[{_ALONE}]|[^\W{_ALONE}]+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words: letters, digits and underscores of any script between anything else.

    Where a script sets no spaces between words, each letter is one.
    """
    return _INNER.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's last sentence or line are its answer, those before are the question.

    An item of one sentence, or whose answer would be shorter than a shingle, is a question only.
    """
    parts = [w for w in (words_of(p) for p in re.split(r"(?<=[.!?])\s+|\n+", text)) if w]
    answer: list[str] = []
    while parts and len(answer) < SHINGLE:
        answer = parts.pop() + answer
    question = [w for p in parts for w in p]
    return (question, answer) if len(question) >= SHINGLE else (question + answer, [])


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    if not words:
        return set()
    return {tuple(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def least_part(parts: tuple[set, set], impact: dict[str, float]) -> float:
    """A lower bound for the score of any passage that holds OVERLAP of each part's shingles.

    A word is missing only with all shingles that hold it, so it must be in few enough of them, and no
    more words than shingles can be missing. One shingle of a part at least is there.
    """
    lost = there = 0.0
    for part in filter(None, parts):
        spare = len(part) - ceil(OVERLAP * len(part) - 1e-9)
        held_by = Counter(w for s in part for w in set(s))
        lost += sum(sorted((impact[w] for w, n in held_by.items() if n <= spare), reverse=True)[:spare])
        there = max(there, min(sum(impact[w] for w in set(s)) for s in part))
    return max(1.0 - lost, there)


@dataclass
class Index:
    """Inverted index of items; impacts are parts of an item's score against itself.

    ``threshold`` is one part for all items in place of each item's own. ``statistics`` are
    the number of items, their mean length and the items of a word, where there are more than those here.
    """

    items: list[tuple[int | None, str | None]]
    threshold: float | None = None
    statistics: tuple[int, float, dict[str, int]] | None = None
    term_of: dict[str, int] = field(default_factory=dict)
    postings: list[tuple[list[int], list[float]]] = field(default_factory=list)
    highest: np.ndarray = None  # by term: its largest impact

    def __post_init__(self) -> None:
        self.items = sorted((i for i in self.items if words_of(i[1])), key=lambda i: (i[0] is None, i[0] or 0, i[1]))
        texts = [words_of(t) for _, t in self.items]
        self.parts = [tuple(shingles(p) for p in question_and_answer(t)) for _, t in self.items]
        counts: dict[str, dict[int, int]] = {}
        for n, words in enumerate(texts):
            for w in words:
                of = counts.setdefault(w, {})
                of[n] = of.get(n, 0) + 1
        here = (len(texts), sum(map(len, texts)) / max(1, len(texts)), {w: len(of) for w, of in counts.items()})
        total, mean, having = self.statistics or here
        raw = {}
        own = [0.0] * len(texts)
        for w, of in counts.items():
            idf = log(1 + (total - having[w] + 0.5) / (having[w] + 0.5))
            raw[w] = [(n, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(texts[n]) / mean))) for n, tf in of.items()]
            for n, x in raw[w]:
                own[n] += x
        for w in sorted(raw):
            self.term_of[w] = len(self.postings)
            self.postings.append(([n for n, _ in raw[w]], [x / own[n] for n, x in raw[w]]))
        impacts: list[dict[str, float]] = [{} for _ in texts]
        for w, t in self.term_of.items():
            for n, x in zip(*self.postings[t]):
                impacts[n][w] = x
        self.least = np.array([least_part(p, x) if self.threshold is None else self.threshold
                               for p, x in zip(self.parts, impacts)])
        # Bounds are in parts of the thresholds, so that one bound serves items with different ones.
        least = self.least.tolist()
        bounds = [[x / least[n] for n, x in zip(docs, part)] for docs, part in self.postings]
        self.blocks = [([d[min(i + BLOCK, len(d)) - 1] for i in range(0, len(d), BLOCK)],
                        [max(x[i:i + BLOCK]) for i in range(0, len(x), BLOCK)])
                       for (d, _), x in zip(self.postings, bounds)]
        self.highest = np.array([max(x) for x in bounds] or [0.0])
        # An item is searched by its rarest terms, as many as it takes for SEARCHED. What it has to find in
        # them is its threshold less all that its other terms could give.
        found: dict[int, list[tuple[int, float]]] = {}
        self.needed = np.zeros(len(texts))
        for n, own_terms in enumerate(impacts):
            given = 0.0
            for w, x in sorted(own_terms.items(), key=lambda i: (len(counts[i[0]]), i[0])):
                given += x
                found.setdefault(self.term_of[w], []).append((n, x))
                if least[n] - (1.0 - given) >= SEARCHED * least[n]:
                    break
            self.needed[n] = least[n] - (1.0 - given)
        # The items that search by a term, end to end.
        self.lists = np.cumsum([0, *(len(found.get(t, ())) for t in range(len(self.postings)))])
        self.rare_items = np.array([n for t in sorted(found) for n, _ in found[t]], np.int64)
        self.rare_impacts = np.array([x for t in sorted(found) for _, x in found[t]])
        self.longest = max(map(len, texts), default=1) or 1

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose score for the query's different ``terms`` reaches their threshold: block-max WAND."""
        lists = [[self.postings[t][0][0], 0, t] for t in terms]  # current item, place, term
        found, least = [], 1.0 - 1e-9  # in parts of a threshold
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for n, (_, _, t) in enumerate(lists):
                bound += self.highest[t]
                if bound >= least:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            ends, bound = [], 0.0
            for _, _, t in lists[:pivot + 1]:  # the blocks that hold the pivot item
                last, most = self.blocks[t]
                k = bisect_left(last, item)
                if k < len(last):
                    bound += most[k]
                    ends.append(last[k])
            if bound < least:
                # No item up to the nearest block end, or up to the next list's item, can do.
                go = min([*(e + 1 for e in ends), *(x[0] for x in lists[pivot + 1:pivot + 2])])
                go = max(go, item + 1)
                moved = lists[:pivot + 1]
            elif lists[0][0] == item:
                score = sum(self.postings[t][1][k] for _, k, t in lists[:pivot + 1])
                if score >= self.least[item] - 1e-9:
                    found.append((item, score))
                go, moved = item + 1, lists[:pivot + 1]
            else:
                go, moved = item, [x for x in lists[:pivot] if x[0] < item]
            done = []
            for x in moved:
                docs = self.postings[x[2]][0]
                x[1] = bisect_left(docs, go, x[1])
                if x[1] < len(docs):
                    x[0] = docs[x[1]]
                else:
                    done.append(x)
            lists = [x for x in lists if x not in done] if done else lists
        return found


class _Terms(dict):
    """Term number of a spelling: -1 if it has no term of the index, under -1 if it isn't one word."""

    def __init__(self, term_of: dict[str, int]) -> None:
        self.term_of, self.several = term_of, []

    def __missing__(self, raw: str) -> int:
        word = raw if raw.isalnum() else raw[:-1]
        if not word.isalnum() or not raw.isascii():
            words = _INNER.findall(raw)
            if len(words) != 1:
                self.several.append([self.term_of.get(w, -1) for w in words])
                self[raw] = -1 - len(self.several)
                return self[raw]
            word = words[0]
        elif word is not raw and (raw[-1] == "_" or raw[-1].isalnum()):
            word = raw
        self[raw] = self.term_of.get(word, -1)
        return self[raw]


class Matcher:
    """Finds leaked items in texts; remembers which term a spelling is."""

    def __init__(self, index: Index) -> None:
        self.index, self.known = index, _Terms(index.term_of)

    def terms(self, text: str) -> np.ndarray:
        """A term number or -1 for each word, in order."""
        raws = text.lower().split()
        if len(self.known) > WORDS_KEPT:
            self.known = _Terms(self.index.term_of)
        found = np.fromiter(map(self.known.__getitem__, raws), np.int64, len(raws))
        if (found < -1).any():
            several = self.known.several
            found = np.array([t for x in found.tolist() for t in (several[-2 - x] if x < -1 else (x,))], np.int64)
        return found

    def candidates(self, texts: list[np.ndarray]) -> list[list[int]]:
        """For each text, starts of passages of 2 * step words, one each step, in which an item can reach
        its threshold.

        Sums the impacts that a passage's different terms have on each item that is searched by them, for
        all passages at once. An item lies whole in some passage.
        """
        index, step = self.index, self.index.longest
        passages = [len(t) // step + 1 for t in texts]
        base = np.cumsum([0, *passages])
        at = [np.flatnonzero(t >= 0) for t in texts]
        term = np.concatenate([t[a] for t, a in zip(texts, at)])
        place = np.concatenate([a // step + b for a, b in zip(at, base)])
        first = np.repeat(base[:-1], [len(a) for a in at])
        rare = index.lists[term + 1] > index.lists[term]
        term, place, first = term[rare], place[rare], first[rare]
        # A word is in the passage of its step and in that before; a passage's repeats count once.
        width = len(index.postings)
        pairs = np.unique(np.concatenate([place * width, np.maximum(place - 1, first) * width]) + np.tile(term, 2))
        place, term = pairs // width, pairs % width
        many = index.lists[term + 1] - index.lists[term]
        entry = np.repeat(index.lists[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
        key = np.repeat(place, many) * len(index.items) + index.rare_items[entry]
        order = np.argsort(key, kind="stable")
        key, impact = key[order], index.rare_impacts[entry[order]]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.array([], np.int64)
        total = np.add.reduceat(impact, begin) if len(key) else np.array([])
        keys = key[begin]
        hit = np.unique(keys[total >= index.needed[keys % len(index.items)] - 1e-9] // len(index.items))
        owner = np.searchsorted(base, hit, side="right") - 1
        found: list[list[int]] = [[] for _ in texts]
        for text, passage in zip(owner.tolist(), hit.tolist()):
            found[text].append((passage - int(base[text])) * step)
        return found

    def matches(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text (item_id, score, question overlap, answer overlap, first word of the passage) per item,
        from the passage with the highest score."""
        terms = [self.terms(t or "") for t in texts]
        return [self._verified(text, t, starts) if starts else []
                for text, t, starts in zip(texts, terms, self.candidates(terms))]

    def _verified(self, text: str | None, terms: np.ndarray, starts: list[int]) -> list[tuple]:
        best: dict[int, tuple] = {}
        words, step = words_of(text), self.index.longest
        for start in starts:
            query = np.unique(terms[start:start + 2 * step])
            have = None
            for item, score in self.index.retrieve(query[query >= 0].tolist()):
                have = have or shingles(words[start:start + 2 * step])
                question, answer = self.index.parts[item]
                q = len(question & have) / len(question)
                a = len(answer & have) / len(answer) if answer else q
                if q >= OVERLAP and a >= OVERLAP:
                    new = (self.index.items[item][0], score, q, a, start)
                    if item not in best or (new[1], new[2], -start) > (best[item][1], best[item][2], -best[item][4]):
                        best[item] = new
        return [best[k] for k in sorted(best)]


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _all_words(text):
    return words_of(text)


def _indexes(items: DataFrame, threshold: float | None) -> Iterator[Index]:
    """Indexes of all items, of which one holds ITEMS_AT_ONCE items and about CHARS_AT_ONCE characters.

    Items without words can't be found and are left out by Index; of items that share an id, or have none,
    all count. The statistics are those of all items in every index: Spark counts them where there are
    several, and a single index counts the same itself.
    """
    texts = items.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct()
    n, size = texts.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = max(1, -(-n // ITEMS_AT_ONCE), -(-(size or 0) // CHARS_AT_ONCE))
    statistics = None
    if parts > 1:
        worded = texts.withColumn("w", _all_words("text")).where("size(w) > 0")
        total, mean = worded.agg(F.count("*"), F.avg(F.size("w"))).first()
        different = worded.select("item_id", "text", F.explode(F.array_distinct("w")).alias("word"))
        path = scratch_path(items.sparkSession, "item-words")
        different.groupBy("word").agg(F.count("*").alias("n")).write.parquet(path)
        having = items.sparkSession.read.parquet(path)
    for part in range(parts):
        of_part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part
        # One job for all partitions: the part's size was checked above, and its words are no more than its characters.
        found = texts.where(of_part).toArrow()
        if parts > 1:
            mine = having.join(different.where(of_part).select("word").distinct(), "word").toArrow()
            statistics = (total, mean, dict(zip(mine["word"].to_pylist(), mine["n"].to_pylist())))
        yield Index(list(zip(found["item_id"].to_pylist(), found["text"].to_pylist())), threshold, statistics)


def leaks(text: Column, index: Index) -> Column:
    """The verified test items in a text, as an array of structs."""
    @F.pandas_udf(MATCH)
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(index)
        names = ("item_id", "score", "question_overlap", "answer_overlap", "word_start")
        for part in parts:
            texts, found = [t if isinstance(t, str) else None for t in part], []
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                found += [[dict(zip(names, m)) for m in x] for x in matcher.matches(texts[at:at + TEXTS_AT_ONCE])]
            yield pd.Series(found, dtype=object)
    return find(text)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float | None = None) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, word_start), a row per document and item in it.

    A passage of a document is a candidate for an item if its BM25 score reaches the item's threshold, by
    default the least that a leak can have (else ``threshold`` of the item's score against itself), and a leak
    if it holds 0.8 of the five-word shingles of both question and answer. Words are of any script. Null and empty texts, and items without words, match nothing. Repeated
    rows give repeated matches; rows without ``doc_id`` are matched too, and items without ``item_id`` are
    found and reported without one. An empty table on either side gives no rows. Other
    columns are left out.
    """
    found = None
    for index in _indexes(items, threshold):
        part = docs.select("doc_id", F.explode(leaks(F.col("text"), index)).alias("__m")).select("doc_id", "__m.*")
        found = part if found is None else found.union(part)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float | None = None) -> DataFrame:
    """The documents that hold no test item, also none without ``item_id``; all columns."""
    for index in _indexes(items, threshold):
        docs = docs.where(F.size(leaks(F.col("text"), index)) == 0)
    return docs
