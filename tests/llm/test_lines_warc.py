"""Line dedup and WARC against plain Python, with their edge cases."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from flowlens.llm.line_dedup import drop_shared_lines
from flowlens.llm.warc import read_archives, resolve_revisits, resolved_records, write_archives

SPACES = " \t\n\x0b\x0c\r"


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def expected_lines(rows, min_chars=40, min_docs=5):
    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = fold(line.strip(SPACES))
            if doc is not None and len(key) >= min_chars:
                held[key].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keys = [fold(x.strip(SPACES)) for x in lines]
        kept = [x for x, k in zip(lines, keys) if doc is None or len(held[k]) < min_docs or max(held[k]) == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_lines_match_brute_force(documents):
    long = "É shared line that is well over forty code points long"
    rows = [(n, f"start {n}\n  {long.upper() if n % 2 else long}\t\nend {n}\n") for n in range(7)]
    rows += [(7, None), (8, ""), (9, "\n\n"), (10, f"{long}\n{long}"), (11, "x" * 39), (None, long),
             (12, ("word " * 20_000) + "\n" + "y" * 41), (13, "y" * 40 + " "), (3, rows[3][1]), (3, "another text of id 3")]
    rows += [(n, "y" * 40) for n in range(20, 23)]
    found = drop_shared_lines(documents(*rows)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted((tuple(r) for r in found), key=str) == expected_lines(rows)


def test_lines_keep_other_columns_and_empty_tables(documents):
    docs = documents((1, "a\nb")).withColumn("n_lines", F.lit("old")).withColumn("extra", F.lit(5))
    row = drop_shared_lines(docs).first()
    assert (row["n_lines"], row["extra"], row["lang"]) == (2, 5, "en")
    assert drop_shared_lines(documents()).count() == 0


def test_lines_run_no_python(documents):
    plan = drop_shared_lines(documents((1, "a")))._jdf.queryExecution().executedPlan().toString()
    assert not [n for n in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop") if n in plan]


def expected_pages(rows, least=100):
    first = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if page is not None and len(body) >= least:
            first[body] = min(page, first.get(body, page))
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        revisit = page is not None and body in first and first[body] != page
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response",
                    first[body] if revisit else None))
    return sorted(out, key=str)


def test_warc_matches_brute_force(spark, folder):
    big, tricky = "é" * 50, "WARC/1.1\r\nWARC-Type: response\r\n\r\nx\r\n\r\n" * 5
    rows = [(5, "http://a", big), (3, "http://b\r\nX: y", big), (9, None, big), (4, "u", "é" * 49), (6, "u", "é" * 49),
            (1, "u", None), (2, "u", ""), (7, "u", tricky), (8, "u", tricky), (3, "http://b", big), (None, "n", big),
            (10, "u", "\n".join("line %d" % n for n in range(50_000)))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("__first", F.lit(1))
    write_archives(resolve_revisits(pages), folder + "/w")
    records = read_archives(spark, folder + "/w")
    found = resolved_records(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected_pages(rows)
    stored = {(r["page_id"], r["record_type"]): r["payload"] for r in records.collect()}
    assert bytes(stored[7, "response"]).decode() == tricky and stored[8, "revisit"] is None
    ids = [r["record_id"] for r in records.select("record_id").collect()]
    assert all(i.startswith("<urn:uuid:") and len(i) == 47 for i in ids)


def test_warc_of_no_pages(spark, folder):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    write_archives(resolve_revisits(pages), folder + "/w")
    assert read_archives(spark, folder + "/w").count() == 0
