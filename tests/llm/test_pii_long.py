"""Personal data in long texts: pieces give the same spans as the whole, in time that grows with the text."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from rampwise.llm import pii

PARTS = ["jo.do@mail.example.com", "a@b", "x@y.z", "10.0.0.1", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-5678",
         "+1 2", "030/1234 5678", "me [at] home (dot) org", "é", "😀", ",", ";", "\n", " ", "  ", ".", "-", "+", "@", "(", ")", "[", "]", "word", "A1", "7", "42 "]


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _base(text):
    rules = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m, d: True),
             (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
             (r"[0-9](?:[\x20-]?[0-9])+", lambda m, d: 14 <= len(d) <= 19 and _luhn(d)),
             (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 10 <= len(d) <= 15)]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0], re.sub("[^0-9]", "", m[0])))


@pytest.mark.parametrize("size", [1, 7, 40])
def test_pieces_change_no_span(spark, monkeypatch, size):
    """Random texts cut every few characters against the whole text in one piece, loose spans and their codes included."""
    pick = random.Random(size)
    texts = ["".join(pick.choice(PARTS) + pick.choice(["", "", " ", ", "]) for _ in range(pick.randint(0, 60))) for _ in range(300)] + [None, "", " ", "😀"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r[0]: r[1] for r in pii.candidates(rows, ["doc_id"]).collect()}
    monkeypatch.setattr(pii, "PIECES", pii.PIECES.replace(str(pii.PIECE), str(size)))
    cut = {r[0]: r[1] for r in pii.candidates(rows, ["doc_id"]).collect()}
    bare = lambda found: [(x["start"], x["kind"], x["end"], x["strict"]) for x in found]
    assert {i: bare(f) for i, f in cut.items()} == {i: bare(f) for i, f in whole.items()}
    assert {i: [x[:3] for x in bare(f) if x[3]] for i, f in cut.items()} == {i: _base(t or "") for i, t in enumerate(texts)}
    joined = pii.cut(rows, ["doc_id"], "text").select("doc_id", F.array_join("_p", "").alias("t"))
    assert {r[0]: r[1] for r in joined.collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_long_lists_of_addresses(spark):
    """Texts of a megabyte and a half, joined by blanks, lines and commas; spans and redaction of each in under a minute."""
    n = 50_000
    address = lambda i: f"user{i}.name@mail{i % 97}.example.com"
    texts = [" ".join(map(address, range(n))), "\n".join(map(address, range(n))), ",".join(map(address, range(n)))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    begun = time.monotonic()
    got = {r["doc_id"]: r for r in pii.spans(rows).collect()}
    assert time.monotonic() - begun < 60
    for i, t in enumerate(texts):
        said = ",".join(f"email:{a}:{b}" for a, _, b in _base(t))
        assert got[i]["n_email"] == n and got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    begun = time.monotonic()
    out = {r["doc_id"]: r["text"] for r in pii.redacted(rows).collect()}
    assert time.monotonic() - begun < 60
    assert out == {0: " ".join(["[EMAIL]"] * n), 1: "\n".join(["[EMAIL]"] * n), 2: ",".join(["[EMAIL]"] * n)}
