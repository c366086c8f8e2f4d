"""Exact duplicates, conversation repair and periodic runs against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from rampwise.llm import conversations, exact, periodic
from rampwise.llm.common import read, ship
from rampwise.llm.queries import QUERIES

WORD = r"[^\x20\x09-\x0D]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def same(df, want, *cols):
    got = Counter(tuple(r) for r in df.select(*cols).collect())
    want = Counter(want)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def texts(spark, rows):
    return ship(spark).createDataFrame([(*r, "x", "x", "x", 1) for r in rows], "doc_id long, text string, full string, bits string, _key string, row int")


# --- exact duplicates ------------------------------------------------------------------

LONG = "a long text " * 200_000
ROWS = [(1, "same"), (2, "same"), (3, "same "), (4, None), (5, ""), (6, LONG + "x"), (7, LONG + "y"), (8, LONG + "x"), (9, "é" * 300), (10, "é" * 300), (11, "e" * 600),
        (None, "nobody"), (None, "nobody"), (None, "same"), (12, "twice"), (12, "twice"), (13, "alone"), (None, "alone too"), *[(100 + i, "hot copy of many") for i in range(300)]]


def _exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        ids = sorted(ids, key=lambda i: (i is not None, i or 0))
        out += [(i, keep, len(ids), at == len(ids) - 1, len(t.encode()), sha(t)) for at, i in enumerate(ids)]
    return out


EXACT = ("doc_id", "keep_id", "group_size", "kept", "n_bytes", "text_sha256")


def test_exact_groups(spark, data, monkeypatch):
    docs = texts(spark, ROWS)
    same(exact.grouped(docs, digests=True), _exact(ROWS), *EXACT)
    monkeypatch.setattr(exact, "SIEVE", 8)  # bits that all keys share let too many through, and change nothing
    same(exact.grouped(docs, digests=True), _exact(ROWS), *EXACT)
    monkeypatch.setattr(exact, "HOT", 1)
    same(exact.grouped(docs, digests=True), _exact(ROWS), *EXACT)
    assert exact.grouped(docs.limit(0)).count() == 0
    assert exact.grouped(docs).columns == list(EXACT[:5])
    own = read(spark, data, "documents")
    same(QUERIES["op11_exact"](spark, data), _exact([(r["doc_id"], r["text"]) for r in own.collect()]), *EXACT)


def test_exact_leaves_one_row_of_each_text(spark):
    docs = texts(spark, ROWS)
    kept = exact.deduplicated(docs)
    assert kept.columns == docs.columns
    want = Counter((i, t or "") for (i, _, _, k, _, h) in _exact(ROWS) if k for t in {t or "" for _, t in ROWS} if sha(t) == h)
    assert Counter((r["doc_id"], r["text"] or "") for r in kept.collect()) == want


# --- conversations ---------------------------------------------------------------------


def _damage(rows):
    out = []
    for c, t, role, text in rows:
        name = ":".join(" " if v is None else str(v) for v in (c, t))
        role, text, kind = role if role is not None else " ", text if text is not None else " ", zlib.crc32(name.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def _cheapest(rows):
    """(cost, audit) by trying all edits; rows are (role, must go, truncated)."""
    known = {}

    def follow(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    def best(i, state, inserts):
        key = (i, state, inserts)
        if key not in known:
            some = [(0, "")] if i == len(rows) and state in ("", "a") else []
            if i < len(rows):
                role, gone, cut = rows[i]
                cost, audit = best(i + 1, state, 0)
                some.append((cost + 3, "D" + audit))
                for letter, price, initials in (("K", 0, role[:1]), ("R", 2, "ua")):
                    for x in initials:
                        to = follow(state, x)
                        if not gone and to:
                            cost, audit = best(i + 1, to, 0)
                            some.append((cost + price + cut, letter + audit))
            if inserts < 3:
                for x in "ua":
                    to = follow(state, x)
                    if to:
                        cost, audit = best(i, to, inserts + 1)
                        some.append((cost + 2, "I" + audit))
            known[key] = min(some, default=(10**9, ""))
        return known[key]

    return best(0, "", 0)


def _repaired(rows, audit):
    out, i, state = [], 0, ""
    for x in audit:
        if x == "D":
            i += 1
            continue
        role = rows[i][0] if x == "K" else "assistant" if state == "u" else "user"
        out.append(f"{role}:{'' if x == 'I' else rows[i][1]}")
        state, i = role[0], i + (x != "I")
    return "\n".join(out)


def _conversations(rows):
    by = defaultdict(list)
    for r in _damage(rows):
        by[r[0]].append(r[1:])
    out = []
    for c in {r[0] for r in rows}:
        mine = sorted(by[c], key=lambda r: (r[0] is not None, r[0] or 0, sha(f"{len(r[1])}:{r[1]}{r[2]}")))
        turns = {t for t, _, _ in mine if t is not None}
        seen, judged, counts = set(), [], Counter()
        for _, role, text in mine:
            w = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not w else "duplicate" if (role, text) in seen else "truncated" if w[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] += 1
            judged.append((role, fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = _cheapest(judged)
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
                    sha(_repaired([r[1:] for r in mine], audit))))
    return out


REPAIRED = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")


@pytest.fixture(scope="module")
def talk(spark, data):
    rng = random.Random(7)
    rows = [tuple(r) for r in read(spark, data, "conversations").select("conv_id", "turn", "role", "text").collect()]
    for c in range(10**6, 10**6 + 150):
        for _ in range(rng.randint(1, 14)):
            rows.append((c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "User"]),
                         rng.choice([None, "", " \n", "Yes.", "no", "Why? ", "é!", "more\n", "Yes."])))
    rows += [(None, 1, "user", "Hello."), (None, 2, "assistant", "Hi."), (10**7, 1, "user", "word. " * 50_000), (10**7, 2, "assistant", "word" * 100_000)]
    rows += [(10**7 + 1, 5, "user", "Same.")] * 400 + [(10**7 + 2, i, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"Line {i}.", f"open {i}"])) for i in range(500)]
    return rows


def test_repair_equals_trying_all_edits(spark, talk, monkeypatch):
    df = ship(spark).createDataFrame([(*r, "x", "y") for r in talk], "conv_id long, turn long, role string, text string, k string, digest string").repartition(5)
    for piece in (conversations.PIECE, 7):  # small pieces deal a conversation over several
        monkeypatch.setattr(conversations, "PIECE", piece)
        same(conversations.repair(conversations.damaged(df), df), _conversations(talk), *REPAIRED)
    none = df.limit(0)
    assert conversations.repair(conversations.damaged(none), none).count() == 0
    one = conversations.repair(conversations.damaged(df.where("conv_id = 1000003")), df.where("conv_id = 1000003"), texts=True).first()
    assert sha(one["repaired"]) == next(r[-1] for r in _conversations(talk) if r[0] == 1000003)


def test_all_rows_dropped(spark):
    c = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = ship(spark).createDataFrame([(c, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    assert tuple(conversations.repair(conversations.damaged(df), df).select(*REPAIRED).first()) == (c, 0, 0, 0, 0, 0, 0, "", sha(""))


# --- periodic runs ---------------------------------------------------------------------


def _runs(words, least=24, times=3):
    n, smallest = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                smallest.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in smallest.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        n, letters = rng.randint(1, 60), rng.randint(1, 4)
        s = [rng.randrange(letters) for _ in range(n)]
        if rng.random() < 0.6:
            root = s[: rng.randint(1, 9)]
            s = s[:20] + root * rng.randint(2, 12) + root[: rng.randint(0, len(root))] + s[20:]
        assert periodic.maximal_runs(s, 2, 2) == _runs(s, 2, 2), s
        words = [b"w%d" % x for x in s]
        assert periodic.runs_of(words) == _runs(words), s


def _periodic(doc_id, text):
    words = re.findall(WORD, text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_query(spark, data, tmp_path):
    own = [(r["doc_id"], r["text"]) for r in read(spark, data, "documents").collect()]
    rng = random.Random(5)
    odd = [None, "", " \n", "one", "x y" * 30, "a " * 23, "a " * 24, "a b " * 40 + "c " + "a b " * 40, "  b\x1cc " * 20, "no period here at all", "é ü " * 30]
    odd += [" ".join(rng.choice("ab") for _ in range(rng.randint(20, 300))) for _ in range(60)]
    rows = own + [(10**6 + i, t) for i, t in enumerate(odd)] + [(10**6, None), (None, "a b c " * 30), (10**6 + 7, odd[7])]
    texts(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op13_periodic"](spark, str(tmp_path))
    same(got, [_periodic(i, t) for i, t in rows], "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert periodic.collapsed(texts(spark, rows).limit(0)).count() == 0


def test_long_text_of_one_period():
    words = [b"w%d" % (i % 5000) for i in range(40_000)]
    assert periodic.runs_of(words) == [(0, 40_000, 5000)]
    assert periodic.runs_of([b"a"] * 50_000) == [(0, 50_000, 1)]
