"""The training-data operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rampwise.llm import bpe, decontaminate, jaccard, language, pii, quality, repeats, sharding, tokens, warc
from rampwise.llm.common import pieces, read, ship
from rampwise.llm.suffixes import suffix_array
from rampwise.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
ODD = [None, "", " ", "\n\n", "one", "The quick  brown\tfox\n\n", "é" * 40 + " ñandú 3.14!! ", "a<|endoftext|>b <|endoftext|> c", "don't it's  we'll", "x y" * 700,
       "日本語 テスト   nbsp   em", "é İ İstanbul", "#tag $5 & <b> | * %", "a\nb\na\n \nb\n", "w " * 60, "  lead", "trail   ", "a  b   c \n d"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, key string, node string, slot string"


def table(spark, texts, start=0):
    ship(spark)
    rows = [(start + i, t, "en", f"src{i % 3}", len(t or ""), "x", "y", "z", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, data):
    """The smallest table with odd rows, repeated ones and columns of clashing names."""
    own = read(spark, data, "documents").withColumns({c: F.lit("x") for c in ("h", "key", "node", "slot")})
    odd = table(spark, ODD, 10**6)
    twice = table(spark, ["the same row twice in one table, with words enough to be a set"], 2 * 10**6)
    nobody = table(spark, ["the same row twice in one table, with words enough to be a set"]).withColumn("doc_id", F.lit(None).cast("long"))
    return own.unionByName(odd).unionByName(twice).unionByName(twice).unionByName(nobody).cache()


@pytest.fixture(scope="module")
def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def same(df, want, *cols):
    got = Counter(tuple(r) for r in df.select(*cols).collect())
    want = Counter(want)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def test_bpe_equals_the_library(docs, pairs):
    t = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    want = []
    for i, text in pairs:
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    for leaf in (bpe.LEAF, 8):  # small leaves send nearly all texts through the tree
        same(bpe.encode(docs, leaf=leaf), want, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert bpe.encode(docs.limit(0)).count() == 0
    one = bpe.encode(docs.where("doc_id = 1000005"), keep_ids=True).first()
    assert t.decode(one["ids"], skip_special_tokens=False) == one["decoded"]


@pytest.mark.parametrize("window", [1, 3, 64])
def test_joins_of_long_runs(window):
    c, rng = bpe.coder(bpe.TOKENIZER), random.Random(window)
    for _ in range(300):
        word = "".join(rng.choice(rng.choice(["ab", "theing", "a", "éñxyz"])) for _ in range(rng.randint(2, 200)))
        for special, run in c.words(word):
            assert special < 0
            cut = rng.randint(1, len(run) - 1) if len(run) > 1 else 1
            left, right = run[:cut], run[cut:]
            if right:
                assert bpe.join(c, left, c.run(left)[0], right, c.run(right)[0], window) == c.run(run)[0]


def test_token_counts_equal_the_library(docs, pairs):
    t = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    want = [(i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 1024) for i, x in pairs]
    for size in (tokens.SUMMARY, 5):
        same(tokens.token_counts(docs, size=size), want, "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert tokens.token_counts(docs.limit(0)).count() == 0


def test_summaries_keep_heavy_hitters():
    counts = Counter({f"w{i}": 1 for i in range(100)}) + Counter({"a": 50})
    assert "a" in tokens.thinned(counts, 5) and len(tokens.thinned(counts, 5)) <= 5


def _quality(text):
    w = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i: i + 8])].append(i)
    again = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)


def test_quality_counts(docs, pairs):
    q = quality.judged(docs)
    same(q, [(i, *_quality(x)) for i, x in pairs], "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert q.where("kept AND base_failed").count() == 0 and quality.judged(docs.limit(0)).count() == 0


def test_quality_keeps_labelled_prose(spark):
    d = "/root/testdata/sf0.01"
    told = quality.judged(read(spark, d, "documents")).join(read(spark, d, "labels"), "doc_id")
    share = {r["quality"]: r["kept"] for r in told.where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] == 1.0 and share[0] < 0.2


def _windows(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_decontamination(spark, data):
    ship(spark)
    items = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "tiny item"), (3, None), (4, "..."), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
             (None, "nameless item of four"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (7, "solo")]
    bench = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, h string")
    texts = [None, "", "x ALPHA, beta gamma delta epsilon zeta eta theta iota kappa lambda y", "beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "a tiny item tiny item", "nameless item of four",
             "gamma delta epsilon zeta eta theta iota kappa lambda", "SOLO é solo", "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 5]
    d = table(spark, texts + texts[2:3])
    want = []
    for i, t in enumerate(texts + texts[2:3]):
        w, hit, ids = _windows(t or ""), set(), set()
        for item, x in items:
            v = _windows(x or "")
            n = min(10, len(v))
            for s in range(len(v) - n + 1) if n else ():
                for k in range(len(w) - n + 1):
                    if w[k: k + n] == v[s: s + n]:
                        hit |= set(range(k, k + n))
                        ids |= {str(item)} if item is not None else set()
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    same(decontaminate.contaminated(d, bench), want, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert {r["doc_id"] for r in decontaminate.clean(d, bench).collect()} == {w[0] for w in want if not w[5]}
    assert decontaminate.contaminated(d.limit(0), bench).count() == 0
    assert decontaminate.contaminated(d, bench.limit(0)).where("n_hit > 0").count() == 0


def _components(pairs, k=5):
    sets = []
    for _, t in pairs:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())]
        sets.append({tuple(w[j: j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    having = defaultdict(list)
    for i, s in enumerate(sets):
        met = Counter(j for g in s for j in having[g])
        for j, n in met.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for g in s:
            having[g].append(i)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(pairs):
        ids[find(i)].append(doc)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return [(doc, len(s), least[find(i)]) for i, ((doc, _), s) in enumerate(zip(pairs, sets))], ids


def test_jaccard_components(docs, pairs):
    want, _ = _components(pairs)
    same(jaccard.linked(docs), want, "doc_id", "n_shingles", "component_id")
    assert jaccard.linked(docs.limit(0)).count() == 0


def test_jaccard_of_edited_copies(spark):
    """Chains, a hub, and copies that share most n-grams without being linked."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = rng.choices(words, k=120)
    texts = [" ".join(base)]
    for _ in range(60):
        x = list(base)
        for _ in range(rng.randint(0, 6)):
            x[rng.randrange(len(x))] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(x))
    chain = list(base)
    for i in range(12):
        chain = chain[:]
        chain[i * 9] = f"c{i}"
        texts.append(" ".join(chain))
    d = table(spark, texts)
    want, _ = _components(list(enumerate(texts)))
    same(jaccard.linked(d), want, "doc_id", "n_shingles", "component_id")


def test_one_of_each_component(docs, pairs):
    want, groups = _components(pairs)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    empty = [w[0] for w in want if w[1] == 0]
    alone = {min((x for x in v if x is not None), default=None) for r, v in groups.items()}
    assert Counter(ids) == Counter(alone | set(empty))


def test_personal_data(spark):
    texts = ["a@b.c_d@e.f and x@y", "a@b@c.d", "999.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255", "4111 1111 1111 1111 +1 (234) 567 8901 - ", "+1    ", "é +12-34-56-78-901é a.b@c.de", None, "", "1.1.1." * 300,
             "a@b" + ".c" * 3000, "12 " * 2000, "4" * 16 + " " + "a@b.co " * 200, "+1" * 50 + "+1 234 567 89 01", "clean words alone"]
    d = table(spark, texts + texts[:1])
    base = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    want = []
    for i, t in enumerate(texts + texts[:1]):
        found = []
        for k, (kind, p) in enumerate(base.items()):
            for m in re.finditer(p, t or ""):
                digits = [int(c) for c in re.sub("[^0-9]", "", m[0])]
                luhn = sum(x if j % 2 == 0 else x * 2 - 9 * (x > 4) for j, x in enumerate(reversed(digits))) % 10 == 0
                good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}
                if good[kind]:
                    found.append((m.start(), k, kind, m.end()))
        said = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))
        want.append((i, *[sum(x[2] == k for x in found) for k in base], hashlib.sha256(said.encode()).hexdigest()))
    same(pii.spans(d), want, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    out = {r["doc_id"]: r["text"] for r in pii.redacted(d).collect()}
    assert out[0] == "[EMAIL][EMAIL] and x@y" and out[6] is None and out[7] == "" and out[13] == texts[13] and out[5] == "é [PHONE]é [EMAIL]"
    assert pii.redacted(d).columns == d.columns and pii.spans(d.limit(0)).count() == 0


def test_trees_add_spans_of_the_same_shape(spark):
    """Numbers in the format and context of valid ones are added where nearly all such candidates are valid; others aren't."""
    rows = [f"please call (21{i % 10}) 555-01{i % 90 + 10:02d}" for i in range(40)] + [f"call us at +1 (3{i % 90 + 10}) 555-{i % 9000 + 1000} today" for i in range(900)]
    rows += [f"order 12{i:014d} shipped" for i in range(300)]
    got = pii.spans(table(spark, rows)).collect()
    assert all(r["n_added"] == 1 for r in got if r["doc_id"] < 40)
    assert sum(r["n_added"] for r in got if r["doc_id"] >= 940) == 0


@pytest.mark.parametrize("most", [2_000, 2])
def test_repeats(docs, pairs, most):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    texts = ["a" * 199, "b" * 200, "b" * 201, "c" * 1000, passage + "xx" + passage[:200], passage[60:] + "é", passage[61:] + "z", "q" + passage[:199]]
    spark = docs.sparkSession
    d = docs.unionByName(table(spark, texts, 3 * 10**6))
    rows = [(i, t.encode()) for i, t in pairs] + [(3 * 10**6 + i, t.encode()) for i, t in enumerate(texts)]
    times = Counter(b[s: s + 200] for _, b in rows for s in range(len(b) - 199))
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for s in range(len(b) - 199):
            if times[b[s: s + 200]] > 1:
                gone[s: s + 200] = b"\1" * 200
        left = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(left).hexdigest()))
    same(repeats.without_repeats(d, most=most), want, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert repeats.without_repeats(d.limit(0)).count() == 0


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(3_000):
        s = [rng.randint(0, rng.choice([0, 1, 2, 6])) for _ in range(rng.randint(0, 30))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_sharding(docs, pairs):
    shards = {f"s{i}": 1 + (i == 0) for i in range(7)}
    full = sharding.lookup(shards, 1009)
    share = Counter(full)
    assert share[0] == pytest.approx(2 * 1009 / 8, rel=0.02) and all(share[i] == pytest.approx(1009 / 8, rel=0.02) for i in range(1, 7))
    less = sharding.lookup({k: v for k, v in shards.items() if k != "s3"}, 1009)
    names, rest = list(shards), [k for k in shards if k != "s3"]
    moved = sum(names[a] != rest[b] for a, b in zip(full, less) if names[a] != "s3")
    assert moved < 0.2 * 1009
    want = []
    for i, _ in pairs:
        slot = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) % 1009
        want.append((i, slot, names[full[slot]]))
    same(sharding.placed(docs, F.col("doc_id"), full, names, ["doc_id"]), want, "doc_id", "slot", "shard")
    with pytest.raises(ValueError):
        sharding.lookup(shards, 1000)


def test_sharded_files(docs):
    shards = {"a": 1, "b": 1}
    path = scratch_path(docs.sparkSession, "shards")
    sharding.write_shards(docs, F.col("doc_id"), sharding.lookup(shards, 101), list(shards), path, files=2)
    back = docs.sparkSession.read.parquet(path)
    assert back.count() == docs.count() and {r[0] for r in back.select("shard").distinct().collect()} == {"a", "b"}
    assert set(back.columns) == {*docs.columns, "shard"} and back.where("slot IS NULL").count() == docs.where("slot IS NULL").count()
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumnRenamed("slot", "Shard"), F.col("doc_id"), sharding.lookup(shards, 101), list(shards), path)
    empty = scratch_path(docs.sparkSession, "shards")
    sharding.write_shards(docs.limit(0), F.col("doc_id"), sharding.lookup(shards, 101), list(shards), empty)
    assert docs.sparkSession.read.schema(docs.schema).parquet(empty).count() == 0


def test_warc_round_trip(spark):
    ship(spark)
    rows = [(1, "http://a.b.com/x", "same"), (2, "http://a.b.com/x", "same"), (3, None, "same"), (3, None, "same"), (4, "http://c/ \r\nx", "\r\n\r\nWARC/1.1\r\nWARC-Type: x"),
            (None, "u", None), (7, "u2", ""), (8, "HTTP://A.com:80#f", "é\r\n\r\n"), (None, "u", "zz"), (9, "http://z/", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    import base64
    heads = {}
    for i, _, h in rows:
        if i is not None:
            heads[h or ""] = max(i, heads.get(h or "", i))
    want = []
    for i, _, h in rows:
        b, head = (h or "").encode(), heads.get(h or "")
        again = head is not None and i != head
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", head if again else None))
    path = scratch_path(spark, "warc")
    same(warc.archived(pages, path), want, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    lines = warc.captures(spark, f"{path}/archives")
    assert lines.count() == len(rows)
    index = warc.write_index(lines, f"{path}/again")
    key = warc.capture_key("http://A.b.com/x", 2)
    assert key.startswith("com,b,a)/x ")
    found = warc.find(spark.createDataFrame([(key,), ("nothing",)], "key string"), index)
    assert warc.read_records(found, keep_payload=True).first()["page_id"] == 2 and found.count() == 1
    assert warc.archived(pages.limit(0), scratch_path(spark, "warc")).count() == 0
    assert warc.find(spark.createDataFrame([("a",)], "key string"), warc.write_index(lines.limit(0), f"{path}/none")).count() == 0


def test_warc_directory_of_several_levels(spark, monkeypatch):
    """Blocks of 3 lines under a top of at most 4: four levels, keys that span blocks, archives cut by bytes."""
    ship(spark)
    for name, value in (("LINES_PER_BLOCK", 3), ("MOST_TOP", 4), ("LINES_PER_TASK", 40), ("ARCHIVE_BYTES", 2_000)):
        monkeypatch.setattr(warc, name, value)
    rows = [(i % 97, f"http://h{i % 5}.org/{i % 97}", f"page {i % 13}") for i in range(200)] + [(500, "http://one.org/", "alone"), (500, "http://one.org/", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_path(spark, "warc")
    lines = warc.write_archives(pages, f"{path}/archives")
    assert lines.select("file").distinct().count() > 5
    index = warc.write_index(lines, f"{path}/index")
    assert index.count() <= 4 and index.first()["levels"] >= 3
    got = sorted(tuple(r) for r in warc.find(warc.keys_of(pages), index).collect())
    assert got == sorted(tuple(r) for r in lines.select("file", "offset", "length").collect())
    some = warc.read_records(warc.find(warc.keys_of(pages.where("page_id = 500")), index), keep_payload=True).collect()
    assert [(r["page_id"], r["record_type"], r["payload"]) for r in some] == [(500, "response", "alone")] * 2
    heads = {}
    for i, _, h in rows:
        heads[h] = max(i, heads.get(h, i))
    back = warc.read_records(warc.find(warc.keys_of(pages), index)).select("page_id", "record_type", "refers_to").collect()
    want = [(i, "response" if heads[h] == i else "revisit", None if heads[h] == i else heads[h]) for i, _, h in rows]
    assert sorted(map(str, map(tuple, back))) == sorted(map(str, want))


def test_warc_pages_of_five_megabytes(spark):
    ship(spark)
    pages = spark.range(12).selectExpr("id AS page_id", "concat('http://big.org/', id) AS url", "repeat(concat('<p>', id % 10, '</p>'), 650000) AS html")
    got = warc.archived(pages, scratch_path(spark, "warc")).collect()
    assert sorted((r["page_id"], r["refers_to"]) for r in got) == [(0, 10), (1, 11), *[(i, None) for i in range(2, 12)]] and {r["payload_bytes"] for r in got} == {650_000 * 8}


def test_language(spark, data):
    told = read(spark, data, "documents").select("doc_id", "text", "lang", "source")
    odd = spark.createDataFrame([(10**6, "asdkjh qwpoieur zmxnbv qpwoeiru", "en", "src0"), (10**6 + 1, "", "en", None), (10**6 + 2, None, None, None), (10**6 + 3, "12 34 ## !!", "en", "src1"),
                                 (10**6 + 4, "the of and thing", "xx", None)], told.schema)
    # held out: a fifth has its declared language hidden
    hidden = told.withColumn("truth", F.col("lang")).withColumn("lang", F.when(F.xxhash64("doc_id") % 5 != 0, F.col("lang")))
    got = language.identified(language.from_documents(hidden.drop("truth"))).join(hidden, "doc_id")
    assert got.where("lang IS NULL").count() > 20 and got.where("lang IS NULL AND language <> truth").count() == 0 and got.where("NOT kept").count() == 0
    both = {r["doc_id"]: r for r in language.identified(language.from_documents(told.unionByName(odd))).where("doc_id >= 1000000").collect()}
    assert [both[10**6 + i]["kept"] for i in range(5)] == [False, False, False, False, True] and both[10**6 + 4]["language"] == "en"
    assert language.identified(language.from_documents(told.limit(0))).count() == 0
    kept = language.kept(told.unionByName(odd))
    assert kept.columns == told.columns and kept.count() == told.count() + 1


def test_language_of_pages_uses_host_and_markup(spark):
    """A text too short to tell goes by its host's pages and by what the markup says."""
    ship(spark)
    de, en = "der die und das ist nicht ein eine mit von zu auf", "the and of to in that is for it with as was"
    rows = [(i, f"https://www.h{i % 5}.de/{i}", f'<html lang="de"><body>{de}</body></html>') for i in range(60)] + [
        (100 + i, f"https://e{i % 5}.com/{i}", f"<html lang='en'><p>{en}</p></html>") for i in range(60)] + [(900, "https://www.h1.de/z", "<html><p>in</p></html>"), (901, "https://e1.com/z", "<html><p>in</p></html>"), (902, None, None)]
    got = {r["page_id"]: r for r in language.identified(language.from_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    assert got[900]["language"] == "de" and got[901]["language"] == "en" and not got[902]["kept"]


def test_language_query_identifies_all_documents_and_pages(spark, data, tmp_path):
    """Most pages share a host; two short texts are told apart by host and markup alone."""
    from rampwise.llm.queries import QUERIES

    got = QUERIES["op10_language"](spark, data).cache()
    for name, key in (("documents", "doc_id"), ("pages", "page_id")):
        own = read(spark, data, name).select(F.col(key).cast("long"))
        assert got.where(F.col(key).isNotNull()).select(key).exceptAll(own).count() == 0 and own.exceptAll(got.select(key)).count() == 0
    de, en = "der die und das ist nicht ein eine mit von zu auf", "the and of to in that is for it with as was"
    rows = [(i, f"https://www.hot.de/{i}", f'<html lang="de"><body>{de}</body></html>') for i in range(600)] + [
        (1000 + i, f"https://e{i % 5}.com/{i}", f"<html lang='en'><p>{en}</p></html>") for i in range(60)] + [
        (2000, "https://www.hot.de/z", "<p>in</p>"), (2001, "https://e1.com/z", "<p>in</p>"), (2002, "https://new.hot.de/", "<p>in</p>"), (2003, "https://other.de/", "<p>in</p>"), (2004, None, '<html lang="en"><p>in</p>')]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    read(spark, data, "documents").write.parquet(f"{tmp_path}/documents.parquet")
    told = {r["page_id"]: r["language"] for r in QUERIES["op10_language"](spark, str(tmp_path)).where("page_id >= 2000").collect()}
    assert told == {2000: "de", 2001: "en", 2002: "de", 2003: "de", 2004: "en"}


def test_language_fusion_equals_a_plain_posterior(spark, monkeypatch):
    """Votes, hierarchically smoothed priors and posteriors in plain Python from the texts' likelihoods, with hot and rare values, and with rare ones only."""
    import math

    ship(spark)
    words = {"de": "der die und das ist nicht ein eine mit von zu auf", "en": "the and of to in that is for it with as was"}
    rows = [(i, f"https://w{i % 4}.site{i % 7}.{'com' if i % 5 else 'de'}/{i}" if i % 11 else None,
             f"<html{' lang=' + chr(34) + ('de', 'en', 'xx')[i % 3] + chr(34) if i % 2 else ''}><p>{' '.join(words['de' if i % 3 == 0 else 'en'].split()[i % 6: i % 6 + 1 + i % 5])}</p></html>" if i % 13 else None)
            for i in range(160)] + [(7, "https://w3.site0.com/7", "<html><p>in</p></html>")] * 2
    base = language.from_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn("text", F.coalesce("text", F.lit("")))
    languages = tuple(sorted(language.LANGUAGES))
    names, n, s = [*languages, language.UNKNOWN], len(languages) + 1, language.STRENGTH
    told = language.scored(base, language.trained(base, languages)).collect()
    vote = [r["ll"].index(max(r["ll"])) if r["n_grams"] > 0 else n - 1 for r in told]

    def counts(of):
        found = {}
        for r, v in zip(told, vote):
            if of(r) is not None:
                found.setdefault(of(r), [0.0] * n)[v] += 1
        return found

    said = counts(lambda r: None if r["declared"] is None else r["declared"] if r["declared"] in languages else "other")
    known = [*languages, "other"]
    seen = {d: [x + 1 for x in said.get(d, [0.0] * n)] for d in known}
    overall = [1.0 + vote.count(k) for k in range(n)]
    tables = {level: counts(lambda r: r[level]) for level in ("suffix", "domain", "host")}
    want = []
    for r in told:
        p = [x / sum(overall) for x in overall]
        for level, table in tables.items():
            if r[level] is not None:
                v = table[r[level]]
                p = [(a + s * b) / (sum(v) + s) for a, b in zip(v, p)]
        d = None if r["declared"] is None else seen[r["declared"] if r["declared"] in languages else "other"]
        score = [r["ll"][k] + (math.log(d[k] / sum(seen[x][k] for x in known)) if d else 0.0) + math.log(p[k]) for k in range(n)]
        pick = score.index(max(score)) if r["n_grams"] > 0 else n - 1
        sure = 1 / sum(math.exp(x - max(score)) for x in score) if r["n_grams"] > 0 else 1.0
        want.append((r["page_id"], names[pick], round(sure, 5), pick != n - 1))
    for hot in (language.HOT, 10, 1):  # all values are hot, some, none
        monkeypatch.setattr(language, "HOT", hot)
        got = [(r["page_id"], r["language"], round(r["confidence"], 5), r["kept"]) for r in language.identified(base).collect()]
        assert len(got) == len(want)
        for a, b in zip(sorted(got), sorted(want)):
            assert a[:2] == b[:2] and a[3] == b[3] and abs(a[2] - b[2]) < 3e-5


def test_pieces_bound_what_python_holds():
    """A batch of any size leaves in slices of bounded text, all its rows in order; nulls count as empty, a longer text stands alone."""
    texts = ["x" * 300, None, "", "é" * 100, "y" * 5_000, "z" * 10, None] + ["w" * 99] * 500
    batch = pa.RecordBatch.from_pydict({"text": texts, "i": list(range(len(texts)))})
    got = list(pieces([batch.slice(0, 0), batch, batch.slice(2, 3)], most=1_000))
    assert [i for p in got for i in p.column("i").to_pylist()] == [*range(len(texts)), 2, 3, 4]
    assert [t for p in got for t in p.column("text").to_pylist()] == texts + texts[2:5]
    sizes = [sum(len((t or "").encode()) for t in p.column("text").to_pylist()) for p in got]
    assert all(s <= 1_000 or p.num_rows == 1 for s, p in zip(sizes, got)) and len(got) < 70


def test_repeats_of_rows_without_id(spark):
    """A null id isn't 0, nor are two texts of one id one; hot and other anchors, in one batch or several pieces."""
    rng = random.Random(5)
    some = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (700, 450, 450)]
    rows = [(None, some[0]), (0, some[0][100:] + some[1]), (0, some[1]), (None, some[2]), (0, some[2][:199]), (3, None), (3, "q"), (7, "v" * 300_000)]
    times = Counter(t[s: s + 200] for _, t in rows if t and len(t) < 10**6 for s in range(len(t) - 199))
    want = []
    for i, t in rows[:-1]:
        gone = bytearray(len(t or ""))
        for s in range(len(gone) - 199):
            if times[t[s: s + 200]] > 1:
                gone[s: s + 200] = b"\1" * 200
        left = "".join(x for x, g in zip(t or "", gone) if not g)
        want.append((i, len(gone), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    want.append((7, 300_000, 300_000, hashlib.sha256(b"").hexdigest()))
    d = ship(spark).createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for most in (2_000, 1):
        same(repeats.without_repeats(d, most=most), want, "doc_id", "n_bytes", "n_removed", "kept_sha256")


def test_hot_runs_stay_one_list(spark):
    """The runs of a common passage aren't made rows of their own, and each row gets back its windows that come once."""
    rng = random.Random(9)
    line = "".join(rng.choice("abcdefgh ") for _ in range(600))
    rows = [(i % 30, "".join(rng.choice("abcdefgh ") for _ in range(250)) + line + "".join(rng.choice("abcdefgh ") for _ in range(250))) for i in range(40)]
    rows += rows[:3] + [(None, line), (50, None)]
    times = Counter(t[s: s + 200] for _, t in rows if t for s in range(len(t) - 199))
    want = []
    for i, t in rows:
        gone = bytearray(len(t or ""))
        for s in range(len(gone) - 199):
            if times[t[s: s + 200]] > 1:
                gone[s: s + 200] = b"\1" * 200
        left = "".join(x for x, g in zip(t or "", gone) if not g)
        want.append((i, len(gone), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    d = ship(spark).createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (2_000, 20, 1):
        got = repeats.without_repeats(d, most=most)
        assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
        same(got, want, "doc_id", "n_bytes", "n_removed", "kept_sha256")
