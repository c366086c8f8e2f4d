"""Personal data: candidate spans, boosted trees, calibrated thresholds, redaction.

Generators propose spans of four kinds. Those that meet a kind's strict rule (`BASE`) are
always spans. The looser generators (`LOOSE`) propose more, overlapping at will. Each candidate is
described by its format and context as one of a fixed number of codes; the strict rule's own test (plus sign,
check digit, range of numbers, dots in a domain) is left out of the code. Counting strict and loose
candidates by code covers all documents and gives a table of bounded size, on which boosted trees
learn how likely the strict rule holds. On the documents held out, each kind's threshold is the
least score from which on at least `PRECISION` of the candidates are strict ones; loose candidates of
such codes become spans. All of it is DataFrame operations and Spark's own trees.

A text is worked on in pieces between which no pattern can match (`PIECES`), so a long one costs as much for a character as a short one;
only a long stretch of digits, dots and blanks without any other sign stays one piece.

Null and empty texts have no spans. Places are code points, ends exclusive. Repeated rows and
ids each get a row; extra columns are ignored (kept by `redacted`). An empty table, or one whose
candidates are all strict or all loose, adds no spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rampwise.llm.common import whole
from rampwise.session import pinned

KINDS = ("email", "ip", "card", "phone")
#: Possessive where nothing after could need a step back, so that no text makes a scan quadratic or deep.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z.])[0-9]++(?:\.[0-9]++){3}+(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20.-]?[0-9])++(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+|00)?+\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9A-Za-z])",
}
#: Cheap tests that a text must pass before a kind's patterns are tried.
NEEDS = {"email": r"@|[\[(](?:at|AT)[\])]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20.-]?[0-9]", "phone": r"[0-9][\x20)./-]|\+[0-9]"}
#: Words that announce a kind, in four languages.
CUES = {
    "email": "mail|contact|write|kontakt|courriel|correo",
    "ip": "ip|host|server|address|adresse|servidor",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|anruf|appel|llam",
}
#: Values of each part of a code: kind, before, after, cue, digits, separators, brackets.
SIZES = (4, 3, 3, 2, 6, 4, 2)
FEATURES = ("kind", "before", "after", "cue", "digits", "separators", "brackets")
#: A kind without LEAST held-out candidates above its threshold adds no spans.
PRECISION, TREES, DEPTH, HELD_OUT, LEAST = 0.9, 12, 3, 4, 20
SPAN = "struct<start:int,end:int,value:string>"
#: A text is cut into pieces of about PIECE characters where no pattern can match across: behind a sign that none of them has, and at a
#: blank between letters or a letter and a digit. All work on spans is within a piece, so it grows with the text and not with its square.
PIECE, CONTEXT = 2048, 24
CUT = r"(?:(?<=[^A-Za-z0-9._%+@\x20\[\]()/-])|(?<=[A-Za-z]\x20)(?=[A-Za-z0-9])|(?<=[A-Za-z0-9]\x20)(?=[A-Za-z]))"
PIECES = rf"(?s).{{1,{PIECE}}}(?:\z|{CUT})|.+?(?:\z|{CUT})"
_BLOCK = 64


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)


def _blocks(steps: Column) -> Column:
    """Sums of the full blocks of a list; with them the sum before any place takes few steps however many come before."""
    last = F.floor((F.size(steps) - 1) / _BLOCK).cast("int")
    return F.when(F.size(steps) > _BLOCK, F.transform(F.sequence(F.lit(0), last), lambda b: _total(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))).otherwise(
        F.array().cast("array<int>"))


def _before(steps: Column, blocks: Column, i: Column) -> Column:
    """Sum of the steps before place i."""
    return (_total(F.slice(blocks, 1, F.floor(i / _BLOCK).cast("int")))
            + _total(F.slice(steps, (F.floor(i / _BLOCK) * _BLOCK + 1).cast("int"), i % _BLOCK)))


def cut(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The kept columns with `_p`, the pieces of the text, and for each piece where it begins (`_at`), itself behind the
    end of the piece before (`_near`) and the length of that end (`_lead`)."""
    rows = rows.select(*keep, F.regexp_extract_all(whole(text), F.lit(PIECES), F.lit(0)).alias("_p"))
    rows = rows.select("*", F.transform("_p", lambda c: F.char_length(c)).alias("_len"),
                       F.transform("_p", lambda c, j: F.when(j == 0, F.lit("")).otherwise(F.right(F.get(F.col("_p"), j - 1), F.lit(CONTEXT)))).alias("_tail"))
    rows = rows.select("*", _blocks(F.col("_len")).alias("_blk"))
    # the sizes are looked at so that the optimizer, seeing two uses, doesn't move these columns into the function, once an element
    made = (F.size("_len") > 0) & (F.size("_blk") >= 0)
    return rows.select(*keep, "_p", F.when(made, F.transform("_len", lambda _, j: _before(F.col("_len"), F.col("_blk"), j))).otherwise(F.array().cast("array<int>")).alias("_at"),
                       F.zip_with("_tail", "_p", lambda t, c: F.concat(t, c)).alias("_near"), F.transform("_tail", lambda t: F.char_length(t)).alias("_lead"))


def located(rows: DataFrame, patterns: dict[str, str], suffix: str) -> DataFrame:
    """Adds for each kind the spans of each piece, from the piece's start: what lies between matches gives their places."""
    columns = rows.columns

    def matches(k: str) -> Column:
        return F.transform("_p", lambda c: F.when(c.rlike(NEEDS[k]), F.regexp_extract_all(c, F.lit(patterns[k]), F.lit(0))).otherwise(F.array().cast("array<string>")))

    def gaps(k: str) -> Column:
        return F.transform("_p", lambda c: F.when(c.rlike(NEEDS[k]), F.transform(F.split(c, patterns[k], -1), lambda g: F.char_length(g))).otherwise(F.array().cast("array<int>")))

    found = [made for k in KINDS for made in (matches(k).alias(f"{k}_m"), gaps(k).alias(f"{k}_g"))]
    rows = rows.select("*", *found)
    rows = rows.select("*", *[F.zip_with(f"{k}_m", f"{k}_g", lambda m, g: F.transform(m, lambda v, i: F.get(g, i) + F.char_length(v))).alias(f"{k}_s") for k in KINDS])
    rows = rows.select("*", *[F.transform(f"{k}_s", _blocks).alias(f"{k}_b") for k in KINDS])

    def spans(z: Column, k: str) -> Column:
        start = lambda i: _before(z[f"{k}_s"], z[f"{k}_b"], i) + F.get(z[f"{k}_g"], i)
        placed = F.transform(z[f"{k}_m"], lambda v, i: F.struct(start(i).cast("int").alias("start"), v.alias("value")))
        return F.transform(placed, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.char_length(x["value"])).alias("end"), x["value"].alias("value")))

    of_kind = lambda k: F.transform(F.arrays_zip(f"{k}_m", f"{k}_g", f"{k}_s", f"{k}_b"), lambda z: spans(z, k))
    return rows.select(*columns, *[of_kind(k).alias(f"{k}{suffix}") for k in KINDS])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    padded = F.lpad(digits, 19, "0")
    number = lambda at: F.substring(padded, at, 1).cast("int")
    parts = [number(19 - j) * 2 - F.when(number(19 - j) > 4, 9).otherwise(0) if j % 2 else number(19 - j) for j in range(19)]
    return reduce(lambda a, b: a + b, parts) % 10 == 0


def strict(kind: str, v: Column) -> Column:
    """The rule that a match of the kind's base pattern must pass."""
    n = F.char_length(_digits(v))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return v.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return n.between(14, 19) & _luhn(_digits(v))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _shaped(spans: Column, kind: str, z: Column, ok: bool) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"),
                                                 F.lit(ok).alias("strict"), _code(kind, z["_near"], z["_lead"], x).alias("code")))


def _free(kind: str, loose: Column, own: Column) -> Column:
    """Loose candidates that meet no strict span of their kind."""
    free = F.filter(loose, lambda x: ~F.exists(own, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return F.filter(free, lambda x: F.char_length(_digits(x["value"])).between(13, 19)) if kind == "card" else free


def _of_kind(spans: str, i: int) -> Column:
    return F.filter(spans, lambda x: x["kind"] == i)


def _code(kind: str, near: Column, lead: Column, x: Column) -> Column:
    """Format and context of a candidate as one number below the product of SIZES."""
    start = x["start"] + lead
    before, after = F.substring(near, start, F.lit(1)), F.substring(near, x["end"] + lead + 1, F.lit(1))
    before = F.when(start == 0, F.lit("")).otherwise(before)
    side = lambda c: F.when(c.rlike("^[A-Za-z0-9]$"), 2).when(c.rlike(r"^[^\s]$"), 1).otherwise(0)
    context = F.lower(F.substring(near, F.greatest(F.lit(1), start - CONTEXT + 1), F.least(F.lit(CONTEXT), start)))
    bare = F.regexp_replace(x["value"], r"^\+[0-9]{1,3}[\x20.-]", "")  # the local part of a number with a country code
    n = F.char_length(_digits(bare if kind == "phone" else x["value"]))
    digits = F.when(n < 7, 0).when(n < 10, 1).when(n < 12, 2).when(n < 14, 3).when(n < 17, 4).otherwise(5)
    signs = F.char_length(F.regexp_replace(bare, r"[^\x20.()@-]", ""))
    separators = F.when(signs == 0, 0).when(signs < 3, 1).when(signs == 3, 2).otherwise(3)
    parts = (F.lit(KINDS.index(kind)), side(before), side(after), context.rlike(rf"\b(?:{CUES[kind]})").cast("int"), digits, separators, x["value"].rlike(r"[()\[\]]").cast("int"))
    return reduce(lambda total, p: total * p[0] + p[1], zip(SIZES, parts), F.lit(0)).cast("int")


def by_piece(rows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with `_p` and `_at` of the pieces and `found` for each: kind, start, end from the piece's start, code and whether the strict rule holds."""
    rows = located(cut(rows, keep, text), BASE, "")
    strict_ones = lambda k: F.transform(k, lambda spans: F.filter(spans, lambda x: strict(k, x["value"])))
    rows = rows.select(*keep, "_p", "_at", "_near", "_lead", *[strict_ones(k).alias(k) for k in KINDS])
    rows = located(rows, LOOSE, "_l")
    free_ones = lambda k: F.zip_with(f"{k}_l", k, lambda loose, own: _free(k, loose, own))
    rows = rows.select(*keep, "_p", "_at", "_near", "_lead", *KINDS, *[free_ones(k).alias(f"{k}_f") for k in KINDS])
    each = lambda z: F.concat(*[_shaped(z[k], k, z, True) for k in KINDS], *[_shaped(z[f"{k}_f"], k, z, False) for k in KINDS])
    found = F.transform(F.arrays_zip("_near", "_lead", *KINDS, *[f"{k}_f" for k in KINDS]), lambda z: F.array_sort(each(z)))
    return rows.select(*keep, "_p", "_at", found.alias("found"))


def candidates(rows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with `found`: kind, start, end, code and whether the strict rule holds, by start."""
    moved = F.zip_with("_at", "found", lambda at, piece: F.transform(piece, lambda x: F.struct(
        (x["start"] + at).alias("start"), x["kind"].alias("kind"), (x["end"] + at).alias("end"), x["strict"].alias("strict"), x["code"].alias("code"))))
    return by_piece(rows, keep, text).select(*keep, F.flatten(moved).alias("found"))


def _parts(code: Column) -> list[Column]:
    out, below = [], 1
    for name, size in reversed(list(zip(FEATURES, SIZES))):
        out.append(F.pmod(F.floor(code / below), F.lit(size)).cast("double").alias(name))
        below *= size
    return out[::-1]


def accepted(found: DataFrame) -> list[int]:
    """Codes whose loose candidates become spans: at most as many numbers as there are codes.

    `found` has a row for each candidate: fold (0 is held out), code, strict.
    """
    spark = found.sparkSession
    counts = found.groupBy("code", (F.col("fold") == 0).alias("held"), "strict").agg(F.count("*").cast("double").alias("n")).coalesce(1)
    counts = pinned(counts)  # at most four rows for each code
    learn = counts.where("NOT held").select(*_parts(F.col("code")), F.col("strict").cast("double").alias("label"), F.col("n").alias("weight"))
    if learn.select("label").distinct().count() < 2:
        return []
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, weightCol="weight").fit(vector.transform(learn))
    total = reduce(lambda a, b: a * b, SIZES)
    codes = spark.range(0, total, 1, 1).select(F.col("id").cast("int").alias("code"), *_parts(F.col("id")))
    scores = trees.transform(vector.transform(codes)).select("code", "kind", vector_to_array("probability")[1].alias("score"))
    held = counts.where("held").groupBy("code").agg(F.sum(F.when(F.col("strict"), F.col("n"))).alias("yes"), F.sum("n").alias("all"))
    from_top = Window.partitionBy("kind").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    ranked = scores.join(held, "code").select("code", "kind", "score", F.coalesce(F.sum("yes").over(from_top), F.lit(0.0)).alias("yes"), F.sum("all").over(from_top).alias("all"))
    least = ranked.where((F.col("yes") >= PRECISION * F.col("all")) & (F.col("all") >= LEAST)).groupBy("kind").agg(F.min("score").alias("least"))
    return sorted(r["code"] for r in scores.join(least, "kind").where(F.col("score") >= F.col("least")).select("code").collect())


def _exploded(found: DataFrame) -> DataFrame:
    return found.select(F.pmod(F.xxhash64("doc_id", F.size("found")), F.lit(HELD_OUT)).alias("fold"), F.explode("found").alias("x")).select("fold", "x.code", "x.strict")


def chosen(found: Column, codes: list[int]) -> Column:
    """The spans among those found: all strict ones, and loose ones of accepted codes."""
    held = F.split(F.lit(",".join(map(str, codes or [-1]))), ",").cast("array<int>")  # a constant
    return F.filter(found, lambda x: x["strict"] | F.array_contains(held, x["code"]))


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of every document."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = pinned(candidates(base, ["doc_id"]).select("doc_id", "found"))  # spans only, far smaller than the texts
    rows = found.select("doc_id", chosen(F.col("found"), accepted(_exploded(found))).alias("all"))
    rows = rows.select("doc_id", "all", F.filter("all", lambda x: x["strict"]).alias("base"))
    names = F.array(*map(F.lit, KINDS))
    said = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))
    return rows.select("doc_id", *[F.size(_of_kind("base", i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],
                       F.sha2(said("base"), 256).alias("base_sha256"), said("all").alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_added"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with each span in the text replaced by its kind in brackets; overlapping spans go as one, named by the first.

    A text without spans stays as it is, null included.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    counted = pinned(candidates(docs.select("doc_id", F.col(text).alias("text")), ["doc_id"]).select("doc_id", "found"))  # without the texts
    codes = accepted(_exploded(counted))
    rows = by_piece(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), ["_row"], "_text")
    empty = F.struct(F.lit(-1).alias("end"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))
    one = lambda start, kind, end: F.array(F.struct(start.alias("start"), kind.alias("kind"), end.alias("end")))

    def put(acc: Column, x: Column) -> Column:
        """A span behind those before it, or grown into the last one where they meet."""
        last, end = F.element_at(acc["out"], -1), F.greatest(acc["end"], x["end"])
        return F.when(x["start"] >= acc["end"], F.struct(x["end"].alias("end"), F.concat(acc["out"], one(x["start"], x["kind"], x["end"])).alias("out"))).otherwise(
            F.struct(end.alias("end"), F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), one(last["start"], last["kind"], end)).alias("out")))

    def replaced(z: Column) -> Column:
        begun = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(z["m"], i - 1)["end"])
        parts = F.transform(z["m"], lambda x, i: F.concat(F.substring(z["_p"], begun(i) + 1, x["start"] - begun(i)), F.get(names, x["kind"])))
        rest = F.substring(z["_p"], F.element_at(z["m"], -1)["end"] + 1, F.lit(2**31 - 1))
        return F.when(F.size(z["m"]) > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(z["_p"])

    merged = F.transform("found", lambda piece: F.aggregate(chosen(piece, codes), empty, put, lambda acc: acc["out"]))
    rows = rows.select("_row", "_p", merged.alias("m"))
    some = F.exists("m", lambda x: F.size(x) > 0)
    new = F.when(some, F.array_join(F.transform(F.arrays_zip("_p", "m"), replaced), "")).otherwise(F.col(f"_row.{text}"))
    return rows.select("_row", new.alias("_new")).select(*[F.col("_new").alias(text) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
