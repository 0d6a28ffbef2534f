"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their scores.

DataFrame functions only. Positions come from splitting at the same expression that finds the matches: a match begins
after all gaps and matches before it. Every expression runs in time linear in the text: runs are possessive and anchored
at their first character, and no group repeats without a bound, so neither a run of 100,000 digits nor a number table
makes Java's matcher recurse.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import running_sums
from .common import read


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    guard: str  # a cheap test that texts without any such span fail
    base: float  # score of a confirmed span
    context: str  # words that raise the score
    raise_by: float
    against: str = "order|invoice|serial|part n|sku|isbn|version|build|commit"  # words that lower it: numbers of another sort
    lower_by: float = 0.3


_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: The first four are the base kinds, in the order in which they are listed.
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@(?=[{_HOST}]++\.[{_HOST}])[{_HOST}.]+?(?=\.\.|\.?(?![{_HOST}.]))", "@", 0.8, "mail|contact|write|kontakt|correo", 0.2),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"\bip\b|host|server|address|login|adresse", 0.3),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])", r"[0-9][0-9\x20-]{11}", 0.7, "card|visa|credit|karte|carte|tarjeta", 0.3),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, "phone|call|tel|fax|mobile|anruf|appel", 0.3),
    # A chance number passes mod 97 once in 97: words around it decide.
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.7, "iban|bank|account|konto|compte|cuenta", 0.3),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-", 0.3, r"\bssn\b|social security", 0.6),
    # Nothing confirms a date of birth but what is written near it.
    Kind("born", r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2})(?![0-9./-])", r"[0-9][./-][0-9]", 0.3, r"\bborn\b|birth|\bdob\b|geboren|geburt|naissance|né[e]? le|nacid|nacimiento", 0.4),
)
BASE = tuple(k.name for k in KINDS[:4])
#: A span beyond the base kinds is reported if its score is this or more; the base kinds' spans are always.
ACCEPT = 0.5
#: Characters on either side of a span that are searched for context words.
NEAR = 40
_SPAN = "struct<kind:string,start:int,end:int,value:string,score:double,byte_start:int,byte_end:int>"
_RAW = "struct<start:int,end:int,value:string,byte_start:int,byte_end:int,around:string>"


def _mod97(value: Column) -> Column:
    """IBAN checksum: the first four characters go to the end, letters count from 10; the remainder by 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    digit = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c <= "9", 10).otherwise(100) + digit(c)) % 97))


def _confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34) & (_mod97(value) == 1)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "born":
        parts = F.split(value, "[./-]")
        year_first = F.length(F.get(parts, F.lit(0))) == 4
        day, month = (F.when(year_first, F.get(parts, F.lit(a))).otherwise(F.get(parts, F.lit(b))).cast("int") for a, b in ((2, 0), (1, 1)))
        # Day and month come in either order where the year is last.
        return (F.least(day, month).between(1, 12) & F.greatest(day, month).between(1, 31)) & (~year_first | (month <= 12))
    return F.lit(True)


def _proposed(text: Column, kind: Kind) -> Column:
    return text.contains(kind.guard) if kind.guard == "@" else text.rlike(kind.guard)


def _gaps(text: Column, kind: Kind) -> Column:
    """What lies before the first match, between matches and after the last, in order."""
    return F.when(_proposed(text, kind), F.split(text, kind.pattern, -1)).otherwise(F.array().cast("array<string>"))


def _raw(text: Column, kind: Kind, gaps: Column) -> Column:
    """All matches of the kind's expression with their places and surroundings, leftmost and not overlapping."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    after = F.slice(gaps, 2, F.size(gaps))
    none = F.lit(0)

    def step(x: Column) -> Column:
        value, gap = x["value"], x["gap"]
        around = F.concat(F.right(gap, F.lit(NEAR)), F.lit("\n"), F.left(F.coalesce(x["after"], F.lit("")), F.lit(NEAR)))
        return F.struct(
            (F.length(gap) + F.coalesce(F.length(value), none)).alias("n"), (F.octet_length(gap) + F.coalesce(F.octet_length(value), none)).alias("b"), value.alias("value"), F.lower(around).alias("around")
        )

    # The last gap has no match after it: its row has no value and goes.
    steps = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("value"), after.alias("after")), step)
    ends = F.arrays_zip(running_sums(steps["n"]).alias("end"), running_sums(steps["b"]).alias("byte_end"))

    def span(e: Column, x: Column) -> Column:
        v = x["value"]
        return F.struct((e["end"] - F.length(v)).alias("start"), e["end"].alias("end"), v.alias("value"), (e["byte_end"] - F.octet_length(v)).alias("byte_start"), e["byte_end"].alias("byte_end"), x["around"].alias("around"))

    spans = F.filter(F.zip_with(ends, steps, span), lambda x: x["value"].isNotNull()).cast(f"array<{_RAW}>")
    return F.when(F.size(gaps) > 1, spans).otherwise(F.array().cast(f"array<{_RAW}>"))


def _scored(kind: Kind, raw: Column) -> Column:
    kept = F.filter(raw, lambda x: _confirmed(kind.name, x["value"]))

    def score(x):
        near = lambda words, by: F.when(x["around"].rlike(words), F.lit(by)).otherwise(F.lit(0.0))
        value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(kind.base) + near(kind.context, kind.raise_by) - near(kind.against, kind.lower_by)))
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), value.alias("score"), x["byte_start"].alias("byte_start"), x["byte_end"].alias("byte_end"))

    scored = F.transform(kept, score)
    return (scored if kind.name in BASE else F.filter(scored, lambda x: x["score"] >= ACCEPT)).cast(f"array<{_SPAN}>")


def find_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """`docs` with the column `out`: all spans (kind, start, end, value, score, byte_start, byte_end), by kind in the order
    of KINDS, then start.

    start and end count code points, end exclusive; byte_start and byte_end the UTF-8 bytes. A span's context is what
    surrounds it, up to NEAR characters a side, as far as the next span of its kind; words there raise or lower the score. A
    null or empty text has no spans; a text of any length is searched whole; repeated rows give one row each; an empty table
    gives none. Kinds may overlap one another. The base kinds (BASE) are the leftmost non-overlapping matches that pass their
    test, whatever their score; iban (mod 97), ssn and born (dates of birth) come on top, where their score is ACCEPT or more. Columns
    of `docs` stay as they are; one named like `out` is replaced."""
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    cut = docs.select(*kept, *[_gaps(whole, k).alias(f"__gaps_{k.name}") for k in KINDS])
    raw = cut.select(*kept, *[_raw(whole, k, F.col(f"__gaps_{k.name}")).alias(f"__raw_{k.name}") for k in KINDS])
    return raw.select(*kept, F.concat(*[_scored(k, F.col(f"__raw_{k.name}")) for k in KINDS]).alias(out))


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; where spans overlap, the first names the whole stretch.
    A null text stays null."""
    found = find_spans(docs, text, "__spans")
    spans = F.array_sort(F.col("__spans"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    whole = F.col(text)
    raw = whole.cast("binary")  # bytes are cut without walking the text from its beginning
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        between = F.substring(raw, a["at"] + 1, x["byte_start"] - a["at"]).cast("string")
        add = F.when(x["byte_start"] >= a["at"], F.array(between, F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(a["at"], x["byte_end"]).alias("at"), F.concat(a["out"], add).alias("out"))

    rest = lambda a: F.substring(raw, a["at"] + 1, F.octet_length(raw)).cast("string")
    cut = F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), rest(a)))
    masked = F.when(whole.isNull() | (F.size("__spans") == 0), whole).otherwise(cut)
    return found.select(*[(masked if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    scores = F.array_join(F.transform("pii", lambda x: F.format_string("%.1f", x["score"])), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), scores.alias("scores"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the spans of every document and their scores, one row per row of documents; nulls, long texts, repeats and empty
    tables as in find_spans()."""
    return digest(find_spans(read(spark, sf_dir, "documents", "doc_id", "text")))
