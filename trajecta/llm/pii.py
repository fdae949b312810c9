"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Column functions only. A text is matched and split by the same pattern, so the lengths of
pieces and matches give every position in one linear pass over the text. The patterns are
written with possessive loops, which find the same matches as greedy ones without
backtracking or deep recursion on very long texts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table

WINDOW = 40  # characters before a span in which context words count
STEP, LEAST = 0.25, 0.5  # what a context word adds or takes; the least score of an added span
LUHN, MOD97 = 10, 97


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check."""
    def total(d: Column) -> Column:
        each = F.transform(F.split(F.reverse(d), ""), lambda c, i: c.cast("int") * (1 + i % 2))
        return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))

    return let(_digits(v), lambda d: F.length(d).between(13, 19) & (F.when(F.length(d) <= 19, total(d)).otherwise(1) % LUHN == 0))


def mod97(v: Column) -> Column:
    """Whether an account number of 15 to 34 characters passes the mod-97 check."""
    def rest(c: Column) -> Column:
        turned = F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))
        value = lambda x: F.ascii(x) - F.when(F.ascii(x) >= 65, 55).otherwise(48)
        return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, x: (a * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % MOD97)

    return let(F.regexp_replace(v, " ", ""), lambda c: F.length(c).between(15, 34) & (rest(c) == 1))


def _octets(v: Column) -> Column:
    part = lambda p: F.regexp_replace(p, r"\A0+(?=[0-9])", "")
    return F.forall(F.split(v, r"\."), lambda p: let(part(p), lambda n: (F.length(n) <= 3) & (F.when(F.length(n) <= 3, n).otherwise("999").cast("int") <= 255)))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    quick: Callable[[Column], Column]  # a cheap test that every text with a match passes
    valid: Callable[[Column], Column]
    score: float
    nearby: str
    against: str = r"(?i)\b(?:version|isbn|issn|order|item|page|sku)\b"
    base: bool = True


#: The first four kinds are fixed; the method adds the rest.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda v: F.lit(True), 0.9, r"(?i)\b(?:e-?mail|contact|correo|courriel|kontakt)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")), _octets, 0.6, r"(?i)\b(?:ip|host|server|address|login)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")), luhn, 0.7, r"(?i)\b(?:card|visa|mastercard|credit|debit|karte|carte|tarjeta)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda v: F.length(_digits(v)).between(9, 15), 0.7, r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|teléfono|téléphone)\b"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: F.rlike(t, F.lit(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")), mod97, 0.8, r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: F.rlike(t, F.lit(r"[0-9]-[0-9]{2}-[0-9]")), lambda v: ~F.rlike(v, F.lit(r"\A(?:000|666|9[0-9]{2})|-00-|-0000\z")), 0.3, r"(?i)\b(?:ssn|social security)\b", base=False),
)


def running_ends(lengths: Column, chunk: int = 128) -> Column:
    """Inclusive running sums of an array in near-linear time: sums of chunks, then inside each chunk."""
    plus = lambda a, x: a + x
    zero = F.lit(0).cast("long")
    part = lambda v, c, n: F.aggregate(F.slice(v, c * chunk + 1, n), zero, plus)

    def inside(v: Column, sums: Column, c: Column) -> Column:
        upto = F.sequence(F.lit(1), F.least(F.lit(chunk), F.size(v) - c * chunk))
        return let(F.aggregate(F.slice(sums, F.lit(1), c), zero, plus), lambda before: F.transform(upto, lambda i: before + part(v, c, i)))

    def whole(v: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int"))
        return let(F.transform(chunks, lambda c: part(v, c, F.lit(chunk))), lambda sums: F.flatten(F.transform(chunks, lambda c: inside(v, sums, c))))

    return F.when(F.size(lengths) > 0, let(lengths, whole)).otherwise(F.array().cast("array<bigint>"))


def proposals(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, score>> of the confirmed matches of a kind; code points, end exclusive."""
    matches, pieces = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)

    def spans(m: Column, s: Column) -> Column:
        lengths = F.zip_with(F.slice(s, F.lit(1), F.size(m)), m, lambda p, v: (F.length(p) + F.length(v)).cast("long"))
        ends = running_ends(lengths)
        before = F.transform(F.slice(s, F.lit(1), F.size(m)), lambda p: F.substring(p, -WINDOW, WINDOW))
        score = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(kind.score) + F.when(F.rlike(c, F.lit(kind.nearby)), STEP).otherwise(0.0) - F.when(F.rlike(c, F.lit(kind.against)), STEP).otherwise(0.0))), 4)
        full = F.zip_with(F.arrays_zip(ends.alias("e"), before.alias("c")), m, lambda z, v: F.struct((z["e"] - F.length(v)).alias("start"), z["e"].alias("end"), score(z["c"]).alias("score"), v.alias("value")))
        kept = F.filter(full, lambda x: kind.valid(x["value"]) if kind.base else kind.valid(x["value"]) & (x["score"] >= LEAST))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))

    found = let(matches, lambda m: let(pieces, lambda s: spans(m, s)))
    return F.when(kind.quick(text), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,score:double>>"))


def find_pii(docs: DataFrame, kinds=KINDS) -> DataFrame:
    """``docs`` with an array ``found_<kind>`` of (start, end, score) for each kind.

    The whole text is searched; a null text counts as empty and has no spans. Repeated rows
    are all searched. An input column that already has such a name is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.drop(*[f"found_{k.name}" for k in kinds])
    return docs.select("*", *[proposals(text, k).alias(f"found_{k.name}") for k in kinds])


def redact(docs: DataFrame, kinds=KINDS) -> DataFrame:
    """``docs`` with each confirmed span in ``text`` replaced by its kind, like ``<EMAIL>``."""
    def masked(text: Column, kind: Kind) -> Column:
        word = F.lit(f"<{kind.name.upper()}>")
        matches, pieces = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
        near = lambda p: F.lit(True) if kind.base or kind.score >= LEAST + STEP else F.rlike(F.substring(p, -WINDOW, WINDOW), F.lit(kind.nearby))
        fill = lambda p, v: F.concat(p, F.when(v.isNull(), "").when(kind.valid(v) & near(p), word).otherwise(v))
        return F.when(kind.quick(text), let(matches, lambda m: F.array_join(F.zip_with(pieces, m, fill), ""))).otherwise(text)

    for kind in kinds:
        docs = docs.withColumn("text", masked(F.col("text"), kind))
    return docs


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Contract query: base spans, their digest, and all spans."""
    found = find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = lambda name: lambda x: F.concat_ws(":", F.lit(name), x["start"].cast("string"), x["end"].cast("string"))
    listed = lambda kinds: F.concat(*[F.transform(f"found_{k.name}", told(k.name)) for k in kinds])
    base = [k for k in KINDS if k.base]
    return found.select(
        "doc_id",
        *[F.size(f"found_{k.name}").cast("long").alias(f"n_{k.name}") for k in base],
        F.sha2(F.array_join(listed(base), ","), 256).alias("base_sha256"),
        F.array_join(listed(KINDS), ",").alias("spans"),
    )
