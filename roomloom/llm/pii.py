"""Personal data: patterns, checksums and context words, in DataFrame functions only.

Patterns propose spans, leftmost and non-overlapping for each kind; validators
confirm them (parts of an address at most 255, Luhn, mod 97, digit counts); a
score starts from the kind's weight, rises with a checksum and with words that
announce the kind shortly before the span, and falls with words that speak
against it.  Spans that score ``threshold`` or more are returned.  The four base
kinds start above the threshold, so that context never drops them; national phone
numbers, cards of 13 to 15 digits and secrets start below it, so that they count only
where a word announces them.

Offsets count code points, the end exclusive.

Defined cases: a null text is empty and has no spans; repeated rows give equal
results; an empty table gives no rows; columns of the input are kept, except
that they are replaced by an output column of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

BASE_KINDS = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class Kind:
    """``pattern`` finds candidates; ``hint`` is a cheaper pattern that any text with one has."""

    name: str
    pattern: str
    hint: str
    weight: float
    checksum: float = 0.0
    words: str = ""
    against: str = ""


#: A run that cannot start a match where it begins cannot start one further in,
#: so a match starts where its run does, or where the last match ended.  With
#: possessive repeats this keeps the time linear and the stack flat on long runs.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, words="mail|contact|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]", 0.7, words="ip|host|server|addr", against="version|release"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", 0.6, 0.3, words="card|visa|credit|karte|tarjeta|carte", against="isbn|order"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, words="tel|phone|call|mobile|fax", against="score|odds"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", 0.3, 0.5, words="iban|account|konto|cuenta|compte"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.3, words="ssn|social security", against="serial|part"),
    Kind("national", r"(?<![0-9+.-])\(?0[0-9]{2,4}\)?[\x20/.-][0-9]{3,4}[\x20.-]?[0-9]{3,5}(?![0-9])", r"0[0-9]{2,4}\)?[\x20/.-][0-9]", 0.3, words="tel|phone|call|mobile|fax", against="score|odds|order"),
    Kind("short_card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}", 0.2, 0.2, words="card|visa|credit|karte|tarjeta|carte|amex", against="isbn|order"),
    Kind("key_id", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])", "AKIA", 0.7),
    Kind("secret", r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,64}(?![A-Za-z0-9])", r"(?i)passw|token|secret|api.?key", 0.3, words="passw|token|secret|api.?key|bearer", against="sha|commit|digest"),
)

_SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, 1).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod_97(match: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, is 1 modulo 97."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
    step = lambda r, c: (r * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]|)"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "short_card":
        return F.when(n.between(13, 15), luhn(_digits(match))).otherwise(False)
    if kind == "iban":
        return mod_97(match)
    return F.lit(True)


def running(values: Column, step, zero: int = 0, block: int = 256) -> Column:
    """For each of an array of longs ``step`` over all values before it.

    Whole arrays are never copied once a value: blocks are scanned by themselves, then
    shifted by what the blocks before them give.  ``step`` is associative, such as a sum.
    """
    none = F.array().cast("array<bigint>")
    start = F.struct(F.lit(zero).cast("long").alias("at"), none.alias("out"))

    def scan(items: Column) -> Column:
        grow = lambda acc, v: F.struct(step(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(items, start, grow)

    count = F.ceil(F.size(values) / F.lit(block)).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), count), lambda b: scan(F.slice(values, (b - 1) * block + 1, F.lit(block))))

    def joined(scanned: Column) -> Column:
        return let(scan(F.transform(scanned, lambda s: s["at"]))["out"], lambda before: F.flatten(F.transform(scanned, lambda s, i: F.transform(s["out"], lambda v: step(F.get(before, i), v)))))

    return F.when(F.size(values) > 0, let(blocks, joined)).otherwise(none)


def spans_of(kind: Kind, text: Column, threshold: float, reach: int = 40) -> Column:
    """Array of (kind, start, end, score) of one kind; ``text`` is not null.

    The text is split at the matches: a match starts behind all parts and
    matches before it.  Context is the ``reach`` characters before the span.
    """
    def placed(pairs: Column) -> Column:
        lengths = F.transform(pairs, lambda x: (F.length(x["part"]) + F.length(x["match"])).cast("long"))

        def span(x: Column, at: Column) -> Column:
            start = at + F.length(x["part"])
            return F.struct(start.alias("start"), (start + F.length(x["match"])).alias("end"), x["match"].alias("match"), F.lower(F.right(x["part"], F.lit(reach))).alias("before"))

        return let(running(lengths, lambda a, b: a + b), lambda at: F.transform(pairs, lambda x, i: span(x, F.get(at, i))))

    pairs = let(F.split(text, kind.pattern, -1), lambda parts: F.zip_with(F.slice(parts, 1, F.size(parts) - 1), F.regexp_extract_all(text, F.lit(kind.pattern), 0), lambda p, m: F.struct(p.alias("part"), m.alias("match"))))
    near = lambda before, w, gain: F.when(before.rlike(rf"\b(?:{w})"), F.lit(gain)).otherwise(F.lit(0.0)) if w else F.lit(0.0)
    score = lambda s: F.round(F.lit(kind.weight + kind.checksum) + near(s["before"], kind.words, 0.3) + near(s["before"], kind.against, -0.2), 3)
    scored = F.transform(
        F.filter(let(pairs, placed), lambda s: _valid(kind.name, s["match"])),
        lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score(s).alias("score")),
    )
    if kind.name not in BASE_KINDS:
        scored = F.filter(scored, lambda s: s["score"] >= threshold)
    return F.when(text.rlike(kind.hint), scored).otherwise(F.array().cast(_SPAN))


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with ``pii``: array of (kind, start, end, score), by kind as listed, then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = [spans_of(k, text, threshold) for k in kinds]
    return docs.withColumn("pii", F.concat(*found))


def _cutter(text: Column, body, piece: int = 1024) -> Column:
    """``body(cut)`` with ``cut(start, end)`` taken from pieces of the text, as a position in a long
    text costs a walk from its start."""
    def within(pieces: Column):
        def cut(start: Column, end: Column) -> Column:
            first, last = F.floor(start / piece), F.floor(end / piece)
            some = F.array_join(F.slice(pieces, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
            return F.when(start < end, F.substring(some, (start - first * piece + 1).cast("int"), (end - start).cast("int"))).otherwise(F.lit(""))

        return body(cut)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0)), within)


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first one's."""
    def pieces(s: Column) -> Column:
        # A span is replaced where all before it have ended.
        ended = running(F.transform(s, lambda x: x["end"]), F.greatest)

        def joined(cut, at: Column) -> Column:
            one = lambda x, i: F.when(x["start"] >= F.get(at, i), F.concat(cut(F.get(at, i), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
            rest = cut(F.array_max(F.transform(s, lambda x: x["end"])), F.length(text).cast("long"))
            return F.concat(F.array_join(F.transform(s, one), ""), rest)

        return let(ended, lambda at: _cutter(text, lambda cut: joined(cut, at)))

    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.when(F.size(spans) == 0, text).otherwise(let(in_order, pieces))


def span_list(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans (of some kinds), comma-joined in their order."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
