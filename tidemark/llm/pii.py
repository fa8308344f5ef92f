"""Personal data in texts. Native DataFrame functions only: no shuffle, one pass over each text.

Regular expressions propose spans, validators confirm them (digit counts, Luhn, mod 97, number
ranges), and context words near a span raise or lower its score. ``split`` by the same expression
gives the gaps between matches, so positions are sums of lengths. Expressions use look-behind and
possessive quantifiers so that a text of any length costs time in proportion.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bind, packed, unpacked

#: Lengths summed at a time when matches are turned into positions.
BLOCK = 64
#: Code points on either side of a span in which context words count.
NEAR = 48


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def n_digits(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(digits(m)).between(low, high)


def luhn(match: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", digits(match)), F.lit(False))


def mod97(match: Column) -> Column:
    """ISO 7064: the first four characters go last, letters count 10 to 35, the remainder by 97 is 1."""
    bare = F.upper(F.regexp_replace(match, "[^A-Za-z0-9]", ""))
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    value = lambda c: F.instr(F.lit("0123456789" + UPPER), c).cast("int") - 1
    step = lambda r, c: F.when(value(c) < 10, (r * 10 + value(c)) % 97).otherwise((r * 100 + value(c)) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


def octets(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


@dataclass(frozen=True)
class Kind:
    """What to look for. ``gate``: cheap test that a text without a match usually fails. ``score``: with the check passed and no context word near; a context word adds ``lift``."""

    name: str
    pattern: str
    gate: str
    check: Callable[[Column], Column] = lambda m: F.lit(True)
    score: float = 1.0
    context: str = ""
    lift: float = 0.4
    base: bool = False


BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "[A-Za-z0-9._%+-]@[A-Za-z0-9-]", score=0.9, context="mail|contact|write to|correo|courriel", lift=0.1, base=True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", octets, 0.7, "address|host|server|ip", 0.3, True),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9][\x20-]?[0-9]", lambda m: n_digits(14, 19)(m) & luhn(m), 0.8, "card|visa|credit|payment|karte|tarjeta|carte", 0.2, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", n_digits(10, 15), 0.7, "phone|call|tel|mobile|fax|whatsapp", 0.3, True),
)
#: Kinds beyond the base; a span stays if its score reaches the threshold.
MORE = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", lambda m: F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m), 0.9, "iban|account|konto|compte|cuenta", 0.1),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", score=0.5, context="ssn|social security|taxpayer", lift=0.4),
    Kind("local_phone", r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])", "[0-9][.\x20-][0-9]", score=0.4, context="phone|call|tel|mobile|fax|whatsapp", lift=0.4),
)
THRESHOLD = 0.6


def varied(match: Column) -> Column:
    """A secret, not a word or a placeholder: a digit, and at least six different characters."""
    return match.rlike("[0-9]") & (F.size(F.array_distinct(F.split(match, ""))) >= 6)


#: Words before an assigned secret.
_NAMES = "(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?secret)"
#: Credentials. The value of an assignment is the span, without the name and the quotes.
SECRETS = (
    Kind("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----", "-----BEGIN ", score=1.0),
    Kind("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", "(?:AKIA|ASIA)[A-Z0-9]", varied, 0.9),
    Kind("service_token", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk[-_](?:live_|test_|proj-)?[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])", "gh[pousr]_|xox[abprs]-|sk[-_]", varied, 0.9),
    Kind("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+", "eyJ[A-Za-z0-9_-]", score=0.9),
    Kind("secret", rf"(?i)(?<=\b{_NAMES}[\"']?[ \t]{{0,4}}[:=][ \t]{{0,4}}[\"']?)[A-Za-z0-9+/_=.~-]{{8,}}+", rf"(?i){_NAMES}[\"']?[ \t]{{0,4}}[:=]", varied, 0.6, "key|token|secret|password|login|credential", 0.3),
)


def _ends(lengths: Column) -> Column:
    """Running sums of a bound array of lengths, by blocks, so that many matches do not cost the square of their number."""
    n_blocks = F.ceil(F.size(lengths) / BLOCK).cast("int")
    # slice() copies all of its array, so blocks are taken element by element.
    block = lambda b: F.transform(F.sequence(b * BLOCK, F.least(b * BLOCK + BLOCK, F.size(lengths)) - 1), lambda i: F.get(lengths, i))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    sums = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: total(block(b)))
    return bind(sums, lambda s: F.flatten(F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: bind(total(F.slice(s, 1, b)), lambda before: bind(
        block(b), lambda own: F.transform(own, lambda _, i: before + total(F.slice(own, 1, i + 1))))))))


def matches(text: Column, kind: Kind, rank: int) -> Column:
    """Array of (start, rank, kind, end, match, score) of every match of a kind that its check confirms, leftmost and not overlapping; code points, end exclusive. Context is the NEAR code points on either side, up to the neighbouring match of the kind."""
    schema = "array<struct<start:long,rank:int,kind:string,end:long,match:string,score:double>>"
    none = F.array().cast(schema)
    between = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))

    def spans(m: Column) -> Column:
        # gap and match lengths by turns: the end of gap i is the start of match i.
        return bind(between, lambda g: bind(F.transform(m, lambda x, i: F.length(F.get(g, i)).cast("long") + F.length(x)), lambda b: bind(_ends(b), lambda e: F.filter(
            F.transform(m, lambda x, i: F.struct(
                (F.get(e, i) - F.length(x)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), F.get(e, i).alias("end"), x.alias("match"), score(kind, F.get(g, i), F.get(g, i + 1)).alias("score"))),
            lambda s: kind.check(s["match"])))))

    several = bind(found, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(none))
    return F.when(text.rlike(kind.gate), several).otherwise(none).cast(schema)


def score(kind: Kind, before: Column, after: Column) -> Column:
    """The kind's score, with its lift if a context word stands at the end of the gap before or at the start of the gap after."""
    if not kind.context:
        return F.lit(kind.score)
    around = F.concat_ws(" ", F.right(before, F.lit(NEAR)), F.left(after, F.lit(NEAR)))
    hit = F.translate(around, UPPER, LOWER).rlike(rf"(?<![a-z])(?:{kind.context})")
    return F.when(hit, F.lit(min(1.0, kind.score + kind.lift))).otherwise(F.lit(kind.score))


def _clear_of(base: Column) -> Callable[[Column], Column]:
    """Whether a span overlaps none of the base spans, which are sorted by start and looked at by blocks."""
    over = lambda x, s: (x["start"] < s["end"]) & (s["start"] < x["end"])
    n = F.ceil(F.size(base) / BLOCK).cast("int")
    items = lambda b: F.transform(F.sequence(b * BLOCK, F.least(b * BLOCK + BLOCK, F.size(base)) - 1), lambda i: F.get(base, i))
    block = lambda b: bind(items(b), lambda own: F.struct(F.get(own, F.lit(0))["start"].alias("start"), F.array_max(F.transform(own, lambda x: x["end"])).alias("end"), own.alias("own")))
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), block))
    return lambda spans: F.when(n == 0, spans).otherwise(bind(blocks, lambda bs: F.filter(spans, lambda s: ~F.exists(bs, lambda b: over(b, s) & F.exists(b["own"], lambda x: over(x, s))))))


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = BASE + MORE + SECRETS, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Input columns plus ``spans``: an array of (start, rank, kind, end, match, score), by start, then by kind as listed.

    A base kind's confirmed spans always stay; other kinds need ``threshold`` after context and must
    not overlap a base span. Null and empty texts have no spans; rows are neither dropped nor
    merged, so repeated rows return repeated rows. A column of the input named ``spans`` is replaced.
    """
    rows = packed(docs, doc_id, text)
    t = F.col("td_text")
    found = [(kind, matches(t, kind, rank)) for rank, kind in enumerate(kinds)]
    base = [x for kind, x in found if kind.base]
    more = [F.filter(x, lambda s: s["score"] >= threshold) for kind, x in found if not kind.base]
    if not base or not more:
        spans = F.sort_array(F.concat(*base, *more))
    else:
        spans = bind(F.sort_array(F.concat(*base)), lambda b: bind(F.concat(*more), lambda m: F.when(F.size(m) == 0, b).otherwise(F.sort_array(F.concat(b, _clear_of(b)(m))))))
    return unpacked(rows.withColumn("td_spans", spans), docs.columns, {"spans": F.col("td_spans")})


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Input columns with every found span of the text replaced by ``[KIND]``; overlapping spans become one mark, named by the first. A null text stays null."""
    found = find_pii(docs, doc_id=doc_id, text=text, **options)
    state = "struct<at:long,cuts:array<struct<start:long,end:long,kind:string>>>"
    # Four bytes a code point: pieces are cut out by place, not by walking from the start.
    wide = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-32")
    piece = lambda w, a, b: F.decode(F.substring(w, (a * 4 + 1).cast("int"), ((b - a) * 4).cast("int")), "UTF-32")

    def step(acc: Column, s: Column) -> Column:
        cut = F.struct(acc["at"].alias("start"), s["start"].alias("end"), s["kind"].alias("kind"))
        new = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["cuts"], F.array(cut)).alias("cuts"))
        return F.when(s["start"] >= acc["at"], new).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["cuts"].alias("cuts"))).cast(state)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().alias("cuts")).cast(state)
    kept = F.aggregate("spans", start, step)
    done = bind(wide, lambda w: bind(kept, lambda k: F.concat(
        F.array_join(F.transform(k["cuts"], lambda c: F.concat(piece(w, c["start"], c["end"]), F.lit("["), F.upper(c["kind"]), F.lit("]"))), ""), piece(w, k["at"], (F.length(w) / 4).cast("long")))))
    return found.withColumn(text, F.when(F.col(text).isNotNull(), F.when(F.size("spans") > 0, done).otherwise(F.col(text).cast("string")))).drop("spans")
