"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Everything is a DataFrame expression. Positions come from splitting a text by the pattern: the pieces between the
matches and the matches themselves alternate, so running sums of their lengths are the offsets, in code points.

The patterns are written so that they take linear time on any text; each finds exactly what the plain form beside it
finds. `\\G` and the look-behind stop a search from starting in the middle of a run that it has already tried.

Edge cases: a null text counts as empty and has no spans; ties in start sort by kind; overlapping spans of different
kinds are all reported; repeated rows are each reported; a column of the input with the name of the spans' column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_L = r"A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """A pattern, what a text must contain for it to be tried, the score of a confirmed match, and context words with their weight."""

    name: str
    pattern: str
    gate: str
    base: bool
    score: float = 1.0
    context: str = ""
    lift: float = 0.0


#: Base kinds in the order in which they are listed. Plain forms:
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card [0-9]([\x20-]?[0-9])+   phone \+[0-9][\x20().0-9-]+[0-9]
#: Added kinds: iban (mod 97), card13 (13-digit cards, Luhn), ssn, and secret, an unbroken token of letters and digits; card13 and ssn need a
#: context word to pass, a secret too unless it has the form of a known key.
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_L}]))[{_L}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.9, r"(?i)\b(?:mail|email|e-mail|contact|kontakt|courriel|correo)\b", 0.1),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True, 0.7, r"(?i)\b(?:ip|host|server|address|login|adresse|dirección)\b", 0.3),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])", "", True, 0.8, r"(?i)\b(?:card|visa|credit|karte|carte|tarjeta)\b", 0.2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 0.8, r"(?i)\b(?:phone|call|tel|mobile|fax|telefon|téléphone|teléfono)\b", 0.2),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", False, 0.7, r"(?i)\b(?:iban|account|konto|compte|cuenta)\b", 0.3),
    Kind("card13", r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12}(?![0-9])", "", False, 0.4, r"(?i)\b(?:card|visa|karte|carte|tarjeta)\b", 0.4),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", False, 0.4, r"(?i)\b(?:ssn|social security)\b", 0.4),
    Kind("secret", r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9_+/=-])", "", False, 0.3, r"(?i)(?:\b|_)(?:token|secret|password|passwd|pwd|api_?key|apikey|access_?key|bearer|auth|credential|schlüssel|clave|clé)\b", 0.5),
)
#: Forms of secrets that need no context: the openings of well-known keys. Fixed values.
KNOWN_SECRET = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abp]-[A-Za-z0-9-]{20,}|eyJ[A-Za-z0-9_-]{20,})={0,2}$"
#: A confirmed match of an added kind is reported from this score on; context is looked for in so many characters before and after a match.
THRESHOLD, WINDOW = 0.6, 40
#: Matches that are folded at a time, and code points that are cut at a time, so that neither is quadratic in a long text.
BLOCK, PIECE = 256, 4096


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN passes the ISO 7064 check: rotated by four, letters as 10 to 35, remainder 1."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        v = F.ascii(c) - F.when(c <= "9", 48).otherwise(55)
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _confirmed(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "card13":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "secret":
        return F.rlike(match, F.lit("[0-9]")) & F.rlike(match, F.lit("[A-Za-z]"))
    return mod97(match) if kind == "iban" else F.lit(True)


def _found(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, rank, kind, score>> of the matches of a kind that are confirmed and, unless the kind is a base one, score enough.

    Gaps and matches alternate. Their lengths are added up block by block, and each block then starts from its own offset.
    """
    rank = KINDS.index(kind)
    gate = F.contains(text, F.lit(kind.gate)) if kind.gate else F.rlike(text, F.lit("[0-9]"))
    both = F.struct(F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"))
    nothing = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,score:double>>")
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))

    def block(b: Column, k: Column, offset: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            gap, match = F.get(b["gaps"], i), F.get(b["found"], i)
            start = acc["at"] + F.length(gap)
            end = start + F.length(match)
            near = F.concat(F.right(gap, F.lit(WINDOW)), F.lit("\n"), F.left(F.get(b["gaps"], i + 1), F.lit(WINDOW)))
            score = F.lit(kind.score) + F.when(F.rlike(near, F.lit(kind.context)), kind.lift).otherwise(0.0)
            if kind.name == "secret":
                score = score + F.when(F.rlike(match, F.lit(KNOWN_SECRET)), 0.4).otherwise(0.0)
            span = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), score.alias("score"))
            good = _confirmed(kind.name, match) & (F.lit(kind.base) | (score >= THRESHOLD))
            return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        mine = F.sequence(k * BLOCK, F.least(k * BLOCK + BLOCK, F.size(b["found"])) - 1)
        return F.aggregate(mine, F.struct(offset.alias("at"), nothing.alias("out")), step, lambda acc: acc["out"])

    def each(b: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(b["found"]) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda k: length(F.slice(b["gaps"], k * BLOCK + 1, F.lit(BLOCK))) + length(F.slice(b["found"], k * BLOCK + 1, F.lit(BLOCK))))
        upto = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("k"), F.slice(upto, F.lit(1), F.size(blocks)).alias("at")), lambda x: block(b, x["k"], x["at"])))

    found = F.filter(F.array(both), lambda b: F.size(b["found"]) > 0)
    return F.when(gate, F.coalesce(F.get(F.transform(found, each), F.lit(0)), nothing)).otherwise(nothing)


def detect(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs with a column of spans: array<struct<start, end, rank, kind, score>> by start, then kind; offsets in code points, end exclusive."""
    whole = F.coalesce(F.col(text), F.lit(""))
    spans = F.concat(*[_found(whole, k) for k in KINDS])
    return docs.withColumn(out, F.array_sort(spans, _order))


def _order(a: Column, b: Column) -> Column:
    first = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    return F.coalesce(first(a["start"], b["start"]), first(a["rank"], b["rank"]), F.lit(0))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Replace each span by its kind in brackets. Where spans overlap, the one that starts first (then the longer) hides the rest.

    A text is cut into pieces of `PIECE` code points, and each is put together from what lies in it; a span is written where it starts. A null
    text stays null; docs keep all columns but the spans.
    """
    whole, by = F.col(text), F.array_sort(F.col(spans), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))

    def shown(acc: Column, s: Column) -> Column:
        """The spans that no earlier one hides, as far as the last end tells."""
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))).alias("out"))

    def piece(p: Column, k: Column) -> Column:
        at = k * PIECE

        def step(acc: Column, s: Column) -> Column:
            mark = F.when(s["start"] >= at, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
            kept = F.substring(p, acc["at"] - at + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            return F.struct(F.least(s["end"], at + PIECE).alias("at"), F.concat(acc["out"], F.array(F.concat(kept, mark))).alias("out"))

        mine = F.filter("__shown", lambda s: (s["start"] < at + PIECE) & (s["end"] > at))
        start = F.struct(at.cast("int").alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(mine, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(p, acc["at"] - at + 1, F.lit(PIECE))))

    # Block by block: what the spans before a block reach is all that it needs of them.
    nothing = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    out = docs.withColumn("__by", by).withColumn("__blocks", F.sequence(F.lit(0), F.floor((F.size("__by") - 1) / BLOCK).cast("int")))
    block = lambda k: F.slice("__by", k * BLOCK + 1, F.lit(BLOCK))
    ends = F.transform("__blocks", lambda k: F.array_max(F.transform(block(k), lambda s: s["end"])))
    upto = F.aggregate(ends, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), n))))
    each = lambda x: F.aggregate(block(x["k"]), F.struct(x["at"].alias("at"), nothing.alias("out")), shown, lambda acc: acc["out"])
    told = F.flatten(F.transform(F.arrays_zip(F.col("__blocks").alias("k"), F.slice(upto, F.lit(1), F.size("__blocks")).alias("at")), each))
    out = out.withColumn("__shown", F.when(F.size("__by") > 0, told)).drop("__by", "__blocks")
    pieces = F.regexp_extract_all(whole, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    done = F.array_join(F.transform(pieces, piece), "")
    return out.withColumn(text, F.when(F.col("__shown").isNotNull(), done).otherwise(whole)).drop(spans, "__shown")
