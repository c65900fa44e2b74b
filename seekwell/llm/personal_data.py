"""Personal data in whole texts, with DataFrame functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, mod-97
for account numbers, ranges for the rest), and words nearby adjust the score; spans
from `ACCEPT` on stay. A kind whose validator is enough starts at `ACCEPT`, so words
can only add to it; a national id needs them.

A span's place comes from the text between matches: `split` gives the gaps and
`regexp_extract_all` the matches of the same expression, and their lengths add up in
blocks, so a text with very many matches stays cheap. The expressions take repeats
possessively and start at the first character of a run or where the last match ended;
a long run costs linear time and no stack. Everything is one narrow pass over the scan,
without a shuffle.

Account numbers are proposed at every word start, by an expression that looks ahead
without taking anything, so an invalid run cannot swallow the start of a valid number;
of valid ones that overlap the first stays.

An account number has the length that its country prescribes. With an unlisted country
code it is a run of words of capitals and digits, cut to its longest valid beginning.
The words nearby are those of the text around a span, other matches included.

Null and empty texts have no spans. Repeated rows give repeated results, an empty
table an empty one; a null doc_id is passed on; extra columns are not read. Places are
code points, ends exclusive."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

ACCEPT = 0.5
_NEARBY = 0.3
_BLOCK = 128
_BEFORE, _AFTER = 48, 24


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def step(total, i, d):
        number = F.substring(d, i, 1).cast("int")
        twice = number * 2 - F.when(number > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(number)

    places = lambda d: F.sequence(F.lit(1), F.length(d))
    total = let(F.reverse(digits), lambda d: F.aggregate(
        places(d), F.lit(0), lambda total, i: step(total, i, d)
    ))
    return total % 10 == 0


def mod_97(account: Column) -> Column:
    def step(rest, i, text):
        code = F.ascii(F.substring(text, i, 1))
        letter = rest * 100 + code - 55
        return F.when(code > 57, letter).otherwise(rest * 10 + code - 48) % 97

    turned = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))
    rest = let(turned, lambda t: F.aggregate(
        F.sequence(F.lit(1), F.length(t)), F.lit(0), lambda r, i: step(r, i, t)
    ))
    return rest == 1


def _valid_ip(value: Column) -> Column:
    def small(part):
        return let(F.regexp_replace(part, "^0+", ""), lambda p: (F.length(p) <= 3) & (
            F.coalesce(p.try_cast("int"), F.lit(0)) <= 255
        ))

    return F.forall(F.split(value, r"\."), small)


def _valid_card(value: Column) -> Column:
    return let(_digits(value), lambda d: F.when(
        F.length(d).between(12, 19), luhn(d)
    ).otherwise(False))


def _valid_account(value: Column) -> Column:
    return let(F.regexp_replace(value, " ", ""), lambda a: F.when(
        F.length(a).between(15, 34), mod_97(a)
    ).otherwise(False))


def _account_length(value: Column) -> Column:
    """Length of the account number that `value` begins with, 0 if there is none."""
    words = F.split(value, " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " "))
    longest = F.coalesce(F.array_max(F.transform(F.filter(starts, _valid_account), F.length)), F.lit(0))
    listed = F.substring(value, 1, 2).isin(*" ".join(_COUNTRIES.values()).split())
    return F.when(_valid_account(value), F.length(value)).when(listed, 0).otherwise(longest)


def _valid_national(value: Column) -> Column:
    return ~F.substring(value, 1, 3).rlike("^(000|666|9..)") & ~value.rlike("-00-|-0000$")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a cheap expression that every text with a valid match has
    valid: object
    score: float
    words: str
    length: object = F.length  # of the span that a match begins with, 0 if there is none
    overlapping: bool = False  # looked for at every place, also inside other matches


BASE = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "@", lambda v: F.lit(True), 0.6, "mail|contact|write|address|kontakt|correo|courriel"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         r"[0-9]\.[0-9]", _valid_ip, 0.5, "ip|host|server|login|address|client"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++",
         r"[0-9](?:[\x20-]?[0-9]){11}", _valid_card, 0.8, "card|visa|credit|debit|pay|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         r"\+[0-9]", lambda v: F.length(_digits(v)).between(9, 15), 0.5, "phone|call|tel|mobile|fax|handy"),
)
#: Country codes by the length of their account numbers.
_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO EG GT HN HU LB NI PL SV", 29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
    32: "LC", 33: "RU",
}
_LISTED = "(?:" + "|".join(
    rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in _COUNTRIES.items()
) + ")(?![A-Za-z0-9])"
_UNLISTED = (
    r"[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![A-Za-z0-9])"
    rf"(?:\x20(?!{_LISTED})[A-Z0-9]++(?![A-Za-z0-9])){{0,30}}+"
)
ADDED = (
    Kind("account", rf"(?<![A-Za-z0-9])(?:{_LISTED}|{_UNLISTED})",
         "[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{11}", lambda v: _account_length(v) > 0, 0.8,
         "iban|account|bank|konto|cuenta|compte", _account_length, True),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         "[0-9]{3}-[0-9]{2}-[0-9]{4}", _valid_national, 0.3, "ssn|social security|national id|tax id"),
)
KINDS = BASE + ADDED
_SPAN = "struct<start:bigint,place:int,stop:bigint,kind:string,score:double>"


def _starts(sizes: Column, body) -> Column:
    """`body` of a function that gives the total of `sizes` before a position."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(sizes) / _BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(sizes, b * _BLOCK + 1, _BLOCK), F.lit(0).cast("bigint"), lambda t, x: t + x),
    )
    add = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda t, x: t + x)
    running = let(blocks, lambda s: F.transform(s, lambda _, i: add(F.slice(s, 1, i))))
    return let(running, lambda r: body(lambda i: F.get(r, F.floor(i / _BLOCK).cast("int")) + add(
        F.slice(sizes, (F.floor(i / _BLOCK) * _BLOCK).cast("int") + 1, i % _BLOCK)
    )))


def _of_kind(text: Column, kind: Kind, place: int) -> Column:
    def around(gaps, found, i, length):
        """The text before and after a span. Matches have at least two characters, so
        these many hold enough."""
        first, last = F.greatest(i - _BEFORE // 2, F.lit(0)), F.least(i + _AFTER // 2, F.size(found))
        before = F.transform(F.sequence(first, i), lambda k: F.concat(
            F.when(k > first, F.get(found, k - 1)).otherwise(""), F.right(F.get(gaps, k), F.lit(_BEFORE))
        ))
        after = F.transform(F.sequence(i + 1, F.greatest(last, i + 1)), lambda k: F.concat(
            F.left(F.get(gaps, k), F.lit(_AFTER)), F.coalesce(F.get(found, k), F.lit(""))
        ))
        rest = F.substring(F.get(found, i), length + 1, F.lit(_AFTER))
        return F.right(F.array_join(before, ""), F.lit(_BEFORE)), F.left(
            F.concat(rest, F.array_join(after, "")), F.lit(_AFTER)
        )

    def span(gaps, found, value, i, start):
        length = kind.length(value)
        near = F.lower(F.concat_ws(" ", *around(gaps, found, i, length)))
        score = F.lit(kind.score) + F.when(near.rlike(rf"\b(?:{kind.words})"), _NEARBY).otherwise(0.0)
        return F.struct(
            start.cast("bigint").alias("start"), F.lit(place).alias("place"),
            (start + length).cast("bigint").alias("stop"), F.lit(kind.name).alias("kind"),
            F.when(kind.valid(value), score).otherwise(0.0).alias("score"),
        )

    def spans(gaps, found):
        sizes = F.transform(found, lambda v, i: (F.length(F.get(gaps, i)) + F.length(v)).cast("bigint"))
        return let(sizes, lambda s: _starts(s, lambda before: F.transform(
            found, lambda v, i: span(gaps, found, v, i, before(i) + F.length(F.get(gaps, i)))
        )))

    gaps = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    all_spans = let(gaps, lambda g: let(found, lambda f: spans(g, f)))
    valid = F.filter(all_spans, lambda s: s["score"] >= ACCEPT)
    hint = text.contains(kind.hint) if kind.hint == "@" else text.rlike(kind.hint)
    return F.when(hint, valid).otherwise(F.array().cast(f"array<{_SPAN}>"))


_LEAST = 5  # characters from one account number's start to that of the next


def _apart(spans: Column) -> Column:
    """Of spans by start, those that begin behind the last one taken."""
    def take(done, s):
        free = (F.size(done) == 0) | (s["start"] >= F.get(done, F.size(done) - 1)["stop"])
        return F.when(free, F.concat(done, F.array(s))).otherwise(done)

    meets = F.transform(spans, lambda s, i: (i > 0) & (s["start"] < F.get(spans, i - 1)["stop"]))
    one_by_one = F.aggregate(spans, F.array().cast(f"array<{_SPAN}>"), take)
    return F.when(F.exists(meets, lambda m: F.coalesce(m, F.lit(False))), one_by_one).otherwise(spans)


def _of_every_start(text: Column, kind: Kind, place: int) -> Column:
    """Like `_of_kind` for matches that may overlap. `split` cuts the text where one
    begins."""
    ahead = f"(?=({kind.pattern}))"

    def span(pieces, value, i, start):
        def of_length(n):
            first = F.greatest(i - _BEFORE // _LEAST, F.lit(0))
            left = F.transform(F.slice(pieces, first + 1, i - first + 1), lambda p: F.right(p, F.lit(_BEFORE)))
            several = F.floor((n + _AFTER) / _LEAST).cast("int") + 2
            right = F.transform(F.slice(pieces, i + 2, several), lambda p: F.left(p, n + _AFTER))
            after = F.substring(F.array_join(right, ""), n + 1, F.lit(_AFTER))
            near = F.lower(F.concat_ws(" ", F.right(F.array_join(left, ""), F.lit(_BEFORE)), after))
            score = F.lit(kind.score) + F.when(near.rlike(rf"\b(?:{kind.words})"), _NEARBY).otherwise(0.0)
            return F.struct(
                start.cast("bigint").alias("start"), F.lit(place).alias("place"),
                (start + n).cast("bigint").alias("stop"), F.lit(kind.name).alias("kind"),
                F.when(n > 0, score).otherwise(0.0).alias("score"),
            )

        return let(kind.length(value).cast("int"), of_length)

    def spans(pieces, found):
        sizes = F.transform(pieces, lambda p: F.length(p).cast("bigint"))
        return let(sizes, lambda s: _starts(s, lambda before: F.transform(
            found, lambda v, i: span(pieces, v, i, before(i + 1))
        )))

    def padded(parts, found):  # there is no piece before a match at the very start
        nothing = F.array().cast("array<string>")
        return F.concat(F.when(F.size(parts) == F.size(found), F.array(F.lit(""))).otherwise(nothing), parts)

    found = F.regexp_extract_all(text, F.lit(ahead), F.lit(1))
    all_spans = let(found, lambda f: let(padded(F.split(text, ahead, -1), f), lambda p: spans(p, f)))
    valid = let(F.filter(all_spans, lambda s: s["score"] >= ACCEPT), _apart)
    return F.when(text.rlike(kind.hint), valid).otherwise(F.array().cast(f"array<{_SPAN}>"))


def with_spans(docs: DataFrame, name: str = "spans") -> DataFrame:
    """`docs` and the accepted spans of `text`, by start, then kind, as an array of
    (start, place, stop, kind, score); place is the kind's position in KINDS."""
    text = text_of()
    found = F.flatten(F.array(*[
        (_of_every_start if k.overlapping else _of_kind)(text, k, i) for i, k in enumerate(KINDS)
    ]))
    return docs.withColumn(name, F.sort_array(found))


def _joined(spans: Column) -> Column:
    named = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
    return F.array_join(named, ",")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    rows = with_spans(docs.select("doc_id", "text"), "found")

    def number(place: int) -> Column:
        return F.size(F.filter("found", lambda s: s["place"] == place)).cast("long")

    counts = [number(i).alias(f"n_{k.name}") for i, k in enumerate(BASE)]
    base = _joined(F.filter("found", lambda s: s["place"] < len(BASE)))
    return rows.select(
        "doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with every span replaced by its kind in brackets, and `n_chars`, where
    there is one, brought up to date. Of overlapping spans the first gives the name
    and the stretch runs to the end of the last. A null text stays null."""
    names = set(docs.columns)
    column = next(f"_spans{i}" for i in range(len(names) + 1) if f"_spans{i}" not in names)

    def merge(done, s):
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(
            last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"),
            last["kind"].alias("kind"),
        )
        alone = F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))
        return F.when(
            (F.size(done) > 0) & (s["start"] < last["stop"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer)),
        ).otherwise(F.concat(done, F.array(alone)))

    empty = F.array().cast("array<struct<start:bigint,stop:bigint,kind:string>>")
    text = F.col("text")
    merged = F.aggregate(F.col(column), empty, merge)

    def cut(spans):
        def part(s, i):
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["stop"]).cast("int")
            kept = F.substring(text, begin + 1, s["start"].cast("int") - begin)
            return F.concat(kept, F.lit("["), F.upper(s["kind"]), F.lit("]"))

        tail = F.substring(text, F.get(spans, F.size(spans) - 1)["stop"].cast("int") + 1, F.length(text))
        return F.concat(F.array_join(F.transform(spans, part), ""), tail)

    masked = F.when(F.size(column) > 0, let(merged, cut)).otherwise(text)
    out = with_spans(docs, column).withColumn("text", masked).drop(column)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out
