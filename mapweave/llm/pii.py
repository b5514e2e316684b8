"""PII: format-preserving pseudonyms from a keyed Feistel permutation, inside each row, without a shuffle.

Validated values are replaced by others of the same format: equal values get equal pseudonyms in all documents, different
ones different pseudonyms (each is a permutation of its format's values).

==========  ==========================================  =====================================================
kind        valid if                                    permuted
==========  ==========================================  =====================================================
card        13-19 digits, Luhn                          digits after the first; the check digit is made anew
iban        country, check digits modulo 97             digits of the account; the check digits are made anew
ssn         AAA-GG-SSSS in its legal ranges             all three parts, in those ranges
phone       +country, or 10 digits in usual grouping    the last seven digits
ip          four numbers up to 255                      all 32 bits
date        a calendar date of 1800-2199                the day among those 400 years (146097 = 189 x 773)
email       local part, domain                          letters and digits by a keyed hash; the last label stays
secret      tokens, key=value, passwords in addresses   letters and digits by a keyed hash of the whole value
==========  ==========================================  =====================================================

The round function and the hashes are HMAC-SHA-256. E-mails and secrets are not numbers; they get a keyed hash in their
alphabet (as good as distinct for values of usual length, not provably a permutation). Values that do not validate stay.
A run of digit groups may hold a card among other numbers (an expiry date, a leading count): every window of groups in a
usual grouping is tried, the leftmost first.

Defined results: null stays null; empty texts stay; texts without a value are returned unchanged; several values in a
text are replaced in place, whatever its length; every row is treated by itself, so repeated rows get the same result,
ties cannot arise and an empty table gives an empty one; extra columns are kept, but for one named as ``into`` or
``kinds``, which is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spare

ROUNDS = 8
DAYS = (189, 773)  # 1800-01-01 to 2199-12-31 are 146097 days
SSN = (898, 99 * 9999)

_NAMES = "password|passwd|secret|token|api[_-]?key"
#: Kinds in the order in which their patterns are tried at a place.
PATTERNS = {
    "assigned": rf"(?<=[:= \"'])(?<=[:=][\"' ]{{0,3}})(?:(?<=(?i:{_NAMES})[\"']?\s{{0,2}}=\s{{0,2}}[\"']?)(?!=)|(?<=(?i:{_NAMES})[\"']?\s{{0,2}}:\s{{0,2}}[\"']?)(?=[^\s\"']*\d))[^\s\"']{{6,}}",
    "secret": r"(?:AKIA|ASIA)[A-Z0-9]{16}|(?:gh[pousr]_|glpat-|sk-)[A-Za-z0-9]{20,}|xox[abeoprs]-[A-Za-z0-9-]{6,}|eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}|(?<=[Bb]earer )[A-Za-z0-9._~+/=-]{16,}"
    r"|(?<=:)(?<=://[^\s/:@]{1,64}:)[^\s/@]{3,}(?=@)",
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]?\d)",
    "date": r"(?<!\d|\d-)(?:1[89]|2[01])\d{2}-\d{2}-\d{2}(?!-?\d)|(?<!\d|\d/)\d{2}/\d{2}/(?:1[89]|2[01])\d{2}(?!/?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d.])(?:\+\d{1,3}[ .-]?)?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
}
#: Digit groups among which cards are looked for, in what the other patterns leave, and the usual lengths of a card's groups.
RUN = r"\d[\d -]{11,}\d"
CARD_GROUPS = r"^(?:1[3-9]|4-6-[45]|4-4-4-[1-4]|4-4-4-4-[1-3])$"

#: What every match of PATTERNS and RUN holds, with what is before it: an @, a name or start of a secret, or two digits.
GATE = rf"@|(?i:{_NAMES})|AKIA|ASIA|gh[pousr]_|glpat-|sk-|xox[abeoprs]-|eyJ|earer |\d[ .-]?\d"


def keyed(key: str, kind: str, *parts: Column) -> Column:
    """A pseudo-random number below 2^60: HMAC-SHA-256 of the kind and the parts. The key becomes a literal of the plan."""
    k = key.encode()
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in k)) for pad in (0x36, 0x5C))
    text = F.concat_ws("|", F.lit(kind), *(p.cast("string") for p in parts)).cast("binary")
    mac = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text), 256))), 256)
    return F.conv(F.substring(mac, 1, 15), 16, 10).cast("long")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def feistel(left: Column, left_size: Column, right: Column, right_size: Column, key: str, kind: str, tweak: Column | None = None) -> Column:
    """Struct (x, y): a permutation of the pairs with left in [0, left_size) and right in [0, right_size), for each tweak."""
    extra = [] if tweak is None else [tweak]
    start = F.struct(left.cast("long").alias("x"), left_size.cast("long").alias("nx"), right.cast("long").alias("y"), right_size.cast("long").alias("ny"))
    step = lambda s, i: F.struct(s.y.alias("x"), s.ny.alias("nx"), F.pmod(s.x + keyed(key, kind, i, s.y, *extra), s.nx).alias("y"), s.nx.alias("ny"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def permute_digits(digits: Column, key: str, kind: str, tweak: Column | None = None) -> Column:
    """A permutation of the digit strings of each length from 2 to 36."""
    n = F.char_length(digits)
    half = F.floor(n / 2).cast("int")
    power = lambda k: F.pow(F.lit(10.0), k).cast("long")
    num = lambda s: F.coalesce(s.try_cast("long"), F.lit(0).cast("long"))
    out = feistel(num(F.substr(digits, F.lit(1), half)), power(half), num(F.substr(digits, half + 1)), power(n - half), key, kind, tweak)
    made = lambda s: F.concat(F.lpad(s.x.cast("string"), half, "0"), F.lpad(s.y.cast("string"), n - half, "0"))
    return F.get(F.transform(F.array(out), made), F.lit(0))


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def into_format(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by ``digits``."""
    runs = F.transform(F.regexp_extract_all(value, F.lit("[0-9]+"), 0), F.char_length)
    starts = F.transform(runs, lambda n, i: F.aggregate(F.slice(runs, 1, i), F.lit(1), lambda a, b: a + b))
    new = F.zip_with(starts, runs, lambda at, n: F.substr(digits, at, n))
    return F.array_join(F.flatten(F.transform(F.split(value, "[0-9]+", -1), lambda gap, i: F.array(gap, F.coalesce(F.get(new, i), F.lit(""))))), "")


def luhn_sum(digits: Column, doubled_from_last: int) -> Column:
    """Luhn sum; every second digit is doubled, counted from the last: from it (0) or the one before (1)."""
    back = F.split(F.reverse(digits), "")
    weigh = lambda d, i: F.when(i % 2 == doubled_from_last, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.coalesce(d.try_cast("int"), F.lit(0)) + 1)).otherwise(F.coalesce(d.try_cast("int"), F.lit(0)))
    return F.aggregate(F.transform(F.filter(back, lambda d: d != ""), weigh), F.lit(0), lambda a, b: a + b)


def is_card(digits: Column) -> Column:
    return F.char_length(digits).between(13, 19) & (luhn_sum(digits, 1) % 10 == 0)


def _card(v: Column, key: str) -> Column:
    d = only_digits(v)
    n = F.char_length(d)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_digits(F.substr(d, F.lit(2), n - 2), key, "card", F.substr(d, F.lit(1), F.lit(1))))
    return let(body, lambda b: into_format(v, F.concat(b, F.pmod(10 - luhn_sum(b, 0) % 10, F.lit(10)).cast("string"))))


def piece(kind: Column | None, value: Column) -> Column:
    return F.struct((F.lit(None) if kind is None else kind).cast("string").alias("kind"), value.alias("value"))


def _cards_of_run(run: Column, key: str) -> Column:
    """Pieces of a run of digit groups: the cards in it, left to right, and what is between them."""

    def found(r: Column) -> Column:
        groups, n = r.groups, F.size(r.groups)

        def fits(i: Column, k: Column) -> Column:
            own = F.slice(groups, i + 1, k)
            shape = F.array_join(F.transform(own, lambda g: F.char_length(g).cast("string")), "-")
            single = F.forall(F.slice(r.gaps, i + 2, k - 1), lambda g: F.char_length(g) == 1)
            return (i + k <= n) & single & (F.rlike(shape, F.lit(CARD_GROUPS)) | ((i == 0) & (k == n))) & is_card(F.array_join(own, ""))

        size = lambda i: F.coalesce(F.get(F.filter(F.array(F.lit(4), F.lit(3), F.lit(1), F.lit(5), n), lambda k: fits(i, k)), F.lit(0)), F.lit(0))
        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<i:int,k:int,since:int>>").alias("cards"))

        def step(s: Column, i: Column) -> Column:
            card = lambda k: F.struct((i + k).alias("next"), F.concat(s.cards, F.array(F.struct(i.alias("i"), k.alias("k"), s.next.alias("since")))).alias("cards"))
            return F.when(i < s.next, s).otherwise(let(size(i), lambda k: F.when(k > 0, card(k)).otherwise(s)))

        parts = F.flatten(F.transform(r.gaps, lambda g, i: F.array(g, F.coalesce(F.get(groups, i), F.lit("")))))
        text = lambda a, k: F.array_join(F.slice(parts, a + 1, k), "")
        one = lambda c: F.array(piece(None, text(2 * c.since, 2 * (c.i - c.since) + 1)), let(text(2 * c.i + 1, 2 * c.k - 1), lambda v: piece(F.lit("card"), _card(v, key))))
        rest = lambda s: F.concat(F.flatten(F.transform(s.cards, one)), F.array(piece(None, text(2 * s.next, 2 * n + 2))))
        last = lambda s: F.struct(F.when(F.size(s.cards) > 0, s.next).otherwise(0).alias("next"), s.cards.alias("cards"))
        return let(F.aggregate(F.sequence(F.lit(0), n - 1), start, step, last), rest)

    return let(F.struct(F.regexp_extract_all(run, F.lit("[0-9]+"), 0).alias("groups"), F.split(run, "[0-9]+", -1).alias("gaps")), found)


def _cards(text: Column, key: str) -> Column:
    runs = F.struct(F.split(text, RUN, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(RUN), 0).alias("runs"))
    one = lambda x, g, i: F.concat(F.array(piece(None, g)), F.when(i < F.size(x.runs), _cards_of_run(F.get(x.runs, i), key)).otherwise(F.array().cast(PIECES)))
    return let(runs, lambda x: F.flatten(F.transform(x.gaps, lambda g, i: one(x, g, i))))


def _iban(v: Column, key: str) -> Column:
    s = F.replace(v, F.lit(" "), F.lit(""))
    country, bban = F.substr(s, F.lit(1), F.lit(2)), F.substr(s, F.lit(5))
    worth = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("long")).otherwise(F.ascii(c) - 55)
    mod97 = lambda t: F.aggregate(F.filter(F.split(t, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + worth(c)) % 97)
    old = only_digits(bban)
    valid = (F.char_length(old) >= 2) & (mod97(F.concat(bban, F.substr(s, F.lit(1), F.lit(4)))) == 1)
    check = lambda new: F.lpad((98 - mod97(F.concat(into_format(bban, new), country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, let(permute_digits(old, key, "iban", country), lambda new: into_format(v, F.concat(check(new), new))))


def _ssn(v: Column, key: str) -> Column:
    part = lambda a, n: F.coalesce(F.substr(v, F.lit(a), F.lit(n)).try_cast("int"), F.lit(0))
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    out = feistel(F.when(area > 666, area - 2).otherwise(area - 1), F.lit(SSN[0]), (group - 1) * 9999 + serial - 1, F.lit(SSN[1]), key, "ssn")
    shown = lambda s: F.format_string("%03d-%02d-%04d", F.when(s.x >= 665, s.x + 2).otherwise(s.x + 1), F.floor(s.y / 9999).cast("int") + 1, s.y % 9999 + 1)
    return F.when(valid, F.get(F.transform(F.array(out), shown), F.lit(0)))


def _phone(v: Column, key: str) -> Column:
    d = only_digits(v)
    n = F.char_length(d)
    return F.when((n >= 8) & (n <= 15), into_format(v, F.concat(F.substr(d, F.lit(1), n - 7), permute_digits(F.substr(d, n - 6), key, "phone", F.substr(d, F.lit(1), n - 7)))))


def _ip(v: Column, key: str) -> Column:
    parts = F.transform(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)))
    p = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(999))
    out = feistel(p(0) * 256 + p(1), F.lit(65536), p(2) * 256 + p(3), F.lit(65536), key, "ip")
    shown = lambda s: F.format_string("%d.%d.%d.%d", F.floor(s.x / 256).cast("int"), s.x % 256, F.floor(s.y / 256).cast("int"), s.y % 256)
    return F.when(F.forall(parts, lambda x: x <= 255), F.get(F.transform(F.array(out), shown), F.lit(0)))


def _date(v: Column, key: str) -> Column:
    """Day/month order of the slashed form is read as month/day, else day/month; written in the order read."""
    iso, american, european = v.contains("-"), F.try_to_date(v, "MM/dd/yyyy"), F.try_to_date(v, "dd/MM/yyyy")
    day = F.when(iso, F.try_to_date(v, "yyyy-MM-dd")).otherwise(F.coalesce(american, european))
    origin = F.to_date(F.lit("1800-01-01"))
    num = F.datediff(day, origin)
    out = feistel(F.floor(num / DAYS[1]), F.lit(DAYS[0]), F.pmod(num, F.lit(DAYS[1])), F.lit(DAYS[1]), key, "date")
    made = F.transform(F.array(out), lambda s: F.date_add(origin, (s.x * DAYS[1] + s.y).cast("int")))
    new = F.get(made, F.lit(0))
    form = F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(american.isNotNull(), F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy"))
    return F.when(day.isNotNull(), form)


def _hashed(v: Column, key: str, kind: str) -> Column:
    """Each letter and digit replaced by one of its class, chosen by a keyed hash of the whole value and the place."""
    chars = F.filter(F.split(v, ""), lambda c: c != "")
    tag = keyed(key, kind, v)
    pick = lambda c, i, alphabet: F.substr(F.lit(alphabet), F.pmod(F.xxhash64(tag, i), F.lit(len(alphabet))).cast("int") + 1, F.lit(1))
    new = lambda c, i: F.when(c.rlike("[0-9]"), pick(c, i, "0123456789")).when(c.rlike("[a-z]"), pick(c, i, "abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick(c, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)
    return F.array_join(F.transform(chars, new), "")


def pseudonym(v: Column, matched: Column, key: str) -> Column:
    """Piece of a match of the pattern ``matched``: kind is null, and the value as it was, if it does not validate."""
    local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    last = F.substring_index(domain, ".", -1)
    names = _hashed(F.substr(domain, F.lit(1), F.char_length(domain) - F.char_length(last)), key, "domain")
    made = {
        "email": F.concat(_hashed(local, key, "email"), F.lit("@"), names, last), "iban": _iban(v, key), "ip": _ip(v, key), "date": _date(v, key),
        "ssn": _ssn(v, key), "phone": _phone(v, key),
    }
    kind = F.when(matched.isin("assigned", "secret"), F.lit("secret")).otherwise(matched)
    value = F.when(kind == "secret", _hashed(v, key, "secret"))
    for k, new in made.items():
        value = value.when(kind == k, new)
    return let(value, lambda x: piece(F.when(x.isNotNull(), kind), F.coalesce(x, v)))


#: Characters that no text should have; those of texts that do are written as ESC and a letter while the text is searched.
MARK, SEP, ESC = "\ufdd0", "\ufdd1", "\ufdd2"


def _escaped(t: Column) -> Column:
    for c, letter in ((ESC, "c"), (MARK, "a"), (SEP, "b")):
        t = F.replace(t, F.lit(c), F.lit(ESC + letter))
    return t


def _unescaped(t: Column) -> Column:
    for c, letter in ((SEP, "b"), (MARK, "a"), (ESC, "c")):
        t = F.replace(t, F.lit(ESC + letter), F.lit(c))
    return t


PIECES = "array<struct<kind:string,value:string>>"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", into: str | None = None, kinds: str = "pii_kinds") -> DataFrame:
    """``docs`` with pseudonyms in ``into`` (default: the text column) and the kinds replaced, in order, in ``kinds``."""
    pattern = "|".join(f"({p})" for p in PATTERNS.values())
    (pieces,) = spare(docs, "pieces")
    t = F.col(text_col)
    # Cheap first: texts without what every match holds are not searched.
    gate = t.rlike(GATE)
    # One search: each match is set off by MARK and written as the groups of all alternatives, of which one is not empty.
    shown = MARK + SEP.join(f"${i + 1}" for i in range(len(PATTERNS))) + MARK
    parts = F.split(F.regexp_replace(_escaped(t), F.lit(pattern), F.lit(shown)), MARK, -1)

    def match(groups: Column) -> Column:
        by = F.coalesce(*(F.when(F.get(groups, F.lit(j)) != "", F.lit(k)) for j, k in enumerate(PATTERNS)))
        return let(F.struct(F.array_join(groups, "").alias("v"), by.alias("by")), lambda m: pseudonym(m.v, m.by, key))

    first = lambda x: F.transform(x, lambda p, i: F.when(i % 2 == 0, piece(None, p)).otherwise(let(F.split(p, SEP, -1), match)))
    cards = lambda p: F.when(p.kind.isNull() & p.value.rlike(RUN), _cards(p.value, key)).otherwise(F.array(p))
    out = docs.withColumn(pieces, F.when(gate, F.flatten(F.transform(let(parts, first), cards))))
    return out.select(*_outputs(docs, F.col(pieces), t, into or text_col, kinds))


def _outputs(docs: DataFrame, pieces: Column, t: Column, into: str, kinds: str) -> list[Column]:
    text = F.coalesce(_unescaped(F.array_join(F.transform(pieces, lambda p: p.value), "")), t).alias(into)
    done = F.coalesce(F.filter(F.transform(pieces, lambda p: p.kind), lambda k: k.isNotNull()), F.array().cast("array<string>")).alias(kinds)
    new = {into: text, kinds: done}
    return [new.pop(c, F.col(c)) for c in docs.columns] + list(new.values())
