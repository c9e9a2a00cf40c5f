"""Surrogates for personal data (operator 8).

Detected entities are replaced by keyed hashes spelled out in their own form: a phone number keeps its punctuation and
country code, a card number and an IBAN their check digits, an address its four octets, a secret its alphabet and
length and the prefix that tells its issuer, an e-mail address its shape under a reserved domain, and a titled name its
title, gender, script and number of parts; where a text names it again without a title, by its full name or its surname,
it is replaced there too. What is hashed is the entity's plain form (digits without punctuation, lower-case letters), so all spellings of
one entity get the same surrogate in every document: a lost task or another run makes the same ones.

A surname's surrogate is the same behind any title. A given name's has an ending for its gender: that of its titles in
the whole corpus, if they agree, else a neutral one. Letters stay in their script where it is Latin, Cyrillic or Greek,
and in e-mail addresses in eight more (SCRIPTS); others become Latin ones. A number of country code 1 is the same entity
with and without the code. Hashes are HMAC-SHA-256; the key reaches the plan as a subquery's result, not as a literal.

Distinct entities must stay distinct. The corpus's distinct entities are tabled, and those whose surrogate another
entity has, or that is itself an entity of the corpus, take the next attempt of their hash until none collide. An
entity's surrogates have one plain form, whatever its spelling, so the test covers all spellings. Some forms have few
surrogates or none but themselves (a password of asterisks, ::1, addresses under 192.168): what still collides after
WIDE attempts gets one of a wider form. Only these exceptions,
and given names whose title leaves the gender open that others tell, travel back to the documents; all other surrogates
are computed where the text stands, so texts are never shuffled unless exceptions are too many to broadcast. Documents
are told apart by a hash of their text, so ids may be null or repeat. Only DataFrame operations are used.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Titles that say what stands behind them is a name.
MALE_TITLES = ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "г-н", "Г-н", "господин", "Господин", "Κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "Srta", "г-жа", "Г-жа", "госпожа", "Госпожа", "Κυρία"]
OTHER_TITLES = ["Dr", "Dra", "Prof"]
SECRET_WORDS = ["password", "passwd", "passwort", "pwd", "secret", "token", "api[_-]?key"]
# How keys of well-known issuers begin, and what follows.
SECRET_PREFIXES = {"(?:AKIA|ASIA)": "[0-9A-Z]{16}", "gh[pousr]_": "[A-Za-z0-9]{20,}", "github_pat_": "[A-Za-z0-9_]{20,}", "glpat-": "[A-Za-z0-9_-]{20,}", "xox[abprs]-": "[A-Za-z0-9-]{10,}", "sk-": "[A-Za-z0-9_-]{20,}", "AIza": "[A-Za-z0-9_-]{35}"}

#: A word of a name: inner capitals, apostrophes and hyphens belong to it, an English possessive doesn't.
_NAME = r"\p{Lu}(?:[\p{L}\p{M}]|['’-](?!s(?!\p{L}))(?=\p{L}))*+(?<!(?<!\p{L})\p{Lu})"
_TITLES = "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
_SECRET_HEAD = r"(?=[APSTapst])(?i:" + "|".join(SECRET_WORDS) + r")[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
_ISSUED = r"(?=[Agsx])(?<![A-Za-z0-9])(?:" + "|".join(head + rest for head, rest in SECRET_PREFIXES.items()) + r")(?![A-Za-z0-9])"
_SECRET_START = "^(?:" + _SECRET_HEAD + "|" + "|".join(SECRET_PREFIXES) + ")"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: In this order where two could begin at the same place. Looking ahead for what a match begins with changes no match, but
#: spares most places of a text the rest of the pattern.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63})*\.\p{L}{2,24}(?![\p{L}\p{N}])",
    "secret": _SECRET_HEAD + r"[^\s\"'«»“”]{6,}|" + _ISSUED + r"|(?=[0-9A-Fa-f]{32})(?<![A-Za-z0-9])(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])",
    "iban": r"(?=[A-Z]{2}[0-9])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": r"(?=[0-9A-Fa-f:])(?<![\p{L}\p{N}:])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*::)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\p{L}\p{N}:])",
    "card": r"(?=[0-9])(?:(?<![\p{L}\p{N}])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])[0-9]{13,19}(?![\p{L}\p{N}]))",
    "ip": r"(?=[0-9])(?<![\p{N}.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![\p{N}]|\.[0-9])",
    "ssn": r"(?=[0-9])(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "phone": r"(?=[0-9+(])(?:(?<![\p{L}\p{N}])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[ .-]?[0-9]{2,5}){1,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\p{L}\p{N}])|(?=0)(?<![\p{L}\p{N}.,/-])(?=(?:[0-9][ /-]?){8,13}(?![0-9]))(?![0-9]{1,2}[ /-][0-9]{1,2}[ /-][0-9]{4}(?![ /-]?[0-9]))0[0-9]{1,4}(?:[ /-][0-9]{2,8}){1,5}(?![\p{L}\p{N}]))",
    "name": r"(?=[A-ZΚгГ])(?<![\p{L}\p{N}])(?:" + _TITLES + r")\.?\s{1,3}(?:\p{Lu}\.? )?" + _NAME + r"(?: " + _NAME + r")?",
}
ENTITY = "|".join(PATTERNS.values())
#: A quick test that all texts with entities pass.
_GATE = "[0-9@=:]|" + PATTERNS["name"]

_ONSETS = {"latin": "b d f g k l m n p r s t v z".split(), "cyrillic": "б д ф г к л м н п р с т в з".split(), "greek": "β γ δ ζ κ λ μ ν π ρ σ τ φ χ".split()}
_VOWELS = {"latin": "a e i o".split(), "cyrillic": "а е и о".split(), "greek": "α ε ι ο".split()}
_ENDINGS = {"latin": {"m": "rtus", "f": "lina", "x": "ren"}, "cyrillic": {"m": "слав", "f": "лина", "x": "рен"}, "greek": {"m": "ρος", "f": "νία", "x": "νι"}}
_SURNAMES = {"latin": "sten", "cyrillic": "енко", "greek": "άκη"}


def _range(first: int, last: int, *without: int) -> str:
    return "".join(chr(c) for c in range(first, last + 1) if c not in without)


#: Scripts of letters in e-mail addresses, with capitals and small letters that stand for theirs.
SCRIPTS = {
    "Cyrillic": (_range(0x410, 0x42F), _range(0x430, 0x44F)),
    "Greek": (_range(0x391, 0x3A9, 0x3A2), _range(0x3B1, 0x3C9, 0x3C2)),
    "Hebrew": (_range(0x5D0, 0x5EA),) * 2,
    "Arabic": (_range(0x628, 0x63A),) * 2,
    "Devanagari": (_range(0x915, 0x939),) * 2,
    "Thai": (_range(0xE01, 0xE2E),) * 2,
    "Hiragana": (_range(0x3042, 0x3062),) * 2,
    "Katakana": (_range(0x30A2, 0x30C2),) * 2,
    "Hangul": (_range(0xAC00, 0xAC40),) * 2,
    "Han": (_range(0x4E00, 0x4E40),) * 2,
}

MAX_ATTEMPTS = 40
#: Attempts in an entity's own form; the later ones are of a wider form where its own has few surrogates.
WIDE = 5


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often (and in whatever loops) the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kind_of(m: Column) -> Column:
    """The type of a match, from its form."""
    return (
        F.when(m.rlike("^" + _SECRET_HEAD), "secret")
        .when(m.contains("@"), "email")
        .when(m.rlike("^(?:" + PATTERNS["iban"] + ")$"), "iban")
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(m.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f]*:[0-9A-Fa-f:]*$"), "ip6")
        .when(m.rlike("^(?:[0-9]{4}[ -]){3}[0-9]{1,7}$|^[0-9]{13,19}$"), "card")
        .when(m.rlike(r"^(?:" + _TITLES + r")\.?\s"), "name")
        .when(m.rlike("^[+(]|^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$|^0[0-9]+[ /-]"), "phone")
        .otherwise("secret")
    )


def _gender(m: Column) -> Column:
    return F.when(m.rlike("^(?:" + "|".join(MALE_TITLES) + r")\.?\s"), "m").when(m.rlike("^(?:" + "|".join(FEMALE_TITLES) + r")\.?\s"), "f").otherwise("x")


def _name_words(m: Column) -> Column:
    """The given name, or an initial, and the surname; or the surname alone."""
    words = F.split(F.regexp_replace(m, r"^\S+\s+", ""), " ")
    return F.when(F.size(words) > 2, F.array(F.array_join(F.slice(words, 1, F.size(words) - 1), " "), F.element_at(words, -1))).otherwise(words)


def _base(x: Column, kind: Column) -> Column:
    """The form in which entities are the same: what is hashed, and compared for collisions."""
    return (
        F.when(kind == "phone", F.regexp_replace(F.regexp_replace(x, r"^\+1(?=(?:[^0-9]*[0-9]){10}$)", ""), "[^0-9]", ""))
        .when(kind.isin("card", "ssn"), F.regexp_replace(x, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(x, " ", ""))
        .when(kind.isin("email", "given", "surname", "ip6"), F.lower(x))
        .otherwise(x)
    )


def _head(m: Column, kind: Column) -> Column:
    """What stands before the entity in a match and stays: a title, or the word that names a secret."""
    return F.when(kind == "name", F.regexp_extract(m, r"^\S+\s+", 0)).when(kind == "secret", F.regexp_extract(m, _SECRET_START + "?", 0)).otherwise("")


def _form(m: Column, kind: Column) -> Column:
    return F.when(kind == "secret", F.regexp_replace(m, _SECRET_START, "")).otherwise(m)


def entities(m: Column, kind: Column) -> Column:
    """Array of (kind, base, form, gender) of a match of a kind: one, or of a name one for each of its words."""
    one = lambda kind, base, form, gender: F.struct(kind.alias("kind"), base.alias("base"), form.alias("form"), gender.alias("gender"))
    words = _name_words(m)
    surname = one(F.lit("surname"), F.lower(F.element_at(words, -1)), F.element_at(words, -1), F.lit(""))
    given = one(F.lit("given"), F.lower(words[0]), words[0], _gender(m))
    return F.when(kind == "name", F.when(F.size(words) > 1, F.array(given, surname)).otherwise(F.array(surname))).otherwise(F.array(_let(_form(m, kind), lambda form: one(kind, _base(form, kind), form, F.lit("")))))


class Key:
    """The two blocks that HMAC-SHA-256 makes of a key, as a table of one row whose values no plan shows."""

    def __init__(self, spark: SparkSession, key: str):
        plain = key.encode()
        block = (hashlib.sha256(plain).digest() if len(plain) > 64 else plain).ljust(64, b"\0")
        pads = [bytearray(b ^ x for b in block) for x in (0x36, 0x5C)]
        self.table = spark.createDataFrame([tuple(pads)], "inner_pad binary, outer_pad binary")

    def beside(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.table.select(c).scalar() for c in ("inner_pad", "outer_pad")})


def _mac(message: Column) -> Column:
    """Hex digits of the HMAC, of rows that have a Key beside them."""
    inner = F.unhex(F.sha2(F.concat(F.col("inner_pad"), F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(F.col("outer_pad"), inner), 256)


def _stream(kind: Column, base: Column, attempt: Column) -> Column:
    """128 hex digits that depend on the key and all three."""
    return _let(F.concat_ws("|", kind, base, attempt.cast("string")), lambda seed: F.concat(_mac(seed), _mac(F.concat(F.lit("+"), seed))))


def _number(stream: Column, i: Column) -> Column:
    """The i-th (from 0) of 63 numbers below 2 ** 16 in a stream, over and over."""
    return F.conv(F.substring(stream, (F.pmod(i, F.lit(62)) * 2 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _chars(x: Column) -> Column:
    return F.split(x, "(?!^)(?!$)")


def _is_digit(c: Column) -> Column:
    return c.between("0", "9")


def _redigit(form: Column, stream: Column, keep: Column) -> Column:
    """Digits after the first ``keep`` ones replaced, by their place among those."""
    state = lambda n, made: F.struct(n.alias("n"), made.alias("made"))
    digit = lambda acc: F.when(acc["n"] >= keep, F.pmod(_number(stream, acc["n"] - keep), F.lit(10)).cast("string"))
    step = lambda acc, c: F.when(_is_digit(c), state(acc["n"] + 1, F.concat(acc["made"], F.coalesce(digit(acc), c)))).otherwise(state(acc["n"], F.concat(acc["made"], c)))
    return F.aggregate(_chars(form), state(F.lit(0), F.lit("")), step, lambda acc: acc["made"])


def _letter(alphabet: str, stream: Column, i: Column) -> Column:
    return F.substring(F.lit(alphabet), (F.pmod(_number(stream, i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))


def _reshape(form: Column, stream: Column, scripts: dict | None = None) -> Column:
    """Every letter and digit replaced by one of its class and case, and of its script among the given ones."""

    def other(c: Column, i: Column) -> Column:
        out = F.when(_is_digit(c), _letter("0123456789", stream, i))
        for name, (upper, lower) in (scripts or {}).items():
            here = c.rlike(f"\\p{{Is{name}}}") & c.rlike("\\p{L}")
            out = out.when(here & c.rlike("\\p{Lu}"), _letter(upper, stream, i)).when(here, _letter(lower, stream, i))
        return out.when(c.rlike("\\p{Lu}"), _letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", stream, i)).when(c.rlike("\\p{L}"), _letter("abcdefghijklmnopqrstuvwxyz", stream, i)).otherwise(c)

    return F.array_join(F.transform(_chars(form), other), "")


def _rehex(form: Column, stream: Column) -> Column:
    pick = lambda alphabet, i: F.substring(F.lit(alphabet), (F.pmod(_number(stream, i), F.lit(16)) + 1).cast("int"), F.lit(1))
    every = lambda alphabet: F.array_join(F.transform(_chars(form), lambda c, i: pick(alphabet, i)), "")
    return F.when(form.rlike("[A-F]"), every("0123456789ABCDEF")).otherwise(every("0123456789abcdef"))


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn check, modulo 10: 0 for valid numbers."""
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(_chars(digits), lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 0, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.pmod(F.aggregate(values, F.lit(0), lambda acc, x: acc + x), F.lit(10))


def _card(form: Column, stream: Column) -> Column:
    """All digits but the first replaced; the last makes the number as valid as it was."""
    plain = lambda x: F.regexp_replace(x, "[^0-9]", "")

    def checked(made: Column) -> Column:
        start = F.substring(made, F.lit(1), F.length(made) - 1)
        right = F.pmod(F.lit(10) - _luhn(plain(F.concat(start, F.lit("0")))), F.lit(10))
        return F.when(_luhn(plain(form)) == 0, F.concat(start, right.cast("string"))).otherwise(made)

    return _let(_redigit(form, stream, F.lit(1)), checked)


def _iban(form: Column, stream: Column) -> Column:
    """Country kept, the account replaced, check digits made right."""

    def checked(body: Column) -> Column:
        ring = F.concat(F.regexp_replace(body, " ", ""), F.substring(form, 1, 2), F.lit("00"))
        left = F.aggregate(_chars(ring), F.lit(0), lambda acc, c: F.when(_is_digit(c), F.pmod(acc * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97))))
        return F.concat(F.substring(form, 1, 2), F.lpad((98 - left).cast("string"), 2, "0"), body)

    return _let(_reshape(F.substring(form, F.lit(5), F.length(form)), stream), checked)


def _ip(form: Column, stream: Column) -> Column:
    """Private, loopback and link-local ranges stay what they are; other addresses get an ordinary public first octet."""
    octets = F.transform(F.split(form, "\\."), lambda c, i: (1 + F.pmod(_number(stream, i), F.lit(254))).cast("string"))
    kept = lambda n: F.concat(F.substring_index(form, ".", n), F.lit("."), F.array_join(F.slice(octets, n + 1, 4 - n), "."))
    first = F.concat((11 + F.pmod(_number(stream, F.lit(0)), F.lit(88))).cast("string"), F.lit("."), F.array_join(F.slice(octets, 2, 3), "."))
    return F.when(form.rlike(r"^(?:10|127)\."), kept(1)).when(form.rlike(r"^(?:192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\."), kept(2)).otherwise(first)


def _ip6(form: Column, stream: Column) -> Column:
    """Groups keep their length and case, unique local and link-local addresses their first group; the address doesn't
    begin with a zero that wasn't there."""
    keep = F.when(form.rlike("(?i)^(?:f[cd][0-9a-f]{2}|fe80):"), 4).otherwise(0)
    pick = lambda alphabet, i: F.substring(F.lit(alphabet), (F.pmod(_number(stream, i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
    one = lambda c, i: F.when((i < keep) | (c == ":"), c).when(form.rlike("[A-F]"), pick("123456789ABCDEF", i)).otherwise(pick("123456789abcdef", i))
    return F.array_join(F.transform(_chars(form), one), "")


def _email(form: Column, stream: Column) -> Column:
    host = F.array_join(F.transform(F.sequence(F.lit(40), F.lit(47)), lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.pmod(_number(stream, i), F.lit(26)) + 1).cast("int"), F.lit(1))), "")
    local = F.substring_index(form, "@", 1)
    return F.concat(F.when(local.rlike("[^\\x00-\\x7F]"), _reshape(local, stream, SCRIPTS)).otherwise(_reshape(local, stream)), F.lit("@"), host, F.lit(".example"))


def _syllable(script: str, stream: Column):
    onsets, vowels = F.array(*map(F.lit, _ONSETS[script])), F.array(*map(F.lit, _VOWELS[script]))
    at = lambda xs, n, count: F.element_at(xs, (F.pmod(n, F.lit(count)) + 1).cast("int"))
    return lambda i: F.concat(at(onsets, _number(stream, 2 * i), 14), at(vowels, _number(stream, 2 * i + 1), 4))


def _spelled(form: Column, stream: Column, attempt: Column, ending) -> Column:
    """A name of syllables in the form's script with the ending of that script; each attempt adds a syllable."""
    out = None
    for script in ("latin", "greek", "cyrillic"):
        stem = F.array_join(F.transform(F.sequence(F.lit(0), F.least(2 + attempt, F.lit(20))), _syllable(script, stream)), "")
        name = F.initcap(F.concat(stem, ending(script)))
        out = name if out is None else F.when(form.rlike(f"\\p{{Is{script.capitalize()}}}"), name).otherwise(out)
    return out


def _given(form: Column, stream: Column, attempt: Column, gender: Column) -> Column:
    return _spelled(form, stream, attempt, lambda script: F.when(gender == "m", _ENDINGS[script]["m"]).when(gender == "f", _ENDINGS[script]["f"]).otherwise(_ENDINGS[script]["x"]))


def _surname(form: Column, stream: Column, attempt: Column) -> Column:
    return _spelled(form, stream, attempt, lambda script: F.lit(_SURNAMES[script]))


def _country(form: Column) -> Column:
    """Digits of a leading country code, or the zero of a number within a country."""
    return F.when(form.startswith("+"), F.length(F.regexp_extract(form, "^\\+([0-9]{1,3}?)(?=[^0-9]|[0-9]{4})", 1))).when(form.startswith("0"), 1).otherwise(F.lit(0))


def _widened(kind: Column, form: Column, attempt: Column, stream: Column) -> Column:
    """A surrogate of a wider form: a secret of letters and digits, an address in a larger private range and then a public
    one, all groups of an IPv6 address, more digits of a short phone number. Null for kinds that have enough in their own."""
    pick = lambda alphabet, i: F.substring(F.lit(alphabet), (F.pmod(_number(stream, i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
    row = lambda alphabet, first, last: F.array_join(F.transform(F.sequence(first, last), lambda i: pick(alphabet, i)), "")
    octet = lambda i: (1 + F.pmod(_number(stream, F.lit(i)), F.lit(254))).cast("string")
    small = (attempt < 2 * WIDE) & ~form.startswith("10.") & form.rlike(r"^(?:127|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\.")
    first = F.when(small, "10").otherwise((11 + F.pmod(_number(stream, F.lit(0)), F.lit(88))).cast("string"))
    local = form.rlike("(?i)^(?:f[cd][0-9a-f]{2}|fe80):")
    groups = [F.when(local, F.substring(form, 1, 4)).otherwise(row("123456789abcdef", F.lit(0), F.lit(3))), *[row("123456789abcdef", F.lit(i), F.lit(i + 3)) for i in range(4, 32, 4)]]
    ip6 = F.concat_ws(":", *groups)
    short = F.length(F.regexp_replace(form, "[^0-9]", "")) < 9
    return (
        F.when(kind == "secret", row("abcdefghijklmnopqrstuvwxyz0123456789", F.lit(0), F.greatest(F.length(form), F.lit(12)) - 1))
        .when(kind == "ip", F.concat_ws(".", first, octet(1), octet(2), octet(3)))
        .when(kind == "ip6", F.when(form.rlike("[A-F]"), F.upper(ip6)).otherwise(ip6))
        .when((kind == "phone") & short, F.concat(_redigit(form, stream, _country(form)), F.lit(" "), row("0123456789", F.lit(40), F.lit(47))))
    )


def surrogate(e: Column, attempt: Column, gender: Column) -> Column:
    """What stands for an entity (kind, base, form), of rows that have a Key beside them."""
    return _let(_stream(e["kind"], e["base"], attempt), lambda stream: _from_stream(e["kind"], e["form"], attempt, gender, stream))


def _from_stream(kind: Column, form: Column, attempt: Column, gender: Column, stream: Column) -> Column:
    own = (
        F.when(kind == "email", _email(form, stream))
        .when(kind == "card", _card(form, stream))
        .when(kind == "ip", _ip(form, stream))
        .when(kind == "ip6", _ip6(form, stream))
        .when(kind == "phone", _redigit(form, stream, _country(form)))
        .when(kind == "ssn", _redigit(form, stream, F.lit(0)))
        .when(kind == "iban", _iban(form, stream))
        .when(kind == "given", _given(form, stream, attempt, gender))
        .when(kind == "surname", _surname(form, stream, attempt))
        .when(form.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), _rehex(form, stream))
        .otherwise(_reshape(form, stream))
    )
    return F.coalesce(F.when(attempt >= WIDE, _widened(kind, form, attempt, stream)), own)


def exceptions(found: DataFrame, key: Key) -> tuple[DataFrame, list[str]]:
    """(kind, base, attempt, gender) of the entities (kind, base, form, gender) whose first surrogate collides or whose
    forms differ in gender; folders to remove."""
    spark = found.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    made = lambda attempt: _base(surrogate(F.struct("kind", "base", "form"), attempt, F.col("gender")), F.col("kind"))
    # the table is small in bytes but dear to compute: dealt to all cores, and each surrogate is made once
    said = lambda g: F.max(F.col("gender") == g)
    gender = F.when(said("m") & ~said("f"), "m").when(said("f") & ~said("m"), "f").otherwise(F.when(F.max("gender") == "", "").otherwise("x"))
    real = found.groupBy("kind", "base").agg(F.min("form").alias("form"), gender.alias("gender"), (F.min("gender") != F.max("gender")).alias("mixed")).repartition(parts, "kind", "base")
    now, path = common.saved(key.beside(real).select("kind", "base", "form", "gender", "mixed", F.lit(0).alias("attempt"), made(F.lit(0)).alias("made")), "pii-entities")
    done = [path]
    for _ in range(MAX_ATTEMPTS):
        firsts = now.groupBy("kind", "made").agg(F.min(F.struct("attempt", "base")).alias("first"), F.count("*").alias("n"))
        taken = now.select("kind", F.col("base").alias("made"), F.lit(True).alias("taken"))
        clash = firsts.join(taken, ["kind", "made"], "left").where("n > 1 OR taken").select("kind", "made", F.when(F.col("taken"), None).otherwise(F.col("first.base")).alias("winner"))
        losers, path = common.saved(now.join(clash, ["kind", "made"]).where("winner IS NULL OR winner <> base").select("kind", "base", F.lit(1).alias("again")), "pii-clashes")
        done.append(path)
        if losers.isEmpty():
            return now.where("attempt > 0 OR mixed").select("kind", "base", "attempt", "gender"), done
        # a select of its own: within a lambda function Spark takes a name for the alias beside it, not for the input's column
        turned = now.join(losers, ["kind", "base"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        tried = F.when(F.col("again").isNull(), F.col("made")).otherwise(made(F.col("attempt")))
        now, path = common.saved(key.beside(turned).select("kind", "base", "form", "gender", "mixed", "attempt", tried.alias("made")), "pii-entities")
        done.append(path)
    raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def with_surrogates(docs: DataFrame, key: str, *, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with entities of ``text`` replaced, and n_entities (a titled name's later mentions without
    the title aren't counted).

    A null text stays null with 0 entities; an empty one stays empty. Rows that repeat are treated alike; ids play no
    part and may be null. Surrogates depend on ``key``, which must be kept secret, and on the entity alone but for
    collisions and the gender of given names, which depend on the corpus. A column named n_entities is replaced; other
    names are free. An empty table gives an empty one.
    """
    spark, secret = docs.sparkSession, Key(docs.sparkSession, key)
    own = [c for c in docs.columns if c != "n_entities"]
    # a row's other columns are one, so that no name of docs can clash with one of ours
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in own if c != text]).alias("row")
    t = F.col("t")
    matches = F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0))
    # explode_outer, as a filter of empty arrays would be pushed down and match everything twice
    hits = docs.select(F.col(text).alias("t")).where(t.rlike(_GATE)).select(F.xxhash64("t").alias("doc"), F.explode_outer(matches).alias("m")).where("m IS NOT NULL")
    split = _let(kind_of(F.col("m")), lambda kind: entities(F.col("m"), kind))
    found, path = common.saved(hits.select("doc", F.explode_outer(split).alias("e")).select("doc", "e.*").distinct(), "pii-found")
    again, done = exceptions(found.select("kind", "base", "form", "gender"), secret)
    again = again.withColumnRenamed("gender", "known")
    odd = found.select("doc", "kind", "base", "gender").join(again, ["kind", "base"]).where("attempt > 0 OR gender <> known")
    named = F.struct(F.concat_ws(":", "kind", "base"), F.struct("attempt", F.col("known").alias("gender")))
    by_text, _ = common.saved(odd.groupBy("doc").agg(F.map_from_entries(F.collect_set(named)).alias("exceptions")), "pii-exceptions")
    common.remove(spark, path, *done)
    joined = secret.beside(docs.select(others, F.col(text).alias("t")).withColumn("found", F.when(t.rlike(_GATE), matches)))
    rows = by_text.count()
    if rows:
        there = common.maybe_broadcast(by_text, rows, 500)
        joined = joined.join(there, F.when(F.size("found") > 0, F.xxhash64("t")) == F.col("doc"), "left")
        known = lambda e: F.try_element_at(F.col("exceptions"), F.concat_ws(":", e["kind"], e["base"]))
        stand_in = lambda e: _let(known(e), lambda x: surrogate(e, F.coalesce(x["attempt"], F.lit(0)), F.coalesce(x["gender"], e["gender"])))
    else:
        stand_in = lambda e: surrogate(e, F.lit(0), e["gender"])

    def one(m: Column, kind: Column) -> Column:
        return F.concat(_head(m, kind), F.array_join(F.transform(entities(m, kind), stand_in), " "))

    pieces = F.split(t, ENTITY, -1)
    whole = F.array_join(F.flatten(F.zip_with(pieces, F.transform("found", lambda m: _let(kind_of(m), lambda kind: one(m, kind))), lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")
    # a titled name's later mentions: its words together first, then the surname
    names = F.filter("found", lambda m: m.rlike(r"^(?:" + _TITLES + r")\.?\s"))
    told = F.transform(names, lambda m: _let(entities(m, F.lit("name")), lambda es: F.struct(F.transform(es, lambda e: e["form"]).alias("old"), F.transform(es, stand_in).alias("new"))))
    pair = lambda n: F.struct(F.array_join(n["old"], " ").alias("old"), F.array_join(n["new"], " ").alias("new"))
    last = lambda n: F.struct(F.element_at(n["old"], -1).alias("old"), F.element_at(n["new"], -1).alias("new"))
    mentions = _let(told, lambda ns: F.concat(F.transform(F.filter(ns, lambda n: F.size(n["old"]) > 1), pair), F.transform(F.filter(ns, lambda n: F.length(F.element_at(n["old"], -1)) > 2), last)))
    mention = lambda acc, n: F.when(acc.contains(n["old"]), F.regexp_replace(acc, F.concat(F.lit(r"(?<![\p{L}\p{N}'’-])"), n["old"], F.lit(r"(?![\p{L}\p{N}])")), n["new"])).otherwise(acc)
    again = F.when(F.size(names) > 0, F.aggregate(F.array_distinct(mentions), whole, mention)).otherwise(whole)
    new = F.when(F.size("found") > 0, again).otherwise(t)
    count = F.when(F.col("found").isNotNull(), F.size("found")).otherwise(0).cast("long")
    replaced = joined.select("row", new.alias("new"), count.alias("count"))
    return replaced.select(*[F.col("new").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in own], F.col("count").alias("n_entities"))
