"""Personal data and secrets replaced by keyed surrogates, with DataFrame functions only.

Entities are found by one pattern.  A surrogate is a keyed permutation of the entity within its format:
each letter or digit moves within its own class (digits; vowels and consonants of a script and case) by
a shift hashed from the key and what stands before it, then again from what stands after it.  Both passes
can be undone, and entities that they would leave as they are change places with their neighbours, so
different entities of a kind have different surrogates, none its own, and equal entities (whatever
their case) equal ones, in every document and on every machine, without a shared table.  Only private
keys and parts over ``LONG`` characters rest on a digest instead.  Script, length,
separators, case, and in names the honorific and the ending that tells gender stay; card numbers keep a
valid check digit and account numbers valid check digits, addresses stay addresses, domains keep their
top level.  Cards, accounts, phone and social security numbers are permuted without their separators, so
one number in several layouts has one surrogate, each time in its own layout.

Collisions are checked, not only excluded: ``surrogates_distinct`` says of each document that its entities and surrogates are
equally many; ``surrogate_collisions`` lists surrogates that several entities of the corpus share.

Defined results: null texts stay null and have no entities; texts without entities are not changed; equal
rows have equal results; very long texts are searched whole, in time in line with their length; where
entities could overlap (a tie), the one that begins first is taken, then the kind named first in
``PATTERNS``; an empty table gives no rows; other columns pass through unread, but for
columns of the input named like the three results, which these replace.  Numbers of a card's length
whose check digit is wrong, and account numbers written in one piece whose check digits are wrong, are no
entities.  Letters of scripts without a class here are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_KEY = "basalt-surrogates"

# Letters of each class; the upper-case class follows from the lower-case one.
_VOWELS = ("aeiou", "àáâäåæèéêëìíîïòóôöùúûü", "аеиоуыэюя", "αεηιουω")
_CONSONANTS = ("bcdfghjklmnpqrstvwxyz", "çñ", "бвгджзйклмнпрстфхцчшщ", "βγδζθκλμνξπρστφχψ")
_ALPHABETS = ("0123456789", *_VOWELS, *_CONSONANTS, *(x.upper() for x in (*_VOWELS, *_CONSONANTS)))

# Scripts whose letters form one class each: first and last code point.
_RANGES = ((0x05D0, 0x05EA), (0x0621, 0x063A), (0x0641, 0x064A), (0x0905, 0x0939), (0x0E01, 0x0E2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))

_RANGE_ROWS = "array(" + ", ".join(f"named_struct('a', {a}L, 'b', {b}L)" for a, b in _RANGES) + ")"

# Every quantifier over a group is bounded and every unbounded one is over a single class, as Java's matcher calls
# itself once a turn of a group; no unbounded run can start inside another one, so time stays linear.
_EDGE, _END = r"(?<![A-Za-z0-9_\p{L}\p{N}])", r"(?![A-Za-z0-9_\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HONORIFIC = r"(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sr|Sra|Don|Doña|Г-н|Г-жа|Κύριος|Κυρία)\.?"
_SUFFIX = r"\d*+(?:[_-][A-Za-z0-9]++){0,6}+"
_SURE = r"(?i:password|passwd|pwd|passphrase|api[_-]?key|access[_-]?key)" + _SUFFIX
_LIKELY = r"(?i:secret|token|auth)" + _SUFFIX
_IS = r"\s{0,3}[:=]\s{0,3}"
_ASSIGNED = rf"(?:{_SURE}|{_LIKELY}){_IS}[\"']?"
#: Plain words behind a colon are prose (`the secret: remember`), unless the name says that it is a password.
_NO_PROSE = r"(?!\s{0,3}:\s{1,3}[\p{L}'’-]{1,40}[.,;:!?)]{0,3}(?:\s|$))"

#: Kinds and their patterns; where several fit at one place, the first is taken.
PATTERNS = {
    "private_key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:\s{1,4}[A-Za-z-]{1,40}: [^\n]{0,400}){0,4}[A-Za-z0-9+/=\s\\]*+-----END [A-Z ]{0,40}PRIVATE KEY-----",
    "email": r"(?<![A-Za-z0-9\p{L}\p{N}._%+-])[A-Za-z0-9\p{L}\p{N}._%+-]++@[\p{L}\p{N}][\p{L}\p{N}.-]*\.\p{L}{2,}+",
    "token": _EDGE + r"(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}|sk[-_][A-Za-z0-9_-]{16,}|AIza[A-Za-z0-9_-]{35}|(?<!-)eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,})" + _END,
    "secret": r"(?<![A-Za-z0-9\p{L}\p{N}])(?:" + _SURE + "|" + _LIKELY + _NO_PROSE + ")" + _IS + r"[\"']?[^\s\"'<>]{6,}+",
    "iban": _EDGE + r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)" + _END,
    "ip": r"(?<![A-Za-z0-9\p{L}\p{N}_.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![\p{L}\p{N}_]|\.\d)",
    "ssn": r"(?<![A-Za-z0-9\p{L}\p{N}_-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}_-])",
    "card": r"(?<![A-Za-z0-9\p{L}\p{N}_.,-])(?:\d{13,19}+|(?:\d{4} ){3}\d{1,7}+|(?:\d{4}-){3}\d{1,7}+|\d{4}[ -]\d{6}[ -]\d{4,5}+)(?![\p{L}\p{N}_-]|\.\d)",
    "phone": r"(?<![A-Za-z0-9\p{L}\p{N}_.,-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,13}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}_])",
    "name": _EDGE + _HONORIFIC + r" (?:\p{Lu}[\p{L}'’-]{1,30}(?: \p{Lu}[\p{L}'’-]{1,30})?|\p{IsHan}{1,6}|\p{IsHangul}{1,6}|[\p{IsHiragana}\p{IsKatakana}]{1,12})",
}
#: What each kind may begin with, so that most places of a text fail at one look.
_FIRST = {"token": "[Agxse]", "secret": "[pPsStTaA]", "iban": "[A-Z]", "ip": r"\d", "ssn": r"\d", "card": r"\d", "phone": r"[\d+(]", "name": "[MDHFSГΚ]"}
ANY = (
    f"{PATTERNS['private_key']}|(?<![A-Za-z0-9\\p{{L}}\\p{{N}}])(?:"
    + "|".join((f"(?={_FIRST[k]})" if k in _FIRST else "") + f"(?:{p})" for k, p in PATTERNS.items() if k != "private_key")
    + ")"
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern is the whole entity; null for numbers that only look like a card or an account."""
    out = F.lit("secret")
    for kind, pattern in reversed(PATTERNS.items()):
        own = F.lit(kind)
        if kind == "card":
            own = F.when(_luhn(_compact(entity)) == 0, own)
        if kind == "iban":
            own = F.when(entity.contains(" ") | (_account_sum(entity) == 1), own)
        out = F.when(entity.rlike(f"^(?:{pattern})$"), own).otherwise(out)
    return out


#: Kinds whose separators are only layout: one number in several layouts has one surrogate.
_LAID_OUT = ("card", "phone", "ssn", "iban")


def _compact(entity: Column) -> Column:
    return F.regexp_replace(entity, r"[^A-Za-z0-9+]", "")


def _laid_out(entity: Column, made: Column) -> Column:
    """The characters of ``made`` with the separators of ``entity`` between them."""
    step = lambda n, out: F.struct(n.alias("n"), out.alias("out"))
    return F.aggregate(
        F.split(entity, ""),
        step(F.lit(0), F.lit("")),
        lambda at, c: F.when(c.rlike("[A-Za-z0-9+]"), step(at["n"] + 1, F.concat(at["out"], _substring(made, at["n"] + 1, F.lit(1))))).otherwise(step(at["n"], F.concat(at["out"], c))),
        lambda at: at["out"],
    )


# Where each character's class begins and how long it is, three digits a character.
_ALL = "".join(_ALPHABETS)
_BEGINS = "".join(f"{sum(map(len, _ALPHABETS[:k])):03d}" * len(a) for k, a in enumerate(_ALPHABETS))
_SIZES = "".join(f"{len(a):03d}" * len(a) for a in _ALPHABETS)

#: Parts of an entity that stay; the rest of it is permuted.
_NOTHING = "(?!)"
_KEPT = {
    "email": r"@|\.\p{L}+$",
    "card": r"^\d|\d$",
    "phone": r"^\+\d",
    "iban": r"^[A-Z]{2}\d{2}",
    "token": "^(?:AKIA|ASIA|AIza|gh[pousr]_|xox[abprs]-|sk[-_]|eyJ)",
    "secret": "^" + _ASSIGNED,
    "name": "^" + _HONORIFIC + r" |\p{L}(?= |$)| ",
}


def _substring(text: Column, start: Column, length: Column) -> Column:
    return text.substr(start.cast("int"), length.cast("int"))


def _shifted(char: Column, shift: Column) -> Column:
    """The character that many places on in its class; others stay."""

    def moved(at: Column) -> Column:
        begin = F.substr(F.lit(_BEGINS), 3 * at - 2, F.lit(3)).cast("int")
        size = F.substr(F.lit(_SIZES), 3 * at - 2, F.lit(3)).cast("int")
        to = begin + F.pmod(at - begin - 1 + shift, size).cast("int") + 1
        return F.when(at > 0, F.substr(F.lit(_ALL), to, F.lit(1))).otherwise(beyond)

    def in_range(kept: Column, r: Column) -> Column:
        to = r["a"] + F.pmod(F.ascii(char) - r["a"] + shift, r["b"] - r["a"] + 1)
        return F.when(F.ascii(char).between(r["a"], r["b"]), F.decode(F.unhex(F.lpad(F.hex(to), 4, "0")), "UTF-16BE")).otherwise(kept)

    beyond = F.aggregate(F.expr(_RANGE_ROWS), char, in_range)
    return _let(F.instr(F.lit(_ALL), char), moved)


def _pass(text: Column, seed: Column, forward: bool) -> Column:
    """One pass over the text: every character moves by what stands before (or after) it."""
    n = F.char_length(text)

    def one(i: Column) -> Column:
        beside = _substring(text, F.lit(1), i - 1) if forward else _substring(text, i + 1, n - i)
        shift = F.pmod(F.xxhash64(F.concat_ws("\x1f", seed, F.lit("f" if forward else "b"), F.lower(beside))), F.lit(1_000_000_007))
        return _shifted(_substring(text, i, F.lit(1)), shift)

    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), one), "")).otherwise(text)


#: Longer texts are moved by a digest of the whole, which takes time in line with their length.
LONG = 400


def _moved_by_digest(text: Column, seed: Column) -> Column:
    """A long text with every character moved in its class by a digest of the whole and its place."""

    def one(digest: Column) -> Column:
        by = lambda i: F.pmod(F.xxhash64(F.concat_ws("\x1f", digest, i.cast("string"))), F.lit(1_000_000_007))
        return F.array_join(F.transform(F.split(text, ""), lambda c, i: _shifted(c, by(i))), "")

    return _let(F.sha2(F.concat_ws("\x1f", seed, F.lower(text)), 256), one)


def permuted(text: Column, seed: Column) -> Column:
    """The keyed permutation of a text within its format."""
    short = _let(_pass(text, seed, True), lambda x: _pass(x, seed, False))
    return F.when(F.char_length(text) > LONG, _moved_by_digest(text, seed)).otherwise(short)


#: Any letter or digit that has a class.
_MOVABLE = "[" + "".join(_ALPHABETS) + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _RANGES) + "]"


def _turned(parts: Column, by: int) -> Column:
    """The first character of the parts that has a class, so many places on in it; no parts stay alike if one has."""
    at = F.array_position(F.transform(parts, lambda p: p.rlike(_MOVABLE)), True)

    def turn(part: Column) -> Column:
        n = F.char_length(F.regexp_extract(part, f"^[^{_MOVABLE[1:]}*", 0))
        char = _shifted(_substring(part, n + 1, F.lit(1)), F.lit(by))
        return F.concat(_substring(part, F.lit(1), n), char, _substring(part, n + 2, F.char_length(part)))

    return F.transform(parts, lambda p, i: F.when(i + 1 == at, turn(p)).otherwise(p))


def _may_stay(part: Column, seed: Column) -> Column:
    """False if the permutation surely moves the last character, which takes two hashes to see."""
    n = F.char_length(part)
    by = lambda way, beside: F.pmod(F.xxhash64(F.concat_ws("\x1f", seed, F.lit(way), F.lower(beside))), F.lit(1_000_000_007))
    last = _substring(part, n, F.lit(1))
    return F.when(n > LONG, False).when(n > 0, _shifted(last, by("f", _substring(part, F.lit(1), n - 1)) + by("b", F.lit(""))) == last).otherwise(True)


def _without_fixed_points(x: Column, image, turned, may_stay, orbit: int) -> Column:
    """The permutation ``image`` with values that it leaves as they are exchanged with their neighbours.

    ``turned(x, 1)`` is the next value, in cycles of at most ``orbit``.  Of a run of fixed values each takes the
    image of the next one, and the value behind the run takes the first of the run: again a permutation.
    """

    def first_of_run(z: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(orbit)), z, lambda at, _: _let(turned(at, -1), lambda y: F.when(image(y) == y, y).otherwise(at)))

    def moved(made: Column) -> Column:
        other = _let(turned(x, -1), lambda z: F.when(may_stay(z) & (image(z) == z), first_of_run(z)).otherwise(made))
        return F.when(made == x, image(turned(x, 1))).otherwise(other)

    return _let(image(x), moved)


def _octets(address: Column, seed: Column) -> Column:
    """An IPv4 address moved within the addresses: first numbers of 1 to 223 among themselves."""

    def one(parts: Column, i: int, beside: Column, way: str) -> Column:
        shift = F.pmod(F.xxhash64(F.concat_ws("\x1f", seed, F.lit(f"{way}{i}"), beside)), F.lit(1_000_000_007))
        if i:
            return F.pmod(parts[i] + shift, F.lit(256))
        common = F.pmod(parts[0] - 1 + shift, F.lit(223)) + 1
        rare = F.pmod(parts[0] - 224 + shift, F.lit(32)) + 224
        return F.when(parts[0].between(1, 223), common).when(parts[0] > 223, rare).otherwise(parts[0])

    def forward(p: Column) -> Column:
        return F.array(*[one(p, i, F.array_join(F.slice(p, 1, i), ".") if i else F.lit(""), "f") for i in range(4)])

    def backward(p: Column) -> Column:
        return F.array(*[one(p, i, F.array_join(F.slice(p, i + 2, 3 - i), ".") if i < 3 else F.lit(""), "b") for i in range(4)])

    def turned(p: Column, by: int) -> Column:
        return F.concat(F.slice(p, 1, 3), F.array(F.pmod(p[3] + by, F.lit(256))))

    parts = F.split(address, r"\.").cast("array<long>")
    image = lambda p: _let(_let(p, forward), backward)
    return F.array_join(_let(parts, lambda p: _without_fixed_points(p, image, turned, lambda z: F.lit(True), 256)), ".")


def _luhn(digits: Column) -> Column:
    """The check sum of a string of digits with its last digit: 0 (modulo 10) if it is valid."""
    n = F.char_length(digits)

    def one(i: Column) -> Column:
        d = _substring(digits, i, F.lit(1)).cast("int")
        doubled = F.pmod(n - i, F.lit(2)) == 1
        return F.when(doubled & (d > 4), 2 * d - 9).when(doubled, 2 * d).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda a, x: a + x) % 10


def _checked(number: Column, remainder: Column) -> Column:
    """A number with its last digit set so that its check sum has that remainder (0: it is valid)."""
    body = _substring(number, F.lit(1), F.char_length(number) - 1)
    with_zero = _luhn(F.concat(F.regexp_replace(body, r"\D", ""), F.lit("0")))
    return F.concat(body, F.pmod(10 + remainder - with_zero, F.lit(10)).cast("string"))


def _account_sum(account: Column) -> Column:
    """The remainder modulo 97 of an account number without separators: 1 if its check digits are right."""
    turned = F.split(F.concat(_substring(account, F.lit(5), F.char_length(account)), _substring(account, F.lit(1), F.lit(4))), "")

    def step(at: Column, c: Column) -> Column:
        digit = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(c == "", at).otherwise((at * F.when(digit > 9, 100).otherwise(10) + digit) % 97)

    return F.aggregate(turned, F.lit(0), step)


def _account_checked(made: Column, was: Column) -> Column:
    """An account number with check digits as far from the right ones as they were in ``was``: right ones stay right."""
    right = lambda x: 98 - _account_sum(F.concat(_substring(x, F.lit(1), F.lit(2)), F.lit("00"), _substring(x, F.lit(5), F.char_length(x))))
    digits = F.pmod(right(made) + _substring(was, F.lit(3), F.lit(2)).cast("int") - right(was), F.lit(100))
    return F.concat(_substring(made, F.lit(1), F.lit(2)), F.lpad(digits.cast("string"), 2, "0"), _substring(made, F.lit(5), F.char_length(made)))


def _private_key(entity: Column, seed: Column) -> Column:
    """A key's body is hashed, not permuted: it is long and its only format is its alphabet and length."""
    head = F.regexp_extract(entity, "^-----BEGIN [A-Z ]*PRIVATE KEY-----", 0)
    tail = F.regexp_extract(entity, "-----END [A-Z ]*PRIVATE KEY-----$", 0)
    digest = F.sha2(F.concat_ws("\x1f", seed, entity), 512)
    room = F.char_length(entity) - F.char_length(head) - F.char_length(tail)
    body = F.rpad(digest, F.greatest(room - 2, F.lit(0)), digest)
    return F.concat(head, F.lit("\n"), body, F.lit("\n"), tail)


def surrogate(entity: Column, kind: Column, key: str = DEFAULT_KEY) -> Column:
    """The surrogate of an entity: a permutation within kind and format that leaves nothing as it is.

    Card and account numbers keep the remainder of their check sums, so valid and invalid ones stay apart;
    a null kind leaves the entity as it is.
    """
    return _let(F.when(kind.isin(*_LAID_OUT), _compact(entity)).otherwise(entity), lambda x: _surrogate(x, entity, kind, key))


def _surrogate(core: Column, entity: Column, kind: Column, key: str) -> Column:
    kept = F.lit(_NOTHING)
    for k, pattern in _KEPT.items():
        kept = F.when(kind == k, pattern).otherwise(kept)
    seed = F.concat(F.lit(f"{key}/0/"), kind)
    image = lambda parts: F.transform(parts, lambda p: permuted(p, seed))
    parts = _let(
        F.split(core, kept, -1),
        lambda x: _without_fixed_points(x, image, _turned, lambda z: F.forall(z, lambda p: _may_stay(p, seed)), max(map(len, _ALPHABETS))),
    )
    joined = F.array_join(
        F.zip_with(parts, F.regexp_extract_all(core, kept, F.lit(0)), lambda p, k: F.concat(p, F.coalesce(k, F.lit("")))), ""
    )
    checked = _let(joined, lambda x: F.when(kind == "card", _checked(x, _luhn(core))).when(kind == "iban", _account_checked(x, core)).otherwise(x))
    own = _let(checked, lambda x: F.when(kind.isin(*_LAID_OUT), _laid_out(entity, x)).otherwise(x))
    return F.when(kind.isNull(), entity).when(kind == "ip", _octets(entity, seed)).when(kind == "private_key", _private_key(entity, seed)).otherwise(own)


def detect(text: Column) -> Column:
    """All entities of a text in order, as an array of strings; null for null."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def find_entities(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """doc_id, kind, entity, surrogate of every entity."""
    found = docs.select("doc_id", F.explode(detect(F.col("text"))).alias("entity")).withColumn("kind", kind_of(F.col("entity"))).filter("kind is not null")
    return found.select("doc_id", "kind", "entity", surrogate(F.col("entity"), F.col("kind"), key).alias("surrogate"))


def surrogate_collisions(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """kind, surrogate, n_entities of surrogates that different entities of the corpus share (case aside)."""
    own = find_entities(docs, key).select("kind", F.lower("entity").alias("entity"), F.lower("surrogate").alias("surrogate")).distinct()
    return own.groupBy("kind", "surrogate").agg(F.count("*").alias("n_entities")).filter("n_entities > 1")


def replace_entities(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """The input's columns with surrogates in ``text``, and pii_kinds, pii_distinct, surrogates_distinct.

    A text without entities costs one search.  ``n_chars``, if there, follows the text.
    """
    text = F.col("text")
    held = f"_pii_{uuid.uuid4().hex}"
    found = docs.withColumn(held, F.coalesce(detect(text), F.array().cast("array<string>")))
    made = F.transform(held, lambda e: _let(kind_of(e), lambda k: F.struct(k.alias("kind"), e.alias("entity"), surrogate(e, k, key).alias("surrogate"))))
    found = found.withColumn(held, F.when(F.size(held) > 0, made).otherwise(F.array().cast("array<struct<kind:string,entity:string,surrogate:string>>")))
    between = F.split(text, ANY, -1)
    joined = F.zip_with(between, F.col(held), lambda b, e: F.concat(b, F.coalesce(e["surrogate"], F.lit(""))))
    new = F.when(F.size(held) > 0, F.array_join(joined, "")).otherwise(text)
    real = F.filter(held, lambda e: e["kind"].isNotNull())
    own = F.size(F.array_distinct(F.transform(real, lambda e: F.struct(e["kind"], e["entity"]))))
    theirs = F.size(F.array_distinct(F.transform(real, lambda e: F.struct(e["kind"], e["surrogate"]))))
    kinds = F.transform(real, lambda e: e["kind"])
    own_names = ("pii_kinds", "pii_distinct", "surrogates_distinct")
    columns = {c: F.col(f"`{c}`") for c in docs.columns if c not in own_names} | {"text": new}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.size(held) > 0, F.char_length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[v.alias(k) for k, v in columns.items()], kinds.alias("pii_kinds"), own.alias("pii_distinct"), (own == theirs).alias("surrogates_distinct"))
