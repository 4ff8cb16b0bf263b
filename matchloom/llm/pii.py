"""Surrogates for personal data, in DataFrame operations only.

Entities are found by one pattern of the types below.  A mention's canonical
form (an e-mail address or a hex secret in lower case, a number's digits, a
name's words in lower case) is hashed with a key, and the hash makes a
surrogate of the same type and format: as many digits in the same places, a
card number that passes the check digit test exactly if the true one does,
octets of an address, a local part of the same letters, digits and marks.
Equal canonical forms get equal surrogates in all documents (coreference).

A name is two entities, its family name (by script) and its given name (by
gender and script), so "Mr Smith", "John Smith" and "Dr John Smith" agree in what
they share.  Names are found by a title, by a listed given name, or by a cue
("my name is", "signed by"); a word in capitals stays in capitals.

Distinctness: all distinct canonical forms of the table are gathered as rows;
where two of one type share a surrogate, or a surrogate is a true entity of the
table, all but the least are hashed again with the next attempt, until none is
left.  A round works on the rows that are still open only, and there is always
room for them: each attempt adds a syllable to a family name (16 times the names
before) and a letter to an e-mail address, and from attempt ``WIDE`` on, where
a format has no more values to give, it adds a syllable to a given name and a
digit behind anything else.  Only the entities with an attempt above 0 need a
look-up when texts are rewritten; they are joined by row, salted.

Null texts stay null, empty ones empty; a text without entities is unchanged;
an empty table gives an empty result.  Repeated rows and equal texts get equal
surrogates; texts of any length are rewritten whole; of entities that tie for a
surrogate the least canonical form keeps it.  Other columns pass as they are.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, tables, written

# Titles and given names by gender, which mark a name's gender and script.
TITLES = {"m": ["Mr", "Herr", "Señor", "Monsieur", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Госпожа"], "x": ["Dr", "Prof"]}
GIVEN = {
    ("latin", "m"): ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Hans", "Karl", "Pierre", "Jean", "Louis", "Carlos", "Miguel", "Javier", "Paul", "George", "Daniel", "Richard", "Joseph", "Charles", "Mohammed", "Ahmed", "Wei", "Antonio", "Marco", "Stefan", "Klaus", "Juan", "Luis", "Pedro"],
    ("latin", "f"): ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Anna", "Greta", "Ursula", "Marie", "Claire", "Sophie", "Lucia", "Carmen", "Isabel", "Maria", "María", "Laura", "Julia", "Emma", "Emily", "Jessica", "Barbara", "Margaret", "Fatima", "Sofia", "Elena", "Monika", "Sabine", "Ana", "Camille"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Алексей", "Дмитрий", "Сергей", "Николай", "Андрей", "Михаил"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"],
}
#: Syllables of invented family names, by script.
SYLLABLES = {
    "latin": ["ba", "del", "gor", "han", "kel", "lom", "mar", "nev", "por", "ran", "sel", "tam", "vin", "wes", "zan", "fer"],
    "cyrillic": ["ба", "дел", "гор", "хан", "кел", "лом", "мар", "нев", "пор", "ран", "сел", "там", "вин", "вес", "зан", "фер"],
}

#: The attempt from which a surrogate may leave its mention's format by more digits.
WIDE = 8
#: Parts that the look-up of a hot entity is dealt into.
SALT = 16

LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAMED = "|".join([*(t for v in TITLES.values() for t in v)])
_GIVEN = "|".join(n for v in GIVEN.values() for n in v)
_CUE = "(?:[Nn]ame is|[Nn]ame:|[Ss]igned by|[Cc]ontact:) "
#: Fixed card shapes, which a number behind them leaves alone: unbroken, and an issuer's first digits in the usual groups.
_CARD = r"(?:\d{13,19}|(?:[3-6]\d|2[2-7])\d{2}(?:[ -]\d{4}){3}(?:[ -]\d{3})?|3\d{3}[ -]\d{6}[ -]\d{4,5}|[56]\d{5}[ -]\d{13})(?!\d)"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "secret": r"(?<![\p{L}\p{N}])(?:[0-9A-Fa-f]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": rf"(?<![\d+])(?:{_CARD}|\d(?:[ -]?\d){{12,18}}(?![ -]?\d))",
    "phone": r"(?<![\d+])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])(?:\d[-. ])?\d{3}[-. ]\d{3}[-. ]\d{4}(?![\d-])|(?=0)(?<=(?:[Tt]el|[Pp]hone|[Cc]all|[Ff]ax|[Mm]obile)[.:]{0,2} {0,2})0\d{1,4}(?:[ -]\d{3,4}){1,3}(?!\d)",
    "name": rf"(?=\p{{Lu}})(?:(?<![\p{{L}}\p{{N}}])(?:(?:{_NAMED})\.? (?:\p{{Lu}}[\p{{L}}'-]+)(?: \p{{Lu}}[\p{{L}}'-]+)?|(?:{_GIVEN}) \p{{Lu}}[\p{{L}}'-]+)|(?<={_CUE})\p{{Lu}}[\p{{L}}'-]+ \p{{Lu}}[\p{{L}}'-]+)",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must have for any pattern to match: cheap to look for.
HINT = rf"\d|@|(?=\p{{Lu}})(?<!\p{{L}})(?:{_NAMED}|{_GIVEN})[. ]|{_CUE}|AKIA|gh[pousr]_|sk-|[A-Fa-f]{{32}}"


def kind_of(m: Column) -> Column:
    """The type of a mention that PATTERN found."""
    found = F.when(m.contains("@"), "email")
    for kind in ("secret", "iban", "ip", "ssn"):
        found = found.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    found = found.when(m.rlike(f"^(?:{PATTERNS['card']})$"), "card")
    return found.when(m.rlike(r"^[+\d(]"), "phone").otherwise("name")


def _body(m: Column) -> Column:
    """A name without its title, as words."""
    return F.split(F.regexp_replace(m, rf"^(?:{_NAMED})\.? ", ""), " ")


def parts(kind: Column, m: Column) -> Column:
    """The entities of a mention as an array of struct(kind, canon): one, or a family name and the given name before it."""
    digits = F.regexp_replace(m, r"\D", "")
    plain = F.when(kind.isin("card", "phone", "ssn"), digits).when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).when((kind == "email") | m.rlike("^[0-9A-Fa-f]{32,}$"), F.lower(m)).otherwise(m)
    one = lambda k, canon: F.struct(F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), canon.alias("canon"))
    words = _body(m)
    family = one("family", F.concat(_script(m), F.lit(":"), F.lower(F.element_at(words, -1))))
    given = one("given", F.concat(_gender(m), F.lit(":"), _script(m), F.lit(":"), F.lower(words[0])))
    return F.when(kind != "name", F.array(one(kind, plain))).when(F.size(words) > 1, F.array(family, given)).otherwise(F.array(family))


def _gender(m: Column) -> Column:
    starts = lambda words: m.rlike(rf"^(?:{'|'.join(words)})[. ]")
    given = {g: [n for (_, k), v in GIVEN.items() if k == g for n in v] for g in "mf"}
    has = lambda words: m.rlike(rf"(?:^| )(?:{'|'.join(words)}) ")
    return F.when(starts(TITLES["m"]), "m").when(starts(TITLES["f"]), "f").when(has(given["m"]), "m").when(has(given["f"]), "f").otherwise("x")


def _script(m: Column) -> Column:
    return F.when(m.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _hash(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 hex digits, and the attempt behind them."""
    base = lambda side: F.sha2(F.concat_ws("|", F.lit(key), F.lit(side), kind, attempt.cast("string"), canon), 256)
    return F.concat(base("a"), base("b"), attempt.cast("string"))


def _nibbles(h: Column, i: Column, n: int) -> Column:
    """A number from ``n`` hex digits of the hash, by position."""
    return F.conv(F.substr(h, (F.pmod(i * F.lit(n), F.lit(128 - n)) + 1).cast("int"), F.lit(n)), 16, 10).cast("int")


def _digits_at(h: Column, n: Column) -> Column:
    """An array of n digits."""
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.pmod(_nibbles(h, i, 3), F.lit(10)))


def _luhn(digits: Column) -> Column:
    """The check digit sum, from the right, of an array of digits."""
    twice = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    parts = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 1, twice(d)).otherwise(d))
    return F.aggregate(parts, F.lit(0), lambda a, d: a + d)


def _to_digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: c.cast("int"))


def surrogate(key: str, kind: Column, canon: Column, h: Column) -> Column:
    """The surrogate of a canonical form, canonical itself; ``h``: its ``_hash``, a column of its own."""
    made = _digits_at(h, F.length(canon))
    joined = lambda a: F.array_join(F.transform(a, lambda d: d.cast("string")), "")
    # the brand digit stays, the check digit passes the test only if the true one does
    body = F.concat(F.slice(_to_digits(canon), 1, 1), F.slice(made, 2, F.greatest(F.length(canon) - 2, F.lit(0))))
    check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(body, F.array(F.lit(0)))), F.lit(10)), F.lit(10))
    off = F.when(F.pmod(_luhn(_to_digits(canon)), F.lit(10)) == 0, 0).otherwise(1 + F.pmod(_nibbles(h, F.lit(40), 2), F.lit(9)))
    card = F.concat(joined(body), F.pmod(check + off, F.lit(10)).cast("string"))
    # a phone number's first two digits (its region) stay
    phone = F.concat(F.substr(canon, F.lit(1), F.lit(2)), F.substr(joined(made), F.lit(3)))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + F.pmod(_nibbles(h, i, 4), F.lit(254))).cast("string")), ".")
    domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index(canon, "@", -1)), 256)
    letter = lambda i, alphabet: F.substr(F.lit(alphabet), 1 + F.pmod(_nibbles(h, i, 3), F.lit(len(alphabet))), F.lit(1))
    local = F.transform(
        F.filter(F.split(F.substring_index(canon, "@", 1), ""), lambda c: c != ""),
        lambda c, i: F.when(c.rlike(r"\p{N}"), F.pmod(_nibbles(h, i, 3), F.lit(10)).cast("string")).when(c.rlike(r"\p{IsCyrillic}"), letter(i, CYRILLIC)).when(c.rlike(r"\p{L}"), letter(i, LATIN)).otherwise(c),
    )
    attempt = F.substr(h, F.lit(129)).cast("int")
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: letter(i + 11, LATIN)), "")
    email = F.concat(F.array_join(local, ""), F.when(attempt > 0, more).otherwise(""), F.lit("@d"), F.substr(domain, F.lit(1), F.lit(8)), F.lit(".example.org"))
    wider = F.when(attempt < WIDE, F.lit("")).otherwise(F.concat(F.when(kind == "ip", "-").otherwise(""), joined(F.transform(F.sequence(F.lit(WIDE), F.greatest(attempt, F.lit(WIDE))), lambda i: F.pmod(_nibbles(h, i + 23, 3), F.lit(10))))))
    chars = F.transform(
        F.filter(F.split(canon, ""), lambda c: c != ""),
        lambda c, i: F.when(c.rlike("[0-9]"), F.pmod(_nibbles(h, i, 3), F.lit(10)).cast("string"))
        .when(kind == "secret", F.when(c.rlike("[a-f]"), F.substr(F.lit("abcdef"), 1 + F.pmod(_nibbles(h, i, 3), F.lit(6)), F.lit(1))).when(c.rlike("[A-Z]"), F.char(65 + F.pmod(_nibbles(h, i, 3), F.lit(26)))).when(c.rlike("[a-z]"), F.char(97 + F.pmod(_nibbles(h, i, 3), F.lit(26)))).otherwise(c))
        .when(i < 2, c)
        .when(c.rlike("[A-Z]"), F.char(65 + F.pmod(_nibbles(h, i, 3), F.lit(26))))
        .otherwise(c),
    )
    same = (
        F.when(kind == "ip", octets)
        .when(kind == "card", card)
        .when(kind == "phone", phone)
        .when(kind == "ssn", joined(made))
        .otherwise(F.array_join(chars, ""))
    )
    return F.when(kind == "email", email).when(kind == "family", _family(h, canon)).when(kind == "given", _given(h, canon)).otherwise(F.concat(same, wider))


def _pick(h: Column, words: list[str], i) -> Column:
    return F.element_at(F.array(*[F.lit(w.lower()) for w in words]), 1 + F.pmod(_nibbles(h, F.lit(i) if isinstance(i, int) else i, 4), F.lit(len(words))))


def _syllables(h: Column, script: Column, n: Column) -> Column:
    """n syllables; none for n = 0."""
    made = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(script == "cyrillic", _pick(h, SYLLABLES["cyrillic"], i)).otherwise(_pick(h, SYLLABLES["latin"], i)))
    return F.when(n > 0, F.array_join(made, "")).otherwise("")


def _family(h: Column, canon: Column) -> Column:
    script = F.split(canon, ":")[0]
    return F.concat(script, F.lit(":"), _syllables(h, script, 3 + F.substr(h, F.lit(129)).cast("int")))


def _given(h: Column, canon: Column) -> Column:
    gender, script = F.split(canon, ":")[0], F.split(canon, ":")[1]
    first = F.lit(None).cast("string")
    for s in ("latin", "cyrillic"):
        for g, names in (("m", GIVEN[s, "m"]), ("f", GIVEN[s, "f"]), ("x", GIVEN[s, "m"] + GIVEN[s, "f"])):
            first = F.when((script == s) & (gender == g), _pick(h, names, 0)).otherwise(first)
    return F.concat(gender, F.lit(":"), script, F.lit(":"), first, _syllables(h, script, F.substr(h, F.lit(129)).cast("int") - (WIDE - 1)))


def render(kind: Column, mention: Column, mades: Column) -> Column:
    """The canonical surrogates of a mention's entities in its own format."""
    made = mades[0]
    # the surrogate's digits (or characters) take the places that the mention's have; a wider one's stand behind
    into = F.aggregate(
        F.filter(F.split(mention, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(c.rlike("[0-9A-Z]"), F.struct(F.concat(a["out"], F.substr(made, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
        lambda a: F.concat(a["out"], F.when(a["at"] <= F.length(made), F.concat(F.lit("-"), F.substr(made, a["at"]))).otherwise("")),
    )
    # a secret's letters, one by one, in the case of the mention's
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    cased = F.array_join(F.zip_with(chars(mention), chars(made), lambda m, c: F.when(m.rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    title = F.regexp_extract(mention, rf"^((?:{_NAMED})\.? )", 1)
    words = _body(mention)
    like = lambda w, x: F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(x)).otherwise(F.initcap(x))
    family = like(F.element_at(words, -1), F.substring_index(made, ":", -1))
    given = F.when(F.size(words) > 1, F.concat(like(words[0], F.substring_index(F.get(mades, F.lit(1)), ":", -1)), F.lit(" "))).otherwise("")
    return (
        F.when(kind.isin("card", "phone", "ssn", "iban"), into)
        .when(kind == "name", F.concat(title, given, family))
        .when(kind == "secret", cased)
        .when((kind == "email") & (mention == F.upper(mention)), F.upper(made))
        .otherwise(made)
    )


def _mentions(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _parts_of(mentions: DataFrame, *keep: str) -> DataFrame:
    """Rows (``keep``, kind, canon) of rows with a ``mention``, which may hold two entities."""
    m = mentions.select(*keep, "mention", kind_of(F.col("mention")).alias("of"))
    return m.select(*keep, F.explode(parts(F.col("of"), F.col("mention"))).alias("e")).select(*keep, "e.kind", "e.canon")


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct (kind, canon) of the whole table, with the number of mentions."""
    m = docs.select(F.explode(_mentions(F.col(text_col))).alias("mention"))
    return _parts_of(m).groupBy("kind", "canon").agg(F.count(F.lit(1)).alias("mentions"))


def attempts(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities that attempt 0 leaves in collision."""
    with tables() as keep:
        true = written(found.select("kind", F.col("canon").alias("made")), "pii-true")
        open_ = true.select("kind", F.col("made").alias("canon"), F.lit(0).alias("attempt"))
        settled: list[DataFrame] = []
        while True:
            h = _hash(key, F.col("kind"), F.col("canon"), F.col("attempt"))
            tried = written(open_.withColumn("h", h).withColumn("made", surrogate(key, F.col("kind"), F.col("canon"), F.col("h"))).drop("h"), "pii-tried")
            best = tried.groupBy("kind", "made").agg(F.min("canon").alias("canon"), F.min("attempt").alias("attempt"))
            for taken in (true, *settled):
                best = best.join(taken.select("kind", "made"), ["kind", "made"], "left_anti")
            settled.append(written(best.select("kind", "canon", "attempt", "made"), "pii-settled"))
            lost = written(tried.join(settled[-1].select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), "pii-lost")
            discard(tried)
            if lost.isEmpty():
                break
            open_ = lost
        again = functools.reduce(DataFrame.unionByName, settled[1:]) if settled[1:] else settled[0].limit(0)
        return keep(written(again.select("kind", "canon", "attempt"), "pii-exceptions"))


def replace(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text_col``, all columns kept; ``count_col``: also the number of mentions."""
    exceptions = attempts(entities(docs, text_col), key)
    text = F.col(text_col)
    rows = docs.withColumn("__mentions", _mentions(text))
    # one step an array, so that no expression holds another one twice
    rows = rows.withColumn("__found", F.transform("__mentions", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))))
    rows = rows.withColumn("__found", F.transform("__found", lambda e: F.struct(e["m"].alias("m"), e["kind"].alias("kind"), parts(e["kind"], e["m"]).alias("parts"))))
    if exceptions.isEmpty():
        attempt = lambda p: F.lit(0)
    else:
        # the exceptions of each row that has any, by the row's text; an entity that many texts hold is dealt by salt
        by_text = F.xxhash64(text)
        held = _parts_of(docs.select(by_text.alias("__h"), F.explode(_mentions(text)).alias("mention")), "__h").distinct()
        salted = exceptions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        held = held.withColumn("salt", F.pmod("__h", F.lit(SALT)).cast("int")).join(salted, ["kind", "canon", "salt"])
        held = written(held.groupBy("__h").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("__again")), "pii-rows")
        rows = rows.withColumn("__h", by_text).join(held, "__h", "left")
        attempt = lambda p: F.coalesce(F.try_element_at(F.col("__again"), F.concat_ws("|", p["kind"], p["canon"])), F.lit(0))
    each = lambda step: F.transform("__found", lambda e: F.struct(e["m"].alias("m"), e["kind"].alias("kind"), F.transform(e["parts"], step).alias("parts")))
    rows = rows.withColumn("__found", each(lambda p: F.struct(p["kind"].alias("kind"), p["canon"].alias("canon"), _hash(key, p["kind"], p["canon"], attempt(p)).alias("h"))))
    rows = rows.withColumn("__found", each(lambda p: surrogate(key, p["kind"], p["canon"], p["h"])))
    made = F.transform("__found", lambda e: render(e["kind"], e["m"], e["parts"]))
    pieces = F.split(text, PATTERN, -1)
    new = F.when(F.size("__mentions") > 0, F.array_join(F.flatten(F.zip_with(pieces, made, lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")).otherwise(text)
    out = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*out, *([F.size("__mentions").cast("long").alias(count_col)] if count_col else []))
