"""PII: keyed surrogates that keep type, script, gender and format.

Entities are found by one regular expression, in one pass over each text: e-mail addresses, IPv4 and IPv6 addresses,
phone numbers, payment cards, social security numbers, IBANs, dates of birth, street addresses and personal names (after
a title, after words that announce a name, or a known given name before a surname); then, in documents that hold a full
name, its parts where they stand alone. Each entity has a canonical form (an address in lower case, a number's digits, a
name's given name and surname apart), and the canonical form, not its spelling, gets the surrogate: so every mention of
it, in any spelling and any document, gets the same. Surrogates are drawn from HMAC-SHA256, under the key, of type,
canonical form and attempt; digits become digits, letters letters of their script, a card number that passes the Luhn
test another that does, country codes stay, names keep case and gender. A given name has one gender in the corpus, that
of all titles and lists it is found with; one that is found with both, or with none, gets a neutral surrogate.

Distinctness is checked, not hoped for: a surrogate that another canonical form of the type has taken, or that is itself
found in the corpus, is drawn again with the next attempt, until none is left. From attempt GROW on surrogates have more
characters than their form, so a format with too few values comes to an end as well. The checks are aggregations over
distinct canonical forms, a loop of a pass or two.

Native: DataFrame functions alone. The one pass writes each row to the shared folder with a number of its own, the text
cut at its entities; rows without entities are then passed on, the others are joined by their number with a map of
their own entities. No pattern repeats a group without bound, so texts of any length are matched in constant stack.

The key has no default: who holds it can undo the surrogates by trying names.

Defined results: null texts stay null, empty ones empty; a text of any length is read whole; rows that share a doc_id (or
have none) are rows of their own; repeated rows come out equal; other columns, whatever their names, come out as they were, but for
one named like ``count``, which is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Where the queries and the pipeline find the key.
KEY_CONF = "spark.sluiceway.pii.key"
GROW = 12

# Given names and titles by gender. A surname may follow any of them.
FEMALE = "Alice Anna Barbara Camille Carmen Catherine Claudia Emily Emma Helga Ingrid Isabel Jane Jennifer Julia Karen Laura Linda Lucia Maria Marie Mary Monika Patricia Sarah Sophie Susan Ursula Анна Елена Мария Наталья Ольга Татьяна".split()
MALE = "Ahmed Andrew Antonio Carlos Charles Daniel David Diego Edward François Georg Hans Henri James Jean John Juan Jürgen Klaus Louis Manuel Michael Miguel Paul Pedro Peter Pierre Robert Thomas William Wolfgang Александр Андрей Дмитрий Иван Михаил Сергей".split()
FEMALE_TITLES = "Mrs Ms Miss Frau Madame Mme Señora Sra Госпожа".split()
MALE_TITLES = "Mr Herr Monsieur Señor Sr Господин".split()
OTHER_TITLES = ["Dr", "Prof"]
#: Words after which one to three capitalised words are a name.
CUES = ["My name is", "my name is", "Name:", "name:", "Sincerely, ", "Regards, ", "Signed, ", "signed by", "Mein Name ist", "mein Name ist", "Je m'appelle", "je m'appelle", "Me llamo", "me llamo", "Меня зовут", "меня зовут"]
BORN = ["born on", "born", "date of birth:", "Date of birth:", "DOB:", "geboren am", "geb\\.", "né le", "née le", "nacido el", "nacida el"]
STREETS = "Street St Avenue Ave Road Rd Boulevard Blvd Lane Ln Drive Court Square".split()

_NAME = r"\p{Lu}\p{L}{1,39}+(?:-\p{Lu}\p{L}{1,39}+)?"
_TITLES = "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)
_GIVEN = "|".join(FEMALE + MALE)
_CUES = "|".join(c.strip() for c in CUES)
_BORN = "|".join(BORN)
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})"
_H = "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: (type, what its first character is, pattern), the first that fits at a place wins.
TYPES = [
    ("email", "", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?=\.[\p{L}\p{N}])[\p{L}\p{N}.-]*[\p{L}\p{N}]"),
    ("ipv6", "[0-9A-Fa-f]", rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{2,6}}(?::{_H}){{1,5}}|{_H}:(?::{_H}){{2,6}})(?![\p{{L}}\p{{N}}:])"),
    ("ip", r"\d", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"),
    ("birth", r"\d", rf"(?<=(?<![\p{{L}}\p{{N}}])(?:{_BORN}) ){_DATE}(?!\d)"),
    ("phone", r"[+(\d]", r"\+\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d|\.\d)|(?<!\d)(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)"),
    ("ssn", r"\d", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"\d", r"(?<![\d.])\d{4}([ -]?)\d{4}\g\d{4}\g\d{1,7}(?!\d)"),
    ("address", r"\d", rf"(?<![\p{{L}}\p{{N}}])\d{{1,5}} (?:\p{{Lu}}\p{{Ll}}{{1,29}}+ ){{1,3}}?(?:{'|'.join(STREETS)})\b"),
    ("iban", "[A-Z]", r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("name", r"\p{Lu}", rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLES})\.? (?:{_NAME} )?{_NAME}|(?:{_GIVEN}) {_NAME}|(?<=(?:{_CUES}) ){_NAME}(?: {_NAME}){{0,2}})(?![\p{{L}}\p{{N}}])"),
]


def _joined() -> str:
    """All patterns as one; each has a back reference of its own number. A place where no entity begins costs a look or two."""
    out, group = [], 0
    for _, first, p in TYPES:
        if r"\g" in p:
            group += 1
            p = p.replace(r"\g", rf"\{group}")
        out.append(f"(?={first})(?:{p})" if first else f"(?:{p})")
    return rf"(?:(?<![\p{{L}}\p{{N}}])|(?=[+(\d]))(?=[\p{{L}}\p{{N}}._%+(-])(?:{'|'.join(out)})"


PATTERN = _joined()
GROUPED = PATTERN.replace(r"\1", r"\2")
DIGITS = ("phone", "ssn", "card")
CONSONANTS, VOWELS = "bdfgklmnprstvz", "aeiou"
CYRILLIC_CONSONANTS, CYRILLIC_VOWELS = "бвгдзклмнпрст", "аеиоу"


def key_of(spark: SparkSession) -> str:
    """The key of the queries: KEY_CONF; without it a public one, which hides nothing from anyone and is for tests alone."""
    found = spark.conf.get(KEY_CONF, None)
    if not found:
        warnings.warn(f"{KEY_CONF} is not set: surrogates are drawn with a key that is public", stacklevel=2)
    return found or "public test key"


def every_second(parts: Column) -> Column:
    """The entities of a cut text."""
    return F.filter(parts, lambda x, i: i % 2 == 1)


def type_of(surface: Column) -> Column:
    """The type of a mention. What stands before it is not known here, so that a type's own look back is left out."""
    out = F.lit("name")
    for name, _, p in reversed(TYPES[:-1]):
        p = _DATE if name == "birth" else p
        out = F.when(F.rlike(surface, F.lit("^(?:" + p.replace(r"\g", r"\1") + ")$")), F.lit(name)).otherwise(out)
    return out


def _cyrillic(x: Column) -> Column:
    return F.rlike(x, F.lit(r"\p{IsCyrillic}"))


def name_parts(surface: Column) -> Column:
    """The given names (or null), surname and gender (f, m or u) of a name's mention."""
    title = F.regexp_extract(surface, rf"^({_TITLES})\.? ", 1)
    rest = F.regexp_replace(surface, rf"^(?:{_TITLES})\.? ", "")
    size = F.size(F.split(rest, " "))
    given = F.when(size > 1, F.regexp_extract(rest, "^(.*) [^ ]*$", 1))
    first = F.substring_index(rest, " ", 1)
    sex = F.when(title.isin(FEMALE_TITLES) | (first.isin(FEMALE) & (size > 1)), "f").when(title.isin(MALE_TITLES) | (first.isin(MALE) & (size > 1)), "m").otherwise("u")
    return F.struct(given.alias("given"), F.substring_index(rest, " ", -1).alias("surname"), sex.alias("sex"))


def _stem(surname: Column) -> Column:
    """A Slavic surname without its feminine ending."""
    low = F.lower(surname)
    return F.when(_cyrillic(surname), F.regexp_replace(low, "(?<=[вн])а$", "")).otherwise(low)


def canonical(kind: Column, surface: Column) -> Column:
    """(kind, canon, sex) of the parts of a mention that get surrogates."""
    p = name_parts(surface)
    part = lambda kind, canon, sex: F.struct(kind.alias("kind"), canon.alias("canon"), sex.alias("sex"))
    none = F.lit("u")
    given = part(F.lit("given"), F.lower(p["given"]), p["sex"])
    last = part(F.lit("surname"), _stem(p["surname"]), none)
    names = F.when(p["given"].isNull(), F.array(last)).otherwise(F.array(given, last))
    digits = F.concat(F.when(F.startswith(surface, F.lit("+")), F.lit("+")).otherwise(F.lit("")), F.regexp_replace(surface, "[^0-9]", ""))
    plain = F.when(kind.isin(*DIGITS), digits).when(kind == "iban", F.replace(surface, F.lit(" "), F.lit(""))).otherwise(F.lower(surface))
    return F.when(kind == "name", names).otherwise(F.array(part(kind, plain, none)))


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal digits."""
    import hashlib

    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in raw.ljust(64, b"\0")).hex()))
    inner = F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def _draw(hexes: Column, i: Column, n: int) -> Column:
    """The i-th number below n of a stream of hex digits; the stream repeats after 32 numbers."""
    return (F.conv(F.substr(hexes, (i % 32) * 4 + F.lit(1), F.lit(4)), 16, 10).cast("int") % n).cast("int")


def _pick(letters: str, hexes: Column, i: Column) -> Column:
    return F.substr(F.lit(letters), _draw(hexes, i, len(letters)) + 1, F.lit(1))


def _letters(x: Column, hexes: Column) -> Column:
    """Each letter another of its script and each digit another digit; the rest as it is. x is in lower case."""
    cyr = "".join(chr(c) for c in range(0x430, 0x450))
    def one(c, i):
        return (
            F.when(F.rlike(c, F.lit("[0-9]")), _pick("0123456789", hexes, i)).when(F.rlike(c, F.lit(r"\p{IsCyrillic}")), _pick(cyr, hexes, i))
            .when(F.rlike(c, F.lit(r"\p{L}")), _pick("abcdefghijklmnopqrstuvwxyz", hexes, i)).otherwise(c)
        )
    return F.array_join(F.transform(F.split(x, ""), one), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a number's digits, a multiple of ten for valid ones."""
    def one(c, i):
        d = c.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, x: a + x)


def _word(hexes: Column, length: Column, cons: str, vows: str) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when(i % 2 == 0, _pick(cons, hexes, i)).otherwise(_pick(vows, hexes, i))), "")


def surrogate(kind: Column, canon: Column, sex: Column, attempt: Column, key: str) -> Column:
    """The candidate of an attempt for a canonical form."""
    seed = F.concat_ws("|", kind, canon, attempt.cast("string"))
    hexes = F.concat(hmac(key, seed), hmac(key, F.concat(seed, F.lit("|"))))
    drawn = lambda text, start: F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when((i >= start) & F.rlike(c, F.lit("[0-9]")), _pick("0123456789", hexes, i)).otherwise(c)), "")
    plus = F.startswith(canon, F.lit("+"))
    bare = F.replace(canon, F.lit("+"), F.lit(""))
    keep = F.when(~plus, 0).when(F.rlike(bare, F.lit("^[17]")), 1).otherwise(2)
    phone = F.concat(F.when(plus, F.lit("+")).otherwise(F.lit("")), drawn(bare, keep))
    body = drawn(F.substr(canon, F.lit(1), F.length(canon) - 1), 0)
    check = ((10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.when(luhn(canon) % 10 == 0, F.concat(body, check)).otherwise(drawn(canon, 0))
    ip = F.concat_ws(".", *[(_draw(hexes, F.lit(i), 254) + 1).cast("string") for i in range(4)])
    ipv6 = F.concat_ws(":", F.lit("fd00"), *[F.substr(hexes, F.lit(4 * i + 1), F.lit(4)) for i in range(7)])
    day = F.date_add(F.lit("1940-01-01").cast("date"), _draw(hexes, F.lit(0), 25_000))
    birth = F.when(F.rlike(canon, F.lit("^\\d{4}-")), F.date_format(day, "yyyy-MM-dd")).otherwise(F.when(F.contains(canon, F.lit("/")), F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy")))
    number, street = F.substring_index(canon, " ", 1), F.substring_index(canon, " ", -1)
    address = F.concat_ws(" ", F.regexp_replace(drawn(number, 0), "^0", "1"), F.initcap(_word(hexes, F.lit(6) + _draw(hexes, F.lit(30), 4), CONSONANTS, VOWELS)), F.initcap(street))
    iban = F.concat(F.substr(canon, F.lit(1), F.lit(2)), F.upper(_letters(F.lower(F.substr(canon, F.lit(3), F.length(canon))), hexes)))
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    email = F.concat(_letters(local, hexes), F.lit("@"), _word(hmac(key, F.concat(F.lit("domain|"), domain)), F.lit(8), CONSONANTS, VOWELS), F.lit(".example."), F.when(F.rlike(domain, F.lit(r"\.(com|net|org)$")), F.substring_index(domain, ".", -1)).otherwise(F.lit("com")))
    cyr, size = _cyrillic(canon), F.lit(4) + _draw(hexes, F.lit(31), 3) + F.least(attempt, F.lit(6))
    ending = lambda f, m, u, last: F.when(kind == "surname", F.lit(last)).when(sex == "f", F.lit(f)).when(sex == "m", F.lit(m)).otherwise(F.lit(u))
    latin_name = F.concat(_word(hexes, size, CONSONANTS, VOWELS), ending("na", "ron", "li", "sk"))
    slavic_name = F.concat(_word(hexes, size, CYRILLIC_CONSONANTS, CYRILLIC_VOWELS), ending("на", "мир", "ли", "нов"))
    more = F.when(attempt >= GROW, _letters(F.repeat(F.lit("0"), attempt - (GROW - 1)), hexes)).otherwise(F.lit(""))
    out = (
        F.when(kind == "email", F.concat(more, email)).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "phone", F.concat(phone, more)).when(kind == "card", F.concat(card, more)).when(kind == "ssn", F.concat(drawn(canon, 0), more))
        .when(kind == "birth", F.concat(birth, more)).when(kind == "address", address).when(kind == "iban", F.concat(iban, more)).when(cyr, slavic_name).otherwise(latin_name)
    )
    return out


def assign(spark, forms: DataFrame, key: str) -> DataFrame:
    """(kind, canon, cand): a surrogate for each distinct canonical form (kind, canon, sex), distinct within its kind and none of the corpus's own."""
    now, path = C.write_out(spark, forms.select("kind", "canon", "sex", F.lit(0).alias("attempt"), surrogate(F.col("kind"), F.col("canon"), F.col("sex"), F.lit(0), key).alias("cand")), "pii")
    while True:
        rank = now.groupBy("kind", "cand").agg(F.min(F.struct("attempt", "canon")).alias("first"))
        real = now.select("kind", F.col("canon").alias("cand"), F.lit(True).alias("real"))
        judged = now.join(rank, ["kind", "cand"]).join(real, ["kind", "cand"], "left")
        lost = (F.col("first.canon") != F.col("canon")) | F.coalesce("real", F.lit(False))
        judged = judged.select("kind", "canon", "sex", "attempt", "cand", lost.alias("lost"))
        if not judged.where("lost").limit(1).count():
            return now.select("kind", "canon", "cand")
        again = F.col("attempt") + F.when(F.col("lost"), 1).otherwise(0)
        step = judged.select("kind", "canon", "sex", again.cast("int").alias("attempt"), F.when(F.col("lost"), surrogate(F.col("kind"), F.col("canon"), F.col("sex"), again, key)).otherwise(F.col("cand")).alias("cand"))
        now, new = C.write_out(spark, step, "pii")
        C.drop_path(spark, path)
        path = new


def _cased(word: Column, like: Column) -> Column:
    """word in the case of like: upper if like has no lower-case letter, capitalised if like begins with a capital."""
    return F.when((F.upper(like) == like) & (F.lower(like) != like) & (F.length(like) > 1), F.upper(word)).when(F.rlike(like, F.lit(r"^\p{Lu}")), F.initcap(word)).otherwise(word)


def _digits_into(surface: Column, digits: Column) -> Column:
    """The surface with its digits replaced in order."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    def step(acc, c):
        is_digit = F.rlike(c, F.lit("[0-9]"))
        n = acc["n"] + F.when(is_digit, 1).otherwise(0)
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substr(digits, n, F.lit(1))).otherwise(c)).alias("out"), n.alias("n"))
    return F.aggregate(F.split(surface, ""), zero, step, lambda a: a["out"])


def replacements(spark, surfaces: DataFrame, key: str) -> DataFrame:
    """(surface, new, given, surname) for each distinct mention; the last two are (word, surrogate) of a name's parts, else null."""
    known, _ = C.write_out(spark, surfaces.select("surface", type_of(F.col("surface")).alias("type")).withColumn("part", F.explode(canonical(F.col("type"), F.col("surface")))).select("surface", "type", "part.*"), "pii-forms")
    # One gender for a given name; one that is met with both is neutral.
    sexes = F.collect_set(F.when(F.col("sex") != "u", F.col("sex")))
    forms = known.groupBy("kind", "canon").agg(F.when(F.size(sexes) == 1, F.element_at(sexes, 1)).otherwise(F.lit("u")).alias("sex"))
    chosen = assign(spark, forms, key)
    got = known.join(chosen, ["kind", "canon"]).groupBy("surface", "type").agg(F.max(F.when(F.col("kind") == "given", F.col("cand"))).alias("first"), F.max(F.when(F.col("kind") != "given", F.col("cand"))).alias("cand"))
    s, p = F.col("surface"), name_parts(F.col("surface"))
    bare = F.replace(F.col("cand"), F.lit("+"), F.lit(""))
    ending = F.when(_cyrillic(p["surname"]) & F.rlike(p["surname"], F.lit("(?<=[вн])а$")), F.lit("а")).otherwise(F.lit(""))
    title = F.regexp_extract(s, rf"^(?:{_TITLES})\.? ", 0)
    given, last = _cased(F.col("first"), p["given"]), _cased(F.concat("cand", ending), p["surname"])
    name = F.concat(title, F.when(F.col("first").isNotNull(), F.concat(given, F.lit(" "))).otherwise(F.lit("")), last)
    new = F.when(F.col("type").isin(*DIGITS), _digits_into(s, bare)).when(F.col("type") == "iban", _spaced(s, F.col("cand"))).when(F.col("type") == "name", name).when(F.col("type") == "email", _cased_mail(F.col("cand"), s)).otherwise(F.col("cand"))
    full = (F.col("type") == "name") & F.col("first").isNotNull()
    pair = lambda a, b: F.when(full, F.struct(a.alias("word"), b.alias("new")))
    return got.select("surface", new.alias("new"), pair(p["given"], given).alias("given"), pair(p["surname"], last).alias("surname"))


def _cased_mail(word: Column, like: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.lower(like) != like), F.upper(word)).otherwise(word)


def _spaced(surface: Column, new: Column) -> Column:
    """new with spaces where the surface has them."""
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    def step(acc, c):
        n = acc["n"] + F.when(c == " ", 0).otherwise(1)
        return F.struct(F.concat(acc["out"], F.when(c == " ", c).otherwise(F.substr(new, n, F.lit(1)))).alias("out"), n.alias("n"))
    whole = F.aggregate(F.split(surface, ""), zero, step, lambda a: F.struct(a["out"].alias("out"), a["n"].alias("n")))
    return F.concat(whole["out"], F.substr(new, whole["n"] + 1, F.length(new)))


def _alone(text: Column, names: Column) -> Column:
    """text with the words of names (word, new) replaced where they stand alone."""
    def step(acc, x):
        word = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), x["word"], F.lit(r"\E(?![\p{L}\p{N}])"))
        return F.when(F.contains(acc, x["word"]), F.regexp_replace(acc, word, x["new"])).otherwise(acc)
    return F.aggregate(names, text, step)


def pseudonymise(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """docs with surrogates for the entities of ``text``; ``count`` names a column for their number (parts of names that stand alone aside)."""
    spark = docs.sparkSession
    plain = docs.drop(count) if count else docs
    row, parts = C.fresh(plain, "row"), C.fresh(plain, "parts")
    read = plain.withColumn(parts, C.cut(F.col("text"), PATTERN, GROUPED))
    some = F.size(parts) > 1
    tagged = read.select(F.monotonically_increasing_id().alias(row), *[F.when(~F.coalesce(some, F.lit(False)), F.col("text")).alias("text") if c == "text" else F.col(c) for c in plain.columns], F.when(some, F.col(parts)).alias(parts))
    tagged, _ = C.write_out(spark, tagged, "pii-cut")
    own = tagged.where(F.col(parts).isNotNull())
    found, _ = C.write_out(spark, own.select(F.col(row).alias("row"), F.explode(F.array_distinct(every_second(F.col(parts)))).alias("surface")), "pii-found")
    new, _ = C.write_out(spark, replacements(spark, found.select("surface").distinct(), key), "pii-new")
    one = F.struct("surface", "new")
    maps = found.join(new, "surface").groupBy("row").agg(F.map_from_entries(F.collect_list(one)).alias("map"), F.array_sort(F.concat(F.collect_set("surname"), F.collect_set("given"))).alias("names"))
    key_, map_, names = C.fresh(plain, "key"), C.fresh(plain, "map"), C.fresh(plain, "names")
    maps = maps.select(F.col("row").alias(key_), F.col("map").alias(map_), F.col("names").alias(names))
    joined = own.join(maps, F.col(row) == F.col(key_))
    done = F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.element_at(map_, x)).otherwise(F.when(F.size(names) > 0, _alone(x, F.col(names))).otherwise(x)))
    n = lambda x: [x.cast("long").alias(count)] if count else []
    out = joined.select(*[F.array_join(done, "").alias("text") if c == "text" else F.col(c) for c in plain.columns], *n(F.size(every_second(F.col(parts)))))
    return tagged.where(F.col(parts).isNull()).select(*plain.columns, *n(F.lit(0))).unionByName(out)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(C.wide(docs), key_of(spark), count="n_entities")
