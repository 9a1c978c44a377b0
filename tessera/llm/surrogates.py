"""Surrogates for personal data, in DataFrame functions only.

Detection finds e-mail addresses, telephone numbers, payment cards, IPv4 addresses, US social
security numbers, IBANs, secrets (long hexadecimal strings, access keys) and personal names: after a
title, after words that introduce a name, before an address in brackets, or beginning with a listed
given name. In a text that has a name, its words are also found where they stand alone.

Normal forms. A value is normalised before it is replaced (letters in lower case, numbers without
their separators, calling codes apart), and the match's own separators and capitals are put back
after, so one value has one surrogate however it is written (coreference), in all documents.

Draws. The surrogate is a keyed permutation of the values of one kind and format: a Feistel network
over the characters, each within its own class (digits; vowels and consonants of a script), whose
rounds are HMAC-SHA-512, around a shift that no value survives unchanged. Equal lengths, scripts and
separators follow, and two values never get one surrogate, whatever the size of the corpus: the collision
check is part of the construction, and no table of values is gathered. Where an image would leave its
own format it is permuted again until it is in it (cycle walking): a surname keeps a Slavic
ending and its gender, an unlisted given name its last letter and never becomes a listed one.
Listed given names are permuted among those of their gender and script. Cards keep the first digit and
pass the Luhn test if the value does, IBANs keep the country and get valid check digits, addresses
keep the top-level domain (followed by `.example`) and IPv4 addresses the first two octets. Values in
other scripts become a keyed digest.

The key is the caller's. It travels in the rows of a one-row table, read by a scalar subquery, so it
stands neither in plans nor in event logs.

What is not found: names that are neither listed nor introduced by anything above, names in scripts
without capitals, and numbers of other kinds than those listed.

Defined cases: null text stays null, empty text empty; n_entities is 0 for both; an empty table
gives no rows. Repeated rows get equal results; extra columns are passed on; a column named n_entities
is replaced, in any case of letters. At equal starts the kinds' order in KINDS decides. The longest
texts are worked on whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, table, without

#: Titles, words before names, particles within names, and given names by gender.
TITLES = "Mrs Ms Miss Mr Dr Prof Frau Herr Madame Mme Mlle Monsieur Señora Señorita Señor Sra Srta Sr Doña Signora Signor Госпожа Господин".split()
CUES = ("my name is ", "My name is ", "name is ", "Name: ", "name: ", "From: ", "Author: ", "Contact: ", "Patient: ", "Customer: ", "Signed: ", "signed by ", "written by ", "Dear ", "Regards,\n", "regards,\n", "Sincerely,\n", "ich heiße ", "Ich heiße ", "mein Name ist ", "Mein Name ist ", "Liebe ", "Lieber ", "je m'appelle ", "Je m'appelle ", "me llamo ", "Me llamo ", "mi nombre es ", "Mi nombre es ", "меня зовут ", "Меня зовут ")
PARTICLES = "van von der den de del della di da dos la le bin ibn al".split()
FEMALE_NAMES = (
    "Mary Anna Maria Elizabeth Jennifer Linda Susan Sarah Karen Emma Olivia Julia Laura Claudia Sabine Sophie Camille Isabelle Carmen Lucía Patricia Barbara Jessica Nancy Lisa Margaret Sandra Ashley Kimberly Emily Donna "
    "Michelle Amanda Melissa Deborah Stephanie Rebecca Ursula Petra Monika Heike Katharina Ingrid Nathalie Françoise Chantal Amélie Pilar Dolores Marta Elena Fatima Aisha Priya Ananya Lakshmi Mei Yuki Sakura Ngozi"
).split()
MALE_NAMES = (
    "James John Robert Michael William David Thomas Daniel Peter Paul Hans Klaus Stefan Pierre Antoine Jean Carlos José Miguel Javier Richard Joseph Charles Christopher Matthew Anthony Steven Andrew Kenneth Kevin Brian George Bill "
    "Timothy Ronald Jason Edward Jeffrey Jürgen Wolfgang Dieter Matthias Andreas Philippe Nicolas François Laurent Juan Pedro Fernando Alejandro Mohammed Ahmed Omar Raj Satya Sundar Arjun Wei Hiroshi Kenji Chukwu"
).split()
CYRILLIC_FEMALE, CYRILLIC_MALE = "Мария Анна Елена Ольга Татьяна Наталья Ирина Светлана".split(), "Иван Сергей Алексей Дмитрий Владимир Андрей Николай Михаил".split()
#: Classes of characters that replace one another; characters in none stay as they are.
CLASSES = ("0123456789", "bcdfghjklmnpqrstvwxyz", "aeiou", "áéíóú", "àèìòù", "âêîôû", "äöü", "бвгджзйклмнпрстфхцчшщ", "аеиоуыэюя", "βγδζθκλμνξπρστφχψ", "αεηιουω", "άέήίόύώ")
HEX_DIGITS = ("0123456789abcdef",)
KEY_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Calling codes of one and two digits; all others have three.
CALLING_CODE = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Endings of surnames that show gender.
SURNAME_ENDING = r"(?:ов|ев|ёв|ин|ын)а?$|[сц]к(?:ий|ая|ой)$|(?:ov|ev)(?:a|á)?$|[sc]k(?:i|y|a|á|ý|aya|aia)$"

_WORD = r"\p{Lu}[\p{L}'’-]+"
_PART = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}"
_FULL = rf"{_WORD}(?: \p{{Lu}}\.)?(?: {_PART}{_WORD})?"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}](?:[\p{L}\p{N}-]*+\.)+\p{L}{2,}"
HEX = r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\p{N}])"
ACCESS_KEY = r"(?<![\p{L}\p{N}_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pos]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,48})(?![\p{L}\p{N}])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d.]*\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"
#: Marks put around matches; a text that holds one of them is split the slow way.
OPEN, CLOSE = "﷐", "﷑"
KEY_HEAD = r"^(?:AKIA|ASIA|gh[pos]_|sk-)"
#: How often an image outside its format is permuted again; one in thousands is, so this is never reached.
WALK = 24
CONF = "spark.tessera.surrogates.secret"


def name_pattern(given: Iterable[str]) -> str:
    introduced = rf"(?:{'|'.join(TITLES)})\.? {_FULL}|(?<={'|'.join(CUES)}){_FULL}|{_WORD}(?: {_PART}{_WORD}){{1,2}}(?= ?[<(][^<>()@\s]{{1,64}}@)"
    return rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:{introduced}|(?:{'|'.join(given)})(?: \p{{Lu}}\.)? {_PART}{_WORD})"


def detectors(given: Iterable[str]) -> dict[str, tuple[str, str]]:
    """Each kind's pattern, and a cheap one that finds something in every text in which the first does."""
    given = list(given)
    return {
        "email": (EMAIL, "@"),
        "hex": (HEX, r"[0-9]|[a-f]{32}|[A-F]{32}"),
        "access_key": (ACCESS_KEY, "AKIA|ASIA|gh[pos]_|sk-"),
        "iban": (IBAN, "[0-9]"),
        "ip": (IPV4, "[0-9]"),
        "ssn": (SSN, "[0-9]"),
        "phone": (PHONE, "[0-9]"),
        "card": (CARD, "[0-9]"),
        "name": (name_pattern(given), name_pattern(given)),  # hundreds of words without an anchor would take longer
    }


KINDS = tuple(detectors(()))
LISTED = (FEMALE_NAMES, MALE_NAMES, CYRILLIC_FEMALE, CYRILLIC_MALE)


def all_given(extra: dict[str, Iterable[str]] | None = None) -> list[list[str]]:
    """The listed names by gender and script; extra may add female and male ones."""
    extra = extra or {}
    return [sorted({*own, *extra.get(gender, ())}) for own, gender in zip(LISTED, ("female", "male", "cyrillic_female", "cyrillic_male"))]


def key_ring(spark: SparkSession, key: bytes, given: list[list[str]]) -> Column:
    """A struct of both pads of HMAC-SHA-512 and the permutation of the listed names, read from a one-row table."""
    block = (hashlib.sha512(key).digest() if len(key) > 128 else key).ljust(128, b"\0")
    names = {}
    for group in given:
        order = sorted((n.lower() for n in group), key=lambda n: hmac.digest(key, f"listed:{n}".encode(), "sha512"))
        names |= dict(zip(order, order[1:] + order[:1]))
    row = (bytearray(b ^ 0x36 for b in block), bytearray(b ^ 0x5C for b in block), names)
    rows = spark.createDataFrame([(row,)], "ring struct<inner:binary,outer:binary,names:map<string,string>>")
    return rows.scalar()


def digest(ring: Column, message: Column) -> Column:
    """HMAC-SHA-512 of a string, in 128 hexadecimal digits."""
    inside = F.unhex(F.sha2(F.concat(ring["inner"], message.cast("binary")), 512))
    return F.sha2(F.concat(ring["outer"], inside), 512)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


#: The steps of a permutation: half of the places (2: the shift of the first) and sign.
STEPS = ((0, 1), (1, 1), (2, 1), (1, -1), (0, -1))


def permuted(ring: Column, tweak: Column, x: Column, n: Column) -> Column:
    """x, numbers below n at each place (places of n below 2 stay), permuted; never x itself if any place can change.

    Places are split by their distance from the first that can change. Two rounds add to the one half a
    digest of the other, then the first place is shifted, and the rounds are undone.
    """

    def of(a: Column) -> Column:
        steps = F.array(*[F.struct(F.lit(half).alias("half"), F.lit(sign).alias("sign")) for half, sign in STEPS])
        at = a["first"]

        def turn(x: Column, step: Column) -> Column:
            half = step["half"]
            own = lambda i: F.when(half == 2, i == at).otherwise(F.pmod(i - at, F.lit(2)) == half)
            other = F.array_join(F.transform(x, lambda v, i: F.when((half == 2) | own(i), "").otherwise(v.cast("string"))), ",")

            def add(h: Column) -> Column:
                drawn = lambda i: F.conv(F.substr(h, F.pmod(i * 4, F.lit(125)) + 1, F.lit(4)), 16, 10).cast("int")
                moved = lambda v, i, n: F.pmod(v + F.when(half == 2, 1 + F.pmod(drawn(i), n - 1)).otherwise(step["sign"] * drawn(i)), n)
                return F.transform(x, lambda v, i: F.when(own(i) & (F.get(a["n"], i) > 1), moved(v, i, F.get(a["n"], i))).otherwise(v))

            return let(digest(ring, F.concat_ws(":", a["tweak"], half, other)), add)

        return F.when(at < 0, a["x"]).otherwise(F.aggregate(steps, a["x"], turn))

    first = (F.array_position(F.transform(n, lambda k: k > 1), True) - 1).cast("int")
    return let(F.struct(x.alias("x"), n.alias("n"), first.alias("first"), tweak.alias("tweak")), of)


#: The alphabets in one string, and for each of its characters where its class begins and how large it is.
ALPHABETS = {"text": CLASSES, "hex": HEX_DIGITS, "key": KEY_CLASSES}
LETTERS = "".join("".join(c) for c in ALPHABETS.values())


def class_bounds() -> tuple[list[int], list[int]]:
    starts, counts, at = [], [], 0
    for classes in ALPHABETS.values():
        for c in classes:
            starts += [at] * len(c)
            counts += [len(c)] * len(c)
            at += len(c)
    return starts, counts


STARTS, COUNTS = class_bounds()


def permuted_text(ring: Column, tweak: Column, value: Column, alphabet: Column) -> Column:
    """value with each character permuted within its class of an alphabet."""
    starts, counts = F.array(*map(F.lit, STARTS)), F.array(*map(F.lit, COUNTS))

    def placed(c: Column) -> Column:
        out, at = None, 0
        for name, classes in ALPHABETS.items():
            size = sum(map(len, classes))
            place = F.position(c, F.lit("".join(classes))).cast("int")
            case = F.when(place > 0, place + at - 1)
            out = F.when(alphabet == name, case) if out is None else out.when(alphabet == name, case)
            at += size
        return out

    def of(v: Column) -> Column:
        def put(p: Column) -> Column:
            x = F.transform(p, lambda k: F.coalesce(k - F.get(starts, k), F.lit(0)))
            n = F.transform(p, lambda k: F.coalesce(F.get(counts, k), F.lit(0)))
            return let(permuted(ring, tweak, x, n), lambda y: F.array_join(F.transform(v, lambda c, i: F.coalesce(F.substr(F.lit(LETTERS), F.get(starts, F.get(p, i)) + F.get(y, i) + 1, F.lit(1)), c)), ""))

        return let(F.transform(v, placed), put)

    return let(chars(value), of)


#: A letter that no class has a replacement for, in a script of its own.
FOREIGN = r"[\p{L}&&[^\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]]"
KNOWN = f"[{''.join(CLASSES)}]"


def recased(match: Column, surrogate: Column) -> Column:
    """surrogate (in lower case) with match's capitals; by place where lengths are equal."""

    def of(s: Column) -> Column:
        by_place = F.array_join(F.transform(chars(match), lambda c, i: let(F.substr(s, i + 1, F.lit(1)), lambda d: F.when(c == F.lower(c), d).otherwise(F.upper(d)))), "")
        shout = (match == F.upper(match)) & (F.length(match) > 1)
        return F.when(match == F.lower(match), s).when(F.length(match) == F.length(s), by_place).when(shout, F.upper(s)).otherwise(F.initcap(s))

    return let(surrogate, of)


def reset(match: Column, surrogate: Column) -> Column:
    """match with its digits and letters replaced by the surrogate's, in order; letters are capitals, as in account codes."""

    def of(s: Column) -> Column:
        def put(a: Column, c: Column) -> Column:
            own = c.rlike(r"[0-9\p{L}]")
            return F.struct((a["at"] + F.when(own, 1).otherwise(0)).alias("at"), F.concat(a["out"], F.when(own, F.substr(s, a["at"] + 1, F.lit(1))).otherwise(c)).alias("out"))

        return F.aggregate(chars(match), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda a: F.upper(a["out"]))

    return let(surrogate, of)


def luhn(digits: Column) -> Column:
    """The Luhn sum of digits, modulo 10."""
    doubled = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    return F.pmod(F.aggregate(F.transform(F.reverse(chars(digits)), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 1, doubled(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, d: a + d), F.lit(10))


def mod97(code: Column) -> Column:
    """The remainder of an account code (lower case, no blanks) with its first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substr(code, F.lit(5)), F.substr(code, F.lit(1), F.lit(4)))
    numbers = F.array_join(F.transform(chars(turned), lambda c: F.when(c.rlike("[a-z]"), (F.ascii(c) - 87).cast("string")).otherwise(c)), "")
    return F.aggregate(chars(numbers), F.lit(0), lambda a, c: F.pmod(a * 10 + c.cast("int"), F.lit(97)))


def kind_of(m: Column) -> Column:
    """The kind of a match; an account code with wrong check digits is an account."""
    bare = F.lower(F.replace(m, F.lit(" "), F.lit("")))
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), "hex")
        .when(m.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pos]_[0-9A-Za-z]{36}$|^sk-[0-9A-Za-z]{20,48}$"), "access_key")
        .when(m.rlike(r"^[A-Z]{2}\d{2}[ 0-9A-Z]+$"), F.when(mod97(bare) == 1, "iban").otherwise("account"))
        .when(m.rlike(r"^\p{L}"), "name")
        .when(m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^\d") & (F.length(F.regexp_replace(m, r"[^0-9]", "")) >= 13), "card")
        .otherwise("phone")
    )


def name_words(m: Column) -> Column:
    """The words of a name as structs of kind (given, surname, or none for titles, particles and initials) and value."""
    parts = F.split(m, " ")
    fixed = lambda w, i: ((i == 0) & w.rlike(rf"^(?:{'|'.join(TITLES)})\.?$")) | w.rlike(rf"^(?:{'|'.join(PARTICLES)}|\p{{Lu}}\.)$")
    last = F.size(parts) - 1
    return F.transform(parts, lambda w, i: F.struct(F.when(fixed(w, i), F.lit(None)).when(i == last, F.lit("surname")).otherwise(F.lit("given")).alias("kind"), w.alias("value")))


PART = "struct<mode:string,tweak:string,value:string,alphabet:string>"


def part(mode: str, tweak: Column | str, value: Column, alphabet: str = "text") -> Column:
    """What is permuted as one: mode says what stays and what its image must be."""
    return F.struct(F.lit(mode).alias("mode"), (F.lit(tweak) if isinstance(tweak, str) else tweak).alias("tweak"), value.alias("value"), F.lit(alphabet).alias("alphabet")).cast(PART)


def drawn(ring: Column, p: Column) -> Column:
    """The image of a part.

    Modes: number (all of it), word (all of it; a digest in other scripts), given and surname (words; a listed
    given name becomes another of its group, others keep their last letter and become no listed one; a
    surname keeps its ending), account (keeps the country, and stays wrong), fixed (stays).
    """
    mode, value = p["mode"], p["value"]
    ending = lambda v: let(F.regexp_extract(v, SURNAME_ENDING, 0), lambda e: F.when(F.length(v) - F.length(e) > 1, F.length(e)).otherwise(0))
    head = F.when(mode == "account", 2).otherwise(0)

    # What stays is the value's own in every step, else the steps would not permute.
    tail = F.when(mode == "given", 1).when(mode == "surname", ending(value)).otherwise(0)

    def step(v: Column, t: Column) -> Column:
        middle = permuted_text(ring, p["tweak"], F.substr(v, head + 1, F.length(v) - head - t), p["alphabet"])
        return F.concat(F.substr(v, F.lit(1), head), middle, F.substr(v, F.length(v) - t + 1, t))

    def fits(v: Column) -> Column:
        tails = lambda v: F.right(v, ending(v))
        return F.when(mode == "given", F.element_at(ring["names"], v).isNull()).when(mode == "surname", tails(v) == tails(value)).when(mode == "account", mod97(v) != 1).otherwise(True)

    other = F.concat(F.lit("x"), F.substr(digest(ring, F.concat_ws(":", p["tweak"], value)), F.lit(1), F.lit(24)))
    foreign = mode.isin("word", "given", "surname") & (value.rlike(FOREIGN) | ~value.rlike(KNOWN))
    walk = let(tail, lambda t: F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), value, lambda v, i: F.when((i > 0) & fits(v), v).otherwise(step(v, t))))
    listed = F.when(mode == "given", F.element_at(ring["names"], value))
    return F.when(mode == "fixed", value).otherwise(F.coalesce(listed, F.when(foreign, other).otherwise(walk)))


def split_up(kind: Column, m: Column, given_here: Column) -> Column:
    """The parts of a match by its kind; given_here are the text's given names, for words that stand alone."""
    low = F.lower(m)
    digits = F.regexp_replace(m, r"[^0-9]", "")
    bare = F.replace(low, F.lit(" "), F.lit(""))
    domain = F.substring_index(low, "@", -1)
    labels = F.regexp_replace(domain, r"\.[^.]*$", "")
    octet = lambda i: F.regexp_extract(m, r"^\d+\.\d+\.(\d+)\.(\d+)$", i).cast("int")
    head = F.regexp_extract(m, KEY_HEAD, 0)
    code = calling_code(m)
    word = lambda a: F.when(a["kind"].isNull(), part("fixed", "", a["value"])).when((a["kind"] == "given") | (~m.contains(" ") & F.array_contains(given_here, low)), part("given", "given", F.lower(a["value"]))).otherwise(part("surname", "surname", F.lower(a["value"])))
    return (
        F.when(kind == "email", F.array(part("word", F.concat(F.lit("local@"), domain), F.substring_index(low, "@", 1)), part("word", "domain", labels)))
        .when(kind == "name", F.transform(name_words(m), word))
        .when(kind == "ip", F.array(part("number", F.concat(F.lit("ip"), F.substring_index(m, ".", 2)), F.lpad(F.lower(F.hex(octet(1) * 256 + octet(2))), 4, "0"), "hex")))
        .when(kind == "hex", F.array(part("number", "hex", low, "hex")))
        .when(kind == "access_key", F.array(part("number", head, F.substr(m, F.length(head) + 1), "key")))
        .when(kind == "card", F.array(part("number", F.concat(F.lit("card"), F.left(digits, F.lit(1))), F.substr(digits, F.lit(2), F.length(digits) - 2))))
        .when(kind == "iban", F.array(part("number", F.concat(F.lit("iban"), F.left(bare, F.lit(2))), F.substr(bare, F.lit(5)))))
        .when(kind == "account", F.array(part("account", "account", bare)))
        .when(kind == "ssn", F.array(part("number", "ssn", digits)))
        .otherwise(F.array(part("number", F.concat(F.lit("phone+"), code), F.substr(digits, F.length(code) + 1))))
    )


def calling_code(m: Column) -> Column:
    return F.when(m.startswith("+"), F.regexp_extract(F.regexp_replace(m, r"[^0-9]", ""), CALLING_CODE, 0)).otherwise("")


def put_together(kind: Column, m: Column, new: Column) -> Column:
    """A match with the images of its parts in place."""
    low, digits = F.lower(m), F.regexp_replace(m, r"[^0-9]", "")
    one = F.get(new, 0)
    number = F.conv(one, 16, 10).cast("int")
    stem = F.concat(F.left(digits, F.lit(1)), one)
    # The last digit of a card is as far from the right one as the value's is: right stays right.
    last = F.pmod(luhn(digits) - luhn(F.concat(stem, F.lit("0"))), F.lit(10)).cast("string")
    country = F.left(low, F.lit(2))
    checked = F.concat(country, F.lpad((98 - mod97(F.concat(country, F.lit("00"), one))).cast("string"), 2, "0"), one)
    numbers = F.when(kind == "card", F.concat(stem, last)).when(kind == "iban", checked).when(kind == "phone", F.concat(calling_code(m), one)).otherwise(one)
    words = F.when(kind == "email", F.array(F.substring_index(m, "@", 1))).otherwise(F.split(m, " "))
    cased = F.array_join(F.transform(words, lambda w, i: recased(w, F.get(new, i))), " ")
    return (
        F.when(kind == "name", cased)
        .when(kind == "email", F.concat(cased, F.lit("@"), F.get(new, 1), F.lit("."), F.substring_index(low, ".", -1), F.lit(".example")))
        .when(kind == "ip", F.concat_ws(".", F.substring_index(m, ".", 2), F.shiftright(number, 8), F.pmod(number, F.lit(256))))
        .when(kind == "hex", F.when(m == low, one).otherwise(F.upper(one)))
        .when(kind == "access_key", F.concat(F.regexp_extract(m, KEY_HEAD, 0), one))
        .otherwise(reset(m, numbers))
    )


def surrogate(ring: Column, m: Column, given_here: Column) -> Column:
    """The replacement of a match."""

    def of(kind: Column) -> Column:
        return let(F.transform(split_up(kind, m, given_here), lambda p: drawn(ring, p)), lambda new: put_together(kind, m, new))

    return let(kind_of(m), of)


def pieces(text: Column, pattern: Column | str) -> Column:
    """text cut into what is not matched (even places from 0) and what is (odd places), in one pass."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]", -1)
    between = F.split(text, pattern, -1)
    slow = F.flatten(F.zip_with(between, F.regexp_extract_all(text, pattern, F.lit(0)), lambda p, m: F.filter(F.array(p, m), lambda x: x.isNotNull())))
    return F.when(text.rlike(f"[{OPEN}{CLOSE}]"), slow).otherwise(marked)


def matches_in(parts: Column) -> Column:
    return F.filter(parts, lambda x, i: F.pmod(i, F.lit(2)) == 1)


def session_key(spark: SparkSession) -> bytes:
    """The session's key: that of the setting CONF, whose name Spark's interfaces redact, else a random one for this session."""
    own = spark.conf.get(CONF, None)
    if own is None:
        own = secrets.token_hex(32)
        spark.conf.set(CONF, own)
    return own.encode()


def pseudonymise(docs: DataFrame, key: bytes | None = None, text: str = "text", given_names: dict[str, Iterable[str]] | None = None) -> DataFrame:
    """docs with personal data in text replaced, and n_entities, the number of replacements.

    key: at least 16 bytes; without one the session's. given_names adds names to the lists, by gender.
    One pass over the texts, without a shuffle.
    """
    spark = docs.sparkSession
    key = session_key(spark) if key is None else key
    if len(key) < 16:
        raise ValueError("a key has 16 bytes or more")
    given = all_given(given_names)
    found = detectors(n for group in given for n in group)
    pattern, name = "|".join(p for p, _ in found.values()), found["name"][1]
    cheap = "|".join(dict.fromkeys(h for k, (_, h) in found.items() if k != "name"))
    df = without(docs, ["n_entities"])
    ring, parts, words = fresh(df, "ring"), fresh(df, "parts"), fresh(df, "words")
    t = F.col(f"`{text}`")
    df = df.withColumn(ring, key_ring(spark, key, given))
    df = df.withColumn(parts, F.when(t.rlike(cheap) | t.rlike(name), pieces(t, pattern)).otherwise(F.array(t)))
    # The names of the text, whose words are then looked for alone.
    named = F.flatten(F.transform(F.filter(matches_in(F.col(parts)), lambda m: kind_of(m) == "name"), name_words))
    own = F.array_distinct(F.filter(named, lambda a: a["kind"].isNotNull() & (F.length(a["value"]) > 2)))
    df = df.withColumn(words, F.when(F.size(parts) > 1, own))
    alone = F.concat(F.lit(pattern + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(words, lambda a: a["value"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    df = df.withColumn(parts, F.when(F.size(words) > 0, pieces(t, alone)).otherwise(F.col(parts)))
    given_here = F.transform(F.filter(F.coalesce(words, F.array()), lambda a: a["kind"] == "given"), lambda a: F.lower(a["value"]))
    new = F.array_join(F.transform(parts, lambda p, i: F.when(F.pmod(i, F.lit(2)) == 1, surrogate(F.col(ring), p, given_here)).otherwise(p)), "")
    df = df.withColumn("n_entities", F.when(F.size(parts) > 1, F.shiftright(F.size(parts), 1)).otherwise(0).cast("long"))
    return df.withColumn(text, F.when(F.size(parts) > 1, new).otherwise(t)).drop(ring, parts, words)


def query(spark, sf_dir):
    """op1: documents with personal data replaced by surrogates."""
    return pseudonymise(table(spark, sf_dir, "documents", "doc_id", "text"))
