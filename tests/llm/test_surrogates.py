"""Surrogates against a version in plain Python, and what they promise: one for each value, none for two."""

import hmac
import random

import pytest
import regex
from pyspark.sql import functions as F

from tessera.llm import surrogates as sg

KEY = b"a key of the test, not of the source"


def digest(message):
    return hmac.new(KEY, message.encode(), "sha512").hexdigest()


def permute(tweak, x, n):
    """Two half rounds, a shift of the first place that can change, and the rounds undone."""
    places = [i for i, k in enumerate(n) if k > 1]
    if not places:
        return x
    first, x = places[0], list(x)

    def turn(half, sign):
        own = {i for i in range(len(x)) if (i - first) % 2 == half}
        h = digest(f"{tweak}:{half}:" + ",".join("" if i in own else str(v) for i, v in enumerate(x)))
        for i in own:
            if n[i] > 1:
                x[i] = (x[i] + sign * int(h[i * 4 % 125 :][:4], 16)) % n[i]

    turn(0, 1), turn(1, 1)
    h = digest(f"{tweak}:2:" + "," * (len(x) - 1))
    x[first] = (x[first] + 1 + int(h[first * 4 % 125 :][:4], 16) % (n[first] - 1)) % n[first]
    turn(1, -1), turn(0, -1)
    return x


def permute_text(tweak, value, classes):
    own = [next((c for c in classes if ch in c), "") for ch in value]
    y = permute(tweak, [c.index(ch) if c else 0 for ch, c in zip(value, own)], [len(c) for c in own])
    return "".join(c[v] if c else ch for ch, c, v in zip(value, own, y))


def listed():
    out = {}
    for group in sg.all_given():
        order = sorted((n.lower() for n in group), key=lambda n: hmac.digest(KEY, f"listed:{n}".encode(), "sha512"))
        out |= {n: order[(i + 1) % len(order)] for i, n in enumerate(order)}
    return out


NAMES = listed()


def word(tweak, value, image):
    letters = [c for c in value if c.isalpha()]
    foreign = any(not regex.match(r"[\p{Latin}\p{Cyrillic}\p{Greek}]", c) for c in letters)
    known = any(c in k for c in value for k in sg.CLASSES)
    return image(value) if known and not foreign else "x" + digest(f"{tweak}:{value}")[:24]


def ending(v):
    m = regex.search(sg.SURNAME_ENDING, v)
    return m[0] if m and len(v) - len(m[0]) > 1 else ""


def given(v):
    def image(v):
        for _ in range(sg.WALK):
            v = permute_text("given", v[:-1], sg.CLASSES) + v[-1]
            if v not in NAMES:
                return v
        raise AssertionError("no image fits")

    return NAMES.get(v) or word("given", v, image)


def surname(v):
    def image(v):
        kept = ending(v)
        for _ in range(sg.WALK):
            v = permute_text("surname", v[: len(v) - len(kept)], sg.CLASSES) + kept
            if ending(v) == kept:
                return v
        raise AssertionError("no image fits")

    return word("surname", v, image)


def recase(m, s):
    if m == m.lower():
        return s
    if len(m) == len(s):
        return "".join(d if c == c.lower() else d.upper() for c, d in zip(m, s))
    return s.upper() if m == m.upper() and len(m) > 1 else s[:1].upper() + s[1:]


def reset(m, s):
    it = iter(s)
    return "".join(next(it) if c.isalpha() or c in "0123456789" else c for c in m).upper()


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10


def mod97(code):
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def is_title(w):
    return w.rstrip(".") in sg.TITLES


def name_words(m):
    parts = m.split(" ")
    for i, w in enumerate(parts):
        if (i == 0 and is_title(w)) or w in sg.PARTICLES or regex.fullmatch(r"\p{Lu}\.", w):
            yield None, w
        else:
            yield ("surname" if i == len(parts) - 1 else "given"), w


def kind_of(m):
    if "@" in m:
        return "email"
    if regex.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", m):
        return "hex"
    if regex.fullmatch(r"(AKIA|ASIA)[0-9A-Z]{16}|gh[pos]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,48}", m):
        return "key"
    if regex.fullmatch(r"[A-Z]{2}[0-9]{2}[ 0-9A-Z]+", m):
        return "iban" if mod97(m.replace(" ", "").lower()) == 1 else "account"
    if m[0].isalpha():
        return "name"
    if regex.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", m):
        return "ip"
    if regex.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
        return "ssn"
    return "card" if m[0] in "0123456789" and len(regex.sub("[^0-9]", "", m)) >= 13 else "phone"


def replace(m, given_here):
    kind, low, digits, bare = kind_of(m), m.lower(), regex.sub("[^0-9]", "", m), m.replace(" ", "").lower()
    text = lambda tweak, v: permute_text(tweak, v, sg.CLASSES)
    if kind == "email":
        local, domain = low.rsplit("@", 1)
        labels, top = domain.rsplit(".", 1)
        new = word("local@" + domain, local, lambda v: text("local@" + domain, v))
        return recase(m.split("@")[0], new) + "@" + word("domain", labels, lambda v: text("domain", v)) + f".{top}.example"
    if kind == "name":
        out = []
        for k, w in name_words(m):
            as_given = k == "given" or (" " not in m and low in given_here)
            out.append(w if k is None else recase(w, (given if as_given else surname)(w.lower())))
        return " ".join(out)
    if kind == "ip":
        a, b, c, d = m.split(".")
        n = int(permute_text(f"ip{a}.{b}", f"{int(c) * 256 + int(d):04x}", sg.HEX_DIGITS), 16)
        return f"{a}.{b}.{n // 256}.{n % 256}"
    if kind == "hex":
        new = permute_text("hex", low, sg.HEX_DIGITS)
        return new if m == low else new.upper()
    if kind == "key":
        head = regex.match("AKIA|ASIA|gh[pos]_|sk-", m)[0]
        return head + permute_text(head, m[len(head) :], sg.KEY_CLASSES)
    if kind == "card":
        stem = digits[0] + text("card" + digits[0], digits[1:-1])
        return reset(m, stem + str((luhn(digits) - luhn(stem + "0")) % 10))
    if kind == "iban":
        new = text("iban" + bare[:2], bare[4:])
        return reset(m, bare[:2] + f"{98 - mod97(bare[:2] + '00' + new):02}" + new)
    if kind == "account":
        for _ in range(sg.WALK):
            bare = bare[:2] + text("account", bare[2:])
            if mod97(bare) != 1:
                return reset(m, bare)
    if kind == "ssn":
        return reset(m, text("ssn", digits))
    code = regex.match(sg.CALLING_CODE, digits)[0] if m[0] == "+" else ""
    return reset(m, code + text("phone+" + code, digits[len(code) :]))


def python(pattern):
    """Java's digits and blanks are ASCII."""
    return pattern.replace(r"[^<>()@\s]", r"[^<>()@\t-\r ]").replace(r"[\d.]", "[0-9.]").replace(r"[\d-]", "[0-9-]").replace(r"[\d.-]", "[0-9.-]").replace(r"[\d(]", "[0-9(]").replace(r"\d", "[0-9]")


PATTERN = python("|".join(p for p, _ in sg.detectors(n for g in sg.all_given() for n in g).values()))


def brute(text):
    if text is None:
        return None, 0
    find = lambda p: list(regex.finditer(p, text))
    words = [(k, w) for m in find(PATTERN) if kind_of(m[0]) == "name" for k, w in name_words(m[0]) if k and len(w) > 2]
    spans = find(PATTERN + r"|(?<![\p{L}\p{N}])(?:" + "|".join(dict.fromkeys(w for _, w in words)) + r")(?![\p{L}\p{N}])") if words else find(PATTERN)
    given_here, out, at = {w.lower() for k, w in words if k == "given"}, [], 0
    for m in spans:
        out += [text[at : m.start()], replace(m[0], given_here)]
        at = m.end()
    return "".join(out) + text[at:], len(spans)


def run(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (r["text"], r["n_entities"]) for r in sg.pseudonymise(docs, KEY, **more).collect()}


def some(rng):
    """A random value of a random kind."""
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n, a="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(a) for _ in range(n))
    name = lambda: rng.choice([letters(rng.randrange(2, 9)).title(), "Müller", "Łukasz", "Нов" + letters(2, "аеио") + "ов", "Петрова", "O'Neil", "Smith-Jones", "KOWALSKI", "Novák", "Papadopoulos", "Αλέξης"])
    iban = lambda: (lambda c, b: f"{c}{98 - mod97(c.lower() + '00' + b.lower()):02}{b}")(rng.choice(["DE", "FR", "GB"]), digit(8) + letters(rng.randrange(0, 4), "ABCDEFGH") + digit(8))
    return rng.choice([
        lambda: letters(rng.randrange(1, 9)) + rng.choice(["", ".", "_"]) + digit(rng.randrange(3)) + "x@" + letters(4) + rng.choice([".com", ".example.de", "-mail.co.uk"]),
        lambda: "王小" + "@" + letters(5) + ".cn", lambda: "Élodie.ç@ñandú.es",
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: "999.999.1.2",
        lambda: f"+{rng.choice(['1', '49', '353'])} ({digit(3)}) 555-{digit(4)}", lambda: f"({digit(3)}) 555-{digit(4)}", lambda: f"{digit(3)}-{digit(3)}-{digit(4)}",
        lambda: digit(16), lambda: rng.choice([" ", "-"]).join(digit(4) for _ in range(4)), lambda: "4111 1111 1111 1111",
        lambda: f"{digit(3)}-{digit(2)}-{digit(4)}", iban, lambda: "DE" + digit(20), lambda: " ".join(regex.findall(".{1,4}", iban())),
        lambda: letters(40, "0123456789abcdef"), lambda: letters(32, "0123456789ABCDEF"), lambda: letters(36, "abcdef"),
        lambda: "AKIA" + letters(16, "ABCDEFGH23"), lambda: "sk-" + letters(24, "abcdefXYZ"), lambda: "ghp_" + letters(36, "abcdefGH12"),
        lambda: f"{rng.choice(sg.TITLES)}{rng.choice(['', '.'])} {name()}", lambda: f"{rng.choice(sg.TITLES)} {name()} {name()}", lambda: f"{rng.choice(sg.FEMALE_NAMES + sg.MALE_NAMES + sg.CYRILLIC_FEMALE)} {name()}",
        lambda: f"my name is {name()} J. van der {name()}", lambda: f"{name()} {name()} <{letters(4)}@{letters(4)}.org>", lambda: f"Dear {name()}",
    ])()


FIXED = [
    None, "", "Nothing of the kind: 12 3.4 version 1.2.3", "﷐ Bob@x.de ﷑ 10.2.3.4", "x " * 20_000 + "bob@corp.de", "a.b." * 30_000,
    "Mrs Maria Smith and Dr Maria Smith", "4111 1111 1111 1111, 4111-1111-1111-1111 and 4111111111111111", "Bill Gates, Satya Nadella and Wei Zhang", "999.999.1.2", "token sk-abcdefghijABCDEFGHIJ here",
    "Mrs Anna Kowalski met Emma Stone. Kowalski said that Anna left. ANNA KOWALSKI", "+1 (068) 555-7713 is +10685557713, +1 068 555 7713", "DE89 3704 0044 0532 0130 00, DE89370400440532013000",
    "Bob.Smith7@corp.example.de or bob.smith7@CORP.example.de", "FC22F42429FEF2EBDE85E081B172BC12 fc22f42429fef2ebde85e081b172bc12", "Госпожа Анна Петрова и Господин Петров",
]


def test_equal_to_plain_python(spark):
    rng = random.Random(6)
    texts = FIXED + [rng.choice([" ", "\n", ", "]).join(some(rng) if rng.random() < 0.6 else rng.choice(["and", "the Haus", "12", "Road", "—", "A"]) for _ in range(12)) for _ in range(300)]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t[:200]


def test_coreference_and_formats(spark):
    got = {t: x for t, (x, _) in zip(FIXED, run(spark, FIXED).values())}
    both = regex.fullmatch(r"Mrs (.+) and Dr (.+)", got["Mrs Maria Smith and Dr Maria Smith"])
    assert both[1] == both[2] and both[1].split()[0] in sg.FEMALE_NAMES and both[1] != "Maria Smith"
    cards = [regex.sub(r"\D", "", c) for c in regex.split(", | and ", got[FIXED[7]])]
    assert len(set(cards)) == 1 and luhn(cards[0]) == 0 and cards[0] != "4" + "1" * 15 and regex.fullmatch(r"4\d{3}( \d{4}){3}, 4\d{3}(-\d{4}){3} and 4\d{15}", got[FIXED[7]])
    assert not any(n in got[FIXED[8]] for n in ("Gates", "Nadella", "Zhang", "Bill", "Satya", "Wei"))
    assert got["999.999.1.2"] == "999.999.1.2" and "abcdefghij" not in got[FIXED[10]]
    m = regex.fullmatch(r"Mrs (\w+) (\w+) met (\w+) (\w+)\. (\w+) said that (\w+) left\. (\w+) (\w+)", got[FIXED[11]])
    assert m[2] == m[5] and m[1] == m[6] and "Kowalski" not in got[FIXED[11]]
    phones = [regex.sub(r"\D", "", x) for x in regex.split(" is |, ", got[FIXED[12]])]
    assert len(set(phones)) == 1 and phones[0][0] == "1"
    codes = [x.replace(" ", "") for x in got[FIXED[13]].split(", ")]
    assert codes[0] == codes[1] != "DE89370400440532013000" and mod97(codes[0].lower()) == 1
    m = regex.fullmatch(r"Госпожа (\w+) (\w+ова|\w+ева) и Господин (\w+)", got[FIXED[16]])
    assert m and m[1] in sg.CYRILLIC_FEMALE


def test_distinct_values_stay_distinct_and_none_stays(spark):
    """Whole small formats: their surrogates are permutations without a fixed point."""
    emails = [f"{c}@x.test" for c in "abcdefghijklmnopqrstuvwxyz0123456789"]
    names = [f"Mr {a}{b}{c}" for a in "BCD" for b in "aeiou" for c in ["ra", "ov", "rov", "ova", "ski", "n", "ñ"]]
    ips = [f"10.7.{i % 256}.{i // 256}" for i in range(0, 65_536, 13)]
    first = [f"my name is {a}{b}{c} Hill" for a in "MW" for b in "aeio" for c in ["ry", "ri", "i", "n", "rk", "ria"]]
    for values, kept in ((emails, 0), (names, 0), (ips, 0), (first, 0)):
        got = run(spark, values)
        out = [got[i][0] for i in range(len(values))]
        assert len(set(out)) == len(set(values)) and all(a != b for a, b in zip(values, out)) and all(n == 1 for _, n in got.values())


def test_each_detector_s_cheap_test_finds_its_matches():
    rng = random.Random(3)
    found = sg.detectors(n for g in sg.all_given() for n in g)
    hit = set()
    for _ in range(4000):
        t = f"{rng.choice(['', 'so ', '('])}{some(rng)}{rng.choice(['', ' end', ')'])}"
        for kind, (pattern, cheap) in found.items():
            if regex.search(python(pattern), t):
                hit.add(kind)
                assert regex.search(python(cheap), t), (kind, t)
    assert hit == set(found)


def test_key_is_not_in_the_plan_and_matters(spark):
    docs = spark.createDataFrame([(1, "bob@corp.de", "r", "p", 7)], "doc_id long, text string, ring string, parts string, N_Entities int")
    done = sg.pseudonymise(docs, KEY)
    plan = done._jdf.queryExecution().toString()
    for form in (KEY, bytes(b ^ 0x36 for b in KEY), bytes(b ^ 0x5C for b in KEY)):
        assert form.decode("latin-1") not in plan and form.hex().upper() not in plan.upper()
    row = done.first()
    assert (row["ring"], row["parts"], row["n_entities"]) == ("r", "p", 1) and "N_Entities" not in done.columns
    assert sg.pseudonymise(docs, KEY[::-1]).first()["text"] != row["text"]
    assert sg.pseudonymise(docs).first()["text"] == sg.pseudonymise(docs).first()["text"]
    assert not any("Python" in line or "Arrow" in line for line in plan.split("\n"))
    with pytest.raises(ValueError):
        sg.pseudonymise(docs, b"short")


def test_extra_names_and_odd_tables(spark):
    assert run(spark, ["Xylo Brown"]) == {0: ("Xylo Brown", 0)}
    text, n = run(spark, ["Xylo Brown"], given_names={"female": ["Xylo"]})[0]
    assert n == 1 and text.split()[0] in {*sg.FEMALE_NAMES, "Xylo"} and "Brown" not in text
    docs = spark.createDataFrame([(1, "bob@corp.de")] * 3 + [(None, "bob@corp.de")], "doc_id long, text string")
    assert sg.pseudonymise(docs, KEY).groupBy("text").agg(F.count("*").alias("n")).first()["n"] == 4
    assert sg.pseudonymise(docs.where("false"), KEY).count() == 0
