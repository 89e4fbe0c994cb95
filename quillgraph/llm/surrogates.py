"""Surrogates for personal data and secrets.

Detected entities are replaced by keyed look-alikes: digits by digits, letters
by letters of the same script and case, a card number or bank account that
passes its checksum by one that passes, an address of the net by one of the same
kind (private or public), a birth date by a date, a street by a street of the
same type, a person's name by a pronounceable one of the same length and
punctuation.  Given names keep their gender (from the title, a list of frequent
names, or the ending); surnames have none, so a person called with and without
title or given name keeps one surname, and a feminine Slavic ending is put back.
The replacement is a Feistel permutation, keyed per type, of all strings of the
entity's format, so within a format two entities hardly ever share a surrogate,
and the same entity (whatever its case or punctuation) gets the same one
everywhere: coreference needs no lookup.

Names are found by titles and by frequent given names before a capitalised word;
every other mention of a name found so in the same text is replaced with it.

A collision check over all entities of the corpus finds the surrogates that are
another entity's surrogate (formats can meet after case folding), equal a real
entity, or equal their own; those few get the next permutation of a numbered
family (names grow longer after a few attempts), and are checked again.  Only
these exceptions are looked up during the rewrite; they are broadcast after a
count and joined per document beyond it.

Edge cases: null texts stay null and empty texts empty; texts without entities
are unchanged; texts of any length are read whole; of overlapping entities the
first found stays, ties go to the longer pattern; repeated rows get equal
results; an empty table gives an empty result; other columns are kept, clashing
output names are replaced.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .tables import pieces

# Titles, frequent given names, and words that announce a secret, a birth date or a street.
MALE_TITLES = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "Господин", "Господина")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Lady", "Frau", "Señora", "Sra", "Señorita", "Srta", "Doña", "Mme", "Madame", "Mlle", "Dra", "Госпожа", "Госпожи")
OTHER_TITLES = ("Dr", "Prof", "Professor", "Doktor", "Doctor")
MALE_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Peter "
    "Hans Klaus Jürgen Wolfgang Stefan Andreas Markus Uwe Dieter Heinz Jean Pierre Michel Philippe Jacques François Luc Henri Louis Antoine "
    "José Juan Carlos Luis Miguel Pedro Javier Manuel Diego Pablo Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай Владимир Пётр"
).split()
FEMALE_NAMES = (
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Emily Laura Jane Alice Helen Rachel Julia "
    "Anna Ursula Monika Petra Sabine Claudia Gisela Renate Heike Birgit Marie Nathalie Isabelle Catherine Sophie Camille Chloé Juliette Claire Hélène "
    "María Carmen Ana Isabel Pilar Lucía Elena Teresa Rosa Marta Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия"
).split()
SECRET_CUES = ("token", "secret", "password", "passwd", "pwd", "api[_-]?key", "access[_-]?key")
BIRTH_CUES = ("born", "birth", "birthday", "dob", "geboren", "geburtsdatum", "geb\\.", "née?", "naissance", "nacid[oa]", "nacimiento", "родил(?:ся|ась)", "рождения")
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Drive", "Boulevard", "Blvd", "straße", "strasse", "weg", "platz", "gasse", "allee", "rue", "avenue", "boulevard", "chemin", "Calle", "Avenida", "Plaza", "Paseo", "улица", "ул")
PARTICLES = {"von", "van", "der", "den", "de", "del", "la", "du", "des", "zu", "di", "da", "bis"}

UP = "A-ZÀ-ÖØ-ÞЁА-Я"
NAME = rf"[{UP}][\w'’\-]*[^\W\d_]|[{UP}]\."
_cues = "|".join(SECRET_CUES)
FINDER = re.compile(
    rf"""(?P<email>(?<![\w.%+\-@])[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{{2,}})
    |(?i:\b(?:{_cues}))["']?\s*[=:]\s*(?:["'](?P<quoted>[^\s"']{{4,}})["']|(?P<token>(?=[^\s"',;]*[\d_/+\-])[^\s"',;<>]{{6,}}|[A-Za-z]{{12,}}))
    |(?<![\w])(?P<hex>[0-9a-f]{{32,64}}|[0-9A-F]{{32,64}})(?!\w)
    |(?<![\d.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d))(?!\d|\.\d)
    |(?i:\b(?:{"|".join(BIRTH_CUES)}))[^\d\n]{{0,20}}(?P<birth>\d{{4}}-\d\d-\d\d|\d{{1,2}}[./]\d{{1,2}}[./]\d{{4}})(?!\d)
    |(?<![\w+])(?P<phone>\+\d{{1,3}}[ .\-]?(?:\(\d{{1,4}}\)|\d{{1,4}})(?:[ .\-]?\d{{2,4}}){{2,4}}|\(\d{{3}}\)[ .\-]?\d{{3}}[ .\-]\d{{4}}|\d{{3}}[ .\-]\d{{3}}[ .\-]\d{{4}})(?!\w)
    |(?<![\w\-])(?P<ssn>\d{{3}}-\d{{2}}-\d{{4}})(?![\w\-])
    |(?<!\w)(?P<iban>[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?)(?!\w)
    |(?<!\w)(?P<card>\d(?:[ \-]?\d){{12,18}})(?!\w)
    |(?<!\w)(?P<street>\d{{1,5}}[ ][{UP}]\w+[ ](?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd)|[{UP}]\w*(?:straße|strasse|weg|platz|gasse|allee)[ ]\d{{1,4}}[a-z]?|\d{{1,4}},?[ ](?:bis[ ])?(?:rue|avenue|boulevard|chemin)[ ](?:(?:de[ ]la|de|du|des)[ ])?[{UP}]\w+|(?:Calle|Avenida|Plaza|Paseo)[ ](?:(?:de|del)[ ])?[{UP}]\w+,?[ ]\d{{1,4}}|(?:улица|ул\.)[ ][{UP}]\w+,?[ ](?:дом[ ]|д\.[ ]?)?\d{{1,4}})(?!\w)""",
    re.VERBOSE,
)
_digit = re.compile(r"\d")
#: Parts of every secret cue.
CUE_PARTS = ("token", "secret", "passw", "pwd", "key")


def may_match(text: str) -> bool:
    """Has the text what every match of FINDER has: a digit, an at sign or a secret's cue?"""
    if "@" in text or _digit.search(text):
        return True
    low = text.lower()
    return any(part in low for part in CUE_PARTS)


_titles = "|".join(sorted((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES), key=len, reverse=True))
_rest = rf"(?:[ ](?:{'|'.join(sorted(PARTICLES))}))*[ ](?:{NAME})"
TITLED = re.compile(rf"(?<!\w)(?P<titles>(?:(?:{_titles}|M\.)\.?[ ])+)(?P<name>(?:(?:{'|'.join(sorted(PARTICLES))})[ ])*(?:{NAME})(?:{_rest}){{0,2}})")
PAIR = re.compile(rf"(?<![\w'’\-])(?P<given>[{UP}][^\W\d_]+)(?=[ ][{UP}])(?P<more>(?:{_rest}){{1,2}})")
GENDER = {**dict.fromkeys((*MALE_TITLES, *MALE_NAMES, "M"), "m"), **dict.fromkeys((*FEMALE_TITLES, *FEMALE_NAMES), "f")}
_names = {*MALE_NAMES, *FEMALE_NAMES}
_capital = re.compile(rf"[{UP}]\w*")
_triggers = {*_names, *MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES, "M"}
KINDS = ("email", "quoted", "token", "hex", "ip", "birth", "phone", "ssn", "iban", "card", "street")
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßÿ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
PLACE = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
#: Letters that may stand for each other in a name: vowels and consonants of a script.
SOUNDS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæèéêëìíîïòóôõöøùúûü", "çðñýþßÿ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь", "αεηιουω", "βγδζθκλμνξπρστφχψ", "0123456789")
SOUND = {c: (a, i) for a in SOUNDS for i, c in enumerate(a)}
FEMININE = ("ова", "ева", "ёва", "ина", "ova", "eva")
PATRONYMS = ("ов", "ев", "ёв", "ин", "ov", "ev")
HEX = "0123456789abcdef"
ENDINGS = {("latin", "f"): "a", ("latin", "m"): "n", ("cyrillic", "f"): "а", ("cyrillic", "m"): "н"}
SYLLABLES = {"latin": ["ba", "de", "fi", "go", "lu", "ma", "ne", "ri"], "cyrillic": ["ба", "де", "фи", "го", "лу", "ма", "не", "ри"]}
#: Attempts after which a name's surrogate gets a syllable more.
TRIES = 6
FIRST_DAY, DAYS = dt.date(1900, 1, 1), 43829
PRIVATE = [(10 << 24, 24), (127 << 24, 24), ((169 << 8 | 254) << 16, 16), ((172 << 8 | 16) << 16, 20), ((192 << 8 | 168) << 16, 16)]
ROUNDS = 6


def _round(key: bytes, tweak: str, i: int, half: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}\x00{i}\x00{half}".encode(), key=key, digest_size=32).digest(), "big")


def permute(number: int, a: int, b: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..a*b-1."""
    left, right = divmod(number, b)
    for i in range(ROUNDS):
        if i % 2:
            right = (right + _round(key, tweak, i, left)) % b
        else:
            left = (left + _round(key, tweak, i, right)) % a
    return left * b + right


def _mixed(symbols: list[tuple[str, int]], key: bytes, tweak: str) -> list[str]:
    """Permute a sequence of (alphabet, place) among all sequences over the same alphabets."""
    cut = (len(symbols) + 1) // 2
    a = b = 1
    number = 0
    for k, (alphabet, place) in enumerate(symbols):
        number = number * len(alphabet) + place
        if k < cut:
            a *= len(alphabet)
        else:
            b *= len(alphabet)
    number = permute(number, a, b, key, tweak)
    out = []
    for alphabet, _ in reversed(symbols):
        number, place = divmod(number, len(alphabet))
        out.append(alphabet[place])
    return out[::-1]


def _like(text: str, key: bytes, tweak: str, alphabet: str | None = None, places: dict = PLACE) -> str:
    """``text`` with its letters and digits permuted within their alphabets, case and all other characters kept."""
    spots, symbols = [], []
    for i, c in enumerate(text):
        low = c.lower()
        where = (alphabet, alphabet.index(low)) if alphabet and low in alphabet else places.get(low)
        if where and len(low) == 1:
            spots.append(i)
            symbols.append(where)
    if not symbols:
        return text
    form = ".".join(s[0][:2] for s in symbols)
    out = list(text)
    for i, c in zip(spots, _mixed(symbols, key, f"{tweak}|{form}"), strict=True):
        out[i] = c.upper() if text[i] != text[i].lower() and len(c.upper()) == 1 else c
    return "".join(out)


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def iban_check(country: str, account: str) -> str:
    """The two check digits of an account number."""
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def private_net(number: int) -> tuple[int, int]:
    """(first address, bits) of the private net that an address lies in; (0, 0) for public ones."""
    return next(((net, bits) for net, bits in PRIVATE if number >> bits == net >> bits), (0, 0))


def day_of(text: str) -> dt.date | None:
    """The date of a mention; day first, unless that can't be or the year stands first."""
    try:
        if "-" in text:
            return dt.date.fromisoformat(text)
        one, two, year = map(int, re.split(r"[./]", text))
        return dt.date(year, one, two) if two > 12 else dt.date(year, two, one)
    except ValueError:
        return None


def canonical(kind: str, value: str) -> str:
    """What coreferent mentions of an entity share."""
    if kind in ("phone", "card"):
        digits = re.sub(r"\D", "", value)
        return digits[-10:] if kind == "phone" else digits
    if kind == "iban":
        return value.replace(" ", "").lower()
    if kind == "birth":
        day = day_of(value)
        return day.isoformat() if day and 0 <= (day - FIRST_DAY).days < DAYS else value
    if kind == "surname":
        low = value.lower()
        return low[:-1] if len(low) > 5 and low.endswith(FEMININE) else low
    return " ".join(value.lower().split())


def _name(word: str, gender: str, attempt: int, key: bytes, tweak: str) -> str:
    """A pronounceable look-alike of one name word; hyphens and apostrophes stay where they are."""
    kept = word[-2:] if not gender and len(word) > 4 and word.endswith(PATRONYMS) else ""
    made = _like(word[: len(word) - len(kept)], key, f"{tweak}|{kept}", places=SOUND) + kept
    script = "cyrillic" if "а" <= word[0] <= "я" or word[0] == "ё" else "latin"
    number = _round(key, f"{tweak}|longer", 0, int.from_bytes(word.encode(), "big"))
    more = "".join(SYLLABLES[script][number >> 3 * i & 7] for i in range(attempt // TRIES))
    made = made[: len(made) - len(kept)] + more + kept if kept else made + more
    if gender:
        made = re.sub(r"(?<=[^\W\d_])[^\W\d_](?![^\W\d_])", ENDINGS[script, gender], made)
    return made


def surrogate(kind: str, name: str, attempt: int, key: bytes) -> str:
    """The surrogate of a canonical value, itself canonical; ``attempt`` numbers a family of permutations."""
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        local, _, domain = name.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_like(local, key, tweak + '|l')}@{_like(host, key, tweak + '|d')}.{top}"
    if kind == "ip":
        number = 0
        for part in name.split("."):
            number = number * 256 + int(part)
        net, bits = private_net(number)
        bits = bits or 32
        low = number - net
        while True:  # public addresses walk the cycle past the private nets
            low = permute(low, 1 << bits - bits // 2, 1 << bits // 2, key, f"{tweak}|{net}")
            if net or private_net(low) == (0, 0):
                return ".".join(str(net + low >> s & 255) for s in (24, 16, 8, 0))
    if kind in ("hex", "token") and all(c in HEX for c in name):
        return _like(name, key, tweak, HEX)
    if kind == "card":
        valid, out = luhn(name), _like(name, key, tweak)
        while luhn(out) != valid:  # walk the cycle inside the class of equal checksums
            out = _like(out, key, tweak)
        return out
    if kind == "iban":
        country, account = name[:2], _like(name[4:], key, f"{tweak}|{name[:2]}")
        if iban_check(country, name[4:]) == name[2:4]:
            return country + iban_check(country, account) + account
        out = _like(name[2:], key, tweak)
        while iban_check(country, out[2:]) == out[:2]:  # what fails its checksum stays so
            out = _like(out, key, tweak)
        return country + out
    if kind == "birth":
        if not re.fullmatch(r"\d{4}-\d\d-\d\d", name) or (day := day_of(name)) is None:
            return _like(name, key, tweak)
        side = math.isqrt(DAYS) + 1
        number = (day - FIRST_DAY).days
        while (number := permute(number, side, side, key, tweak)) >= DAYS:
            pass
        return (FIRST_DAY + dt.timedelta(number)).isoformat()
    if kind == "given":
        gender, _, word = name.partition(":")
        return f"{gender}:{_name(word, gender, attempt, key, f'{tweak}|{gender}')}"
    if kind == "surname":
        return _name(name, "", attempt, key, tweak)
    if kind == "street":
        made = []
        for word in name.split(" "):
            end = next((e for e in STREETS if word.endswith(e.lower()) and len(word) > len(e)), "")
            same = word in PARTICLES or word.strip(".,") in _street_words
            made.append(word if same else _like(word[: len(word) - len(end)], key, f"{tweak}|{end}", places=SOUND) + end)
        return " ".join(made)
    return _like(name, key, tweak)


_street_words = {w.lower() for w in STREETS} | {"д", "дом"}


def _cased(value: str, made: str) -> str:
    """``made`` in the case of ``value``."""
    if len(value) > 1 and value.isupper():
        return made.upper()
    out = "".join(c.upper() if v.isupper() and len(c.upper()) == 1 else c for v, c in zip(value, made, strict=False))
    return out + made[len(value) :]


def _dress(kind: str, value: str, made: str) -> str:
    """The canonical surrogate in the mention's own punctuation and case."""
    if kind in ("given", "surname"):
        made = made.partition(":")[2] if kind == "given" else made
        if kind == "surname" and len(value) > 5 and value.lower().endswith(FEMININE):
            made += value[-1].lower()
        return _cased(value, made)
    if kind == "birth" and (day := day_of(value)) and re.fullmatch(r"\d{4}-\d\d-\d\d", made):
        new = dt.date.fromisoformat(made)
        if "-" in value:
            return made
        mark = "." if "." in value else "/"
        month_first = int(value.split(mark)[1]) > 12
        if not month_first and "/" not in value:
            return f"{new.day:02d}.{new.month:02d}.{new.year:04d}"
        if month_first and new.day <= 12:  # must be read the same way again
            return f"{new.day:02d}{mark}{new.month:02d}{mark}{new.year:04d}"
        return f"{new.month:02d}{mark}{new.day:02d}{mark}{new.year:04d}" if month_first else f"{new.day:02d}{mark}{new.month:02d}{mark}{new.year:04d}"
    if kind in ("phone", "card", "iban"):
        plain = [i for i, c in enumerate(value) if c.isalnum()][-len(made) :]
        out = list(value)
        for i, c in zip(plain, made, strict=True):
            out[i] = c.upper() if value[i].isupper() or (kind == "iban" and c.isalpha()) else c
        return "".join(out)
    if len(made) == len(value):
        upper = value.upper() == value and value.lower() != value
        return "".join(c.upper() if v.isupper() or (upper and v.isdigit()) else c for v, c in zip(value, made, strict=True))
    return made


def _people(text: str) -> list[tuple[int, int, str, str]]:
    """Name words of a text: those with a title or after a frequent given name, and every further mention of them."""
    if _triggers.isdisjoint(_capital.findall(text)):
        return []
    words: list[tuple[int, int, str, str]] = []
    known: dict[str, tuple[str, str]] = {}

    def take(start: int, name: str, gender: str | None) -> None:
        spans = [(m.start() + start, m.group()) for m in re.finditer(r"\S+", name) if m.group() not in PARTICLES]
        for k, (at, word) in enumerate(spans):
            if k == len(spans) - 1:
                kind, value = "surname", canonical("surname", word)
            else:
                low = word.lower().rstrip(".")
                kind, value = "given", f"{gender or GENDER.get(word) or ('f' if low.endswith(('a', 'а', 'я')) else 'm')}:{low}"
            words.append((at, at + len(word.rstrip(".")), kind, value))
            if len(word) > 2:
                known.setdefault(word.lower(), (kind, value))

    for m in TITLED.finditer(text):
        genders = [GENDER[t.strip(".")] for t in m.group("titles").split() if t.strip(".") in GENDER]
        take(m.start("name"), m.group("name"), genders[0] if genders else None)
    at = 0
    while m := PAIR.search(text, at):
        if m.group("given") in _names:
            take(m.start(), m.group(), GENDER[m.group("given")])
            at = m.end()
        else:
            at = m.end("given")
    if known:
        again = re.compile(rf"(?<![\w'’\-])(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?![\w'’\-])", re.IGNORECASE)
        done = {w[0] for w in words}
        words += [(m.start(), m.end(), *known[m.group().lower()]) for m in again.finditer(text) if m.group()[0].isupper() and m.start() not in done and m.group().lower() in known]
    return words


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical) of the entities of a text, in order, without overlaps."""
    if not text:
        return []
    out = []
    if may_match(text):
        for m in FINDER.finditer(text):
            group = next(k for k in KINDS if m.group(k) is not None)
            kind = "token" if group == "quoted" else group
            out.append((m.start(group), m.end(group), kind, canonical(kind, m.group(group))))
    people = _people(text)
    if not people:
        return out
    merged: list[tuple[int, int, str, str]] = []
    for e in sorted([*out, *people], key=lambda e: (e[0], e[2] in ("given", "surname"), -e[1])):
        if not merged or e[0] >= merged[-1][1]:
            merged.append(e)
    return merged


def rewrite(text: str | None, key: bytes, exceptions: dict[tuple[str, str], int]) -> tuple[str | None, dict[str, int]]:
    found, counts, parts, at = find(text), {}, [], 0
    for start, end, kind, name in found:
        made = surrogate(kind, name, exceptions.get((kind, name), 0), key)
        parts += [text[at:start], _dress(kind, text[start:end], made)]
        at = end
        counts[kind] = counts.get(kind, 0) + 1
    return ("".join([*parts, text[at:]]) if found else text), counts


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct (kind, name) of all entities; repeats are removed before the shuffle as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            seen = {(k, n) for t in batch.column(0).to_pylist() for _, _, k, n in find(t)}
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], pa.string()) for i in (0, 1)], names=["kind", "name"])

    return docs.select(text_col).mapInArrow(run, "kind string, name string").distinct()


def assign(names: DataFrame, key: bytes, max_attempts: int = 40) -> DataFrame:
    """(kind, name, attempt, made): distinct surrogates, none equal to a real entity of its kind."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values, tries = (batch.column(i).to_pylist() for i in range(3))
            made = [surrogate(k, n, a, key) for k, n, a in zip(kinds, values, tries, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["kind", "name", "attempt", "made"])

    schema = "kind string, name string, attempt int, made string"
    current = materialize(names.select("kind", "name", F.lit(0).alias("attempt")).mapInArrow(make, schema), "surrogates")
    real = names.select("kind", F.col("name").alias("made")).withColumn("taken", F.lit(True))
    for _ in range(max_attempts):
        same = Window.partitionBy("kind", "made")
        first = F.row_number().over(same.orderBy("attempt", "name"))
        checked = current.withColumn("nth", first).join(real, ["kind", "made"], "left").withColumn("bad", (F.col("nth") > 1) | F.coalesce("taken", F.lit(False)))
        checked = materialize(checked.select("kind", "name", "attempt", "made", "bad"), "surrogates-checked")
        if checked.where("bad").isEmpty():
            return current
        again = checked.where("bad").select("kind", "name", (F.col("attempt") + 1).alias("attempt")).mapInArrow(make, schema)
        current = materialize(checked.where("not bad").select("kind", "name", "attempt", "made").unionByName(again), "surrogates")
    raise RuntimeError("surrogates still collide")


def replace(docs: DataFrame, keep: list[str], key: bytes, text_col: str = "text", max_broadcast: int = 100_000) -> DataFrame:
    """Columns ``keep`` with text (rewritten), n_entities and entity_kinds (kind=count, comma-joined)."""
    made = ("text", "n_entities", "entity_kinds")
    keep = [c for c in keep if c not in made]
    table = assign(materialize(entities(docs, text_col), "entities"), key).where("attempt > 0").select("kind", "name", "attempt")
    spark = docs.sparkSession
    few = table.limit(max_broadcast + 1).count() <= max_broadcast
    shared = spark.sparkContext.broadcast({(r.kind, r.name): r.attempt for r in table.collect()} if few else {})
    rows = docs.select(*keep, F.col(text_col).alias("__read_text"))
    if not few:  # each document gets just its own exceptions
        rows = rows.withColumn("__row", F.monotonically_increasing_id())
        rows = materialize(rows, "surrogate-rows")

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                hits = [(i, k, n) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, n in {(k, n) for _, _, k, n in find(t)}]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), *(pa.array([h[j] for h in hits], pa.string()) for j in (1, 2))], names=["__row", "kind", "name"])

        needs = rows.select("__row", "__read_text").mapInArrow(own, "__row long, kind string, name string").join(table, ["kind", "name"])
        rows = rows.join(needs.groupBy("__row").agg(F.collect_list(F.struct("kind", "name", "attempt")).alias("__own")), "__row", "left").drop("__row")
    else:
        rows = rows.withColumn("__own", F.lit(None).cast("array<struct<kind:string,name:string,attempt:int>>"))
    schema = docs.select(*keep).schema.add("text", "string").add("n_entities", "long").add("entity_kinds", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = len(keep)
            out = []
            for text, own in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                out.append(rewrite(text, key, {(o["kind"], o["name"]): o["attempt"] for o in own} if own else shared.value))
            cols = [pa.array([t for t, _ in out], pa.string()), pa.array([sum(c.values()) for _, c in out], pa.int64()), pa.array([",".join(f"{k}={c[k]}" for k in sorted(c)) for _, c in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *cols], names=[*keep, *made])

    return rows.mapInArrow(run, schema)
