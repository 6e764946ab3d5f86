"""Surrogates for personal data.

Detected entities (mail and IP addresses, phone, card and other long numbers, social security and bank account numbers,
secrets, names of persons) get keyed replacements of the same kind. Structured kinds go through a keyed bijection without fixed
points over the alphabets of their own characters, so that layout, letter case, script and digit script stay, private networks
stay private, and check digits stay as right as they were. A given name that is in ``NAMES`` gets the next one in a keyed cycle
through those of its gender and script; another one, and a family name, is composed of syllables of its script, with an
ending of its gender.

Names are found after a title, by a given name in ``NAMES``, by words before and after that go with persons, and where two
capitalised words are listed beside a person found otherwise.

The replacement is a function of key, kind and normal form alone: the same entity gets the same surrogate everywhere, also
in another layout, and a family name alone is replaced in a text that has it in a full name. Bijections keep different entities
different whatever the corpus holds, even all of a small domain. Composed names must differ from each other and from every name
of the corpus; where one doesn't, the entity goes to the next attempt, with more syllables, until none is left. The few entities
with a later attempt are broadcast if they are at most ``broadcast_rows``, else joined to the rows.

Defined cases: a null text stays null; an empty one stays empty; very long texts are read whole; texts without entities come back
unchanged; repeated rows are replaced alike; spans that start at one place go to the longest; an empty table gives an empty
result; a column of ``docs`` named n_entities or kinds is replaced by ours.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .scratch import written

_MAIL = r"(?P<mail>(?<![\w.+%-])[\w.+%-]*[\w+%-]@[\w-]+(?:\.[\w-]+)+)|"
_OTHERS = (
    r"(?P<secret>(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}|(?:[0-9a-f]{32,}|[0-9A-F]{32,}))(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d\d(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?!\w))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))"
    r"|(?P<card>(?<![\d.])(?:\d[ -]?){12,18}\d(?!\d))"
    r"|(?P<ssn>(?<!\d)\d{3}-\d\d-\d{4}(?!\d))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\w.])\+\d{8,14}(?!\d))"
)
_PATTERN = {True: re.compile(_MAIL + _OTHERS), False: re.compile(_OTHERS)}  # is there an @ at all?
_TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Don господин г-н κύριος".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Señorita Doña госпожа г-жа κυρία".split(),
    "": "Dr Doctor Prof Professor".split(),
}
NAMES = {
    ("latin", "m"): (
        "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Peter Hans Klaus Jürgen Wolfgang Pierre Jean Luc François Carlos "
        "José Miguel Javier Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander "
        "Patrick Jack Dennis Jerry Tyler Aaron Henry Nathan Oliver Noah Ethan Liam Lukas Felix Stefan Dieter Günter Uwe Matthias Tobias Antoine Étienne Mathieu Olivier Laurent Thierry Pedro Juan "
        "Luis Jorge Diego Pablo Fernando Sergio Alejandro Rafael Marco Giovanni Luca Matteo Paolo Mehmet Mustafa Ahmed Mohammed Muhammad Ali Omar Hassan Ibrahim Yusuf Khalid Rajesh Arjun Rahul "
        "Amit Vikram Sanjay Wei Hiroshi Takashi Kenji Kwame Kofi Chinedu Lars Sven Björn Piotr Tomasz Jakub Andrei Mihai Zoltán László"
    ).split(),
    ("latin", "f"): (
        "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Margaret Sandra Ashley Emily Donna Michelle Greta Ursula Heike Sabine Marie Camille Brigitte Amélie Carmen "
        "Lucía Isabel Pilar Kimberly Carol Amanda Melissa Deborah Stephanie Rebecca Laura Sharon Cynthia Kathleen Amy Angela Shirley Anna Brenda Pamela Emma Nicole Helen Samantha Katherine Christine "
        "Rachel Carolyn Janet Catherine Maria Heather Diane Julie Olivia Sophia Sophie Charlotte Ingrid Monika Petra Claudia Birgit Gisela Élodie Chloé Céline Nathalie Sylvie Isabelle Ana Elena Sofía "
        "Marta Cristina Teresa Rosa Giulia Chiara Francesca Ayşe Fatma Zeynep Aisha Fatima Khadija Layla Maryam Noor Priya Ananya Deepa Lakshmi Sunita Kavita Mei Yuki Sakura Akiko Amara Ngozi Adaeze "
        "Freja Astrid Agnieszka Katarzyna Zofia Ioana Zsófia"
    ).split(),
    ("cyrillic", "m"): "Иван Сергей Дмитрий Алексей Николай Михаил Андрей Павел Олег Юрий Борис Виктор Владимир Александр Максим Игорь Антон Евгений".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана Людмила Галина Вера Нина Екатерина Юлия Анастасия Дарья Ксения Полина".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Πέτρος Βασίλης Παναγιώτης Χρήστος".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Ιωάννα Βασιλική Γεωργία Δέσποινα".split(),
}
_GENDER = {n: g for (_, g), names in NAMES.items() for n in names}
_CAP = r"[^\W\d_a-zß-öø-ÿа-яα-ω][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted(sum(_TITLES.values(), []), key=len, reverse=True))})(\.? )({_CAP})(?: ({_CAP}))?")
_FULL = re.compile(rf"(?<!\w)({'|'.join(sorted(_GENDER, key=len, reverse=True))}) ({_CAP})")
_TITLE_GENDER = {t: g for g, ts in _TITLES.items() for t in ts}
_BEFORE = "Dear Contact contact Attn named Sincerely Regards Liebe Lieber Cher Chère Estimado Estimada Querida Querido Уважаемый Уважаемая Αγαπητέ Αγαπητή".split()
_BY = "written signed authored drafted directed narrated".split()
_AFTER = (
    "said wrote asked replied answered whispered nodded smiled laughed shrugged sighed sagte schrieb fragte antwortete lächelte nickte répondit demanda écrivit sourit dijo escribió preguntó respondió "
    "сказал сказала написал написала спросил спросила ответил ответила είπε έγραψε ρώτησε απάντησε"
).split()
_CUED = re.compile(rf"(?<!\w)(?:(?:{'|'.join(_BEFORE)})[:,]?|(?:{'|'.join(_BY)}) by)\s({_CAP}) ({_CAP})")
_DOING = re.compile(rf"(?<!\w)({_CAP}) ({_CAP}) (?:{'|'.join(_AFTER)})(?!\w)")
_LINK = r"(?:, | and | or | und | oder | et | ou | y | o | и | или | και |, and |, or )"
_NEXT = re.compile(rf"{_LINK}({_CAP}) ({_CAP})")
_LAST = re.compile(rf"(?<!\w)({_CAP}) ({_CAP}){_LINK}$")
_NO_NAME = set(
    "Customer Service Support Team Colleague Colleagues Sales The This That These Those New Old North South East West United Great Saint Upper Lower First Second Last Next White Black High Supreme Prime General National International Royal Federal Central "
    "City State County Street Road Avenue House Hall Court Council Congress Senate Parliament Government Ministry Department Office Bank Group Company Corp Corporation Inc Ltd Association Institute "
    "University College School Hospital Church Museum Library Party Army Union Times Post News Journal Press Team Club League Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February "
    "March April May June July August September October November December Der Die Das Ein Eine Le La Les Un Une El Los Las Una In On At For From With And But He She They We It His Her Their Our"
    .split()
)
_RANGES = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ßàáâãäåæçèéêëìíîïðñòóôõö", "øùúûüýþÿ",
    *("".join(map(chr, range(a, b))) for a, b in ((0x430, 0x450), (0x3B1, 0x3C2), (0x3C3, 0x3CA), (0x5D0, 0x5EB), (0x627, 0x63B), (0x641, 0x64B), (0x904, 0x93A), (0xE01, 0xE2F), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0xA000), (0xAC00, 0xD7A4))),
]
_ALPHABET = {c: (r, i) for r in _RANGES for i, c in enumerate(r)}
_SYLLABLES = {
    "latin": [a + b for a in "b d f g k l m n p r s t v z".split() for b in "a e i o u".split()],
    "cyrillic": [a + b for a in "б в г д з к л м н п р с т".split() for b in "а е и о у".split()],
    "greek": [a + b for a in "β γ δ κ λ μ ν π ρ σ τ".split() for b in "α ε ι ο".split()],
}
_ENDINGS = {
    ("latin", "m"): "n r s k l d".split(), ("latin", "f"): "a ia ina elle ine".split(), ("latin", ""): "e i".split(),
    ("cyrillic", "m"): "н р й к л".split(), ("cyrillic", "f"): "а ия ина ена".split(), ("cyrillic", ""): "е и".split(),
    ("greek", "m"): "ος ης ας".split(), ("greek", "f"): "α η ια".split(), ("greek", ""): "ι ο".split(),
}


def _draw(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key, digest_size=16).digest(), "little")


def permute(key: bytes, tweak: str, digits: list[int], radices: list[int], back: bool = False) -> list[int]:
    """A keyed bijection on mixed-radix numbers of one shape (an unbalanced Feistel network of eight rounds), or its inverse."""
    half = len(digits) // 2
    a, b = list(digits[:half]), list(digits[half:])
    ra, rb = radices[:half], radices[half:]
    for i in range(7, -1, -1) if back else range(8):
        side, radix, other = (b, rb, a) if i % 2 == 0 else (a, ra, b)
        for lo in range(0, len(side), 4):
            n = _draw(key, tweak, i, lo, *radices, "|", *other)
            for j in range(lo, min(lo + 4, len(side))):
                step = n & 0xFFFFFFFF
                side[j] = (side[j] - step if back else side[j] + step) % radix[j]
                n >>= 32
    return a + b


def displace(key: bytes, tweak: str, digits: list[int], radices: list[int]) -> list[int]:
    """A keyed bijection that leaves no number where it is: the next number, as seen through ``permute``."""
    there = permute(key, tweak, digits, radices)
    for i, r in enumerate(radices):
        there[i] = (there[i] + 1) % r
        if there[i]:
            break
    return permute(key, tweak, there, radices, back=True)


def _permute_text(key: bytes, tweak: str, text: str, fixed: int = 0) -> str:
    """Every character after the first ``fixed`` stays in its alphabet; those without one stay as they are."""
    spots = [i for i, c in enumerate(text) if i >= fixed and c in _ALPHABET]
    if not spots:
        return text
    out = list(text)
    picked = [_ALPHABET[text[i]] for i in spots]
    for i, (alphabet, _), v in zip(spots, picked, displace(key, tweak, [v for _, v in picked], [len(a) for a, _ in picked])):
        out[i] = alphabet[v]
    return "".join(out)


def _luhn(digits: str) -> int:
    total = sum(sum(divmod(int(c) * (2 if i % 2 == 0 else 1), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _digits(text: str) -> str:
    return "".join(str(unicodedata.digit(c)) for c in text if c.isdigit() and unicodedata.digit(c, None) is not None)


def normal_form(kind: str, text: str) -> str:
    if kind in ("card", "ssn"):
        return _digits(text)
    if kind == "phone":
        return _digits(text)[-10:]
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(x)) for x in text.split("."))
    return text.lower() if kind == "mail" else text


_cycles: dict[tuple[bytes, str, str], dict[str, str]] = {}


def _next_name(key: bytes, script: str, gender: str, name: str) -> str:
    """The next name of the keyed cycle through those of a gender and script."""
    if (key, script, gender) not in _cycles:
        order = sorted(NAMES[script, gender], key=lambda n: _draw(key, "cycle", n))
        _cycles[key, script, gender] = dict(zip(order, [*order[1:], order[0]]))
    return _cycles[key, script, gender][name]


def _compose(key: bytes, kind: str, value: str, attempt: int) -> str:
    """A name of syllables of the script, with an ending of the gender if it is a given name."""
    what, script, gender = kind.split(":")
    table = _SYLLABLES[script]
    for salt in itertools.count():
        n = _draw(key, kind, value, attempt, salt)
        out = ""
        for _ in range((2 if what == "given" else 3) + attempt // 2):
            n, i = divmod(n, len(table))
            out += table[i]
        if what == "given":
            endings = _ENDINGS[script, gender]
            out = (out if gender == "m" and script != "greek" else out[:-1]) + endings[n % len(endings)]
        if out.capitalize() not in _GENDER:
            return out.capitalize()
    raise AssertionError


def by_bijection(kind: str, value: str) -> bool:
    """Is the surrogate a bijection's value, which can clash with no other?"""
    return not kind.startswith(("given:", "family:")) or (kind.startswith("given:") and value in NAMES.get(tuple(kind.split(":")[1:3]), ()))


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """Replacement of a normal form; attempts matter to composed names only."""
    if kind == "card":
        body = _permute_text(key, kind, value[:-1], 1)
        return body + str((_luhn(body) + int(value[-1]) - _luhn(value[:-1])) % 10)
    if kind in ("ssn", "phone"):
        lead = [9 if value[0] != "0" else 1]
        new = displace(key, kind, [int(value[0]) - (value[0] != "0"), *map(int, value[1:])], lead + [10] * (len(value) - 1))
        return "".join(map(str, [new[0] + (value[0] != "0"), *new[1:]]))
    if kind == "ip":
        parts = list(map(int, value.split(".")))
        # networks, each closed under the bijection: private ones, what is left of 172 and 192, public addresses, and the rest by its first part
        inner = {172: range(16, 32), 192: range(168, 169)}.get(parts[0])
        if inner is not None:
            held, table = parts[:1], [x for x in range(256) if (x in inner) == (parts[1] in inner)]
        elif parts[0] in (0, 10, 127) or parts[0] >= 224:
            held, table = parts[:1], list(range(256))
        else:
            held, table = [], [x for x in range(1, 224) if x not in (10, 127, 172, 192)]
        rest = parts[len(held) :]
        new = displace(key, f"ip:{held}:{len(table)}", [table.index(rest[0]), *rest[1:]], [len(table)] + [256] * (len(rest) - 1))
        return ".".join(map(str, [*held, table[new[0]], *new[1:]]))
    if kind == "iban":
        low = _permute_text(key, kind, value[4:].lower()).upper()
        code = "".join(str(int(c, 36)) for c in low + value[:2])
        old = "".join(str(int(c, 36)) for c in value[4:] + value[:2])
        shift = (int(value[2:4]) - (98 - int(old + "00") % 97)) % 100
        return f"{value[:2]}{(98 - int(code + '00') % 97 + shift) % 100:02d}{low}"
    if kind == "secret":
        head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-", value)
        low = value[head.end() if head else 0 :]
        if re.fullmatch(r"[0-9a-fA-F]{32,}", value):
            case = "0123456789ABCDEF" if re.search("[A-F]", value) else "0123456789abcdef"
            return "".join(case[v] for v in displace(key, kind + case, [int(c, 16) for c in value], [16] * len(value)))
        upper = [c.isupper() for c in low]
        new = _permute_text(key, kind + "".join("01"[u] for u in upper), low.lower())
        return value[: len(value) - len(low)] + "".join(c.upper() if u else c for c, u in zip(new, upper))
    if kind == "mail":
        name, _, host = value.rpartition("@")
        stem, _, top = host.rpartition(".")
        return f"{_permute_text(key, kind, name)}@{_permute_text(key, 'host', stem)}.{top}"
    script, gender = kind.split(":")[1:3]
    if by_bijection(kind, value):
        return _next_name(key, script, gender, value)
    return _compose(key, kind, value, attempt) if script in _SYLLABLES else _permute_text(key, f"{kind}:{attempt}", value)


def _script(word: str) -> str:
    cp = ord(word[0])
    return "latin" if cp < 0x250 else "greek" if 0x370 <= cp < 0x400 else "cyrillic" if 0x400 <= cp < 0x530 else "other"


def find(text: str, structured: bool = True, names: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form), ascending and without overlap."""
    spans = []
    if structured:
        for m in _PATTERN["@" in text].finditer(text):
            kind, end = m.lastgroup, m.end()
            value = normal_form(kind, m.group())
            if value and (kind != "mail" or value.rpartition(".")[2].isalpha()):
                spans.append((m.start(), end, kind, value))
    if not names:
        return spans
    family: dict[str, str] = {}
    own: list[tuple[int, int, str, str]] = []
    people: dict[int, int] = {}  # where full names begin and end

    def person(m: re.Match, given: int, gender: str = "") -> None:
        """The given name in one group and the family name in the next."""
        first, last = m.group(given), m.group(given + 1)
        own.append((m.start(given), m.end(given), f"given:{_script(first)}:{_GENDER.get(first, gender)}", first))
        family[last] = f"family:{_script(last)}:"
        own.append((m.start(given + 1), m.end(given + 1), family[last], last))
        people[m.start(given)] = m.end(given + 1)

    for m in _TITLED.finditer(text):
        if m.group(4):
            person(m, 3, _TITLE_GENDER[m.group(1)])
        else:
            family[m.group(3)] = f"family:{_script(m.group(3))}:"
            own.append((m.start(3), m.end(3), family[m.group(3)], m.group(3)))
    for m in _FULL.finditer(text):
        person(m, 1)
    for pattern in (_CUED, _DOING):
        for m in pattern.finditer(text):
            if not {m.group(1), m.group(2)} & _NO_NAME:
                person(m, 1)
    todo = sorted(people.items())
    while todo:  # two capitalised words listed beside a person
        begin, end = todo.pop()
        before = max(0, begin - 120)
        for m in (_NEXT.match(text, end), _LAST.search(text[before:begin])):
            if m and not {m.group(1), m.group(2)} & _NO_NAME:
                shift = before if m.re is _LAST else 0
                start, stop = m.start(1) + shift, m.end(2) + shift
                if start not in people and not any(x < stop and start < y for x, y in people.items()):
                    first, last = m.group(1), m.group(2)
                    own.append((start, m.end(1) + shift, f"given:{_script(first)}:{_GENDER.get(first, '')}", first))
                    family[last] = f"family:{_script(last)}:"
                    own.append((m.start(2) + shift, stop, family[last], last))
                    people[start] = stop
                    todo.append((start, stop))
    if family:
        again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(family, key=len, reverse=True)))})(?!\w)")
        own += [(m.start(), m.end(), family[m.group()], m.group()) for m in again.finditer(text)]
    out, end = [], 0
    for span in sorted({*spans, *own}, key=lambda s: (s[0], -s[1])):
        if span[0] >= end:
            out.append(span)
            end = span[1]
    return out


def render(kind: str, old: str, value: str, new: str) -> str:
    """The surrogate in the layout of the mention."""
    if kind in ("card", "ssn", "phone", "iban"):
        room = sum(c.isalnum() for c in old) - len(new)
        it, out = iter(new), []
        for c in old:
            if c.isalnum():
                if room > 0:
                    room -= 1
                else:
                    d = next(it)
                    zero = unicodedata.digit(c, None) if c.isdigit() else None
                    c = chr(ord(c) - zero + int(d)) if zero is not None and d.isdigit() else d
            out.append(c)
        return "".join(out)
    if kind == "mail" and old != value and len(new) == len(old):
        return "".join(b.upper() if a.isupper() else b for a, b in zip(old, new))
    return new


_HINTS: list[tuple[np.ndarray, ...]] = []


def _hints() -> tuple[np.ndarray, ...]:
    """Hashes of words that a name begins with or that stand right before one (of those with a hyphen, of what follows it), the lengths of those
    without and their hashes; the hashes of the words before that count only with a capital after them; lengths and hashes of the words behind a name."""
    if not _HINTS:

        def hashes(words: set[bytes]) -> np.ndarray:
            words = sorted(words)
            off = np.concatenate([[0], np.cumsum([len(w) for w in words])])
            return np.sort(tx.span_hashes(np.frombuffer(b"".join(words), dtype=np.uint8), off[:-1], off[1:]))

        whole = {w.encode() for w in {*_GENDER, *_TITLE_GENDER, *_BY}}
        before, after = {w.encode() for w in _BEFORE}, {w.encode() for w in _AFTER}
        plain = {w for w in whole | before if b"-" not in w}
        lengths = lambda words: np.array(sorted({len(w) for w in words}))
        _HINTS.append((hashes({w.rpartition(b"-")[2] for w in whole}), lengths(plain), hashes(plain), hashes(before), lengths(after), hashes(after)))
    return _HINTS[0]


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


_BREAK = np.ones(256, dtype=bool)
_BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False
_NOT_LATIN = _BREAK.copy()
_NOT_LATIN[128:] = True
_LOWER_START = np.zeros(256, dtype=bool)
_LOWER_START[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = _DIGIT[0xD9:0xDC] = _DIGIT[0xDF:] = True  # ASCII digits and the leads of others


def scan(texts: pa.Array, structured: bool = True) -> Iterator[tuple[int, str, list[tuple[int, int, str, str]]]]:
    """(row, text, entities) of the rows that have entities; most others are ruled out by their bytes. Without ``structured``, names alone.

    What rules out must never be narrower than the patterns: a name begins at the end of a run of letters and bytes from 128
    on, which may hold quotes or dashes before it; structured kinds have a digit, an @ or a run of letters that may be a secret.
    """
    whole, lengths, plain, before, after_lengths, after = _hints()
    for lo, _, buf, off in tx.text_chunks(texts, 1 << 20):  # a byte takes some 30 here, in a worker beside the JVM
        digit = np.zeros(len(off) - 1, dtype=bool)
        if structured:
            starts, ends, word_off = tx.word_spans(buf, off, _NOT_LATIN)
            digit = tx.per_doc((_DIGIT[buf] | (buf == 64)).astype(np.int64), off) > 0
            # of letters alone there are secrets of 32, or of 16 and more behind a prefix
            long = np.flatnonzero(ends - starts >= 16)
            at = starts[long]
            joined = (buf[np.maximum(at - 1, 0)] == 45) | (buf[np.maximum(at - 1, 0)] == 95)
            head = (buf[at] == 65) & ((buf[at + 1] == 75) | (buf[at + 1] == 83)) & (buf[at + 2] == 73) & (buf[at + 3] == 65)
            secret = np.zeros(len(starts), dtype=np.int64)
            secret[long] = joined | head | (ends[long] - at >= 32)
            digit |= tx.per_doc(secret, word_off) > 0
        starts, ends, word_off = tx.word_spans(buf, off, _BREAK)
        h = tx.span_hashes(buf, starts, ends)
        hit = _among(h, whole) | _among(h, after)
        if len(h):
            capital = ~_LOWER_START[buf[starts[1:]]]
            hit[:-1] |= _among(h[:-1], before) & capital
        high = np.concatenate([[0], np.cumsum(buf >= 128)])
        mixed = np.flatnonzero(high[ends] > high[starts])
        for n in lengths:
            some = mixed[ends[mixed] - starts[mixed] > n]
            hit[some] |= _among(tx.span_hashes(buf, ends[some] - n, ends[some]), plain)
        for n in after_lengths:
            some = mixed[ends[mixed] - starts[mixed] > n]
            hit[some] |= _among(tx.span_hashes(buf, starts[some], starts[some] + n), after)
        name = tx.per_doc(hit.astype(np.int64), word_off) > 0
        for i in np.flatnonzero(digit | name):
            text = texts[int(lo + i)].as_py()
            spans = find(text, bool(digit[i]), bool(name[i]))
            if spans:
                yield int(lo + i), text, spans


def _group(kind: str) -> str:
    """Kinds whose surrogates must differ from each other."""
    return kind.split(":")[0]


def later_attempts(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt) of the distinct names whose first composed surrogate is taken by another or is a name of the corpus itself."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, values, tries = (b.column(c).to_pylist() for c in ("kind", "value", "attempt"))
            new = [surrogate(key, k, v, a) for k, v, a in zip(kinds, values, tries)]
            yield pa.record_batch(
                [pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(tries, pa.int32()), pa.array([_group(k) for k in kinds], pa.string()), pa.array(new, pa.string())],
                names=["kind", "value", "attempt", "grp", "new"],
            )

    schema = "kind string, value string, attempt int, grp string, new string"
    known = written(entities.withColumn("attempt", F.lit(0)).mapInArrow(propose, schema))
    originals = known.select("grp", F.col("value").alias("new")).distinct()
    first = known
    settled: DataFrame | None = None
    for attempt in itertools.count():  # a later attempt draws from many more names, so few rounds are needed
        # a surrogate is good for the smallest of its entities, unless it is an entity or was given before
        counted = first.groupBy("grp", "new").agg(F.min(F.struct("kind", "value")).alias("owner"))
        taken = originals if settled is None else originals.unionAll(settled.select("grp", "new"))
        good = counted.join(taken, ["grp", "new"], "left_anti")
        marked = first.join(good, ["grp", "new"], "left").withColumn("ok", F.coalesce(F.struct("kind", "value") == F.col("owner"), F.lit(False)))
        marked = written(marked.drop("owner"))
        keep = marked.filter("ok").drop("ok")
        settled = keep if settled is None else settled.unionAll(keep)
        rest = marked.filter(~F.col("ok"))
        if rest.isEmpty():
            break
        first = rest.select("kind", "value", F.lit(attempt + 1).alias("attempt")).mapInArrow(propose, schema)
    return settled.filter("attempt > 0").select("kind", "value", "attempt")


def replace_pii(
    docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000
) -> DataFrame:
    """docs with replaced texts, and n_entities and kinds (the distinct kinds found, by name)."""
    docs = docs.drop("n_entities", "kinds")
    texts = docs.select(F.col(text_col).cast("string").alias("text"))

    def entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(k, v) for _, _, spans in scan(batch.column("text"), False) for _, _, k, v in spans if not by_bijection(k, v)}
            rows = sorted(found)
            yield pa.record_batch([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], names=["kind", "value"])

    later = written(later_attempts(texts.mapInArrow(entities, "kind string, value string").distinct(), key))
    few = later.limit(broadcast_rows + 1).count() <= broadcast_rows
    row_key = [F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.hash(F.col(text_col), F.lit(1))]
    if few:
        fixed = docs.sparkSession.sparkContext.broadcast({(r.kind, r.value): r.attempt for r in later.collect()})
        base = docs
    else:

        def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, k, v) for i, _, spans in scan(batch.column("text")) for k, v in {(k, v) for _, _, k, v in spans}]
                at = pa.array([i for i, _, _ in rows], pa.int64())
                yield pa.record_batch(
                    [batch.column("k1").take(at), batch.column("k2").take(at), pa.array([k for _, k, _ in rows], pa.string()), pa.array([v for _, _, v in rows], pa.string())],
                    names=["k1", "k2", "kind", "value"],
                )

        keyed = docs.select(row_key[0].alias("k1"), row_key[1].alias("k2"), F.col(text_col).cast("string").alias("text"))
        per_row = keyed.mapInArrow(mentions, "k1 long, k2 int, kind string, value string").distinct().join(later, ["kind", "value"])
        per_row = per_row.groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias("_later"))
        base = docs.withColumn("k1", row_key[0]).withColumn("k2", row_key[1]).join(per_row.hint("shuffle_hash"), ["k1", "k2"], "left").drop("k1", "k2")
        fixed = None

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, str, int], str] = {}
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string())
            changed, counts = {}, np.zeros(batch.num_rows, dtype=np.int32)
            kinds = [""] * batch.num_rows
            attempts = fixed.value if fixed is not None else None
            own_later = batch.column(batch.schema.get_field_index("_later")) if fixed is None else None
            for row, text, spans in scan(column):
                mine = attempts if attempts is not None else {(x["kind"], x["value"]): x["attempt"] for x in own_later[row].as_py() or []}
                parts, end = [], 0
                for a, b, kind, value in spans:
                    k = (kind, value, mine.get((kind, value), 0))
                    if k not in memo:
                        if len(memo) > 200_000:
                            memo.clear()
                        memo[k] = surrogate(key, *k)
                    parts += [text[end:a], render(kind, text[a:b], value, memo[k])]
                    end = b
                changed[row] = "".join([*parts, text[end:]])
                counts[row] = len(spans)
                kinds[row] = ",".join(sorted({_group(s[2]) for s in spans}))
            if changed:
                mask = np.zeros(batch.num_rows, dtype=bool)
                mask[list(changed)] = True
                column = pa.compute.replace_with_mask(column, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], pa.string()))
            cols = [column if n == text_col else batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_later"]
            names = [n for n in batch.schema.names if n != "_later"]
            yield pa.record_batch([*cols, pa.array(counts), pa.array(kinds, pa.string())], names=[*names, "n_entities", "kinds"])

    schema = docs.withColumn(text_col, F.col(text_col).cast("string")).schema.add("n_entities", "integer").add("kinds", "string")
    return base.mapInArrow(replace, schema)
