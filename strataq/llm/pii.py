"""PII surrogates: keyed, type-consistent, distinct and coreferent replacements.

Entities found: e-mail addresses, phone numbers, card-like digit runs, IBANs, US social
security numbers, IPv4 addresses, assigned secrets, and person names.  A name is what
follows a title, a greeting or a field such as ``name:``; a listed given name and the
capitalised word after it; the two words of an address's local part where they stand
capitalised in the text; and every later mention of a surname found in one of these ways.

Each type has a *bijection* on values of one format: characters of a class (digits, hex,
small and capital letters of a script) are numbered in a mixed radix, and the number goes
one step on along a keyed cycle through all numbers of its range (a Feistel network with
cycle walking, one step, and the network backwards).  So distinct entities of a format get
distinct surrogates without any state shared between tasks, however many stand in one
document, no value is mapped to itself, and the same entity gets the same surrogate in
every document.  Where a format asks for more (a card's check digit, a reserved exchange),
the cycle is followed to the next value that has the property, which is a bijection again.
Spelling variants (letter case of an address, separators of a number) are mapped by the
bare value and put back.  Given names go along a keyed cycle of the list of their gender
and script; other names keep script and case.

Every document is checked for collisions: ``collisions`` counts distinct entities less
distinct surrogates, and is 0.  A surrogate may equal another entity of the document, as
with a document that holds a whole list of given names; that entity is replaced as well.

Cases: null stays null, an empty text stays empty; a very long text is searched whole, in
time in proportion to it; repeated rows change alike; text outside entities is kept byte
for byte; a value without any letter or digit of a class stays; an empty table gives no
rows; columns other than doc_id and text (in ``clean`` n_chars) are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame

from .common import like_input, table

KEY = b"strataq surrogate key: replace in production"
SCHEMA = "doc_id long, text string, n_entities int, n_distinct int, kinds string, collisions int"

# Given names by script and gender, titles by gender, and words before a name.
NAMES = {
    ("latin", "f"): """Anna Maria Laura Julia Sarah Emma Sophie Claire Helena Lucia Elena Carmen Isabel Katharina Charlotte Margaret Elizabeth Susan Patricia
        Jennifer Linda Barbara Jessica Karen Nancy Lisa Sandra Ashley Emily Michelle Amanda Melissa Rebecca Olivia Hannah Lena Sabine Ursula Monika Petra
        Camille Juliette Nathalie Valentina Francesca Giulia Chiara Ana Marta Sofia Fatima Aisha Priya Mei""".split(),
    ("latin", "m"): """John James Robert Michael William David Thomas Daniel Peter Paul Martin Stefan Hans Klaus Pierre Jean Carlos Miguel Antonio Francisco
        Richard Joseph Charles Christopher Matthew Anthony Mark Steven Andrew Kevin Brian George Edward Jason Ryan Jacob Nicholas Eric Jonathan Wolfgang
        Jürgen Dieter Matthias Antoine Nicolas Giovanni Marco Luca Pablo Javier Ahmed Mohammed Omar Raj Wei Hiroshi""".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила".split(),
    ("cyrillic", "m"): "Иван Александр Сергей Дмитрий Андрей Алексей Михаил Николай Владимир Павел".split(),
}
TITLES = {"f": "Mrs Ms Miss Frau Madame Mme Señora Sra Signora Lady Госпожа".split(), "m": "Mr Herr Monsieur Señor Sr Signor Sir Господин".split(), "": "Dr Prof Professor Doctor".split()}
FIELDS = "name author contact signed attn owner sender recipient customer patient employee manager client applicant".split()
GREETINGS = "Dear Hello Sincerely Regards Cheers Yours".split()
OF_NAME = {name: group for group, names in NAMES.items() for name in names}
CLASSES = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "".join(map(chr, range(0x430, 0x450))) + "ё",
    "".join(map(chr, range(0x410, 0x430))) + "Ё",
    "".join(c for c in map(chr, range(0x3B1, 0x3CA)) if c != "ς"),
    "".join(c for c in map(chr, range(0x391, 0x3AA)) if c.isupper()),
    "".join(c for c in map(chr, range(0x100, 0x180)) if c.islower() and len(c.upper()) == 1),
    "".join(c for c in map(chr, range(0x100, 0x180)) if c.isupper() and len(c.lower()) == 1),
    "".join(map(chr, range(0x5D0, 0x5EB))),
    "".join(c for c in map(chr, range(0x621, 0x64B)) if c.isalpha() and c != "ـ"),
    "".join(map(chr, range(0x905, 0x93A))),
    "".join(map(chr, range(0xE01, 0xE2F))),
    "".join(map(chr, range(0x4E00, 0x9FA6))),
    "".join(map(chr, range(0x3041, 0x3097))),
    "".join(map(chr, range(0x30A1, 0x30FB))),
    "".join(map(chr, range(0xAC00, 0xD7A4))),
]
HEX = "0123456789abcdef"
HEX_ONLY = re.compile("[0-9a-f]+")
PLACE = {c: (alphabet, i) for alphabet in CLASSES for i, c in enumerate(alphabet)}

EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]*[^\W_][\w.+-]*@[^\W_][\w-]*(?:\.[\w-]+)*\.[^\W\d_]{2,}")
NUMERIC = re.compile(
    r"(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.]*\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
)
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")
SECRET = re.compile(r"(?i)(?<![^\W_])(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|pwd)[\"']?\s*[=:]\s*(?P<q>[\"']?)(?P<v>[^\s\"',;]{8,})(?P=q)")
TITLED = re.compile(r"(?<!\w)(?P<t>%s)\.? (?P<a>[^\W\d_]+)(?: (?P<b>[^\W\d_]+))?(?: (?P<c>[^\W\d_]+))?" % "|".join(t for ts in TITLES.values() for t in ts))
GIVEN = re.compile(r"(?<!\w)(?P<a>%s) (?P<b>[^\W\d_]{2,})(?: (?P<c>[^\W\d_]{2,}))?(?!\w)" % "|".join(OF_NAME))
FIELD = re.compile(r"(?i:(?<![^\W_])(?:%s))[\"']?\s{0,4}[:=]\s{0,4}[\"']?(?P<a>[^\W\d_]{2,}) (?P<b>[^\W\d_]{2,})(?: (?P<c>[^\W\d_]{2,}))?(?!\w)" % "|".join(FIELDS))
GREETED = re.compile(r"(?<!\w)(?:%s),?\s{1,4}(?P<a>[^\W\d_]{2,})(?: (?P<b>[^\W\d_]{2,}))?(?!\w)" % "|".join(GREETINGS))
PAIR = re.compile(r"(?<!\w)(?P<a>[^\W\d_]+) (?=(?P<b>[^\W\d_]+)(?!\w))")
WORD = re.compile(r"\w+")
ALL_TITLES = frozenset(t for ts in TITLES.values() for t in ts)
FIELD_WORDS, GREETING_WORDS = frozenset(FIELDS), frozenset(GREETINGS)


class Cipher:
    """A keyed permutation of range(n), for any n and tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, x: int, bits: int) -> int:
        size = max(1, (bits + 7) // 8)
        out = b"".join(hashlib.blake2b(b"%d.%d|%x|%s" % (i, j, x, tweak), key=self.key, digest_size=min(64, size)).digest() for j in range(-(-size // 64)))
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _walk(self, x: int, n: int, half: int, tweak: bytes, rounds) -> int:
        mask, back = (1 << half) - 1, rounds.step < 0
        while True:
            a, b = x >> half, x & mask
            for i in rounds:
                a, b = (b ^ self._round(tweak, i, a, half), a) if back else (b, a ^ self._round(tweak, i, b, half))
            x = a << half | b
            if x < n:
                return x

    def permute(self, x: int, n: int, tweak: bytes, back: bool = False) -> int:
        """A keyed permutation of range(n), or the way back."""
        if n < 2:
            return x
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        return self._walk(x, n, half, tweak, range(7, -1, -1) if back else range(8))

    def step(self, x: int, n: int, tweak: bytes) -> int:
        """The next number on one keyed cycle through range(n): a permutation that moves every number."""
        return self.permute((self.permute(x, n, tweak) + 1) % n, n, tweak, back=True)

    def text(self, value: str, tweak: bytes, alphabet: str | None = None) -> str:
        """A value of the same format; characters of no class stay."""
        spots = [(i, *((alphabet, alphabet.index(c)) if alphabet else PLACE[c])) for i, c in enumerate(value) if (c in alphabet if alphabet else c in PLACE)]
        x, n = 0, 1
        for _, letters, k in spots:
            x, n = x * len(letters) + k, n * len(letters)
        shape = "".join("x" if alphabet and c in alphabet else str(CLASSES.index(PLACE[c][0])) + "," if not alphabet and c in PLACE else c for c in value)
        x = self.step(x, n, tweak + b"|" + shape.encode("utf-8", "surrogatepass"))
        out = list(value)
        for i, letters, _ in reversed(spots):
            x, k = divmod(x, len(letters))
            out[i] = letters[k]
        return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _iban_ok(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def refill(shape: str, bare: str, keep) -> str:
    """Puts the characters of ``bare`` where ``shape`` has ones that ``keep`` accepts."""
    chars = iter(bare)
    return "".join(next(chars) if keep(c) else c for c in shape)


def _cased(like: str, value: str) -> str:
    return "".join(v.upper() if c.isupper() and len(v.upper()) == 1 else v for c, v in zip(like, value))


class Surrogates:
    def __init__(self, key: bytes = KEY):
        self.cipher = Cipher(key)

    def email(self, value: str, tweak: bytes) -> str:
        low = value.lower()
        if len(low) != len(value):
            low = value
        local, _, domain = low.partition("@")
        head, *tail = domain.split(".")
        # reserved domains keep their end; no other address is given an end that they have
        if ".".join(tail[-2:]) in ("example.com", "example.net", "example.org") or tail[-1] in ("test", "invalid"):
            new = self.cipher.text(head, b"host" + tweak) + "." + ".".join(tail)
        else:
            new = self.cipher.text(".".join([head, *tail[:-1]]), b"host" + tweak) + "." + tail[-1] + ".example"
        out = self.cipher.text(local, b"local" + tweak + domain.encode("utf-8", "surrogatepass")) + "@" + new
        return _cased(value, out[: len(value)]) + out[len(value) :]

    def phone(self, value: str, tweak: bytes) -> str:
        digits = re.sub(r"\D", "", value)
        country = 0 if value[0] != "+" else 1 if digits[0] in "17" else 2  # by digits only, so that spellings agree
        head, rest = digits[:country], digits[country:]
        if len(rest) == 10 and rest[3:6] == "555":  # exchange reserved for fiction
            new = self.cipher.text(rest[:3] + rest[6:], b"phone555" + tweak)
            rest = new[:3] + "555" + new[3:]
        else:
            rest = self.cipher.text(rest, b"phone" + tweak + head.encode())
            while len(rest) == 10 and rest[3:6] == "555":  # stays out of the reserved set
                rest = self.cipher.text(rest, b"phone" + tweak + head.encode())
        return refill(value, head + rest, str.isdigit)

    def card(self, value: str, tweak: bytes) -> str:
        digits = re.sub(r"\D", "", value)
        valid, new = luhn(digits), digits
        while True:  # a walk over numbers with the same validity is a permutation of them
            new = self.cipher.text(new, b"card" + tweak)
            if luhn(new) == valid:
                return refill(value, new, str.isdigit)

    def iban(self, value: str, tweak: bytes) -> str:
        bare = value.replace(" ", "")
        body = self.cipher.text(bare[4:], b"iban" + bare[:2].encode() + tweak)
        check = 98 - int("".join(str(int(c, 36)) for c in body + bare[:2] + "00")) % 97
        return refill(value, f"{bare[:2]}{check:02d}{body}", lambda c: c != " ")

    def ssn(self, value: str, tweak: bytes) -> str:
        return self.cipher.text(value, b"ssn" + tweak)

    def ip(self, value: str, tweak: bytes) -> str:
        x = int.from_bytes(bytes(map(int, value.split("."))), "big")
        return ".".join(map(str, self.cipher.step(x, 1 << 32, b"ip" + tweak).to_bytes(4, "big")))

    def secret(self, value: str, tweak: bytes) -> str:
        if HEX_ONLY.fullmatch(value):
            return self.cipher.text(value, b"secret" + tweak, HEX)
        while HEX_ONLY.fullmatch(value := self.cipher.text(value, b"secret" + tweak)):
            pass  # on to the next value that is no hex number
        return value

    def given(self, value: str, tweak: bytes) -> str:
        names = NAMES[OF_NAME[value]]
        return names[self.cipher.step(names.index(value), len(names), b"given" + repr(OF_NAME[value]).encode() + tweak)]

    def surname(self, value: str, tweak: bytes) -> str:
        return self.cipher.text(value, b"surname" + tweak)

    def make(self, kind: str, value: str) -> str:
        return getattr(self, kind)(value, b"|")


def canonical(kind: str, value: str) -> str:
    if kind in ("phone", "card"):
        return re.sub(r"[^\d+]", "", value)
    if kind == "email":
        return value.lower()
    return value.replace(" ", "") if kind == "iban" else value


ORDER = ("secret", "email", "iban", "ip", "ssn", "phone", "card", "given", "surname")


def _person(m: re.Match, parts: str) -> list[tuple[int, int, str]]:
    """The capitalised words of a name, up to the first other one."""
    out = []
    for part in parts:
        word = m[part]
        if not word or not word[0].isupper() or word in ALL_TITLES:
            break
        out.append((*m.span(part), "given" if word in OF_NAME else "surname"))
    return out


def _names(text: str, addresses: list[str]) -> list[tuple[int, int, str]]:
    words = set(WORD.findall(text))  # runs that the patterns cannot start inside of
    found: list[tuple[int, int, str]] = []
    if not ALL_TITLES.isdisjoint(words):
        for m in TITLED.finditer(text):
            found += _person(m, "abc" if m["b"] in OF_NAME else "ab")
    if not words.isdisjoint(OF_NAME):
        for m in GIVEN.finditer(text):
            if m["b"][0].isupper():
                found += _person(m, "abc" if m["b"] in OF_NAME else "ab")
    if (":" in text or "=" in text) and not FIELD_WORDS.isdisjoint(w.lower() for w in words):
        for m in FIELD.finditer(text):
            if m["a"][0].isupper() and m["b"][0].isupper():
                found += _person(m, "abc")
    if not GREETING_WORDS.isdisjoint(words):
        for m in GREETED.finditer(text):
            found += _person(m, "ab")
    owners = {tuple(w.capitalize() for w in re.split(r"[\W\d_]+", x) if len(w) > 1) for x in addresses}
    if owners := {x for x in owners if len(x) == 2 and words.issuperset(x)}:
        found += [x for m in PAIR.finditer(text) if (m["a"], m["b"]) in owners for x in _person(m, "ab")]
    later = {text[a:b] for a, b, kind in found if kind == "surname" and b - a > 2}
    if later:
        found += [(*m.span(), "surname") for m in WORD.finditer(text) if m[0] in later]
    return found


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of entities, in order and apart from each other."""
    found: list[tuple[int, int, str]] = []
    addresses: list[str] = []
    if "@" in text:
        for m in EMAIL.finditer(text):
            bare = m[0].lstrip("_.+-")
            found.append((m.end() - len(bare), m.end(), "email"))
            addresses.append(bare.partition("@")[0])
    if re.search(r"\d\d", text) or re.search(r"\d\.\d", text):
        found += [(*m.span(), m.lastgroup) for m in NUMERIC.finditer(text)]
        found += [(*m.span(), "iban") for m in IBAN.finditer(text) if 15 <= len(m[0].replace(" ", "")) <= 34 and _iban_ok(m[0].replace(" ", ""))]
    if "=" in text or ":" in text:
        found += [(*m.span("v"), "secret") for m in SECRET.finditer(text)]
    found += _names(text, addresses)
    starts: list[int] = []  # of what is taken, in order: only the neighbours can overlap
    taken: dict[int, tuple[int, str]] = {}
    for a, b, kind in sorted(set(found), key=lambda x: (ORDER.index(x[2]), x[0], -x[1])):
        at = bisect_right(starts, a)
        if (at and taken[starts[at - 1]][0] > a) or (at < len(starts) and starts[at] < b):
            continue
        starts.insert(at, a)
        taken[a] = b, kind
    return [(a, *taken[a]) for a in starts]


def replace(text: str | None, surrogates: Surrogates) -> tuple[str | None, list[tuple[str, str, str]], int]:
    """New text, (kind, value, surrogate) of each place, and distinct entities that share a surrogate."""
    if not text:
        return text, [], 0
    places = find(text)
    if not places:
        return text, [], 0
    made: dict[tuple[str, str], str] = {}
    real: dict[tuple[str, str], str] = {}
    parts, at, log = [], 0, []
    for a, b, kind in places:
        value = text[a:b]
        if (kind, value) not in made:
            made[kind, value] = surrogates.make(kind, value)
            real[kind, canonical(kind, value)] = canonical(kind, made[kind, value])
        new = made[kind, value]
        parts += [text[at:a], new]
        log.append((kind, value, new))
        at = b
    return "".join(parts) + text[at:], log, len(real) - len({(k, new) for (k, _), new in real.items()})


def pseudonyms(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """The text of every row of ``docs`` (doc_id, text) with surrogates, and counts."""

    def step(batches):
        made = Surrogates(key)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                new, log, clashes = replace(text, made)
                rows.append((doc, new, len(log), len({x[:2] for x in log}), ",".join(sorted({x[0] for x in log})), clashes))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "n_entities", "n_distinct", "kinds", "collisions"]).astype({"doc_id": "Int64", "n_entities": "int32", "n_distinct": "int32", "collisions": "int32"})

    return docs.select("doc_id", "text").mapInPandas(step, SCHEMA)


def clean(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """All rows and columns of ``docs``; text replaced, n_chars counted anew."""

    def step(batches):
        made = Surrogates(key)
        for pdf in batches:
            old = pdf.text
            pdf["text"] = [replace(t, made)[0] for t in old]
            if "n_chars" in pdf:
                changed = [a != b for a, b in zip(old, pdf.text)]
                pdf["n_chars"] = [len(t) if c else n for t, c, n in zip(pdf.text, changed, pdf.n_chars.astype("object"))]
                pdf["n_chars"] = pdf["n_chars"].astype("Int64")
            yield pdf

    return like_input(docs, step)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return pseudonyms(table(spark, sf_dir, "documents"))
