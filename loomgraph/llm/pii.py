"""Surrogates for personal data.

Detected entities are replaced by keyed surrogates of the same kind, shape, script and, for names, gender. A surrogate is
the entity's image under a keyed permutation of all strings of its kind and shape (a Feistel network over mixed radices,
walked until the image is one the format allows), so one entity has one surrogate wherever it stands
and in whatever layout, and distinct entities have distinct ones; nothing is looked up. The permutation
is one cycle, so it leaves none of two or more strings as it is. A check over all distinct entities counts what
stayed unchanged and what met in one surrogate, and while there is any, all is drawn again under the next key.

Names are learnt where a title or a listed given name tells them, and then replaced wherever they stand in the document, each part of a
hyphenated name by itself, in capitals or not. Where all strings of a shape are in use, a surrogate is some other entity's real form;
as every entity is replaced, it names nobody.

Who has the key can undo the permutations: it must be kept apart from the output, and no key is built in.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from bisect import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import stored

EPOCHS = 16
ROUNDS = 8
#: Letters that are permuted as one number; longer strings go in blocks of so many, in linear time.
BLOCK = 256

GIVEN = {
    ("latin", "f"): "Anna Maria Julia Laura Clara Emma Sofia Elena Marta Paula Nina Lucia Alice Sarah Hannah Ruth Helen Grace Rose Jane Mary Susan Karen Linda Sophie Marie Claire Julie Camille Carmen".split(),
    ("latin", "m"): "John Peter Paul Thomas Martin David Daniel Lukas Felix Jonas Simon Adam Mark James Robert William Henry George Charles Louis Pierre Jean Michel Carlos Juan Pedro Diego Hans Karl Otto".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Павел Виктор".split(),
}
TITLES = {
    "m": "Mr Sir Herr Monsieur Señor Don Господин".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mademoiselle Señora Señorita Doña Госпожа".split(),
    "u": "Dr Prof Professor".split(),
}
GENDER = {form: g for g, titles in TITLES.items() for t in titles for form in (t, t.upper())}
#: Small words between names.
PARTICLES = "van von de der den di da del della du la le dos das ter ten bin al el zu".split()
#: Where each listed name is, by its small letters.
LISTED = {n.lower(): (group, i) for group, names in GIVEN.items() for i, n in enumerate(names)}
#: Letters stand for letters of their own class, so that a surrogate can be spoken like its entity.
CLASSES = [
    "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "çñß",
    "аеиоуыэюяё", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρστφχψ", "0123456789",
]
CLASSES += [c.upper().replace("SS", "ẞ") for c in CLASSES[:-1]]
OF_CLASS = {letter: c for c in CLASSES for letter in c}
NUMBER = {c: str(i) for i, c in enumerate(CLASSES)}


@lru_cache(maxsize=1 << 16)
def letter_class(letter: str) -> str | None:
    """The letters that may stand for letter: its class, or its like among the 64 code points around it."""
    if letter in OF_CLASS:
        return OF_CLASS[letter]
    if not letter.isalpha():
        return None
    kind, first = unicodedata.category(letter), ord(letter) & ~63
    like = "".join(c for c in map(chr, range(first, first + 64)) if unicodedata.category(c) == kind and c not in OF_CLASS and len(c.lower()) == len(c.upper()) == 1)
    return like if letter in like and len(like) > 1 else None


HEX = "0123456789abcdef"


def permuted(x: int, n: int, key: bytes, tweak: str, back: bool = False) -> int:
    """The image of x under a keyed permutation of 0 .. n - 1, or what has x as its image."""
    if n < 2:
        return x
    half = max(1, (n - 1).bit_length() + 1) // 2
    mask, size = (1 << half) - 1, half // 8 + 1
    while True:
        left, right = x >> half, x & mask
        if back:
            left, right = right, left
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            seen = hashlib.blake2b(b"%d|%d|" % (r, right) + tweak.encode(), key=key[:64], digest_size=min(64, size)).digest()
            if size > 64:
                seen = hashlib.shake_256(seen).digest(size)
            left, right = right, left ^ (int.from_bytes(seen) & mask)
        x = right << half | left if back else left << half | right
        if x < n:
            return x


def moved(x: int, n: int, key: bytes, tweak: str) -> int:
    """The image of x under a keyed permutation of 0 .. n - 1 that is one cycle, so that none of two or more stays."""
    return permuted((permuted(x, n, key, tweak) + 1) % n, n, key, tweak, back=True)


def respelt(text: str, key: bytes, tweak: str, fits: Callable[[str], bool] = lambda s: True, alphabet: str | None = None) -> str:
    """The image of text among the strings of its shape: each letter in its class, all else as it is.

    Of a long text, the first block is permuted under a digest of the others, and these under the first one's image.
    """
    if len(text) > BLOCK:
        blocks = [text[at : at + BLOCK] for at in range(BLOCK, len(text), BLOCK)]
        rest = hashlib.blake2b("".join(blocks).encode(), key=key[:64]).hexdigest()
        first = respelt(text[:BLOCK], key, f"{tweak}|first|{len(text)}|{rest}", fits, alphabet)
        lead = hashlib.blake2b(first.encode(), key=key[:64]).hexdigest()
        return first + "".join(respelt(b, key, f"{tweak}|{i}|{lead}", fits, alphabet) for i, b in enumerate(blocks))
    classes = [alphabet if alphabet and c in alphabet else letter_class(c) for c in text]
    shape = "".join((NUMBER.get(c) or ("x" if c == alphabet else f"<{c[0]}>")) if c else t for c, t in zip(classes, text))
    x, n = 0, 1
    for c, letter in zip(classes, text):
        if c:
            x, n = x * len(c) + c.index(letter), n * len(c)
    # text fits too, so the cycle ends there at last.
    while True:
        x = moved(x, n, key, f"{tweak}|{shape}")
        rest, out = x, []
        for c, letter in zip(reversed(classes), reversed(text)):
            if c:
                rest, at = divmod(rest, len(c))
                out.append(c[at])
            else:
                out.append(letter)
        found = "".join(reversed(out))
        if fits(found) or found == text:
            return found


def luhn(digits: str) -> int:
    """The check sum: 0 for a valid number."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def private(ip: str) -> bool:
    a, b, *_ = map(int, ip.split("."))
    return a in (0, 10, 127) or a >= 224 or (a, b) == (192, 168) or (a == 172 and 16 <= b < 32)


def with_digits(layout: str, digits: str) -> str:
    """layout with its digits replaced in turn."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in layout)


@dataclass(frozen=True)
class Entity:
    kind: str
    #: The same for all layouts of one entity.
    name: str
    start: int
    end: int


_DIGIT = re.compile(r"\d")
#: A letter that isn't small.
_HIGH = r"[^\W\d_a-zа-яß-öø-ÿα-ω]"
#: A name, with its apostrophes and hyphens but without a possessive ending.
_NAME = re.compile(_HIGH + r"(?:[^\W\d_]|[-'’](?!s\b)(?=[^\W\d_]))+")
_FOLLOWING = rf"[ \u00a0](?:(?:{'|'.join(PARTICLES)})[ \u00a0])*{_NAME.pattern}"
_FIRST = re.compile(rf"\b{_HIGH}[^\W\d_]*")
_TITLED = re.compile(rf"[^\W\d_]+\.?[ \u00a0](?:{_HIGH}\.[ \u00a0]?){{0,3}}((?:(?:{'|'.join(PARTICLES)})[ \u00a0])*{_NAME.pattern}(?:{_FOLLOWING}){{0,2}})")
_LISTED = re.compile(rf"({_NAME.pattern}(?:{_FOLLOWING}){{1,2}})")
#: How some services' secrets begin.
KNOWN_SECRETS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
#: Kind, pattern, and what a text must hold for the pattern to be worth trying: one of these, or for None a digit.
_PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}"), ("@",)),
    ("secret", re.compile(r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_.-]{6,}[A-Za-z0-9+/_-])"), ("=", ":")),
    ("secret", re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])"), KNOWN_SECRETS),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), None),
    ("ip", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"), None),
    ("ip6", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}(?![\w:]|\.\d)"), (":",)),
    ("card", re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]|\.\d)"), None),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"), None),
    ("phone", re.compile(r"(?<![\w.])\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,5}(?!\w)"), None),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), None),
]


def canonical(kind: str, found: str) -> str | None:
    """What all layouts of one entity share; None if found is none of its kind after all."""
    if kind == "email":
        return found.lower()
    if kind == "ip":
        parts = found.split(".")
        return found if all(int(p) < 256 and str(int(p)) == p for p in parts) else None
    if kind == "ip6":
        try:
            ip = ipaddress.IPv6Address(found)
        except ValueError:
            return None
        # Without a figure, two colons can be a name in a program.
        plain = ip.is_loopback or ip.is_unspecified or (found.count(":") < 3 and not _DIGIT.search(found))
        return None if plain else str(ip)
    if kind in ("card", "phone", "ssn"):
        digits = re.sub(r"\D", "", found)
        if kind == "phone":
            return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits if 8 <= len(digits) <= 15 else None
        return digits
    if kind == "iban":
        packed = found.replace(" ", "")
        return packed if iban_check(packed[:2], packed[4:]) == packed[2:4] else None
    return found


def folded(name: str) -> str:
    return "".join(low if len(low := c.lower()) == 1 else c for c in name)


def name_parts(found: str, start: int, gender: str) -> Iterator[Entity]:
    """The parts of one person's names, which stand at start: the last is the family's, the others, or a listed one, are given."""
    names = list(_NAME.finditer(found))
    for i, m in enumerate(names):
        at = m.start()
        for part in m[0].split("-"):
            name = folded(part)
            last = i == len(names) - 1 and not (len(names) == 1 and name in LISTED)
            if len(name) > 1:
                yield Entity("family" if last else f"given-{gender}", name, start + at, start + at + len(part))
            at += len(part) + 1


def names_in(text: str) -> list[Entity]:
    """Names after a title, or that begin with a listed given name, and all other mentions of theirs."""
    found: list[Entity] = []
    for m in _FIRST.finditer(text):
        if m[0] in GENDER:
            if told := _TITLED.match(text, m.start()):
                found += name_parts(told[1], told.start(1), GENDER[m[0]])
        elif (low := m[0].lower()) in LISTED and (told := _LISTED.match(text, m.start())):
            found += name_parts(told[1], told.start(1), LISTED[low][0][1])
    if found:
        learnt = {e.name: e.kind for e in reversed(found)}
        for m in _NAME.finditer(text):
            at = m.start()
            for part in m[0].split("-"):
                name = folded(part)
                name = name if name in learnt else name[:-1] if name[-1:] == "s" else name
                if name in learnt:
                    found.append(Entity(learnt[name], name, at, at + len(name)))
                at += len(part) + 1
    return found


def entities(text: str | None) -> list[Entity]:
    """All entities, by place; where kinds overlap, the kind that is listed first."""
    text = text or ""
    digits = _DIGIT.search(text) is not None
    found: list[Entity] = []
    for kind, pattern, needs in _PATTERNS:
        if not (digits if needs is None else any(c in text for c in needs)):
            continue
        for m in pattern.finditer(text):
            group = 1 if pattern.groups else 0
            name = canonical(kind, m[group])
            if name is not None:
                found.append(Entity(kind, name, m.start(group), m.end(group)))
    found += names_in(text)
    order = {k: i for i, (k, _, _) in reversed(list(enumerate(_PATTERNS)))}
    # Entities that are taken do not overlap, so only the two beside a place can.
    taken: list[Entity] = []
    starts: list[int] = []
    for e in sorted(found, key=lambda e: (order.get(e.kind, 99), e.start, -e.end)):
        at = bisect(starts, e.start)
        if (at == 0 or taken[at - 1].end <= e.start) and (at == len(taken) or e.end <= starts[at]):
            taken.insert(at, e)
            starts.insert(at, e.start)
    return taken


def surrogate(kind: str, name: str, key: bytes) -> str:
    """The canonical surrogate of a canonical entity."""
    if kind == "email":
        local, _, domain = name.partition("@")
        labels, _, top = domain.rpartition(".")
        return f"{respelt(local, key, 'local')}@{respelt(labels, key, 'domain')}.{top}" + ("" if top == "example" else ".example")
    if kind == "secret":
        fixed = next((p for p in KNOWN_SECRETS if name.startswith(p)), "")
        rest = name[len(fixed) :]
        return fixed + respelt(rest, key, "secret" + fixed, alphabet=HEX if set(rest) <= set(HEX) else None)
    if kind == "ip":
        own = private(name)
        x = int.from_bytes(bytes(map(int, name.split("."))))
        while True:
            x = moved(x, 1 << 32, key, "ip")
            found = ".".join(map(str, x.to_bytes(4)))
            if private(found) == own:
                return found
    if kind == "ip6":
        x = int(ipaddress.IPv6Address(name))
        return str(ipaddress.IPv6Address(x >> 112 << 112 | moved(x & ((1 << 112) - 1), 1 << 112, key, f"ip6|{x >> 112}")))
    if kind == "card":
        valid = luhn(name) == 0
        if valid:
            body = name[0] + respelt(name[1:-1], key, "card" + name[0])
            return body + str(-luhn(body + "0") % 10)
        return name[0] + respelt(name[1:], key, "number" + name[0], fits=lambda s: luhn(name[0] + s) != 0)
    if kind == "phone":
        # Numbers that can be dialled stay so, and others others: each sort has its own cycle.
        sort = lambda s: (len(s) == 10 and s[0] not in "01" and s[3] not in "01", s[0] == "0")
        return respelt(name, key, "phone", fits=lambda s: sort(s) == sort(name))
    if kind == "ssn":
        unused = lambda s: s[:3] in ("000", "666") or s[0] == "9"
        return respelt(name, key, "ssn", fits=lambda s: unused(s) == unused(name))
    if kind == "iban":
        rest = respelt(name[4:], key, "iban" + name[:2])
        return name[:2] + iban_check(name[:2], rest) + rest
    if kind.startswith("given-"):
        if name in LISTED:
            (script, gender), i = LISTED[name]
            names = GIVEN[script, gender]
            return names[moved(i, len(names), key, script + gender)].lower()
        return respelt(name[:-1], key, "given" + name[-1], fits=lambda s: s + name[-1] not in LISTED) + name[-1]
    return respelt(name, key, "family")


def written(e: Entity, layout: str, new: str) -> str:
    """new in the layout of the place it stands at."""
    if e.kind in ("card", "phone", "ssn"):
        digits = re.sub(r"\D", "", layout)
        return with_digits(layout, digits[: len(digits) - len(e.name)] + new)
    if e.kind == "iban":
        left = iter(new)
        return "".join(next(left) if c != " " else c for c in layout)
    if e.kind in ("email", "ip6") and layout.isupper():
        return new.upper()
    if e.kind == "family" or e.kind.startswith("given-"):
        if e.name in LISTED and e.kind != "family":
            return new.upper() if layout.isupper() else new[:1].upper() + new[1:]
        return "".join(up if old.isupper() and len(up := c.upper()) == 1 else c for c, old in zip(new, layout))
    return new


def replaced(text: str | None, key: bytes) -> tuple[str | None, int]:
    """text with surrogates, and how many."""
    found = entities(text)
    if not found:
        return text, 0
    out, at = [], 0
    for e in found:
        out += [text[at : e.start], written(e, text[e.start : e.end], surrogate(e.kind, e.name, key))]
        at = e.end
    return "".join([*out, text[at:]]), len(found)


def distinct_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, name): all distinct entities."""

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = sorted({(e.kind, e.name) for t in batch.column("text") for e in entities(t.as_py())})
            yield pa.record_batch([pa.array([k for k, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.string())], names=["kind", "name"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(detect, "kind string, name string").distinct()


def key_of_epoch(key: bytes, epoch: int) -> bytes:
    return hashlib.blake2b(b"%d|" % epoch + key).digest()


def clashes(found: DataFrame, key: bytes) -> int:
    """How many entities share a surrogate with another of their kind or kept their own form though a letter could change."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("name").to_pylist()
            new = [surrogate(k, n, key) for k, n in zip(batch.column("kind").to_pylist(), names)]
            same = [a == b and any(map(letter_class, a)) for a, b in zip(names, new)]
            yield pa.record_batch([batch.column("kind"), pa.array(new, pa.string()), pa.array(same, pa.bool_())], names=["kind", "new", "same"])

    made = found.mapInArrow(make, "kind string, new string, same boolean")
    groups = made.groupBy("kind", "new").agg(F.count("*").alias("n"), F.sum(F.col("same").cast("long")).alias("same"))
    return groups.agg(F.sum(F.col("n") - 1 + F.col("same"))).first()[0] or 0


def safe_key(docs: DataFrame, key: bytes, text_col: str = "text") -> bytes:
    """The first epoch's key under which no two entities of docs clash."""
    found = stored(distinct_entities(docs, text_col), "entities")
    for epoch in range(EPOCHS):
        if not clashes(found, k := key_of_epoch(key, epoch)):
            return k
    raise ValueError(f"entities clash under {EPOCHS} keys: some kind has more entities than surrogates of their shape")


def with_surrogates(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_replaced: a row for each row of docs, its text with surrogates for all entities.

    Null texts stay null, empty ones empty; texts without entities stay as they are. Repeated rows get the same
    surrogates. Null ids stay null. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [replaced(t.as_py(), key) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], names=["doc_id", "text", "n_replaced"])

    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return held.mapInArrow(run, f"doc_id {dict(held.dtypes)['doc_id']}, text string, n_replaced int")
