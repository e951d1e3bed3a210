"""Format-preserving pseudonyms for personal data.

Found values are validated (Luhn, mod 97, calendar, octet ranges, SSN areas, country codes after a
plus; North American phones by their numbering plan, unless a country code or brackets mark them as
phones) and then permuted within their own format by a keyed alternating Feistel network: positions
keep their character class, check digits are computed anew, dates stay dates, numbers of the plan stay
in it. The permutation depends on key and kind alone, so equal values have equal pseudonyms in every
document, and the key holder can invert it. Nobody else can: there is no default key.

Each kind is searched in the text less what earlier kinds took, and the text is written once, so no
pseudonym is found again.

Kinds: card, iban, ssn, phone, ip, date (1900 to 2099), email (local part), secret (the value
after a name like token or api_key). Values that fail validation are left alone.

Edge cases: null text stays null with nothing found; empty text stays empty; a value whose class
has one member (a mail name without letters and digits) stays; in the smallest domains (dates) a
value may be its own pseudonym; repeated rows are treated alike; whole texts are searched; extra
columns stay as they are, whatever their names, except that ``counts`` names the column added.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

ROUNDS = 10
#: Classes whose members stand in for each other.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŸ")
_CLASS = {c: (members, i) for members in CLASSES for i, c in enumerate(members)}
HEX = "0123456789abcdef"
FIRST_DAY, DAYS = date(1900, 1, 1), (date(2099, 12, 31) - date(1900, 1, 1)).days + 1

#: Characters of a value that are permuted together; a longer value is permuted block by block, its blocks by kinds of their own.
BLOCK = 256
#: Text between digits that numbers may have inside.
_RUN = re.compile(r"[+(0-9][0-9 ().:/-]*")
_NAME, _HOST = re.compile(r"[\w.+-]+"), re.compile(r"[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}")
_SECRET = re.compile(r"(?i)\b(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_+/=-]{12,})")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_NUMBERS = re.compile(
    r"(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d))"
    r"|(?P<phone>(?:\+\d{1,3}[ -]?)?\(\d{3}\) ?\d{3}[ -]\d{4}(?!\d)|(?<![\d-])(?:\+\d{1,3}[ -])?\d{3}(?P<s1>[-. ])\d{3}(?P=s1)\d{4}(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<date>(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d]|[/.-]\d))"
    r"|(?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?P<s2>[ -])\d{4}(?P=s2)\d{4}(?:(?P=s2)\d{4}(?P=s2)\d{1,3}(?![ ./-]?\d)|(?P=s2)\d{1,7})?|\d{4}(?P<s3>[ -])\d{6}(?P=s3)\d{5})(?!\d))"
    r"|(?P<abroad>(?<!\d)\+(?!\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)|\d{4}-\d{2}-\d{2}(?!\d))\d(?:[ ()./-]{0,2}\d){7,14}(?![ ()./-]{0,2}\d))"
)


def permute(key: bytes, kind: str, values: list[int], sizes: list[int], back: bool = False) -> list[int]:
    """A keyed permutation of mixed-radix numbers (``values[i] < sizes[i]``): alternating Feistel rounds on two halves.

    A key of more than 64 bytes counts by its hash.
    """
    key = key if len(key) <= 64 else blake2b(key).digest()
    half = len(values) // 2
    a, b = prod(sizes[:half]), prod(sizes[half:])
    x = y = 0
    for v, s in zip(values[:half], sizes[:half]):
        x = x * s + v
    for v, s in zip(values[half:], sizes[half:]):
        y = y * s + v
    shape = f"{kind}:{a}:{b}:".encode()

    def f(i: int, v: int) -> int:
        n = max(a, b).bit_length() // 8 + 16
        seed = shape + b"%d:%d" % (i, v)
        out = b"".join(blake2b(seed + b":%d" % j, key=key).digest() for j in range(-(-n // 64)))
        return int.from_bytes(out[:n], "big")

    sign = -1 if back else 1
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if i % 2:
            x = (x + sign * f(i, y)) % a
        else:
            y = (y + sign * f(i, x)) % b
    out = []
    for v, part in ((y, sizes[half:]), (x, sizes[:half])):
        for s in reversed(part):
            v, r = divmod(v, s)
            out.append(r)
    return out[::-1]


def _in_class(key: bytes, kind: str, text: str, back: bool, classes=None) -> str:
    """``text`` with each known character permuted within its class; others stay."""
    of = [(i, *(classes or _CLASS)[c]) for i, c in enumerate(text) if c in (classes or _CLASS)]
    if not of:
        return text
    numbers, sizes, n = [n for _, _, n in of], [len(m) for _, m, _ in of], len(of)
    if n <= BLOCK:
        new = permute(key, kind, numbers, sizes, back)
    else:
        edges = [n * i // -(-n // BLOCK) for i in range(-(-n // BLOCK) + 1)]
        new = [v for a, b in zip(edges, edges[1:]) for v in permute(key, f"{kind}:{a} of {n}", numbers[a:b], sizes[a:b], back)]
    out = list(text)
    for (i, members, _), n in zip(of, new):
        out[i] = members[n]
    return "".join(out)


def _refill(value: str, digits: str) -> str:
    """``value`` with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in value)


def luhn(digits: str) -> int:
    """0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10


def _card(key, value, back):
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or luhn(digits):
        head, tail = value[:19], value[19:]  # four groups of four may be a card of their own before a short number
        if not re.fullmatch(r"[ -]\d{1,3}", tail) or luhn(re.sub(r"\D", "", head)):
            return None
        while True:  # cycle walking, so that all groups together stay no card
            head = _card(key, head, back)
            if luhn(re.sub(r"\D", "", head + tail)):
                return head + tail
    body = _in_class(key, "card", digits[:-1], back)
    return _refill(value, body + str(-luhn(body + "0") % 10))


def _iban(key, value, back):
    flat = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    body = _in_class(key, "iban" + flat[:2], flat[4:], back)
    it = iter(flat[:2] + f"{98 - number(body + flat[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(it) for c in value)


def _real_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(key, value, back):
    digits = value.replace("-", "")
    if not _real_ssn(digits):
        return None
    while True:  # cycle walking: the permutation of the valid ones
        digits = _in_class(key, "ssn", digits, back)
        if _real_ssn(digits):
            return _refill(value, digits)


def _in_plan(digits: str) -> bool:
    """Whether ten digits fit the North American plan: area and exchange begin with 2 to 9 and are no service codes (N11)."""
    return all(part[0] in "23456789" and part[1:] != "11" for part in (digits[:3], digits[3:6]))


def _phone(key, value, back):
    digits = re.sub(r"\D", "", value)
    head, own = digits[:-10], digits[-10:]
    known = _in_plan(own)
    if not known and not head and "(" not in value:
        return None
    while True:  # cycle walking: numbers of the plan among themselves, others too; the country stays
        own = _in_class(key, "phone", own, back)
        if _in_plan(own) == known:
            return _refill(value, head + own)


#: Country codes of two digits (1 and 7 have one, others three).
_TWO = {"20", "27", *map(str, (*range(30, 35), 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98))}


def _abroad(key, value, back):
    digits = re.sub(r"\D", "", value)
    n = 1 if digits[0] in "17" else 2 if digits[:2] in _TWO else 3
    if digits[0] == "0":
        return None
    return _refill(value, digits[:n] + _in_class(key, "phone" + digits[:n], digits[n:], back))  # the country stays


#: What makes the four numbers behind it a version.
_VERSION = re.compile(r"(?i)(?:\bv|\bver|\bversion|\brelease)[.:]? ?$")


def _ip(key, value, back):
    parts = [int(p) for p in value.split(".")]
    if max(parts) > 255 or any(p != "0" and p[0] == "0" for p in value.split(".")):
        return None
    return ".".join(map(str, permute(key, "ip", parts, [256] * 4, back)))


def _date(key, value, back):
    sep = next(c for c in value if not c.isdigit())
    parts = value.split(sep)
    y, m, d = (0, 1, 2) if sep == "-" else (2, 0, 1) if sep == "/" else (2, 1, 0)
    try:
        n = (date(int(parts[y]), int(parts[m]), int(parts[d])) - FIRST_DAY).days
    except ValueError:
        if sep != "/":
            return None
        m, d = d, m  # day before month
        try:
            n = (date(int(parts[y]), int(parts[m]), int(parts[d])) - FIRST_DAY).days
        except ValueError:
            return None
    if not 0 <= n < DAYS:
        return None
    while True:  # cycle walking in 271 * 271 >= DAYS
        n = (lambda v: v[0] * 271 + v[1])(permute(key, "date", [n // 271, n % 271], [271, 271], back))
        if n < DAYS:
            break
    new = FIRST_DAY + timedelta(n)
    padded = len(parts[m]) == 2 and len(parts[d]) == 2
    out = ["", "", ""]
    out[y], out[m], out[d] = f"{new.year:04d}", f"{new.month:02d}" if padded else str(new.month), f"{new.day:02d}" if padded else str(new.day)
    return sep.join(out)


def _email(key, value, back):
    name, at, host = value.rpartition("@")
    return _in_class(key, "email", name, back) + at + host


_HEX = {c: (HEX, i) for i, c in enumerate(HEX)}


def _secret(key, value, back):
    return _in_class(key, "secret", value, back, _HEX if all(c in _HEX for c in value) else None)


KINDS: dict[str, Callable] = {"card": _card, "iban": _iban, "ssn": _ssn, "phone": _phone, "abroad": _abroad, "ip": _ip, "date": _date, "email": _email, "secret": _secret}


def pseudonym(key: bytes, kind: str, value: str, back: bool = False) -> str | None:
    """The value's pseudonym (or, ``back``, the value of a pseudonym); None if it isn't valid."""
    return _known(key, kind, value, back) if len(value) <= BLOCK else KINDS[kind](key, value, back)


@lru_cache(100_000)
def _known(key: bytes, kind: str, value: str, back: bool) -> str | None:
    return KINDS[kind](key, value, back)


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """Where mail addresses lie: each name that ends before an @, but for what the address before took, and the host behind."""
    at = 0
    for name in _NAME.finditer(text):
        a, b = max(name.start(), at), name.end()
        if a < b and text[b : b + 1] == "@" and (host := _HOST.match(text, b + 1)):
            yield a, host.end()
            at = host.end()


def _runs(text: str) -> Iterator[tuple[int, int]]:
    """Where numbers may lie: from a digit, plus or bracket to the last digit that such text goes on to."""
    for run in _RUN.finditer(text):
        a, b = run.start(), run.start() + len(run[0].rstrip(" ().:/-+"))
        if b - a > 1:
            yield a, b


_IBAN_HINT = re.compile(r"[A-Z]{2}\d{2}")


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, Counter]:
    """``text`` with pseudonyms, and how many of each kind."""
    found: Counter = Counter()
    put: list[tuple[int, int, str]] = []
    left = text  # with blanks of another kind where values were taken

    def take(kind: str, a: int, b: int) -> None:
        new = pseudonym(key, kind, text[a:b], back)
        if new is not None:
            found["phone" if kind == "abroad" else kind] += 1
            put.append((a, b, new))

    def search(spans: Iterator[tuple[int, int]], kind: str) -> str:
        before = len(put)
        for a, b in spans:
            take(kind, a, b)
        rest, at = [], 0
        for a, b, _ in put[before:]:
            rest += [left[at:a], "\0" * (b - a)]
            at = b
        return "".join([*rest, left[at:]])

    if "=" in text or ":" in text:
        left = search((m.span(1) for m in _SECRET.finditer(left)), "secret")
    if "@" in left:
        left = search(_mails(left), "email")
    if _IBAN_HINT.search(left):
        left = search((m.span() for m in _IBAN.finditer(left)), "iban")
    for start, end in _runs(left):
        for m in _NUMBERS.finditer(left[start:end]):
            a, b = (start + x for x in m.span())
            if m.lastgroup != "ip" or not _VERSION.search(left, max(0, a - 10), a):
                take(m.lastgroup, a, b)
    out, at = [], 0
    for a, b, new in sorted(put):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), found


def pseudonymise(docs: DataFrame, key: bytes, counts: str = "pii", back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and ``counts``: what was replaced, as "kind:count;..." in order of kind."""
    if not key:
        raise ValueError("pseudonyms need a key")
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields if f.name != counts]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [(None, Counter()) if t is None else replace(t, key, back) for t in b.column("text").to_pylist()]
            text = pa.array([m[0] for m in made], pa.string())
            what = pa.array([";".join(f"{k}:{m[1][k]}" for k in sorted(m[1])) for m in made], pa.string())
            yield pa.RecordBatch.from_arrays([*(text if n == "text" else b.column(n) for n in names), what], [*names, counts])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(counts, T.StringType(), True)]))
