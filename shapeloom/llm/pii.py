"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

A value is found by its pattern, checked where its kind has a rule (check digits, calendar, octets), and mapped by a
keyed permutation of all values of its format: the same key maps equal values alike in every document, distinct values
stay distinct, and check digits hold where they held before.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapeloom.llm.kernels import tidy

ROUNDS = 8
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_PATTERN = re.compile(
    r"""(?P<email>(?<![\w.%+-])[\w.%+-]+@(?:[\w-]+\.)+[^\W\d_]{2,})
    |(?P<date>(?<![\d.-])(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})(?![\d-]))
    |(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))
    |(?P<iban>\b[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b)
    |(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z]))
    |(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)
      |(?<![\w+(.-])(?:1[ .-])?\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\w-]|[.]\d)
      |(?<![\w+(.-])(?:1[ .-])?\d{3}(?P<gap>[ .-])\d{3}(?P=gap)\d{4}(?![\w-]|[.]\d)
      |(?<![\w+(.-])0\d(?P<pair>[ .-])\d\d(?:(?P=pair)\d\d){3}(?![\w-]|[.]\d)
      |(?<![\w+(.-])0\d{2,4}[ /-]\d{5,8}(?![\w-]|[.]\d))
    |(?P<number>(?<![\d-])(?:\d{13,19}|\d{4}(?P<four>[ -])\d{4}(?P=four)\d{4}(?P=four)\d{4}|\d{3}-\d\d-\d{4})(?![\d]|-\d))
    """,
    re.VERBOSE,
)
_KINDS = ("email", "date", "ip", "iban", "secret", "phone", "number")
_WORTH = re.compile(r"[\d@]")


def _round(key: bytes, tweak: str, step: int, value: int, size: int) -> int:
    data = f"{tweak}|{step}|{value}".encode()
    return int.from_bytes(hashlib.blake2b(data, digest_size=max(16, size.bit_length() // 8 + 8), key=key).digest() if size.bit_length() < 380 else hashlib.shake_256(key + data).digest(size.bit_length() // 8 + 8), "big") % size


def permute(key: bytes, tweak: str, value: int, size: int, allowed=None) -> int:
    """A keyed permutation of the numbers below size (of those that ``allowed`` accepts) that keeps none in its place.

    A Feistel network places all numbers on one circle; the next accepted number of the circle is the result. So a
    value that has another to change with never stays as it is.
    """
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    while True:
        left, right = divmod(value, a)
        for step in range(0, ROUNDS, 2):
            left = (left + _round(key, tweak, step, right, a)) % a
            right = (right + _round(key, tweak, step + 1, left, a)) % a
        left, right = divmod((left * a + right + 1) % (a * a), a)
        for step in range(ROUNDS - 2, -1, -2):
            right = (right - _round(key, tweak, step + 1, left, a)) % a
            left = (left - _round(key, tweak, step, right, a)) % a
        value = left * a + right
        if value < size and (allowed is None or allowed(value)):
            return value


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASS = {c: s for s in _CLASSES for c in s}


@lru_cache(10_000)
def _alphabet(c: str) -> str | None:
    """The characters that may take a letter's or a digit's place: those of its kind, outside ASCII also of its block of 256."""
    if c in _CLASS or not c.isalnum():
        return _CLASS.get(c)
    kind, block = unicodedata.category(c), ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(block, block + 256)) if x not in _CLASS and unicodedata.category(x) == kind)


def _by_place(key: bytes, tweak: str, text: str, alphabets) -> str:
    """Permute all texts with the same alphabets in the same places; other characters stay."""
    size, value = 1, 0
    for c, s in zip(text, alphabets, strict=True):
        if s:
            size, value = size * len(s), value * len(s) + s.index(c)
    value = permute(key, tweak + "".join("." if s else c for c, s in zip(text, alphabets, strict=True)) if len(text) < 200 else tweak, value, size)
    out = []
    for c, s in zip(reversed(text), reversed(alphabets), strict=True):
        if s:
            value, k = divmod(value, len(s))
            c = s[k]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(key: bytes, tweak: str, text: str) -> str:
    """Digits in their places; numbers with a valid check digit stay such numbers, others stay others."""
    digits = "".join(c for c in text if c.isdigit())
    if 13 <= len(digits) <= 19 and luhn(digits):
        body = f"{permute(key, tweak + 'luhn', int(digits[:-1]), 10 ** (len(digits) - 1)):0{len(digits) - 1}d}"
        made = next(body + c for c in "0123456789" if luhn(body + c))
    else:
        n = len(digits)
        made = f"{permute(key, f'{tweak}{n}', int(digits), 10**n, (lambda v: not luhn(f'{v:0{n}d}')) if 13 <= n <= 19 else None):0{n}d}"
    fresh = iter(made)
    return "".join(next(fresh) if c.isdigit() else c for c in text)


def _date(key: bytes, text: str) -> str | None:
    parts = re.split(r"[-/.]", text)
    ymd = "-" in text
    try:
        day = datetime.date(*map(int, parts if ymd else parts[::-1])).toordinal()
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None
    fresh = datetime.date.fromordinal(_FIRST + permute(key, "date", day - _FIRST, _LAST - _FIRST + 1))
    return fresh.strftime("%Y-%m-%d" if ymd else "%d/%m/%Y" if "/" in text else "%d.%m.%Y")


def _ip(key: bytes, text: str) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    value = permute(key, "ip", int.from_bytes(bytes(octets), "big"), 2**32)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _is_iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and _iban_rest(plain) == 1


def _iban(key: bytes, text: str) -> str | None:
    """The pseudonym of the longest valid number that begins here; words of letters after it may belong to the sentence."""
    ends = [len(text), *(k for k in range(len(text) - 1, 0, -1) if text[k] == " " and not re.search(r"\d", text[k:]))]
    end = next((k for k in ends if _is_iban(text[:k])), None)
    if end is None:
        return None
    plain = text[:end].replace(" ", "")
    body = _by_place(key, "iban", plain[4:], [_CLASS[c] for c in plain[4:]])
    made = plain[:2] + f"{98 - _iban_rest(plain[:2] + '00' + body):02d}" + body
    fresh = iter(made)
    return "".join(c if c == " " else next(fresh) for c in text[:end])


def _as_ascii(text: str) -> str:
    """Digits of all scripts as ASCII digits."""
    return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def _in_script(made: str, text: str) -> str:
    """Digits in the script of the digits in the same places of a text, or of its first digit where places differ."""
    first = next(c for c in text if c.isdecimal())
    other = [text[k] if len(text) >= len(made) and text[k].isdecimal() else first for k in range(len(made))]
    return "".join(chr(ord(o) - unicodedata.decimal(o) + int(c)) if c.isdecimal() else c for c, o in zip(made, other, strict=True))


@lru_cache(100_000)
def pseudonym(key: bytes, kind: str, text: str) -> str | None:
    """The value's pseudonym; None where it fails the rule of its kind.

    Equal numbers in digits of several scripts have equal pseudonyms, each in its own script.
    """
    plain = text if text.isascii() or kind == "email" else _as_ascii(text)
    made = _pseudonym(key, kind, plain)
    return made if made is None or plain == text else _in_script(made, text)


def _pseudonym(key: bytes, kind: str, text: str) -> str | None:
    if kind == "email":
        local, _, domain = text.partition("@")
        alphabets = [_alphabet(c) for c in local]
        return _by_place(key, "email", local, alphabets) + "@" + domain if any(alphabets) else None
    if kind == "secret":
        if not re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
            head = re.match(r"AKIA|ghp_|sk-", text).end()
            return text[:head] + _by_place(key, "secret", text[head:], [_CLASS[c] for c in text[head:]])
        return _by_place(key, "secret", text, ["0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"] * len(text))
    if kind in ("phone", "number"):
        head = re.match(r"\+\d{1,3}(?=[ .(-])", text)
        at = head.end() if head else 0
        return text[:at] + _digits(key, kind, text[at:])
    return {"date": _date, "ip": _ip, "iban": _iban}[kind](key, text)


def replace(key: bytes, text: str) -> tuple[str, list[dict]]:
    """The text with pseudonyms, and the places of what was found in the given text."""
    if not _WORTH.search(text):
        return text, []
    out, found, at, begin = [], [], 0, 0
    while m := _PATTERN.search(text, begin):
        kind = next(k for k in _KINDS if m.group(k) is not None)
        fresh = pseudonym(key, kind, m.group())
        if fresh is None:
            # what failed its rule may hide a value that begins later
            begin = m.start() + 1
            continue
        # an IBAN may end before the pattern does, and keeps its length
        begin = m.start() + len(fresh) if kind == "iban" else m.end()
        out += [text[at : m.start()], fresh]
        found.append({"kind": kind, "start": m.start(), "end": begin})
        at = begin
    return "".join([*out, text[at:]]), found


def _run(key: bytes):
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            made = [(None, []) if t is None else replace(key, t) for t in batch.column(1).to_pylist()]
            own = [batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], span)]
            yield pa.RecordBatch.from_arrays([*own, *batch.columns[2:]], names=["doc_id", "text", "found", *batch.schema.names[2:]])
            del made, own
        # a worker that is used again for other work begins small
        pseudonym.cache_clear()
        tidy()

    return run


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text with pseudonyms, found (array of kind, start, end in the given text) of every whole text.

    The columns named in ``keep`` are passed on as they are, so that no join has to bring them back.

    Found: e-mail addresses, dates, IPv4 addresses, IBANs, hexadecimal secrets of 32 to 128 digits and access keys of
    known beginnings, phone numbers with a country code or in national groups, card and account numbers of 13 to 19
    digits, and social security numbers. A value that is found is never left as it is, unless its format has no other
    value. ``key`` must stay secret and the same for texts that are to stay linked; it has at most 64 bytes. A null
    text stays null; an empty one has nothing; null ids and repeated rows pass through. Where two patterns could begin
    at one place, the first of the list above wins. Other columns are not read. No rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    schema = StructType.fromDDL("doc_id long, text string, found array<struct<kind:string,start:long,end:long>>")
    return rows.mapInArrow(_run(key), StructType([*schema.fields, *(rows.schema[c] for c in keep)]))
