"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets, by a keyed Feistel permutation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, documents

DEMO_KEY = b"tidepress demonstration key"
ROUNDS = 8


class Permutation:
    """Keyed bijections of 0..size-1 without fixed points, one for each tweak (the kind and format of a value).

    A Feistel network on pairs (left, right) of a near-square grid covers the range; values outside it walk on to the
    next. To leave no value in its place the permutation E is used as x -> E^-1(E(x) + 1).
    """

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mix(self, tweak: str, turn: int, value: int) -> int:
        data = f"{tweak}|{turn}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=64).digest(), "big")

    def _pass(self, tweak: str, x: int, a: int, b: int, back: bool) -> int:
        left, right = divmod(x, b)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if turn % 2:
                right = (right + (-1 if back else 1) * self._mix(tweak, turn, left)) % b
            else:
                left = (left + (-1 if back else 1) * self._mix(tweak, turn, right)) % a
        return left * b + right

    def _walk(self, tweak: str, x: int, size: int, back: bool) -> int:
        b = isqrt(size - 1) + 1
        a = -(-size // b)
        while True:
            x = self._pass(tweak, x, a, b, back)
            if x < size:
                return x

    def __call__(self, tweak: str, x: int, size: int) -> int:
        if size < 2:
            return x
        return self._walk(tweak, (self._walk(tweak, x, size, False) + 1) % size, size, True)


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_HEX = {c: s for s in ("0123456789abcdef", "0123456789ABCDEF") for c in s}


def _alphabets(text: str, hexa: bool = False) -> list[str]:
    """The set of each character that is permuted; marks and other letters are kept."""
    if hexa:
        upper = any(c in "ABCDEF" for c in text)
        return ["0123456789ABCDEF" if upper else "0123456789abcdef" if c in _HEX else "" for c in text]
    return [_DIGITS if c in _DIGITS else _LOWER if c in _LOWER else _UPPER if c in _UPPER else "" for c in text]


def _mixed(permute: Permutation, kind: str, text: str, hexa: bool = False) -> str:
    """Permutes all permutable characters together, as one number of mixed radix."""
    sets = _alphabets(text, hexa)
    x = 0
    for c, s in zip(text, sets, strict=True):
        if s:
            x = x * len(s) + s.index(c)
    shape = "".join(s[:1] or c for c, s in zip(text, sets, strict=True))
    x = permute(f"{kind}|{shape}", x, prod(len(s) for s in sets if s))
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if sets[i]:
            x, r = divmod(x, len(sets[i]))
            out[i] = sets[i][r]
    return "".join(out)


def _fill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _card(permute: Permutation, text: str) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = digits[:-1]
    new = str(permute(f"card|{len(body)}", int(body), 10 ** len(body))).zfill(len(body))
    return _fill(text, new + luhn_digit(new))


def _phone(permute: Permutation, text: str) -> str | None:
    m = re.match(r"\+\d{1,3}(?=[ .(-])|\+1", text)
    head = m[0] if m else "+" if text[0] == "+" else ""
    rest = text[len(head) :]
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) <= 14:
        return None
    return head + _fill(rest, str(permute(f"phone|{head}|{len(digits)}", int(digits), 10 ** len(digits))).zfill(len(digits)))


def _ip(permute: Permutation, text: str) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = permute("ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(permute: Permutation, text: str) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    d = text.replace("-", "")
    if not valid(d):
        return None
    while True:  # on to the next valid number of the cycle: still a bijection of valid numbers
        d = str(permute("ssn", int(d), 10**9)).zfill(9)
        if valid(d):
            return _fill(text, d)


def _iban(permute: Permutation, text: str) -> str | None:
    def rest(s: str) -> int:
        return int("".join(str(int(c, 36)) for c in s)) % 97

    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or rest(plain[4:] + plain[:4]) != 1:
        return None
    body = _mixed(permute, f"iban|{plain[:2]}", plain[4:])
    new = iter(plain[:2] + f"{98 - rest(body + plain[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


_FIRST, _DAYS = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal() - date(1900, 1, 1).toordinal() + 1
_DATES = {"-": "ymd", "/": "mdy", ".": "dmy"}


def _date(permute: Permutation, text: str) -> str | None:
    """Dates of 1900 to 2099, written y-m-d, m/d/y (d/m/y where only that is a date) or d.m.y, each with two-digit day and month."""
    mark = "-" if text[4] == "-" else text[2]
    parts = list(map(int, text.split(mark)))
    for order in {"-": ("ymd",), "/": ("mdy", "dmy"), ".": ("dmy",)}[mark]:
        at = dict(zip(order, parts, strict=True))
        try:
            x = date(at["y"], at["m"], at["d"]).toordinal() - _FIRST
        except ValueError:
            continue
        if not 0 <= x < _DAYS:
            return None
        ambiguous = mark == "/" and max(parts[:2]) <= 12
        while True:  # an unambiguous day stays so, and an ambiguous one too: the format stays readable in one way
            x = permute(f"date|{order}|{mark}", x, _DAYS)
            d = date.fromordinal(_FIRST + x)
            if mark != "/" or (d.day <= 12) == ambiguous:
                break
        new = {"y": f"{d.year:04d}", "m": f"{d.month:02d}", "d": f"{d.day:02d}"}
        return mark.join(new[c] for c in order)
    return None


def _email(permute: Permutation, text: str) -> str | None:
    local, _, domain = text.partition("@")
    new = _mixed(permute, f"email|{domain.lower()}", local)
    if new == local:  # nothing that can be permuted before the @
        new = _mixed(permute, "email-odd", "user" + hashlib.blake2b(local.encode(), key=permute.key, digest_size=6).hexdigest())
    return f"{new}@{domain}"


def _secret(permute: Permutation, text: str) -> str | None:
    hexa = all(c in _HEX for c in text) and not (re.search("[a-f]", text) and re.search("[A-F]", text))
    return _mixed(permute, "secret-hex" if hexa else "secret", text, hexa)


#: Kind, expression, pseudonym (None: not valid, left as it is). Earlier kinds win over later ones at the same place.
KINDS: list[tuple[str, str, Callable]] = [
    ("secret", r"(?i:(?<![a-z])(?:[a-z]+[_-])?(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,4}[:=]\s{0,4}[\"']?)(?P<secret>[A-Za-z0-9_+/=.-]{8,})", _secret),
    ("email", r"(?P<email>(?<![\w.%+-])[\w.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})", _email),
    ("date", r"(?P<date>(?<![\w./-])(?:\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})(?![\w/-]|\.\d))", _date),
    ("ip", r"(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))", _ip),
    ("iban", r"(?P<iban>(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))", _iban),
    ("ssn", r"(?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))", _ssn),
    ("card", r"(?P<card>(?<![\w.])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{4}(?P<gap2>[ -])\d{6}(?P=gap2)\d{5})(?!\w))", _card),
    ("phone", r"(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)|\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\w)|\+\d{9,14}(?!\w))", _phone),
]
_ANY = re.compile("|".join(x for _, x, _ in KINDS))
_SOME = re.compile("[0-9@=:]").search
_MAKE = {name: make for name, _, make in KINDS}


class Pseudonymiser:
    """apply(text) gives the text with every valid value replaced, and (kind, start, end in the new text) of each.

    A value's pseudonym depends on the key, its kind and the value alone, so equal values stay equal everywhere and
    different values stay different; it has the same format and passes the same checks (Luhn, mod 97, calendar).
    """

    def __init__(self, key: bytes = DEMO_KEY):
        self.permute = Permutation(key)
        self.known = lru_cache(1 << 16)(lambda kind, value: _MAKE[kind](self.permute, value))

    def apply(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        if not text or not _SOME(text):
            return text, []
        out, spans, at, size, look = [], [], 0, 0, 0
        while m := _ANY.search(text, look):
            kind = next(k for k in _MAKE if m[k] is not None)
            a, b = m.span(kind)
            new = self.known(kind, m[kind])
            if new is None:
                look = min(x for x in (self._next(text, a, b), b) if x > a)
                continue
            out += [text[at:a], new]
            size += a - at
            spans.append((kind, size, size + len(new)))
            size, at, look = size + len(new), b, b
        return "".join([*out, text[at:]]), spans

    @staticmethod
    def _next(text: str, a: int, b: int) -> int:
        """Where to look again after an invalid value: behind its first blank, if it has one."""
        gap = text.find(" ", a, b)
        return gap + 1 if gap > 0 else b


def pseudonymise(spark: SparkSession, docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """doc_id, text, spans (kind, start, end in code points of the new text). Null text stays null, with no spans.

    Other columns play no part; null and repeated doc_ids are rows like any others.
    """
    bound_batches(spark)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Pseudonymiser(key)
        for batch in batches:
            done = [make.apply(t) for t in batch.column(1).to_pylist()]
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(spans, kind)], ["doc_id", "text", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, spans array<struct<kind:string,start:int,end:int>>")


def with_pseudonyms(spark: SparkSession, docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """docs with pseudonyms in text, and n_chars of the new text where there is such a column; all else as it is."""
    bound_batches(spark)
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Pseudonymiser(key)
        for batch in batches:
            texts = [make.apply(t)[0] for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if count >= 0:
                columns[count] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(spark, documents(spark, sf_dir)).selectExpr("doc_id", "text", "size(spans) AS n_values", "array_join(transform(spans, s -> s.kind), ',') AS kinds")
