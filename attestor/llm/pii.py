"""Format-preserving pseudonyms for personal data and secrets."""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
#: The session setting that holds the key.
KEY_SETTING = "spark.attestor.pii.key"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX = "0123456789abcdef"

#: Names of the months in written dates (fixed values).
_MONTHS = "January February March April May June July August September October November December".split()
_PATTERN = re.compile(
    r"""(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)
    |(?P<secret>(?<![\w])(?:AKIA|ASIA)[0-9A-Z]{16}(?![\w])|(?<![\w])[0-9a-f]{32,}(?![\w])
      |(?<![\w])(?:gh[pousr]_|github_pat_|(?:sk|pk|rk)_(?:live|test)_|sk-|glpat-|xox[abprs]-|AIza)[A-Za-z0-9_-]{16,}(?![\w])
      |(?<![\w])(?:password|passwd|pwd)=[^\s"',;]+
      |(?<![\w])(?i:api[_-]?key|access[_-]?key|secret[_-]?key|client[_-]?secret|auth[_-]?token|access[_-]?token|secret|token)["']?\s?[=:]\s?["']?(?=[^\s"',;]*\d)[^\s"',;]{8,})
    |(?P<iban>(?<![\w])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![\w]))
    |(?P<ipv6>(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d))
    |(?P<written>(?<![\w])(?:\d{1,2}[ ](?:%(months)s)[ ]\d{4}|(?:%(months)s)[ ]\d{1,2},[ ]\d{4})(?![\w]))
    |(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))
    |(?P<date>(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?:(?=T\d{2}:?\d{2})|(?![\w/-]|\.\d)))
    |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
    |(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?P<s4>[ -])\d{4}(?P=s4)\d{4}(?P=s4)\d{4}|\d{4}(?P<s6>[ -])\d{6}(?P=s6)\d{5})(?![\w-]))
    |(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})|\(\d{3}\))(?:[ .-]?\d{2,4}){2,4}(?![\w-])|(?<![\w+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"""
    % {"months": "|".join([*_MONTHS, *(m[:3] for m in _MONTHS)])},
    re.VERBOSE,
)
_ANY = re.compile(r"[0-9@=]")


class Permuter:
    """Keyed permutations of strings that keep every character in its alphabet; ``back`` undoes them.

    A Feistel network orders the domain at random and every value goes to the next
    in that order, so no value stays as it is, however small the domain.
    """

    def __init__(self, key: bytes, back: bool = False):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.step = -1 if back else 1

    def _draw(self, tweak: bytes, round_: int, value: int, below: int) -> int:
        message = b"%b|%d|%d|%d" % (tweak, round_, below, value)
        return int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=32).digest()[: 16 + below.bit_length() // 8], "big") % below

    def number(self, value: int, left: int, right: int, tweak: bytes) -> int:
        """A permutation of 0 .. left * right - 1: an alternating Feistel network on (value div right, value mod right), one place on, and back."""
        a, b = divmod(value, right)
        for k in range(0, ROUNDS, 2):
            a = (a + self._draw(tweak, k, b, left)) % left
            b = (b + self._draw(tweak, k + 1, a, right)) % right
        a, b = divmod((a * right + b + self.step) % (left * right), right)
        for k in range(ROUNDS - 2, -1, -2):
            b = (b - self._draw(tweak, k + 1, a, right)) % right
            a = (a - self._draw(tweak, k, b, left)) % left
        return a * right + b

    def below(self, value: int, n: int, tweak: bytes) -> int:
        """A permutation of 0 .. n - 1 by cycle walking."""
        side = 1
        while side * side < n:
            side += side
        while True:
            value = self.number(value, side, side, tweak)
            if value < n:
                return value

    def characters(self, text: str, tweak: bytes, alphabets: tuple[str, ...] = (_DIGITS, _LOWER, _UPPER)) -> str:
        """Characters of the alphabets are permuted as one mixed-radix number; others stay."""
        places = [(i, a) for i, c in enumerate(text) for a in alphabets if c in a]
        if not places:
            return text
        half = len(places) // 2
        radix = [len(a) for _, a in places]
        left = right = 1
        for r in radix[:half]:
            left *= r
        for r in radix[half:]:
            right *= r
        value = 0
        for (i, a), r in zip(places, radix):
            value = value * r + a.index(text[i])
        shape = "".join("d" if c in _DIGITS else "l" if c in _LOWER else "u" if c in _UPPER else c for c in text)
        value = self.number(value, left, right, tweak + shape.encode() if len(alphabets) == 3 else tweak + b"%d" % len(places))
        out = list(text)
        for i, a in reversed(places):
            value, digit = divmod(value, len(a))
            out[i] = a[digit]
        return "".join(out)


def luhn_ok(digits: str) -> bool:
    """Check sum of payment card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _with_digits(text: str, digits: str) -> str:
    source = iter(digits)
    return "".join(next(source) if c in _DIGITS else c for c in text)


def _card(text: str, p: Permuter) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not luhn_ok(digits) or not digits.strip("0"):
        return None
    body = p.characters(digits[:-1], b"card")
    check = next(c for c in _DIGITS if luhn_ok(body + c))
    return _with_digits(text, body + check)


def _phone(text: str, p: Permuter) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    head = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    prefix = head.group() if head else ""
    known = len(re.sub(r"\D", "", prefix))
    return prefix + _with_digits(text[len(prefix) :], p.characters(digits[known:], b"phone" + digits[:known].encode()))


def _ip(text: str, p: Permuter) -> str | None:
    parts = text.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    return str(ipaddress.IPv4Address(p.number(int(ipaddress.IPv4Address(text)), 65536, 65536, b"ip")))


_EPOCH = datetime.date(1900, 1, 1)
_DAYS = (datetime.date(2100, 1, 1) - _EPOCH).days


def _date(text: str, p: Permuter) -> str | None:
    """Dates from 1900 to 2099; with slashes month first if that is a date, else day first; with dots day first."""
    cut = "-" if "-" in text else "/" if "/" in text else "."
    parts = [int(x) for x in text.split(cut)]
    orders = [(0, 1, 2)] if cut == "-" else [(2, 0, 1), (2, 1, 0)] if cut == "/" else [(2, 1, 0)]
    for order in orders:
        try:
            day = (datetime.date(*(parts[i] for i in order)) - _EPOCH).days
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            return None
        new = _EPOCH + datetime.timedelta(p.below(day, _DAYS, b"date"))
        values = dict(zip(order, (new.year, new.month, new.day)))
        while cut == "/" and order == (2, 1, 0) and new.day <= 12:  # it must still read day first
            new = _EPOCH + datetime.timedelta(p.below((new - _EPOCH).days, _DAYS, b"date"))
            values = dict(zip(order, (new.year, new.month, new.day)))
        padded = any(len(x) == 2 and x[0] == "0" for x in text.split(cut)) or cut == "-"
        return cut.join(f"{values[i]:02d}" if padded else str(values[i]) for i in range(3))
    return None


def _ssn_ok(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def _ssn(text: str, p: Permuter) -> str | None:
    digits = text.replace("-", "")
    if not _ssn_ok(digits):
        return None
    digits = p.characters(digits, b"ssn")
    while not _ssn_ok(digits):
        digits = p.characters(digits, b"ssn")
    return _with_digits(text, digits)


def _iban_check(country: str, body: str) -> str:
    digits = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(digits) % 97:02d}"


#: Length of the bank numbers of each country (the registry's fixed values); other countries are judged by mod 97 alone.
_IBAN_LENGTHS = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}


def _iban_end(text: str) -> int | None:
    """Where the bank number that a match begins with ends: at its country's length, else with the match or, for countries not listed, at a group before, if mod 97 holds."""
    ends = [i + 1 for i, c in enumerate(text) if c != " " and (i + 1 == len(text) or text[i + 1] == " ")][::-1]
    length = _IBAN_LENGTHS.get(text[:2])
    own = [e for e in ends if e - text.count(" ", 0, e) == length]
    for end in own + ends[:1] if length else ends:
        plain = text[:end].replace(" ", "")
        if 15 <= len(plain) <= 34 and _iban_check(plain[:2], plain[4:]) == plain[2:4]:
            return end
    return None


def _iban(text: str, p: Permuter) -> str | None:
    """The bank number at the head of ``text``; words that the pattern took along stay as they are."""
    end = _iban_end(text)
    if end is None:
        return None
    plain = text[:end].replace(" ", "")
    body = p.characters(plain[4:], b"iban" + plain[:2].encode())
    new = iter(plain[:2] + _iban_check(plain[:2], body) + body)
    return "".join(c if c == " " else next(new) for c in text[:end])


def _caseless(text: str, p: Permuter, tweak: bytes) -> str:
    """Digits and letters permuted alike in either case; the places of capitals stay."""
    new = p.characters(text.lower(), tweak, (_DIGITS, _LOWER))
    return "".join(n.upper() if c.isupper() else n for c, n in zip(text, new))


def _email(text: str, p: Permuter) -> str:
    """The name before the at sign, and the domain but for its last label, in either case alike."""
    local, _, domain = text.partition("@")
    name, _, top = domain.rpartition(".")
    return _caseless(local, p, b"email") + "@" + _caseless(name, p, b"domain") + "." + top


def _secret(text: str, p: Permuter) -> str:
    if re.fullmatch(r"[0-9a-f]+", text):
        return p.characters(text, b"hex", (_HEX,))
    head = re.match(r"AKIA|ASIA|gh[pousr]_|github_pat_|(?:sk|pk|rk)_(?:live|test)_|sk-|glpat-|xox[abprs]-|AIza", text) or re.match(r"""[A-Za-z_-]+["']?\s?[=:]\s?["']?""", text)
    cut = head.end() if head else 0
    if text[:4] in ("AKIA", "ASIA"):
        return text[:4] + p.characters(text[4:], b"key", (_DIGITS + _UPPER,))
    return text[:cut] + p.characters(text[cut:], b"password")


def _ipv6(text: str, p: Permuter) -> str | None:
    try:
        value = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    return str(ipaddress.IPv6Address(p.number(value, 1 << 64, 1 << 64, b"ipv6"))) if value > 1 else None


def _written(text: str, p: Permuter) -> str | None:
    """Dates with the month's name, in the order and length of name they had."""
    parts = text.replace(",", "").split(" ")
    first = parts[0].isdigit()
    name = parts[1 if first else 0]
    month = next(i for i, m in enumerate(_MONTHS) if m.startswith(name[:3]))
    try:
        day = (datetime.date(int(parts[2]), month + 1, int(parts[0 if first else 1])) - _EPOCH).days
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None
    new = _EPOCH + datetime.timedelta(p.below(day, _DAYS, b"date"))
    said = _MONTHS[new.month - 1] if len(name) > 3 or name == "May" else _MONTHS[new.month - 1][:3]
    return f"{new.day} {said} {new.year}" if first else f"{said} {new.day}, {new.year}"


_KINDS: dict[str, Callable[[str, Permuter], str | None]] = {"email": _email, "secret": _secret, "iban": _iban, "ipv6": _ipv6, "written": _written, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonymize(text: str | None, p: Permuter) -> tuple[str | None, list[str]]:
    """The text with every validated value replaced, and the kinds found in order."""
    if not text or not _ANY.search(text):
        return text, []
    found: list[str] = []
    out: list[str] = []
    done = 0
    while m := _PATTERN.search(text, done):
        kind = next(k for k in _KINDS if m.group(k) is not None)
        value = m.group()
        if kind == "iban":  # what the pattern took along is searched again, and so is all behind the head of what fails
            end = _iban_end(value)
            value = value[: value.find(" ") if " " in value else len(value)] if end is None else value[:end]
        new = _KINDS[kind](value, p)
        if new is not None:
            found.append(kind)
        out += [text[done : m.start()], value if new is None else new]
        done = m.start() + len(value)
    out.append(text[done:])
    return "".join(out), found


def secret_key(spark: SparkSession) -> bytes:
    """The key that the session names in KEY_SETTING; where it names none, a fresh one, whose pseudonyms link inside one result only."""
    named = spark.conf.get(KEY_SETTING, None)
    return named.encode() if named else secrets.token_bytes(32)


def pseudonyms(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with its text pseudonymised, ``n_values`` (long) and ``kinds`` (sorted, distinct).

    Card and bank numbers that pass their check sums, valid dates, internet addresses of both kinds,
    telephone and social security numbers, mail addresses (domains too) and secrets are replaced by
    keyed Feistel permutations within their format, and none stays what it was: equal values give equal
    pseudonyms in all documents, and check sums hold again.  Numbers that fail validation
    stay.  Null stays null, empty stays empty; other columns pass; columns named n_values or kinds give way.
    """
    kept = [c for c in docs.columns if c not in ("n_values", "kinds")]
    at = kept.index(text)
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("long").alias("n_values"), F.array().cast("array<string>").alias("kinds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permuter(key)
        for batch in batches:
            done = [pseudonymize(x, p) for x in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([x for x, _ in done], pa.string())
            columns[-2] = pa.array([len(k) for _, k in done], pa.int64())
            columns[-1] = pa.array([sorted(set(k)) for _, k in done], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return out.mapInArrow(run, out.schema)
