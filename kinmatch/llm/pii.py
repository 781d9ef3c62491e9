"""Pseudonyms for personal data that keep its format.

Numbers and dates are validated (check digits, octets, calendar) and permuted inside the set of values of their own
format by a keyed Feistel network, walking its cycle until the result is valid again. What has more than 2^128 values, as
long secrets, is permuted as a list of symbols by a network whose halves are lists, in linear time at any length. Equal values therefore become
equal pseudonyms in every document and different values stay different, however they are punctuated; the same key
gives the same pseudonyms in every run, and nothing but the key is needed to make them.

Kinds: payment card numbers (Luhn), IBANs (modulo 97), IPv4 addresses, telephone numbers, social security numbers,
dates, e-mail addresses (local part and the labels before the last two), and secrets: access keys, and what follows
`token =`, `password=` and their like.

Defined results: null texts stay null, and empty ones empty. A text without personal data comes back unchanged. What
fails validation stays as it is. All other columns are kept, whatever their names: a count is left out where its column
is there already. Repeated rows each give a row, an empty table an empty one. A text of any length is read whole, in
time that grows with its length.
"""

from __future__ import annotations

import calendar
import hashlib
import hmac
import math
import re
import string
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinmatch.llm.common import map_slices, per_process

ROUNDS = 8
#: Formats with more values than this are permuted as lists of symbols.
NUMBERS = 1 << 128
KINDS = ("card", "iban", "ip", "phone", "ssn", "date", "email", "secret")
_DAY0, _DAYS = date(1900, 1, 1), (date(2099, 12, 31) - date(1900, 1, 1)).days + 1

#: A text without any of these has nothing to find: every kind holds a digit, an @ or an assignment.
_MAYBE = re.compile(r"[0-9@]|(?i:password|passwd|pwd|secret|token|api[_-]?key|AKIA|ASIA)")
_FIND = re.compile(
    # begun at the border of a run and never given back, so that a long run without an @ is read once
    r"(?<![A-Za-z0-9._%+-])(?P<lead>[._%+-]*+)(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,})"
    r"|(?P<assigned>(?i:\b(?:access[_-]?token|auth[_-]?token|api[_-]?key|apikey|token|secret|password|passwd|pwd)\b\s?[:=]\s?[\"']?))(?P<secret>[A-Za-z0-9+/_-]{8,})"
    r"|(?P<key>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)"
    r"|(?P<iban>\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b)"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))"
    r"|(?P<iso>(?<![\w-])[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![\w]|-[0-9]))"
    r"|(?P<dmy>(?<![\w.])[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}(?![\w]|[-.][0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w])|(?<![\w+])\+[0-9](?:[ .()-]?[0-9]){7,14}(?![\w]))"
    r"|(?P<card>(?<![\w])[0-9](?:[ -]?[0-9]){12,18}(?![\w]))"
)


class Permuter:
    """Keyed permutations, each named by a format: of the numbers below n, and of lists of symbols."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, name: bytes, i: int, half: int, n: int) -> int:
        said = hmac.new(self.key, b"%s/%d/%d/%d" % (name, n, i, half), hashlib.sha256).digest()
        return int.from_bytes(said, "big")

    def permute(self, name: bytes, value: int, n: int) -> int:
        """Alternating additions of a keyed function of the one half to the other, until the value is below n.

        A half has 64 bits at most, the function 256, so every sum is as good as evenly spread.
        """
        if n > NUMBERS:
            raise ValueError("larger values are permuted as lists of symbols")
        if n < 2:
            return value
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(value, b)
            for i in range(ROUNDS):
                if i % 2:
                    right = (right + self._round(name, i, left, n)) % b
                else:
                    left = (left + self._round(name, i, right, n)) % a
            value = left * b + right
            if value < n:
                return value

    def permute_symbols(self, name: bytes, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each position a number below its size. The halves are lists; 64 bits are added for every position of one."""
        half = len(values) // 2
        parts, moduli = [values[:half].astype(np.uint64), values[half:].astype(np.uint64)], [sizes[:half].astype(np.uint64), sizes[half:].astype(np.uint64)]
        for i in range(ROUNDS):
            to = i % 2
            said = hmac.new(self.key, b"%s/list/%d/%d/" % (name, len(values), i) + parts[1 - to].astype(np.uint8).tobytes(), hashlib.sha256).digest()
            added = np.frombuffer(hashlib.shake_256(said).digest(8 * len(parts[to])), "<u8")
            parts[to] = (parts[to] + added % moduli[to]) % moduli[to]
        return np.concatenate(parts).astype(np.int64)


def luhn(digits: str) -> int:
    total = 0
    for i, x in enumerate(reversed(digits)):
        d = int(x) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def iban_remainder(compact: str) -> int:
    return int("".join(str(int(x, 36)) for x in compact[4:] + compact[:4])) % 97


class Pseudonyms:
    """replace() gives a text's pseudonymous form and how many values of each kind it had."""

    def __init__(self, key: str):
        self.feistel = Permuter(key.encode())

    def _classes(self, name: str, text: str) -> str:
        """Permutes the letters and digits of a text, each inside its class; all else stays."""
        hexadecimal = len(text) >= 16 and re.fullmatch(r"[0-9a-f]+", text) is not None and not text.isdigit()
        sets = [string.hexdigits[:16]] if hexadecimal else [string.digits, string.ascii_lowercase, string.ascii_uppercase]
        place = {x: (s, k) for s in sets for k, x in enumerate(s)}
        at = [k for k, x in enumerate(text) if x in place]
        own = [place[text[k]] for k in at]
        sizes = [len(s) for s, _ in own]
        shape = hashlib.sha256(",".join(f"{len(place[x][0])}" if x in place else x for x in text).encode()).hexdigest()
        format_name, n = f"{name}:{shape}".encode(), math.prod(sizes) if len(sizes) < 100 else NUMBERS + 1
        if n > NUMBERS:
            values = self.feistel.permute_symbols(format_name, np.array([k for _, k in own]), np.array(sizes)).tolist()
        else:
            value, values = 0, []
            for (_, k), size in zip(own, sizes):
                value = value * size + k
            value = self.feistel.permute(format_name, value, n)
            for size in reversed(sizes):
                value, k = divmod(value, size)
                values.append(k)
            values.reverse()
        out = list(text)
        for k, (s, _), v in zip(at, own, values):
            out[k] = s[v]
        new = "".join(out)
        # digits alone are another format
        return self._classes(name, new) if hexadecimal and new.isdigit() else new

    @staticmethod
    def _refill(text: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if x.isdigit() else x for x in text)

    def card(self, text: str) -> str | None:
        digits = "".join(filter(str.isdigit, text))
        if luhn(digits) or not digits.strip("0"):
            return None
        # the first digit, the scheme's, stays; the last one follows from the others
        n = len(digits) - 2
        body = digits[0] + str(self.feistel.permute(b"card%d%s" % (n, digits[0].encode()), int(digits[1:-1]), 10**n)).zfill(n)
        return self._refill(text, body + str(-luhn(body + "0") % 10))

    def iban(self, text: str) -> str | None:
        compact = text.replace(" ", "")
        if not 15 <= len(compact) <= 34 or iban_remainder(compact) != 1:
            return None
        body = self._classes("iban" + compact[:2], compact[4:])
        check = 98 - iban_remainder(compact[:2] + "00" + body)
        it = iter(f"{compact[:2]}{check:02d}{body}")
        return "".join(x if x == " " else next(it) for x in text)

    def ip(self, text: str) -> str | None:
        octets = [int(x) for x in text.split(".")]
        if max(octets) > 255:
            return None
        value = self.feistel.permute(b"ip", int.from_bytes(bytes(octets), "big"), 1 << 32)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def phone(self, text: str) -> str | None:
        digits = "".join(filter(str.isdigit, text))
        if not 7 <= len(digits) <= 15:
            return None
        country = len(re.match(r"\+([0-9]*)", text).group(1)) if re.match(r"\+[0-9]{1,3}[ .(-]", text) else 0
        own = digits[country:]
        return self._refill(text, digits[:country] + str(self.feistel.permute(b"phone%d" % len(own), int(own), 10 ** len(own))).zfill(len(own)))

    def ssn(self, text: str) -> str | None:
        def valid(v: int) -> bool:
            area, group, serial = v // 1_000_000, v // 10_000 % 100, v % 10_000
            return 0 < area < 900 and area != 666 and group > 0 and serial > 0

        value = int(text.replace("-", ""))
        if not valid(value):
            return None
        while True:
            value = self.feistel.permute(b"ssn", value, 10**9)
            if valid(value):
                return f"{value // 1_000_000:03d}-{value // 10_000 % 100:02d}-{value % 10_000:04d}"

    def _day(self, year: int, month: int, day: int) -> date | None:
        if not (1900 <= year <= 2099 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
            return None
        return _DAY0 + timedelta(self.feistel.permute(b"date", (date(year, month, day) - _DAY0).days, _DAYS))

    @staticmethod
    def _like(number: int, text: str) -> str:
        return str(number).zfill(2) if len(text) == 2 else str(number)

    def iso(self, text: str) -> str | None:
        y, s1, m, s2, d = re.split(r"([-/.])", text)
        if s1 != s2 or (to := self._day(int(y), int(m), int(d))) is None:
            return None
        wide = "00" if len(m) == 2 and len(d) == 2 else "0"
        return f"{to.year}{s1}{self._like(to.month, wide)}{s1}{self._like(to.day, wide)}"

    def dmy(self, text: str) -> str | None:
        a, s1, b, s2, y = re.split(r"([-/.])", text)
        if s1 != s2:
            return None
        day_first = int(b) <= 12
        to = self._day(int(y), int(b), int(a)) if day_first else self._day(int(y), int(a), int(b))
        if to is None:
            return None
        wide = "00" if len(a) == 2 and len(b) == 2 else "0"
        first, second = (to.day, to.month) if day_first else (to.month, to.day)
        return f"{self._like(first, wide)}{s1}{self._like(second, wide)}{s1}{to.year}"

    def email(self, text: str) -> str:
        local, _, domain = text.rpartition("@")
        labels = domain.split(".")
        head = ".".join(labels[:-2])
        mixed = self._classes("email", f"{local}@{head}" if head else local)
        return mixed + ("." if head else "@") + ".".join(labels[-2:])

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        found = dict.fromkeys(KINDS, 0)

        def change(m: re.Match) -> str:
            kind = m.lastgroup
            if kind == "email":
                found["email"] += 1
                return m["lead"] + self.email(m["email"])
            if kind == "secret":
                found["secret"] += 1
                return m["assigned"] + self._classes("secret", m["secret"])
            if kind == "key":
                found["secret"] += 1
                return m["key"][:4] + self._classes("key", m["key"][4:])
            new = getattr(self, kind)(m[kind])
            if new is None:
                # a longer kind took the place of a shorter one that may be valid
                if kind in ("iban", "phone") and (digits := "".join(filter(str.isdigit, m[0]))) and 13 <= len(digits) <= 19 and re.fullmatch(r"[0-9 -]+", m[0]) and (new := self.card(m[0])):
                    kind = "card"
                else:
                    return m[0]
            found["date" if kind in ("iso", "dmy") else kind] += 1
            return new

        return _FIND.sub(change, text), found


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """The frame with pseudonyms in its text, and with counts one column pii_<kind> for each kind that it does not have."""
    own = per_process(lambda: Pseudonyms(key))
    new = [f"pii_{k}" for k in KINDS if f"pii_{k}" not in docs.columns] if counts else []
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"{x} int" for x in new])

    def change(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, rows = part.column(text_col).to_pylist(), {}
        for at, text in enumerate(texts):
            if text and _MAYBE.search(text):
                texts[at], found = own().replace(text)
                if any(found.values()):
                    rows[at] = found
        cols = [pa.array(texts, pa.string()) if name == text_col else part.column(name) for name in part.schema.names]
        cols += [pa.array([rows[at][x[4:]] if at in rows else 0 for at in range(len(texts))], pa.int32()) for x in new]
        return pa.record_batch(cols, names=[*part.schema.names, *new])

    return map_slices(docs, change, schema, text_col)
