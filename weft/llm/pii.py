"""Format-preserving pseudonyms for personal data.

Validated numbers and dates are permuted within their own format by a keyed
Feistel network, so equal values get equal pseudonyms in every document, others
others, and the text keeps its form:

* payment cards and other long numbers: the digits before the check digit are
  permuted. A number that passes the Luhn check passes it afterwards, one that
  doesn't, doesn't; so the two kinds stay apart and the map is one to one.
* phone numbers: the digits after the country code, grouping kept.
* IPv4 addresses: the 32 bits, leading networks of private use among themselves.
* IBANs: the account's letters and digits, each within its class, with new check digits.
* social security numbers: the valid ones among themselves (area 001 to 899 but
  666, group 01 to 99, serial 0001 to 9999), and so those of areas 900 to 999
  with groups 50 to 99, which taxpayers have; others aren't such numbers and stay.
* dates: days from 1900-01-01 to 2099-12-31, in the format found.
* e-mail addresses: letters, digits and accents of the local part, each within its
  class, and the domain's name likewise, but for reserved example domains. A class
  is a script's letters of one case, or what comes near it: those of one category
  in one 128th of the code points' pages. All of a part is permuted together, in
  chunks where it is long, each of which depends on all others.

Permutations over domains that aren't powers of two walk the cycle until they
are back inside, which keeps them one to one. Operators need a key. The query and
the pipeline take the session's ``weft.pii.secret``; where that is unset, one is
drawn at random for the session, so pseudonyms are linked within it only and
nothing that is published leads back.

Defined cases: null texts stay null, empty ones empty; equal rows stay equal;
other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
import unicodedata
from collections.abc import Iterator
from datetime import date, timedelta
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weft.llm.common import in_workers, sliced, table

KEY_SETTING = "weft.pii.secret"
ROUNDS = 8
#: Characters of an address that are permuted together.
CHUNK = 48

#: Letters and digits that are permuted among themselves.
CLASSES = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)
_PLAIN = {c: k for k in CLASSES for c in k}


@cache
def class_of(c: str) -> str:
    """The characters that ``c`` may become; itself alone where it is no letter, mark or digit."""
    if c in _PLAIN:
        return _PLAIN[c]
    kind = unicodedata.category(c)
    if kind[0] not in "LMN":
        return c
    return _page(ord(c) >> 7, kind) if len(_page(ord(c) >> 7, kind)) > 1 else _lone(kind)


@cache
def _page(page: int, kind: str) -> str:
    found = map(chr, range(page << 7, (page + 1) << 7))
    return "".join(c for c in found if unicodedata.category(c) == kind and c not in _PLAIN)


@cache
def _lone(kind: str) -> str:
    """Characters that are the only ones of their category in their page."""
    return "".join(p for page in range(0x110000 >> 7) if len(p := _page(page, kind)) == 1)


# Fixed patterns, by kind; the first kind that matches a place and validates takes it.
EMAIL = r"(?P<email>(?<![\w\u0300-\u036f.+-])\w[\w\u0300-\u036f.+-]*@[\w\u0300-\u036f-]+(?:\.[\w\u0300-\u036f-]+)+)"
IBAN = r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w))"
IP = r"(?P<ip>(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d))"
DATE = r"(?P<date>(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/]|[.-]\d))"
SSN = r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
PHONE = r"(?P<phone>(?<!\w)(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{2,4}\)[\x20.-]?)\d{3,4}[\x20.-]?\d{3,4}(?!\w)|(?<!\w)\+\d{1,3}(?:[\x20.-]?\d{2,4}){2,4}(?!\w)|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]))"
NUMBER = r"(?P<number>(?<![\w.])\d(?:[\x20-]?\d){12,18}(?!\w))"
PATTERN = re.compile("|".join((EMAIL, IBAN, IP, DATE, SSN, PHONE, NUMBER)))
#: What every match has: a digit beside one of these, or an at sign. Texts without are not scanned.
_LIKELY = re.compile(r"@|\d[\d\x20./()-]{5}")

EPOCH, LAST = date(1900, 1, 1), date(2099, 12, 31)


class Feistel:
    """Keyed permutations of 0..n-1."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, what: bytes, n: int, i: int, right: int, bits: int) -> int:
        size = (bits + 7) // 8
        data = b"%s|%d|%d|" % (what, n.bit_length(), i) + right.to_bytes(size, "big") + n.to_bytes((n.bit_length() + 7) // 8, "big")
        # as many blocks as the half is wide, so that all its bits are mixed
        blocks = [hmac.digest(self.key, b"%d|" % k + data, "sha256") for k in range(-(-size // 32))]
        return int.from_bytes(b"".join(blocks)[:size], "big") & ((1 << bits) - 1)

    def permuted(self, value: int, n: int, what: bytes, back: bool = False) -> int:
        """``value`` in the permutation of 0..n-1 that is named ``what``; or its original."""
        if n < 2:
            return value
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:  # walk the cycle of the power of two back into the domain
            left, right = value >> half, value & mask
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = right ^ self._round(what, n, i, left, half), left
                else:
                    left, right = right, left ^ self._round(what, n, i, right, half)
            value = left << half | right
            if value < n:
                return value


def luhn_digit(digits: str) -> int:
    """The digit that completes ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def into(form: str, digits: str) -> str:
    """``form`` with its digits replaced, one by one."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


class Pseudonyms:
    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.of = lru_cache(100_000)(self._of)

    def digits(self, s: str, what: bytes) -> str:
        return str(self.feistel.permuted(int(s), 10 ** len(s), what + b"%d" % len(s))).zfill(len(s)) if s else s

    def number(self, form: str) -> str:
        s = re.sub(r"\D", "", form)
        body, check = s[:-1], int(s[-1])
        new = self.digits(body, b"number")
        # the distance from the right check digit stays, and so does passing the check
        return into(form, new + str((luhn_digit(new) + check - luhn_digit(body)) % 10))

    def phone(self, form: str) -> str:
        m = re.match(r"\+\d{1,3}(?=[\x20.(-])", form)
        head = m[0] if m else ""
        rest = form[len(head) :]
        return head + into(rest, self.digits(re.sub(r"\D", "", rest), b"phone"))

    def ssn(self, form: str) -> str | None:
        area, group, serial = map(int, form.split("-"))
        if area >= 900 and group >= 50:
            value = self.feistel.permuted(((area - 900) * 50 + group - 50) * 10_000 + serial, 100 * 50 * 10_000, b"itin")
            area, group, serial = 900 + value // 500_000, 50 + value // 10_000 % 50, value % 10_000
        elif 0 < area < 900 and area != 666 and group and serial:
            place = area - 1 - (area > 666)
            value = self.feistel.permuted((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, b"ssn")
            place, group, serial = value // (99 * 9999), value // 9999 % 99 + 1, value % 9999 + 1
            area = place + 1 + (place >= 665)
        else:
            return None
        return f"{area:03d}-{group:02d}-{serial:04d}"

    def ip(self, form: str) -> str | None:
        parts = [int(x) for x in form.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in form.split(".")):
            return None
        value = int.from_bytes(bytes(parts), "big")
        private = ((10 << 24, 24), ((172 << 8 | 16) << 16, 20), ((192 << 8 | 168) << 16, 16), (127 << 24, 24))
        for base, bits in private:
            if base <= value < base + (1 << bits):
                return ".".join(map(str, (base + self.feistel.permuted(value - base, 1 << bits, b"ip%d" % base)).to_bytes(4, "big")))
        inside = lambda v: any(b <= v < b + (1 << n) for b, n in private)
        while True:  # public addresses stay public
            value = self.feistel.permuted(value, 1 << 32, b"ip")
            if not inside(value):
                return ".".join(map(str, value.to_bytes(4, "big")))

    def date(self, form: str) -> str | None:
        mark = next(c for c in form if not c.isdigit())
        a, b, c = form.split(mark)
        options = [(0, 1, 2)] if len(a) == 4 else [(2, 1, 0)] if mark == "." else [(2, 0, 1), (2, 1, 0)]
        for y, m, d in options:
            parts = (a, b, c)
            try:
                day = date(int(parts[y]), int(parts[m]), int(parts[d]))
            except ValueError:
                continue
            if not EPOCH <= day <= LAST:
                return None
            n = (LAST - EPOCH).days + 1
            new = EPOCH + timedelta(self.feistel.permuted((day - EPOCH).days, n, b"date"))
            wide = all(len(x) >= 2 for x in parts)
            out = [""] * 3
            out[y] = f"{new.year:04d}"
            out[m] = f"{new.month:02d}" if wide else str(new.month)
            out[d] = f"{new.day:02d}" if wide else str(new.day)
            return mark.join(out)
        return None

    def letters(self, s: str, what: bytes) -> str:
        """All characters permuted together, each within its class.

        Long ones in chunks, there and back again: each chunk's permutation is
        named after all that is before it, and then after all that is behind.
        """
        if len(s) <= CHUNK:
            return self._letters(s, what)
        chunks = [s[i : i + CHUNK] for i in range(0, len(s), CHUNK)]
        for way in (b"there", b"back"):
            seen = hashlib.sha256(what + way)
            for i, chunk in enumerate(chunks):
                chunks[i] = self._letters(chunk, what + way + b"%d" % i + seen.digest())
                seen.update(chunks[i].encode())
            chunks.reverse()
        return "".join(chunks)

    def _letters(self, s: str, what: bytes) -> str:
        classes = list(map(class_of, s))
        n, value = 1, 0
        for c, k in zip(s, classes, strict=True):
            n *= len(k)
            value = value * len(k) + k.index(c)
        value = self.feistel.permuted(value, n, what + "".join(k[0] for k in classes).encode())
        out = []
        for k in reversed(classes):
            value, v = divmod(value, len(k))
            out.append(k[v])
        return "".join(reversed(out))

    def email(self, form: str) -> str:
        local, _, domain = form.rpartition("@")
        reserved = re.search(r"(?:^|\.)example(?:\.[a-z]+)?$|\.(?:test|invalid)$", domain.lower())
        name, _, top = domain.rpartition(".")
        return f"{self.letters(local, b'local')}@{domain if reserved else self.letters(name, b'domain') + '.' + top}"

    def iban(self, form: str) -> str | None:
        s = form.replace(" ", "")
        spelt = lambda x: int("".join(str(int(c, 36)) for c in x))
        if not 15 <= len(s) <= 34 or spelt(s[4:] + s[:4]) % 97 != 1:
            return None
        account = self.letters(s[4:], b"iban" + s[:2].encode())
        check = 98 - spelt(account + s[:2] + "00") % 97
        new = iter(f"{s[:2]}{check:02d}{account}")
        return "".join(c if c == " " else next(new) for c in form)

    def _of(self, kind: str, form: str) -> str | None:
        return getattr(self, kind)(form)

    def text(self, text: str | None) -> tuple[str | None, int]:
        """The text with pseudonyms, and how many there are."""
        if not text or not _LIKELY.search(text):
            return text, 0
        count, out, at, pos = 0, [], 0, 0
        while m := PATTERN.search(text, pos):
            new = self.of(m.lastgroup, m[0])
            if new is None:  # not valid: the next kind may start within
                if m.lastgroup == "iban" and (n := re.compile(NUMBER).search(text, m.start(), m.end())):
                    new, m = self.of("number", n[0]), n
                else:
                    pos = m.start() + 1
                    while pos < m.end() and text[pos - 1].isalnum() and text[pos].isalnum():
                        pos += 1
                    continue
            out += [text[at : m.start()], new]
            at = pos = m.end()
            count += 1
        return "".join([*out, text[at:]]), count


def session_key(spark: SparkSession) -> bytes:
    """The session's key; drawn at random where none is set."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING).encode()


def pseudonymise(df: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``df`` with pseudonyms in ``text_col``; optionally, their number in a new column.

    The columns and their order stay. A clashing ``count_col`` raises ValueError.
    """
    if count_col in df.columns:
        raise ValueError(f"column {count_col} exists")
    at = df.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema += f", `{count_col}` long" if count_col else ""

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in sliced(batches):
            new = [names.text(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in new], pa.string())
            if count_col:
                columns.append(pa.array([n for _, n in new], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *([count_col] if count_col else [])])

    return in_workers(df, replace, schema)


def op3_pii_pseudonyms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, session_key(spark), count_col="n_pseudonyms")
