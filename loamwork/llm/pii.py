"""Format-preserving pseudonyms: personal numbers and dates are permuted within their format.

A value that passes its kind's check is mapped by a keyed Feistel network to another value of the
same kind that passes too, written in the same way. The map is a permutation, so different values
stay different, and it depends on key and value alone, so equal values stay linked across
documents; whoever has the key can reverse it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date
from ipaddress import IPv6Address
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import map_arrow, text_slices

#: For tests and demonstrations; a real run passes its own secret key.
DEMO_KEY = b"demonstration key, not secret"
ROUNDS = 10
#: Characters of a long value that are permuted at once.
BLOCK = 128
_FIRST, _LAST = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of range(n) for any n, by a two-part Feistel network and cycle walking."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, value: int, size: int) -> int:
        """A keyed number of ``size`` bytes."""
        data = tweak + i.to_bytes(1, "big") + value.to_bytes((value.bit_length() + 7) // 8, "big")
        if size <= 64:
            return int.from_bytes(hashlib.blake2b(data, digest_size=size, key=self.key).digest(), "big")
        return int.from_bytes(hashlib.shake_256(self.key + data).digest(size), "big")

    def _once(self, tweak: bytes, n: int, x: int, back: bool) -> int:
        a = 1 << ((n - 1).bit_length() + 1) // 2
        b = -(-n // a)
        size = a.bit_length() // 8 + 12  # 88 bits more than a half, so that its remainders are even
        left, right = divmod(x, b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(tweak, i, left, size)) % b
            else:
                left = (left + sign * self._round(tweak, i, right, size)) % a
        return left * b + right

    def permute(self, tweak: str, n: int, x: int, back: bool = False, fits: Callable[[int], bool] | None = None) -> int:
        """Image of ``x`` in range(n); with ``fits``, within the values that fit, of which x is one."""
        if n < 2:
            return x
        limit = n.to_bytes((n.bit_length() + 7) // 8, "big")
        name = tweak.encode("utf-8", "surrogatepass")
        name = len(name).to_bytes(8, "big") + name + len(limit).to_bytes(8, "big") + limit
        x = self._once(name, n, x, back)
        while x >= n or fits is not None and not fits(x):
            x = self._once(name, n, x, back)
        return x

    def permute_chars(self, tweak: str, chars: str, alphabet: str, back: bool = False) -> str:
        """Image of characters of ``alphabet``, as many. Long ones go in blocks, each under the images before it."""
        size, place, out = len(alphabet), {c: i for i, c in enumerate(alphabet)}, ""
        chain = hashlib.blake2b(digest_size=16)
        for begin in range(0, len(chars), BLOCK):
            block, x = chars[begin : begin + BLOCK], 0
            for c in block:
                x = x * size + place[c]
            # the first block's name holds the length alone, a later one's also what the images before it were
            name = f"{tweak}{len(chars)}" + (f" after {chain.hexdigest()}" if begin else "")
            x, new = self.permute(name, size ** len(block), x, back), []
            for _ in block:
                x, c = divmod(x, size)
                new.append(alphabet[c])
            image = "".join(reversed(new))
            chain.update((block if back else image).encode())
            out += image
        return out


def luhn_digit(digits: str) -> int:
    """The check digit that makes ``digits`` followed by it valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_remainder(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _fill(shape: str, chars: str, pattern: Callable[[str], bool]) -> str:
    """``shape`` with its characters that meet ``pattern`` replaced, in order, by ``chars``."""
    new = iter(chars)
    return "".join(next(new) if pattern(c) else c for c in shape)


def _digit(c: str) -> bool:
    return "0" <= c <= "9"


def _digits(text: str) -> str:
    return "".join(filter(_digit, text))


class Pseudonymizer:
    """Finds and replaces the values of a text."""

    def __init__(self, key: bytes = DEMO_KEY) -> None:
        self.feistel = Feistel(key)
        self.known: dict[tuple[str, str, bool], str | None] = {}

    def replace(self, text: str | None, back: bool = False) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The text with its values permuted (``back``: restored), and (kind, start, end) of each."""
        if text is None or not _ANY.search(text):
            return text, []
        out, at, spans = [], 0, []
        here = 0
        while m := _VALUE.search(text, here):
            kind, start, here = m.lastgroup, m.start(), m.end()
            if kind == "card":
                start, here, new = self._first_card(text, start, here, back)
            else:
                new = self.value(kind, m[0], back)
            if new is not None:
                out += (text[at:start], new)
                at = here
                spans.append((kind, start, here))
        return "".join((*out, text[at:])), spans

    def value(self, kind: str, text: str, back: bool = False) -> str | None:
        """The image of one value, or None where it fails the check of its kind."""
        if len(self.known) > 50_000:
            self.known.clear()
        if (kind, text, back) not in self.known:
            self.known[kind, text, back] = getattr(self, f"_{kind}")(text, back)
        return self.known[kind, text, back]

    def _number(self, tweak: str, digits: str, back: bool, fits: Callable[[int], bool] | None = None) -> str:
        n = len(digits)
        return str(self.feistel.permute(f"{tweak}{n}", 10**n, int(digits), back, fits)).zfill(n)

    def _card(self, text: str, back: bool, also: Callable[[str], bool] | None = None) -> str | None:
        digits = _digits(text)
        if not self._is_card(digits):
            return None
        n = len(digits) - 1

        def fits(x: int) -> bool:
            s = str(x).zfill(n)
            s += str(luhn_digit(s))
            return len(set(s)) > 1 and (also is None or also(s))

        body = self._number("card", digits[:-1], back, fits)
        return _fill(text, body + str(luhn_digit(body)), _digit)

    def _first_card(self, text: str, start: int, end: int, back: bool) -> tuple[int, int, str | None]:
        """(start, end, image) of the card that ends first among those that begin in the match.

        A reading begins and ends at a space or a border of the run of digits. Readings that are
        tried before the card fail, and with its image they have to fail too, or it wouldn't be
        found again when it is restored. They end with the card at the latest, so what follows
        doesn't matter.
        """
        run = _RUN.match(text, start)
        marks = [i for i in range(start, min(run.end(), end + 40)) if text[i] == " "]
        begins, ends = [start, *(i + 1 for i in marks if i < end)], [*marks, run.end()] if _BORDER.match(text, run.end()) else marks
        tried: list[tuple[int, int]] = []
        for b in ends:
            for a in begins:
                if not 13 <= len(_digits(text[a:b])) <= 19:
                    continue
                if self._is_card(_digits(text[a:b])):
                    before = [(_digits(text[x:a]), len(_digits(text[x:y])), max(0, len(_digits(text[a:x])))) for x, y in tried if y > a]
                    if not before:
                        return a, b, self.value("card", text[a:b], back)
                    fails = lambda digits: not any(self._is_card((lead + digits[skip:])[:n]) for lead, n, skip in before)  # noqa: B023, E731
                    return a, b, self._card(text[a:b], back, fails)
                tried.append((a, b))
        return start, end, None

    @staticmethod
    def _is_card(digits: str) -> bool:
        return 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == int(digits[-1]) and len(set(digits)) > 1

    def _ssn(self, text: str, back: bool) -> str | None:
        def fits(x: int) -> bool:
            s = f"{x:09d}"
            return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

        digits = _digits(text)
        return _fill(text, self._number("ssn", digits, back, fits), _digit) if fits(int(digits)) else None

    def _phone(self, text: str, back: bool) -> str | None:
        digits = _digits(text)
        if not 10 <= len(digits) <= 15:
            return None
        # the country code stays, so the number keeps its format
        keep = len(digits) - 10
        return _fill(text, digits[:keep] + self._number("phone", digits[keep:], back), _digit)

    def _ip(self, text: str, back: bool) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        x = self.feistel.permute("ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"), back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _iban(self, text: str, back: bool) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_remainder(plain) != 1:
            return None
        country, body = plain[:2], plain[4:]
        letters, digits = "".join(filter(str.isalpha, body)), _digits(body)
        shape = "".join("A" if c.isalpha() else "0" for c in body)
        if digits:
            body = _fill(body, self._number(f"iban{country}{shape}", digits, back), _digit)
        if letters:
            body = _fill(body, self.feistel.permute_chars(f"ibanletters{country}{shape}", letters, ascii_uppercase, back), str.isalpha)
        check = 98 - iban_remainder(f"{country}00{body}")
        return _fill(text, f"{country}{check:02d}{body}", str.isalnum)

    def _isodate(self, text: str, back: bool) -> str | None:
        day = self._day(int(text[:4]), int(text[5:7]), int(text[8:]))
        if day is None:
            return None
        new = self._other_day(day, back)
        return f"{new.year:04d}{text[4]}{new.month:02d}{text[7]}{new.day:02d}"

    def _daydate(self, text: str, back: bool) -> str | None:
        mark = re.search(r"[./-]", text)[0]
        first, second, y = text.split(mark)
        # dates with slashes are read month first where they can be
        month_first = mark == "/" and 1 <= int(first) <= 12 and self._day(int(y), int(first), int(second)) is not None
        m, d = (first, second) if month_first else (second, first)
        day = self._day(int(y), int(m), int(d))
        if day is None:
            return None
        new = self._other_day(day, back)
        pair = (new.month, new.day) if month_first else (new.day, new.month)
        return mark.join((str(pair[0]).zfill(len(first)), str(pair[1]).zfill(len(second)), str(new.year)))

    @staticmethod
    def _day(y: int, m: int, d: int) -> int | None:
        try:
            x = date(y, m, d).toordinal()
        except ValueError:
            return None
        return x - _FIRST if _FIRST <= x <= _LAST else None

    def _other_day(self, day: int, back: bool) -> date:
        """One permutation for all ways of writing, so that equal dates stay linked. It keeps whether the
        month and the day have one digit and whether the day is above 12, so an image has the lengths
        of its date and is read in the same order."""
        kind = lambda x: (x.month > 9, (x.day > 9) + (x.day > 12))
        own = kind(date.fromordinal(_FIRST + day))
        return date.fromordinal(_FIRST + self.feistel.permute("date", _LAST - _FIRST + 1, day, back, lambda x: kind(date.fromordinal(_FIRST + x)) == own))

    def _email(self, text: str, back: bool) -> str | None:
        local, domain = text.split("@")
        out = local
        for name, alphabet in (("lower", ascii_lowercase), ("upper", ascii_uppercase), ("digit", "0123456789")):
            chars = "".join(c for c in local if c in alphabet)
            if chars:
                out = _fill(out, self.feistel.permute_chars(f"email{name}", chars, alphabet, back), lambda c, alphabet=alphabet: c in alphabet)
        return f"{out}@{domain}"

    def _ipv6(self, text: str, back: bool) -> str | None:
        try:
            IPv6Address(text)
        except ValueError:
            return None
        hexes, upper = text.replace(":", ""), text.upper() == text != text.lower()
        if not hexes or not upper and text.lower() != text:
            return None
        alphabet = "0123456789ABCDEF" if upper else "0123456789abcdef"
        shape = "".join(c if c == ":" else "0" for c in text) + ("upper" if upper else "")
        n = len(hexes)
        # capitals are told by a letter, so an image of capitals has one
        fits = (lambda x: not f"{x:x}".isdigit()) if upper else None
        x = self.feistel.permute(f"ipv6{shape}", 16**n, int(hexes, 16), back, fits)
        return _fill(text, "".join(alphabet[x >> 4 * i & 15] for i in reversed(range(n))), lambda c: c != ":")

    def _abroad(self, text: str, back: bool) -> str | None:
        """A number with a country code: the code as written apart, or two digits, stays."""
        number = _digits(text)
        if not 8 <= len(number) <= 15:
            return None
        code = len(_digits(re.split(r"[ .()-]", text[1:], maxsplit=1)[0]))
        keep = code if code <= 3 else 2
        return _fill(text, number[:keep] + self._number(f"abroad{number[:keep]}", number[keep:], back), _digit)


_ANY = re.compile(r"[0-9@]")
_RUN, _BORDER = re.compile(r"[0-9]+(?:[ -]?[0-9]+)*", re.ASCII), re.compile(r"(?![\w]|[.-][0-9])", re.ASCII)
# each pattern begins and ends at a border, so that a part of a longer number is no value
_VALUE = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))"
    r"|(?P<isodate>(?<![\w-])[0-9]{4}([-/])[0-9]{2}\5[0-9]{2}(?![\w-]))"
    r"|(?P<daydate>(?<![\w./-])[0-9]{1,2}([./-])[0-9]{1,2}\7[0-9]{4}(?![\w]|[./-][0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w]|[.-][0-9]))"
    r"|(?P<phone>(?<![\w])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![\w]|-[0-9]))"
    r"|(?P<abroad>(?<![\w+])\+[1-9](?:[ .-]?\(?[0-9]\)?){7,14}(?![\w]|[ .-][0-9]))"
    r"|(?P<ipv6>(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}(?![\w:.]))",
    re.ASCII,
)


def pseudonymize(docs: DataFrame, key: bytes = DEMO_KEY, back: bool = False) -> DataFrame:
    """``docs`` with ``text`` pseudonymised, and ``pii``: (kind, start, end) of each value in the input.

    Kinds: Luhn-valid card numbers, checked IBANs, US social security numbers in assigned ranges,
    IPv4 and IPv6 addresses, ten-digit phone numbers with separators, numbers of 8 to 15 digits after
    a plus sign, calendar dates from 1900 to 2099, and the local part of e-mail addresses. Equal
    values have equal images, dates in any way of writing. What fails its check stays, as do mail
    domains and digits without separators that no check confirms. Null and empty texts stay, with no
    values; values may be of any length; repeated rows have equal results; other columns pass
    through, whatever their names, but one named ``pii`` is replaced. An empty table stays empty.
    """
    docs = docs.drop("pii")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Pseudonymizer(key)
        for part in text_slices(batches):
            texts, found = [], []
            for text in part.column("text").to_pylist():
                new, spans = worker.replace(text, back)
                texts.append(new)
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            columns = [pa.array(texts, pa.string()) if name == "text" else part.column(name) for name in part.schema.names]
            yield pa.record_batch([*columns, pa.array(found, kind)], names=[*part.schema.names, "pii"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_arrow(docs.withColumn("text", F.col("text").cast("string")), run, f"{fields}, pii array<struct<kind:string,start:bigint,end:bigint>>")
