r"""Format-preserving pseudonyms by a keyed Feistel permutation.

Values are found by pattern, validated (check digits, number ranges, calendar), made a
number within the set of all values of their format, permuted there, and written
back in the same format: separators stay, check digits are made again, a pseudonym
is a valid value of its kind.  The permutation depends on the key and the kind alone, so
equal values stay equal in every document, however they are written.

Kinds: card (13 to 19 digits, Luhn), iban (mod 97), phone (+ and 8 to 15 digits, groups),
ipv4, date (ISO, and day.month.year or day/month/year, 1900 to 2099), email (local part), secret
(quoted hexadecimal of 32 or more digits).  Where patterns overlap the leftmost value counts.
Invalid look-alikes stay as they are.

Null text: null, nothing found.  Empty text: empty.  Repeated rows and values: equal results.  Empty
table: no rows.  Extra columns pass through unless their names clash with ``found``.
"""

from __future__ import annotations

import datetime
import hmac
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
PATTERN = re.compile(
    r"(?P<date>(?<![\w.-])(?:\d{4}-\d\d-\d\d|\d\d([./])\d\d\2\d{4})(?![\w-]|[./]\d))"
    r"|(?P<ipv4>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}(?:[ -]?\(?\d{2,4}\)?){2,4}(?!\w))"
    r"|(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<secret>(?<=\")(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?=\"))"
)
EMAIL = re.compile(r"(?<![\w.+-])([A-Za-z0-9][A-Za-z0-9.+-]*)(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
#: Where none of these is in a text, no pattern can be.
HINT = re.compile(r"[0-9@]")


def permute(value: int, size: int, key: bytes, kind: str) -> int:
    """A keyed permutation of ``range(size)``: balanced Feistel rounds, walked until the result lies inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            digest = hmac.digest(key, f"{kind}|{size}|{r}|".encode() + right.to_bytes(width, "big"), "sha256")
            stream = digest if width <= 32 else digest + b"".join(hmac.digest(key, digest + bytes([i]), "sha256") for i in range(width // 32))
            left, right = right, left ^ (int.from_bytes(stream[:width], "big") & mask)
        value = left << half | right
        if value < size:
            return value


def luhn(digits: str) -> int:
    """Check digit for the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _refill(shape: str, symbols: str, is_symbol: Callable[[str], bool]) -> str:
    """``shape`` with its symbols replaced in order; all else stays."""
    rest = iter(symbols)
    return "".join(next(rest) if is_symbol(c) else c for c in shape)


def _is_digit(c: str) -> bool:
    return "0" <= c <= "9"


def _card(text: str, key: bytes) -> str | None:
    digits = "".join(filter(_is_digit, text))
    if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    body = str(permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, "card")).zfill(len(digits) - 1)
    return _refill(text, body + str(luhn(body)), _is_digit)


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(text: str, key: bytes) -> str | None:
    flat = text.replace(" ", "")
    country, check, body = flat[:2], flat[2:4], flat[4:]
    if not 15 <= len(flat) <= 34 or f"{_iban_check(country, body):02d}" != check:
        return None
    new = _mixed(body, key, f"iban{country}")
    return _refill(text, country + f"{_iban_check(country, new):02d}" + new, lambda c: c != " ")


#: Symbols that stay within their own class.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _mixed(text: str, key: bytes, kind: str) -> str:
    """Permute the letters and digits of a text, each within its class; the shape is part of the kind."""
    value, size, shape = 0, 1, []
    for c in text:
        known = next((k for k in CLASSES if c in k), None)
        shape.append(known)
        if known:
            value = value * len(known) + known.index(c)
            size *= len(known)
    if size == 1:
        return text
    name = "".join(str(CLASSES.index(s)) if s else c for s, c in zip(shape, text))
    value = permute(value, size, key, f"{kind}|{name}")
    out = []
    for c, known in zip(reversed(text), reversed(shape)):
        if known:
            value, at = divmod(value, len(known))
            c = known[at]
        out.append(c)
    return "".join(reversed(out))


def _phone(text: str, key: bytes) -> str | None:
    digits = "".join(filter(_is_digit, text))
    if not 8 <= len(digits) <= 15:
        return None
    head = re.match(r"\+(\d+)", text)[1]
    if len(head) == len(digits):  # one run of digits: the first stands for the country
        head = digits[:1]
    body = digits[len(head):]
    new = str(permute(int(body), 10 ** len(body), key, f"phone{head}")).zfill(len(body))
    return _refill(text, head + new, _is_digit)


def _ipv4(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = permute(int.from_bytes(map(int, parts), "big"), 1 << 32, key, "ipv4")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(text: str, key: bytes) -> str | None:
    mark = "-" if "-" in text else text[2]
    parts = [int(p) for p in text.split(mark)]
    year, month, day = parts if mark == "-" else parts[::-1]
    try:
        at = datetime.date(year, month, day).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= at <= LAST_DAY:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + permute(at - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
    return new.isoformat() if mark == "-" else f"{new.day:02d}{mark}{new.month:02d}{mark}{new.year:04d}"


MAKERS: dict[str, Callable[[str, bytes], str | None]] = {
    "card": _card, "iban": _iban, "phone": _phone, "ipv4": _ipv4, "date": _date,
    "email": lambda t, k: _mixed(t, k, "email"), "secret": lambda t, k: _mixed_hex(t, k),
}


def _mixed_hex(text: str, key: bytes) -> str:
    new = f"{permute(int(text, 16), 16 ** len(text), key, f'secret{len(text)}'):0{len(text)}x}"
    return new.upper() if any("A" <= c <= "F" for c in text) else new


def pseudonymise(text: str, key: bytes, known: dict[tuple[str, str], str | None] | None = None) -> tuple[str, Counter]:
    """The text with pseudonyms, and how many values of each kind it held."""
    found: Counter = Counter()
    if not HINT.search(text):
        return text, found
    known = {} if known is None else known

    def make(kind: str, value: str) -> str:
        if (kind, value) not in known:
            known[kind, value] = MAKERS[kind](value, key)
        new = known[kind, value]
        if new is None:
            return value
        found[kind] += 1
        return new

    if "@" in text:
        text = EMAIL.sub(lambda m: make("email", m[0]), text)
    return PATTERN.sub(lambda m: make(m.lastgroup, m[0]), text), found


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``found``: kind to number of values."""
    names = [c for c in docs.columns if c.lower() != "found"]
    docs = docs.select(*names)
    at = names.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts, found = [], []
            for text in batch.column(at).to_pylist():
                new, kinds = (None, Counter()) if text is None else pseudonymise(text, key, known)
                texts.append(new)
                found.append(list(kinds.items()))
            if len(known) > 100_000:
                known.clear()
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(found, pa.map_(pa.string(), pa.int64()))], [*names, "found"])

    return docs.mapInArrow(run, f"{fields}, found map<string,bigint>")
