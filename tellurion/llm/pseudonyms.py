"""Format-preserving pseudonyms for personal numbers, addresses and dates.

Each value that passes the checks of its kind (Luhn, SSN areas, octets, IBAN mod 97, calendar) is ranked within the set
of all values of its format, the rank goes through a keyed Feistel permutation of just that set (cycle walking keeps it
inside), and the new rank is written in the old layout with check digits made anew. Equal values get equal pseudonyms
in all documents and runs of a key, so links survive; without the key they cannot be undone.

Scale: a map over rows without a shuffle, state or look-up table; texts without a digit or @ are passed over.

Defined cases: null text stays null; values that fail the checks stay; where several kinds match at one place, the first
listed whose checks pass takes the characters; a card number followed by more digits is tried at each group boundary,
longest first; a slashed date is read month first and, where the calendar has no such day, day first; very long texts are
rewritten as a whole; repeated rows are each rewritten the same way; columns kept are carried as they are, but a
caller's column with the name of a result gives way.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import answer, mapped, others, packed, table, unpacked

ROUNDS = 8


class Back(bytes):
    """A key whose permutations run backwards: what was pseudonymised with the key is restored."""


def permute(key: bytes, tweak: str, x: int, size: int) -> int:
    """A keyed permutation of range(size): balanced Feistel network over enough bits, walked until inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8

    def mixed(r: int, side: int) -> int:
        return int.from_bytes(hashlib.blake2b(bytes([r]) + tweak.encode() + side.to_bytes(width, "big"), key=key, digest_size=max(8, width)).digest(), "big") & mask

    while True:
        left, right = x >> half, x & mask
        if isinstance(key, Back):
            for r in reversed(range(ROUNDS)):
                left, right = right ^ mixed(r, left), left
        else:
            for r in range(ROUNDS):
                left, right = right, left ^ mixed(r, right)
        x = left << half | right
        if x < size:
            return x


def relayout(layout: str, digits: str) -> str:
    """The digits of `layout` replaced in order."""
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), layout)


def luhn_digit(head: str) -> str:
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(head))))
    return str(-total % 10)


def card(key: bytes, s: str) -> str | None:
    d = re.sub(r"[ -]", "", s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1]:
        return None
    n = len(d) - 1
    # the first digit keeps its place among 1-9 (or stays 0), the rest is free
    low = 10 ** (n - 1) if d[0] != "0" else 0
    size = 9 * 10 ** (n - 1) if low else 10 ** (n - 1)
    head = f"{low + permute(key, f'card{n}', int(d[:-1]) - low, size):0{n}d}"
    return relayout(s, head + luhn_digit(head))


def ssn(key: bytes, s: str) -> str | None:
    a, g, n = map(int, s.split("-"))
    if not (1 <= a <= 899 and a != 666 and g and n):
        return None
    x = permute(key, "ssn", ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1, 898 * 99 * 9999)
    a, g, n = x // (99 * 9999), x // 9999 % 99, x % 9999
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{n + 1:04d}"


def phone(key: bytes, s: str) -> str | None:
    d = re.sub(r"\D", "", s)
    cut = len(d) - 10 if len(d) > 10 else 0  # the country code stays
    rest = d[cut:]
    return relayout(s, d[:cut] + f"{permute(key, f'phone{len(rest)}', int(rest), 10 ** len(rest)):0{len(rest)}d}")


def ip(key: bytes, s: str) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (p[0] == "0" and p != "0") for p in parts):
        return None
    x = permute(key, "ip", int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def iban(key: bytes, s: str) -> str | None:
    d = s.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x))
    if not 15 <= len(d) <= 34 or number(d[4:] + d[:4]) % 97 != 1:
        return None
    body = _classes(key, "iban" + d[:2], d[4:])
    check = 98 - number(body + d[:2] + "00") % 97
    new = iter(d[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(new) for c in s)


def _classes(key: bytes, tweak: str, s: str) -> str:
    """Digits to digits, lower to lower, upper to upper; anything else stays."""
    sets = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    of = [next((z for z in sets if c in z), "") for c in s]
    x, size = 0, 1
    for c, z in zip(s, of):
        if z:
            x, size = x * len(z) + z.index(c), size * len(z)
    if size == 1:
        return s
    x = permute(key, f"{tweak}/{','.join(str(len(z)) for z in of)}", x, size)
    out = []
    for c, z in zip(reversed(s), reversed(of)):
        if z:
            x, k = divmod(x, len(z))
            c = z[k]
        out.append(c)
    return "".join(reversed(out))


def email(key: bytes, s: str) -> str | None:
    local, _, domain = s.partition("@")
    return _classes(key, "email@" + domain.lower(), local) + "@" + domain


FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


@lru_cache(maxsize=1)
def _late_days() -> list[int]:
    """Days that cannot be taken for a month, in order."""
    return [d for d in range(FIRST, LAST + 1) if datetime.date.fromordinal(d).day > 12]


def _date(order: str) -> Callable[[bytes, str], str | None]:
    def run(key: bytes, s: str) -> str | None:
        at = dict(zip(order, map(int, re.split(r"\D", s))))
        try:
            day = datetime.date(at["y"], at["m"], at["d"]).toordinal()
        except ValueError:
            return None
        if not FIRST <= day <= LAST:
            return None
        if order == "dmy" and "/" in s:  # not readable month first, and its pseudonym is not either
            late = _late_days()
            day = late[permute(key, "late", bisect_left(late, day), len(late))]
        else:
            day = FIRST + permute(key, "date", day - FIRST, LAST - FIRST + 1)
        new = datetime.date.fromordinal(day)
        seps = re.findall(r"\D", s)
        padded = [f"{getattr(new, {'y': 'year', 'm': 'month', 'd': 'day'}[o]):0{4 if o == 'y' else 2}d}" for o in order]
        return "".join(x + y for x, y in zip(padded, [*seps, ""]))

    return run


#: Kind, pattern, rule; tried in this order at each place.
KINDS: tuple[tuple[str, str, Callable[[bytes, str], str | None]], ...] = (
    ("email", r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}\b", email),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    ("date", r"(?<![\w.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![\w-]|\.[0-9])", _date("ymd")),
    ("date", r"(?<![\w.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![\w]|\.[0-9])", _date("dmy")),
    ("date", r"(?<![\w/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![\w/])", _date("mdy")),
    ("date", r"(?<![\w/])(?:1[3-9]|2[0-9]|3[01])/[0-9]{2}/[0-9]{4}(?![\w/])", _date("dmy")),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])", ip),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", ssn),
    ("card", r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])", card),
    ("phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?!\w)", phone),
    ("phone", r"(?<![\w.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![\w-])", phone),
)

PLACES = re.compile("|".join(f"({p})" for _, p, _ in KINDS))
_HINT = re.compile("[0-9@]")


def pseudonymise(key: bytes, text: str, cache: dict | None = None) -> tuple[str, list[str]]:
    """The rewritten text and the kinds found, in order."""
    if not _HINT.search(text):
        return text, []
    cache = {} if cache is None else cache
    out, kinds, last, at = [], [], 0, 0
    while m := PLACES.search(text, at):
        if (found := _first(key, m.start(), text, cache)) is None:
            # not a value of any kind here: look again behind its first run of digits and letters
            at = m.start() + max(1, re.match(r"\w*", text[m.start() : m.end()]).end())
            continue
        value, kind, end = found
        out += [text[last : m.start()], value]
        kinds.append(kind)
        last = at = end
    return ("".join([*out, text[last:]]), kinds) if out else (text, kinds)


def _first(key: bytes, start: int, text: str, cache: dict) -> tuple[str, str, int] | None:
    """The first kind that has a value here which passes its checks: its pseudonym, its name and where the value ends."""
    for name, p, rule in _PATTERNS:
        if (x := p.match(text, start)) is None:
            continue
        ends = [x.end()]
        if name == "card":  # more digits may follow the number behind a blank
            ends += [start + k for k in range(len(x[0]) - 1, 12, -1) if x[0][k] == " "]
        for end in ends:
            value = text[start:end]
            if (value, rule) not in cache:
                if len(cache) > 100_000:
                    cache.clear()
                cache[value, rule] = rule(key, value)
            if (new := cache[value, rule]) is not None:
                return new, name, end
    return None


def restore(key: bytes, text: str) -> str:
    """The text that became this one under pseudonymise() with the key."""
    return pseudonymise(Back(key), text)[0]


_PATTERNS = [(name, re.compile(p), rule) for name, p, rule in KINDS]


@lru_cache(maxsize=4)
def _cache(key: bytes) -> dict:
    return {}


def _rewriter(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(key)
        for b in batches:
            texts, kinds = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                new, found = pseudonymise(key, t, cache) if t is not None else (None, [])
                texts.append(new)
                kinds.append(found)
            yield answer(b, _pn_text=pa.array(texts, pa.string()), _pn_kinds=pa.array(kinds, pa.list_(pa.string())))

    return run


def with_pseudonyms(docs: DataFrame, key: bytes, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, _pn_text and _pn_kinds (kinds replaced, in order). The key stays out of plans and logs' texts only
    as far as the caller keeps it in a secret store; it is sent to the tasks with the code."""
    if not key:
        raise ValueError("pseudonyms need a key")
    kept = others(keep, ("_pn_text", "_pn_kinds"))
    rows = docs.select(packed(kept), F.col("text"))
    return unpacked(mapped(rows, _rewriter(key), "_pn_text string, _pn_kinds array<string>"), kept, "_pn_text", "_pn_kinds")


#: The session's setting with the key of op9_pseudonyms. Where it is unset the query takes TEST_KEY, which is for
#: synthetic tables only; with_pseudonyms() itself has no default.
KEY_SETTING, TEST_KEY = "spark.tellurion.pseudonymKey", "key of the registered query"


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_pseudonyms(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, TEST_KEY).encode())
    count = lambda k: F.size(F.filter("_pn_kinds", lambda x: x == k)).cast("long")
    kinds = list(dict.fromkeys(name for name, _, _ in KINDS))
    return found.select("doc_id", F.col("_pn_text").alias("text"), F.size("_pn_kinds").cast("long").alias("n_replaced"), *(count(k).alias(f"n_{k}") for k in kinds))
