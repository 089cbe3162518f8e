"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out = []
    for number, kind in enumerate(KINDS):
        out += [(m.start(), number, m.end()) for m in re.finditer(BASE[kind], text or "") if valid(kind, m.group())]
    return sorted(out)


def listed(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def edited(rows: list[tuple[int, str]]) -> dict[int, str]:
    rows = sorted(rows)
    out = {}
    for i, (key, text) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        out[key] = text[: len(text) - half] + after[:half]
    return out


def components(pairs, nodes) -> dict:
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def repeated(units: dict[int, list | bytes], width: int) -> dict[int, list[bool]]:
    """Which units of each document a window that also starts earlier covers."""
    first, out = {}, {}
    for key in sorted(units):
        some = units[key]
        gone = [False] * len(some)
        for i in range(len(some) - width + 1):
            window = some[i : i + width] if isinstance(some, bytes) else tuple(some[i : i + width])
            if first.setdefault(window, (key, i)) != (key, i):
                gone[i : i + width] = [True] * width
        out[key] = gone
    return out


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contaminated(docs, items, width: int = 10) -> dict:
    """doc_id -> (n_words, n_hit, item names)."""
    windows = defaultdict(set)
    for key, text in items:
        words = bench_words(text)
        n = min(width, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i : i + n])].add(key)
    lengths = {len(w) for w in windows}
    out = {}
    for key, text in docs:
        words, hit, names = bench_words(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                found = windows.get(tuple(words[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    names |= found
        out[key] = (len(words), len(hit), sorted(str(x) for x in names if x is not None))
    return out


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()
