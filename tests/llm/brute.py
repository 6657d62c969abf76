"""Plain Python versions of the corpus operators, and awkward documents."""

from __future__ import annotations

import collections
import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def corpus(seed: int = 1, n: int = 48) -> list[tuple[int, str | None]]:
    """Prose with exact and near copies, shared passages and lines, nulls, blanks, one very long text."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéñü") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared, line = say(60), "This is one Common line that very many documents hold " + say(3)
    out: list[str | None] = [None, "", " \t\n", "one", "Two words", "ONE", "a\n\nb\n", "é" * 39, ("é" * 40 + "\n") * 3]
    base = say(120)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            w = base.split()
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
        elif kind == 1:
            out.append(say(30) + "\n" + (line.upper() if i % 4 else f"  {line}\t") + "\n" + say(20) + ("\n" + line if i % 3 == 0 else ""))
        elif kind == 2:
            out.append(say(r.randrange(5, 40)) + " " + shared + " " + say(9))
        elif kind == 3:
            out.append(out[-1])
        elif kind == 4:
            out.append(say(40) + " " + say(36) * 2)
        else:
            out.append(say(r.randrange(1, 200)))
    out.append(say(6_000))
    ids = list(range(len(out)))
    r.shuffle(ids)
    return [(3 * i + 7, t) for i, t in zip(ids, out, strict=True)]


def lines(docs, least=40, times=5):
    held = collections.defaultdict(set)
    strip = lambda x: x.strip(" \t\n\v\f\r")
    for i, t in docs:
        for x in (t or "").split("\n"):
            held[low(strip(x))].add(i)
    out = {}
    for i, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if not (len(k := low(strip(x))) >= least and len(held[k]) >= times and i != max(held[k]))]
        out[i] = (len(every), len(every) - len(kept), "\n".join(kept))
    return out


def repeats(docs, window=35):
    split = {i: WORD.findall(t or "") for i, t in docs}
    seen = collections.Counter(tuple(w[j : j + window]) for w in split.values() for j in range(len(w) - window + 1))
    out = {}
    for i, w in split.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                gone |= set(range(j, j + window))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def sets(docs, k=5):
    out = {}
    for i, t in docs:
        w = WORD.findall(low(t or ""))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def near(docs, percent=85):
    s = sets(docs)
    up = {i: i for i in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= percent * len(s[a] | s[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s[i]), top(i)) for i in ids}


def contaminated(docs, items, window=10):
    held = collections.defaultdict(set)
    for i, t in items:
        w = PLAIN.findall(low(t or ""))
        for j in range(max(1, len(w) - window + 1) if w else 0):
            held[tuple(w[j : j + window])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = PLAIN.findall(low(t or "")), set(), set()
        for m in {len(x) for x in held}:
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in held:
                    found |= held[tuple(w[j : j + m])]
                    hit |= set(range(j, j + m))
        out[i] = (len(w), len(hit), sorted(found))
    return out


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text: str) -> list[tuple[str, int, int]]:
    found = []
    for n, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            bad = kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15
            if not bad:
                found.append((m.start(), n, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(found)]


def sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()
