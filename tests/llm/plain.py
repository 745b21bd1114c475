"""Plain-Python forms of the operators, used to check the DataFrame forms."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def fold(doc_id, m):
    return zlib.crc32(str(doc_id).encode()) % m


def window_dedup(rows, width=13):
    first = {}
    for i, t in rows:
        w = words(t, lower=False)
        for k in range(len(w) - width + 1):
            x = tuple(w[k:k + width])
            first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        w = words(t, lower=False)
        gone = [0] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < i:
                gone[k:k + width] = [1] * width
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return sorted(out)


def substring_dedup(rows, length=50):
    first, data = {}, [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            x = b[k:k + length]
            first[x] = min(first.get(x, i), i)
    out = []
    for i, b in data:
        gone, upto = bytearray(len(b)), 0
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < i:
                lo = max(k, upto)
                gone[lo:k + length] = b"\1" * (k + length - lo)
                upto = k + length
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)


def shingle_set(text):
    w = words(text)
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_dedup(rows, num=85):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            places[x].append(i)
    common = collections.Counter((a, b) for own in places.values() for k, b in enumerate(own) for a in own[:k])
    for (a, b), n in common.items():
        if 100 * n >= num * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in sets)


def unigram_base(rows):
    """{doc_id: (tokens, known, N, base score)}"""
    tokens = {i: words(t) + [None] for i, t in rows}
    count = collections.Counter(x for i, w in tokens.items() if fold(i, 7) != 2 for x in w)
    n, v = sum(count.values()), len(count)
    unit = math.log10(n + v + 1)
    return {i: (len(w), sum(count[x] > 0 for x in w), n, sum(math.log10(count[x] + 1) - unit for x in w))
            for i, w in tokens.items()}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def planted_period(doc_id, text):
    w, h = words(text, lower=False), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def word_runs(w, shortest=12):
    """(start, length, period): for each period the maximal stretches, each stretch by its smallest period."""
    seen, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(shortest, 2 * q):
                seen.setdefault((s, i + q), q)
            i += i == s
    return sorted(((s, e - s, q) for (s, e), q in seen.items()), key=lambda r: (r[0], r[2]))


def periodic(rows):
    out = []
    for i, t in rows:
        w = planted_period(i, t)
        found = word_runs(w)
        gone = [False] * len(w)
        for s, n, q in found:
            gone[s + q:s + n] = [True] * (n - q)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        out.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None,
                    sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()),
                    sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return sorted(out)


def damage(rows):
    """(conv_id, turn, role, text) after the faults; nulls of role and text as one space."""
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(c, t, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return out


def repairs(rows):
    """For each conversation of damaged rows: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines.

    Costs and audits by whole strings: least (cost, audit) of every remainder and state."""
    convs, out = collections.defaultdict(list), {}
    for r in rows:
        convs[r[0]].append(r)
    for c, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, seen = [], set()
        for _, _, role, text in own:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else
                          "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {r[1] for r in own if r[1] is not None}
        initials = [r[2][:1] for r in own]
        after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        inserts = {"": "u", "s": "u", "u": "a", "a": "u"}
        names = {"u": "user", "a": "assistant"}

        def closed(best):
            for _ in range(4):
                for q, to in inserts.items():
                    cost, audit, lines = best[to]
                    best[q] = min(best[q], (cost + 5, "I" + audit, (names[to] + ":", lines)))
            return best

        far = (10**9, "", None)
        best = closed({"": (0, "", None), "s": far, "u": far, "a": (0, "", None)})
        for (_, _, role, text), fault in zip(reversed(own), reversed(faults)):
            extra, new = 5 * (fault == "truncated"), {}
            for q in after:
                options = [(best[q][0] + 2, "D" + best[q][1], best[q][2])]
                if fault not in ("blank", "duplicate"):
                    to = after[q].get(role[:1])
                    if to:
                        options.append((best[to][0] + extra, "K" + best[to][1], (f"{role}:{text}", best[to][2])))
                    to = inserts[q]
                    options.append((best[to][0] + 1 + extra, "R" + best[to][1], (f"{names[to]}:{text}", best[to][2])))
                new[q] = min(options, key=lambda o: o[:2])
            best = closed(new)
        cost, audit, chain = best[""]
        lines = []
        while chain is not None:
            lines.append(chain[0])
            chain = chain[1]
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                  sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, lines)
    return out


def conversation_repair(rows):
    found = repairs(damage(rows))
    return [(c, *(found[c][:7] if c in found else (0,) * 6 + ("",)), sha("\n".join(found[c][7] if c in found else []).encode()))
            for c in dict.fromkeys(r[0] for r in rows)]


def brown_scores(rows, learn, order, heads, classes, sweeps, least):
    """Class bigram scores of (id, text) rows; ``order``: the frequent words, most frequent first.

    Sums over whole texts and dictionaries only; every likelihood is formed anew.
    """
    from collections import Counter
    from math import log, log10

    def form(w):
        b = w.encode()
        size = sum(len(b) >= x for x in (5, 9, 13))
        c = b[-1]
        kind = 1 if c > 127 else 2 if 48 <= c <= 57 else 0 if 65 <= c <= 90 or 97 <= c <= 122 or c < 33 or c == 127 else 3
        return ("form", kind * 4 + size)

    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    end = ("end",)
    texts = {i: [end, *words(lower(t)), end] for i, t in rows}
    pairs = Counter(p for i, t in texts.items() if i in learn for p in zip(t, t[1:]))
    count = Counter()
    for (_, w), n in pairs.items():
        count[w] += n
    lg = lambda n: n * log(n) if n else 0.0
    known, head = set(order), order[:heads]
    klass = {w: k % classes for k, w in enumerate(head)} | {end: end}
    of = lambda w: klass.get(w) if w in klass else form(w)

    def likelihood(table, left, right):
        return sum(map(lg, table.values())) - sum(map(lg, left.values())) - sum(map(lg, right.values()))

    def tables(show):
        table, left, right = Counter(), Counter(), Counter()
        for (a, b), n in pairs.items():
            table[show(a), show(b)] += n
            left[show(a)] += n
            right[show(b)] += n
        return table, left, right

    for _ in range(sweeps):
        moved = False
        for w in head:
            own, gains = klass[w], []
            for c in range(classes):
                klass[w] = c
                gains.append(likelihood(*tables(of)))
            best = max(range(classes), key=lambda c: (gains[c], -c))
            klass[w] = best if gains[best] > gains[own] + 1e-9 else own
            moved |= klass[w] != own
        if not moved:
            break

    def exchange(chosen, sides, show):
        table, left, right = tables(show)
        out = {}
        for w in chosen:
            home, around = show(w), Counter()
            for (a, b), n in pairs.items():
                if b == w:
                    around["left", show(a)] += n
                if a == w and sides == 2:
                    around["right", show(b)] += n
            cell = lambda side, v, c: table[v, c] if side == "left" else table[c, v]
            margins = [right, left][:sides]
            value = {c: sum(lg(cell(s, v, c) + n) - lg(cell(s, v, c)) for (s, v), n in around.items())
                     - sum(lg(m[c] + count[w]) - lg(m[c]) for m in margins) for c in range(classes)}
            stay = (sum(lg(cell(s, v, home)) - lg(cell(s, v, home) - n) for (s, v), n in around.items())
                    - sum(lg(m[home]) - lg(m[home] - count[w]) for m in margins))
            best = max(value, key=lambda c: (value[c], -c))
            if value[best] > stay + 1e-9:
                out[w] = best
        return out

    klass |= exchange([w for w in order[heads:] if count[w] >= least], 2, of)
    shown = dict(klass)
    show = lambda w: shown[w] if w in shown else form(w)
    klass |= exchange([w for w in count if w not in known and w != end and count[w] >= least], 1, show)
    table = Counter()
    for (a, b), n in pairs.items():
        table[show(a), of(b)] += n
    arrive, row, varied, distinct = Counter(), Counter(), Counter(), Counter(of(w) for w in count if w != end)
    for (v, c), n in table.items():
        arrive[c] += n
        row[v] += n
        varied[v] += 1
    total, many = sum(arrive.values()), classes + 17
    scores = {}
    for i, t in texts.items():
        s = 0.0
        for a, b in zip(t, t[1:]):
            v, c = show(a), of(b)
            kinds = max(varied[v], 1)
            s += log10((table[v, c] + kinds * (arrive[c] + 1) / (total + many)) / (row[v] + kinds))
            if b != end:
                s += log10((count[b] + 1) / (arrive[c] + distinct[c] + (c not in range(classes))))
        scores[i] = s
    return scores
