"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOW = str.maketrans(UPPER, UPPER.lower())


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOW)].append(i)
    return {(i, max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}


def windows(rows, size):
    first, texts = {}, {i: words(t) for i, t in rows}
    for i in sorted(texts):
        w = texts[i]
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = set()
    for i, w in texts.items():
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.add((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def repeated(rows, size):
    """Words of each text in a window of `size` words that another document has too."""
    texts, seen = {i: words(t) for i, t in rows}, collections.defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - size + 1):
            seen[tuple(w[k : k + size])].add(i)
    out = {}
    for i, w in texts.items():
        hit = [False] * len(w)
        for k in range(len(w) - size + 1):
            if len(seen[tuple(w[k : k + size])]) > 1:
                hit[k : k + size] = [True] * size
        out[i] = sum(hit)
    return out


def shingles(text, n):
    w = words((text or "").translate(LOW))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def linked(rows, n, num, den):
    sets = {i: shingles(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {(i, len(s), root(i)) for i, s in sets.items()}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    found, digits = [], lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def disclosing(rows, support=3, threshold=0.9):
    """{(doc_id, start, end)} of terms, and {(entity, term): disclosure}, from whole documents."""
    import math

    held, words_of, n = collections.defaultdict(set), {}, len(rows)
    for i, t in rows:
        t = t or ""
        words_of[i] = {w.lower() for w in re.findall(r"[^\W_]+", t)}
        for kind, a, b in personal(t):
            held[f"{kind}:{t[a:b].lower()}"].add(i)
    texts, docs_of = dict(rows), collections.defaultdict(set)
    for i, w in words_of.items():
        for x in w:
            docs_of[x].add(i)
    found = {}
    for e, ids in held.items():
        for x in set().union(*(words_of[i] for i in ids)):
            both = ids & docs_of[x]
            if len({texts[i] for i in both}) >= support and len(ids) < n:
                d = min(1.0, math.log(n * len(both) / (len(docs_of[x]) * len(ids))) / math.log(n / len(ids)))
                if d >= threshold:
                    found[e, x] = d
    spans = set()
    for i, t in rows:
        t = t or ""
        base = personal(t)
        masked = list(t)
        for _, a, b in base:
            masked[a:b] = "\n" * (b - a)
        own = {f"{k}:{t[a:b].lower()}" for k, a, b in base}
        spans |= {(i, m.start(), m.end()) for m in re.finditer(r"[^\W_]+", "".join(masked)) if any((e, m[0].lower()) in found for e in own)}
    return spans, found
