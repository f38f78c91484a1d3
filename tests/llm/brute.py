"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

UPPER = {c: c + 32 for c in range(65, 91)}
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal_words(text):
    return ALNUM.findall((text or "").translate(UPPER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items, n=13):
    """docs, items: lists of (id, text). Rows (id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    grams = {}
    for item, text in items:
        w = normal_words(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w, hit, found = normal_words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in grams:
                    hit |= set(range(i, i + size))
                    found |= grams[tuple(w[i:i + size])]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def removals(docs, n=20):
    """docs: list of (id, text) with distinct ids. Rows (id, n_words, n_removed, kept_sha256)."""
    seen, out = set(), []
    for doc, text in sorted(docs, key=lambda d: d[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in seen:
                gone |= set(range(i, i + n))
            seen.add(tuple(w[i:i + n]))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def bag(text, k=5):
    w = normal_words(text)
    return Counter(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def jaccard(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def classes(docs, k=5, threshold=0.8):
    """id -> smallest id of its component, and the links between different texts."""
    bags = {d: bag(t, k) for d, t in docs}
    root = {d: d for d in bags}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d
    ids = sorted(d for d in bags if bags[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if jaccard(bags[a], bags[b]) >= threshold:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in bags}


def private_spans(text):
    """kind:start:end of the base patterns of personal data, in the contract's order."""
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def secret_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


def loop(doc, words):
    """The words of a document as the query of periodic runs changes them."""
    n, h = len(words), zlib.crc32(str(doc).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def runs(words, least=6, exponent=4):
    """(start, length, period) of all runs by start, then period."""
    best = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in best.items())


def run_row(doc, text):
    words = loop(doc, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = runs(words)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def code_length(text, training, order):
    """Bits of a text by prediction by partial matching with exclusion; ``training`` is a list of texts."""
    seen = {}
    for raw in (t.encode() for t in training):
        for i, b in enumerate(raw):
            for k in range(min(i, order) + 1):
                seen.setdefault(raw[i - k:i], Counter())[b] += 1
    raw, total = text.encode(), 0.0
    for i, b in enumerate(raw):
        out = set()
        for k in range(min(i, order), -1, -1):
            left = {s: n for s, n in seen.get(raw[i - k:i], {}).items() if s not in out}
            if b in left:
                total += math.log2(sum(left.values()) + len(left)) - math.log2(left[b])
                break
            if left:
                total += math.log2(sum(left.values()) + len(left)) - math.log2(len(left))
            out |= set(left)
        else:
            total += math.log2(max(256 - len(out), 1))
    return total


def disclosing(texts, group, spans, reach=8, min_support=3, min_share=0.5, remove_share=0.8, min_g2=10.83):
    """term -> (level, share) by dictionaries. ``spans``(text): (kind, start, end); ``group``(kind, value): names of value and group."""
    texts = sorted({t for t in texts if t is not None})
    near, entities, terms = Counter(), Counter(), Counter()
    for t in texts:
        found = spans(t)
        words = [(m.group(), m.start(), m.end()) for m in ALNUM.finditer(t.translate(UPPER))]
        terms.update({w for w, _, _ in words})
        free = [not any(a < y and x < b for _, a, b in found) for _, x, y in words]
        here = set()
        for kind, a, b in found:
            left = [i for i, (_, _, y) in enumerate(words) if y <= a][-reach:]
            right = [i for i, (_, x, _) in enumerate(words) if x >= b][:reach]
            for broad, name in enumerate(group(kind, t[a:b])):
                here |= {(None, name, broad)} | {(words[i][0], name, broad) for i in left + right if free[i]}
        near.update(x for x in here if x[0] is not None)
        entities.update(x[1:] for x in here if x[0] is None)
    out, n = {}, len(texts)
    for (term, name, broad), both in near.items():
        a, b = terms[term], entities[name, broad]
        cells = [(both, a, b), (a - both, a, n - b), (b - both, n - a, b), (n - a - b + both, n - a, n - b)]
        g2 = 2 * sum(x * math.log(x * n / (r * c)) for x, r, c in cells if x > 0)
        if both >= min_support and both / a >= min_share and both / a > b / n and g2 >= min_g2:
            level = 2 if not broad and both / a >= remove_share else 1
            out[term] = max(out.get(term, (0, 0.0)), (level, 0.0))[0], max(out.get(term, (0, 0.0))[1], both / a)
    return out
