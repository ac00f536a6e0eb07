"""Plain Python versions of what the text operators must return."""

import hashlib
import re
import string
from collections import defaultdict

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WHITE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate(LOWER)


def words(text):
    return WORD.findall(lower(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def key(line):
    return lower(line.strip(WHITE))


def dedup_lines(docs, least_chars=40, least_documents=5):
    """(id, text) -> (id, kept text, lines, dropped)."""
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(doc)
    lost = {k: max(v, key=lambda x: (x is not None, x or 0)) for k, v in holders.items() if len(v) >= least_documents}
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in lost or lost[key(line)] == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def shingles(text, n=5):
    own = words(text)
    return frozenset(tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))) if own else frozenset()


def near_links(texts, threshold=0.8):
    """Pairs of positions of texts whose shingle sets are similar enough."""
    sets = [shingles(text) for text in texts]
    found = set()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both / (len(a) + len(sets[j]) - both) >= threshold:
                found.add((j, i))
    return found


def classes(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[min(a, b)] = max(a, b)
    return [root(x) for x in range(n)]


def hits(text, items, window=13):
    """Number of words, words inside occurring windows, and ids of the items they are from."""
    own, covered, found = words(text), set(), set()
    for item, said in items:
        it = words(said)
        size = min(len(it), window)
        for s in range(len(it) - size + 1 if it else 0):
            for i in range(len(own) - size + 1):
                if own[i : i + size] == it[s : s + size]:
                    covered.update(range(i, i + size))
                    found.add(str(item))
    return len(own), len(covered), sorted(found)


def near_places(docs, items, slop, window=13):
    """Per text, the places (item id, word) where the two rarest words of a window stand within `slop` of their distance in it."""
    from collections import Counter

    counts = Counter(word for text in docs for word in words(text))
    pairs = set()
    for name, text in items:
        own = words(text)
        size = min(len(own), window)
        for start in range(len(own) - size + 1 if size > 1 else 0):
            a, b = sorted(range(start, start + size), key=lambda k: (counts[own[k]], k))[:2]
            pairs.add((str(name), own[a], own[b], b - a))
    out = []
    for text in docs:
        at = {}
        for k, word in enumerate(words(text)):
            at.setdefault(word, []).append(k)
        out.append(
            {
                (name, p)
                for name, a, b, distance in pairs
                for p in at.get(a, ())
                if any(q != p and abs(q - p - distance) <= slop for q in at.get(b, ()))
            }
        )
    return out
