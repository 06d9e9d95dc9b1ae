"""Plain versions of the operators, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def substrings(docs, width=20):
    seen, out = set(), {}
    for doc, text in sorted(docs):
        w = WORD.findall(text or "")
        gone = set()
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            if key in seen:
                gone.update(range(i, i + width))
            seen.add(key)
        out[doc] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def contamination(docs, items, width=13):
    patterns = []
    for item, text in items:
        w = FOLDED.findall(lower(text))
        n = min(width, len(w))
        patterns += [(item, w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    out = {}
    for doc, text in docs:
        w, hit, found = FOLDED.findall(lower(text)), set(), set()
        joined = "\0" + "\0".join(w) + "\0"
        for item, p in patterns:
            if "\0" + "\0".join(p) + "\0" in joined:
                for i in range(len(w) - len(p) + 1):
                    if w[i : i + len(p)] == p:
                        hit.update(range(i, i + len(p)))
                        found.add(str(item))
        out[doc] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out
