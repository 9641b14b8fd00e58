"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def contamination(text, items, window=10):
    """items: pairs of id and text. Words, hit words, sorted ids."""
    words = ITEM_WORD.findall((text or "").translate(LOWER))
    hit, ids = set(), set()
    for item, passage in items:
        theirs = ITEM_WORD.findall((passage or "").translate(LOWER))
        size = min(window, len(theirs))
        if not size:
            continue
        windows = {tuple(theirs[i : i + size]) for i in range(len(theirs) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                if item is not None:
                    ids.add(str(item))
    listed = ",".join(sorted(ids))
    return len(words), len(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest()


def fingerprint(text, size=4):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(bits, threshold=4):
    """For each fingerprint the smallest index that it reaches."""
    least = list(range(len(bits)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(bits):
            for j, b in enumerate(bits):
                if least[j] < least[i] and (a ^ b).bit_count() <= threshold:
                    least[i] = least[j]
                    changed = True
    return least


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            repeated.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, dup, len(repeated)


def remaining(rows, size=50):
    """rows: pairs of id and bytes. Removed bytes, runs and what remains of each."""
    first = {}
    for doc, text in rows:
        if doc is not None:
            for i in range(len(text) - size + 1):
                key = text[i : i + size]
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        gone = bytearray(len(text))
        for i in range(len(text) - size + 1):
            if doc is not None and first[text[i : i + size]] < doc:
                gone[i : i + size] = b"\x01" * size
        kept = bytes(c for c, x in zip(text, gone) if not x)
        out.append((sum(gone), len(re.findall(b"\x01+", bytes(gone))), kept))
    return out
