"""Plain versions of the corpus operators, one document after another, for small fixtures."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKED = re.compile(r"[^\x20\x09-\x0D]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.no_truncation()
    found.no_padding()
    return found


def base_counts(text):
    text = text or ""
    words = BLANKED.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, inside = Counter(windows), set()
    for i, window in enumerate(windows):
        if times[window] > 1:
            inside.update(range(i, i + 5))
    lines = [line for line in text.split("\n") if BLANKED.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def score(trees, row):
    total = trees.bias
    for node in trees.roots:
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        total += trees.value[node]
    return total


def fingerprint(text, width=4):
    words = BLANKED.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def classes(prints, most):
    """The least value reachable from each, by union of all pairs within ``most`` bits."""
    prints = sorted(prints)
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    bits = np.array([p & (1 << 64) - 1 for p in prints], dtype=np.uint64)
    for i, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= most):
            a, b = sorted((find(p), find(prints[i + 1 + int(j)])))
            parent[b] = a
    return {p: find(p) for p in prints}


def terms(text):
    return TERMS.findall((text or "").translate(LOWER))


def hits(text, items, length=10):
    """Words hit, and the ids of the items with an occurring window."""
    words, marked, found = terms(text), set(), set()
    for item_id, item in items:
        item = terms(item)
        size = min(length, len(item))
        windows = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if item else set()
        for i in range(len(words) - size + 1):
            if windows and tuple(words[i : i + size]) in windows:
                marked.update(range(i, i + size))
                found.add(str(item_id))
    return len(words), len(marked), sorted(found)


def targets(sizes, weights=(5, 2, 1), most=3):
    """Share by weight, cap, share the excess again, until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= most * sizes[s]
        open_ -= full
    return out


def copies(rows, weights=(5, 2, 1), most=3, seed="mix-1", bucket_rows=4096):
    """Times that each (doc_id, text, source) is taken, by position."""
    drawn = defaultdict(list)
    for at, (doc_id, text, source) in enumerate(rows):
        size = len(BLANKED.findall(text or ""))
        digest = hashlib.md5(f"{'' if doc_id is None else doc_id}/{seed}".encode()).hexdigest()
        u = (int(digest[:13], 16) + 0.5) / 2**52
        w = 1 / (1 + abs(len(text or "") / max(size, 1) - 1 - 5) / 5)
        drawn[source].append((-math.log(u) / w, doc_id is not None, doc_id or 0, hashlib.md5((text or "").encode()).hexdigest(), size, at))
    goal, out = targets({s: sum(r[4] for r in own) for s, own in drawn.items()}, weights, most), [0] * len(rows)
    for source, own in drawn.items():
        total = sum(r[4] for r in own)
        if not total:
            continue
        epochs = int(goal[source] // total)
        budget, run = goal[source] - epochs * total, 0
        buckets = -(-len(own) // bucket_rows)
        place = lambda r, n=buckets: min(n - 1, int(n * (1 - math.exp(-r[0]))))
        rest, end = [], None
        for r in sorted(own):
            out[r[5]] = epochs if r[4] else 0
            run += r[4]
            if not r[4]:
                continue
            if run <= budget:
                out[r[5]] += 1
            else:
                end = place(r) if end is None else end
                rest.append(r)
        taken = max([0, *(x for x in np.cumsum([r[4] for r in sorted(own)]).tolist() if x <= budget)])
        near = [r for r in rest if place(r) == end and abs(r[4] - (budget - taken)) < budget - taken]
        if near:
            out[min(near, key=lambda r: (abs(r[4] - (budget - taken)), r))[5]] += 1
    return out


def token_rows(rows):
    """doc_id, start, n_tokens, crc of (doc_id, text) in order of id."""
    coder, start, out = tokenizer(), 0, []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out
