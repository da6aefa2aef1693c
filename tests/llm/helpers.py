"""A small corpus with copies, near copies, repeats, nulls, and odd texts, and brute-force forms of the operators."""

import hashlib
import random
from collections import Counter

from xxhash import xxh64_intdigest

SYLLABLES = ["ba", "co", "di", "fu", "ge", "hé", "ÿo", "ka", "lu", "mo", "né", "Pa", "RO", "si"]


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def corpus(seed: int = 1) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    docs: list[str | None] = [None, "", " \t\n ", "one", "two words", "no break", "x" * 500, "ab " * 300]
    for k in range(30):
        text = " ".join(words(rng, rng.choice([3, 19, 20, 21, 40, 120, 400])))
        if k % 3 == 0:
            text = text[: len(text) // 2] + "\n" + passage + "  " + text[len(text) // 2 :]
        docs.append(text)
    docs += [docs[10], docs[11], docs[10]]
    near = docs[12].split(" ")
    for at in (1, 5, len(near) - 2):
        docs.append(" ".join([*near[:at], "changed", *near[at + 1 :]]))
    docs.append(" ".join(words(rng, 15_000)))
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(10 * i + 3, docs[k]) for i, k in enumerate(order)]


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def ascii_words(text: str | None) -> list[str]:
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, word] if word else out


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def fingerprint(text: str | None) -> int:
    w = ascii_words(ascii_lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes: dict[int, int], budget: int) -> dict[int, int]:
    label = {k: k for k in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if (nodes[a] ^ nodes[b]).bit_count() <= budget and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return label


def repeated_words(docs: list[tuple[int, str | None]], width: int = 20) -> dict[int, tuple[int, int, str]]:
    seen, out = set(), {}
    for k, text in sorted(docs):
        w = ascii_words(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            window = tuple(w[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        out[k] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def repeated_bytes(docs: list[tuple[int, str | None]], width: int = 200) -> dict[int, tuple[int, int, int, str]]:
    raws = {k: (t or "").encode() for k, t in docs}
    counts = Counter(raw[i : i + width] for raw in raws.values() for i in range(len(raw) - width + 1))
    out = {}
    for k, raw in raws.items():
        gone = [False] * len(raw)
        for i in range(len(raw) - width + 1):
            if counts[raw[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(raw), sum(gone), spans, sha(bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def similar_groups(docs: dict[int, str | None], least: float = 0.8) -> dict[int, int]:
    sets = {}
    for k, text in docs.items():
        w = ascii_words(ascii_lower(text or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    label, changed = {k: k for k in docs}, True
    near = [(a, b) for a in docs for b in docs if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label
