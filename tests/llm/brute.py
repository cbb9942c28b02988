"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def blank(t):
    return BLANK.findall(t or "")


def plain(t):
    return PLAIN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def sha(parts, by):
    return hashlib.sha256(by.join(parts).encode()).hexdigest()


def tokens(docs, tokenizer, end=2):
    out, start = [], 0
    for i, t in sorted(docs, key=lambda r: r[0]):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


def substrings(docs, n=50):
    words, first = [(i, blank(t)) for i, t in docs], {}
    for i, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k:k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k:k + n])] < i:
                gone[k:k + n] = [True] * n
        out.append((i, len(w), sum(gone), sha([x for x, g in zip(w, gone) if not g], " ")))
    return out


def targets(sizes, weights=(5, 2, 1), most=3):
    """Water-filling by repetition; sizes by source, None last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in held]
        level = (total - sum(most * sizes[s] for s in held)) / (sum(weight[s] for s in free) or 1)
        over = {s for s in free if level * weight[s] > most * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: most * sizes[s] if s in held else level * weight[s] for s in order}
        held |= over


def base_licenses(text, phrases):
    w, places, labels = plain(text), [], set()
    for phrase, label in phrases:
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k:k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def contaminated(docs, bench, n=13):
    windows = defaultdict(set)
    for item, t in bench:
        w = plain(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k:k + n])].add(item)
    out = []
    for i, t in docs:
        w = plain(t)
        hit, items = [False] * len(w), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                found = windows.get(tuple(w[k:k + size]))
                if found:
                    items |= found
                    hit[k:k + size] = [True] * size
        out.append((i, len(w), sum(hit), len(items), sha(sorted(map(str, items)), ","), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return out


class Groups(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self[b] = a


def near_groups(docs, threshold=0.8, width=5):
    """The smallest reachable doc_id of each document."""
    sets, inverted, groups = {}, defaultdict(list), Groups()
    for i, t in docs:
        w = blank(t)
        sets[i] = Counter(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else None
    for i, own in sets.items():
        groups.find(i)
        shared = Counter()
        for x, m in (own or {}).items():
            for j, other in inverted[x]:
                shared[j] += min(m, other)
            inverted[x].append((i, m))
        for j, m in shared.items():
            if m >= threshold * (sum(own.values()) + sum(sets[j].values()) - m) - 1e-9:
                groups.join(i, j)
    return {i: groups.find(i) for i in sets}


def languages(rows, background, weight=0.35, smooth=5.0, agree=8.0, disagree=1.0, bits=15, prior_grams=0.1 * (1 << 15)):
    """(language, confidence, text language) of each of ``rows`` (text, declared or None, host, label or None), by loops over all trigrams.

    ``background`` makes the even share of each table place from the labelled texts' bytes.
    """
    def grams(text):
        raw = b" " + re.sub(rb"[^a-z\x80-\xff]", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) + b"  "
        return [(((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 2654435761) & 0xFFFFFFFF) >> (32 - bits) for k in range(len(raw) - 2) if raw[k + 1] != 32]

    known = sorted({label for text, _, _, label in rows if label and text is not None})
    labelled = [(t, label) for t, _, _, label in rows if label and t is not None]
    seen = [0.0] * 256
    for text, _ in labelled:
        for b in f"{text} ".encode():
            low = b + 32 if 65 <= b <= 90 else b
            seen[low if 97 <= low <= 122 or low >= 128 else 32] += 1
    even, names = background(seen), [*known, "und"]
    counts = {n: Counter(g for t, label in labelled if label == n for g in grams(t)) for n in names}
    whole = {n: prior_grams + sum(counts[n].values()) for n in names}
    logs, shares = [], []
    for text, *_ in rows:
        own = [sum(math.log((even[g] * prior_grams + counts[n][g]) / whole[n]) for g in grams(text)) * weight for n in names]
        logs.append(own)
        top = [math.exp(x - max(own)) for x in own]
        shares.append([x / sum(top) for x in top])
    lettered = [bool(grams(text)) for text, *_ in rows]
    said = [d if d in names else ("?" if d else "") for _, d, _, _ in rows]
    parts = [h.split(".") for _, _, h, _ in rows]
    domain, suffix = [".".join(p[-2:]) if len(p) > 1 else "" for p in parts], [p[-1] if len(p) > 1 else "" for p in parts]

    def total(which):
        return [sum(shares[i][k] for i in which) for k in range(len(names))]

    def at(keys, key):
        return [i for i in range(len(rows)) if lettered[i] and keys[i] == key]

    def smoothed(which, above):
        return [(x + smooth * a) / (len(which) + smooth) for x, a in zip(total(which), above)]

    hosts = [h for _, _, h, _ in rows]
    everything = [i for i in range(len(rows)) if lettered[i]]
    prior = [(x + 1) / (len(everything) + len(names)) for x in total(everything)]
    told = {"": [0.0] * len(names)}
    for k, n in enumerate(names):
        sums = {d: total(at(said, d))[k] + (agree if d == n else disagree) for d in [*names, "?"]}
        for d, x in sums.items():
            told.setdefault(d, []).append(math.log(x / sum(sums.values())))
    found = []
    for i in range(len(rows)):
        if not lettered[i]:
            found.append(("und", 0.0, "und"))
            continue
        above = smoothed(at(domain, domain[i]), smoothed(at(suffix, suffix[i]), prior))
        here = [j for j in at(hosts, hosts[i]) if j != i]
        share = smoothed(here, above)
        sums = [x + t + math.log(max(p, 1e-9)) for x, t, p in zip(logs[i], told[said[i]], share)]
        best = max(range(len(names)), key=sums.__getitem__)
        found.append((names[best], 1 / sum(math.exp(x - sums[best]) for x in sums), names[max(range(len(names)), key=logs[i].__getitem__)]))
    return found
