"""Plain-Python meaning of the operators."""

import math
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_duplicates(docs):
    """docs: {id: text} -> {id: (n_shingles, component)}"""
    sets = {d: shingles(t) for d, t in docs.items()}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return {d: (len(sets[d]), comp[d]) for d in ids}


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen, covered = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(k for i in places for k in range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def grams(text, buckets):
    """(buckets of the words, buckets of the pairs) of a text."""
    h = [_signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(text or "")]
    pack = lambda x: (x & (1 << 64) - 1).to_bytes(8, "little")
    two = [buckets if a == b else (xxhash.xxh64_intdigest(pack(b), xxhash.xxh64_intdigest(pack(a), 42)) >> 1) % buckets for a, b in zip(h, h[1:], strict=False)]
    return h, two


def ratios(docs, trusted, buckets, least, smoothing):
    each = {d: grams(t, buckets) for d, t in docs.items()}
    weights = []
    for k in (0, 1):
        raw, good = {}, {}
        for d, own in each.items():
            for g in own[k]:
                raw[g] = raw.get(g, 0) + 1
                good[g] = good.get(g, 0) + (d in trusted)
        pooled = (lambda g: g) if k else (lambda g, raw=dict(raw): g if raw[g] >= least else None)
        total = {}
        for g in raw:
            a, b = total.get(pooled(g), (0, 0))
            total[pooled(g)] = a + raw[g], b + good[g]
        n = buckets + 1 if k else len(total.keys() - {None}) + 1
        r, s = sum(raw.values()), sum(good.values())
        of = {g: round(math.log((b + smoothing) / (s + smoothing * n)) - math.log((a + smoothing) / (r + smoothing * n)), 5) if s else 0.0 for g, (a, b) in total.items()}
        weights.append({g: of[pooled(g)] for g in raw})
    return {d: (sum(weights[0][g] for g in one) + sum(weights[1][g] for g in two)) / max(1, len(one) + len(two)) for d, (one, two) in each.items()}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    """[(start, kind, end)] of the base kinds, sorted."""
    out = []
    for k, (kind, pattern) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip":
                good = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                good = 14 <= len(digits) <= 19 and luhn(digits)
            else:
                good = kind == "email" or 10 <= len(digits) <= 15
            if good:
                out.append((m.start(), k, kind, m.end()))
    return [(a, kind, b) for a, _, kind, b in sorted(out)]


def unit(name, key):
    h = xxhash.xxh64_intdigest(name.encode(), 42)
    if key is not None:
        h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), h)
    return ((h >> 11) + 0.5) / 2.0**53


def placed(regions, key):
    """The shard of a key in a tree without grants: the lowest draw at each level."""
    draw = lambda name, w: -math.log(unit(name, key)) / w
    weigh = lambda rack: sum(w for _, w in rack)
    i = min(range(len(regions)), key=lambda i: draw(f"region {i}", sum(map(weigh, regions[i]))))
    j = min(range(len(regions[i])), key=lambda j: draw(f"rack {i} {j}", weigh(regions[i][j])))
    return min(regions[i][j], key=lambda s: draw(f"shard {s[0]}", s[1]))[0]


def best_fit_bins(lengths, capacity):
    """How many bins best-fit decreasing opens, piece by piece."""
    import bisect

    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - n)
    return len(rooms)


def context_spans(docs, rounds, confident, least, identifier, hex_key):
    """{id: [(start, kind, end)]} of base and bootstrapped spans."""
    plain = lambda w: "#" if re.search("[0-9@]", w) else w.lower()
    tokens, places, base = {}, {}, {}
    for d, text in docs.items():
        text = text or ""
        base[d] = personal(text)
        led = ["^", "^", *WORD.findall(text)]
        for p in zip(map(plain, led), map(plain, led[1:]), strict=False):
            places[p] = places.get(p, 0) + 1
        tokens[d] = []
        for k, m in enumerate(WORD.finditer(text)):
            if not re.search("[0-9@]", m[0]) or any(a < m.start() < b for a, _, b in base[d]):
                continue
            lead = len(re.match("[^A-Za-z0-9+]*", m[0])[0])
            core = re.sub("[^A-Za-z0-9]+$", "", m[0][lead:])
            wide = [(a, b) for a, _, b in base[d] if m.start() <= a < m.end() < b]
            start, end = wide[0] if wide else (m.start() + lead, m.start() + lead + len(core))
            if wide or re.search(identifier, core):
                seed = bool(re.search(hex_key, core)) or any(a < end and start < b for a, _, b in base[d])
                tokens[d].append(((plain(led[k]), plain(led[k + 1])), text[start:end], start, end, seed))
    edges = {}
    for own in tokens.values():
        for pattern, instance, _, _, seed in own:
            n, s = edges.get((pattern, instance), (0, False))
            edges[pattern, instance] = n + 1, s or seed
    trust, good = {}, {}
    of = {}
    for (p, i), (n, seed) in edges.items():
        of.setdefault(p, []).append((i, n, seed))
    for _ in range(rounds):
        good = {}
        for p, own in of.items():
            each = [(n, 1.0 if seed else trust.get(i, 0.0)) for i, n, seed in own]
            share = sum(n * t for n, t in each) / max(places[p], sum(n for n, _ in each))
            if sum(t >= confident for _, t in each) >= least and share >= confident:
                good[p] = share
        doubt = {}
        for (p, i), _ in edges.items():
            if p in good:
                doubt[i] = doubt.get(i, 0.0) + math.log(max(1 - good[p], 1e-9))
        trust = {i: 1 - math.exp(x) for i, x in doubt.items()}
    out = {}
    for d, own in tokens.items():
        added = {(a, "context", b) for p, _, a, b, _ in own if p in good and not any(x < b and a < y for x, _, y in base[d])}
        order = ("email", "ip", "card", "phone", "context")
        out[d] = sorted([*base[d], *added], key=lambda s: (s[0], order.index(s[1]), s[2]))
    return out
