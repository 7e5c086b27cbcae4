"""Plain re-statements of the operators' contracts, one document at a time, to hold the operators against."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(rows, pct=80):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                up[rb] = ra
                links[a] += 1
                links[b] += 1
    return {i: (len(sets[i]), root(i), links[i]) for i in ids}


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out)


def quality(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    hit = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(5)}
    base = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), base


def best_fit_decreasing(lengths, room):
    """Bins that best-fit decreasing opens, a document at a time."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, free in enumerate(bins) if free >= n]
        if fits:
            i = min(fits, key=lambda i: bins[i])
            bins[i] -= n
        else:
            bins.append(room - n)
    return len(bins)
