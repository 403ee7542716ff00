"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def spans(text):
    out = []
    for n, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def span_text(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def repeats(texts, length=400):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text."""
    data, count, out = [(t or "").encode() for t in texts], Counter(), []
    for b in data:
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, n):
    words = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in (text or "").encode().split()]
    if len(words) >= n:
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    return {tuple(words)} if words else set()


def joined(ids, linked):
    """Component of each id, given a test of two positions."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(ids)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low[find(i)] for i in range(len(ids))]


def near(texts, ids, n, percent=80):
    sets = [shingles(t, n) for t in texts]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return both > 0 and 100 * both >= percent * len(sets[i] | sets[j])

    return [len(s) for s in sets], joined(ids, linked)


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def allot(sizes, weights, share=1.5, most=2):
    """Targets: share times all sizes by weight, none above most times its size."""
    targets, free, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0], share * sum(sizes)
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole > most * sizes[i]]
        for i in over or free:
            targets[i] = float(most * sizes[i]) if over else left * weights[i] / whole
        left -= sum(targets[i] for i in over)
        free = [i for i in free if i not in over] if over else []
    return targets


def mixed(rows, golden, block=256, weights=(5, 2, 1)):
    """rows: (id, source, text). For each row (size, source_size, target, taken, first_slot), and the words taken of it in each pass."""
    size = [len((t or "").encode().split()) for _, _, t in rows]
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for n, r in zip(size, rows, strict=True) if r[1] == s) for s in names]
    targets = allot(sizes, [weights[i % len(weights)] for i in range(len(names))])
    goals = [int(t + 0.5) for t in targets]
    quotas = [-(-g // block) for g in goals]
    blocks, owner = sum(quotas), [i for i, q in enumerate(quotas) for _ in range(q)]
    slots = [[] for _ in names]
    for k in range(2 * blocks + 64 if blocks else 0):
        i = owner[((k + 1) * golden % (1 << 62)) * blocks >> 62]
        if len(slots[i]) < quotas[i]:
            slots[i].append(k)
    assert [len(x) for x in slots] == quotas
    seen, order = Counter(), []
    for n, (i, s, t) in enumerate(rows):
        order.append(seen[(i, s, t)])
        seen[(i, s, t)] += 1
    taken, first, parts = [0] * len(rows), [None] * len(rows), [[] for _ in rows]
    for no, s in enumerate(names):
        own = [n for n, r in enumerate(rows) if r[1] == s and size[n]]
        at = 0
        for turn in (0, 1) if goals[no] > sizes[no] else (0,):
            place = lambda n: hashlib.md5(":".join(str(x) for x in (turn, rows[n][0], size[n], order[n]) if x is not None).encode()).hexdigest()[:15]  # noqa: B023, E731
            for n in sorted(own, key=place):
                words = max(0, min(at + size[n], goals[no]) - at)
                if words:
                    taken[n] += words
                    parts[n].append(words)
                    met = slots[no][at // block : (at + words - 1) // block + 1]
                    first[n] = min([*met, *([] if first[n] is None else [first[n]])])
                at += size[n]
    by = dict(zip(names, zip(sizes, targets, strict=True), strict=True))
    return [(size[n], *by[r[1]], taken[n], first[n]) for n, r in enumerate(rows)], parts


def bootstrap(texts, pii):
    """For each text the found spans (start, kind number, stop) of the bootstrap, step by step; pii: the module, for its fixed values."""
    space = " \t\n\x0b\f\r"
    alnum = lambda c: c.isalpha() or c.isnumeric()
    word = re.compile(pii.WORD)
    patterns = [re.compile(p) for _, p in KINDS]
    candidate = re.compile(pii.CANDIDATE)

    def kind_of(n, value):
        return n if any(k == KINDS[n][0] and (a, b) == (0, len(value)) for k, a, b in spans(value)) else None

    def slot(sort, value, lead, tail, l1, l2, r1):
        has = lambda w: any(c.isalpha() for c in w)
        if sort == "around":
            return f"around:{l1} {lead}_{tail} {r1}" if has(l1) and has(r1) else None
        if sort == "two":
            return f"two:{l2} {l1} {lead}_" if l1 and l2 and (has(l1) or has(l2)) else None
        if sort == "one":
            return f"one:{l1} {lead}_" if has(l1) else None
        return f"affix:{value[:4]}" if len(value) >= 16 and all(c.isalpha() for c in value[:4]) else None

    def gaps(text, found):
        ends = [0, *[m.end() for m in found]]
        return [(text[e : m.start()][-80:], text[m.end() : (found[i + 1].start() if i + 1 < len(found) else len(text))][:80]) for i, (e, m) in enumerate(zip(ends, found, strict=False))]

    def contexts(value, before, after):
        before, after, value = before.lower(), after.lower(), value.lower()
        glue = re.search(rf"[^{space}]*$", before)[0]
        tail = re.match(rf"[^{space}]*", after)[0]
        left, right = word.findall(before[: len(before) - len(glue)]), word.findall(after[len(tail) :])
        l1, l2, r1 = (left or [""])[-1], left[-2] if len(left) > 1 else "", (right or [""])[0]
        out = []
        if re.match(r"[^=:]*[=:]['\"]?$", glue) and any(c.isalpha() for c in re.split("[=:]", glue)[0]):
            out.append(f"glued:{glue}_")
        for sort in ("around", "two", "one"):
            if not any(map(alnum, glue)) and not (sort == "around" and any(map(alnum, tail))):
                out.append(slot(sort, value, glue, tail, l1, l2, r1))
        out.append(slot("affix", value, glue, tail, l1, l2, r1))
        return [p for p in out if p]

    seen = []  # text, start, stop, value, kind, patterns
    for t, text in enumerate(texts):
        text = text or ""
        for n, p in enumerate(patterns):
            found = list(p.finditer(text))
            for m, (b, a) in zip(found, gaps(text, found), strict=True):
                kind = kind_of(n, m[0])
                if kind is not None or (" " in m[0] and not re.search(rf"[^{space}(]$", b) and not re.match(rf"[^{space}).,;:!?]", a)):
                    seen.append((t, m.start(), m.end(), m[0], kind, contexts(m[0], b, a)))
        found = list(candidate.finditer(text))
        for m, (b, a) in zip(found, gaps(text, found), strict=True):
            firsts = [(n, f[0]) for n, p in enumerate(patterns) if (f := p.search(m[0]))]
            if not any(kind_of(n, v) is not None for n, v in firsts):
                seen.append((t, m.start(), m.end(), m[0], None, contexts(m[0], b, a)))
    edges = {}
    for _, _, _, value, kind, own in seen:
        worth = 1.0 if kind is not None else pii.PRIOR if re.match(pii.KEY_SHAPE, value) else 0.0
        kind = pii.SECRET if kind is None and worth else kind
        for p in own:
            if (p, value) not in edges or edges[p, value][1] < worth:
                edges[p, value] = (kind, worth)
    by = {}
    for (p, value), (kind, worth) in edges.items():
        by.setdefault(p, {})[value] = (kind, worth)
    score = {}
    for _ in range(pii.ROUNDS):
        good = {}
        for p, own in by.items():
            kinds = [k for k, _ in own.values() if k is not None]
            if len(kinds) >= pii.MIN_SEEDS:
                mean = sum(1 - (1 - w) * (1 - score.get(v, 0.0)) for v, (_, w) in own.items()) / len(own)
                good[p] = (mean, min(kinds, key=lambda k: (-kinds.count(k), k)), len(own))  # noqa: B023
        doubt = {}
        for (p, v), (_, w) in edges.items():
            if p in good and w < 1:
                doubt[v] = doubt.get(v, 1.0) * (1 - min(good[p][0], 0.999))
        score = {v: 1 - d for v, d in doubt.items()}
    good = {p: x for p, x in good.items() if x[0] >= pii.MIN_CONFIDENCE - 1e-12}
    bare = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w)
    known = {p: {bare(v.lower().split(" ")[0]) for v in own} for p, own in by.items()}
    fills = []  # text, pattern, word, start, stop
    for t, text in enumerate(texts):
        places = list(word.finditer(text or ""))
        low = [m[0].lower() for m in places]
        for i, (w, m) in enumerate(zip(low, places, strict=True)):
            lead = re.match(r"[\W_]*", w)[0]
            tail = re.search(r"[\W_]*$", w)[0]
            l1, l2, r1 = (low[k] if 0 <= k < len(low) else "" for k in (i - 1, i - 2, i + 1))
            stop = m.start() + len(re.sub(r"[\W_]+$", "", m[0]))
            for sort in ("around", "two", "one", "affix"):
                if w[len(lead) :] and (p := slot(sort, bare(w), lead, tail, l1, l2, r1)) in good:
                    fills.append((t, p, bare(w[len(lead) :]), m.start() + len(lead), stop))
            name = re.match(r"([^=:]*[=:]['\"]?)(?=[^\W_])", w)
            if name and any(c.isalpha() for c in re.split("[=:]", name[0])[0]) and (p := f"glued:{name[0]}_") in good:
                fills.append((t, p, bare(w[len(name[0]) :]), m.start() + len(name[0]), stop))
    doubts = {p: {w for _, q, w, _, _ in fills if q == p} - known[p] for p in good}
    sure = {p: (c * n / (n + len(doubts[p])), k) for p, (c, k, n) in good.items()}
    sure = {p: x for p, x in sure.items() if x[0] >= pii.MIN_CONFIDENCE - 1e-12}
    unseen = {}
    for t, a, b, _, kind, own in seen:
        if kind is None:
            for p in own:
                if p in sure:
                    unseen.setdefault((t, a, b, False), []).append(sure[p])
    for t, p, _, a, b in fills:
        if p in sure and a < b:
            unseen.setdefault((t, a, b, True), []).append(sure[p])
    out = [[] for _ in texts]
    for (t, a, b, loose), own in sorted(unseen.items(), key=lambda x: (x[0][0], x[0][3], x[0][1], -x[0][2])):
        doubt = 1.0
        for trust, _ in own:
            doubt *= 1 - min(trust, 0.999)
        if 1 - doubt >= pii.MIN_SCORE and not any(a < y and x < b for _, x, y in spans(texts[t])) and not any(a < y and x < b for x, _, y in out[t]):
            out[t].append((a, max(own)[1], b))
    return [sorted(x) for x in out]


def notices(text, scanner, licenses):
    """(paragraph, first, last, family, confirmed) of the notices of a text, window by window."""
    out, families = [], list(licenses.TEMPLATES)
    templates = [(f, licenses.grams(t)) for f in families for t in licenses.TEMPLATES[f]]
    known = set(scanner.vocabulary).union(*[g for _, g in templates])
    for number, run in enumerate(re.split(licenses.BLANK, text or "")):
        lines = [x for x in (re.findall(licenses.TOKEN, line.lower()) for line in run.split("\n")) if x]
        units = []
        for i, own in enumerate(lines):
            k, words = 0, 0
            while True:
                parts = own if not k else own[-licenses.WINDOW :] + [w for x in lines[i + 1 : i + k + 1] for w in x[: licenses.WINDOW]]
                grams = {*parts, *map(" ".join, zip(parts, parts[1:], strict=False))}
                if grams & set(scanner.vocabulary):
                    grams &= known
                    p = scanner.probabilities(grams)
                    best = int(p[:-1].argmax())
                    if p[-1] < 0.5:
                        shares = [(len(grams & g) / len(g), len(g)) for f, g in templates if best < len(families) and f == families[best]]
                        family = families[best] if best < len(families) and p[best] >= scanner.threshold else "unknown"
                        confirmed = family != "unknown" and max(s for s, _ in shares) >= licenses.CONFIRMED - 1e-12
                        like = max((2 * s * n / (len(grams) + n) for s, n in shares), default=0.0)
                        units.append(((not confirmed, -round(like, 9) if confirmed else 0, k, i), i, i + k, family, confirmed))
                k += 1
                if i + k >= len(lines) or words >= licenses.WINDOW:
                    break
                words += len(lines[i + k])
        taken = []
        for _, a, b, family, confirmed in sorted(units):
            if not any(a <= y and x <= b for x, y in taken):
                taken.append((a, b))
                out.append((number, a, b, family, confirmed))
    return sorted(out)
