"""Plain Python versions of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BIG = 2**63 - 1


def key(k):
    return BIG if k is None else k


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) if not isinstance(x, list) else (False, x) for x in r))


def repeats(rows, size=20):
    docs, first = [(key(k), WORD.findall(t or "")) for k, t in rows], {}
    for k, w in docs:
        for i in range(len(w) - size + 1):
            g = tuple(w[i : i + size])
            first[g] = min(first.get(g, (k, i)), (k, i))
    out = []
    for (k, _), (kk, w) in zip(rows, docs):
        drop = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (kk, i):
                drop[i : i + size] = [True] * size
        out.append((k, len(w), sum(drop), " ".join(x for x, d in zip(w, drop) if not d)))
    return order(out)


def near(rows, pct=85, k=5):
    sets = []
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((key(d), {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    index, parent = {}, list(range(len(sets)))
    for i, (_, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (_, s) in enumerate(sets):
        for j, n in Counter(j for x in s for j in index[x] if j < i).items():
            if 100 * n >= pct * (len(s) + len(sets[j][1]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    show = lambda d: None if d == BIG else d
    return order([(rows[i][0], len(s), show(least[find(i)]), d == least[find(i)]) for i, (d, s) in enumerate(sets)])


def leaks(rows, items, size=10):
    win = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(size, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            win.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = []
    for d, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = [0] * len(w), set()
        for n in {len(g) for g in win}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in win:
                    found |= win[tuple(w[j : j + n])]
                    hit[j : j + n] = [1] * n
        out.append((d, len(w), sum(hit), sorted(found)))
    return order(out)


def mixed(rows, weights=(5, 2, 1), share=1.5, cap=2.0, seed="mix"):
    sized = [(d, s, len(WORD.findall(t or ""))) for d, s, t in rows]
    names = sorted({s for _, s, _ in sized if s is not None}) + ([None] if any(s is None for _, s, _ in sized) else [])
    size = {s: sum(n for _, x, n in sized if x == s) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, list(names), share * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > cap * size[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = cap * size[s]
            left -= target[s]
            free.remove(s)
    out = []
    for s in names:
        budget = int(target[s] + 1e-9)
        rest = budget % size[s] if size[s] else 0
        before = 0
        number = lambda d: int(hashlib.md5(f"{seed}|{'' if d is None else d}".encode()).hexdigest()[:13], 16)
        for d, _, n in sorted((r for r in sized if r[1] == s), key=lambda r: (number(r[0]), key(r[0]), r[2])):
            out.append((d, n, size[s], (budget // size[s] * n if size[s] else 0) + max(0, min(n, rest - before))))
            before += n
    return order(out)


def line_fails(line):
    from loomlake.llm.quality import BOILERPLATE

    w = WORD.findall(line)
    if not w:
        return False
    return (
        2 * sum(x.endswith("!!") for x in w) >= len(w)
        or (not re.search("[.,;:!?…¿¡。、，．；：！？؟،؛۔।॥։՝՞՜።፣፤፥፦፧၊။។།᠂᠃\u0e00-\u0eff]", line) and len(w) >= 8)
        or sum(x in "|»›·•" for x in w) >= 3
        or any(p in line.lower() for p in BOILERPLATE)
        or 2 * len(re.findall("[#*$%&|<>]", line)) >= len(w)
        or (len(w) >= 16 and 4 * len(set(w)) < len(w))
    )


def judged(rows):
    out = []
    for d, t in rows:
        t = t or ""
        w, c = WORD.findall(t), Counter()
        for i in range(len(w) - 4):
            c[tuple(w[i : i + 5])] += 1
        cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = t.split("\n")
        full = [x for x in lines if WORD.search(x)]
        good = [x for x in lines if not line_fails(x)]
        lost = len(w) - sum(len(WORD.findall(x)) for x in good)
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        out.append((d, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(full) - len(set(full)), len(cover), "\n".join(good), failed, not failed and 100 * lost <= 50 * len(w)))
    return order(out)


def lines(rows, least=10):
    """Every place of a line against every earlier one, extended as far as they agree; rows that repeat whole are copies of the first."""
    docs, seen = [], set()
    for d, t in rows:
        raw = (t or "").split("\n")
        own = [(p, x, len(WORD.findall(x))) for p, x in enumerate(raw) if WORD.search(x)]
        docs.append(((key(d), xxhash.xxh64((t or "").encode(), seed=42).intdigest() - (2**64 if xxhash.xxh64((t or "").encode(), seed=42).intdigest() >= 2**63 else 0)), t, raw, own, (d, t) in seen))
        seen.add((d, t))
    places = {}
    for n, (k, _, _, own, copy) in enumerate(docs):
        if not copy:
            for a, x in enumerate(own):
                places.setdefault(x[1], []).append((k, a, n))
    out = []
    for n, (d, t) in enumerate(rows):
        k, _, raw, own, copy = docs[n]
        gone = set()
        if copy and sum(x[2] for x in own) >= least:
            gone = set(range(len(own)))
        for a in range(len(own)):
            for kk, aa, m in places[own[a][1]]:
                if (kk, aa) < (k, a) and not copy:
                    size, other = 0, docs[m][3]
                    while a + size < len(own) and aa + size < len(other) and own[a + size][1] == other[aa + size][1]:
                        size += 1
                    if sum(x[2] for x in own[a : a + size]) >= least:
                        gone.update(range(a, a + size))
        drop = {own[i][0] for i in gone}
        out.append((d, None if t is None else "\n".join(x for p, x in enumerate(raw) if p not in drop), len(own), len(drop)))
    return order(out)


def secrets(rows, max_owners=2, max_repos=3):
    """rows: (id, owner, language, text) to (id, counts by kind, base, spans, statuses, holders), all plain."""
    import math

    base_rules = [
        ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32),
    ]
    more = [
        ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0), ("token", r"\b(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|sk-|AIza|npm_|hf_)[A-Za-z0-9_-]{16,}", 0),
        ("url", r"://([^\s:/@]+):([^\s/@]+)@", 2), ("random", r"[A-Za-z0-9+/_=-]{24,}", 0),
    ]
    kinds = ["assign", "access", "hex", "token", "jwt", "url", "random"]
    bits = lambda v: -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values())
    found, owners, repos = [], {}, {}
    for _, owner, lang, text in rows:
        own = [(k, *m.span(), m[g]) for k, rule, g, least in base_rules for m in rule.finditer(text or "") if len(m[g]) >= least]
        every = list(own)
        for k, rule, g in more:
            for m in re.finditer(rule, text or ""):
                v = m[g]
                if k == "random" and not (re.search("[a-z]", v) and re.search("[A-Z]", v) and len(re.findall("[0-9]", v)) >= 2 and bits(v) >= 4):
                    continue
                if all(m.end(g) <= a or b <= m.start(g) for _, a, b, _ in every):
                    every.append((k, *m.span(g), v))
        for *_, v in every:
            owners.setdefault(v, set()).add(owner)
            repos.setdefault(v, set()).add((owner, lang))
        found.append((own, every))
    out = []
    for (d, *_), (own, every) in zip(rows, found):
        def status(k, v):
            if len(owners[v]) > max_owners or len(repos[v]) > max_repos:
                return "copied"
            bad = ["example", "changeme", "placeholder", "your_", "xxxx", "1234567"] + (["password", "passwd", "secret", "username", "hunter2", "${", "{{", "<", "***"] if k == "url" else [])
            least = min(3.0, 0.8 * math.log2(max(2, len(v)))) if k == "url" else 3.0
            return "live" if bits(v) >= least and not any(b in v.lower() for b in bad) else "plain"

        listed = lambda spans: sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))
        text = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in listed(spans))
        spans = [s for s in every if s[0] in kinds[:3] or status(s[0], s[3]) == "live"]
        states = ",".join(f"{k}:{a}:{status(k, v)}" for k, a, _, v in listed(every))
        held = ",".join(f"{k}:{a}:{len(owners[v])}:{len(repos[v])}" for k, a, _, v in listed(every))
        out.append((d, *(sum(s[0] == k for s in own) for k in kinds[:3]), text(own), text(spans), states, held))
    return order(out)
