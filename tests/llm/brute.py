"""Plain Python versions of the numbered queries."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\v\f\r"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def crc_mod(doc_id, mod):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def lines(rows):
    """op3 over (doc_id, text)."""
    least = -(1 << 63)
    split = [(least if i is None else i, (t or "").split("\n")) for i, t in rows]
    keys = [[x.strip(SPACE).translate(LOWER) for x in parts] for _, parts in split]
    n, last = Counter(), {}
    for (i, _), own in zip(split, keys):
        for k in {k for k in own if len(k) >= 20}:
            n[k] += 1
            last[k] = max(last.get(k, i), i)
    out = []
    for (i, parts), own, (doc_id, _) in zip(split, keys, rows):
        gone = [len(k) >= 20 and n[k] >= 3 and i < last[k] for k in own]
        out.append((doc_id, len(parts), sum(gone), sha("\n".join(p for p, g in zip(parts, gone) if not g))))
    return out


def personal(text):
    """The base spans of op4."""
    text, found = text or "", []
    forms = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(sum(divmod(int(x) * 2, 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0

    for rank, (kind, form) in enumerate(forms.items()):
        for m in re.finditer(form, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                found.append((m.start(), rank, kind, m.end()))
    return sorted(found)


def base_scores(rows):
    """op5's (doc_id, held_out, n_tokens, n_known, N, base_score)."""
    tokens = [[*words_of(t), None] for _, t in rows]
    count = Counter(x for (i, _), own in zip(rows, tokens) if crc_mod(i, 7) != 2 for x in own)
    n, v = sum(count.values()), len(count)
    return [
        (i, crc_mod(i, 7) == 2, len(own), sum(count[x] > 0 for x in own), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in own))
        for (i, _), own in zip(rows, tokens)
    ]


BEGIN = "\n"


class Backoff:
    """p(w | h) of op5 by its definition, from counts of the tuples in ``train``."""

    def __init__(self, train, mu):
        self.mu, self.count, self.first = mu, Counter(), len(train)
        for _, t in train:
            own = [BEGIN, *words_of(t), None]
            for k in range(1, len(mu) + 2):
                self.count.update(tuple(own[a : a + k]) for a in range(len(own) - k + 1))
        self.n = sum(n for g, n in self.count.items() if len(g) == 1 and g != (BEGIN,))
        self.v = sum(len(g) == 1 and g != (BEGIN,) for g in self.count)

    def __call__(self, history, word):
        if not history:
            return (self.count[(word,)] + 1) / (self.n + self.v + 1)
        lower, held = self(history[1:], word), self.count[history]
        mu = self.mu[len(history) - 1]
        return (self.count[(*history, word)] + mu * lower) / (held + mu) if held else lower


def backoff_scores(rows, mu, train=lambda i: crc_mod(i, 7) != 2):
    """op5's score of each row."""
    p, out = Backoff([r for r in rows if train(r[0])], mu), []
    for _, t in rows:
        own = [BEGIN, *words_of(t), None]
        out.append(sum(math.log10(p(tuple(own[max(0, i - len(mu)) : i]), own[i])) for i in range(1, len(own))))
    return out


def overlaps(rows, items):
    """op8 over (doc_id, text) and (item_id, text)."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        k = min(13, len(w))
        for a in range(len(w) - k + 1) if w and i is not None else ():
            windows[tuple(w[a : a + k])].add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = cut(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if own := windows.get(tuple(w[a : a + k])):
                    hit |= set(range(a, a + k))
                    found |= own
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return out


def jaccard(rows, k, percent):
    """op10: (doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for a, b in {(a, b) for own in holders.values() for a in own for b in own if a < b}:
        both = len(sets[a] & sets[b])
        if both * 100 >= (len(sets[a]) + len(sets[b]) - both) * percent:
            root[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    least = {r: min((rows[i][0] for i in own if rows[i][0] is not None), default=None) for r, own in groups.items()}
    return [(rows[i][0], len(s), least[find(i)]) for i, s in enumerate(sets)]


def trie(rows, graft=True):
    """op13 over (conv_id, turn, role, text); with ``graft`` conversations are rebuilt."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    built = dict(own)
    for c, v in own.items():
        if graft:
            h = crc_mod(c, 6)
            base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
            built[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(k))
        out.append((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], sha(ends)))
    return out
