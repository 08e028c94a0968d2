"""Plain versions of the operators, for small inputs."""

import math
import re
from collections import Counter, defaultdict


def groups(links: dict) -> dict:
    """Smallest member of each member's connected group."""
    up = {i: i for i in links}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, others in links.items():
        for b in others:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in links}


def shingle_set(text, size=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def jaccard(texts: dict, threshold=0.8):
    """Per id: smallest id of its group, and number of links."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    links = {
        i: {j for j, b in sets.items() if i != j and a and b and len(a & b) >= threshold * len(a | b)}
        for i, a in sets.items()
    }
    found = groups(links)
    return {i: (found[i], len(links[i])) for i in texts}


def secrets(text):
    """(n_assign, n_access, n_hex), spans joined."""
    text = text or ""
    found = []
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for order, (kind, pattern, group, least) in enumerate(
        [("assign", assign, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    ):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                found.append((m.start(), order, m.end(), kind))
    found.sort()
    n = Counter(x[3] for x in found)
    return (n["assign"], n["access"], n["hex"]), ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def lm_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [None]


class KneserNey:
    """Interpolated modified Kneser-Ney over triples of words; what follows the start mark is counted plainly."""

    def __init__(self, texts):
        self.words, self.triples, self.pairs, self.follows = Counter(), Counter(), Counter(), Counter()
        for t in texts:
            tokens = lm_words(t)
            self.words.update(tokens)
            self.pairs["<s>", tokens[0]] += 1
            self.triples.update(zip(["<s>", *tokens], tokens, tokens[1:]))
        for _, v, w in self.triples:
            self.pairs[v, w] += 1
        for _, w in self.pairs:
            self.follows[w] += 1
        self.total, self.kinds = Counter(), defaultdict(Counter)
        for grams in (self.triples, self.pairs):
            for gram, c in grams.items():
                self.total[gram[:-1]] += c
                self.kinds[gram[:-1]][min(c, 3)] += 1
        self.d = {n: self.discounts(Counter(x.values())) for n, x in ((3, self.triples), (2, self.pairs), (1, self.follows))}
        self.left = sum(self.d[1][min(c, 3)] for c in self.follows.values())

    @staticmethod
    def discounts(n):
        if not n[1] or not n[2]:
            return [0, 0.5, 0.75, 0.75]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1]
        return [min(max(x, 0), max(k - 0.05, 0)) for k, x in enumerate(d)]

    def word(self, w):
        total, c = len(self.pairs), self.follows[w]
        return max(c - self.d[1][min(c, 3)], 0) / total + self.left / total / (len(self.words) + 1)

    def after(self, context, w):
        """Probability of a word after the words of a context, two at most."""
        if not context:
            return self.word(w)
        shorter = self.after(context[1:], w)
        if not self.total[context]:
            return shorter
        c, d = (self.triples if len(context) == 2 else self.pairs)[(*context, w)], self.d[len(context) + 1]
        left = sum(d[k] * n for k, n in self.kinds[context].items())
        return (max(c - d[min(c, 3)], 0) + left * shorter) / self.total[context]

    def score(self, text):
        tokens = ["<s>", *lm_words(text)]
        return sum(math.log10(self.after(tuple(tokens[max(i - 2, 0) : i]), tokens[i])) for i in range(1, len(tokens)))

    def base(self, text):
        n, size = sum(self.words.values()), len(self.words)
        return sum(math.log10((self.words[w] + 1) / (n + size + 1)) for w in lm_words(text))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]
