"""Second versions of operators in plain Python, one text and one number at a time, for tests alone."""

import math
import re

import numpy as np

MASK = 2**64 - 1
PRIME = 0x9E3779B97F4A7C15


def mixed(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & MASK
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & MASK
    return h ^ h >> 33


def words(text):
    return re.findall(r"[a-z0-9_\u0080-\U0010ffff]+", (text or "").lower())


def hashed(piece, k=0):
    return mixed((sum((b + 1) * pow(PRIME, i, 2**64) for i, b in enumerate(piece)) + k) & MASK)


def features(text, prefixes=(4, 5, 6)):
    """Hash of each feature of a text, and how often it has it."""
    out = {}
    for w in words(text):
        raw = w.encode()
        for h in [hashed(raw), *(hashed(raw[:n], k) for k, n in enumerate(prefixes, 1) if len(raw) > n)]:
            out[h] = out.get(h, 0) + 1
    return out


def up_to(text, model):
    """P(grade > k) of a text under an ordinal model."""
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    s = sum(weight[h] * (1 + math.log(n)) for h, n in features(text).items() if h in weight)
    return [1 / (1 + math.exp(-max(-35.0, min(35.0, s - c)))) for c in model.cuts.tolist()]


def shingles(text, n=3):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(texts, threshold=0.5):
    """texts by id: of each id the least id connected to it, and how many are linked to it."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders, common = {}, {}
    for i, s in sets.items():
        for g in s:
            for j in holders.setdefault(g, []):
                common[j, i] = common.get((j, i), 0) + 1
            holders[g].append(i)
    root, links = {i: i for i in texts}, dict.fromkeys(texts, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, j), n in common.items():
        if n >= threshold * (len(sets[i]) + len(sets[j]) - n):
            links[i] += 1
            links[j] += 1
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in texts}


class Secrets:
    """The scan for secrets, run by run. texts: all documents."""

    def __init__(self, texts, S):
        self.S = S
        self.base = S.ENCODINGS["base64_any"].lower()
        self.null = [self.chain(texts), {(a, b): float(S._english()[ord(a), ord(b)]) for a in map(chr, range(128)) for b in map(chr, range(128))}]
        found = {}
        for t in texts:
            for _, run in self.runs(t):
                for c in self.candidates(run):
                    e = self.encoding(c)
                    found.setdefault((e, math.floor(2 * math.log2(len(c) / S.LEAST))), []).append(self.bin(self.p_ordinary(c, e)))
        self.least = {}
        for key, bins in found.items():
            for at in sorted(set(bins), reverse=True):
                if 10 ** (-at / S.BINS_PER_DECADE) <= S.FDR * sum(b >= at for b in bins) / len(bins):
                    self.least[key] = at

    def runs(self, text):
        allowed = self.S.ENCODINGS["base64_any"]
        out, k, text = [], 0, text or ""
        while k < len(text):
            e = k
            while e < len(text) and text[e] in allowed:
                e += 1
            before, after = text[k - 1 : k] if k else "", text[e : e + 1]
            if e - k >= self.S.LEAST and not re.match(r"[\w+/-]", before) and not re.match(r"[\w+/-]", after):
                out.append((k, text[k:e]))
            k = max(e, k + 1)
        return out

    def candidates(self, run):
        some = [run]
        if m := re.search("[-_/+]+", run):
            rest = run[m.end() :]
            some += [*re.split("[-_/+]+", run), rest, re.sub("[-_/+]+", "", run), re.sub("[-_/+]+", "", rest)]
        return [x for x in dict.fromkeys(some) if len(x) >= self.S.LEAST]

    def encoding(self, run):
        return next(k for k, a in enumerate(self.S.ENCODINGS.values()) if set(run) <= set(a))

    def chain(self, texts):
        """How often one ASCII character follows another outside runs, case aside."""
        out = {}
        for t in texts:
            t = t or ""
            pairs = [(a, b) for a, b in zip(t, t[1:]) if ord(a) < 128 and ord(b) < 128]
            for _, run in self.runs(t):
                for p in zip(run, run[1:]):
                    pairs.remove(p)
            for a, b in pairs:
                key = a.lower(), b.lower()
                out[key] = out.get(key, 0) + 1
        return out

    def p_ordinary(self, run, e):
        alphabet = list(self.S.ENCODINGS.values())[e]
        every = {c: self.base.count(c) for c in set(self.base)}
        gains = []
        for table, prior in zip(self.null, (self.S._PRIOR, 0.0)):
            gain = 0.0
            for a, b in zip(run.lower(), run.lower()[1:]):
                whole = sum(table.get((a, c), 0.0) for c in every)
                under = (table.get((a, b), 0.0) + prior * every[b] / sum(every.values()) + 1e-12) / (whole + prior + 1e-12)
                gain += float(np.float32(math.log(alphabet.lower().count(b) / len(alphabet) / under)))
            gains.append(gain)
        return min(1.0, len(self.S.ENCODINGS) * math.exp(-min(gains)))

    def bin(self, p):
        return min(math.floor(-math.log10(max(p, 1e-300)) * self.S.BINS_PER_DECADE), self.S.BINS_PER_DECADE * self.S.DECADES)

    def battery(self, run, e):
        """p-values of uniformity, runs and serial correlation, and Fisher's of all."""
        tail = lambda z: math.erfc(abs(z) / math.sqrt(2))
        alphabet = list(self.S.ENCODINGS.values())[e]
        value = {c: k for k, c in enumerate(alphabet)} | ({"-": 64, "_": 65} if len(alphabet) == 66 else {})
        v, n, k = [value[c] for c in run], len(run), len(alphabet)
        chi2 = sum((v.count(x) - n / k) ** 2 / (n / k) for x in range(k))
        df = k - 1
        scaled = max(df + (chi2 - df) * math.sqrt(2 * df / (2 * df * (1 - 1 / n))), 1e-9)
        p_uniform = tail(((scaled / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
        high = [x >= k // 2 for x in v]
        n1 = sum(high)
        n0, r = n - n1, 1 + sum(a != b for a, b in zip(high, high[1:]))
        var = 2 * n1 * n0 * (2 * n1 * n0 - n) / (n * n * (n - 1))
        p_runs = 2 * 0.5 ** (n - 1)
        if var > 0:
            z = (r - 2 * n1 * n0 / n - 1) / math.sqrt(var)
            p_runs = tail(max(abs(z) - 0.5 / math.sqrt(var), 0))
        mean = sum(v) / n
        spread = sum((x - mean) ** 2 for x in v)
        rho = sum((a - mean) * (b - mean) for a, b in zip(v, v[1:])) / spread if spread else 1.0
        p_serial = tail((rho + 1 / n) * math.sqrt(n))
        half = -sum(math.log(max(p, 1e-300)) for p in (p_uniform, p_runs, p_serial))
        return p_uniform, p_runs, p_serial, math.exp(-half) * (1 + half + half * half / 2)

    def secrets(self, text):
        """(start, run) of each secret of a text."""
        out = []
        for start, run in self.runs(text):
            for c in self.candidates(run):
                e = self.encoding(c)
                least = self.least.get((e, math.floor(2 * math.log2(len(c) / self.S.LEAST))))
                if least is not None and self.battery(c, e)[3] >= self.S.REJECT and self.bin(self.p_ordinary(c, e)) >= least:
                    out.append((start, run))
                    break
        return out

    def redacted(self, text):
        for start, run in reversed(self.secrets(text)):
            text = text[:start] + self.S.MASK + text[start + len(run) :]
        return text
