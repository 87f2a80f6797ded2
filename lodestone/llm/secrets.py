"""Secret scans: a battery of randomness tests on token-like runs, with length-aware false-discovery control.

1. Candidates are maximal runs of ``LEAST`` or more characters of the base64 alphabets. The smallest alphabet that holds
   a run is its inferred encoding (decimal, hex, base32, base36, letters, base64). A run with - _ / or + in it also has its
   parts, the rest after its first label, and both without separators as candidates, each of its own encoding; the run is a
   secret if one of them is.
2. The battery asks whether a run could be random over that alphabet: chi-squared uniformity (two-sided: a counter is too
   even), Wald-Wolfowitz runs about the middle of the alphabet, and lag-1 serial correlation. Their p-values are combined
   by Fisher's method. A run whose combined value is below ``REJECT`` is structured, and no secret.
3. What passes may still be ordinary text. Its likelihood over uniform characters of its alphabet, divided by that under
   ordinary text, is its evidence: a Markov chain of the characters, case aside, as it is in all documents outside such runs,
   and the same with plain English in place of these documents; the lesser of the two counts. Under ordinary text a ratio of
   x or more has a probability of 1 / x at most, so 1 / x (times the alphabets that it was chosen from) is the p-value.
   Benjamini-Hochberg at level ``FDR`` runs within each encoding and band of lengths, so crowds of short words don't
   decide over long keys, nor the other way round. p-values are counted in fine bins, each taken at its upper edge, so the
   tables that leave the executors have a bounded size at any scale.

Decisions depend on the run alone and on those tables, so texts are never shuffled.

Edge cases: null and empty texts have no runs; rows that repeat are scanned each; a run inside a longer word with letters
beyond ASCII is no run; texts of any length are scanned whole; an empty table gives an empty result; further columns are
ignored by ``scan`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import per_slice, raw

#: Characters of a candidate, at least.
LEAST = 16
#: Combined p-value of randomness below which a run is structured.
REJECT = 1e-4
#: Level of the false-discovery control.
FDR = 0.001
#: What redact puts in place of a secret.
MASK = "[SECRET]"
#: Bins of a p-value's decimal logarithm.
BINS_PER_DECADE, DECADES = 50, 40

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Smallest first. The two base64 alphabets share places 62 and 63.
ENCODINGS: dict[str, str] = {
    "decimal": _DIGIT,
    "hex": _DIGIT + "abcdef",
    "hex_upper": _DIGIT + "ABCDEF",
    "letters": _LOWER,
    "letters_upper": _UPPER,
    "base32": _UPPER + "234567",
    "base36": _DIGIT + _LOWER,
    "base36_upper": _DIGIT + _UPPER,
    "letters_mixed": _LOWER + _UPPER,
    "base62": _UPPER + _LOWER + _DIGIT,
    "base64": _UPPER + _LOWER + _DIGIT + "+/",
    "base64url": _UPPER + _LOWER + _DIGIT + "-_",
    "base64_any": _UPPER + _LOWER + _DIGIT + "+/-_",
}
_NAMES = list(ENCODINGS)
_RUN = re.compile(r"(?<![\w+/-])[A-Za-z0-9+/_-]{%d,}(?![\w+/-])" % LEAST)
_CUT = re.compile("[-_/+]+")
_VALUES = np.full((len(_NAMES), 128), -1, np.int64)
for _k, _alphabet in enumerate(ENCODINGS.values()):
    for _v, _c in enumerate(_alphabet):
        _VALUES[_k, ord(_c)] = _v
_SIZES = np.array([len(a) for a in ENCODINGS.values()])
#: Bits of a letter after another in English, from a to z, in hexadecimal.
_ENGLISH = """
c546a87c5c7343c6c33266986a 4a682ccc53c3ab47c5693ccc3c 3c6b3cc45c53ab39c5824ccc9c 56951ccc2cc6cb4cca4749cc6c
584365797cc553a56334c6746c 4bcc45ac2ca5cc29c4a53ccc7c 598c2a543cc47379c4453bcccc 3ccc1ccc3cca8b3cc6b79cccac
6646546cac855237c633c6c8c7 7b7b0bbbbbbbbb7bbbbb5bbbbb 5b8b19693bb8b694b6495b6bbb 3c9525ac3cc3ba39ca45498c4c
35cb1ccc5ccb5943c9675ccc9c 4a3338395cb67649cb4267cc7c 8454748c7c754265c254465acb 3ca62bc85ca3a944c3737ccc5c
aaaaaaaaaaaaaaaaaaaa0aaaaa 3875285c3c995547c545597c5c 6c5b29c53c969955ac324cac6c 4b7a3bc23cc78b4ac4455c8c5c
4557386c4cc34384c433cccccc 1ccc1ccc3ccc8c5cccbbbccccc 3cc94cc21cc7c63cc55ccc9cca 4c293cc94cccac72cc73cca78c
986c6ccc4cc87351cc33c84ccc 39991699399999699979999959
""".split()
#: So many pairs after each character count as if they had been seen at a uniform choice.
_PRIOR = 16.0
_FOLD = np.array([ord(chr(c).lower()) for c in range(128)])


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """P(|N| >= |z|)."""
    return np.array([math.erfc(abs(x) / math.sqrt(2)) for x in z.tolist()])


def runs_of(texts: list[str | None]) -> tuple[list[int], list[int], list[str]]:
    """Row, start in characters, and string of each candidate."""
    row, start, found = [], [], []
    for i, t in enumerate(texts):
        if t:
            for m in _RUN.finditer(t):
                row.append(i)
                start.append(m.start())
                found.append(m.group())
    return row, start, found


def candidates(found: list[str]) -> tuple[np.ndarray, list[str]]:
    """Number of the run, and string: each run whole; where separators cut it also its parts of ``LEAST`` or more characters,
    the run less its first label, and both without separators."""
    owner, out = [], []
    for i, s in enumerate(found):
        some = [s]
        if m := _CUT.search(s):
            rest = s[m.end() :]
            some += [*_CUT.split(s), rest, _CUT.sub("", s), _CUT.sub("", rest)]
        some = [x for x in dict.fromkeys(some) if len(x) >= LEAST]
        owner += [i] * len(some)
        out += some
    return np.array(owner, np.int64), out


def battery(found: list[str]) -> tuple[np.ndarray, ...]:
    """Of each run: encoding, length, sum of squared counts, and p-values of uniformity, runs, serial correlation and all."""
    m = len(found)
    enc, size, squares = np.zeros(m, np.int64), np.array([len(s) for s in found], np.int64), np.zeros(m, np.int64)
    p_uniform, p_runs, p_serial = np.ones(m), np.ones(m), np.ones(m)
    if not m:
        return enc, size, squares, p_uniform, p_runs, p_serial, p_uniform
    flat = np.frombuffer("".join(found).encode("ascii"), np.uint8)
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    fits = np.stack([np.logical_and.reduceat(_VALUES[k, flat] >= 0, at) for k in range(len(_NAMES))])
    enc = np.argmax(fits, axis=0)
    owner = np.repeat(np.arange(m), size)
    k = _SIZES[enc]
    v = _VALUES[enc[owner], flat]
    pair, count = np.unique(owner * 128 + v, return_counts=True)
    squares = np.bincount(pair >> 7, count.astype(np.float64) ** 2, minlength=m).astype(np.int64)
    chi2 = squares * k / size - size
    # Wilson-Hilferty, with the exact variance of Pearson's statistic for few expected counts.
    df, var = k - 1.0, 2 * (k - 1.0) * (1 - 1 / size)
    scaled = np.maximum(df + (chi2 - df) * np.sqrt(2 * df / var), 1e-9)
    p_uniform = _normal_tail((np.cbrt(scaled / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df)))
    high = v >= (k // 2)[owner]
    n1 = np.add.reduceat(high.astype(np.int64), at)
    n0 = size - n1
    change = np.zeros(len(flat), np.int64)
    change[1:] = high[1:] != high[:-1]
    change[at] = 0
    r = np.add.reduceat(change, at) + 1
    both = 2.0 * n1 * n0
    mean = both / size + 1
    var = both * (both - size) / (size**2.0 * (size - 1))
    z = np.where(var > 0, (r - mean) / np.sqrt(np.maximum(var, 1e-9)), 0.0)
    p_runs = np.where(var > 0, _normal_tail(np.sign(z) * np.maximum(np.abs(z) - 0.5 / np.sqrt(np.maximum(var, 1e-9)), 0)), 2 * 0.5 ** (size - 1.0))
    x = v - (np.add.reduceat(v, at) / size)[owner]
    follow = np.zeros(len(flat))
    follow[:-1] = x[:-1] * x[1:]
    follow[at + size - 1] = 0
    spread = np.add.reduceat(x * x, at)
    rho = np.where(spread > 0, np.add.reduceat(follow, at) / np.maximum(spread, 1e-9), 1.0)
    p_serial = _normal_tail((rho + 1 / size) * np.sqrt(size))
    fisher = -2 * (np.log(np.maximum(p_uniform, 1e-300)) + np.log(np.maximum(p_runs, 1e-300)) + np.log(np.maximum(p_serial, 1e-300)))
    half = fisher / 2
    p_all = np.exp(-half) * (1 + half + half * half / 2)  # upper tail of chi-squared with 6 degrees
    return enc, size, squares, p_uniform, p_runs, p_serial, p_all


def band(size: np.ndarray) -> np.ndarray:
    """Lengths by half octaves from LEAST on."""
    return np.floor(2 * np.log2(size / LEAST)).astype(np.int64)


def _english() -> np.ndarray:
    """Of each character (case folded), how often others follow in plain words, numbers and separators."""
    letter, digit, other = (np.array(list(x.encode())) for x in (_LOWER, _DIGIT, "+/-_"))
    out = np.zeros((128, 128))
    for a, row in zip(letter, _ENGLISH):
        out[a, letter] = 2.0 ** -np.array([int(c, 16) for c in row])
        out[a, letter] *= 0.9 / out[a, letter].sum()
    for group, weights in ((letter, (0.0, 0.05, 0.05)), (digit, (0.2, 0.7, 0.1)), (other, (0.7, 0.25, 0.05))):
        for to, w in zip((letter, digit, other), weights):
            out[np.ix_(group, to)] += w / len(to)
    return out


def evidence(pairs: np.ndarray) -> np.ndarray:
    """Of each null (these documents, English), encoding and pair of characters: log of the uniform choice's probability over
    that under the null. pairs: counts of two ASCII characters in a row."""
    folded = np.zeros((128, 128))
    np.add.at(folded, (_FOLD[:, None], _FOLD[None, :]), pairs)
    out = np.zeros((2, len(_NAMES), 128, 128), np.float32)
    every, times = np.unique(_FOLD[list(ENCODINGS["base64_any"].encode())], return_counts=True)
    for null, (table, prior) in enumerate(((folded, _PRIOR), (_english(), 0.0))):
        seen = table[:, every]
        under = np.ones((128, 128))
        under[:, every] = (seen + prior * times / times.sum() + 1e-12) / (seen.sum(axis=1, keepdims=True) + prior + 1e-12)
        for k, alphabet in enumerate(ENCODINGS.values()):
            at = np.array(list(alphabet.encode()))
            chars, where, n = np.unique(_FOLD[at], return_inverse=True, return_counts=True)
            out[null, k][np.ix_(at, at)] = np.log((n / n.sum())[where] / under[np.ix_(_FOLD[at], _FOLD[at])])
    return out


def ordinary(found: list[str], enc: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """P(a run of ordinary characters speaks as much for a uniform choice as this one), at most."""
    if not found:
        return np.ones(0)
    size = np.array([len(s) for s in found], np.int64)
    flat = np.frombuffer("".join(found).encode("ascii"), np.uint8)
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    gain = np.zeros((2, len(flat)))
    gain[:, 1:] = ratios[:, np.repeat(enc, size)[1:], flat[:-1], flat[1:]]
    gain[:, at] = 0
    return np.minimum(1.0, len(_NAMES) * np.exp(-np.add.reduceat(gain, at, axis=1).min(axis=0)))


def _bin(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(-np.log10(np.maximum(p, 1e-300)) * BINS_PER_DECADE), BINS_PER_DECADE * DECADES).astype(np.int64)


class Rules:
    """What a scan decides by: evidence of pairs of characters, and the least bin that counts as discovered."""

    def __init__(self, ratios: np.ndarray, least_bin: dict[tuple[int, int], int]) -> None:
        self.ratios, self.least_bin = ratios, least_bin

    def judge(self, found: list[str]) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
        """Of each run's candidate that speaks most for a secret: battery, p-value under the null of ordinary text, and
        whether it is a secret."""
        owner, strings = candidates(found)
        tests = battery(strings)
        enc, size, p_all = tests[0], tests[1], tests[6]
        p = ordinary(strings, enc, self.ratios)
        never = BINS_PER_DECADE * DECADES + 1
        least = np.array([self.least_bin.get(x, never) for x in zip(enc.tolist(), band(size).tolist())], np.int64)
        secret = (p_all >= REJECT) & (_bin(p) >= least)
        order = np.lexsort((p, ~secret, owner))
        best = order[np.unique(owner[order], return_index=True)[1]]
        return tuple(x[best] for x in tests), p[best], secret[best]


def discover(bins: list[tuple[int, int, int, int]], level: float = FDR) -> dict[tuple[int, int], int]:
    """Benjamini-Hochberg in each (encoding, band) on (encoding, band, bin, count): the least bin that is discovered."""
    groups: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for enc, where, at, n in bins:
        groups.setdefault((enc, where), []).append((at, n))
    out = {}
    for key, rows in groups.items():
        total, rank = sum(n for _, n in rows), 0
        for at, n in sorted(rows, reverse=True):
            rank += n
            if 10 ** (-at / BINS_PER_DECADE) <= level * rank / total:
                out[key] = at
    return out


def _pairs(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Counts of two ASCII bytes in a row. first: where a text begins."""
    ok = (data[:-1] < 128) & (data[1:] < 128)
    ok[first[(first > 0) & (first < len(data))] - 1] = False
    return np.bincount((data[:-1].astype(np.int64) * 128 + data[1:])[ok], minlength=128 * 128)


def learn(docs: DataFrame, level: float = FDR) -> Rules:
    """Rules from all documents: two passes over the texts, which send counts alone."""

    def tally(batch: pa.RecordBatch) -> pa.RecordBatch:
        off, data = raw(batch.column("text"))
        found = runs_of(batch.column("text").to_pylist())[2]
        count = _pairs(data, off) - _pairs(np.frombuffer("".join(found).encode(), np.uint8), np.cumsum([len(s) for s in found], dtype=np.int64))
        at = np.flatnonzero(count)
        return pa.RecordBatch.from_pydict({"pair": pa.array(at), "n": pa.array(count[at])})

    seen = docs.select("text").mapInArrow(per_slice(tally, "text"), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = np.zeros(128 * 128)
    for r in seen.collect():  # 16,384 rows at most
        pairs[r["pair"]] = r["n"]
    ratios = evidence(pairs.reshape(128, 128))

    def binned(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = candidates(runs_of(batch.column("text").to_pylist())[2])[1]
        enc, size, *_ = battery(found)
        rows, n = np.unique(np.stack([enc, band(size), _bin(ordinary(found, enc, ratios))], axis=1), axis=0, return_counts=True)
        return pa.RecordBatch.from_pydict({"enc": pa.array(rows[:, 0]), "band": pa.array(rows[:, 1]), "bin": pa.array(rows[:, 2]), "n": pa.array(n.astype(np.int64))})

    bins = docs.select("text").mapInArrow(per_slice(binned, "text"), "enc long, band long, bin long, n long").groupBy("enc", "band", "bin").agg(F.sum("n").alias("n"))
    return Rules(ratios, discover([tuple(r) for r in bins.collect()], level))  # bounded: encodings x bands x bins


def scan(docs: DataFrame, rules: Rules) -> DataFrame:
    """A row for each secret: doc_id, start (in characters) and length of the run, encoding and p-values of the candidate that
    decided, and a digest of the run instead of the secret."""
    import hashlib

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        row, start, found = runs_of(batch.column("text").to_pylist())
        tests, p, secret = rules.judge(found)
        keep = np.flatnonzero(secret)
        if not len(keep):
            return None
        cols = {"doc_id": batch.column("doc_id").take(pa.array(np.array(row)[keep])), "start": pa.array(np.array(start, np.int64)[keep]), "length": pa.array(np.array([len(found[i]) for i in keep], np.int32))}
        cols["encoding"] = pa.array([_NAMES[k] for k in tests[0][keep]])
        cols |= {name: pa.array(x[keep]) for name, x in (("p_uniform", tests[3]), ("p_runs", tests[4]), ("p_serial", tests[5]), ("p_random", tests[6]), ("p_ordinary", p))}
        cols["sha256"] = pa.array([hashlib.sha256(found[i].encode()).hexdigest() for i in keep])
        return pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, start long, length int, encoding string, p_uniform double, p_runs double, p_serial double, p_random double, p_ordinary double, sha256 string"
    return docs.select("doc_id", "text").mapInArrow(per_slice(run, "text"), schema)


def redact(docs: DataFrame, rules: Rules) -> DataFrame:
    """docs, all rows and columns, with MASK in place of each secret; n_chars follows where there is such a column of numbers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        row, start, found = runs_of(texts)
        secret = rules.judge(found)[2]
        if not secret.any():
            return batch
        cuts: dict[int, list[int]] = {}
        for i in np.flatnonzero(secret).tolist():
            cuts.setdefault(row[i], []).append(i)
        columns = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
        changed = dict.fromkeys(cuts)
        for r, spans in cuts.items():
            parts, end = [], 0
            for i in spans:
                parts += [texts[r][end : start[i]], MASK]
                end = start[i] + len(found[i])
            changed[r] = "".join([*parts, texts[r][end:]])
        at = batch.schema.get_field_index("text")
        arrays = list(batch.columns)
        arrays[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns["text"].type)
        if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
            k = batch.schema.get_field_index("n_chars")
            arrays[k] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(columns["n_chars"].to_pylist())], columns["n_chars"].type)
        return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(per_slice(run, "text"), docs.schema)
