"""Dense features of whole texts, computed for all rows of an Arrow batch at once."""

from __future__ import annotations

import numpy as np

from rulewright.llm._text import lower_ascii, reduce_rows, shingle_hashes, span_hashes, word_bounds

_TABLE = np.zeros(256, dtype=np.uint8)
_UPPER, _LOWER, _DIGIT, _PUNCT, _SYMBOL, _HIGH = 1, 2, 4, 8, 16, 32
for _c in range(256):
    if 65 <= _c <= 90:
        _TABLE[_c] = _UPPER
    elif 97 <= _c <= 122:
        _TABLE[_c] = _LOWER
    elif 48 <= _c <= 57:
        _TABLE[_c] = _DIGIT
    elif chr(_c) in ".,;:!?'\"()-":
        _TABLE[_c] = _PUNCT
    elif 33 <= _c <= 126:
        _TABLE[_c] = _SYMBOL
    elif _c >= 128:
        _TABLE[_c] = _HIGH

# Characters often written for letters.
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip("013457@$", "oieastas", strict=True):
    _LEET[ord(_a)] = ord(_b)


def hash_words(words: list[str]) -> np.ndarray:
    """Sorted hashes of lower-case words, equal to those that Texts computes."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b" ".join(raw), dtype=np.uint8)
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if len(raw) else np.zeros(0, np.int64)
    return np.sort(span_hashes(data, starts, starts + sizes))


def is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if len(table) == 0:
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


class Texts:
    """Words and characters of a batch of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.size = np.diff(offsets).astype(float)
        self.kind = _TABLE[data]
        self.low = lower_ascii(data)
        self.starts, self.ends, self.first = word_bounds(data, offsets)
        self.words = np.diff(self.first).astype(float)
        s, e = self.starts.copy(), self.ends.copy()
        if len(s):
            for _ in range(4):  # punctuation around a word, as far as four characters
                edge = np.isin(self.kind[s], (_PUNCT, _SYMBOL)) & (e - s > 1)
                s = s + edge
                edge = np.isin(self.kind[e - 1], (_PUNCT, _SYMBOL)) & (e - s > 1)
                e = e - edge
        self.core_starts, self.core_ends = s, e
        self.full = span_hashes(self.low, self.starts, self.ends)
        self.core = span_hashes(self.low, s, e)

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each word."""
        return reduce_rows(np.add, values.astype(float), self.first, 0.0)

    def per_byte(self, values: np.ndarray) -> np.ndarray:
        return reduce_rows(np.add, values.astype(np.int64), self.offsets, 0).astype(float)

    def prefixes(self, k: int) -> np.ndarray:
        """Hashes of the first k bytes of each word that is longer (shorter ones: 0)."""
        long = self.core_ends - self.core_starts > k
        out = np.zeros(len(self.core), dtype=np.uint64)
        out[long] = span_hashes(self.low, self.core_starts[long], self.core_starts[long] + k)
        return out

    def unleet(self) -> np.ndarray:
        """Hashes of the words with look-alike characters replaced, and repeated letters kept."""
        return span_hashes(_LEET[self.low], self.core_starts, self.core_ends)

    def word_bits(self) -> np.ndarray:
        """For each word, the kinds of its characters."""
        if not len(self.starts):
            return np.zeros(0, np.uint8)
        flat = np.stack([self.starts, self.ends], axis=1).ravel()
        if flat[-1] == len(self.kind):
            return np.bitwise_or.reduceat(self.kind, flat[:-1])[::2]
        return np.bitwise_or.reduceat(self.kind, flat)[::2]

    def rate(self, counts: np.ndarray, of: np.ndarray) -> np.ndarray:
        return counts / np.maximum(of, 1.0)


QUALITY = (
    "log_words", "word_length", "upper", "digits", "symbols", "punctuation", "high", "pipes", "repeated_next", "distinct_words",
    "distinct_grams", "lines", "line_length", "repeated_lines", "caps_words", "symbol_words", "symbol_only", "end_marks", "mixed_words", "short_words",
    "long_words", "longest_word", "line_ends",
)


def quality_features(t: Texts) -> np.ndarray:
    """One row of QUALITY values for each text."""
    c = lambda bits: t.per_byte((t.kind & bits) > 0)
    length = t.ends - t.starts
    bits = t.word_bits()
    row = np.repeat(np.arange(t.n), np.diff(t.first))
    same_next = np.zeros(len(t.full), bool)
    if len(t.full) > 1:
        same_next[1:] = (t.full[1:] == t.full[:-1]) & (row[1:] == row[:-1])

    def distinct(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = np.repeat(np.arange(t.n), np.diff(at))
        order = np.lexsort((values, r))
        v, r = values[order], r[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
        return np.bincount(r[new], minlength=t.n).astype(float)

    grams, gram_at = shingle_hashes(t.full, t.first, 3)
    # Lines: spans between line feeds (and the ends of texts).
    feeds = np.flatnonzero(t.data == 10)
    bounds = np.unique(np.concatenate([t.offsets[:-1], feeds + 1]))
    bounds = bounds[bounds < len(t.data)] if len(t.data) else np.zeros(0, np.int64)
    line_ends = np.append(bounds[1:], len(t.data)).astype(np.int64) if len(bounds) else np.zeros(0, np.int64)
    line_row = np.searchsorted(t.offsets, bounds, side="right") - 1
    line_at = np.searchsorted(line_row, np.arange(t.n + 1))
    line_hash = span_hashes(t.low, bounds, line_ends)
    lines = np.diff(line_at).astype(float)
    last = t.kind[t.ends - 1] if len(t.ends) else np.zeros(0, np.uint8)
    ends_in = np.isin(last, (_PUNCT, _SYMBOL))
    words, size = t.words, t.size
    longest = reduce_rows(np.maximum, length.astype(float), t.first, 0.0)
    columns = [
        np.log1p(words),
        t.rate(t.per_row(length), words),
        t.rate(c(_UPPER), size),
        t.rate(c(_DIGIT), size),
        t.rate(c(_SYMBOL), size),
        t.rate(c(_PUNCT), size),
        t.rate(c(_HIGH), size),
        t.rate(t.per_byte(t.data == 124), size),
        t.rate(t.per_row(same_next), words),
        t.rate(distinct(t.full, t.first), words),
        t.rate(distinct(grams, gram_at), np.diff(gram_at).astype(float)),
        np.log1p(lines),
        np.log1p(t.rate(size, lines)),
        1 - t.rate(distinct(line_hash, line_at), lines),
        t.rate(t.per_row(((bits & (_UPPER | _LOWER)) == _UPPER) & (length > 1)), words),
        t.rate(t.per_row((bits & _SYMBOL) > 0), words),
        t.rate(t.per_row((bits & ~np.uint8(_SYMBOL | _PUNCT)) == 0), words),
        t.rate(t.per_row(ends_in), words),
        t.rate(t.per_row(((bits & _DIGIT) > 0) & ((bits & (_LOWER | _UPPER)) > 0)), words),
        t.rate(t.per_row(length <= 2), words),
        t.rate(t.per_row(length >= 14), words),
        np.log1p(longest),
        t.rate(lines, words),
    ]
    return np.stack(columns, axis=1) if t.n else np.zeros((0, len(columns)))


# Insults that a toxicity lexicon starts from, and words of the second person (English, German, French, Spanish).
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "clown", "clowns", "loser", "losers", "scum", "trash", "pathetic", "worthless", "disgusting", "dumb", "dumbass", "imbecile", "retard", "filth", "vermin", "bastard", "bitch", "asshole", "fool", "ugly")
SECOND_PERSON = ("you", "your", "yours", "you're", "youre", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "vous", "votre", "vos", "ton", "usted", "ustedes", "tú", "ti", "tus", "vosotros")

TOXIC = (
    "fixed_density", "fixed_any", "learnt_density", "learnt_count", "prefix_density", "prefix_count", "hits", "hit_kinds", "near_second", "second_density",
    "upper", "caps_words", "exclaim", "question", "punctuation", "symbols", "mixed_words", "unleet", "repeated_letters", "log_words",
)


class Lexicon:
    """Sorted hashes: fixed words, learnt words, and learnt word beginnings of 4 and 5 bytes."""

    def __init__(self, words: np.ndarray | None = None, beginnings: dict[int, np.ndarray] | None = None):
        none = np.zeros(0, np.uint64)
        self.fixed, self.second = hash_words(list(INSULTS)), hash_words(list(SECOND_PERSON))
        self.words, self.beginnings = none if words is None else words, beginnings or {4: none, 5: none}


def toxic_features(t: Texts, lexicon: Lexicon) -> np.ndarray:
    """One row of TOXIC values for each text."""
    fixed = is_in(t.core, lexicon.fixed)
    learnt = is_in(t.core, lexicon.words)
    begins = np.zeros(len(t.core), bool)
    for k, table in lexicon.beginnings.items():
        if len(table):
            begins |= is_in(t.prefixes(k), table)
    plain = t.unleet()
    hidden = (plain != t.core) & (is_in(plain, lexicon.fixed) | is_in(plain, lexicon.words))
    hit = fixed | learnt | begins | hidden
    second = is_in(t.core, lexicon.second)
    row = np.repeat(np.arange(t.n), np.diff(t.first))
    near = np.zeros(len(hit), bool)
    at = np.flatnonzero(hit)
    for d in range(-5, 6):
        o = at + d
        ok = (o >= 0) & (o < len(hit))
        ok[ok] = row[o[ok]] == row[at[ok]]
        near[at[ok]] |= second[o[ok]]
    bits = t.word_bits()
    length = t.ends - t.starts
    three = np.zeros(len(t.data), bool)
    if len(t.low) > 2:
        letter = (t.kind & (_UPPER | _LOWER)) > 0
        three[2:] = (t.low[2:] == t.low[1:-1]) & (t.low[1:-1] == t.low[:-2]) & letter[2:]
    kinds = np.zeros(t.n)
    if len(at):
        pair = np.unique(np.stack([row[at].astype(np.uint64), t.core[at]]), axis=1)
        kinds = np.bincount(pair[0].astype(np.int64), minlength=t.n).astype(float)
    w, size = t.words, t.size
    c = lambda bits_: t.per_byte((t.kind & bits_) > 0)
    hits = t.per_row(hit)
    columns = [
        t.rate(t.per_row(fixed), w),
        np.minimum(t.per_row(fixed), 3),
        t.rate(t.per_row(learnt), w),
        np.log1p(t.per_row(learnt)),
        t.rate(t.per_row(begins), w),
        np.log1p(t.per_row(begins)),
        np.log1p(hits),
        np.log1p(kinds),
        t.rate(t.per_row(near), np.maximum(hits, 1)),
        t.rate(t.per_row(second), w),
        t.rate(c(_UPPER), size),
        t.rate(t.per_row(((bits & (_UPPER | _LOWER)) == _UPPER) & (length > 1)), w),
        t.rate(t.per_byte(t.data == 33), size),
        t.rate(t.per_byte(t.data == 63), size),
        t.rate(c(_PUNCT), size),
        t.rate(c(_SYMBOL), size),
        t.rate(t.per_row(((bits & (_DIGIT | _SYMBOL)) > 0) & ((bits & (_LOWER | _UPPER)) > 0)), w),
        t.per_row(hidden),
        t.rate(t.per_byte(three), size),
        np.log1p(w),
    ]
    return np.stack(columns, axis=1) if t.n else np.zeros((0, len(columns)))
