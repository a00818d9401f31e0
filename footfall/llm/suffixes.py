"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than the next one. The substrings between leftmost
S places are sorted by inducing and named; if names repeat, the string of names is sorted by the same
function; then one more induction sorts all suffixes. Buckets are not read place by place: as many of them
as put no suffix into one another are read together, and one that puts suffixes into itself is read
wave by wave, so the work stays linear and runs in numpy.
"""

from __future__ import annotations

import numpy as np

#: Suffixes that are read together at least, from as many buckets as hold them.
LEAST = 64


def _types(s: np.ndarray) -> np.ndarray:
    """True for S places: the suffix is smaller than the next one."""
    step = np.append(np.sign(np.diff(s.astype("int32"))), 1)
    decided = np.where(step != 0, np.arange(len(s)), len(s) - 1)
    return step[np.minimum.accumulate(decided[::-1])[::-1]] > 0


def _induce(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in order, from the leftmost S places in order."""
    size = np.bincount(s, minlength=k)
    ends = np.cumsum(size)
    heads = ends - size
    out = np.full(len(s), -1, "int32")
    per = np.bincount(s[leftmost], minlength=k)
    own = np.arange(len(leftmost)) + (ends - np.cumsum(per))[s[leftmost]]  # at the ends of their buckets
    out[own] = leftmost
    # Letter of the place before each place if that is of type L, or of type S; -1 if not, and for no place (-1).
    before = s[:-1].astype("int32")
    before_l = np.concatenate([[-1], np.where(small[:-1], -1, before), [-1]]).astype("int32")
    before_s = np.concatenate([[-1], np.where(small[:-1], before, -1), [-1]]).astype("int32")
    counting = np.arange(len(s) + 1)

    def sources(part: np.ndarray, letter_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        letters = letter_before[part]
        found = letters >= 0
        return part[found], letters[found]

    fill, tails = heads.copy(), ends.copy()

    def put_l(places: np.ndarray, letters: np.ndarray) -> None:
        order = letters.argsort(kind="stable")
        letters = letters[order]
        at = fill[letters] + (counting[: len(letters)] - letters.searchsorted(letters))
        out[at] = places[order] - 1
        fill[letters] = at + 1  # of one letter's places the last one stays

    def put_s(places: np.ndarray, letters: np.ndarray) -> None:
        order = letters.argsort(kind="stable")
        letters = letters[order]
        at = tails[letters] - (counting[1 : len(letters) + 1] - letters.searchsorted(letters))
        out[at] = places[order] - 1
        tails[letters] = at

    c, wide = 0, LEAST
    while c < k:
        stop = int(ends.searchsorted(heads[c] + wide, "right"))
        if stop > c:
            places, letters = sources(out[heads[c] : ends[stop - 1]], before_l)
            lowest = int(letters.min()) if len(letters) else k
            if lowest >= stop:
                wide *= 2
            else:  # what is put into these buckets must be read in its turn
                cut = s[places].searchsorted(lowest)
                places, letters, stop, wide = places[:cut], letters[:cut], lowest, max(LEAST, wide // 2)
            put_l(places, letters)
        if stop == c:  # a bucket that puts suffixes into itself, or a large one
            done = int(heads[c])
            while done < fill[c]:
                wave, done = out[done : fill[c]], int(fill[c])
                put_l(*sources(wave, before_l))
            put_l(*sources(out[ends[c] - per[c] : ends[c]], before_l))
            stop = c + 1
        c = stop
    out[own] = -1
    out[0], tails[0] = len(s) - 1, 0
    c, wide = k, LEAST
    while c > 0:
        stop = int(heads.searchsorted(ends[c - 1] - wide, "left"))
        if stop < c:
            places, letters = sources(out[heads[stop] : ends[c - 1]][::-1], before_s)
            highest = int(letters.max()) if len(letters) else -1
            if highest < stop:
                wide *= 2
            else:
                cut = (-s[places]).searchsorted(-highest)
                places, letters, stop, wide = places[:cut], letters[:cut], highest + 1, max(LEAST, wide // 2)
            put_s(places, letters)
        if stop == c:
            done = int(ends[c - 1])
            while done > tails[c - 1]:
                wave, done = out[tails[c - 1] : done][::-1], int(tails[c - 1])
                put_s(*sources(wave, before_s))
            put_s(*sources(out[heads[c - 1] : fill[c - 1]][::-1], before_s))
            stop = c - 1
        c = stop
    return out


def _same_as_before(s: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each substring (start and length) equals the one before it."""
    same = np.append(False, sizes[1:] == sizes[:-1])
    at = np.flatnonzero(same)
    offset = 0
    while len(at):
        at = at[sizes[at] > offset]
        differs = s[places[at] + offset] != s[places[at - 1] + offset]
        same[at[differs]] = False
        at = at[~differs]
        offset += 1
    return same


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """The suffixes of ``s`` in order; letters are below ``k`` and the last, 0, is found nowhere else."""
    if len(s) == 1:
        return np.zeros(1, "int32")
    small = _types(s)
    is_leftmost = np.append(False, small[1:] & ~small[:-1])
    leftmost = np.flatnonzero(is_leftmost).astype("int32")
    rough = leftmost[np.argsort(s[leftmost], kind="stable")]
    ordered = _induce(s, small, rough, k)
    ordered = ordered[is_leftmost[ordered]]
    size_at = np.zeros(len(s), "int32")
    size_at[leftmost] = np.diff(np.append(leftmost, len(s) - 1)) + 1
    size_at[len(s) - 1] = 1
    fresh = ~_same_as_before(s, ordered, size_at[ordered])
    names = np.cumsum(fresh) - 1
    if not fresh.all():
        name_at = np.zeros(len(s), "int32")
        name_at[ordered] = names
        ordered = leftmost[suffix_array(name_at[leftmost], int(names[-1]) + 1)]
    return _induce(s, small, ordered, k)


def of_bytes(text: np.ndarray) -> np.ndarray:
    """The suffix array of a byte string, without the empty suffix."""
    return suffix_array(np.append(text.astype("int16") + 1, 0), 257)[1:]


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By place: the suffix before it in order (-1: none), and the length of their common prefix.

    Where the same byte stands before both, the length is one less than at the place before; only
    at the other places are bytes compared, eight at once.
    """
    n = len(text)
    prior = np.full(n, -1, "int64")
    prior[order[1:]] = order[:-1]
    places = np.arange(n)
    follows = (prior > 0) & (places > 0)
    follows[follows] = text[places[follows] - 1] == text[prior[follows] - 1]
    words = np.ndarray((n + 8,), "<u8", np.append(text, np.zeros(16, "uint8")).tobytes(), strides=(1,))
    length = np.zeros(n, "int64")
    at = np.flatnonzero(~follows & (prior >= 0))
    other, done = prior[at], 0
    while len(at):
        most = n - np.maximum(at, other) - done
        differ = words[at + done] ^ words[other + done]
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype("float64")).astype("int64") // 8)
        end = (equal < 8) | (most <= 8)
        length[at[end]] = done + np.minimum(equal, most)[end]
        at, other, done = at[~end], other[~end], done + 8
    last = np.maximum.accumulate(np.where(follows, 0, places))
    return prior, np.where(follows, length[last] - (places - last), length)


def repeated_starts(text: np.ndarray, size: int) -> np.ndarray:
    """Places where a string of ``size`` bytes starts that also starts elsewhere in the text."""
    prior, length = permuted_prefixes(text, of_bytes(text))
    found = np.zeros(len(text), bool)
    long = np.flatnonzero(length >= size)
    found[long] = found[prior[long]] = True
    return found
