"""Similar pairs of two lists of texts, by matrices: an upper bound from character counts, then common subsequences.

The longest common subsequence is found with one bit per character of the first text, for thousands of pairs at once.
"""

from collections.abc import Iterator, Sequence

import numpy as np

from editlens.functions.text import common_length

#: Classes of characters that the bound counts, and cells of the matrices held at a time.
CLASSES = 64
CELLS = 1 << 22
#: Pairs whose bit rows are run together.
RUN = 4096
#: So few pairs per word of bits are faster one by one, as long numbers.
FEW = 32
_WORD = 64


def _codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the texts' lengths."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def _class_counts(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Characters per text and class. Two texts share at most the sum of the smaller counts."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(row * CLASSES + codes % CLASSES, minlength=len(lengths) * CLASSES).reshape(-1, CLASSES).astype(np.int32)


def _possible(old: np.ndarray, new: np.ndarray, n_old: np.ndarray, n_new: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs whose bound reaches the least ratio, some first texts at a time."""
    step = max(1, CELLS // max(1, len(new) * 8))
    for start in range(0, len(old), step):
        part, n = old[start:start + step], n_old[start:start + step, None]
        shared = np.minimum(n, n_new)
        near = np.flatnonzero((200.0 * shared >= least * (n + n_new)) & (shared > 0))  # by length alone
        i, j = near // len(n_new), near % len(n_new)
        for at in range(0, len(i), CELLS // CLASSES):
            x, y = i[at:at + CELLS // CLASSES], j[at:at + CELLS // CLASSES]
            bound = np.minimum(part[x], new[y]).sum(axis=1)
            keep = 200.0 * bound >= least * (n_old[start + x] + n_new[y])
            yield x[keep] + start, y[keep]


def _padded(codes: np.ndarray, lengths: np.ndarray, texts: np.ndarray, pad: int) -> np.ndarray:
    """The given texts as rows, filled up with `pad`."""
    starts = (np.cumsum(lengths) - lengths)[texts]
    width = int(lengths[texts].max(initial=0))
    place = np.arange(width)
    inside = place < lengths[texts][:, None]
    return np.where(inside, codes[np.where(inside, starts[:, None] + place, 0)], pad)


def _bit_rows(codes: np.ndarray, pad: int) -> np.ndarray:
    """Per word of bits, row and letter the places of the letter; the pad letter has none."""
    n, width = codes.shape
    masks = np.zeros((max(1, -(-width // _WORD)), n * (pad + 1)), np.uint64)
    row, place = np.nonzero(codes != pad)
    bits = np.uint64(1) << (place % _WORD).astype(np.uint64)
    np.bitwise_or.at(masks, (place // _WORD, row * (pad + 1) + codes[row, place]), bits)
    return masks


def _common_lengths(masks: np.ndarray, row: np.ndarray, other: np.ndarray, pad: int) -> np.ndarray:
    """Length of the longest common subsequence of text `row[k]` of the masks and `other[k]`, a padded row of letters."""
    words = len(masks)
    state = np.full((words, len(row)), ~np.uint64(0))
    letters = np.ascontiguousarray(other.T) + row * (pad + 1)
    for letter in letters:
        carry = None
        for w in range(words):
            old = state[w]
            hit = masks[w].take(letter)
            hit &= old
            total = old + hit
            if w + 1 < words:  # what the sum carries into the next word
                over = total < old
            if carry is not None:
                total += carry
                if w + 1 < words:
                    over |= total < carry
            if w + 1 < words:
                carry = over.astype(np.uint64)
            old ^= hit
            old |= total
    return words * _WORD - np.bitwise_count(state).sum(axis=0, dtype=np.int64)


def similar_pairs(first: Sequence[str], second: Sequence[str], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and ratio (0 to 100, rounded half to even) of all pairs of different texts whose ratio is above the threshold."""
    none = np.zeros(0, np.int64)
    if not first or not second:
        return none, none, none
    (a, n_a), (b, n_b) = _codes(first), _codes(second)
    letters, packed = np.unique(np.concatenate([a, b]), return_inverse=True)
    pad, packed_a, packed_b = len(letters), packed[:len(a)], packed[len(a):]
    out = [(none, none, none)]
    for i, j in _possible(_class_counts(a, n_a), _class_counts(b, n_b), n_a, n_b, threshold + 0.5):
        # Texts of like length together, so that rows need little padding and few words.
        order = np.lexsort([n_b[j], i, -(-n_a[i] // _WORD)])
        i, j = i[order], j[order]
        at = 0
        while at < len(i):
            words = max(1, -(-int(n_a[i[at]]) // _WORD))
            same = np.searchsorted(-(-n_a[i[at:at + RUN]] // _WORD), words, side="right")
            end = at + max(1, min(int(same), CELLS // max(1, int(n_b[j[at:at + int(same)]].max(initial=0)))))
            texts, row = np.unique(i[at:end], return_inverse=True)
            most = max(1, CELLS // ((pad + 1) * words))
            if len(texts) > most:  # few texts at a time where letters or lengths are many
                end = at + int(np.searchsorted(row, most))
                texts, row = texts[:most], row[:end - at]
            if end - at < FEW * words:
                pairs = zip(i[at:end].tolist(), j[at:end].tolist(), strict=True)
                common = np.array([common_length(first[x], second[y]) for x, y in pairs], np.int64)
            else:
                masks = _bit_rows(_padded(packed_a, n_a, texts, pad), pad)
                common = _common_lengths(masks, row, _padded(packed_b, n_b, j[at:end], pad), pad)
            ratios = np.rint(200 * common / (n_a[i[at:end]] + n_b[j[at:end]])).astype(np.int64)
            good = np.flatnonzero(ratios > threshold)
            out.append((i[at:end][good], j[at:end][good], ratios[good]))
            at = end
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))
