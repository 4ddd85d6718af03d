"""Fingerprints by majority of bits, and their comparison as bit planes."""

from __future__ import annotations

import numpy as np

#: Word-pairs compared at once in one task.
STRIDE = 1 << 15
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash of runs of n[0], n[1], ... unsigned hashes, none of them empty: a bit is 1 if it is set in over half of its run."""
    ends = np.cumsum(n)
    starts = ends - n
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # bytes add up to 255 without overflow, so long runs are summed in pieces
    cuts = np.unique(np.concatenate([starts, np.arange(0, len(hashes), 255)]))
    part = np.add.reduceat(bits, cuts, axis=0, dtype=np.uint8)
    count = np.add.reduceat(part, np.searchsorted(cuts, starts), axis=0, dtype=np.int64)
    on = 2 * count > n[:, None]
    return np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()


def components_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable, for each of n nodes, over edges a-b."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], m)
        np.minimum.at(new, label[b], m)
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def bit_sliced_links(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """fp: (n, words) unsigned fingerprints, sorted by group (non-decreasing ints). Index pairs that span the links inside groups, as stars."""
    label, _, _ = bit_sliced_forest(fp, group, radius)
    i = np.flatnonzero(label != np.arange(len(fp)))
    return i, label[i]


def bit_sliced_forest(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, a, b): the smallest index reachable inside its group for each fingerprint, and a forest of the links that join them, each within the radius."""
    n, depth = fp.shape
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    words = -(-sizes // 64)
    base = np.cumsum(words) - words
    g = np.repeat(np.arange(len(starts)), sizes)
    slot = base[g] * 64 + (np.arange(n) - starts[g])
    total = int(words.sum())
    padded = np.zeros((total * 64, depth), np.uint64)
    padded[slot] = fp
    member = np.full(total * 64, -1, np.int64)
    member[slot] = np.arange(n)
    empty = np.packbits((member < 0).astype(np.uint8), bitorder="little").view("<u8")
    planes = [np.packbits(((padded[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8") for p in range(64 * depth)]
    # each member meets its own word and the later ones of its group
    first = slot // 64
    n_words = np.where(sizes[g] < 2, 0, (base + words)[g] - first)
    ends = np.cumsum(n_words)
    levels = max(1, int(radius).bit_length())
    bias = (1 << levels) - (radius + 1)
    label = np.arange(n)
    whole = None  # the component of all members of a word, if they have one in common
    low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, int(ends[-1]) if n else 0, STRIDE):
        ids = np.arange(at, min(at + STRIDE, int(ends[-1])))
        q = np.searchsorted(ends, ids, side="right")
        w = first[q] + ids - (ends[q] - n_words[q])
        if whole is not None:
            fresh = whole[w] != label[q]
            q, w = q[fresh], w[fresh]
        over = empty[w].copy()
        count = [np.full(len(q), ONES if bias >> k & 1 else np.uint64(0)) for k in range(levels)]
        for p in range(0, 64 * depth, 2):
            mine = fp[q, p // 64]
            x1 = planes[p][w] ^ -(mine >> np.uint64(p % 64) & np.uint64(1))
            x2 = planes[p + 1][w] ^ -(mine >> np.uint64(p % 64 + 1) & np.uint64(1))
            s = count[0] ^ x1
            carry = (count[0] & x1) | (s & x2)
            count[0] = s ^ x2
            for k in range(1, levels):
                t = count[k] & carry
                count[k] = count[k] ^ carry
                carry = t
            over |= carry
            if p % 8 == 6:
                live = over != ONES
                if live.sum() < 0.7 * len(q):
                    q, w, over, count = q[live], w[live], over[live], [c[live] for c in count]
                    if not len(q):
                        break
        if not len(q):
            continue
        lanes = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, lane = np.nonzero(lanes)
        a, b = q[i], member[w[i] * 64 + lane]
        new = (b > a) & (label[a] != label[b])
        if new.any():
            a, b = a[new], b[new]
            while len(a):  # one link for each label that another of less index joins
                _, one = np.unique(np.maximum(label[a], label[b]), return_index=True)
                low.append(a[one])
                high.append(b[one])
                label = components_of(n, label[a[one]], label[b[one]])[label]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
            by_slot = np.where(member < 0, -1, label[member]).reshape(-1, 64)
            least = np.where(by_slot < 0, n, by_slot).min(axis=1)
            whole = np.where(by_slot.max(axis=1) == least, least, -1)
    return label, np.concatenate(low), np.concatenate(high)
