"""Deep-shallow sorting of byte strings, with their common prefix lengths.

Strings come in groups; each group is put in order by itself. Down to a
shallow depth this is a multikey quicksort on characters of eight bytes: a
group is parted around a pivot into smaller, equal and greater, and the equal
part goes on to the next character. All groups of a round are parted together.
What is still tied there shares a long prefix, and a blind trie orders each
such group: it stores only the bits at which strings branch, finds a place for
a string by those bits alone, and compares it with one leaf to learn where it
really departs.
"""

from __future__ import annotations

import numpy as np

CHARACTER = 8
#: Bytes sorted by quicksort before blind tries take over.
SHALLOW = 32


def _as_characters(rows: np.ndarray, bytes_: int) -> np.ndarray:
    return np.ascontiguousarray(rows[:, :bytes_]).view(">u8").astype(np.uint64)


def _bits_to_bytes(differing: int, width: int) -> int:
    """Common bytes of two numbers of `width` bytes with this XOR."""
    return width - (differing.bit_length() + 7) // 8


class BlindTrie:
    """A Patricia trie over equally long strings, held as integers."""

    def __init__(self, bits: int):
        self.bits = bits
        # A node is [bit counted from the low end, zero child, one child]; a
        # leaf is [-1, value, members].
        self.root: list | None = None

    def insert(self, value: int, member: int) -> None:
        if self.root is None:
            self.root = [-1, value, [member]]
            return
        node = self.root
        while node[0] >= 0:
            node = node[2] if value >> node[0] & 1 else node[1]
        other = value ^ node[1]
        if not other:
            node[2].append(member)
            return
        bit = other.bit_length() - 1
        parent, node = None, self.root
        while node[0] > bit:
            parent, node = node, node[2] if value >> node[0] & 1 else node[1]
        leaf = [-1, value, [member]]
        made = [bit, node, leaf] if value >> bit & 1 else [bit, leaf, node]
        if parent is None:
            self.root = made
        elif parent[2] is node:
            parent[2] = made
        else:
            parent[1] = made

    def ordered(self) -> tuple[list[int], list[int]]:
        """Members in ascending order, and for each but the first the high bit
        in which it differs from the one before (-1: equal)."""
        members, bits, stack, pending = [], [], [(self.root, -1)], -1
        while stack:
            node, pending = stack.pop()
            if node[0] >= 0:
                stack += [(node[2], node[0]), (node[1], pending)]
                continue
            for k, m in enumerate(node[2]):
                if members:
                    bits.append(pending if k == 0 else -1)
                members.append(m)
        return members, bits


def deep_shallow_order(group: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common) of zero-padded strings.

    group: ascending group numbers. rows: (n, width) bytes, the width a
    multiple of eight. order puts each group's strings in ascending order,
    equal ones by length; common[i] is the number of bytes that the padded
    strings order[i - 1] and order[i] have in common, or -1 where a group
    starts.
    """
    n, width = rows.shape
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shallow = min(SHALLOW, width)
    characters = _as_characters(rows, shallow)
    order = np.lexsort((lengths, group))
    # part: number of each string's part; depth: characters it shares in it.
    part = np.cumsum(np.concatenate([[0], (group[order][1:] != group[order][:-1]).astype(np.int64)]))
    depth = np.zeros(n, np.int64)
    active = np.arange(n)
    while True:
        sizes = np.bincount(part[active], minlength=0)
        active = active[(sizes[part[active]] > 1) & (depth[active] < shallow // CHARACTER)]
        if not len(active):
            break
        own = characters[order[active], depth[active]]
        starts = np.flatnonzero(np.concatenate([[True], part[active][1:] != part[active][:-1]]))
        ends = np.append(starts[1:], len(active))
        pivot = np.repeat(own[(starts + ends) // 2], ends - starts)
        side = (own > pivot).astype(np.int64) - (own < pivot)
        moved = np.lexsort((side, part[active]))
        order[active] = order[active][moved]
        side = side[moved]
        depth[active] += side == 0
        # Parts are numbered anew over all strings; those done keep theirs.
        fresh = np.zeros(n, bool)
        fresh[1:] = part[1:] != part[:-1]
        inner = np.flatnonzero(side[1:] != side[:-1]) + 1
        fresh[active[inner]] = True
        part = np.cumsum(fresh)
        # A part that was split keeps the depth of what it shared.
    ordered = rows[order]
    common = np.full(n, -1, np.int64)
    same = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
    # Common prefixes of neighbours, from their characters.
    xor = characters[order[same]] ^ characters[order[same - 1]]
    first = (xor != 0).argmax(1)
    tied = ~(xor != 0).any(1)
    value = xor[np.arange(len(same)), first]
    high = np.zeros(len(same), np.int64)
    for step in (32, 16, 8):
        big = value >= np.uint64(1 << step)
        high += np.where(big, step, 0)
        value = np.where(big, value >> np.uint64(step), value)
    common[same] = np.where(tied, shallow, first * CHARACTER + 7 - high // 8)
    if width == shallow or not tied.any():
        return order, common
    # Runs of strings tied at the shallow depth go through blind tries.
    is_tied = np.zeros(n + 1, bool)
    is_tied[same[tied]] = True
    run_starts = np.flatnonzero(is_tied[1:] & ~is_tied[:-1])
    run_ends = np.flatnonzero(~is_tied[1:] & is_tied[:-1]) + 1
    rest = width - shallow
    tail = np.ascontiguousarray(ordered[:, shallow:])
    raw = tail.tobytes()
    for lo, hi in zip(run_starts.tolist(), run_ends.tolist(), strict=True):
        at = order[lo:hi]
        trie = BlindTrie(rest * 8)
        for k in np.argsort(lengths[at], kind="stable").tolist():
            trie.insert(int.from_bytes(raw[(lo + k) * rest : (lo + k + 1) * rest], "big"), k)
        members, bits = trie.ordered()
        order[lo:hi] = at[members]
        common[lo + 1 : hi] = [width if b < 0 else shallow + rest - (b + 8) // 8 for b in bits]
    return order, common
