"""External suffix sorting by recursive induction, with queues on disk that carry suffixes and their common prefixes.

A text's suffixes are S (smaller than the next suffix) or L (larger). The S suffixes that follow an L are the seeds, a third at
most. A sweep goes through the suffixes in order of their first character, upwards for L, downwards for S: every suffix that comes
up puts its predecessor, if that is of the sweep's type, into a priority queue under the predecessor's first character;
equal characters come first in, first out. So the order of the seeds gives that of all L, and L that of all S.

Seeds are sorted by recursion: two sweeps from unsorted seeds sort the strings from one seed to the next; each distinct string gets
a number, and the string of these numbers, shorter by half at least, is sorted the same way if a number comes twice. Recursion ends
where a string has `SHORT` numbers or fewer: such a string is sorted in memory, by ranks of twice the length each time.
Only the first `depth` characters of a suffix need be in order.

Beside each suffix a queue holds the length of the prefix that it has in common with the one before it in its queue: one more than
the least of the common prefixes between the two suffixes that put them there. Lengths end at `cap`, so a byte holds one.

Sweeps take from a queue by ranges of characters and work on arrays of `step` suffixes at most. Queues over `held`
suffixes go to a file; texts, types, seeds and results of more than `held` are memory-mapped files. All files lie in a
temporary folder of the task and are gone when the sort ends. What stays in memory is a few numbers for each distinct character.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np

HELD, STEP = 8_000_000, 1 << 18
#: Ranges of characters in a sweep, about, and rounds after which a range that feeds itself is halved.
RANGES, ROUNDS = 128, 8
#: Numbers in a string that is sorted in memory.
SHORT = 600_000


class Disk:
    """A folder of arrays."""

    def __init__(self, folder: str, held: int, step: int = STEP):
        self.folder, self.held, self.step, self.files = Path(folder), held, max(2, min(step, held)), 0

    def path(self) -> Path:
        self.files += 1
        return self.folder / f"{self.files}.bin"

    def array(self, n: int, kind: type) -> np.ndarray:
        if n <= self.held:
            return np.zeros(n, kind)
        return np.asarray(np.memmap(self.path(), dtype=kind, mode="w+", shape=(n,)))


class Queue:
    """Suffixes and common prefixes by range of characters, first in, first out; all that it holds goes to a file beyond `held`."""

    def __init__(self, disk: Disk, kind: type):
        self.disk, self.kind, self.now, self.file = disk, kind, 0, None
        self.parts: dict[int, list] = {}

    def put(self, ranges: np.ndarray, suffixes: np.ndarray, common: np.ndarray) -> None:
        """Adds suffixes that are in order of their ranges."""
        if not len(suffixes):
            return
        cuts = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), len(ranges)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            self.parts.setdefault(int(ranges[a]), []).append((suffixes[a:z], common[a:z]))
        self.now += len(suffixes)
        if self.now > self.disk.held:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = open(self.disk.path(), "w+b")  # noqa: SIM115 - lives as long as the folder
        self.file.seek(0, 2)
        for r, parts in self.parts.items():
            kept = [p for p in parts if len(p) == 2]
            if kept:
                suffixes, common = (np.concatenate([p[i] for p in kept]) for i in (0, 1))
                self.parts[r] = [p for p in parts if len(p) == 3] + [(self.file.tell(), len(suffixes), None)]
                suffixes.tofile(self.file)
                common.tofile(self.file)
        self.file.flush()
        self.now = 0

    def take(self, r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What is in a range, in pieces of about a step at most."""
        size, held, many = np.dtype(self.kind).itemsize, [], 0
        for p in self.parts.pop(r, []):
            if len(p) == 3:
                for i in range(0, p[1], self.disk.step):
                    n = min(self.disk.step, p[1] - i)
                    self.file.seek(p[0] + i * size)
                    suffixes = np.fromfile(self.file, self.kind, n)
                    self.file.seek(p[0] + p[1] * size + i)
                    yield suffixes, np.fromfile(self.file, np.uint8, n)
                continue
            self.now -= len(p[0])
            held.append(p)
            many += len(p[0])
            if many >= self.disk.step:
                yield joined(held)
                held, many = [], 0
        if held:
            yield joined(held)


def joined(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return pieces[0] if len(pieces) == 1 else (np.concatenate([s for s, _ in pieces]), np.concatenate([c for _, c in pieces]))


def range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last] for each pair (both included, first <= last)."""
    levels = [values]
    longest = int((last - first).max()) + 1 if len(first) else 1
    while 2 << (len(levels) - 1) <= longest:
        half = 1 << (len(levels) - 1)
        under = levels[-1]
        levels.append(np.minimum(under[:-half], under[half:]))
    if len(levels) == 1:
        return values[first]
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    width = np.left_shift(1, level)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in levels])])[level]
    flat = np.concatenate(levels)
    return np.minimum(flat[starts + first], flat[starts + last - width + 1])


class Common:
    """The common prefixes of what a sweep puts into its queue."""

    def __init__(self, characters: int, cap: int):
        #: for each character, the least common prefix that came up since it was put last; and whether it was
        self.since, self.fresh, self.cap = np.full(characters, 255, np.uint8), np.ones(characters, bool), cap

    def of(self, common: np.ndarray, at: np.ndarray, character: np.ndarray) -> np.ndarray:
        """For suffixes put by those at the places `at` of a piece whose common prefixes are given, in order of character."""
        begins = np.concatenate([[True], character[1:] != character[:-1]])
        ends = np.concatenate([begins[1:], [True]])
        previous = np.concatenate([[0], at[:-1] + 1])
        previous[begins] = 0
        out = range_least(common, previous, at)
        first = character[begins]
        out[begins] = np.where(self.fresh[first], 0, np.minimum(out[begins], self.since[first]) + 1)
        rest = ~begins
        out[rest] = out[rest] + 1
        self.fresh[first] = False
        self.since = np.minimum(self.since, common.min())
        after = at[ends] + 1
        left = np.full(len(after), 255, np.uint8)
        some = after < len(common)
        left[some] = range_least(common, after[some], np.full(int(some.sum()), len(common) - 1))
        self.since[character[ends]] = left
        return np.minimum(out, self.cap).astype(np.uint8)

    def nothing(self, common: np.ndarray) -> None:
        self.since = np.minimum(self.since, common.min())


def types(text: np.ndarray, disk: Disk) -> np.ndarray:
    """True for S suffixes. The last character must be the end mark 0, which no other is."""
    small = disk.array(len(text), bool)
    small[-1], last = True, len(text) - 1
    while last > 0:
        first = max(0, last - disk.step)
        part = text[first : last + 1].astype(np.int64)
        rise = np.diff(part)
        n = len(rise)
        other = np.where(rise != 0, np.arange(n), n)
        other = np.minimum.accumulate(other[::-1])[::-1]  # where the next change is
        small[first:last] = np.concatenate([rise > 0, [small[last]]])[other]
        last = first
    return small


class Level:
    """A text with its types, counts and ranges of characters."""

    def __init__(self, text: np.ndarray, disk: Disk, cap: int):
        self.text, self.disk, self.cap, self.n = text, disk, cap, len(text)
        self.kind = np.int32 if self.n < 1 << 31 else np.int64
        self.small = types(text, disk)
        self.characters = int(max(text[i : i + disk.step].max() for i in range(0, self.n, disk.step))) + 1
        self.count = np.zeros(self.characters, np.int64)
        self.count_large = np.zeros(self.characters, np.int64)
        seeds = 0
        for i in range(0, self.n, disk.step):
            part, small = text[i : i + disk.step], self.small[i : i + disk.step]
            self.count += np.bincount(part, minlength=self.characters)
            self.count_large += np.bincount(part[~small], minlength=self.characters)
        for first in self.seed_parts():
            seeds += len(first)
        self.first = disk.array(seeds, self.kind)
        at = 0
        for first in self.seed_parts():
            self.first[at : at + len(first)] = first
            at += len(first)
        self.before_large = np.concatenate([[0], np.cumsum(self.count_large)])
        # Ranges: single characters with many suffixes, and neighbours that have few together
        most, total, bounds = max(64, self.n // RANGES), np.cumsum(self.count), [0]
        if cap:  # common prefixes are carried for one character at a time
            bounds = list(range(self.characters + 1))
        while bounds[-1] < self.characters:
            before = int(total[bounds[-1] - 1]) if bounds[-1] else 0
            bounds.append(max(bounds[-1] + 1, int(np.searchsorted(total, before + most, "right"))))
        self.bounds = np.array(bounds)

    def seed_parts(self) -> Iterator[np.ndarray]:
        for i in range(0, self.n - 1, self.disk.step):
            s = self.small[i : i + self.disk.step + 1]
            yield np.flatnonzero(s[1:] & ~s[:-1]) + i + 1

    def alike(self, a: int, b: int) -> int:
        """The common prefix of two suffixes."""
        x, y = self.text[a : a + self.cap], self.text[b : b + self.cap]
        n = min(len(x), len(y))
        differ = np.flatnonzero(x[:n] != y[:n])
        return int(differ[0]) if len(differ) else n


Pieces = Iterator[tuple[np.ndarray, np.ndarray]]


class Sweep:
    """One sweep over a level. `tail(a, z)` gives suffixes of the other type with first characters a to z - 1, in pieces in the
    sweep's order, which come up after those in the queue of equal first character. `use` gets all that comes up:
    suffixes, common prefixes, and whether they are of the tail."""

    def __init__(self, level: Level, small: bool, carry: bool, tail: Callable[[int, int], Pieces], use: Callable[[np.ndarray, np.ndarray, np.ndarray], None]):
        self.level, self.small, self.tail, self.use = level, small, tail, use
        self.queue = Queue(level.disk, level.kind)
        self.common = Common(level.characters, level.cap) if carry else None

    def run(self) -> None:
        bounds = self.level.bounds.tolist()
        ranges = range(len(bounds) - 1)
        for r in reversed(ranges) if self.small else ranges:
            a, z = bounds[r], bounds[r + 1]
            if z == a + 1 and self.level.count[a]:
                self.one(a, self.queue.take(r))
            elif z > a + 1:
                self.several(a, z, self.joined(self.queue.take(r)))

    def joined(self, pieces: Pieces) -> np.ndarray:
        return np.concatenate([np.zeros(0, self.level.kind), *(s for s, _ in pieces)])

    def before(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the predecessors that are of this sweep's type: the places of who puts them, themselves, and their characters."""
        previous = suffixes - 1
        at = np.flatnonzero((suffixes > 0) & (self.level.small[previous] == self.small))
        previous = previous[at]
        return at, previous, self.level.text[previous]

    def put(self, character: np.ndarray, suffixes: np.ndarray, common: np.ndarray) -> None:
        self.queue.put(np.searchsorted(self.level.bounds, character, "right") - 1, suffixes, common)

    def hand_on(self, suffixes: np.ndarray, common: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Puts the predecessors into the queue; those of character `own` come back."""
        at, previous, character = self.before(suffixes)
        if not len(at):
            if self.common:
                self.common.nothing(common)
            return previous, np.zeros(0, np.uint8)
        order = np.argsort(character, kind="stable")
        at, previous, character = at[order], previous[order], character[order]
        shared = self.common.of(common, at, character) if self.common else np.zeros(len(at), np.uint8)
        a, z = np.searchsorted(character, own), np.searchsorted(character, own, "right")
        self.put(character[:a], previous[:a], shared[:a])
        self.put(character[z:], previous[z:], shared[z:])
        return previous[a:z], shared[a:z]

    def one(self, character: int, waiting: Pieces) -> None:
        """All suffixes of one first character: predecessors of that character come up after what waits."""
        runs, last = Queue(self.level.disk, self.level.kind), None
        while True:
            for suffixes, common in waiting:
                self.use(suffixes, common, np.zeros(len(suffixes), bool))
                mine = self.hand_on(suffixes, common, character)
                runs.put(np.zeros(len(mine[0]), np.int8), *mine)
                last = int(suffixes[-1])
            if not runs.parts:
                break
            waiting = runs.take(0)
        for suffixes, common in self.tail(character, character + 1):
            if self.common and last is not None:
                common = common.copy()
                common[0] = self.level.alike(last, int(suffixes[0]))
            last = None
            self.use(suffixes, common, np.ones(len(suffixes), bool))
            self.hand_on(suffixes, common, -1)

    def several(self, a: int, z: int, waiting: np.ndarray) -> None:
        """All suffixes of several first characters. Predecessors within the range are found again until nothing changes; if that
        takes too long, one half of the range comes before the other."""
        text = self.level.text
        if z == a + 1:
            return self.one(a, iter([(waiting, np.zeros(len(waiting), np.uint8))] if len(waiting) else []))
        tail, inside = self.joined(self.tail(a, z)), waiting[:0]
        for _ in range(ROUNDS):
            every = np.concatenate([waiting, inside, tail])
            order = np.argsort(text[every] if not self.small else self.level.characters - text[every], kind="stable")
            every = every[order]
            _, previous, character = self.before(every)
            again = previous[(character >= a) & (character < z)]
            if len(again) == len(inside) and (again == inside).all():
                break
            inside = again
        else:
            middle, r = (a + z) // 2, int(np.searchsorted(self.level.bounds, a, "right") - 1)
            for x, y in [(middle, z), (a, middle)] if self.small else [(a, middle), (middle, z)]:
                more = np.concatenate([waiting, self.joined(self.queue.take(r))])  # the first half puts some for the second
                mine = (text[more] >= x) & (text[more] < y)
                waiting = more[~mine]
                self.several(x, y, more[mine])
            if len(waiting):  # for other parts of the range, which come later
                self.queue.put(np.full(len(waiting), r), waiting, np.zeros(len(waiting), np.uint8))
            return None
        self.use(every, np.zeros(len(every), np.uint8), order >= len(waiting) + len(inside))
        out = (character < a) | (character >= z)
        previous, character = previous[out], character[out]
        order = np.argsort(character, kind="stable")
        self.put(character[order], previous[order], np.zeros(len(order), np.uint8))
        return None


def induce(level: Level, seeds: np.ndarray, common: np.ndarray | None, use: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Gives `use` all suffixes, the greatest first, in the order that the seeds' order gives them, each piece with what its suffixes
    have in common with the one before (if `common` is given, what each seed has in common with the one before it)."""
    disk, text, carry = level.disk, level.text, common is not None
    n_large = int(level.before_large[-1])
    log, shared, filled = disk.array(n_large, level.kind), disk.array(n_large if carry else 0, np.uint8), 0
    counts = np.zeros(level.characters, np.int64)
    for i in range(0, len(seeds), disk.step):
        counts += np.bincount(text[seeds[i : i + disk.step]], minlength=level.characters)
    before = np.concatenate([[0], np.cumsum(counts)])
    none = np.zeros(disk.step, np.uint8)

    def of_seeds(a: int, z: int) -> Pieces:
        for i in range(int(before[a]), int(before[z]), disk.step):
            j = min(i + disk.step, int(before[z]))
            yield np.asarray(seeds[i:j]), np.asarray(common[i:j]) if carry else none[: j - i]

    def keep(suffixes: np.ndarray, own: np.ndarray, of_tail: np.ndarray) -> None:
        nonlocal filled
        kept = suffixes[~of_tail]
        log[filled : filled + len(kept)] = kept
        if carry:
            shared[filled : filled + len(kept)] = own[~of_tail]
        filled += len(kept)

    def of_large(a: int, z: int) -> Pieces:
        low, high = int(level.before_large[a]), int(level.before_large[z])
        for j in range(high, low, -disk.step):
            i = max(low, j - disk.step)
            own = np.concatenate([shared[i + 1 : j], shared[j : j + 1] if j < high else none[:1]]) if carry else none[: j - i]
            yield log[i:j][::-1], own[::-1]

    Sweep(level, False, carry, of_seeds, keep).run()
    Sweep(level, True, carry, of_large, lambda suffixes, own, _: use(suffixes, own)).run()
    use(np.array([level.n - 1], level.kind), none[:1])


def by_character(level: Level) -> np.ndarray:
    """The seeds by first character, else in the text's order."""
    text, step, counts = level.text, level.disk.step, np.zeros(level.characters, np.int64)
    for i in range(0, len(level.first), step):
        counts += np.bincount(text[level.first[i : i + step]], minlength=level.characters)
    next_ = np.cumsum(counts) - counts
    out = level.disk.array(len(level.first), level.kind)
    for i in range(0, len(level.first), step):
        part = np.asarray(level.first[i : i + step])
        order = np.argsort(text[part], kind="stable")
        part = part[order]
        character = text[part]
        starts = np.flatnonzero(np.concatenate([[True], character[1:] != character[:-1]]))
        many = np.diff(np.concatenate([starts, [len(part)]]))
        out[np.repeat(next_[character[starts]] - starts, many) + np.arange(len(part))] = part
        next_[character[starts]] += many
    return out


def equal_runs(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, most: int) -> np.ndarray:
    """Whether text[a : a + length] is text[b : b + length], for each of the pairs; `most` characters, about, at a time."""
    out, total, i = np.zeros(len(a), bool), np.concatenate([[0], np.cumsum(length)]), 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, "right")) - 1)
        n = length[i:j]
        starts = total[i:j] - total[i]
        inside = np.arange(int(n.sum())) - np.repeat(starts, n)
        same = text[np.repeat(a[i:j], n) + inside] == text[np.repeat(b[i:j], n) + inside]
        out[i:j] = np.logical_and.reduceat(same, starts)
        i = j
    return out


def numbered(level: Level, order: np.ndarray) -> tuple[np.ndarray, int]:
    """For the seeds in the text's order, a number for the string up to the next seed, equal for equal ones; and how many there are.

    `order` has the seeds sorted by these strings."""
    out, name, last = level.disk.array(len(order), np.int32 if len(order) < 1 << 31 else np.int64), 0, None
    first = level.first
    for i in range(0, len(order), level.disk.step):
        now = np.asarray(order[i : i + level.disk.step])
        place = np.searchsorted(first, now)
        length = first[np.minimum(place + 1, len(first) - 1)] - now + 1  # the next seed's first character belongs to it
        if last is not None:
            now, length = np.concatenate([last[0], now]), np.concatenate([last[1], length])
        alike = (length[1:] == length[:-1]) & (level.text[now[1:]] == level.text[now[:-1]]) & (now[:-1] != level.n - 1)
        check = np.flatnonzero(alike)
        if len(check):
            alike[check] = equal_runs(level.text, now[check], now[check + 1], length[check], level.disk.step)
        names = name + np.cumsum(~alike)
        if last is None:
            names = np.concatenate([[name], names])
        out[place] = names
        name, last = int(names[-1]), (now[-1:], length[-1:])
    return out, name + 1


def sorted_seeds(level: Level, depth: int) -> np.ndarray:
    """The seeds in the order of the first `depth` characters of their suffixes."""
    first = level.first
    if len(first) < 2:
        return first
    order, left = level.disk.array(len(first), level.kind), len(first)

    def keep(suffixes: np.ndarray, _: np.ndarray) -> None:
        nonlocal left
        kept = suffixes[level.small[suffixes] & (suffixes > 0) & ~level.small[suffixes - 1]]
        order[left - len(kept) : left] = kept[::-1]
        left -= len(kept)

    induce(level, by_character(level), None, keep)
    names, many = numbered(level, order)
    if many == len(first):
        return order
    upper = suffix_order(names, level.disk, depth // 2 + 1)  # a seed and the next are two characters apart at least
    for i in range(0, len(first), level.disk.step):
        order[i : i + level.disk.step] = first[upper[i : i + level.disk.step]]
    return order


def ranked(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a short text in the order of their first `depth` characters at least."""
    rank, step = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while step < min(depth, len(rank)) and rank.max() < len(rank) - 1:
        pair = rank * (int(rank.max()) + 2)
        pair[:-step] += rank[step:] + 1
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        rank[order] = np.concatenate([[0], np.cumsum(pair[1:] != pair[:-1])])
        step *= 2
    return order


def suffix_order(text: np.ndarray, disk: Disk, depth: int) -> np.ndarray:
    """The suffixes of a text that ends with 0, its one smallest character, in the order of their first `depth` characters at least."""
    if len(text) <= min(SHORT, disk.held):
        return ranked(text, depth)
    level = Level(text, disk, 0)
    out, left = disk.array(level.n, level.kind), level.n

    def keep(suffixes: np.ndarray, _: np.ndarray) -> None:
        nonlocal left
        out[left - len(suffixes) : left] = suffixes[::-1]
        left -= len(suffixes)

    if level.n > 1:
        induce(level, sorted_seeds(level, depth), None, keep)
    return out


def in_common(level: Level, order: np.ndarray) -> np.ndarray:
    """What each of the seeds in order has in common with the one before, up to the level's cap: eight bytes at a time."""
    text, cap = level.text, level.cap
    size, out = text.itemsize, level.disk.array(len(order), np.uint8)
    eight = np.ndarray((level.n,), "<u8", text.base if text.base is not None else text, 0, (size,))  # padded, see descending()
    for i in range(1, len(order), level.disk.step):
        b = np.asarray(order[i : i + level.disk.step])
        a = np.asarray(order[i - 1 : i - 1 + len(b)])
        found, going = np.zeros(len(b), np.int64), np.arange(len(b))
        while len(going):
            differ = eight[a[going] + found[going]] ^ eight[b[going] + found[going]]
            low = np.frexp((differ & (~differ + np.uint64(1))).astype(np.float64))[1] - 1  # the lowest bit that differs
            found[going] += np.where(differ == 0, 8, low // 8) // size
            going = going[(differ == 0) & (found[going] < cap)]
        out[i : i + len(b)] = np.minimum(found, cap)
    return out


def descending(text: np.ndarray, cap: int, disk: Disk, use: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Gives `use` the suffixes of a text in pieces, the greatest first, each with what it has in common with the one before.

    Suffixes are in order of their first `cap` characters. Behind the text lie eight bytes that its base holds too."""
    level = Level(text, disk, cap)
    if level.n > 1:
        order = sorted_seeds(level, cap)
        induce(level, order, in_common(level, order), use)


def repeated(texts: list[bytes], width: int, held: int = HELD, step: int = STEP) -> list[np.ndarray]:
    """For each text, which of its strings of `width` bytes start in another place of the texts too: a flag for each start."""
    if width > 250:
        raise ValueError("common prefixes are held in bytes: 250 at most")
    counts = [max(0, len(t) - width + 1) for t in texts]
    size = sum(len(t) + 1 for t in texts) + 1
    with tempfile.TemporaryDirectory(prefix="induced-") as folder:
        disk = Disk(folder, held, step)
        wide = any(t and max(t) > 253 for t in texts)
        text = disk.array(size + 8, np.uint16 if wide else np.uint8)[:size]
        start, flag = disk.array(size, bool), disk.array(size, bool)
        begins, at = [], 0
        for t, n in zip(texts, counts, strict=True):
            text[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
            text[at : at + len(t)] += 2
            text[at + len(t)] = 1  # parts texts; the end mark 0 follows the last
            start[at : at + n] = True
            begins.append(at)
            at += len(t) + 1
        last = np.zeros(0, np.int64)

        def mark(suffixes: np.ndarray, common: np.ndarray) -> None:
            nonlocal last
            both = np.concatenate([last, suffixes])
            shared = common if len(last) else common[1:]
            again = np.flatnonzero((shared >= width) & start[both[1:]])
            flag[both[again]] = flag[both[again + 1]] = True
            last = both[-1:]

        descending(text, width, disk, mark)
        return [np.array(flag[s : s + n]) for s, n in zip(begins, counts, strict=True)]
