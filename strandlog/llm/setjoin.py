"""Exact Jaccard join of documents' word shingles.

Method: universe partition and the pigeonhole. Two sets with a Jaccard similarity of at least num/den differ in at most
H tokens, which their sizes bound. Sizes fall into bands such that a set's partners lie in its own band or the next one. In
each band tokens are hashed into segments, and each segment is allocated
 - 0: not indexed,
 - 1: each set's subset of the segment is one signature, which sets that agree there share,
 - 2: so is each subset that lacks one token of it, so that sets which differ there in one token share one as well.
Sets that share no signature differ in at least as many tokens as their segments are allocated together; with H + 1 or more
they are not linked. A segment of which a set has nothing gives no signature and does not count, one of which it has one
token counts 1 at most; spare allocations make up for that, and a set that still has too few is also partitioned by the next
of SEEDS hash functions, after the last of which H + 1 segments count whether empty or not. Candidates are verified on the
sets themselves.

The allocation is by cost, and decides nothing but cost. A first pass over all documents counts, for each band, its sets and
how many of them have a token in each of CELLS ranges of hashes (of sets with one least hash in a task only the first, so
that near copies, which meet under any allocation, count once). A segment costs its signatures, and the pairs that meet by
chance because a frequent token stands alone in it; numbers of segments are tried, and allocations taken by their cost for
what they count, until all sets of the band have enough.

Equal sets are one entity. In each group of a signature, all are first compared with the group's least entity. What those
links connect needs no further comparison for components. For every other pair of a group's members from different
components, parity sketches are compared first: a sketch has one bit for each value of a token hash, flipped by every token,
so two sketches differ in no more bits than their sets differ in tokens. A pair that differs in more bits than linked sets
may is never linked; only the rest become rows and are verified, so that no link between components is missed.

Defined results: null text, and text without a word, has no shingle and is linked with nothing; a text of fewer words than
n is one shingle; repeated rows are linked (with equal sets) and repeat in the result; other columns are ignored.
Shingles are told apart by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blobs import BUCKETS, Packer, batch, bucket_of, unpack
from .common import GEAR_FOLDED, SLICE, RollingHash, collect_counts, count_rows, grams, materialize, mix, slices, tasks, text_buffer, texts, words
from .components import components

U64 = np.uint64
SEEDS = 4
#: Ranges of hashes whose sets are counted, one vector for each band.
CELLS = SLICE
#: Bytes of a signature, and what a pair that meets by chance costs in such bytes.
RECORD, PAIR = 16, 64
#: Members of a group in one row, and in one comparison of sketches; larger groups are several.
CHUNK = 4096
#: Members that one task compares with one entity.
MEMBERS = 256

_ENTRY = np.dtype([("sig", "<u8"), ("entity", "<u8")])


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and 64-bit shingles of all rows, distinct in each row, sorted."""
    flat, at = text_buffer(column)
    start, end, row = words(flat, at)
    h = RollingHash(flat, GEAR_FOLDED).of(start, end)
    token, first = grams(h, row, n)
    owner = row[first]
    count = np.bincount(row, minlength=len(column))
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(count)])[short]
        whole = np.zeros(len(short), U64)
        for k in range(n - 1):
            have = count[short] > k
            whole[have] = mix(whole[have] + h[begin[have] + k])
        token = np.concatenate([token, mix(whole + U64(0xA5) + count[short].astype(U64))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((token, owner))
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], token[new]


class Plan:
    """Bands of set sizes and their signatures, for similarity of at least num / den.

    measured: band to (sets, sets with a token in each of CELLS ranges of hashes), own sets and those of the band below;
    bands that it lacks have no sets. None: every band counts as having sets without frequent tokens.
    """

    def __init__(self, num: int, den: int, measured: dict[int, tuple[int, np.ndarray]] | None = None):
        self.num, self.den = num, den
        self.upper = [0]
        self.measured = measured
        self.allocated: dict[int, np.ndarray] = {}
        if measured is not None:
            for band in measured:
                self.of(band)
            self.measured = dict.fromkeys(measured)

    def _reach(self, band: int) -> int:
        while len(self.upper) <= band:
            self.upper.append(max(self.upper[-1] + 1, self.upper[-1] * self.den // self.num))
        return self.upper[band]

    def band(self, size: np.ndarray) -> np.ndarray:
        while self.upper[-1] < size.max(initial=1):
            self._reach(len(self.upper))
        return np.searchsorted(np.array(self.upper), size, "left")

    def needed(self, band: int) -> int:
        """H + 1."""
        return self.differ(2 * self._reach(band)) + 1

    def of(self, band: int) -> np.ndarray:
        """The allocation of each segment; none where only equal sets are linked or no set is."""
        if band not in self.allocated:
            none = self.needed(band) == 1 or self.measured is not None and band not in self.measured
            self.allocated[band] = np.zeros(0, np.uint8) if none else self._allocate(band)
        return self.allocated[band]

    def _allocate(self, band: int) -> np.ndarray:
        upper, need = self.upper[band], self.needed(band)
        sets, cells = (1, np.zeros(CELLS)) if self.measured is None else self.measured[band]
        usual = np.median(cells)
        heat = np.maximum(cells - usual - 3 * np.sqrt(usual), 0.0) ** 2
        # Sets of this band and of the one below.
        least, mean = max(self.upper[band - 2] + 1 if band > 1 else 1, 1), (upper + self.upper[max(band - 2, 0)]) / 2
        best, found = np.inf, None
        for share in (0.5, 0.55, 0.6, 0.7, 0.8, 0.9, 1.0, 1.05, 1.1, 1.15, 1.2, 1.3, 1.5, 2.0):
            cost, levels = self._levels(max(-(-need // 2), round(need * share)), need, sets, heat, least, mean)
            if cost < best:
                best, found = cost, levels
        return found if found is not None else np.full(max(2 * need, 1), 1, np.uint8)

    @staticmethod
    def _levels(m: int, need: int, sets: int, heat: np.ndarray, least: float, mean: float) -> tuple[float, np.ndarray | None]:
        """The cheapest allocation of m segments, and its cost in bytes; None if they cannot count enough for a set of `least` tokens."""
        none, one = (1 - 1 / m) ** mean, mean / m * (1 - 1 / m) ** (mean - 1)
        none_least, one_least = (1 - 1 / m) ** least, least / m * (1 - 1 / m) ** (least - 1)
        if m <= CELLS:
            warm, low = np.zeros(m), np.arange(CELLS) * m // CELLS
            high = (np.arange(1, CELLS + 1) * m - 1) // CELLS
            np.add.at(warm, low, heat)
            np.add.at(warm, high[high > low], heat[high > low])
        else:
            warm = heat[np.arange(m) * CELLS // m] * CELLS / m
        first = RECORD * sets * (1 - none) + PAIR / 2 * warm * none**2
        second = RECORD * sets * (1 - none + mean / m) + PAIR / 2 * warm * (none + one) ** 2
        gain, more = 1 - none_least, 1 - none_least - one_least
        if gain <= 0 or more <= 0:
            return np.inf, None
        step = (second - first) / more
        joint = step < first / gain  # both levels together are cheaper for what they count than the first alone
        price = np.concatenate([np.where(joint, second / (gain + more), first / gain), np.where(joint, np.inf, step)])
        counts = np.concatenate([np.where(joint, gain + more, gain), np.where(joint, 0.0, more)])
        cost = np.concatenate([np.where(joint, second, first), np.where(joint, 0.0, second - first)])
        order = np.argsort(price, kind="stable")
        target = need + 2 * np.sqrt(m * none_least * (1 - none_least)) - 1e-9
        taken = int(np.searchsorted(np.cumsum(counts[order]), target)) + 1
        if counts.sum() < target:
            return np.inf, None
        chosen = order[:taken]
        levels = np.zeros(m, np.uint8)
        np.add.at(levels, chosen % m, np.where(joint[chosen % m], 2, 1).astype(np.uint8))
        return float(cost[chosen].sum()), levels

    def differ(self, size: int) -> int:
        """In how many tokens two linked sets may differ, of so many tokens together."""
        return size * (self.den - self.num) // (self.den + self.num)

    def sketches(self, owner: np.ndarray, token: np.ndarray, rows: int) -> list[bytes]:
        """A parity sketch for each row, four times as many bits as linked sets of its band may differ in tokens, a power of two."""
        band = self.band(np.bincount(owner, minlength=rows))
        width = np.array([max(256, 1 << (4 * self.differ(2 * self.upper[b])).bit_length()) for b in range(int(band.max(initial=0)) + 1)])[band]
        base = np.concatenate([[0], np.cumsum(width)])
        bit = base[owner] + (mix(token + U64(0xB17)) & (width[owner] - 1).astype(U64)).astype(np.int64)
        packed = np.packbits(np.bincount(bit, minlength=base[-1]).astype(np.uint8) & 1).tobytes()
        return [packed[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]

    @staticmethod
    def hashes(token: np.ndarray, band: np.ndarray, seed: int) -> np.ndarray:
        """By the upper bits of these a band's tokens fall into cells and segments."""
        return mix(token + mix((band * SEEDS + seed + 1).astype(U64)))

    def signatures(self, owner: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Signatures and their rows, each distinct in its row."""
        size = np.bincount(owner, minlength=rows)
        own = self.band(size)
        found = []
        for step in (0, 1):
            band = own + step
            plans = [self.of(b) for b in range(int(band.max(initial=0)) + 1)]
            segments = np.array([len(p) for p in plans])
            base, levels = np.concatenate([[0], np.cumsum(segments)])[:-1], np.concatenate(plans)
            need = np.array([self.needed(b) for b in range(len(plans))])
            live = (size > 0) & (segments[band] > 0)
            for seed in range(SEEDS - 1):
                if not live.any():
                    break
                sig, of, counts = self._of_seed(owner, token, live, band, segments, base, levels, seed)
                found.append((sig, of))
                live = live & (counts < need[band])
            if live.any():
                found.append(self._whole(owner, token, live, band, need[band]))
        if not found:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        return np.concatenate([s for s, _ in found]), np.concatenate([o for _, o in found])

    @classmethod
    def _segments(cls, owner, token, live, band, m, seed, levels=None, base=None):
        """Rows, tokens and segments of those that are allocated, by row and segment; the first of each segment."""
        use = live[owner]
        o, t = owner[use], token[use]
        place = ((cls.hashes(t, band[o], seed) >> U64(32)) * m[o].astype(U64) >> U64(32)).astype(np.int64)
        if levels is not None:
            use = levels[base[band[o]] + place] > 0
            o, t, place = o[use], t[use], place[use]
        order = np.argsort((o.astype(U64) << U64(32)) | place.astype(U64), kind="stable")
        o, t, place = o[order], t[order], place[order]
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (place[1:] != place[:-1])
        return o, t, place, np.flatnonzero(new)

    @staticmethod
    def _salt(band, place, seed):
        return mix((band * SEEDS + seed).astype(U64) * U64(1 << 32) + place.astype(U64))

    @classmethod
    def _of_seed(cls, owner, token, live, band, segments, base, levels, seed):
        o, t, place, first = cls._segments(owner, token, live, band, segments[band], seed, levels, base)
        if not len(o):
            return np.zeros(0, U64), o, np.zeros(len(live))
        value = mix(t + U64(0x51))
        content = np.add.reduceat(value, first)
        of, length = o[first], np.diff(first, append=len(o))
        salt = cls._salt(band[of], place[first], seed)
        near = (levels[base[band[of]] + place[first]] == 2) & (length > 1)
        counts = np.bincount(of, 1.0 + near, minlength=len(live))
        which = np.repeat(np.arange(len(first)), length)
        drop = near[which]
        lacking = mix(content[which[drop]] - value[drop] + salt[which[drop]])
        return np.concatenate([mix(content + salt), lacking]), np.concatenate([of, o[drop]]), counts

    @classmethod
    def _whole(cls, owner, token, live, band, need):
        """Under the last seed: H + 1 segments, empty or not."""
        seed = SEEDS - 1
        rows = np.flatnonzero(live)
        start = np.zeros(len(live) + 1, np.int64)
        np.cumsum(np.where(live, need, 0), out=start[1:])
        content = np.zeros(start[-1], U64)
        o, t, place, first = cls._segments(owner, token, live, band, need, seed)
        content[start[o[first]] + place[first]] = np.add.reduceat(mix(t + U64(0x51)), first)
        of = np.repeat(rows, need[rows])
        return mix(content + cls._salt(band[of], np.arange(start[-1]) - start[of], seed)), of


def _digests(owner: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit values of each row's set."""
    out = []
    for salt in (0x1234567, 0x89ABCDE):
        sums = np.zeros(len(token) + 1, U64)
        np.cumsum(mix(token + U64(salt)), out=sums[1:])
        at = np.searchsorted(owner, np.arange(rows + 1))
        out.append(mix(sums[at[1:]] - sums[at[:-1]] + (at[1:] - at[:-1]).astype(U64)))
    return out[0], out[1]


_DESCRIBED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("entity", pa.int64()), ("other", pa.int64()), ("sketch", pa.binary()), ("name", pa.string()), ("part", pa.int32()), ("blob", pa.binary())])
_DESCRIBED_SQL = "doc_id long, n long, entity long, other long, sketch binary, name string, part int, blob binary"


def _describe(n: int, num: int, den: int):
    """Each document's set, and at the end of a task what it has counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, seen = Plan(num, den), np.zeros(1 << 16, U64)
        sets: dict[int, int] = {}
        cells: dict[int, np.ndarray] = {}
        for part in slices(batches):
            rows = part.num_rows
            owner, token = shingle_sets(part.column("text"), n)
            entity, other = _digests(owner, token, rows)
            size = np.bincount(owner, minlength=rows)
            sketches = plan.sketches(owner, token, rows)
            described = [part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(entity.view(np.int64)), pa.array(other.view(np.int64)), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*described, *(pa.nulls(rows, f.type) for f in list(_DESCRIBED)[5:])], schema=_DESCRIBED)
            own = plan.band(size)
            for b, k in zip(*(x.tolist() for x in np.unique(own[size > 0], return_counts=True)), strict=True):
                sets[b] = sets.get(b, 0) + k
            filled = np.flatnonzero(size > 0)
            if not len(filled):
                continue
            least = np.minimum.reduceat(token, np.searchsorted(owner, filled))
            fresh = np.zeros(rows, bool)
            for row, h in zip(filled.tolist(), least.tolist(), strict=True):
                if seen[h & 0xFFFF] != h:
                    seen[h & 0xFFFF], fresh[row] = h, True
            use = fresh[owner]
            o, t = owner[use], token[use]
            for step in (0, 1):
                band = own[o] + step
                cell = (Plan.hashes(t, band, 0) >> U64(52)).astype(np.int64)
                # A set counts once in a cell.
                key = np.unique(o * CELLS + cell)
                found = np.bincount((own[key // CELLS] + step) * CELLS + key % CELLS)
                for b in np.unique(own[fresh] + step).tolist():
                    got = found[b * CELLS : (b + 1) * CELLS]
                    cells[b] = cells.get(b, np.zeros(CELLS, np.int64)) + np.pad(got, (0, CELLS - len(got)))
        counts = np.bincount(list(sets), list(sets.values()), CELLS).astype(np.int64) if sets else np.zeros(CELLS, np.int64)
        found = [r for b, v in cells.items() for r in count_rows(str(b), v)] + count_rows("sets", counts)
        yield batch(_DESCRIBED, [(None, None, None, None, None, *r) for r in found])

    return run


def measured(counts: dict[str, np.ndarray]) -> dict[int, tuple[int, np.ndarray]]:
    """What Plan takes, of the sums of all tasks' counts. A band without sets of its own needs no signatures."""
    sets = counts.get("sets", np.zeros(CELLS, np.int64))
    return {b: (int(sets[b] + sets[b - 1]), counts.get(str(b), np.zeros(CELLS))) for b in np.flatnonzero(sets).tolist()}


_SIGNED = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
_SIGNED_SQL = "bucket int, blob binary"


def _sign(n: int, plan, buckets: int):
    """Signatures of all sets, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(_ENTRY, buckets)
        for part in slices(batches):
            rows = part.num_rows
            owner, token = shingle_sets(part.column("text"), n)
            entity, _ = _digests(owner, token, rows)
            # Equal sets of this batch send their signatures once.
            once = np.zeros(rows, bool)
            once[np.unique(entity, return_index=True)[1]] = True
            use = once[owner]
            sig, of = plan.value.signatures(owner[use], token[use], rows)
            records = np.empty(len(sig), _ENTRY)
            records["sig"], records["entity"] = sig, entity[of]
            packer.add(records, bucket_of(sig, buckets))
            if packer.full():
                yield batch(_SIGNED, list(packer.take()))
        yield batch(_SIGNED, list(packer.take()))

    return run


_GROUPS = pa.schema([("group", pa.int64()), ("blob", pa.binary())])
_GROUPS_SQL = "group long, blob binary"


def _groups(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Of one bucket, each group of two entities or more that share a signature: its members in rows of CHUNK."""
    entries = unpack(blobs, _ENTRY)
    order = np.lexsort((entries["entity"], entries["sig"]))
    sig, entity = entries["sig"][order], entries["entity"][order]
    del entries
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (entity[1:] != entity[:-1])
    sig, entity = sig[new], entity[new]
    first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0) if len(sig) else np.zeros(0, np.int64)
    length = np.diff([*first, len(sig)])
    many = length > 1
    known: set[tuple[int, int, int]] = set()
    sums = np.zeros(len(sig) + 1, U64)
    np.cumsum(mix(entity + U64(0x77)), out=sums[1:])
    total = sums[first + length] - sums[first]
    rows = []
    for at, size, whole, name in zip(first[many].tolist(), length[many].tolist(), total[many].tolist(), mix(total[many]).view(np.int64).tolist(), strict=True):
        content = (size, int(entity[at]), whole)
        if content in known:  # another segment with the same members
            continue
        known.add(content)
        for k in range(0, size, CHUNK):
            rows.append((name, entity[at + k : at + min(k + CHUNK, size)].tobytes()))
        if len(rows) >= 4096:
            yield batch(_GROUPS, rows)
            rows = []
    yield batch(_GROUPS, rows)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, of which one is held at a time."""
    now, held = None, []
    for part in batches:
        for b, blob in zip(part.column("bucket").to_pylist(), part.column("blob").to_pylist(), strict=True):
            if b != now and held:
                yield from _groups(held)
                held = []
            now = b
            held.append(blob)
    if held:
        yield from _groups(held)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups' rows to members."""
    for part in batches:
        group = np.repeat(part.column("group").to_numpy(zero_copy_only=False), [len(b) // 8 for b in part.column("blob").to_pylist()] if part.num_rows else [])
        member = np.frombuffer(b"".join(part.column("blob").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int64)), pa.array(member)], ["group", "entity"])


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one length, the least one: halves laid over each other."""
    least = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least // 8), axis=0) for x in sketches])


def _near(num: int, den: int):
    """Rows sorted by comparison (least, p, q): pairs of a family's members from different components whose sketches allow a link."""

    def pairs(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        least, p, q, entity, component, size, sketch, chunk, leaders = zip(*rows, strict=True)
        leaders = [set(x) for x in leaders]
        entity, component, size, chunk = (np.array(x) for x in (entity, component, size, chunk))
        bits, both, found = _folded(list(sketch)), p[0] != q[0], []
        for k in range(0, len(rows), 64):
            own = slice(k, k + 64)
            ok = (entity[own, None] < entity) & (component[own, None] != component)
            if both:
                ok &= chunk[own, None] != chunk
            ok &= num * np.maximum(size[own, None], size) <= den * np.minimum(size[own, None], size)
            a, b = np.nonzero(ok)
            for m in range(0, len(a), 1 << 16):
                x, y = a[m : m + (1 << 16)] + k, b[m : m + (1 << 16)]
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero(apart * (den + num) <= (den - num) * (size[x] + size[y]))
                # A pair that several families hold is given by the one with the least leader.
                near = np.array([i for i in near.tolist() if min(leaders[x[i]] & leaders[y[i]]) == least[0]], np.int64)
                found.append((entity[x[near]], entity[y[near]]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            a, b = pairs(held)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for part in batches:
            for row in zip(*(part.column(c).to_pylist() for c in ("least", "p", "q", "entity", "component", "n", "sketch", "chunk", "leaders")), strict=True):
                if row[:3] != key and held:
                    yield done()
                    held = []
                key = row[:3]
                held.append(row)
        if held:
            yield done()

    return run


def _compare(n: int, num: int, den: int):
    """Rows sorted so that each leader's text comes before its members'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leader = None, np.zeros(0, U64)
        for part in slices(batches):
            owner, token = shingle_sets(part.column("text"), n)
            d1, d2 = _digests(owner, token, part.num_rows)
            at = np.searchsorted(owner, np.arange(part.num_rows + 1))
            out = []
            columns = [part.column(c).to_pylist() for c in ("lead", "chief", "salt", "member", "entity", "other")]
            for k, (lead, chief, salt, member, entity, other) in enumerate(zip(*columns, strict=True)):
                if np.int64(d1[k].view(np.int64)) != entity or np.int64(d2[k].view(np.int64)) != other:
                    continue  # another document of the same id
                own = token[at[k] : at[k + 1]]
                if member is None:
                    key, leader = (lead, chief, salt), own
                elif key == (lead, chief, salt) and member != lead:
                    both = len(np.intersect1d(leader, own, assume_unique=True))
                    if den * both >= num * (len(leader) + len(own) - both):
                        out.append((lead, member))
            yield batch(pa.schema([("a", pa.int64()), ("b", pa.int64())]), out)

    return run


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """pairs: (a, b) of entities. Returns (a, b), the representatives' ids, of those that are linked."""
    side = lambda c: classes.select(F.col("entity").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("entity", "other", "rep", "n")))
    found = pairs.join(side("a"), "a").join(side("b"), "b").filter((num * F.greatest("a_n", "b_n") <= den * F.least("a_n", "b_n")) & (F.col("a_rep") != F.col("b_rep")))
    found = materialize(found.drop("a", "b").distinct())
    # One id may stand for several sets, so a leader is an id and a set.
    parts = found.groupBy("a_rep", "a_entity").agg(F.first("a_other").alias("other"), F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    members = found.join(parts.select("a_rep", "a_entity", "salts"), ["a_rep", "a_entity"]).select(
        F.col("a_rep").alias("lead"), F.col("a_entity").alias("chief"), F.pmod(F.xxhash64("b_rep"), F.col("salts")).cast("int").alias("salt"), F.col("b_rep").alias("member"), F.col("b_entity").alias("entity"), F.col("b_other").alias("other"), F.col("b_rep").alias("doc_id")
    )
    leads = parts.select(F.col("a_rep").alias("lead"), F.col("a_entity").alias("chief"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("member"), F.col("a_entity").alias("entity"), "other", F.col("a_rep").alias("doc_id"))
    # One shuffle of the texts serves both sides.
    rows = members.unionAll(leads).join(texts(docs), "doc_id").drop("doc_id")
    dealt = rows.repartition(tasks(docs.sparkSession), "lead", "chief", "salt").sortWithinPartitions("lead", "chief", "salt", F.col("member").asc_nulls_first())
    return materialize(dealt.mapInArrow(_compare(n, num, den), "a long, b long"))


def join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id long, n_shingles long, component_id long (the least doc_id that links reach) for every document."""
    spark = docs.sparkSession
    dealt_to = tasks(spark)
    buckets = dealt_to * BUCKETS
    docs = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    described = materialize(docs.mapInArrow(_describe(n, num, den), _DESCRIBED_SQL))
    own = described.filter("name is null").select("doc_id", "n", "entity", "other", "sketch")
    counts = collect_counts(described.filter("name is not null").select("name", "part", "blob"), CELLS)
    plan = spark.sparkContext.broadcast(Plan(num, den, measured(counts)))
    # Copies are counted before they are dealt out, so a group of any size is a row for each task.
    classes = materialize(own.filter("n > 0").groupBy("entity", "other").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    signed = docs.mapInArrow(_sign(n, plan, buckets), _SIGNED_SQL).repartition(dealt_to, "bucket").sortWithinPartitions("bucket")
    groups = materialize(signed.mapInArrow(_reduce, _GROUPS_SQL))
    member = materialize(groups.mapInArrow(_members, "group long, entity long").distinct())
    least = member.groupBy("group").agg(F.min("entity").alias("least"))
    stars = member.join(least, "group").filter("entity <> least").select(F.col("least").alias("a"), F.col("entity").alias("b")).distinct()
    links = _verified(stars, classes, docs, n, num, den)
    reached = components(links)
    # Groups with members of several components: pairs across them that their sketches allow.
    at = classes.join(reached.withColumnRenamed("node", "rep"), "rep", "left").select("entity", "n", "sketch", F.coalesce("component", "rep").alias("component"))
    placed = member.join(at.select("entity", "component"), "entity")
    mixed = placed.groupBy("group").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("entity").alias("least")).filter("lo <> hi").select("group", "least")
    # Groups with one leader are one family: a pair that meets in many segments is looked at once for each leader, not for each segment.
    family = materialize(member.join(mixed, "group").filter("entity <> least").select("least", "entity").distinct())
    leaders = family.groupBy("entity").agg(F.collect_list("least").alias("leaders"))  # no more than a set has signatures
    parts = family.groupBy("least").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    rest = family.join(parts, "least").join(at, "entity").join(leaders, "entity").withColumn("chunk", F.pmod(F.xxhash64("entity"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rest = rest.withColumn("other", other).select("least", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"), "entity", "component", "n", "sketch", "chunk", "leaders")
    dealt = rest.repartition(dealt_to, "least", "p", "q").sortWithinPartitions("least", "p", "q")
    across = materialize(dealt.mapInArrow(_near(num, den), "a long, b long").distinct()).join(stars, ["a", "b"], "left_anti")
    more = _verified(across, classes, docs, n, num, den)
    reached = components(links.unionAll(more))
    place = classes.join(reached.withColumnRenamed("node", "rep"), "rep", "left").select("entity", "other", F.coalesce("component", "rep").alias("component"))
    return own.join(place, ["entity", "other"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component, with the columns it had: the one with the least doc_id, and of several texts of that id the one with the least digest.

    Rows of one id are told apart by their texts: equal texts of an id are one row, the least in a fixed order of whole rows.
    """
    columns = docs.columns
    # Rows without an id cannot be told apart: they stay.
    known, bare = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    again = materialize(known.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("doc_id"))
    if again.isEmpty():
        keep = join(known, n, num, den).filter("doc_id = component_id").select("doc_id")
        return known.join(keep, "doc_id", "left_semi").select(columns).unionAll(bare)
    once = known.join(again, "doc_id", "left_anti").select(columns)
    # Ids of several rows: one row of each (id, text), and a number of its own for all but the first text of an id.
    rows = known.join(again, "doc_id", "left_semi").select(F.struct(columns).alias("row"))
    order = F.sha2(F.to_json("row"), 256)
    text = F.when(F.col("row.text").rlike("[^ \\t-\\r]"), F.col("row.text")).otherwise("")  # texts without a word are equal
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("id"), F.md5(text).alias("form"), order.alias("order"))
    rows = rows.groupBy("id", "form").agg(F.min_by("row", "order").alias("row"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("form")) == 1
    rows = materialize(rows.withColumn("first", first).withColumn("extra", F.monotonically_increasing_id()))
    above = known.agg(F.max(F.col("doc_id").cast("long"))).first()[0] + 1
    rows = rows.withColumn("number", F.when(F.col("first"), F.col("id")).otherwise(F.col("extra") + above)).drop("first", "extra")
    sets = once.select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionAll(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")))
    found = join(sets, n, num, den).select(F.col("doc_id").alias("number"), "component_id")
    named = found.join(rows.select("number", "id", "form"), "number", "left")
    least = F.min(F.struct(F.coalesce("id", "number").alias("id"), F.coalesce("form", F.lit("")).alias("form"), "number"))
    keep = materialize(named.groupBy("component_id").agg(least.alias("least")).select("least.number"))
    return once.join(keep, once.doc_id.cast("long") == keep.number, "left_semi").unionAll(rows.join(keep, "number", "left_semi").select("row.*")).unionAll(bare)
