"""Static range asymmetric numeral system over token ids, vectorised with numpy.

One frequency table, scaled to 2**SCALE, is shared by all blocks. A block's ids are dealt to LANES
interleaved coders; every SEGMENT ids the coders' states and the place in the word stream are kept as
a checkpoint, so that segments decode independently (here: side by side in one vector). States are
64 bits wide and are refilled by 32-bit words. A decoder must end in the state that the encoder began
with and have used all words; a CRC-32 over the ids guards the block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LANES, SEGMENT = 8, 4096
START = np.uint64(1 << 31)
LOW, BITS, WORD = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
#: A product with it adds up the bytes of a number from the lowest on: running sums over eight lanes.
RUNNING = np.uint64(0x0101010101010101)
MAGIC = b"TRA1"
_HEAD = struct.Struct("<4sIIIII")  # magic, table checksum, ids, segments, words, crc of the ids


class FrequencyTable:
    """Frequencies of ids that sum to 2**SCALE, each seen id at least one."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        if int(self.freq.sum()) != 1 << SCALE:
            raise ValueError("frequencies must sum to 2**SCALE")
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.checksum = zlib.crc32(self.freq.astype("<u4").tobytes())
        #: For the encoder: an id's start and frequency in one number.
        self.packed = self.start << np.uint64(SCALE) | np.maximum(self.freq, 1) - np.uint64(1)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """For the decoder: of each slot the id, its place among the id's slots, and the id's frequency less one, in one number."""
        if self._slots is None:
            times = self.freq.astype(np.int64)
            place = np.arange(1 << SCALE, dtype=np.uint64) - np.repeat(self.start, times)
            self._slots = np.repeat(np.arange(len(times), dtype=np.uint64) << np.uint64(2 * SCALE) | self.packed & LOW, times) | place << np.uint64(SCALE)
        return self._slots

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> FrequencyTable:
        """Counts (of any sum, zero too) in proportion; what rounding leaves goes to or comes from the most frequent."""
        total, room = int(counts.sum()), 1 << SCALE
        if not total:
            freq = np.zeros(max(1, len(counts)), np.int64)
            freq[0] = room
            return cls(freq)
        seen = counts > 0
        if int(seen.sum()) > room:
            raise ValueError(f"more than {room} distinct ids")
        freq = np.where(seen, np.maximum(1, np.floor(counts.astype(np.float64) * room / total).astype(np.int64)), 0)
        rest = room - int(freq.sum())
        order = np.argsort(-freq, kind="stable")
        if rest > 0:
            freq[order[0]] += rest
        for i in order:
            if rest >= 0:
                break
            give = min(-rest, int(freq[i]) - 1)
            freq[i] -= give
            rest += give
        return cls(freq)


def _lengths(sizes: list[int]) -> np.ndarray:
    """Ids in each segment of blocks of these sizes."""
    return np.concatenate([np.zeros(0, np.int64), *(np.minimum(SEGMENT, n - SEGMENT * np.arange(-(-n // SEGMENT))) for n in sizes)]).astype(np.int64)


def _quotient(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    """x // f, where it is below 2**43: floating division is off by one at most, which the remainder shows."""
    q = (x.astype(np.float64) / f.astype(np.float64)).astype(np.uint64)
    rest = (x - q * f).view(np.int64)
    q -= rest < 0
    q += rest >= f.view(np.int64)
    return q


def encode_blocks(blocks: list[np.ndarray], table: FrequencyTable) -> list[bytes]:
    """One payload for each array of ids, all coded side by side: a row of lanes per segment, longest segments first."""
    lengths = _lengths([len(b) for b in blocks])
    order = np.argsort(-lengths, kind="stable")
    rows, steps = len(lengths), SEGMENT // LANES
    flat = np.zeros((rows, SEGMENT), np.uint32)
    at = 0
    for b in blocks:
        if len(b) and (int(b.max()) >= len(table.freq) or not table.freq[b].all()):
            raise ValueError("an id has no frequency in the table")
        n = -(-len(b) // SEGMENT)
        flat[at : at + n].reshape(-1)[: len(b)] = b
        at += n
    ids = np.ascontiguousarray(flat[order].reshape(rows, steps, LANES).transpose(1, 0, 2))
    state = np.full((rows, LANES), START, np.uint64)
    out, sent = np.zeros(ids.shape, np.uint32), np.zeros(ids.shape, bool)
    room, all_slots = np.uint64(31 - SCALE + 32), np.uint64(1 << SCALE)
    sizes = lengths[order]
    for step in range(steps - 1, -1, -1):
        used = int((sizes > step * LANES).sum())
        if not used:
            continue
        s, x = ids[step, :used], state[:used]
        p = table.packed[s]
        f = (p & LOW) + np.uint64(1)
        full = x >= f << room
        whole = int((sizes >= (step + 1) * LANES).sum())
        if whole < used:  # segments that end within this step
            live = step * LANES + np.arange(LANES) < sizes[whole:used, None]
            full[whole:] &= live
        out[step, :used] = x
        sent[step, :used] = full
        x = np.where(full, x >> WORD, x)
        new = x + _quotient(x, f) * (all_slots - f) + (p >> BITS)
        if whole < used:
            new[whole:] = np.where(live, new[whole:], x[whole:])
        state[:used] = new
    back = np.empty(rows, np.int64)
    back[order] = np.arange(rows)
    out, sent, state = (np.ascontiguousarray(v.transpose(1, 0, 2))[back] for v in (out, sent, state[None]))
    state = state[:, 0]
    laid = [(range(-(-len(b) // SEGMENT)), None) for b in blocks]
    payloads, at = [], 0
    for b, (x, _) in zip(blocks, laid, strict=True):
        n = len(x)
        mask = sent[at : at + n]
        words = out[at : at + n][mask]
        before = np.concatenate(([0], np.cumsum(mask.sum(axis=(1, 2)))[:-1])) if n else np.zeros(0)
        head = _HEAD.pack(MAGIC, table.checksum, len(b), n, len(words), zlib.crc32(b.astype("<u4").tobytes()))
        payloads.append(head + before.astype("<u4").tobytes() + state[at : at + n].astype("<u8").tobytes() + words.astype("<u4").tobytes())
        at += n
    return payloads


def decode_blocks(payloads: list[bytes], table: FrequencyTable) -> list[np.ndarray]:
    """The ids of each payload; ValueError for a payload that is damaged or was made with another table."""
    heads, first, states, words, bases, base = [], [], [], [], [], 0
    for p in payloads:
        if len(p) < _HEAD.size:
            raise ValueError("a block is cut short")
        magic, checksum, n, segments, count, crc = _HEAD.unpack_from(p)
        size = _HEAD.size + segments * (4 + 8 * LANES) + 4 * count
        if magic != MAGIC or checksum != table.checksum or len(p) != size or segments != -(-n // SEGMENT):
            raise ValueError("not a block of this table")
        heads.append((n, segments, count, crc))
        at = _HEAD.size
        first.append(np.frombuffer(p, "<u4", segments, at).astype(np.int64) + base)
        states.append(np.frombuffer(p, "<u8", segments * LANES, at + 4 * segments).reshape(segments, LANES))
        words.append(np.frombuffer(p, "<u4", count, at + segments * (4 + 8 * LANES)))
        base += count
        bases.append(base)
    if not payloads:
        return []
    stream = np.concatenate([*words, np.zeros(SEGMENT + 1, np.uint32)]).astype(np.uint64)  # damaged blocks may ask for more
    at, state = np.concatenate(first), np.concatenate(states).astype(np.uint64)
    ends = np.concatenate([np.append(f[1:], e) if len(f) else f for f, e in zip(first, bases, strict=True)])
    lengths = _lengths([n for n, _, _, _ in heads])
    order = np.argsort(-lengths, kind="stable")
    sizes, at, state = lengths[order], at[order], state[order]
    steps = SEGMENT // LANES
    out = np.zeros((steps, len(at), LANES), np.uint32)
    slots = table.slots
    for step in range(steps):
        used = int((sizes > step * LANES).sum())
        if not used:
            break
        x = state[:used]
        p = slots[x & LOW]
        new = ((p & LOW) + np.uint64(1)) * (x >> BITS) + (p >> BITS & LOW)
        need = new < START
        whole = int((sizes >= (step + 1) * LANES).sum())
        if whole < used:  # segments that end within this step
            live = step * LANES + np.arange(LANES) < sizes[whole:used, None]
            need[whole:] &= live
            new[whole:] = np.where(live, new[whole:], x[whole:])
        out[step, :used] = p >> np.uint64(2 * SCALE)
        if need.any():
            place = (need.view(np.uint64) * RUNNING).view(np.uint8).reshape(need.shape)
            words = stream[at[:used, None] + place - 1]
            new = np.where(need, new << WORD | words, new)
            at[:used] += place[:, -1]
        state[:used] = new
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    out, at, state = np.ascontiguousarray(out.transpose(1, 0, 2))[back], at[back], state[back]
    if (state != START).any() or (at != ends).any():
        raise ValueError("a block's stream doesn't end where its encoder began")
    found, k = [], 0
    for n, segments, _, crc in heads:
        ids = out[k : k + segments].reshape(-1)[:n]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's ids don't match their checksum")
        found.append(ids)
        k += segments
    return found
