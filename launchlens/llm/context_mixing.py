"""Language-model scores by logistic mixing of hashed-context bit predictors.

A byte is coded as the bits of its place in a code tree, one tree for each byte that can stand before it.
Each bit is predicted from six contexts: the last two to six bytes, and the word so far
with the byte before it. A predictor is a hashed table of bit counts, summed over all
training texts. Their log odds are combined by weights that a gate selects, the gate being
the bit's depth and which predictors have seen their context; a last table corrects the mix by the byte before
and the size of the log odds. Weights and corrections are learned online, step by step, in shares of all
training texts, and are then fixed: scoring a text changes nothing.

All that the model does with a byte follows from its place: the six bytes before it, the word so far and the byte. Equal
places are looked at once, with how often they occur, when bits are counted, when the mixer learns and when texts are scored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from launchlens.llm import words as W
from launchlens.session import cut_lineage

#: The byte that ends every text; it never occurs in UTF-8.
END = 255
#: Slots of each predictor's table as a power of two, and slots that one row of partial counts covers.
SLOT_BITS, PART_BITS = 22, 14
N_CONTEXTS = 6
MAX_DEPTH = 30
#: Training text of a share that one task fits a mixer on, about, and places that tables are looked up for at a time.
SHARE_BYTES, PIECE_BYTES = 32 << 20, 64 << 10
#: Different places that a task gathers before it goes on with them, about, and bytes of text that are scored together.
PLACES, SCORE_BYTES = 2 << 20, 8 << 20
#: Places of a step of the mixer at first, and at most, once it has taken STEPS steps of a size.
STEP_LEAST, STEP_MOST, STEPS = 4096, 32768, 16
#: What a weight, and a correction, counts at its start, as curvature.
RIDGE = 16.0
#: Weights and corrections are added up as multiples of this share of one, so that sums do not depend on their order.
UNIT = 1 << 16
#: Partial tables that one task adds up; more are added in rounds.
FAN_IN = 64
GATES = MAX_DEPTH * 8
LEVELS = 24
_NODE, _MULT = 0x9E3779B1, 0x85EBCA6B


def code_trees(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Huffman codes of the byte after each byte: (code, left-aligned in 32 bits; length), each 256 x 256.

    `pairs` counts (byte before, byte). Counts are scaled to 16 bits and raised by one, so every byte has a code of
    fewer than MAX_DEPTH bits.
    """
    code, length = np.zeros((256, 256), np.uint32), np.zeros((256, 256), np.uint8)
    for prev in range(256):
        row = pairs[prev].astype(np.int64)
        weight = (row << 16) // max(int(row.sum()), 1) + 1
        heap = [(int(w), s, (s,)) for s, w in enumerate(weight)]
        heapq.heapify(heap)
        bits = np.zeros(256, np.int64)
        tie = 256
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            both = a[2] + b[2]
            bits[list(both)] += 1
            heapq.heappush(heap, (a[0] + b[0], tie, both))
            tie += 1
        at, last = 0, 0
        for s in np.lexsort((np.arange(256), bits)):
            at <<= int(bits[s]) - last
            last = int(bits[s])
            code[prev, s] = at << (32 - last)
            at += 1
        length[prev] = bits
    return code, length


def byte_stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, each with its END, and the offsets of the texts."""
    data = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
    return W.fold_case()[data], np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])


def before(data: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The byte k places earlier in the same text, 0 before its start."""
    out = np.zeros_like(data)
    out[k:] = data[:-k] if k < len(data) else out[k:]
    for j in range(k):
        at = first[:-1] + j
        out[at[at < np.minimum(first[1:], len(data))]] = 0
    return out


def windows(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each byte with the six before it in its text, the byte itself last; 0 stands for what is before the text."""
    out = data.astype(np.uint64)
    for k in (1, 2, 4):
        out[k:] |= out[:-k] << np.uint64(8 * k)
    out &= np.uint64((1 << 56) - 1)
    for j in range(6):
        at = first[:-1] + j
        out[at[at < first[1:]]] &= np.uint64((1 << 8 * (j + 1)) - 1)
    return out


def word_states(data: np.ndarray) -> np.ndarray:
    """A hash of the word before each byte, as far as it goes: a sum of byte times a value of its place, taken from running totals."""
    new = (W.byte_classes()[data] == 0) | (data == END)
    starts = np.flatnonzero(np.concatenate([[True], new[:-1]]))
    size = np.diff(np.concatenate([starts, [len(data)]]))
    place = np.arange(len(data), dtype=np.uint32) - np.repeat(starts.astype(np.uint32), size)
    powers = (W.mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
    with np.errstate(over="ignore"):
        terms = (data.astype(np.uint32) + np.uint32(1)) * powers.take(np.minimum(place, np.uint32(31))) + place
        total = np.cumsum(terms, dtype=np.uint32)
        total -= terms
        return total - np.repeat(total[starts], size)


def context_hashes(window: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The byte before, and the N_CONTEXTS hashed contexts (uint32)."""
    p = [(window >> np.uint64(8 * k) & np.uint64(255)).astype(np.uint32) for k in range(1, 7)]
    with np.errstate(over="ignore"):
        two = (p[0] | p[1] << np.uint32(8)) * np.uint32(0x2545F491)
        orders, h = [], two
        for k in range(2, 6):
            h = (h + p[k] + np.uint32(1)) * np.uint32(0xB5297A4D)
            h ^= h >> np.uint32(15)
            orders.append(h)
        word = (word ^ p[0]) * np.uint32(0x1B56C4E9)
        word ^= word >> np.uint32(13)
    return p[0].astype(np.uint8), [two, *orders, word]


def contexts(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The byte before each byte, and the N_CONTEXTS hashed contexts (uint32)."""
    return context_hashes(windows(data, first), word_states(data))


def runs_of(window: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the places by a hash of theirs, and where in it a run of equal places starts.

    A number holds the hash's leading bits and the index; runs are told apart by the whole hash of 64 bits. Where leading bits clash a
    run may come in pieces, which changes nothing but the work.
    """
    with np.errstate(over="ignore"):
        key = word.astype(np.uint64)
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= window
        key *= np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xC4CEB9FE1A85EC53)
        key ^= key >> np.uint64(29)
    mask = np.uint64((1 << len(key).bit_length()) - 1)
    packed = key & ~mask
    packed |= np.arange(len(key), dtype=np.uint64)
    packed.sort()
    order = (packed & mask).view(np.int64)
    # what the index took the place of, at most 32 bits
    low, new = key.astype(np.uint32).take(order), np.ones(len(key), bool)
    np.not_equal(low[1:], low[:-1], out=new[1:])
    packed &= ~mask
    new[1:] |= packed[1:] != packed[:-1]
    return order, np.flatnonzero(new)


def places(blocks: Iterable[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, word state, how often) of the different places of many blocks of texts, in order of a hash.

    All bytes are in one result each; a result holds PLACES to twice as many places, the last one fewer.
    """
    held: list[tuple] = []
    size = 0

    def merged() -> tuple:
        window, word, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order, start = runs_of(window, word)
        one = order[start]
        return window[one], word[one], np.add.reduceat(n[order], start)

    for texts in blocks:
        data, first = byte_stream(texts)
        window, word = windows(data, first), word_states(data)
        order, start = runs_of(window, word)
        one = order[start]
        held.append((window[one], word[one], np.diff(start, append=len(order))))
        size += len(one)
        if size > 2 * PLACES:
            held = [merged()]
            size = len(held[0][0])
            if size > PLACES:
                yield held[0]
                held, size = [], 0
    if held:
        yield merged()


def longest_first(window: np.ndarray, length: np.ndarray) -> np.ndarray:
    """An order of the places by falling length of their codes, then by the bytes before, whose slots are looked up next to each other."""
    byte, packed = window.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), np.empty(len(window), "<u8")
    # from the top: length, bytes before, index
    own = packed.view(np.uint8).reshape(-1, 8)
    own[:, 7] = 255 - length.ravel().take(window.astype("<u8", copy=False).view("<u2")[::4])
    for k in (1, 2, 3):
        own[:, 7 - k] = byte[:, k]
    packed.view("<u4")[::2] = np.arange(len(window), dtype=np.uint32)
    packed.sort()
    return (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def bit_levels(data: np.ndarray, prev: np.ndarray, code: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, slice | np.ndarray, np.ndarray, np.ndarray]]:
    """(depth, places of the bytes with a bit there, their node hash, their bit). The places are a slice if codes only get shorter."""
    flat = prev.astype(np.int32) << 8 | data
    c, n = code.ravel().take(flat), length.ravel().take(flat)
    falling = bool((n[1:] <= n[:-1]).all())
    at = slice(0, len(n)) if falling else np.arange(len(n))
    for depth in range(MAX_DEPTH):
        keep = n > depth
        some = np.count_nonzero(keep)
        if not some:
            break
        if some < len(n):
            at, c, n = (slice(0, some), c[:some], n[:some]) if falling else (at[keep], c[keep], n[keep])
        with np.errstate(over="ignore"):
            node = ((c >> np.uint32(32 - depth) if depth else np.uint32(0)) | np.uint32(1 << depth)) * np.uint32(_NODE)
        yield depth, at, np.broadcast_to(node, c.shape), (c >> np.uint32(31 - depth)) & np.uint32(1)


def slots(context: np.ndarray, at: slice | np.ndarray, node: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        slot = context[at] + node
        slot *= np.uint32(_MULT)
        slot >>= np.uint32(32 - SLOT_BITS)
        return slot


def count_places(tables: np.ndarray, window: np.ndarray, word: np.ndarray, n: np.ndarray, code: np.ndarray, length: np.ndarray) -> None:
    """Adds the places' bits, as often as they occur, to tables[context, 2 * slot + bit] (uint32)."""
    one = np.uint32(1)
    for lo in range(0, len(window), PIECE_BYTES):
        cut = slice(lo, lo + PIECE_BYTES)
        order = longest_first(window[cut], length)
        piece = window[cut].take(order)
        prev, ctx = context_hashes(piece, word[cut].take(order))
        times = n[cut].take(order).astype(np.uint32)
        for _, at, node, bit in bit_levels(piece.astype(np.uint8), prev, code, length):
            t = times[at]
            for m in range(N_CONTEXTS):
                np.add.at(tables[m], (slots(ctx[m], at, node) << one | bit).astype(np.int64), t)


def count_bits(tables: np.ndarray, texts: list[bytes], code: np.ndarray, length: np.ndarray) -> None:
    """Adds the texts' bits to tables[context, 2 * slot + bit] (uint32)."""
    for found in places([texts]):
        count_places(tables, *found, code, length)


def shrink(n: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact to 15, then four steps for each doubling."""
    n = n.astype(np.float64)
    return np.where(n < 16, n, np.minimum(16 + np.floor(4 * np.log2(np.maximum(n, 16) / 16)), 255)).astype(np.uint8)


def grow(c: np.ndarray) -> np.ndarray:
    return np.where(c < 16, c, 16 * 2.0 ** ((c - 16.0) / 4))


def log_odds() -> tuple[np.ndarray, np.ndarray]:
    """Log odds of a one by (zeros << 8 | ones) of shrunk counts, and the same with one observation of the bit taken back, by bit."""
    zeros, ones = np.meshgrid(grow(np.arange(256)), grow(np.arange(256)), indexing="ij")
    odds = lambda a, b: np.clip(np.log((b + 0.4) / (a + 0.4)), -9, 9).ravel().astype(np.float32)
    return odds(zeros, ones), np.stack([odds(np.maximum(zeros - 1, 0), ones), odds(zeros, np.maximum(ones - 1, 0))])


def gate_of(depth: int, inputs: Sequence[np.ndarray]) -> np.ndarray:
    seen = (inputs[2] != 0).view(np.uint8) | (inputs[4] != 0).view(np.uint8) << np.uint8(1) | (inputs[5] != 0).view(np.uint8) << np.uint8(2)
    return seen.astype(np.int32) + depth * 8


def level_of(x: np.ndarray) -> np.ndarray:
    return np.clip(x * np.float32(1.5) + np.float32(LEVELS / 2), 0, LEVELS - 1).astype(np.int32)


class Mixer:
    """Weights by gate and, once weights are given, corrections by (byte before, level), learned online over the places of a share of texts.

    The texts are part of the counts, so each bit's own observation is taken back before it is predicted. A step takes some
    places of all depths, in order of a hash, each as often as it occurs. It goes by the gradient over the curvature summed up so far, so what
    was learned counts as much as what is new; steps grow with the places seen. Texts of any size are taken with the contexts of the whole text.
    """

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.full((GATES, N_CONTEXTS), 1.4 / N_CONTEXTS, np.float32) if weights is None else weights.astype(np.float32)
        self.correction = np.zeros(256 * LEVELS, np.float32)
        self.follows, self.steps, self.seen, self.places = weights is not None, 0, 0, 0
        self.curves, self.cell_curves = np.tile(np.eye(N_CONTEXTS) * RIDGE, (GATES, 1, 1)), np.full(256 * LEVELS, RIDGE)
        #: Bits that each weight row and each correction was learned from.
        self.gate_bits, self.cell_bits = np.zeros(GATES, np.int64), np.zeros(256 * LEVELS, np.int64)

    def learn(self, counts: np.ndarray, texts: list[bytes], code: np.ndarray, length: np.ndarray, back: np.ndarray) -> None:
        for found in places([texts]):
            self.learn_places(counts, *found, code, length, back)

    def learn_places(self, counts: np.ndarray, window: np.ndarray, word: np.ndarray, n: np.ndarray, code: np.ndarray, length: np.ndarray, back: np.ndarray) -> None:
        lo = 0
        while lo < len(window):
            cut = slice(lo, lo + min(STEP_MOST, max(STEP_LEAST, self.places // STEPS)))
            self._step(counts, window[cut], word[cut], n[cut], code, length, back.ravel())
            self.places += len(window[cut])
            lo = cut.stop

    def _step(self, counts: np.ndarray, window: np.ndarray, word: np.ndarray, n: np.ndarray, code: np.ndarray, length: np.ndarray, back: np.ndarray) -> None:
        order = longest_first(window, length)
        window, n = window.take(order), n.take(order).astype(np.float32)
        prev, ctx = context_hashes(window, word.take(order))
        levels = ((depth, at, node, bit, bit << np.uint32(16)) for depth, at, node, bit in bit_levels(window.astype(np.uint8), prev, code, length))
        inputs = ((depth, at, bit, [back.take(counts[m].take(slots(ctx[m], at, node), mode="wrap") | side, mode="wrap") for m in range(N_CONTEXTS)]) for depth, at, node, bit, side in levels)
        if self.follows:
            self._correct(inputs, prev.astype(np.int32) * LEVELS, n)
        else:
            self._weigh(inputs, n)
        self.steps += 1

    def _weigh(self, inputs: Iterable[tuple], n: np.ndarray) -> None:
        grad = np.zeros((GATES, N_CONTEXTS))
        for depth, at, bit, x in inputs:
            # bits of a gate stand together, so that each gate takes a product of matrices
            seen = gate_of(0, x).astype(np.uint8)
            order = np.argsort(seen, kind="stable")
            x, times, t = np.stack([y.take(order) for y in x]), n[at].take(order), bit.take(order).astype(np.float32)
            ends = np.cumsum(np.bincount(seen, minlength=8))
            gates = [(depth * 8 + k, slice(int(ends[k - 1]) if k else 0, int(ends[k]))) for k in range(8) if ends[k] > (ends[k - 1] if k else 0)]
            z = np.concatenate([self.weights[g] @ x[:, cut] for g, cut in gates])
            sums = np.add.reduceat(times, [cut.start for _, cut in gates], dtype=np.float64)
            self.gate_bits[[g for g, _ in gates]] += np.round(sums).astype(np.int64)
            self.seen += int(round(sums.sum()))
            err, curve = _slopes(z, t, times)
            for g, cut in gates:
                grad[g] = x[:, cut] @ err[cut]
                self.curves[g] += (x[:, cut] * curve[cut]) @ x[:, cut].T
        self.weights += np.linalg.solve(self.curves, grad[:, :, None])[:, :, 0].astype(np.float32)

    def _correct(self, inputs: Iterable[tuple], cells: np.ndarray, n: np.ndarray) -> None:
        rests = np.zeros(len(self.correction))
        for depth, at, bit, x in inputs:
            z = mixed(x, self.weights[depth * 8 : depth * 8 + 8])
            cell = (cells[at] + level_of(z)).astype(np.intp)
            z += self.correction.take(cell)
            err, curve = _slopes(z, bit.astype(np.float32), n[at])
            rests += np.bincount(cell, err, len(rests))
            self.cell_curves += np.bincount(cell, curve, len(rests))
            bits = np.bincount(cell, n[at], len(rests)).astype(np.int64)
            self.cell_bits += bits
            self.seen += int(bits.sum())
        self.correction += (rests / self.cell_curves).astype(np.float32)


def mixed(x: Sequence[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Log odds added up by the weights of the gates of one depth."""
    seen = gate_of(0, x).astype(np.intp)
    z = np.zeros(len(seen), np.float32)
    for m in range(N_CONTEXTS):
        part = np.ascontiguousarray(weights[:, m]).take(seen)
        part *= x[m]
        z += part
    return z


def _slopes(z: np.ndarray, t: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the cost of bits t at log odds z, as often as they occur."""
    p = 1 / (1 + np.exp(-np.clip(z, -12, 12)))
    err = t - p
    curve = (p * (1 - p) + err * err) * (times * np.float32(0.5))
    err *= times
    return err, curve


def fit_mixer(counts: np.ndarray, texts: list[bytes], code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of one share, and corrections in a second round over its texts."""
    _, back = log_odds()
    mixer = Mixer()
    for _ in range(2):
        mixer = Mixer(mixer.weights) if mixer.steps else mixer
        if texts:
            mixer.learn(counts, texts, code, length, back)
    return mixer.weights, mixer.correction


def place_bits(odds: np.ndarray, weights: np.ndarray, correction: np.ndarray, window: np.ndarray, word: np.ndarray, code: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bits that the model spends on the byte of each place. `odds` holds the log odds of every slot in fourteenths."""
    prev, ctx = context_hashes(window, word)
    # one over the probability of the byte, at most 2 ** (18 * MAX_DEPTH); one logarithm a place
    cost = np.ones(len(window))
    cells = prev.astype(np.int32) * LEVELS
    for depth, at, node, bit in bit_levels(window.astype(np.uint8), prev, code, length):
        z = mixed([odds[m].take(slots(ctx[m], at, node), mode="wrap") for m in range(N_CONTEXTS)], weights[depth * 8 : depth * 8 + 8] * np.float32(1 / 14))
        z += correction.take(level_of(z) + cells[at])
        np.clip(z, -12, 12, out=z)
        z *= np.float32(1) - np.float32(2) * bit.astype(np.float32)
        np.exp(z, out=z)
        cost[at] *= z.astype(np.float64) + 1
    return np.log2(cost)


def text_bits(odds: np.ndarray, weights: np.ndarray, correction: np.ndarray, texts: list[bytes], code: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bits that the model spends on each text; equal places of all texts are scored once."""
    parts = []
    for rows in W.blocks(((t,) for t in texts), 0):
        data, first = byte_stream([r[0] for r in rows])
        window, word = windows(data, first), word_states(data)
        order, start = runs_of(window, word)
        one = order[start]
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(first)).take(order)
        parts.append((window[one], word[one], doc, np.diff(start, append=len(order)), len(rows)))
    window, word = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order, start = runs_of(window, word)
    one = order[start]
    window, word = window.take(one), word.take(one)
    near = longest_first(window, length)
    found = np.empty(len(one))
    for lo in range(0, len(one), PIECE_BYTES):
        cut = near[lo : lo + PIECE_BYTES]
        found[cut] = place_bits(odds, weights, correction, window.take(cut), word.take(cut), code, length)
    cost = np.empty(len(order))
    cost[order] = np.repeat(found, np.diff(start, append=len(order)))
    out, at = [], 0
    for w, _, doc, n, m in parts:
        # a text's places are added in the order of their hash, whatever stands beside it
        out.append(np.bincount(doc, np.repeat(cost[at : at + len(w)], n), m))
        at += len(w)
    return np.concatenate(out)


# ---- over a corpus


def _training(docs: DataFrame, parts: int, part: int) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == part
    return docs.select("doc_id", held.alias("held_out"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))


def pair_counts(train: DataFrame) -> tuple[np.ndarray, int]:
    """Counts of (byte before, byte) over all texts, and their size in bytes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(65536, np.int64)
        for rows in W.blocks(W.arrow_rows(batches, "_text"), 0):
            data, first = byte_stream([r[0] for r in rows])
            total += np.bincount(before(data, first, 1).astype(np.int64) << 8 | data, minlength=65536)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    rows = train.select("_text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(65536, np.int64)
    for r in rows:
        out[r["pair"]] = r["n"]
    return out.reshape(256, 256), int(out.sum())


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of unsigned 32-bit numbers, compressed."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def place_rows(train: DataFrame) -> DataFrame:
    """The places of all texts in rows of a few (window, word, n: packed numbers), different ones within a task's PLACES."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for window, word, n in places([r[0] for r in rows] for rows in W.blocks(W.arrow_rows(batches, "_text"), 0)):
            for lo in range(0, len(window), 1 << 16):
                cut = slice(lo, lo + (1 << 16))
                planes = np.ascontiguousarray(window[cut].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].T)
                row = (zlib.compress(planes.tobytes(), 1), word[cut].astype("<u4").tobytes(), _pack(n[cut]))
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["window", "word", "n"])

    return train.select("_text").mapInArrow(run, "window binary, word binary, n binary")


def _places(batches: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the rows of place_rows(), or of texts."""
    for b in batches:
        if b.num_columns == 1:
            yield from places([r[0] for r in rows] for rows in W.blocks(W.arrow_rows([b], "_text"), 0))
            continue
        for window, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            planes = np.frombuffer(zlib.decompress(window), np.uint8).reshape(7, -1)
            wide = np.zeros((planes.shape[1], 8), np.uint8)
            wide[:, :7] = planes.T
            yield wide.view("<u8").ravel(), np.frombuffer(word, "<u4"), _unpack(n)


def _place_source(train: DataFrame, tasks: int) -> DataFrame:
    # fewer tasks than files would give, as each sends a table; no shuffle
    return train.select("_text" if "_text" in train.columns else "*").coalesce(tasks)


def bit_tables(train: DataFrame, code: np.ndarray, length: np.ndarray, tasks: int) -> np.ndarray:
    """Shrunk counts (zeros << 8 | ones) of every slot of every predictor, over all training texts (_text, or their place_rows).

    About `tasks` tasks count their share in whole tables and send what is not zero, in parts of 2 ** PART_BITS
    slots; parts are added FAN_IN at a time. The result has a fixed size.
    """
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast((code, length))
    per = 1 << (SLOT_BITS - PART_BITS)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        code, length = shared.value
        tables = np.zeros((N_CONTEXTS, 2 << SLOT_BITS), np.uint32)
        for found in _places(batches):
            count_places(tables, *found, code, length)
        task = TaskContext.get().partitionId()
        wide = tables.reshape(N_CONTEXTS * per, 2 << PART_BITS)
        for lo in range(0, len(wide), 16):
            out = []
            for k in range(lo, min(lo + 16, len(wide))):
                at = np.flatnonzero(wide[k])
                if len(at):
                    out.append((k, task, _pack(np.diff(at, prepend=0)), _pack(wide[k][at])))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], names=["part", "task", "at", "n"])

    def add(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        total = np.zeros(2 << PART_BITS, np.uint64)
        for at, n in zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True):
            total[np.cumsum(_unpack(at)).astype(np.int64)] += _unpack(n)
        at = np.flatnonzero(total)
        n = np.minimum(total[at], 0xFFFFFFFF)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "task": pa.array([table.column("task")[0].as_py() // FAN_IN], pa.int32()), "at": pa.array([_pack(np.diff(at, prepend=0))], pa.binary()), "n": pa.array([_pack(n)], pa.binary())})

    schema = "part int, task int, at binary, n binary"
    parts = _place_source(train, tasks).mapInArrow(run, schema)
    while True:
        parts = parts.groupBy("part", F.floor(F.col("task") / FAN_IN)).applyInArrow(add, schema)
        if tasks <= FAN_IN:
            break
        tasks = -(-tasks // FAN_IN)

    def final(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for at, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                total = np.zeros(2 << PART_BITS, np.uint64)
                total[np.cumsum(_unpack(at)).astype(np.int64)] = _unpack(n)
                s = shrink(total).astype(np.uint16)
                out.append(zlib.compress((s[0::2] << 8 | s[1::2]).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["part", "codes"])

    counts = np.zeros((N_CONTEXTS * per, 1 << PART_BITS), np.uint16)
    for r in parts.mapInArrow(final, "part int, codes binary").toLocalIterator():
        counts[r["part"]] = np.frombuffer(zlib.decompress(r["codes"]), np.uint16)
    return counts.reshape(N_CONTEXTS, 1 << SLOT_BITS)


def fit_shares(train: DataFrame, counts: np.ndarray, code: np.ndarray, length: np.ndarray, tasks: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights from all training texts (_text, or their place_rows) in one round, and corrections in a second one.

    In a round each of about `tasks` tasks runs a mixer over its share, in the second one with the weights of the first. A weight row or
    a correction of the result is the mean over tasks, by the bits that each learned it from; the sums are Spark's.
    """
    spark = train.sparkSession
    source = _place_source(train, tasks)
    shared = spark.sparkContext.broadcast((counts, code, length))
    n_weights = GATES * N_CONTEXTS

    def round_from(weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            counts, code, length = shared.value
            _, back = log_odds()
            mixer = Mixer(weights)
            for found in _places(batches):
                mixer.learn_places(counts, *found, code, length, back)
            bits = np.concatenate([np.repeat(mixer.gate_bits, N_CONTEXTS), mixer.cell_bits])
            learned = np.concatenate([mixer.weights.ravel(), mixer.correction]).astype(np.float64)
            at = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits[at]), pa.array(np.round(learned[at] * UNIT).astype(np.int64))], names=["k", "bits", "units"])

        first = Mixer(weights)
        out = np.concatenate([first.weights.ravel(), first.correction])
        parts = source.mapInArrow(run, "k int, bits long, units long")
        # one row for each weight and correction, whatever the input
        total = F.sum(F.col("units").cast("decimal(38,0)") * F.col("bits").cast("decimal(20,0)")).cast("double")
        for r in parts.groupBy("k").agg((total / F.sum("bits") / UNIT).alias("v")).collect():
            out[r["k"]] = r["v"]
        return out[:n_weights].reshape(GATES, N_CONTEXTS), out[n_weights:]

    weights, _ = round_from(None)
    result = round_from(weights)
    shared.destroy()
    return result


def _words_of(texts: list[bytes]) -> W.Words:
    return W.split(texts, lower=True)


def score_texts(docs: DataFrame, parts: int = 7, part: int = 2, task_bytes: int = 96 << 20, chunk_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Texts are lower-cased (A-Z). Held-out documents, crc32(doc_id) mod `parts` = `part`, teach neither the
    token counts nor the model. score is the log10 probability of the text's bytes and its end; bits_per_byte
    is the same over the text's bytes.

    Null texts are empty: one token, the end. A null id counts as an empty one for the split. Repeated rows
    are scored, and learned from, each. Without training texts the tables are empty and scores come from the code
    trees' even odds. An empty table gives no rows; other columns are ignored.

    Token counts: every chunk of about `chunk_bytes` sends its distinct words once, in ranges of their hash;
    the sums go back to the chunks that asked, so a frequent word costs one row a chunk.
    """
    spark = docs.sparkSession
    source = _training(docs, parts, part)
    train = source.where("not held_out")
    pairs, size = pair_counts(train)
    code, length = code_trees(pairs)
    found = cut_lineage(place_rows(train))
    counts = bit_tables(found, code, length, max(1, -(-size // task_bytes)))
    weights, correction = fit_shares(found, counts, code, length, max(1, -(-size // SHARE_BYTES)))
    plain, _ = log_odds()
    fourteenths = np.round(plain * 14).astype(np.int8)
    odds = np.stack([fourteenths[c] for c in counts])
    del counts
    shared = spark.sparkContext.broadcast((odds, weights, correction, code, length))
    ranges = 1 << max(2, int(np.ceil(np.log2(max(1, size / (24 << 20))))))
    shift = np.uint64(64 - int(np.log2(ranges)))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        odds, weights, correction, code, length = shared.value
        task, number = TaskContext.get().partitionId(), 0
        id_type = None

        def checked(batches: Iterator) -> Iterator:
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field(0).type
                yield b

        for chunk in W.blocks(W.arrow_rows(checked(batches), "doc_id", "held_out", "_text"), 2, chunk_bytes):
            bits, at, seen, n = [], [], [], []
            docs_before = 0
            for rows in W.blocks(iter(chunk), 2, SCORE_BYTES):
                bits.append(text_bits(odds, weights, correction, [r[2] for r in rows], code, length))
            for rows in W.blocks(iter(chunk), 2):
                w = _words_of([r[2] for r in rows])
                # distinct words of each text with their counts
                order = np.lexsort((w.hash, w.doc))
                d, h = w.doc[order], w.hash[order]
                edge = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.empty(0, np.int64)
                at.append(d[edge] + docs_before)
                seen.append(h[edge])
                n.append(np.diff(np.concatenate([edge, [len(h)]])))
                docs_before += len(rows)
            at, seen, n = np.concatenate(at), np.concatenate(seen), np.concatenate(n)
            held = np.array([r[1] for r in chunk], bool)
            words, place = np.unique(seen, return_inverse=True)
            taught = np.bincount(place, np.where(held[at], 0, n), minlength=len(words)).astype(np.int64)
            name = task << 20 | number
            number += 1
            cut = np.searchsorted(words >> shift, np.arange(ranges + 1, dtype=np.uint64))
            asks = [(r, words[cut[r] : cut[r + 1]].tobytes(), _pack(taught[cut[r] : cut[r + 1]])) for r in range(ranges) if cut[r] < cut[r + 1]]
            per_doc = np.bincount(at, minlength=len(chunk))
            k = len(asks)
            null = [None] * k
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (k + 1), pa.int64()),
                    pa.array([a[0] for a in asks] + [-1], pa.int32()),
                    pa.array([a[1] for a in asks] + [_pack(place)], pa.binary()),
                    pa.array([a[2] for a in asks] + [_pack(n)], pa.binary()),
                    pa.array([*null, [r[0] for r in chunk]], pa.list_(id_type)),
                    pa.array([*null, held.tolist()], pa.list_(pa.bool_())),
                    pa.array([*null, per_doc.tolist()], pa.list_(pa.int64())),
                    pa.array([*null, np.concatenate(bits).tolist()], pa.list_(pa.float64())),
                    pa.array([*null, [len(r[2]) for r in chunk]], pa.list_(pa.int64())),
                ],
                names=["chunk", "r", "a", "b", "ids", "held", "pairs", "bits", "bytes"],
            )

    chunks = cut_lineage(source.mapInArrow(run, f"chunk long, r int, a binary, b binary, ids array<{kind}>, held array<boolean>, pairs array<long>, bits array<double>, bytes array<long>"))

    def total(table):  # noqa: ANN001, ANN202
        import pyarrow as pa

        words = [np.frombuffer(x, np.uint64) for x in table.column("a").to_pylist()]
        mine = [_unpack(x) for x in table.column("b").to_pylist()]
        known, place = np.unique(np.concatenate(words), return_inverse=True)
        sums = np.bincount(place, np.concatenate(mine), minlength=len(known)).astype(np.int64)
        ends = np.cumsum([0] + [len(w) for w in words])
        back = [_pack(sums[place[ends[k] : ends[k + 1]]]) for k in range(len(words))]
        m = len(words)
        return pa.table(
            {
                "chunk": table.column("chunk").combine_chunks(),
                "r": table.column("r").combine_chunks(),
                "c": pa.array(back, pa.binary()),
                "n_all": pa.array([int(sums.sum())] + [0] * (m - 1), pa.int64()),
                "n_words": pa.array([int((sums > 0).sum())] + [0] * (m - 1), pa.int64()),
            }
        )

    answers = cut_lineage(chunks.where("r >= 0").groupBy("r").applyInArrow(total, "chunk long, r int, c binary, n_all long, n_words long"))
    got = answers.agg(F.coalesce(F.sum("n_all"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    taught = chunks.where("r < 0").agg(F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0))).first()[0]
    n_all, v_all = got[0] + taught, got[1] + (1 if taught else 0)

    def join(left, right):  # noqa: ANN001, ANN202
        import pyarrow as pa

        order = np.argsort(right.column("r").to_numpy()) if right.num_rows else []
        packed = right.column("c").to_pylist()
        c = np.concatenate([_unpack(packed[k]) for k in order]) if len(order) else np.empty(0, np.uint32)
        row = {k: left.column(k)[0].as_py() for k in ("a", "b", "held", "pairs", "bits", "bytes")}
        place, n = _unpack(row["a"]).astype(np.int64), _unpack(row["b"]).astype(np.int64)
        doc = np.repeat(np.arange(len(row["held"])), row["pairs"])
        hits = c[place].astype(np.int64)
        m = len(row["held"])
        floor = np.log10(n_all + v_all + 1.0)
        tokens = np.bincount(doc, n, minlength=m).astype(np.int64) + 1
        known = np.bincount(doc, np.where(hits > 0, n, 0), minlength=m).astype(np.int64) + (1 if taught else 0)
        base = np.bincount(doc, n * np.log10(hits + 1.0), minlength=m) + np.log10(taught + 1.0) - tokens * floor
        bits, size = np.array(row["bits"]), np.array(row["bytes"])
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table(
            {
                "doc_id": ids,
                "held_out": pa.array(row["held"], pa.bool_()),
                "n_tokens": pa.array(tokens),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(m, n_all), pa.int64()),
                "base_score": pa.array(base),
                "score": pa.array(-bits * np.log10(2.0)),
                "bits_per_byte": pa.array(bits / np.maximum(size, 1)),
            }
        )

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return chunks.where("r < 0").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(join, schema)
