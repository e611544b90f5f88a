"""FLAC in vectorised numpy: many frames are coded, checked and decoded in step with each other.

The encoder writes mono 8-bit streams: per frame a constant, verbatim, fixed- or linear-predictor subframe, whichever is
smallest, with Rice-coded residuals. Frames are handled in groups, which bounds the memory that a long stream needs. The decoder reads constant, verbatim, fixed and linear-predictor subframes, both Rice codings
with partitions and escapes, wasted bits, and up to eight channels with stereo decorrelation, and verifies the CRC of every
header and frame and the MD5 of the samples.
"""

from __future__ import annotations

import hashlib

import numpy as np

BLOCK = 256
RATE = 8000

# Fixed values of the format.
FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}
BLOCK_SIZES = [0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768]
SAMPLE_BITS = [0, 8, 12, 0, 16, 20, 24, 32]
CRC8_POLYNOMIAL, CRC16_POLYNOMIAL = 0x07, 0x8005


class FlacError(ValueError):
    pass


def _table(polynomial: int, width: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        out = ((out << 1) ^ np.where(out >> (width - 1) & 1, polynomial, 0).astype(np.uint32)) & ((1 << width) - 1)
    return out


CRC8, CRC16 = _table(CRC8_POLYNOMIAL, 8), _table(CRC16_POLYNOMIAL, 16)
_ZEROS16 = np.array([16, *(16 - int(x).bit_length() for x in range(1, 1 << 16))], dtype=np.int64)


def _crc(data: np.ndarray, start: np.ndarray, length: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """CRC of data[start:start + length] for all starts in step."""
    order = np.argsort(-length, kind="stable")
    at, size = start[order], length[order]
    crc = np.zeros(len(at), dtype=np.uint32)
    active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    keep = np.uint32((1 << width) - 1)
    for i, n in enumerate(active):
        c = crc[:n]
        crc[:n] = ((c << np.uint32(8)) & keep) ^ table[(c >> np.uint32(width - 8)) ^ data[at[:n] + i]]
    out = np.zeros_like(crc)
    out[order] = crc
    return out


#: Frames that are coded or decoded at a time.
GROUP = 2048

#: Order, bits of a coefficient and greatest shift of the linear predictors that are written.
LINEAR, PRECISION, SHIFT = 4, 9, 8


def _predicted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients and shift of each frame's linear predictor by its autocorrelation, and what is left of the frame.
    The shift is -1 where the coefficients do not fit."""
    real = x.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", real[:, : x.shape[1] - lag], real[:, lag:]) for lag in range(LINEAR + 1)], axis=1)
    lags = np.abs(np.subtract.outer(np.arange(LINEAR), np.arange(LINEAR)))
    a = np.linalg.solve(r[:, lags] + np.eye(LINEAR) * (1e-6 * r[:, :1, None] + 1e-3), r[:, 1:, None])[:, :, 0]
    top = np.abs(a).max(axis=1)
    shift = np.select([top < 0.99, top < 1.98, top < 3.96], [SHIFT, SHIFT - 1, SHIFT - 2], -1)
    q = np.where(shift[:, None] >= 0, np.rint(a * np.exp2(np.maximum(shift, 0))[:, None]), 0).astype(np.int32)
    guess = np.zeros_like(x)
    for j in range(LINEAR):
        guess[:, j + 1 :] += q[:, j, None] * x[:, : x.shape[1] - 1 - j]
    return q, shift, x - (guess >> np.maximum(shift, 0)[:, None])


def _frames(x: np.ndarray, n: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frames of samples x (a row a frame, n of them, at that number in their streams), end to end, and their sizes."""
    inside = np.arange(BLOCK) < n[:, None]
    best, order, rice, codes = 8 * n + 8, np.full(len(n), -1), np.zeros(len(n), dtype=np.int64), (x & 0xFF)
    linear = np.zeros(len(n), dtype=bool)
    q, shift, left = _predicted(x)
    residual = x
    for o, kind in ((0, "fixed"), (1, "fixed"), (2, "fixed"), (LINEAR, "linear")):
        if kind == "linear":
            residual = left
        elif o:
            residual = np.diff(residual, axis=1, prepend=np.int32(0))
        u = np.where(inside & (np.arange(BLOCK) >= o), (residual << 1) ^ (residual >> 31), 0)
        fits = (n > o) & ((kind == "fixed") | (shift >= 0))
        for k in range(2, 8):
            cost = 18 + 8 * o + (9 + PRECISION * LINEAR) * (kind == "linear") + (n - o) * (k + 1) + (u >> k).sum(axis=1)
            win = (cost < best) & fits
            if win.any():
                best, order, rice, linear = np.where(win, cost, best), np.where(win, o, order), np.where(win, k, rice), np.where(win, kind == "linear", linear)
                codes = np.where(win[:, None], u, codes)
    constant = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(axis=1)
    order, best, linear = np.where(constant, -2, order), np.where(constant, 16, best), linear & ~constant
    coded = order >= 0

    width = np.where(coded, rice + 1, 8)[:, None]
    held = np.where(coded[:, None], (codes & ((1 << rice) - 1)[:, None]) | (1 << rice)[:, None], x & 0xFF)
    skip = np.where(coded[:, None], codes >> rice[:, None], 0)
    warm = np.arange(BLOCK) < np.maximum(order, 0)[:, None]
    held, skip, width = np.where(warm, x & 0xFF, held), np.where(warm, 0, skip), np.where(warm, 8, width)
    used = inside & (~constant[:, None] | (np.arange(BLOCK) == 0))
    length = np.where(used, skip + width, 0)
    length[:, 0] += 8  # the subframe's header
    model = np.where(linear, 9 + PRECISION * LINEAR, 0)  # after the warm-up samples: the predictor,
    extra = np.where(coded, 10, 0) + model  # and the coding's method, partition order and Rice parameter
    end = np.cumsum(length, axis=1) + np.where(warm, 0, extra[:, None])

    long = np.select([number < 0x80, number < 0x800, number < 0x10000, number < 0x200000], [1, 2, 3, 4], 5)
    short = n != BLOCK
    header = 4 + long + short + 1
    body = -(-(end[:, -1]) // 8)
    total = header + body + 2
    start = np.cumsum(total) - total
    out = np.zeros(int(total.sum()) + 8, dtype=np.uint8)
    out[start], out[start + 1], out[start + 2], out[start + 3] = 0xFF, 0xF8, np.where(short, 6, 8) << 4 | 4, 0x02
    out[start + 4] = np.select([long == 1, long == 2, long == 3, long == 4], [number, 0xC0 | number >> 6, 0xE0 | number >> 12, 0xF0 | number >> 18], 0xF8 | number >> 24)
    for j in range(1, 5):
        f = np.flatnonzero(long > j)
        out[start[f] + 4 + j] = 0x80 | (number[f] >> (6 * (long[f] - 1 - j))) & 0x3F
    out[(start + header - 2)[short]] = (n - 1)[short]
    out[start + header - 1] = _crc(out, start, header - 1, CRC8, 8)

    first = (start + header) * 8
    out[start + header] = np.select([constant, linear, coded], [0, 32 + LINEAR - 1, 8 + np.maximum(order, 0)], 1) << 1
    param, lin = np.flatnonzero(coded), np.flatnonzero(linear)
    at = first[lin] + 8 + 8 * LINEAR
    pieces = [((first[:, None] + end - width)[used], held[used], width[used]), (first[param] + 14 + 8 * order[param] + model[param], rice[param], 4), (at, (PRECISION - 1) << 5 | shift[lin], 9)]
    pieces += [(at + 9 + PRECISION * j, q[lin, j] & ((1 << PRECISION) - 1), PRECISION) for j in range(LINEAR)]
    place = np.concatenate([p for p, _, _ in pieces])
    value = np.concatenate([v.astype(np.int64) << (16 - w) for _, v, w in pieces]) >> (place & 7)  # at most 9 bits, moved by at most 7
    byte = place >> 3
    add = np.bincount(byte, value >> 8, minlength=len(out)) + np.bincount(byte + 1, value & 0xFF, minlength=len(out))
    out += add.astype(np.uint8)
    check = _crc(out, start, total - 2, CRC16, 16)
    out[start + total - 2], out[start + total - 1] = check >> 8, check & 0xFF
    return out[: int(total.sum())], total


def encode(raw: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Each row of bytes (not empty) as a FLAC stream of unsigned 8-bit samples."""
    size = np.diff(bounds)
    per = -(-size // BLOCK)
    row = np.repeat(np.arange(len(size)), per)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    n = np.minimum(size[row] - number * BLOCK, BLOCK)
    at = bounds[:-1][row] + number * BLOCK
    parts, totals = [], [np.zeros(0, dtype=np.int64)]
    for a in range(0, len(row), GROUP):
        some = slice(a, a + GROUP)
        places = np.minimum(at[some, None] + np.arange(BLOCK), len(raw) - 1)
        x = np.where(np.arange(BLOCK) < n[some, None], raw[places].astype(np.int32) - 128, 0)
        out, total = _frames(x, n[some], number[some])
        parts.append(out), totals.append(total)
    out, total = np.concatenate([np.zeros(0, dtype=np.uint8), *parts]), np.concatenate(totals)
    del parts
    stop = np.cumsum(total)
    streams, last = [], np.cumsum(per) - 1
    for i in range(len(size)):
        a, b = last[i] - per[i] + 1, last[i]
        packed = (BLOCK).to_bytes(2) * 2 + int(total[a : b + 1].min()).to_bytes(3) + int(total[a : b + 1].max()).to_bytes(3) + (RATE << 44 | 0 << 41 | 7 << 36 | int(size[i])).to_bytes(8)
        digest = hashlib.md5((raw[bounds[i] : bounds[i + 1]] ^ np.uint8(0x80)).tobytes()).digest()
        streams.append(b"fLaC" + b"\x80\x00\x00\x22" + packed + digest + out[stop[a] - total[a] : stop[b]].tobytes())
    return streams


class _Bits:
    """Reads at many bit places of one buffer at once."""

    def __init__(self, data: np.ndarray):
        wide = np.concatenate([data, np.zeros(16, dtype=np.uint8)]).astype(np.uint64)
        self.words = np.zeros(len(wide) - 8, dtype=np.uint64)
        for j in range(8):
            self.words |= wide[j : len(wide) - 8 + j] << np.uint64(56 - 8 * j)

    def window(self, at: np.ndarray) -> np.ndarray:
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).astype(np.uint64)

    def unsigned(self, at: np.ndarray, bits) -> np.ndarray:
        """Up to 57 bits."""
        bits = np.broadcast_to(np.asarray(bits, dtype=np.int64), at.shape)
        return np.where(bits > 0, (self.window(at) >> (64 - np.maximum(bits, 1)).astype(np.uint64)).astype(np.int64), 0)

    def signed(self, at: np.ndarray, bits) -> np.ndarray:
        x = self.unsigned(at, bits)
        top = np.left_shift(1, np.maximum(np.asarray(bits, dtype=np.int64) - 1, 0))
        return np.where(np.asarray(bits) > 0, (x ^ top) - top, 0)


def _rice(bits: _Bits, pos: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and next places of Rice codes with parameters k."""
    w = bits.window(pos)
    q = _ZEROS16[w >> np.uint64(48)]
    if (q == 16).any():
        far = np.flatnonzero(q == 16)
        while len(far):
            step = _ZEROS16[bits.window(pos[far] + q[far]) >> np.uint64(48)]
            q[far] += step
            if q[far].max() > 1 << 22:
                raise FlacError("a residual does not end")
            far = far[step == 16]
        w = bits.window(pos + q)
        low = (w << np.uint64(1)) >> (63 - k).astype(np.uint64) >> np.uint64(1)
    else:
        low = (w << (q + 1).astype(np.uint64)) >> (63 - k).astype(np.uint64) >> np.uint64(1)
    u = (q << k) | low.astype(np.int64)
    return (u >> 1) ^ -(u & 1), pos + q + 1 + k


def _subframes(bits: _Bits, pos: np.ndarray, n: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (frame, time) of one subframe of each frame, and the places after them."""
    head = bits.unsigned(pos, 8)
    kind, pos = head >> 1 & 63, pos + 8
    if (head & 0x80).any():
        raise FlacError("a subframe's header starts with 1")
    wasted = np.zeros(len(pos), dtype=np.int64)
    if (f := np.flatnonzero(head & 1)).size:
        z = np.zeros(len(f), dtype=np.int64)
        open_ = np.arange(len(f))
        while len(open_):
            step = _ZEROS16[bits.window(pos[f[open_]] + z[open_]) >> np.uint64(48)]
            z[open_] += step
            open_ = open_[step == 16]
        wasted[f] = z + 1
        pos[f] += z + 1
    depth = depth - wasted
    out = np.zeros((len(pos), int(n.max())), dtype=np.int64)
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | linear | (kind <= 1)).all():
        raise FlacError("a subframe's type is reserved")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    if (f := np.flatnonzero(kind == 0)).size:
        out[f] = bits.signed(pos[f], depth[f])[:, None]
        pos[f] += depth[f]
    if (f := np.flatnonzero(kind == 1)).size:
        for t in range(int(n[f].max())):
            g = f[n[f] > t]
            out[g, t] = bits.signed(pos[g], depth[g])
            pos[g] += depth[g]
    if (f := np.flatnonzero(fixed | linear)).size:
        for t in range(int(order[f].max(initial=0))):
            g = f[order[f] > t]
            out[g, t] = bits.signed(pos[g], depth[g])
            pos[g] += depth[g]
        coef = np.zeros((len(pos), 32), dtype=np.int64)
        shift = np.zeros(len(pos), dtype=np.int64)
        for o, c in FIXED.items():
            coef[fixed & (order == o), : len(c)] = c
        if (g := np.flatnonzero(linear)).size:
            precision = bits.unsigned(pos[g], 4) + 1
            shift[g] = bits.signed(pos[g] + 4, 5)
            if (precision == 16).any() or (shift[g] < 0).any():
                raise FlacError("a predictor's precision or shift is not valid")
            pos[g] += 9
            for j in range(int(order[g].max())):
                h = order[g] > j
                coef[g[h], j] = bits.signed(pos[g[h]], precision[h])
                pos[g[h]] += precision[h]
        _residuals(bits, pos, out, f, n, order)
        for o in np.unique(order[f]):
            g = f[order[f] == o]
            if o:
                x, c, s = out[g], coef[g, :o][:, ::-1], shift[g]
                for t in range(int(o), x.shape[1]):
                    x[:, t] += (x[:, t - o : t] * c).sum(axis=1) >> s
                out[g] = x
    return out << wasted[:, None], pos


def _residuals(bits: _Bits, pos: np.ndarray, out: np.ndarray, f: np.ndarray, n: np.ndarray, order: np.ndarray) -> None:
    """Reads the residuals of frames f into out, and moves pos."""
    method = bits.unsigned(pos[f], 2)
    if (method > 1).any():
        raise FlacError("a residual's coding is reserved")
    wide = 4 + method
    each = n[f] >> bits.unsigned(pos[f] + 2, 4)
    by = np.argsort(-n[f], kind="stable")
    f, wide, each = f[by], wide[by], each[by]
    at, size, begin = pos[f] + 6, n[f], order[f]
    k, raw = np.zeros(len(f), dtype=np.int64), np.full(len(f), -1)
    due = begin.copy()
    for t in range(int(begin.min()), int(size[0])):
        m = int(np.searchsorted(-size, -t, side="left"))
        new = np.flatnonzero(due[:m] == t)
        if new.size:
            k[new] = bits.unsigned(at[new], wide[new])
            at[new] += wide[new]
            raw[new] = -1
            if (e := new[k[new] == (1 << wide[new]) - 1]).size:
                raw[e] = bits.unsigned(at[e], 5)
                at[e] += 5
            due[new] = (t // each[new] + 1) * each[new]
        late = begin[:m] > t
        if not late.any() and not (raw[:m] >= 0).any():
            out[f[:m], t], at[:m] = _rice(bits, at[:m], k[:m])
            continue
        g = np.flatnonzero(~late & (raw[:m] < 0))
        out[f[g], t], at[g] = _rice(bits, at[g], k[g])
        g = np.flatnonzero(~late & (raw[:m] >= 0))
        out[f[g], t] = bits.signed(at[g], raw[g])
        at[g] += raw[g]
    pos[f] = at


def _headers(data: np.ndarray, at: np.ndarray):
    """Fields of the frame headers that may start at `at`; `ok` where the check byte holds."""
    get = lambda i: data[np.minimum(at + i, len(data) - 1)].astype(np.int64)
    size, rate, channels, depth = get(2) >> 4, get(2) & 15, get(3) >> 4, get(3) >> 1 & 7
    lead = get(4)
    long = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 0, 2, 3, 4, 5, 6], 7)
    number = np.where(long == 1, lead, lead & (np.left_shift(1, np.maximum(7 - long, 0)) - 1))
    for j in range(1, 7):
        number = np.where(long > j, number << 6 | get(4 + j) & 0x3F, number)
    more = np.select([size == 6, size == 7], [1, 2], 0)
    after = 4 + long
    n = np.select([size == 6, size == 7], [get(after) + 1, (get(after) << 8 | get(after + 1)) + 1], np.array(BLOCK_SIZES)[size])
    length = after + more + np.select([rate == 12, rate == 13, rate == 14], [1, 2, 2], 0)
    ok = (size > 0) & (rate < 15) & (channels < 11) & (get(3) & 1 == 0) & (depth != 3) & (long > 0) & (at + length < len(data))
    check = _crc(data, np.minimum(at, len(data) - 17) if len(data) > 17 else at, np.where(ok, length, 0), CRC8, 8)
    ok &= check == get(length)
    return ok, number, get(1) & 1, n, channels, np.array(SAMPLE_BITS)[depth], length + 1


def sample_bytes(stream: bytes) -> int:
    """Bytes of a sample of all channels in what decode() gives for a stream, whose first block is the required STREAMINFO."""
    packed = int.from_bytes(stream[18:26])
    return ((packed >> 41 & 7) + 1) * -(-((packed >> 36 & 31) + 1) // 8)


def decode(streams: list[bytes]) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """For each FLAC stream its PCM bytes (as in WAV: 8-bit unsigned, else little-endian signed; channels interleaved), each
    frame's first sample and its place in the stream. Raises FlacError where a check fails."""
    data = np.frombuffer(b"".join(streams) + bytes(32), dtype=np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    infos, first = [], []
    for i, s in enumerate(streams):
        if s[:4] != b"fLaC":
            raise FlacError("not a FLAC stream")
        at, last, info = 4, False, None
        while not last:
            last, kind, length = bool(s[at] & 0x80), s[at] & 0x7F, int.from_bytes(s[at + 1 : at + 4])
            if kind == 0:
                info = s[at + 4 : at + 4 + length]
            at += 4 + length
        packed = int.from_bytes(info[10:18])
        infos.append(((packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, info[18:34]))
        first.append(base[i] + at)
    first = np.array(first, dtype=np.int64)
    # Frames: sync codes whose header checks out and whose number follows; the frame's own CRC settles it.
    sync = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] & 0xFE == 0xF8))
    owner = np.searchsorted(base, sync, side="right") - 1
    fine = owner < len(streams)
    sync, owner = sync[fine], owner[fine]
    fine = sync >= first[owner]
    sync, owner = sync[fine], owner[fine]
    ok, number, *_ = _headers(data, sync)
    sync, owner, number = sync[ok], owner[ok], number[ok]
    starts, ends, who = [], [], []
    edge = np.searchsorted(owner, np.arange(len(streams) + 1))
    for i in range(len(streams)):
        own, num = sync[edge[i] : edge[i + 1]], number[edge[i] : edge[i + 1]]
        if not (len(own) and own[0] == first[i] and np.array_equal(num, np.arange(len(num)))):
            own = _chain(data, own, num, first[i], base[i + 1])
        starts.append(own)
        ends.append(np.append(own[1:], base[i + 1])[: len(own)])
        who.append(np.full(len(own), i))
    start, end, who = np.concatenate(starts), np.concatenate(ends), np.concatenate(who)
    who_cut = np.searchsorted(who, np.arange(len(streams) + 1))
    _, _, _, n, channels, depth, length = _headers(data, start)
    channel_bits = np.array([b for _, b, _, _ in infos])[who] if len(who) else np.zeros(0, dtype=np.int64)
    depth = np.where(depth == 0, channel_bits, depth)
    wave: list[list[bytes]] = [[] for _ in streams]
    for a in range(0, len(start), GROUP):
        some = slice(a, a + GROUP)
        low, high = start[some][0], end[some][-1]
        part = np.concatenate([data[low:high], np.zeros(32, dtype=np.uint8)])
        parts = _decoded(part, start[some] - low, end[some] - low, n[some], channels[some], depth[some], length[some], who[some])
        for i in range(who[some][0], who[some][-1] + 1):
            own = slice(max(who_cut[i], a) - a, min(who_cut[i + 1], a + GROUP) - a)
            inside = np.arange(parts[0].shape[1]) < n[some][own, None]
            samples = np.stack([p[own][inside] for p in parts[: infos[i][0]]], axis=1)
            wave[i].append(samples.astype("<i8").reshape(-1, 1).view(np.uint8)[:, : -(-infos[i][1] // 8)].tobytes())
    out = []
    for i, (wide_, deep, total, digest) in enumerate(infos):
        little, a, b = b"".join(wave[i]), who_cut[i], who_cut[i + 1]
        wave[i] = []
        if total and len(little) != total * wide_ * -(-deep // 8):
            raise FlacError(f"stream {i} has {len(little) // (wide_ * -(-deep // 8))} samples of {total}")
        if any(digest) and hashlib.md5(little).digest() != digest:
            raise FlacError(f"the MD5 of stream {i}'s samples is wrong")
        pcm = (np.frombuffer(little, dtype=np.uint8) ^ np.uint8(0x80)).tobytes() if deep == 8 else little
        out.append((pcm, np.cumsum(n[a:b]) - n[a:b], start[a:b] - base[i]))
    return out


def _decoded(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray, channels: np.ndarray, depth: np.ndarray, length: np.ndarray, who: np.ndarray) -> list[np.ndarray]:
    """Samples (frame, time) of each channel of the frames, whose check sums are verified."""
    check = _crc(data, start, end - start - 2, CRC16, 16)
    wrong = check != (data[end - 2].astype(np.uint32) << 8 | data[end - 1])
    if wrong.any():
        raise FlacError(f"the CRC of a frame of stream {who[wrong][0]} is wrong")
    bits, pos = _Bits(data), (start + length) * 8
    count = np.where(channels < 8, channels + 1, 2)
    parts: list[np.ndarray] = []
    for c in range(int(count.max(initial=0))):
        f = np.flatnonzero(count > c)
        side = ((channels == 8) & (c == 1)) | ((channels == 9) & (c == 0)) | ((channels == 10) & (c == 1))
        got, pos[f] = _subframes(bits, pos[f], n[f], (depth + side)[f])
        x = np.zeros((len(n), int(n.max())), dtype=np.int64)
        x[f, : got.shape[1]] = got
        parts.append(x)
    if (-(-pos // 8) + 2 != end).any():
        raise FlacError("a frame does not end where its samples do")
    if len(parts) > 1:
        a, b = parts[0], parts[1]
        mid = (a << 1) | (b & 1)
        is_ = lambda k: (channels == k)[:, None]
        left = np.select([is_(9), is_(10)], [a + b, (mid + b) >> 1], a)
        right = np.select([is_(8), is_(10)], [a - b, (mid - b) >> 1], b)
        parts[:2] = left, right
    return parts


def _chain(data: np.ndarray, at: np.ndarray, number: np.ndarray, first: int, end: int) -> np.ndarray:
    """The frames among places whose headers check out, where some of these are chance: each frame ends at the first
    later place, or the end, where its CRC holds."""
    own, here = [], int(first)
    stops = [*at.tolist(), int(end)]
    while here < end:
        own.append(here)
        later = np.array([s for s in stops if s > here], dtype=np.int64)
        check = _crc(data, np.full(len(later), here), np.maximum(later - here - 2, 0), CRC16, 16)
        good = later[check == (data[later - 2].astype(np.uint32) << 8 | data[later - 1])]
        if not len(good):
            raise FlacError("the CRC of a frame is wrong")
        here = int(good[0])
    return np.array(own, dtype=np.int64)
