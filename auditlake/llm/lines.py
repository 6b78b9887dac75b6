"""Operator 5: fuzzy line deduplication.

Lines are normalised to their words. Each distinct line has MinHash values of its character runs, banded into keys;
lines that share a key and whose sketches (two bits of each value) agree enough are candidates. Candidates are verified
by edit similarity, and of every connected group of lines the first occurrence in the corpus stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.buckets import RESULT, Union, cells, dealt, groups, pairs_and_cells, result
from auditlake.llm.common import WORD_BYTES, connected_components, mix64, parallelism, read_table, stored, words_of

MIN_WORDS = 5  # shorter lines stay as they are
EDIT_SIMILARITY = 0.9
#: Runs of five characters; of similar lines 0.45 to 1 are common, of others few. Recall measured: see the README.
GRAM = 5
BANDS, VALUES = 20, 5
HASHES = BANDS * VALUES
KEY_BYTES = 5
FAMILIES = 4  # hashes of a run; each deals its bins
#: Sketches of candidates differ in at most so many of HASHES values, as many as at 0.41 in common on average.
APART = 44
WORDS = -(-HASHES // 32)  # longs of a sketch
PAIRS = 0x5555555555555555  # the low bit of each two
#: Lines up to which their places are broadcast (some 60 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 200_000
LINES_A_TASK = 50_000
SEEN_LINES = 500_000  # digests a task remembers


#: As words are read, with line ends kept.
LINE_BYTES = bytes(b if b == 10 else w for b, w in enumerate(WORD_BYTES))


def split_lines(text: str | None) -> list[str]:
    return [] if text is None else text.split("\n")


_rng = np.random.default_rng(7)
FAMILY_ODDS = _rng.integers(0, 1 << 63, FAMILIES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _rng.integers(0, 1 << 63, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALT = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
#: Where an empty bin looks for a value, one try after the other: the same bins for every line.
TRIES = np.stack([_rng.permutation(HASHES) for _ in range(24)])
EMPTY = 0xFFFFFFFF


def signatures(norms: list[str]) -> np.ndarray:
    """HASHES MinHash values of each line's runs of GRAM characters; a shorter line is filled up with zeros.

    One-permutation hashing: each of FAMILIES hashes deals the runs to HASHES / FAMILIES bins, of which each keeps its
    least; an empty bin takes another's value, found in the same order for every line.
    """
    filled = [n if len(n) >= GRAM else n.ljust(GRAM, "\0") for n in norms]
    chars = np.frombuffer("".join(filled).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    total = np.zeros(len(chars) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        total += chars[i : len(total) + i] * PLACES[i]
    size = np.array([len(n) for n in filled])
    line = np.repeat(np.arange(len(filled)), size)
    inside = np.ones(len(chars), bool)  # a run that would cross into the next line is none
    for i in range(1, GRAM):
        inside[np.cumsum(size) - i] = False
    runs, line = mix64(total)[inside[: len(total)]], line[: len(total)][inside[: len(total)]].astype(np.uint64)
    bins, out = np.uint64(HASHES // FAMILIES), np.full(len(norms) * HASHES, EMPTY, np.uint32)
    base = line * np.uint64(HASHES)
    for f in range(FAMILIES):
        h = runs * FAMILY_ODDS[f]
        slot = ((h >> np.uint64(32)) * bins >> np.uint64(32)) * np.uint64(FAMILIES) + base
        np.minimum.at(out, slot.view(np.int64) + f, h.astype(np.uint32))
    out = out.reshape(-1, HASHES)
    first = out.copy()
    for step in TRIES:
        r, c = np.nonzero(out == EMPTY)
        if not len(r):
            break
        out[r, c] = first[r, step[c]]
    r, c = np.nonzero(out == EMPTY)
    out[r, c] = first.min(axis=1)[r]
    return out


def keys_of(sig: np.ndarray) -> np.ndarray:
    """The BANDS keys of each signature, of KEY_BYTES bytes."""
    key, values = np.tile(SALT, (len(sig), 1)), sig.reshape(-1, BANDS, VALUES)
    for i in range(VALUES):
        key = mix64(key * np.uint64(31) + values[:, :, i])
    return key >> np.uint64(64 - 8 * KEY_BYTES)


def narrow_keys(keys: np.ndarray) -> list[bytes]:
    """Each row's keys without their empty upper bytes."""
    cut = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(len(keys), BANDS, 8)[:, :, :KEY_BYTES])
    return [x.tobytes() for x in cut]


def wide_keys(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").reshape(-1)


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each value of each signature, in WORDS longs."""
    two = np.zeros((len(sig), 32 * WORDS), np.uint64)
    two[:, :HASHES] = (sig >> np.uint32(15)) & np.uint32(3)
    return (two.reshape(-1, WORDS, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many values sketches differ."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(PAIRS)).sum(axis=-1, dtype=np.int64)


def line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text_h, line, digest, bands, sketch, chars) of every line with MIN_WORDS words or more; what follows from the
    digest only where a task meets it first, by a bounded memory of those met."""
    seen: set[bytes] = set()
    for b in batches:
        at, lines, digests, new, norms = [], [], [], [], []
        for r, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
            for i, line in enumerate((t or b"").translate(LINE_BYTES).split(b"\n")):
                if len(w := line.split()) >= MIN_WORDS:
                    norm = b" ".join(w)
                    digest = hashlib.blake2b(norm, digest_size=16).digest()
                    if digest not in seen:
                        seen.add(digest)
                        new.append(len(at))
                        norms.append(norm.decode("utf-8", "replace"))
                    at.append(r)
                    lines.append(i)
                    digests.append(digest)
        if len(seen) > SEEN_LINES:
            seen.clear()
        bands: list[bytes | None] = [None] * len(at)
        marks, chars = bands.copy(), bands.copy()
        for i in range(0, len(norms), 120):
            sig = signatures(norms[i : i + 120])
            for x, k, m, n in zip(new[i : i + 120], narrow_keys(keys_of(sig)), sketches(sig), norms[i : i + 120]):
                bands[x], marks[x], chars[x] = k, m.tobytes(), len(n)
        where = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("key").take(where), b.column("text_h").take(where), pa.array(lines, pa.int32()), pa.array(digests, pa.binary()),
             pa.array(bands, pa.binary()), pa.array(marks, pa.binary()), pa.array(chars, pa.int32())],
            ["key", "text_h", "line", "digest", "bands", "sketch", "chars"],
        )


def planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, first all lowest ones: numbers that are near each other then compress well."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplaned(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def packed_entries(parts: int):
    """(part, members, keys): band keys dealt to parts, each part's of some 100,000 lines in one row: sorted keys as
    differences, and the members they belong to."""

    def dealt_out(members: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        own = np.concatenate(members)
        low = np.uint64(64 - 8 * KEY_BYTES)  # bits left for a line's number
        both = np.concatenate(keys) << low | np.repeat(np.arange(len(own), dtype=np.uint64), BANDS)
        both.sort()
        rest, member = both >> low, own[(both & ((np.uint64(1) << low) - np.uint64(1))).view(np.int64)]
        part = ((rest >> np.uint64(8)) * np.uint64(parts) >> np.uint64(8 * KEY_BYTES - 8)).astype(np.int64)  # ranges of keys
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        ends = [*cut[1:].tolist(), len(part)]
        made = [[planes(x[i:j]) for i, j in zip(cut.tolist(), ends)] for x in (member, np.diff(rest, prepend=np.uint64(0)))]
        first = [int(x) for x in rest[cut]]
        return pa.RecordBatch.from_arrays(
            [pa.array(part[cut], pa.int32()), pa.array(first, pa.int64()), pa.array(made[0], pa.binary()), pa.array(made[1], pa.binary())], ["part", "first", "members", "keys"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        for b in batches:
            if b.num_rows:
                members.append(b.column("member").to_numpy(zero_copy_only=False))
                keys.append(wide_keys(b"".join(b.column("bands").to_pylist())))
                if sum(map(len, members)) >= 100_000:
                    yield dealt_out(members, keys)
                    members, keys = [], []
        if members:
            yield dealt_out(members, keys)

    return run


def repeated_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, member) of a part's keys that more than one member has, the part's number in the bucket's upper bits."""
    held: dict[int, tuple[list, list]] = {}
    for b in batches:
        for part, first, m, k in zip(*(b.column(c).to_pylist() for c in ("part", "first", "members", "keys"))):
            members, keys = held.setdefault(part, ([], []))
            members.append(unplaned(m, "<i8"))
            steps = unplaned(k, "<u8").copy()
            steps[0] = first
            keys.append(np.cumsum(steps, dtype=np.uint64))
    while held:
        part, (m, k) = held.popitem()
        members, keys = np.concatenate(m), np.concatenate(k)
        m.clear()
        k.clear()
        order = np.argsort(keys, kind="stable")  # runs that are sorted already
        members, keys = members[order], keys[order]
        again = np.zeros(len(keys), bool)
        again[1:] = keys[1:] == keys[:-1]
        again[:-1] |= again[1:].copy()
        members, keys = members[again], keys[again]
        order = np.lexsort((members, keys))
        members, keys = members[order], keys[order]
        once = np.ones(len(keys), bool)  # tasks that met the same line give the same entries
        once[1:] = (keys[1:] != keys[:-1]) | (members[1:] != members[:-1])
        members, keys = members[once], keys[once]
        again = np.zeros(len(keys), bool)
        again[1:] = keys[1:] == keys[:-1]
        again[:-1] |= again[1:].copy()
        bucket = mix64(keys[again] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part))
        yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(members[again])], ["bucket", "member"])


def sketched(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, WORDS)


def close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b) with their sketches those that agree enough."""
    for b in batches:
        fits = differing(sketched(b.column("sketch_a").to_pylist()), sketched(b.column("sketch_b").to_pylist())) <= APART
        yield b.select(["a", "b"]).filter(pa.array(fits))


def close_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the pairs whose sketches agree enough and whose lengths allow EDIT_SIMILARITY."""
    for bounds, across, columns in runs(batches):
        size, own, member = (columns[c].to_numpy() for c in ("chars", "own", "member"))
        sketch = sketched(columns["sketch"].to_pylist())
        count = np.diff(bounds)
        met = []
        for m in np.unique(count).tolist():  # cells of one size together
            cell = np.flatnonzero(count == m)
            step = max(1, 50_000 // (m * m))
            for i in range(0, len(cell), step):
                at = cell[i : i + step]
                if m > 200:
                    here = slice(bounds[at[0]], bounds[at[0]] + m)
                    x, y, _ = near_pairs(sketch[here], size[here], own[here] if across[at[0]] else None)
                    met.append((x + bounds[at[0]], y + bounds[at[0]]))
                    continue
                x, y = (np.add.outer(bounds[at], z).reshape(-1) for z in np.triu_indices(m, 1))
                fits = np.minimum(size[x], size[y]) >= EDIT_SIMILARITY * np.maximum(size[x], size[y]) - 1e-6
                fits &= ~np.repeat(across[at], m * (m - 1) // 2) | (own[x] != own[y])
                x, y = x[fits], y[fits]
                fits = differing(sketch[x], sketch[y]) <= APART
                met.append((x[fits], y[fits]))
        a, b = (np.concatenate(c) for c in zip(*met)) if met else (np.zeros(0, np.int64),) * 2
        union = Union(len(member))
        new = np.array([union.join(x, y) for x, y in zip(a.tolist(), b.tolist())], bool)
        a, b = member[a[new]], member[b[new]]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]]:
    """Whole cells of sorted batches: the bounds of their rows, whether a cell lies across two blocks, and the columns."""
    held: pa.Table | None = None

    def cut(table: pa.Table, last: bool):
        keys = [table.column(c).to_numpy() for c in ("bucket", "i", "j")]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        bounds = np.append(np.flatnonzero(new), table.num_rows)
        bounds = bounds if last else bounds[:-1]
        first = bounds[:-1]
        columns = {c: table.column(c).slice(0, int(bounds[-1])).combine_chunks() for c in table.column_names}
        return (bounds, keys[1][first] != keys[2][first], columns), table.slice(int(bounds[-1]))

    for b in batches:
        if b.num_rows:
            table = pa.Table.from_batches([b])
            held = pa.concat_tables([held, table]) if held is not None else table
            out, held = cut(held, False)
            if len(out[0]) > 1:
                yield out
    if held is not None and held.num_rows:
        yield cut(held, True)[0]


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors (Myers 1999, Hyyrö 2003): a column of the table in one integer."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = mask, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise = (down | ~(diagonal | up)) & mask
        fall = up & diagonal
        score += bool(rise & top) - bool(fall & top)
        rise = (rise << 1 | 1) & mask
        up = ((fall << 1) & mask) | (~(diagonal | rise) & mask)
        down = rise & diagonal
    return score


def band_distance(a: str, b: str, most: int) -> int:
    """``edit_distance`` where that is ``most`` or less, else no less: as ``band_distances``, the band in one integer."""
    a, b = sorted((a, b), key=len)
    apart = len(b) - len(a)
    before = apart + (most - apart) // 2
    places: dict[str, bytearray] = {}
    for i, c in enumerate(a, before):
        if c not in places:
            places[c] = bytearray((len(a) + before) // 8 + 1)
        places[c][i >> 3] |= 1 << (i & 7)
    where = {c: int.from_bytes(x, "little") for c, x in places.items()}
    mask, end, met = (1 << most + 1) - 1, before - apart, 0
    up, down = mask >> before << before, 0
    for i, c in enumerate(b):
        x = (where.get(c, 0) >> i) & mask
        diagonal = ((((x & up) + up) ^ up) | x | down) & mask
        met += (diagonal >> end) & 1
        rise, fall = down | (mask ^ (diagonal | up)), diagonal & up
        diagonal >>= 1
        up, down = fall | (mask ^ (diagonal | rise)), diagonal & rise
    return len(b) - met


def similar(a: str, b: str) -> bool:
    most = (1 - EDIT_SIMILARITY) * max(len(a), len(b)) + 1e-9
    if abs(len(a) - len(b)) > most:
        return False
    start = len(commonprefix([a, b]))
    a, b = a[start:], b[start:]
    end = len(commonprefix([a[::-1], b[::-1]]))
    return band_distance(a[: len(a) - end], b[: len(b) - end], int(most)) <= most


BAND_WORDS = 8  # machine words of a band; pairs that need more are compared one by one
FEW_LANES = 10  # pairs up to which one by one is faster
LANES = 512  # pairs compared side by side
HELD_CHARS, HELD_PAIRS = 4_000_000, 200_000  # of cells whose pairs are compared together
FORESTS = 3  # comparisons along spanning forests before all that is left is compared


def matches(windows: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Bits of where each character of ``text`` (lanes x columns) equals those of its window of the other line, as words."""
    lanes, columns, width = windows.shape
    out = np.empty((lanes, columns, width // 64), np.uint64)
    step = max(1, (1 << 21) // (columns * width))
    for at in range(0, lanes, step):
        same = windows[at : at + step] == text[at : at + step, :, None]
        out[at : at + step] = np.packbits(same.reshape(-1), bitorder="little").view("<u8").reshape(-1, columns, width // 64)
    return np.ascontiguousarray(out.transpose(1, 2, 0))


def band_distances(pairs: list[tuple[np.ndarray, np.ndarray]], bounds: np.ndarray, words: int) -> np.ndarray:
    """Edit distances of pairs (the shorter line first), side by side; sharp where they are within ``bounds``, else no less.

    An alignment within k edits of lines whose lengths differ by d stays on k + 1 diagonals at most: (k - d) / 2 to either
    side of those between both ends. Bit vectors hold these alone (Hyyrö 2003), one row further with every column; a
    diagonal keeps its bit, so the distance is counted along the one that ends in the last cell.
    """
    short, long = (np.array([len(p[i]) for p in pairs]) for i in (0, 1))
    apart = long - short
    before = apart + (bounds - apart) // 2  # diagonals from the window's first to that of the first cells
    lanes, columns, width = len(pairs), int(long.max()), 64 * words
    kind = pairs[0][0].dtype
    top = np.iinfo(kind).max  # no character
    rows, text = np.full((lanes, columns + width), top, kind), np.full((lanes, columns), top, kind)
    for r, ((a, b), at) in enumerate(zip(pairs, before.tolist())):
        rows[r, at : at + len(a)] = a
        text[r, : len(b)] = b
    eq = matches(np.lib.stride_tricks.sliding_window_view(rows, width, axis=1)[:, :columns], text)
    ended = np.arange(columns)[:, None] >= long
    row = np.arange(width).reshape(words, 64, 1) >= before
    one = np.uint64(1)
    up = np.where(row, one << np.arange(64, dtype=np.uint64)[None, :, None], np.uint64(0)).sum(axis=1, dtype=np.uint64)
    down, at = np.zeros_like(up), (before - apart).astype(np.uint64)
    held, shift, met = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63), np.zeros(lanes, np.uint64)
    lane = np.arange(lanes)
    first_end = int(long.min())
    for c in range(columns):
        x = eq[c]
        if c >= first_end:
            x = np.where(ended[c], ~np.uint64(0), x)  # past the last column all match
        diagonal = x & up
        if words == 1:
            diagonal += up
        else:
            carry = np.zeros(lanes, np.uint64)
            for w in range(words):
                low = diagonal[w] + up[w]
                over = low < up[w]
                diagonal[w] = low + carry
                carry = (over | (diagonal[w] < low)).astype(np.uint64)
        diagonal ^= up
        diagonal |= x
        diagonal |= down
        met += ((diagonal[0] if words == 1 else diagonal[held, lane]) >> shift) & one
        rise = diagonal | up
        np.invert(rise, out=rise)
        rise |= down
        fall = diagonal & up
        diagonal, kept = diagonal >> one, diagonal
        if words > 1:
            diagonal[:-1] |= kept[1:] << np.uint64(63)
        up = diagonal | rise
        np.invert(up, out=up)
        up |= fall
        down = diagonal & rise
    return columns - met.astype(np.int64)


def similar_pairs(lines: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``similar`` of the lines at ``a`` and ``b``, many at once."""
    size = np.array(list(map(len, lines)))
    swap = size[a] > size[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    bounds = np.floor((1 - EDIT_SIMILARITY) * size[b] + 1e-9).astype(np.int64)
    out = size[b] - size[a] <= bounds
    words = bounds // 64 + 1  # of bounds + 1 diagonals
    words[~out] = 0
    fits, out = out, np.zeros(len(out), bool)
    codes: dict[int, np.ndarray] = {}
    used = np.unique(np.concatenate([a[fits], b[fits]]))
    for i in used.tolist():
        codes[i] = np.frombuffer(lines[i].encode("utf-32-le", "surrogatepass"), "<u4")
    most = max((int(c.max()) for c in codes.values() if len(c)), default=0)
    kind = np.uint8 if most < 255 else np.uint16 if most < 65535 else np.uint32
    codes = {i: c.astype(kind) for i, c in codes.items()}
    #: With few words first, which give no less than the distance: most similar lines are far nearer than they need be.
    for n in range(1, int(words.max(initial=0)) + 1):
        at = np.flatnonzero((words == n) | (words > 1) & (size[b] - size[a] < 64) if n == 1 else (words == n) & ~out)
        at = at[np.argsort(size[b[at]], kind="stable")]
        for i in range(0, len(at), LANES):
            here = at[i : i + LANES]
            if n > 1 and (n > BAND_WORDS or len(here) <= FEW_LANES * n) or len(here) <= FEW_LANES and (words[here] == 1).all():
                out[here] = [similar(lines[x], lines[y]) for x, y in zip(a[here].tolist(), b[here].tolist())]
            else:
                pairs = [(codes[x], codes[y]) for x, y in zip(a[here].tolist(), b[here].tolist())]
                out[here] = band_distances(pairs, np.minimum(bounds[here], 64 * n - 1), n) <= bounds[here]
    return out


def near_pairs(sketch: np.ndarray, size: np.ndarray, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (x, y) of the lines whose sketches and lengths allow EDIT_SIMILARITY, and in how many values they differ; given
    ``own``, only of lines of different blocks."""
    met = []
    step = max(1, 20_000 // len(size))
    for start in range(0, len(size) - 1, step):
        x, y = np.nonzero(np.arange(start, min(start + step, len(size)))[:, None] < np.arange(len(size)))
        x += start
        if own is not None:
            across = own[x] != own[y]
            x, y = x[across], y[across]
        edits = (1 - EDIT_SIMILARITY) * np.maximum(size[x], size[y]) + 1e-6
        near = np.abs(size[x] - size[y]) <= edits
        x, y = x[near], y[near]
        apart = differing(sketch[x], sketch[y])
        near = apart <= APART
        met.append((x[near], y[near], apart[near]))
    return tuple(np.concatenate(c) for c in zip(*met)) if met else (np.zeros(0, np.int64),) * 3


def links(lines: list[str], a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges of the pairs that have EDIT_SIMILARITY. The nearest are compared first, along spanning forests: what
    they connect needs no comparison."""
    union, out = Union(len(lines)), []
    order = np.argsort(apart, kind="stable")
    a, b = a[order], b[order]
    forests = 0
    while len(a):
        if forests < FORESTS:
            tried = Union(len(lines))
            tried.up = union.up.copy()
            chosen = np.array([tried.join(x, y) for x, y in zip(a.tolist(), b.tolist())])
        else:
            chosen = np.arange(len(a)) < HELD_PAIRS
        forests += 1
        passed = similar_pairs(lines, a[chosen], b[chosen])
        out += [(x, y) for x, y in zip(a[chosen][passed].tolist(), b[chosen][passed].tolist()) if union.join(x, y)]
        a, b = a[~chosen], b[~chosen]
        apart_still = np.array([union.root(x) != union.root(y) for x, y in zip(a.tolist(), b.tolist())], bool)
        a, b = a[apart_still], b[apart_still]
    return out


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of each cell's pairs whose sketches agree and that have EDIT_SIMILARITY; many cells are worked on together."""
    lines: list[str] = []
    members: list[int] = []
    met: list[tuple[np.ndarray, ...]] = []
    chars = pairs = 0

    def flushed() -> pa.RecordBatch:
        a, b, apart = (np.concatenate(c) for c in zip(*met))
        return result([(1, members[x], members[y], 0) for x, y in links(lines, a, b, apart)])

    for (_, i, j), g in groups(batches):
        size = np.array(list(map(len, g["norm"])))
        x, y, apart = near_pairs(sketched(g["sketch"]), size, np.array(g["own"]) if i != j else None)
        met.append((x + len(lines), y + len(lines), apart))
        lines += g["norm"]
        members += g["member"]
        chars, pairs = chars + int(size.sum()), pairs + len(x)
        if chars > HELD_CHARS or pairs > HELD_PAIRS:
            yield flushed()
            lines, members, met, chars, pairs = [], [], [], 0, 0
    if met:
        yield flushed()


def norm_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(member, norm) of the wanted lines of each text."""
    for b in batches:
        members, norms = [], []
        for t, wanted in zip(b.column("text").to_pylist(), b.column("wanted").to_pylist()):
            lines = split_lines(t)
            for w in wanted:
                members.append(w["member"])
                norms.append(b" ".join(words_of(lines[w["line"]])).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.int64()), pa.array(norms, pa.string())], ["member", "norm"])


def dropped_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(dkey, dh, gone): the numbers of the lines that go, for each key and text hash that loses any."""
    kind = dict(docs.dtypes)[key]
    d = docs.select(docs[key].alias("key"), docs[text].alias("text")).withColumn("text_h", F.xxhash64("text"))
    rows = stored(d.mapInArrow(line_rows, f"key {kind}, text_h long, line int, digest binary, bands binary, sketch binary, chars int"))
    place = F.struct("key", "text_h", "line")
    lines = stored(rows.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).withColumn("member", F.xxhash64("digest")))
    marked = rows.where("bands is not null").withColumn("member", F.xxhash64("digest"))
    parts = max(parallelism(docs.sparkSession), -(-lines.count() // LINES_A_TASK))
    packed = marked.select("member", "bands").mapInArrow(packed_entries(parts), "part int, first long, members binary, keys binary")
    again = stored(packed.repartitionById(parts, F.col("part")).mapInArrow(repeated_entries, "bucket long, member long"))
    marks = marked.select("member", "sketch", "chars").join(again.select("member").distinct(), "member", "left_semi")
    marks = stored(marks.dropDuplicates(["member"]))  # lines of one member, rare as they are, are all compared below
    two, more = pairs_and_cells(again)
    left, right = (marks.select(F.col("member").alias(m), F.col("sketch").alias(f"sketch_{m}"), F.col("chars").alias(f"chars_{m}")) for m in "ab")
    two = two.join(left, "a").join(right, "b").where(F.least("chars_a", "chars_b") >= EDIT_SIMILARITY * F.greatest("chars_a", "chars_b") - 1e-6)
    two = two.select("a", "b", "sketch_a", "sketch_b").mapInArrow(close_pairs, "a long, b long")
    near = stored(dealt(more.join(marks, "member")).mapInArrow(close_lines, "a long, b long").unionByName(two))
    candidates = connected_components(None, near).select(F.col("component").alias("bucket"), F.col("node").alias("member"))
    wanted = candidates.join(marks.select("member", "sketch"), "member").join(lines, "member").drop("member", "n")
    wanted = stored(wanted.select("bucket", "sketch", "digest", "first.*").withColumn("member", F.monotonically_increasing_id()))
    by_doc = wanted.groupBy(F.col("key").alias("wkey"), F.col("text_h").alias("wh")).agg(F.collect_list(F.struct("member", "line")).alias("wanted"))
    by_doc = F.broadcast(by_doc) if wanted.count() <= BROADCAST_ROWS else by_doc
    texts = d.join(by_doc, d["key"].eqNullSafe(by_doc["wkey"]) & (d["text_h"] == by_doc["wh"])).select("text", "wanted")
    norms = texts.mapInArrow(norm_lines, "member long, norm string").dropDuplicates(["member"])
    full = cells(wanted.select("bucket", "member"), 256).join(norms, "member").join(wanted.select("member", "sketch"), "member")
    found = stored(dealt(full).mapInArrow(verified, RESULT)).select("a", "b")
    parts = connected_components(None, found)
    named = wanted.select("digest", "member").join(parts, F.col("member") == F.col("node")).select("digest", "component")
    info = stored(lines.join(named, "digest", "left").where("n > 1 or component is not null").select("digest", "first", "component"))
    first = stored(info.where("component is not null").groupBy("component").agg(F.min("first").alias("stays")))
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    again = info.join(first, "component", "left").select("digest", F.coalesce("stays", "first").alias("stays"))
    gone = rows.select("key", "text_h", "line", "digest").join(again, "digest").where(~place.eqNullSafe(F.col("stays")))
    return stored(gone.groupBy(F.col("key").alias("dkey"), F.col("text_h").alias("dh")).agg(F.array_sort(F.collect_set("line")).alias("gone")))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with ``text`` lacking lines that occur before, and the counts
    ``_n_lines``, ``_n_removed`` and ``_n_worded`` (lines with a word that are left; null where none went).

    Order of occurrence: key (null first), text hash, line number. Lines of fewer than MIN_WORDS words never go. Null
    texts stay null and have no lines; an empty text is one short line. Rows equal in key and text are one document
    and lose the same lines. Columns of ``docs`` keep their names; the three counts replace columns so named.
    """
    gone = dropped_lines(docs, key, text)
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("key"), F.xxhash64(docs[text]).alias("text_h"))
    d = d.join(gone, d["key"].eqNullSafe(gone["dkey"]) & (d["text_h"] == gone["dh"]), "left")
    line = F.split(F.col("row")[text], "\n", -1)
    left = F.filter(line, lambda _, i: ~F.array_contains("gone", i))
    d = d.withColumn("left", F.when(F.col("gone").isNotNull(), left))
    # By the same word class as lines are normalised by
    worded = F.filter("left", lambda x: x.rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    counts = {
        "_n_lines": F.coalesce(F.size(line), F.lit(0)),
        "_n_removed": F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0),
        "_n_worded": F.when(F.col("gone").isNotNull(), F.size(worded)),
    }
    kept = F.when(F.col("gone").isNotNull(), F.array_join("left", "\n")).otherwise(F.col("row")[text])
    columns = [kept.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns if c not in counts]
    return d.select(*columns, *(v.alias(c) for c, v in counts.items()))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with repeated lines taken out: doc_id, n_lines, n_removed and the text that is left."""
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.greatest("_n_lines", F.lit(0)).cast("long").alias("n_lines"), F.greatest("_n_removed", F.lit(0)).cast("long").alias("n_removed"), "text")
