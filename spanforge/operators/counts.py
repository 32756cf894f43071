"""Exact dense search over feature counts.

Vectors of a feature-hashing embedder are integers before they are normalised, so a cosine is an
integer product divided by two norms. Products of counts up to 127 are taken in eight bits where
onnxruntime is installed (its kernels use the processor's matrix instructions), else in floats;
both are exact. A task holds all queries of a block as one matrix and streams its chunks past them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from spanforge.functions.worker import worker_cache
from spanforge.operators.topk import TopK

QUERIES, ROWS = 4_096, 4_096  # queries that share a running best k and large ones multiplied at a time; chunks embedded at a time
TILE, COLUMNS = 512, 512  # queries and chunks multiplied at a time, so that products stay in a core's cache
SLACK = 4e-6  # by which scores in single precision may miss the rounded ones
NEAR = 127
WIDE = 1.1  # ratio of norms beyond which chunks multiplied together have no common bound


def slot_bytes(dim: int) -> str:
    return "<u2" if dim <= 1 << 15 else "<u4"


def encode(embed, texts: list[str]) -> list[bytes]:
    """The feature slots of each text as bytes."""
    slots, ends = embed.slots_many(texts)
    whole, width = slots.astype(slot_bytes(embed.dim)).tobytes(), np.dtype(slot_bytes(embed.dim)).itemsize
    return [whole[lo:hi] for lo, hi in zip((ends[:-1] * width).tolist(), (ends[1:] * width).tolist())]


def decode(parts: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What encode was given, as slots_many has it."""
    kind = np.dtype(slot_bytes(dim))
    return np.frombuffer(b"".join(parts), kind), np.concatenate([[0], np.cumsum([len(x) // kind.itemsize for x in parts])]).astype(np.int64)


def count_matrix(slots: np.ndarray, ends: np.ndarray, dim: int) -> np.ndarray:
    """Signed counts (rows, dim) of feature slots, which are hashes modulo 2 * dim."""
    n = len(ends) - 1
    out = np.zeros((n, dim), np.int32)
    for lo in range(0, n, 256):
        size = np.diff(ends[lo : lo + 257])
        flat = slots[ends[lo] : ends[lo + len(size)]] + np.repeat(np.arange(len(size)) * 2 * dim, size)
        both = np.bincount(flat, minlength=len(size) * 2 * dim).reshape(len(size), 2, dim)
        out[lo : lo + 256] = both[:, 0] - both[:, 1]
    return out


def norms(counts: np.ndarray) -> np.ndarray:
    wide = counts.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", wide, wide))


def _message(number: int, content: bytes | str | int) -> bytes:
    """One field of a protocol buffer."""

    def digits(x):
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    if isinstance(content, int):
        return digits(number << 3) + digits(content)
    content = content.encode() if isinstance(content, str) else content
    return digits(number << 3 | 2) + digits(len(content)) + content


def _product_model(b: np.ndarray) -> bytes:
    """c = (a - 128) b for a (uint8) and this b (int8), which the library packs once; c is int32."""

    def value(name, kind, dims):
        shape = b"".join(_message(1, _message(2, d)) for d in dims)
        return _message(1, name) + _message(2, _message(1, _message(1, kind) + _message(2, shape)))

    held = b"".join(_message(1, d) for d in b.shape) + _message(2, 3) + _message(8, "b") + _message(9, b.tobytes())
    zero = _message(2, 2) + _message(8, "z") + _message(9, bytes([128]))
    node = b"".join(_message(1, x) for x in "abz") + _message(2, "c") + _message(4, "MatMulInteger")
    graph = _message(1, node) + _message(2, "product") + _message(5, held) + _message(5, zero) + _message(11, value("a", 2, "mk")) + _message(12, value("c", 6, "mn"))
    return _message(1, 8) + _message(8, _message(2, 13)) + _message(7, graph)


def eight_bit_product() -> Callable | None:
    """b (int8) -> (a (uint8) -> a - 128 times b, until the next call); None without the library or where its kernels saturate."""
    try:
        import onnxruntime as ort
    except ImportError:
        return None
    options = ort.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.graph_optimization_level = ort.GraphOptimizationLevel.ORT_DISABLE_ALL

    def by(b):
        session = ort.InferenceSession(_product_model(b), options, providers=["CPUExecutionProvider"])
        binding, held = session.io_binding(), {}

        def run(a):
            if len(a) not in held:
                held[len(a)] = np.empty((len(a), b.shape[1]), np.int32)
            out = held[len(a)]
            binding.bind_input("a", "cpu", 0, np.uint8, a.shape, a.ctypes.data)
            binding.bind_output("c", "cpu", 0, np.int32, out.shape, out.ctypes.data)
            session.run_with_iobinding(binding)
            return out

        return run

    a = np.full((64, 256), 255, np.uint8)
    a[::2] = 1
    b = np.full((256, 64), NEAR, np.int8)
    b[:, ::2] = -NEAR
    return by if (by(b)(a) == (a.astype(np.int64) - 128) @ b.astype(np.int64)).all() else None


def multiplier() -> Callable:
    """b -> (a -> a - 128 times b, as int32 or as floats that hold integers, valid until the next call); made once a worker."""

    def by_floats(b):
        b = b.astype(np.float32)
        most = np.einsum("ij,ij->j", b, b).max(initial=0)

        def run(a):
            # no partial sum exceeds the product of the norms, and integers below 2^24 are exact in single precision
            a = a.astype(np.float32) - 128
            if np.sqrt(np.einsum("ij,ij->i", a, a).max() * most) > 1 << 23:
                return a.astype(np.float64) @ b.astype(np.float64)
            return a @ b

        return run

    return worker_cache("product of counts", lambda: eight_bit_product() or by_floats)


def product() -> Callable:
    """(a, b) -> a - 128 times b."""
    return lambda a, b: multiplier()(b)(a)


class Asked:
    """The distinct queries of a block: blocks of up to QUERIES with their best k; queries with large counts apart."""

    def __init__(self, slots: list[bytes], dim: int, k: int, digits: int):
        kind = slot_bytes(dim)
        seen: dict[bytes, int] = {}
        self.of = np.array([seen.setdefault(np.sort(np.frombuffer(x, kind)).tobytes(), len(seen)) for x in slots], np.int64)
        distinct = list(seen)
        self.n, self.dim, self.k = len(distinct), dim, k
        self.norm = np.zeros(self.n)
        self.small, self.large = [], []  # (places, matrix, best k)
        for lo in range(0, self.n, QUERIES):
            m = count_matrix(*decode(distinct[lo : lo + QUERIES], dim), dim)
            self.norm[lo : lo + QUERIES] = norms(m)
            near = np.abs(m).max(axis=1) <= NEAR
            for rows, group in ((near, self.small), (~near, self.large)):
                if rows.any():
                    part = (m[rows] + 128).astype(np.uint8) if group is self.small else m[rows].astype(np.float64)
                    group.append((lo + np.flatnonzero(rows), part, TopK(int(rows.sum()), k, digits, buffer=50 * QUERIES)))
        self.inverse = 1 / np.where(self.norm == 0, 1, self.norm)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the block, position, score), for every query that shares a distinct one."""
        members = np.argsort(self.of, kind="stable")
        first = np.searchsorted(self.of[members], np.arange(self.n + 1))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for places, _, top in self.small + self.large:
            q, p, s = top.best()
            q = places[q]
            times = first[q + 1] - first[q]
            at = np.repeat(first[q], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            out.append((members[at], np.repeat(p, times), np.repeat(s, times)))
        a, p, s = (np.concatenate(x) for x in zip(*out))
        return a, p, s


def features(slots: list[bytes], dim: int) -> tuple[np.ndarray, ...]:
    """Queries as jvm.search takes them: (distinct query of each, features, first places, middle places, inverse norms)."""
    seen: dict[bytes, int] = {}
    of = np.array([seen.setdefault(np.sort(np.frombuffer(x, slot_bytes(dim))).tobytes(), len(seen)) for x in slots], np.int64)
    distinct, parts, added, size, inverse = list(seen), [], [], [], []
    for lo in range(0, len(distinct), QUERIES):
        m = count_matrix(*decode(distinct[lo : lo + QUERIES], dim), dim)
        row, at = np.nonzero(m)
        order = np.lexsort((m[row, at] < 0, row))
        row, at = row[order], at[order]
        times = np.abs(m[row, at])
        parts.append(np.repeat(at, times).astype(np.uint16))
        size.append(np.bincount(row, times, len(m)))
        added.append(np.bincount(row, times * (m[row, at] > 0), len(m)))
        norm = norms(m)
        inverse.append(1 / np.where(norm == 0, 1, norm))
    first = np.append(0, np.cumsum(np.concatenate([np.zeros(0), *size]))).astype(np.int64)
    return of, np.concatenate([np.zeros(0, np.uint16), *parts]), first, first[:-1] + np.concatenate([np.zeros(0), *added]).astype(np.int64), np.concatenate([np.zeros(0), *inverse])


def push_all(asked: Asked, counts: np.ndarray, positions: np.ndarray) -> None:
    """Every query meets every chunk of counts (rows, dim)."""
    by, size = multiplier(), norms(counts)
    inverse = 1 / np.where(size == 0, 1, size)
    near = np.abs(counts).max(axis=1, initial=0) <= NEAR
    rows = np.flatnonzero(near)
    rows = rows[np.argsort(inverse[rows], kind="stable")]  # chunks multiplied together are of like norms
    reached = np.empty(TILE * COLUMNS, bool)
    for r in (rows[lo : lo + COLUMNS] for lo in range(0, len(rows), COLUMNS)):
        times = by(np.ascontiguousarray(counts[r].astype(np.int8).T))
        for places, matrix, top in asked.small:
            for lo in range(0, len(matrix), TILE):
                _push(top, lo, times(matrix[lo : lo + TILE]), asked.inverse[places[lo : lo + TILE]], inverse[r], positions[r], reached)
    far = np.flatnonzero(~near)
    if len(far):
        for places, matrix, top in asked.small:
            _push(top, 0, (matrix.astype(np.float64) - 128) @ counts[far].T.astype(np.float64), asked.inverse[places], inverse[far], positions[far])
    for places, matrix, top in asked.large:
        for lo in range(0, len(counts), COLUMNS):
            _push(top, 0, matrix @ counts[lo : lo + COLUMNS].T.astype(np.float64), asked.inverse[places], inverse[lo : lo + COLUMNS], positions[lo : lo + COLUMNS])


def _push(top: TopK, first: int, dots: np.ndarray, q_inverse: np.ndarray, inverse: np.ndarray, positions: np.ndarray, reached: np.ndarray | None = None) -> None:
    """dots: integer products (queries from ``first``, chunks). Candidates reach the least product that could be among the best, and are scored in double precision."""
    k, n = top.k, len(positions)
    floor = top.floor[first : first + len(dots)]
    if n > k and np.isneginf(floor).any():
        kth = np.full(len(top.floor), -np.inf)
        kth[first : first + len(dots)] = np.partition(dots * inverse, n - k, axis=1)[:, n - k] * q_inverse - SLACK
        top.raise_floor(kth)
    bound = (floor - SLACK) / q_inverse
    if inverse.max() > WIDE * inverse.min():  # short chunks: one integer bound would let most pairs through
        with np.errstate(invalid="ignore"):
            at = np.flatnonzero(dots * inverse.astype(np.float32) >= bound.astype(np.float32)[:, None])
    else:
        least = np.where(bound > 0, bound / inverse.max(), bound / inverse.min())
        kind = np.iinfo(np.int32)
        least = np.clip(np.ceil(least - 1e-6), kind.min, kind.max)
        out = None if reached is None else reached[: dots.size].reshape(dots.shape)
        at = np.flatnonzero(np.greater_equal(dots, least.astype(dots.dtype)[:, None], out=out))
    if len(at):
        r, c = np.divmod(at, n)
        top.push_found(first + r, positions[c], dots.ravel()[at].astype(np.float64) * (q_inverse[r] * inverse[c]))


def searcher(shared, embed, k: int, digits: int, stored: bool):
    """Arrow batches (chunk_pos, text or encoded slots) -> the task's best k of each query of shared (ids, slots)."""

    def run(batches):
        ids, slots = shared.value
        asked = Asked(slots, embed.dim, k, digits)
        for batch in batches:
            pos = batch.column(0).to_numpy()
            for lo in range(0, len(pos), ROWS):
                part = batch.column(1).slice(lo, ROWS).to_pylist()
                of = decode(part, embed.dim) if stored else embed.slots_many(part)
                push_all(asked, count_matrix(*of, embed.dim), pos[lo : lo + ROWS])
        a, p, s = asked.best()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), pa.array(p, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "chunk_pos", "score"])

    return run


def _bucket_codes(counts: np.ndarray, planes: np.ndarray, probes: int) -> np.ndarray:
    """(tables, rows, probes): the buckets of each row, its own first, then those across the nearest planes."""
    size = norms(counts)[:, None]
    v = counts / np.where(size == 0, 1, size)
    bits = planes.shape[1]
    out = np.zeros((len(planes), len(v), min(probes, bits + 1)), np.int64)
    for t, plane in enumerate(planes):
        side = v @ plane.T
        code = ((side > 0) << np.arange(bits)).sum(axis=1)
        near = np.argsort(np.abs(side), axis=1)
        for p in range(out.shape[2]):
            out[t, :, p] = code if p == 0 else code ^ (1 << near[:, p - 1])
    return out


def lsh_searcher(shared, embed, k: int, digits: int, planes: np.ndarray, probes: int, stored: bool):
    """searcher over the pairs that share a bucket of some table: a batch's buckets are multiplied one by one."""

    def run(batches):
        ids, slots = shared.value
        q = count_matrix(*decode(slots, embed.dim), embed.dim).astype(np.float64)
        q_size = norms(q)
        q_inverse = 1 / np.where(q_size == 0, 1, q_size)
        codes = _bucket_codes(q, planes, probes)
        sorted_of = []
        for c in codes:
            order = np.argsort(c.ravel(), kind="stable")
            sorted_of.append((c.ravel()[order], order // c.shape[1]))
        top = TopK(len(q), k, digits)
        for batch in batches:
            pos = batch.column(0).to_numpy()
            for lo in range(0, len(pos), 2 * ROWS):
                part = batch.column(1).slice(lo, 2 * ROWS).to_pylist()
                v = count_matrix(*(decode(part, embed.dim) if stored else embed.slots_many(part)), embed.dim).astype(np.float64)
                size = norms(v)
                own = _bucket_codes(v, planes, 1)[:, :, 0]
                _push_buckets(top, q, q_inverse, codes, sorted_of, v, 1 / np.where(size == 0, 1, size), own, pos[lo : lo + 2 * ROWS])
        a, p, s = top.best()
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), pa.array(p, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "chunk_pos", "score"])

    return run


def _push_buckets(top: TopK, q: np.ndarray, q_inverse: np.ndarray, codes: np.ndarray, sorted_of: list, v: np.ndarray, inverse: np.ndarray, own: np.ndarray, positions: np.ndarray) -> None:
    for t, (q_codes, q_rows) in enumerate(sorted_of):
        order = np.argsort(own[t], kind="stable")
        cuts = np.flatnonzero(np.diff(own[t][order], prepend=own[t][order[0]] - 1)) if len(order) else []
        found, held = [], 0
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            code = own[t][order[lo]]
            asked = q_rows[np.searchsorted(q_codes, code) : np.searchsorted(q_codes, code, "right")]
            chunks = order[lo:hi]
            for at in range(0, len(asked), QUERIES):
                a = asked[at : at + QUERIES]
                scores = (q[a] @ v[chunks].T) * (q_inverse[a][:, None] * inverse[chunks])
                r, c = np.nonzero(scores >= (top.floor[a] - SLACK)[:, None])
                a, c, s = a[r], chunks[c], scores[r, c]
                met = np.zeros(len(a), bool)  # in an earlier table
                for u in range(t):
                    met |= (codes[u][a] == own[u][c][:, None]).any(axis=1)
                found.append((a[~met], positions[c[~met]], s[~met]))
                held += len(found[-1][0])
                if held > top.buffer:
                    top.push_found(*(np.concatenate(x) for x in zip(*found)))
                    found, held = [], 0
        if found:
            top.push_found(*(np.concatenate(x) for x in zip(*found)))
