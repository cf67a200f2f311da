"""Removal of repeated 50-byte strings by a blockwise, difference-cover sorted
suffix sample.

Texts are UTF-8 bytes in blocks of some ``BLOCK_BYTES`` (dealt by a hash of
the id).  A window is a 50-byte string; it goes if it also starts in a
document with a smaller id.  Suffixes matter to depth 50 only, so:

1. *Long ties.*  Content-defined chunks of windows (a chunk ends where the next
   16 bytes hash into one of ``CHUNK`` equal ranges) with the 49 bytes after them are ranked
   by a 64-bit hash of all and one of both ends.  A chunk that a smaller document has as well goes as a
   whole; ties longer than a chunk are settled here and not sorted again.
2. *Cover sample.*  Of what is left, the positions of a difference cover
   modulo 31 (six residues) are sampled: any two equal windows hold sample
   positions at equal distance within their first 31 bytes, with 20 equal bytes
   after them.  The sample's suffixes are dealt to buckets by these 20 bytes,
   and one bucket at a time is sorted; what stands in one document only drops
   out.
3. *Ranks of the windows.*  The remaining sample positions go, with the 30
   bytes before and the 50 after them, to their bucket again; there the up to
   31 windows through each are sorted, and windows of a smaller document are
   marked.

Every exchange carries packed arrays per (block, bucket), unique inside a
block, so a passage in very many documents sends one entry per block.  Tasks
hold one block or one bucket; blocks and buckets grow in number, not in size.

Cases: null text is empty; texts below 50 bytes keep all bytes; rows of one id
do not remove each other's bytes; a null id neither removes nor is removed; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .hashing import Prefix, mix

WINDOW, GRAM = 50, 20
CHUNK = 128
STEP = 1 << 14
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 20_000_000
#: Fixed value: a perfect difference set modulo 31 (each residue but 0 is a
#: difference of two of its members).
COVER, PERIOD = (1, 5, 11, 24, 25, 27), 31
REACH = PERIOD - 1
CONTEXT = REACH + WINDOW
NO_ID = (1 << 63) - 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _packed(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a).tobytes()
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(b: bytes, dtype) -> np.ndarray:
    n = struct.unpack_from("<q", b)[0]
    return np.frombuffer(pa.decompress(b[8:], n, codec="zstd", asbytes=True), dtype) if n else np.empty(0, dtype)


def _sorted_packed(a: np.ndarray) -> bytes:
    """Sorted uint32: differences, byte by byte (their high bytes compress)."""
    d = np.diff(a, prepend=np.uint32(0)).astype("<u4")
    return _packed(d.view(np.uint8).reshape(-1, 4).T) if len(d) else _packed(d)


def _sorted_unpacked(b: bytes) -> np.ndarray:
    planes = _unpacked(b, np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint64).astype(np.uint32)


class Block:
    """The documents of a block in one buffer, by id."""

    def __init__(self, rows: list[tuple[int | None, int, bytes]]):
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.ids = [r[0] for r in rows]
        self.texts = [r[2] for r in rows]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.raw = b"".join(self.texts) + bytes(WINDOW)
        self.buf = np.frombuffer(self.raw, np.uint8)[:self.offsets[-1]]
        self.key = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        self.doc = np.repeat(np.arange(len(rows), dtype=np.int32), self.lengths)  # of each byte

    def load(self, at) -> np.ndarray:
        """Eight bytes from each position (or from all of a slice) as a number."""
        every = np.ndarray((len(self.raw) - 7,), "<u8", self.raw, 0, (1,))
        return every[at].astype(np.uint64)

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks of windows: first window, end of the windows, pairs of hashes.

        Documents without an id take no part: they have no windows."""
        n = len(self.buf)
        cut = np.empty(n, bool)
        for i in range(0, n, STEP):  # pieces that stay in the processor's cache
            j = min(n, i + STEP)
            x = self.load(slice(i, j))
            y = self.load(slice(i + 8, j + 8))
            x *= np.uint64(0x9E3779B97F4A7C15)
            y *= np.uint64(0xC2B2AE3D27D4EB4F)
            x += y
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            np.less(x, np.uint64((1 << 64) // CHUNK), out=cut[i:j])
        for i, a, b in zip(self.ids, self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            last = b - WINDOW + 1  # end of the windows
            if i is None or last <= a:
                cut[a:b] = False
            else:
                cut[a] = True
                cut[last:b] = False
        a = np.flatnonzero(cut)
        e = np.minimum(np.append(a[1:], n), self.offsets[self.doc[a].astype(np.int64) + 1] - WINDOW + 1)
        to = e + WINDOW - 1
        # Two residues modulo a prime of 31 bits, and the 8 bytes at either end.
        ends = self.load(a) * np.uint64(0xC2B2AE3D27D4EB4F) ^ self.load(to - 8)
        return a, e, np.column_stack([Prefix(self.buf).of(a, to), mix(ends)])

    def whole(self, found: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First window and end of each chunk, and if a smaller document has it."""
        a, e, h = self.chunks()
        gone = np.zeros(len(a), bool)
        doc = self.key[self.doc[a]]
        for b, entries, where in _by_bucket(h, buckets):
            least = _first_ids(where, doc, len(entries))
            if b in found:
                r = _unpacked(found[b], [("i", "<u4"), ("d", "<i8")])
                least[r["i"]] = np.minimum(least[r["i"]], r["d"])
            gone[where[0]] = doc[where[0]] > least[where[1]]
        return a, e, gone

    def sample(self, chunks: tuple) -> np.ndarray:
        """Sample positions (in the buffer) within reach of a window that is left."""
        a, e, gone = chunks
        inside = _covered(a[~gone], e[~gone] + REACH, len(self.buf))
        pattern = np.tile(_IN_COVER, int(self.lengths.max(initial=0)) // PERIOD + 1)
        inside &= np.concatenate([pattern[:n] for n in self.lengths] or [pattern[:0]])
        return np.flatnonzero(inside)


def _covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Of n bytes: is it in one of the ranges [start, end)?"""
    if len(start) < n // 8:
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, start, 1)
        np.subtract.at(change, end, 1)
    else:
        change = (np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)).astype(np.int32)
    return np.cumsum(change, out=change)[:n] > 0


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _by_bucket(h: np.ndarray, buckets: int):
    """Per bucket of hash pairs: the distinct ones in order, and (rows,
    index of each row's entry)."""
    b = _bucket_of(h[:, 0], buckets).astype(np.int64)
    order = np.lexsort((h[:, 1], h[:, 0]))  # the bucket grows with the first half
    for rows in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
        if len(rows):
            x = h[rows]
            new = np.append(True, (x[1:] != x[:-1]).any(axis=1))
            yield int(b[rows[0]]), x[new], (rows, np.cumsum(new) - 1)


def _first_ids(where, doc: np.ndarray, n: int) -> np.ndarray:
    rows, index = where
    return np.minimum.reduceat(doc[rows], np.flatnonzero(np.append(True, np.diff(index) != 0)))


def _grams(block: Block, at: np.ndarray, buckets: int):
    """Per bucket: the sample's distinct 20-byte strings as sorted 32-bit hashes
    (a chance hit only costs a look at its windows), a flag for those of several
    documents here, and (rows, index of each row's entry)."""
    h = block.load(at) * np.uint64(0x9E3779B97F4A7C15)
    h ^= block.load(at + 8) * np.uint64(0xC2B2AE3D27D4EB4F) + (h >> np.uint64(31))
    h = mix(h * np.uint64(0x165667B19E3779F9) + block.load(at + GRAM - 8))
    key = _bucket_of(h, buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
    order = np.argsort(key)
    key = key[order]
    doc = block.key[block.doc[at]][order]
    new = np.append(True, key[1:] != key[:-1])[:len(key)]
    first = np.flatnonzero(new)
    if not len(first):
        return
    several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    index = np.cumsum(new) - 1
    kinds = key[first]
    cuts = np.flatnonzero(np.diff(kinds >> np.uint64(32))) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(kinds)]):
        a, b = first[lo], first[hi] if hi < len(kinds) else len(key)
        yield (int(kinds[lo] >> np.uint64(32)), kinds[lo:hi].astype(np.uint32), several[lo:hi],
               order[a:b], index[a:b] - lo)


def _emit_chunks(block: Block, buckets: int):
    a, _, h = block.chunks()
    doc = block.key[block.doc[a]]
    for b, entries, where in _by_bucket(h, buckets):
        yield b, _packed(np.column_stack([entries, _first_ids(where, doc, len(entries)).view(np.uint64)]))


def _rank_chunks(blobs: list[bytes]) -> list[bytes]:
    """Per block: entries (index, id) that a smaller document of another block has."""
    rows = [_unpacked(b, np.uint64).reshape(-1, 3) for b in blobs]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    index = np.concatenate([np.arange(len(r)) for r in rows])
    x = np.concatenate(rows)
    doc = x[:, 2].view(np.int64)
    order = np.lexsort((x[:, 1], x[:, 0]))
    first = np.flatnonzero(np.append(True, (x[order][1:, :2] != x[order][:-1, :2]).any(axis=1)))
    least = np.empty(len(x), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(x))))
    out = []
    for k in range(len(rows)):
        m = (owner == k) & (least < doc)
        r = np.empty(m.sum(), [("i", "<u4"), ("d", "<i8")])
        r["i"], r["d"] = index[m], least[m]
        out.append(_packed(r))
    return out


def _emit_grams(block: Block, chunks: tuple, buckets: int):
    for b, kinds, several, _, _ in _grams(block, block.sample(chunks), buckets):
        k = _sorted_packed(kinds)
        yield b, struct.pack("<q", len(k)) + k + np.packbits(several).tobytes()


def _sort_grams(blobs: list[bytes]) -> list[bytes]:
    """Sort a bucket of the sample: per block a bit for each of its entries
    that stands in two documents or more."""
    kinds, several = [], []
    for b in blobs:
        n = struct.unpack_from("<q", b)[0]
        kinds.append(_sorted_unpacked(b[8:8 + n]))
        several.append(np.unpackbits(np.frombuffer(b[8 + n:], np.uint8))[:len(kinds[-1])].astype(bool))
    x, s = np.concatenate(kinds), np.concatenate(several)
    order = np.argsort(x, kind="stable")
    same = x[order][1:] == x[order][:-1]
    hit = s[order]
    hit[1:] |= same
    hit[:-1] |= same
    bits = np.empty(len(x), bool)
    bits[order] = hit
    return [np.packbits(p).tobytes() for p in np.split(bits, np.cumsum([len(k) for k in kinds])[:-1])]


def _contexts(block: Block, chunks: tuple, flags: dict[int, bytes], buckets: int):
    """Per bucket: distinct contexts of the repeated sample positions as rows
    (left, right, 80 bytes), smallest id of each, positions, index."""
    at = block.sample(chunks)
    padded = np.concatenate([np.zeros(REACH, np.uint8), block.buf, np.zeros(WINDOW, np.uint8)])
    for b, kinds, _, rows, index in _grams(block, at, buckets):
        hit = np.unpackbits(np.frombuffer(flags[b], np.uint8))[:len(kinds)].astype(bool)[index]
        pos = at[rows[hit]]
        if not len(pos):
            continue
        doc = block.doc[pos].astype(np.int64)
        left = np.minimum(pos - block.offsets[doc], REACH)
        right = np.minimum(block.offsets[doc + 1] - pos, WINDOW)
        c = np.zeros((len(pos), 2 + CONTEXT), np.uint8)
        c[:, 0], c[:, 1] = left, right
        c[:, 2:] = padded[pos[:, None] + np.arange(CONTEXT)]
        k = np.arange(CONTEXT)
        c[:, 2:][(k < (REACH - left)[:, None]) | (k >= (REACH + right)[:, None])] = 0
        whole, inverse = np.unique(c.view(f"V{2 + CONTEXT}").ravel(), return_inverse=True)
        least = np.full(len(whole), NO_ID, np.int64)
        np.minimum.at(least, inverse, block.key[doc])
        yield b, whole, least, pos, inverse


def _emit_contexts(block: Block, chunks: tuple, flags: dict[int, bytes], buckets: int):
    for b, whole, least, _, _ in _contexts(block, chunks, flags, buckets):
        c = _packed(np.frombuffer(whole.tobytes(), np.uint8))
        yield b, struct.pack("<q", len(c)) + c + _packed(least)


def _rank_windows(blobs: list[bytes]) -> list[bytes]:
    """Per block and context a bit for each of the 31 windows through its
    sample position: does a smaller document have it?"""
    contexts, docs = [], []
    for b in blobs:
        n = struct.unpack_from("<q", b)[0]
        contexts.append(_unpacked(b[8:8 + n], np.uint8).reshape(-1, 2 + CONTEXT))
        docs.append(_unpacked(b[8 + n:], np.int64))
    x, doc = np.concatenate(contexts), np.concatenate(docs)
    left, right = x[:, 0].astype(int), x[:, 1].astype(int)
    # Hashes of all windows, some contexts at a time (31 x 8 bytes each).
    hashes = np.empty((REACH + 1, len(x)), np.uint64)
    for i in range(0, len(x), 4096):
        part = np.ascontiguousarray(x[i:i + 4096, 2:])
        h = Prefix(part.ravel())
        base = np.arange(len(part), dtype=np.int64) * CONTEXT
        for k in range(REACH + 1):
            hashes[k, i:i + 4096] = h.of(base + REACH - k, base + REACH - k + WINDOW)
    marks = np.zeros(len(x), np.uint32)
    for k in range(REACH + 1):  # the window that starts k bytes before the position
        ok = np.flatnonzero((left >= k) & (right >= WINDOW - k))
        if len(ok) < 2:
            continue
        w = hashes[k, ok]
        order = np.argsort(w, kind="stable")
        first = np.flatnonzero(np.append(True, w[order][1:] != w[order][:-1]))
        least = np.empty(len(ok), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(doc[ok][order], first), np.diff(np.append(first, len(ok))))
        marks[ok[least < doc[ok]]] |= np.uint32(1 << k)
    return [_packed(p) for p in np.split(marks, np.cumsum([len(d) for d in docs])[:-1])]


def _removed(block: Block, chunks: tuple, flags: dict[int, bytes], marks: dict[int, bytes], buckets: int) -> np.ndarray:
    """Per byte of the buffer: is it removed?"""
    a, e, gone = chunks
    starts, ends = [a[gone]], [e[gone] + WINDOW - 1]
    for b, _, least, pos, inverse in _contexts(block, chunks, flags, buckets):
        m = _unpacked(marks[b], np.uint32)[inverse]
        # In a larger document of this block every window of the context goes.
        doc = block.doc[pos].astype(np.int64)
        m = np.where(block.key[doc] > least[inverse], np.uint32(0xFFFFFFFF), m)
        first, last = block.offsets[doc], block.offsets[doc + 1]
        for k in range(REACH + 1):
            a = pos - k
            starts.append(a[((m >> np.uint32(k)) & np.uint32(1) == 1) & (a >= first) & (a + WINDOW <= last)])
            ends.append(starts[-1] + WINDOW)
    return _covered(np.concatenate(starts), np.concatenate(ends), len(block.buf))


# Kinds of the messages to a block.
CHUNKS, GRAMS, WINDOWS = 0, 1, 2
EXCHANGE = "bucket bigint, block bigint, kind int, blob binary"


def _blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, blob): packed documents, one row per block of an Arrow batch."""
    d = docs.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text", F.lit(6)), F.lit(blocks))).withColumn(
        "_tie", F.xxhash64("text"))

    def run(batches):
        for b in batches:
            parts: dict[int, list[bytes]] = {}
            for block, i, tie, t in zip(*(b.column(c).to_pylist() for c in ("_block", "doc_id", "_tie", "text"))):
                raw = t.encode("utf-8", "surrogatepass") if t else b""
                parts.setdefault(block, []).append(struct.pack("<?qqq", i is not None, i or 0, tie, len(raw)) + raw)
            packed = [_packed(np.frombuffer(b"".join(p), np.uint8)) for p in parts.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array(packed, pa.binary())], ["block", "blob"])
    return d.select("_block", "doc_id", "_tie", "text").mapInArrow(run, "block bigint, blob binary")


def _opened(table: pa.Table) -> Block:
    rows, head = [], struct.calcsize("<?qqq")
    for blob in table.column("blob").to_pylist():
        raw, at = _unpacked(blob, np.uint8).tobytes(), 0
        while at < len(raw):
            known, i, tie, n = struct.unpack_from("<?qqq", raw, at)
            rows.append((i if known else None, tie, raw[at + head:at + head + n]))
            at += head + n
    return Block(rows)


def _told(table: pa.Table, kind: int) -> dict[int, bytes]:
    rows = zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "blob")))
    return {b: blob for k, b, blob in rows if k == kind}


def _as_table(block: int, kind: int, out) -> pa.Table:
    out = list(out)
    return pa.table({"bucket": pa.array([b for b, _ in out], pa.int64()), "block": pa.array([block] * len(out), pa.int64()),
                     "kind": pa.array([kind] * len(out), pa.int32()), "blob": pa.array([x for _, x in out], pa.binary())})


def _answered(messages: DataFrame, work) -> DataFrame:
    """One bucket at a time: the blocks' arrays in, an answer per block out."""
    def run(t):
        t = t.sort_by("block")
        return t.set_column(3, "blob", pa.array(work(t.column("blob").to_pylist()), pa.binary()))
    return messages.groupBy("bucket").applyInArrow(run, EXCHANGE)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) per document;
    spans are the removed byte ranges ``start:end``, comma-joined."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, buckets = max(1, -(-total // BLOCK_BYTES)), max(1, -(-total // BUCKET_BYTES))
    # One exchange of the packed texts, reused by the four passes below.
    blocks = _blocks(d, n_blocks)

    def pass1(key, t):
        return _as_table(key[0].as_py(), CHUNKS, _emit_chunks(_opened(t), buckets))

    def pass2(key, t, told):
        block = _opened(t)
        return _as_table(key[0].as_py(), GRAMS, _emit_grams(block, block.whole(_told(told, CHUNKS), buckets), buckets))

    def pass3(key, t, told):
        block = _opened(t)
        chunks = block.whole(_told(told, CHUNKS), buckets)
        return _as_table(key[0].as_py(), WINDOWS, _emit_contexts(block, chunks, _told(told, GRAMS), buckets))

    def pass4(key, t, told):
        block = _opened(t)
        chunks = block.whole(_told(told, CHUNKS), buckets)
        cut = _removed(block, chunks, _told(told, GRAMS), _told(told, WINDOWS), buckets)
        out = [(i, *_digest(cut[a:b], text)) for i, text, a, b in
               zip(block.ids, block.texts, block.offsets[:-1], block.offsets[1:])]
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
        kinds = (pa.int64(),) * 4 + (pa.string(),) * 2
        return pa.table({n: pa.array([r[j] for r in out], k) for j, (n, k) in enumerate(zip(names, kinds))})

    by = blocks.groupBy("block")
    chunks = _answered(by.applyInArrow(pass1, EXCHANGE), _rank_chunks)
    grams = _answered(by.cogroup(chunks.groupBy("block")).applyInArrow(pass2, EXCHANGE), _sort_grams)
    told = chunks.unionByName(grams)
    windows = _answered(by.cogroup(told.groupBy("block")).applyInArrow(pass3, EXCHANGE), _rank_windows)
    return by.cogroup(told.unionByName(windows).groupBy("block")).applyInArrow(
        pass4, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans string")


def _digest(cut: np.ndarray, text: bytes) -> tuple:
    edge = np.diff(np.concatenate([[False], cut, [False]]).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept = np.frombuffer(text, np.uint8)[~cut].tobytes() if len(a) else text
    return (len(text), int(cut.sum()), len(a), hashlib.sha256(kept).hexdigest(),
            ",".join(f"{x}:{y}" for x, y in zip(a.tolist(), b.tolist())))


def op6_repeated_substrings(spark, sf_dir):
    return repeated_bytes(read(spark, sf_dir, "documents"))
