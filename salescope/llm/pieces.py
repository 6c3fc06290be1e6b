"""SentencePiece encoding with byte offsets, and decoding.

A model file names a compiled character map (a double-array trie over UTF-8 keys), white space flags and
the pieces of a byte-pair vocabulary.  Normalisation replaces the longest key of the map that starts at
each place, and keeps for every normalised character the byte of the source it came from; whatever is
done to the normalised text afterwards (white space marks, cuts, merges) is thus projected back: each
piece names the bytes of the original text that it covers.

A normalised text is cut between two characters that stand side by side in no piece: no merge can cross
such a place, so equal stretches have equal pieces, and merges run once per distinct stretch and
process.  Batches of texts are cut, hashed and reassembled with numpy.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salescope.llm import wordhash
from salescope.llm.process import give_back, per_process

MARK, SPACE = 0x2581, 0x20
SCHEMA = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"
#: distinct stretches that a process remembers before it starts anew
CACHE = 1_000_000
BATCH_CHARS = 1 << 20
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message: integers, bytes, 4-byte and 8-byte values."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield tag >> 3, raw[at:at + size]
        at += size


class CharMap:
    """The compiled character map: a double-array trie over UTF-8 keys whose leaves point at replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size:]
        self.first = self._first_bytes()
        # whether a text needs the map at all is decided by the lead bytes of its keys
        self.lead = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in self.first) + b"]") if self.first else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _first_bytes(self) -> list[int]:
        if not self.units:
            return []
        root = self._offset(self.units[0])
        return [b for b in range(1, 256) if (root ^ b) < len(self.units) and self.units[root ^ b] & 0x800000FF == b]

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes]:
        """(length, replacement) of the longest key that starts at ``at``; length 0 if none does."""
        units, node, best = self.units, self._offset(self.units[0]), (0, -1)
        for i in range(at, len(raw)):
            byte = raw[i]
            node ^= byte
            if byte == 0 or node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        if best[0] == 0:
            return 0, b""
        return best[0], self.texts[best[1]:self.texts.index(b"\0", best[1])]

    def apply(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points, source byte of each, whether each is a leading space of its unit) of a UTF-8 text."""
        out, starts, origin, done, at = [], [], [], 0, 0
        # stretches that the map leaves alone are copied whole
        while self.lead and (hit := self.lead.search(raw, at)):
            at = hit.start()
            size, new = self.longest(raw, at)
            if size == 0:
                at += 1
                while at < len(raw) and raw[at] & 0xC0 == 0x80:
                    at += 1
                continue
            out += [raw[done:at], new]
            starts += [done, at]
            origin += [False, True]
            done = at = at + size
        out.append(raw[done:])
        starts.append(done)
        origin.append(False)
        data = np.frombuffer(b"".join(out), np.uint8)
        heads = np.flatnonzero((data & 0xC0) != 0x80)  # one per character
        sizes = np.array([len(x) for x in out], np.int64)
        begin = np.cumsum(sizes) - sizes
        unit = np.searchsorted(begin, heads, "right") - 1
        mapped = np.array(origin)[unit]
        source = np.array(starts, np.int64)[unit] + np.where(mapped, 0, heads - begin[unit])
        codes = np.frombuffer(b"".join(out).decode().encode("utf-32-le"), np.uint32)
        blank = codes == SPACE
        if mapped.any():
            # position inside the unit among spaces only
            inner = np.flatnonzero(mapped & ~blank)
            begun = np.full(len(out), len(codes) + 1)
            np.minimum.at(begun, unit[inner], inner)
            blank = blank & (~mapped | (np.arange(len(codes)) < begun[unit]))
        return codes, source, blank


class PieceModel:
    """A byte-pair SentencePiece model: normaliser, vocabulary and merges."""

    def __init__(self, raw: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                one = dict(_fields(value))
                pieces.append((one[1].decode(), struct.unpack("<f", one.get(2, b"\0\0\0\0"))[0], one.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2:
            raise ValueError("not a byte-pair model")
        if trainer.get(24) or any(kind in (USER_DEFINED, UNUSED) for _, _, kind in pieces):
            raise ValueError("suffix marks, user-defined and unused pieces are not supported")
        self.map = CharMap(normalizer.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(normalizer.get(i, 1)) for i in (3, 4, 5))
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = [s for _, s, _ in pieces]
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
        end = next((i for i, p in enumerate(pieces) if p[2] == CONTROL and p[0] == trainer.get(47, b"</s>").decode()), None)
        self.end = end
        self.bytes = [self.unknown] * 256
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.bytes[int(p[1:-1], 16)] = i
        self.fallback = bool(trainer.get(35, 0))
        # characters that stand side by side in some piece; class 0: in no piece
        self.alphabet = np.array(sorted({ord(c) for p in self.ids for c in p}), np.uint32)
        self.side = np.zeros((len(self.alphabet) + 1, len(self.alphabet) + 1), bool)
        place = {int(c): i + 1 for i, c in enumerate(self.alphabet)}
        for p in self.ids:
            for a, b in zip(p, p[1:], strict=False):
                self.side[place[ord(a)], place[ord(b)]] = True
        self.forget()

    # normalisation

    def normalise(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(code points, source bytes): the byte at which each character starts, and where the last one ends."""
        raw = text.encode()
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        codes, source, blank = self.map.apply(raw)
        last = len(raw)
        if self.squeeze:
            before = np.ones(len(codes), bool)
            before[1:] = codes[:-1] == SPACE
            keep = ~(blank & before)
            codes, source = codes[keep], source[keep]
            full = np.flatnonzero(codes != SPACE)
            size = int(full[-1]) + 1 if len(full) else 0
            if size < len(codes):
                last = int(source[size])
            codes, source = codes[:size], source[:size]
            if size == 0:
                return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        mark = MARK if self.escape else SPACE
        codes = np.where(codes == SPACE, mark, codes).astype(np.uint32)
        if self.dummy:
            codes = np.concatenate([np.array([mark], np.uint32), codes])
            source = np.concatenate([source[:1], source]) if len(source) else np.zeros(1, np.int64)
        return codes, np.append(source, last)

    # merges

    def merge(self, text: str) -> tuple[list[int], list[int]]:
        """(ids, characters each covers) of one stretch: the best-scored pair is merged first, then the leftmost.

        A character without a piece becomes its bytes, of which the last covers it.
        """
        ids, score, n = self.ids, self.score, len(text)
        sym, nxt, prv = list(text), [*range(1, n), -1], list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            i = ids.get(sym[a] + sym[b])
            if i is not None:
                heapq.heappush(heap, (-score[i], a, b, len(sym[a]) + len(sym[b])))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not sym[a] or not sym[b] or len(sym[a]) + len(sym[b]) != size:
                continue
            sym[a], sym[b] = sym[a] + sym[b], ""
            nxt[a] = nxt[b]
            if nxt[b] >= 0:
                prv[nxt[b]] = a
                offer(a, nxt[b])
            if prv[a] >= 0:
                offer(prv[a], a)
        out, sizes = [], []
        for s in sym:
            i = ids.get(s) if s else None
            if i is not None:
                out.append(i)
                sizes.append(len(s))
            elif s and self.fallback:
                raw = s.encode()
                out += [self.bytes[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [1]
            elif s:
                out.append(self.unknown)
                sizes.append(len(s))
        return out, sizes

    # batches

    def forget(self) -> None:
        self.entry: dict[int, int] = {}
        self.first, self.pool, self.widths = np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def entries(self, keys: np.ndarray, text_of) -> np.ndarray:
        """Entry of every distinct key; ``text_of(i)`` is the stretch of key i."""
        if len(self.entry) > CACHE:
            self.forget()
        out, new_ids, new_sizes, new_ends, end = np.zeros(len(keys), np.int64), [], [], [], int(self.first[-1])
        for i, key in enumerate(keys.tolist()):
            e = self.entry.get(key)
            if e is None:
                e = self.entry[key] = len(self.entry)
                ids, sizes = self.merge(text_of(i))
                new_ids += ids
                new_sizes += sizes
                end += len(ids)
                new_ends.append(end)
            out[i] = e
        if new_ends:
            self.first = np.concatenate([self.first, np.array(new_ends, np.int64)])
            self.pool = np.concatenate([self.pool, np.array(new_ids, np.int32)])
            self.widths = np.concatenate([self.widths, np.array(new_sizes, np.int32)])
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends, ids of all texts before each): begins and ends are bytes of each source text."""
        normal = [self.normalise(t) for t in texts]
        lens = np.array([len(c) for c, _ in normal], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lens)])
        n = int(offsets[-1])
        if n == 0:
            none = np.zeros(0, np.int32)
            return none, none, none, np.zeros(len(texts) + 1, np.int64)
        codes = np.concatenate([c for c, _ in normal])
        source = np.concatenate([s for _, s in normal])  # one more than characters in every text
        cls = np.searchsorted(self.alphabet, codes)
        cls[cls == len(self.alphabet)] = 0
        cls = np.where(self.alphabet[cls] == codes, cls + 1, 0) if len(self.alphabet) else np.zeros(n, np.int64)
        start = np.ones(n, bool)
        start[1:] = ~self.side[cls[:-1], cls[1:]]
        start[offsets[:-1][lens > 0]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        keys = wordhash.span_hashes(codes, starts, ends)
        distinct, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        entry = self.entries(distinct, lambda i: codes[starts[index[i]]:ends[index[i]]].tobytes().decode("utf-32-le"))[inverse]
        count = self.first[entry + 1] - self.first[entry]
        stop = np.cumsum(count)
        take = np.arange(stop[-1]) + np.repeat(self.first[entry] - (stop - count), count)
        ids, to = self.pool[take], np.cumsum(self.widths[take])  # characters up to and with each piece
        before = np.concatenate([[0], stop])[np.searchsorted(starts, offsets)]
        shift = np.repeat(np.arange(len(texts)), np.diff(before))  # texts before: each has one more source place
        return ids, source[to - self.widths[take] + shift].astype(np.int32), source[to + shift].astype(np.int32), before


def model(path: str) -> PieceModel:
    def load() -> PieceModel:
        with open(path, "rb") as f:
            return PieceModel(f.read())

    return per_process(f"piece model {path}", load)


def encode_pieces(docs: DataFrame, model_path: str, end: bool = True, decode: bool = True) -> DataFrame:
    """One row per document: doc_id, ids, begins, ends, decoded.

    ``ids`` are the pieces of the whole text, followed by the model's end id if ``end``; ``begins`` and
    ``ends`` are the bytes (UTF-8, end exclusive) of the original text that each piece covers: the mark
    put before the first word covers nothing, of the byte pieces of one character the last covers it, and
    the end id stands at the end.  ``decoded`` is the library's decoding of the ids (null unless ``decode``).

    A null text is an empty one: no pieces but the end id.  Null, tied and repeated ids are kept, one row
    per row.  A text of any length is encoded whole; a batch holds at most ``BATCH_CHARS`` characters
    or one text.  An empty table gives an empty table; other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def rows(own: PieceModel, decoder, names: list, texts: list[str]) -> pa.RecordBatch:
        ids, begins, ends, before = own.encode(texts)
        if end:  # one more id after each text's last one
            spots = before[1:]
            size = np.array([len(t.encode()) for t in texts], np.int32)
            ids, begins, ends = np.insert(ids, spots, own.end), np.insert(begins, spots, size), np.insert(ends, spots, size)
            before = before + np.arange(len(before))
        bounds = pa.array(before, pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (ids, begins, ends)]
        if decode:
            decoded = decoder.decode([x.tolist() for x in np.split(ids, before[1:-1])], num_threads=1)
        else:
            decoded = [None] * len(texts)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *lists, pa.array(decoded, pa.string())],
                                          ["doc_id", "ids", "begins", "ends", "decoded"])

    def run(batches):
        import sentencepiece

        own = model(model_path)
        decoder = per_process(f"decoder {model_path}", lambda: sentencepiece.SentencePieceProcessor(model_file=model_path))
        for batch in batches:
            sizes = np.frombuffer(batch.column(1).cast(pa.large_string()).buffers()[1], np.int64)[:batch.num_rows + 1] if batch.num_rows else []
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + BATCH_CHARS, "right")) - 1)
                part = batch.slice(lo, hi - lo)
                yield rows(own, decoder, part.column(0).to_pylist(), part.column(1).to_pylist())
                lo = hi
        give_back()

    return source.mapInArrow(run, SCHEMA)


def decode_pieces(coded: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """``coded`` with a column ``decoded``: the text of its array of ids (null for a null array)."""
    schema = f"{', '.join(f.name + ' ' + f.dataType.simpleString() for f in coded.schema if f.name != 'decoded')}, decoded string"
    keep = [c for c in coded.columns if c != "decoded"]

    def run(batches):
        import sentencepiece

        decoder = per_process(f"decoder {model_path}", lambda: sentencepiece.SentencePieceProcessor(model_file=model_path))
        for batch in batches:
            lists = batch.column(keep.index(ids)).to_pylist()
            texts = [None if x is None else decoder.decode(x) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*keep, "decoded"])

    return coded.select(*keep).mapInArrow(run, schema)
