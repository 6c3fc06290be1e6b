"""Token-ID output: texts to byte-level BPE ids, ids to Simple-8b blocks, blocks to files and back.

The tokenizer cuts a text into pieces (words with their space, numbers, marks, white space) and encodes
each piece alone, so equal pieces have equal ids.  The pieces are found with numpy, and the tokenizer
is asked once per distinct piece and process.  That holds for texts whose characters are all below
U+0250 and that name no special token; every other text goes to the tokenizer as a whole.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salescope.llm import simple8b, wordhash
from salescope.llm.common import land, small
from salescope.llm.process import per_process
from salescope.session import scratch_path

END_ID = 0
FILE_SCHEMA = "part int, block long, before long, doc_ids array<bigint>, payload binary"
#: ids after which a block ends (with the document that reaches it)
BLOCK_IDS = 1 << 16
#: distinct pieces that a process remembers before it starts anew, and pieces merged at once
CACHE_PIECES, MERGE_PIECES = 2_000_000, 100_000
PLAIN_BELOW = 0x250
BATCH_CHARS = 1 << 20


def _classes() -> np.ndarray:
    """Classes of the tokenizer's splitting pattern: 0 white space, 1 letters, 2 numbers, 3 other."""
    out = np.full(PLAIN_BELOW, 3, np.uint8)
    for cp in range(PLAIN_BELOW):
        category = unicodedata.category(chr(cp))[0]
        out[cp] = {"L": 1, "N": 2}.get(category, 3)
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = 0
    return out


def piece_starts(codes: np.ndarray, offsets: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Start of every piece of the texts codes[offsets[i]:offsets[i + 1]] (code points below 0x250).

    The pattern, in order: 's 't 're 've 'm 'll 'd; letters, numbers or other marks, each with one
    space before them if there is one; white space up to the last character before a piece; white space.
    """
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    k = cls[codes]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    run = first.copy()
    run[1:] |= k[1:] != k[:-1]  # a run of one class, inside one text, starts here
    start = run.copy()
    space = k == 0
    # the last white space character before other characters is a piece of its own, or their first one
    follows = np.zeros(n, bool)  # the next character belongs to the same text and is no white space
    follows[:-1] = ~first[1:] & ~space[1:]
    last = space & follows
    start |= last
    joined = last & (codes == 32)
    start[1:] &= ~(joined[:-1] & ~first[1:])
    # contractions: an apostrophe that starts a piece, with letters right after it
    quote = np.flatnonzero((codes == 39) & start)
    if len(quote):
        ends = np.concatenate([offsets[1:], [n]])
        stop = ends[np.searchsorted(offsets, quote, "right") - 1]
        pad = np.concatenate([codes, [0, 0, 0]])
        one, two = np.where(quote + 1 < stop, pad[quote + 1], 0), np.where(quote + 2 < stop, pad[quote + 2], 0)
        size = np.zeros(len(quote), np.int64)
        size[np.isin(one, [ord(c) for c in "stmd"])] = 2
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 3
        hit = size > 0
        q, s = quote[hit], size[hit]
        start[q + 1] = False
        after = q + s
        inside = after < stop[hit]
        same = inside & (k[np.minimum(after, n - 1)] == 1)
        start[after[same]] = True
    return np.flatnonzero(start)


class PieceEncoder:
    """Ids of pieces, remembered by hash: sorted arrays plus a small dictionary of new ones."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cls = _classes()
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.fresh: dict[int, int] = {}
        self.first = np.zeros(1, np.int64)  # entry -> start in the pool
        self.pool = np.zeros(0, np.int32)
        self.new_first: list[int] = []
        self.new_pool: list[np.ndarray] = []
        self.total = 0

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merge(self) -> None:
        if not self.fresh:
            return
        keys = np.fromiter(self.fresh.keys(), np.uint64, len(self.fresh))
        vals = np.fromiter(self.fresh.values(), np.int64, len(self.fresh))
        keys, vals = np.concatenate([self.known, keys]), np.concatenate([self.where, vals])
        order = np.argsort(keys, kind="stable")
        self.known, self.where, self.fresh = keys[order], vals[order], {}

    def _flush(self) -> None:
        if self.new_pool:
            self.pool = np.concatenate([self.pool, *self.new_pool])
            self.first = np.concatenate([self.first, np.array(self.new_first, np.int64)])
            self.new_pool, self.new_first = [], []

    def entries(self, keys: np.ndarray, text_of) -> np.ndarray:
        """Entry of every distinct key; ``text_of(i)`` is the piece of key i."""
        if self.total > CACHE_PIECES:
            self.forget()
        at = np.searchsorted(self.known, keys)
        found = at < len(self.known)
        found[found] = self.known[at[found]] == keys[found]
        out = np.full(len(keys), -1, np.int64)
        out[found] = self.where[at[found]]
        missing = []
        for i in np.flatnonzero(~found).tolist():
            e = self.fresh.get(int(keys[i]))
            if e is None:
                missing.append(i)
            else:
                out[i] = e
        if missing:
            end = int(self.first[-1]) if not self.new_first else self.new_first[-1]
            for i, ids in zip(missing, self.whole([text_of(i) for i in missing]), strict=True):
                end += len(ids)
                self.new_pool.append(np.array(ids, np.int32))
                self.new_first.append(end)
                self.fresh[int(keys[i])] = out[i] = self.total
                self.total += 1
            self._flush()
            if len(self.fresh) > MERGE_PIECES:
                self._merge()
        return out

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per text) of texts whose characters are all in the table and that hold no special token."""
        joined = "".join(texts)
        raw = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lens = np.array([len(t) for t in texts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lens)])
        if len(raw) == 0:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        starts = piece_starts(raw, offsets[:-1][lens > 0], self.cls)
        ends = np.append(starts[1:], len(raw))
        keys = wordhash.span_hashes(raw.astype(np.uint16), starts, ends)
        distinct, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        entry = self.entries(distinct, lambda i: joined[starts[index[i]]:ends[index[i]]])[inverse]
        count = self.first[entry + 1] - self.first[entry]
        stop = np.cumsum(count)
        take = np.arange(stop[-1]) + np.repeat(self.first[entry] - (stop - count), count)
        before = np.concatenate([[0], stop])
        bounds = before[np.searchsorted(starts, offsets)]
        return self.pool[take], np.diff(bounds)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        easy, hard, chars = [], [], 0

        def done():
            if easy:
                ids, sizes = self.plain([texts[i] for i in easy])
                for i, part in zip(easy, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    out[i] = part
                easy.clear()

        for i, t in enumerate(texts):
            if (t.isascii() or ord(max(t)) < PLAIN_BELOW) and not any(s in t for s in self.special):
                easy.append(i)
                chars += len(t)
                if chars > BATCH_CHARS:
                    done()
                    chars = 0
            else:
                hard.append(i)
        done()
        for i, ids in zip(hard, self.whole([texts[i] for i in hard]) if hard else [], strict=True):
            out[i] = np.array(ids, np.int32)
        return out


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, block_ids: int = BLOCK_IDS) -> None:
    """Write all documents' ids, in ascending doc_id order, as Simple-8b blocks.

    A file row is (part, block, before, doc_ids, payload): the part and block number give the order,
    ``before`` counts the part's ids before the block, ``doc_ids`` name the block's documents and
    ``payload`` is the block (see ``simple8b.pack_block``).  Null texts are empty and get the end id
    alone; null ids come first; rows that repeat an id follow each other by text checksum.  Files are
    written by Spark, into any store it can write.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("crc", F.crc32(F.encode("text", "UTF-8")))
    dealt = (source.repartitionByRange(parts, "doc_id", "crc").sortWithinPartitions("doc_id", "crc")
             .select("doc_id", "text", F.spark_partition_id().alias("part")))

    def run(batches):
        encoder = per_process(f"encoder {tokenizer_path}", lambda: PieceEncoder(tokenizer_path))
        ids, names, lengths, held, before, block, part = [], [], [], 0, 0, 0, None

        def close():
            flat = np.concatenate(ids).astype(np.uint64)
            payload = simple8b.pack_block(flat, np.array(lengths))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([before], pa.int64()),
                 pa.array([names], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                ["part", "block", "before", "doc_ids", "payload"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            part = batch.column(2)[0].as_py()
            for lo in range(0, batch.num_rows, 512):
                piece = batch.slice(lo, 512)
                for doc, own in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist()), strict=True):
                    ids.append(np.append(own, END_ID))
                    names.append(doc)
                    lengths.append(len(own) + 1)
                    held += len(own) + 1
                    if held >= block_ids:
                        yield close()
                        before, block = before + held, block + 1
                        ids, names, lengths, held = [], [], [], 0
        if names:
            yield close()

    dealt.mapInArrow(run, FILE_SCHEMA).write.parquet(folder)


def read_token_files(spark, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(folder)

    def run(batches):
        for batch in batches:
            part, doc, start, size, crc = [], [], [], [], []
            for p, before, names, payload in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids, offsets = simple8b.unpack_block(payload.as_py())
                raw = memoryview(ids.astype("<u4")).cast("B")
                names = names.as_py()
                part += [p.as_py()] * len(names)
                doc += names
                start += (offsets[:-1] + before.as_py()).tolist()
                size += np.diff(offsets).tolist()
                crc += [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(crc, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = land(rows.select("part", "before", "doc_ids", "payload")
                 .mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-rows")
    totals = found.groupBy(F.col("part").alias("__p")).agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    starts = totals.select("__p", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (found.join(small(starts, parts), F.col("part") == F.col("__p"))
            .select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))


def token_output(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch_path(spark, "llm-token-files")
    write_token_files(docs, tokenizer_path, folder)
    return read_token_files(spark, folder)
