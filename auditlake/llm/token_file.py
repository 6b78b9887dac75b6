"""Operator 9: token ids as fixed-width bit-packed files with block offsets.

File: header ``PKTK`` | u32 bits | u64 documents | u64 documents without key | u64 ids | u32 ids a block | u64 blocks;
then i64 document keys (those without come first and count as 0),
u64 document starts (documents + 1), u64 byte offsets of blocks (blocks + 1), then the blocks. A block packs its ids
with ``bits`` bits each, least significant first; any id is reached through its block's offset without what is before.
"""

from __future__ import annotations

import gc
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm.common import parallelism, read_table, shared_dir

MAGIC, HEAD = b"PKTK", struct.Struct("<4sIQQQIQ")
BLOCK = 1 << 16
END_ID = 2
FILE_TEXT_BYTES = 64 << 20  # text behind one file, held as ids by one task
CACHED_CHUNKS = 700_000
SEPARATOR = "<|endoftext|>"
#: Letters that normalisation leaves alone but for their case, then ASCII marks but the apostrophe: one pre-token each.
PLAIN = re.compile("([a-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits an id, least significant bit first, padded to whole bytes."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    plane = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(plane.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(raw, "<u2", n).astype("<u4")
    plane = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (plane.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def build_file(keys: list[int | None], lengths: list[int], ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """One file's bytes from documents in their order and their ids, one after the other."""
    packed = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in packed])]).astype("<u8")
    unnamed = sum(k is None for k in keys)
    head = HEAD.pack(MAGIC, bits, len(keys), unnamed, len(ids), block, len(packed))
    return b"".join([head, np.array([0] * unnamed + list(keys[unnamed:]), "<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *packed])


class TokenFile:
    """Reads a file's bytes; ``doc(i)`` unpacks only the blocks that document i touches."""

    def __init__(self, raw: bytes):
        magic, self.bits, docs, self.unnamed, self.n_ids, self.block, blocks = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = HEAD.size
        self.keys = np.frombuffer(raw, "<i8", docs, at)
        self.starts = np.frombuffer(raw, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, at + 16 * docs + 8).astype(np.int64)
        self.raw, self.base = raw, at + 16 * docs + 8 + 8 * (blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(self.raw[self.base + self.offsets[b] : self.base + self.offsets[b + 1]], n, self.bits))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def docs(self) -> Iterator[np.ndarray]:
        """All documents' ids in turn, each block unpacked once for those inside it."""
        cut = [*np.searchsorted(self.starts[:-1], np.arange(0, self.n_ids, self.block)).tolist(), len(self.keys)]
        for first, last in zip(cut, cut[1:]):
            if first < last:
                base = int(self.starts[first])
                ids = self.ids(base, int(self.starts[last]))
                for i in range(first, last):
                    yield ids[self.starts[i] - base : self.starts[i + 1] - base]


class ChunkEncoder:
    """The tokenizers library over runs without white space, each distinct run once in a worker's bounded cache.

    No pre-token of this vocabulary crosses white space, so a text's ids are its runs' ids in a row. Runs not seen
    yet are given to the library together, parted by a special token. Cached ids are bytes of ``kind``.
    """

    def __init__(self, path: str, kind: str = "<u4"):
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_file(path), kind
        self.library.no_truncation()
        self.library.no_padding()
        self.parting = self.library.token_to_id(SEPARATOR)
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new runs: plain words and marks by word ends, all others parted by a special token."""
        out: dict[bytes, bytes] = {}
        plain: dict[str, bytes | None] = {}
        parts: list[tuple[bytes, str, str]] = []
        rest: list[bytes] = []
        known, older, whole = self.young.get, self.old.get, PLAIN.fullmatch
        for c in chunks:
            if b"<|" in c:
                out[c] = self.ids(c.decode("utf-8", "surrogatepass")).tobytes()
                continue
            m = whole(c.decode("utf-8", "surrogatepass"))
            if m is None:
                rest.append(c)
                continue
            word, marks = m.groups()
            word = word.lower()
            parts.append((c, word, marks))
            for x in (word, marks) if marks else (word,):
                if x not in plain:
                    raw = x.encode()
                    plain[x] = known(raw) or older(raw)
        self.learn_plain([x for x, ids in plain.items() if ids is None], plain)
        for c, word, marks in parts:
            out[c] = plain[word] + plain[marks] if marks else plain[word]
        for i in range(0, len(rest), 500):
            part = rest[i : i + 500]
            ids = self.ids(f" {SEPARATOR} ".join(c.decode("utf-8", "surrogatepass") for c in part))
            cuts = np.flatnonzero(ids == self.parting)
            for c, p in zip(part, np.split(ids, cuts), strict=True):
                out[c] = p[1:].tobytes() if len(p) and p[0] == self.parting else p.tobytes()
        return out

    def learn_plain(self, pieces: list[str], to: dict[str, bytes | None]) -> None:
        """Each piece is one pre-token, and only a pre-token's last id ends a word."""
        size = np.dtype(self.kind).itemsize
        for i in range(0, len(pieces), 5000):
            part = pieces[i : i + 5000]
            ids = self.ids(" ".join(part))
            raw, at = ids.tobytes(), 0
            for x, stop in zip(part, (size * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), strict=True):
                to[x] = raw[at:stop]
                at = stop

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text (UTF-8) as little-endian unsigned integers; null counts as empty."""
        if len(self.young) >= CACHED_CHUNKS // 2:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, {}
        found = []
        for raw in texts:
            # Special strings are matched before case is folded, so such a text keeps its case
            chunks = (raw or b"").split() if raw and b"<|" in raw else (raw or b"").lower().split()
            got = list(map(young.get, chunks))
            holes = [i for i, g in enumerate(got) if g is None] if None in got else []
            for i in holes:
                c = chunks[i]
                if (g := old.get(c)) is not None:
                    got[i] = young[c] = g
                else:
                    new[c] = b""
            found.append((chunks, got, holes))
        if new:
            new = self.learn(list(new))
            for chunks, got, holes in found:
                for i in holes:
                    if got[i] is None:
                        got[i] = new[chunks[i]]
            young.update((c, i) for c, i in new.items() if len(c) < 100)
        return [b"".join(got) for _, got, _ in found]


@lru_cache(maxsize=2)
def chunk_encoder(path: str, kind: str) -> ChunkEncoder:
    return ChunkEncoder(path, kind)


def write_token_files(docs: DataFrame, where: str, path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_TEXT_BYTES) -> None:
    """Encode every whole text, append ``end_id``, and write packed files in ascending key order under ``where``.

    Rows are dealt by ranges of (key, text hash), null keys first, so that file order is key order and one key's rows can
    lie in several ranges; rows equal in both are told apart by a running number. A range's rows become files, each begun
    anew once ``file_bytes`` of text are behind it. Each file is one row (range, seq, n_ids, file) of a Parquet table,
    whose commit by Spark leaves no part of a lost task. Null texts hold the end id alone; an empty table gives no file.
    """
    from tokenizers import Tokenizer

    bits = max(1, (max(Tokenizer.from_file(path).get_vocab_size() - 1, end_id)).bit_length())
    kind = "<u2" if bits <= 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, size = chunk_encoder(path, kind), np.array([end_id], kind).tobytes(), np.dtype(kind).itemsize
        number, seq = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def made() -> pa.RecordBatch:
            raw = build_file(keys, [len(p) // size for p in parts], np.frombuffer(b"".join(parts), kind), bits)
            cols = [pa.array([number], pa.int32()), pa.array([seq], pa.int32()), pa.array([sum(map(len, parts)) // size], pa.int64()), pa.array([raw], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["range", "seq", "n_ids", "file"])

        gc.disable()  # the caches are large and hold no cycles
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):  # a few texts' new runs go to the library at a time
                    b = whole.slice(at, 1000)
                    texts = b.column("text").cast(pa.binary()).to_pylist()
                    keys += b.column("key").to_pylist()
                    parts += [ids + end for ids in enc.encode(texts)]
                    held += sum(len(t) for t in texts if t)
                    if held >= file_bytes:
                        yield made()
                        seq, held = seq + 1, 0
                        keys.clear()
                        parts.clear()
            if keys:
                yield made()
        finally:
            gc.enable()

    rows = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("h"), F.monotonically_increasing_id().alias("n"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(parallelism(docs.sparkSession), -(-total // file_bytes))
    dealt = rows.repartitionByRange(files, "key", "h", "n").sortWithinPartitions("key", "h", "text").select("key", "text")
    dealt.mapInArrow(run, "range int, seq int, n_ids long, file binary").write.option("compression", "none").parquet(where)


def read_token_files(spark: SparkSession, where: str) -> DataFrame:
    """Documents of all files: key, start (ids of all documents before), n_tokens, ids_crc32.

    Files are parts of one sequence in the order of (range, seq); only their counts of ids, one a file, are summed up in
    one place. No file: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, seq, raw in zip(b.column("range").to_pylist(), b.column("seq").to_pylist(), b.column("file").to_pylist()):
                f = TokenFile(raw)
                n = len(f.keys)
                crc = [zlib.crc32(ids) for ids in f.docs()]
                keys = pa.array(f.keys, mask=np.arange(n) < f.unnamed)
                cols = [keys, pa.array(f.starts[:-1]), pa.array(np.diff(f.starts)), pa.array(crc, pa.int64()), pa.array(np.full(n, no, np.int32)), pa.array(np.full(n, seq, np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "local_start", "n_tokens", "ids_crc32", "range", "seq"])

    files = spark.read.schema("range int, seq int, n_ids long, file binary").parquet(where)
    docs = files.select("range", "seq", "file").mapInArrow(run, "key long, local_start long, n_tokens long, ids_crc32 long, range int, seq int")
    before = files.select("range", "seq", (F.sum("n_ids").over(Window.orderBy("range", "seq")) - F.col("n_ids")).alias("before"))
    docs = docs.join(before, ["range", "seq"])
    return docs.select("key", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes ``documents`` as packed token files in key order, and what is read back from them, a row a document."""
    import public_tokenizers

    where = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(read_table(spark, sf_dir, "documents"), where, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, where).withColumnRenamed("key", "doc_id")
