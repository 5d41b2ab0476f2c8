"""Token ids in Huffman-coded files: canonical length-limited codes of global counts, read back through tables.

A folder holds ``codebook.json`` (the code length of each id), ``manifest.json`` and files for contiguous ranges of document ids, in ascending
order; a range's files are rolled by size. A file holds blocks that are decoded independently; a block carries the bit offset of every
``CHECKPOINT``-th token, so its parts are decoded side by side, each step one table look-up for all of them. Files are written as a stream,
so a task holds a block and the ids and lengths of one file's documents, whatever the range.

Format, little-endian: ``GMHUF2\\n\\0``; blocks: u32 tokens, u32 words, u32 CRC-32 of the rest of the block, u64 offsets of the checkpoints, u64
words whose bits are used from the highest down; the index: i64 document ids, u8 "has an id" flags, u64 token counts; a JSON footer; u32
length of the footer, and the magic again. A document may go on in the next block, not in the next file.

The end id is appended to each document. A null text is empty and gives only that; a null id sorts first; rows that repeat an id stay, by
text (equal rows each have their row); an empty table gives a folder without files. A text is encoded whole, however long. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import U64, Workspace, balanced_cuts, deal, id_and_text, in_span, partitions, table, uri
from gristmill.llm.encoder import encoder

MAGIC = b"GMHUF2\n\0"
CHECKPOINT, BLOCK, LONGEST = 512, 1 << 16, 16
NO_ID = -(1 << 63)
#: Bytes after which a file is closed, at the end of a frame of documents.
ROLL_BYTES = 128 << 20


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Code lengths of least total cost with none over ``longest`` (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError("more ids than codes")
    order = used[np.lexsort((used, counts[used]))]
    weight = counts[order].astype(np.float64)
    n = len(order)
    levels, packages = [], np.zeros(0)
    for _ in range(longest):  # merge the leaves with the pairs of the level below
        merged = np.concatenate([weight, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        even = len(merged) // 2 * 2
        packages = merged[:even:2] + merged[1:even:2]
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for leaf in reversed(levels):  # of each level the cheapest `take`; its leaves get a bit, its packages open two of the next
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = np.left_shift(1, LONGEST - lengths[order].astype(np.int64))
    start = np.cumsum(size) - size
    out = np.zeros(len(lengths), np.uint32)
    out[order] = start >> (LONGEST - lengths[order].astype(np.int64))
    return out


def decode_table(lengths: np.ndarray) -> np.ndarray:
    """For each value of the next ``LONGEST`` bits the id, and its length above bit 32."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    out = np.zeros(1 << LONGEST, np.int64)
    entries = np.repeat(order.astype(np.int64) | (lengths[order].astype(np.int64) << 32), np.left_shift(1, LONGEST - lengths[order].astype(np.int64)))
    out[: len(entries)] = entries
    return out


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of a block as u64 words, and the offsets of its checkpoints."""
    length = lengths[ids].astype(np.int64)
    ends = np.cumsum(length)
    at = ends - length
    words = np.zeros((int(ends[-1]) >> 6) + 2 if len(ids) else 1, U64)
    if len(ids):
        code = codes[ids].astype(U64)
        word, shift = at >> 6, 64 - (at & 63) - length
        over = shift < 0
        head = np.where(over, code >> np.maximum(-shift, 0).astype(U64), code << np.maximum(shift, 0).astype(U64))
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] |= np.bitwise_or.reduceat(head, first)
        words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(U64)
    return words, at[::CHECKPOINT].astype(U64)


def unpack(blocks: list[tuple[int, np.ndarray, np.ndarray]], decode: np.ndarray, dtype: np.dtype) -> list[np.ndarray]:
    """The ids of (tokens, words, checkpoints), all parts of all blocks in step."""
    words = np.concatenate([w for _, w, _ in blocks] + [np.zeros(2, U64)])
    base = np.cumsum([0, *(len(w) for _, w, _ in blocks)])[:-1] * 64
    at = np.concatenate([c.astype(np.int64) + b for (_, _, c), b in zip(blocks, base, strict=True)])
    out = np.zeros((CHECKPOINT, len(at)), dtype)
    for step in range(CHECKPOINT):
        word, off = at >> 6, (at & 63).astype(U64)
        window = (words[word] << off) | ((words[word + 1] >> U64(1)) >> (U64(63) - off))
        entry = decode[(window >> U64(64 - LONGEST)).astype(np.int64)]
        out[step] = entry
        at = np.minimum(at + (entry >> 32), len(words) * 64 - 129)
    flat = np.ascontiguousarray(out.T)
    parts, lane = [], 0
    for n, _, checkpoints in blocks:
        parts.append(flat[lane : lane + len(checkpoints)].reshape(-1)[:n])
        lane += len(checkpoints)
    return parts


def write_block(out, ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> None:
    words, checkpoints = pack(ids, codes, lengths)
    body = checkpoints.tobytes() + words.tobytes()
    out.write(struct.pack("<III", len(ids), len(words), zlib.crc32(body)) + body)


def read_blocks(stream, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The blocks of the next ``size`` bytes, or of all."""
    while (size is None or size > 0) and (head := stream.read(12)):
        n, words, check = struct.unpack("<III", head)
        checkpoints = -(-n // CHECKPOINT)
        body = stream.read(8 * (checkpoints + words))
        if zlib.crc32(body) != check:
            raise ValueError("a block's checksum is wrong")
        if size is not None:
            size -= 12 + len(body)
        numbers = np.frombuffer(body, "<u8")
        yield n, numbers[checkpoints:], numbers[:checkpoints]


SPOOL = pa.schema([("span", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("counts", pa.binary())])
SPOOL_DDL = "span int, name string, docs long, tokens long, counts binary"


def _spool(folder: str, tokenizer: str, end_id: int):
    """Encodes the documents of each span, in order, to a file of its own (frames of ids), and counts the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, press = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = span = None
        done: list[tuple] = []

        def close() -> None:
            out.close()
            done.append((span, name, docs, int(counts.sum()), press.compress(counts.tobytes())))

        for batch in batches:
            spans = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, spans[1:] != spans[:-1]]) if len(spans) else []
            for a, b in zip(cuts, [*cuts[1:], len(spans)], strict=True):
                if span != spans[a]:
                    if out:
                        close()
                    span, docs, counts = int(spans[a]), 0, np.zeros(max(own.size, end_id + 1), np.int64)
                    name = f"spool-{span:06d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                part = batch.slice(a, b - a)
                for first, ids, n in own.column(part.column(2)):
                    ends = np.cumsum(n)
                    ids = np.insert(ids, ends, end_id)
                    counts += np.bincount(ids, minlength=len(counts))
                    keys = part.column(1).slice(first, len(n))
                    has = np.array(keys.is_valid(), np.uint8)
                    docs += len(n)
                    frame = press.compress(keys.fill_null(0).to_numpy().astype("<i8").tobytes() + has.tobytes() + (n + 1).astype("<u8").tobytes() + ids.astype(own.dtype).tobytes())
                    out.write(struct.pack("<II", len(n), len(frame)) + frame)
        if out:
            close()
        yield table(SPOOL, *(map(list, zip(*done, strict=True)) if done else [[] for _ in SPOOL]))

    return run


def _frames(stream, dtype: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    expand = zstandard.ZstdDecompressor()
    while head := stream.read(8):
        docs, size = struct.unpack("<II", head)
        raw = expand.decompress(stream.read(size))
        a, b, c = 8 * docs, 9 * docs, 17 * docs
        yield np.frombuffer(raw[:a], "<i8"), np.frombuffer(raw[a:b], np.uint8), np.frombuffer(raw[b:c], "<u8"), np.frombuffer(raw[c:], dtype)


def _sum_counts(key: tuple, group: pa.Table) -> pa.Table:
    expand = zstandard.ZstdDecompressor()
    total = sum(np.frombuffer(expand.decompress(x), np.int64) for x in group.column("counts").to_pylist())
    return pa.table({"counts": pa.array([zstandard.ZstdCompressor(1).compress(total.tobytes())], pa.binary())})


class _File:
    """One coded file under a temporary name; blocks go out as they fill."""

    def __init__(self, store, root: str, name: str, first: int, codes: np.ndarray, lengths: np.ndarray, dtype: np.dtype):
        self.name, self.temporary, self.first = name, f"{name}.{uuid.uuid4().hex}.tmp", first
        self.codes, self.lengths = codes, lengths
        self.out = store.open_output_stream(f"{root}/temporary/{self.temporary}", compression=None)
        self.out.write(MAGIC)
        self.index: list[list[np.ndarray]] = []
        self.left, self.tokens, self.size = np.zeros(0, dtype), 0, 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, rows: list[np.ndarray], ids: np.ndarray) -> None:
        self.index.append(rows)
        self.tokens += len(ids)
        ids = np.concatenate([self.left, ids])
        whole = len(ids) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            write_block(self, ids[k : k + BLOCK], self.codes, self.lengths)
        self.left = ids[whole:]

    def close(self) -> tuple[str, str]:
        if len(self.left):
            write_block(self, self.left, self.codes, self.lengths)
        footer = json.dumps({"first_token": self.first, "tokens": self.tokens, "docs": sum(len(x[0]) for x in self.index), "blocks": self.size}).encode()
        self.out.write(b"".join(np.concatenate([x[k] for x in self.index]).tobytes() for k in range(3)) + footer + struct.pack("<I", len(footer)) + MAGIC)
        self.out.close()
        return self.name, self.temporary


def _write(spool: str, folder: str, lengths: np.ndarray, dtype: np.dtype, roll_bytes: int):
    """Spool files to coded files, under temporary names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        _, source = pafs.FileSystem.from_uri(spool)
        codes = canonical_codes(lengths)
        for batch in batches:
            for span, name, first in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                store.create_dir(f"{root}/temporary", recursive=True)
                done, file = [], None
                with store.open_input_stream(f"{source}/{name}", compression=None) as stream:
                    for *rows, ids in _frames(stream, dtype):
                        if file and file.size >= roll_bytes:
                            done.append(file.close())
                            file = None
                        file = file or _File(store, root, f"{span:06d}-{len(done):06d}.huf", first, codes, lengths, dtype)
                        file.add(rows, ids)
                        first += len(ids)
                if file:
                    done.append(file.close())
                yield pa.record_batch({"name": [x for x, _ in done], "temporary": [x for _, x in done]})

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", roll_bytes: int = ROLL_BYTES) -> None:
    """Encodes ``docs`` and writes the folder. Texts cross one shuffle, into ranges of ids of about as many bytes, and are encoded once; ids
    wait in spool files.

    The driver sees a row for each file, and the summed counts. Files are renamed by the driver once Spark has committed their list.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "token-files")
    rows = id_and_text(docs, id_col, text_col).withColumn("k", F.coalesce("doc_id", F.lit(NO_ID)))
    count = partitions(spark)
    dealt = deal(rows.withColumn("span", in_span("k", balanced_cuts(rows, "k", F.octet_length("text") + 16, count))), count).sortWithinPartitions("span", "k", "text")
    spool = uri(ws.path("spool"))
    spooled = ws.write(dealt.select("span", "doc_id", "text").mapInArrow(_spool(spool, tokenizer, end_id), SPOOL_DDL), "spooled")
    sums = spooled.groupBy((F.col("span") % 32).alias("part")).applyInArrow(_sum_counts, "counts binary").collect()
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    own = encoder(tokenizer)
    counts = sum((np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), np.int64) for r in sums), np.zeros(max(own.size, end_id + 1), np.int64))
    lengths = code_lengths(counts)
    listed = sorted(spooled.select("span", "name", "tokens").collect())  # a row for each range
    names: list[str] = []
    if listed:
        starts = np.cumsum([0, *(r["tokens"] for r in listed)])
        plan = spark.createDataFrame([(r["span"], r["name"], int(s)) for r, s in zip(listed, starts, strict=False)], "span int, name string, first long")
        written = ws.write(plan.repartition(len(listed)).mapInArrow(_write(spool, folder, lengths, own.dtype, roll_bytes), "name string, temporary string"), "written")
        for r in written.collect():
            store.move(f"{root}/temporary/{r['temporary']}", f"{root}/{r['name']}")
            names.append(r["name"])
        store.delete_dir(f"{root}/temporary")
    _put(store, f"{root}/codebook.json", {"longest": LONGEST, "lengths": lengths.tolist()})
    _put(store, f"{root}/manifest.json", {"format": "huffman-tokens-2", "files": sorted(names), "end_id": end_id, "width": own.dtype.itemsize})
    ws.drop("spool")


def _put(store, path: str, what: dict) -> None:
    with store.open_output_stream(f"{path}.tmp", compression=None) as out:
        out.write(json.dumps(what).encode())
    store.move(f"{path}.tmp", path)


def decode_file(stream, size: int, decode: np.ndarray, dtype: np.dtype) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """First token's number, document ids, which rows have one, token counts, and the ids by groups of blocks. ``stream`` can seek."""
    mark = len(MAGIC)
    stream.seek(size - mark - 4)
    tail = stream.read(mark + 4)
    if tail[4:] != MAGIC:
        raise ValueError("not a token file, or one that was cut off")
    long = struct.unpack("<I", tail[:4])[0]
    stream.seek(size - mark - 4 - long)
    footer = json.loads(stream.read(long))
    docs = footer["docs"]
    stream.seek(mark + footer["blocks"])
    keys, has, n = (np.frombuffer(stream.read(docs * w), t) for w, t in ((8, "<i8"), (1, np.uint8), (8, "<u8")))
    stream.seek(mark)

    def groups() -> Iterator[np.ndarray]:
        held = []
        for block in read_blocks(stream, footer["blocks"]):
            held.append(block)
            if len(held) == 64:
                yield np.concatenate(unpack(held, decode, dtype))
                held = []
        if held:
            yield np.concatenate(unpack(held, decode, dtype))

    return footer["first_token"], keys, has, n, groups()


ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
ROWS_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(folder: str, lengths: list[int], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        decode, dtype = decode_table(np.array(lengths, np.uint8)), np.dtype(f"<u{width}")
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            with store.open_input_file(f"{root}/{name}") as stream:
                start, keys, has, n, groups = decode_file(stream, stream.size(), decode, dtype)
                checks = np.zeros(len(n), np.int64)
                doc, left = 0, int(n[0]) if len(n) else 0
                for ids in groups:
                    wide, at = ids.astype("<u4"), 0
                    while at < len(wide):
                        step = min(left, len(wide) - at)
                        checks[doc] = zlib.crc32(wide[at : at + step], int(checks[doc]))
                        at, left = at + step, left - step
                        while not left and doc + 1 < len(n):
                            doc += 1
                            left = int(n[doc])
                n = n.astype(np.int64)
                yield table(ROWS, pa.array(keys, mask=has == 0), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(checks))

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from its decoded ids; a task reads whole files."""
    store, root = pafs.FileSystem.from_uri(folder)
    get = lambda name: json.loads(store.open_input_stream(f"{root}/{name}", compression=None).read())
    manifest, codebook = get("manifest.json"), get("codebook.json")
    if not manifest["files"]:
        return spark.createDataFrame([], ROWS_DDL)
    listed = spark.createDataFrame([(n,) for n in manifest["files"]], "name string").repartition(len(manifest["files"]))
    return listed.mapInArrow(_read(folder, codebook["lengths"], manifest["width"]), ROWS_DDL)


def token_file_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes token files in the shared folder and reads them back."""
    folder = uri(Workspace(docs.sparkSession, "token-output").path("files"))
    write_token_files(docs, folder, tokenizer, end_id, id_col, text_col, roll_bytes)
    return read_token_files(docs.sparkSession, folder)
