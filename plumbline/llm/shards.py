"""Training-order materialisation of token ids in fixed-stride binary shards.

Each text is tokenised and cut into sequences of `length` tokens, the last one ended by the end-of-text id and padded.
The k-th sequence of the table gets the global slot pi(k), where pi is a keyed Feistel permutation of the smallest power
of four that holds all sequences, walked along its cycles until it falls inside. Slot ranges are shards: files of equal
records, so that slot s is found at byte (s mod per_shard) * stride of shard s div per_shard, and a reader resumes at any
slot. A record is doc_id (int64), sequence number (int32), number of tokens (int32), then `length` little-endian ids of
`id_bytes` bytes each; a vocabulary whose ids need more is refused.

With `in_order` the k-th sequence is that in the order of the files and rows that docs is read from (a table written in
training order), and `window` permutes only within runs of that many slots, each with a key of its own: a curriculum
keeps its course to within a window.

Two passes over the table: the first counts the sequences of each run of rows, the second writes. Only these counts (one
row for each partition and file) pass through the driver; a check sum of each run's ids guards that both passes saw the
same rows. Sequences go to range partitions of neighbouring shards of about PART_BYTES, as many as the counted total
needs (at least four for each core), are sorted by slot, and stream into one shard file after the other. Shards are written under a temporary name and
renamed, so that a lost or doubled task leaves one whole file.

Null and empty texts become one sequence that holds the end-of-text id alone; a long text becomes many sequences.
Repeated rows are written as often as they occur. A null doc_id is written as the least int64. Columns beside id and text
are not read. An empty table writes no shard.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, column_bytes, mix, shared_dir

#: Public vocabulary as ranks, and what its texts are cut into before merges (fixed values).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50256
NO_ID = -(2**63)
#: Bytes of shards that a writing task makes at most; fewer where that would leave cores idle.
PART_BYTES = 64 << 20

class Tokenizer:
    """Byte-pair ids of whole Arrow columns: the distinct words of a batch are merged in one call, then looked up."""

    def __init__(self, path: str = VOCABULARY, id_bytes: int = 2):
        self.path, self.encoding, self.id_bytes = path, None, id_bytes

    def __getstate__(self):
        return {"path": self.path, "encoding": None, "id_bytes": self.id_bytes}

    @property
    def dtype(self):
        return np.dtype(f"<u{self.id_bytes}")

    def load(self):
        if self.encoding is None:
            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            if max(*ranks.values(), END_OF_TEXT) >= 1 << 8 * self.id_bytes:
                raise ValueError(f"ids of {self.path} don't fit into {self.id_bytes} bytes")
            self.encoding = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
            self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
            self.widths[list(ranks.values())] = [len(x) for x in ranks]
        return self.encoding

    def words(self, words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that may stand side by side without a change, and the n + 1 bounds of each word's ids."""
        data, offsets = column_bytes(words)
        ids = self.load().encode_to_numpy(data.tobytes().decode("utf-8"), disallowed_special=()) if len(data) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(self.widths[ids])])
        bounds = np.searchsorted(ends, offsets)
        if not np.array_equal(ends[bounds], offsets):
            raise RuntimeError("a token spans two words")
        return ids.astype(self.dtype), bounds

    def ids(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a column, and the n + 1 bounds of each text's ids."""
        import pyarrow as pa

        self.load()
        data, offsets = column_bytes(column)
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        # a single space between two solid characters always opens a piece. White space beyond ASCII starts with one of
        # the bytes C2, E1, E2, E3; C3 and one byte more are never white space
        blank = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
        after = ~blank & ~((data >= 0xE1) & (data <= 0xE3)) & (data != 0xC2)
        before = ~blank & (data < 0x80)
        before[1:] |= (data[1:] >= 0x80) & (data[:-1] == 0xC3)
        opens = np.zeros(len(data) + 1, bool)
        opens[1:-2] = (data[1:-1] == 32) & before[:-2] & after[2:]
        opens[offsets] = True
        cuts = np.flatnonzero(opens)
        words = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data.tobytes())])
        # the first word of a text lacks the space, and the last one may end in white space: these are merged singly
        ends = np.isin(cuts, offsets)
        single = ends[:-1] | (ends[1:] & blank[cuts[1:] - 1])
        inner = words.filter(pa.array(~single)).dictionary_encode()
        flat, bounds = self.words(inner.dictionary)
        edge = words.filter(pa.array(single)).dictionary_encode()
        lists = [self.encoding.encode_ordinary(w.decode("utf-8")) for w in edge.dictionary.to_pylist()]
        edge_bounds = np.cumsum([0, *map(len, lists)])
        first, n = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        for chosen, at, b, base in ((~single, inner.indices, bounds, 0), (single, edge.indices, edge_bounds, len(flat))):
            at = at.to_numpy()
            first[chosen], n[chosen] = base + b[:-1][at], np.diff(b)[at]
        flat = np.concatenate([flat, np.array([x for one in lists for x in one], dtype=self.dtype)])
        to = np.cumsum(n)
        out = flat[np.repeat(first - (to - n), n) + np.arange(to[-1])]
        return out, np.concatenate([[0], to])[np.searchsorted(cuts, offsets)]


def part_order(file: str) -> tuple[str, int, str]:
    """Sorts files as they were written: by folder, then by part number, as part-100000 comes after part-99999."""
    import re

    folder, _, name = file.rpartition("/")
    number = re.match(r"part-(\d+)", name)
    return folder, int(number[1]) if number else 0, name


def permute(k: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """pi(k) of each k in 0..size-1: a keyed Feistel network over 2 * half bits with cycle-walking."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, h = np.uint64(2**half - 1), np.uint64(half)
    with np.errstate(over="ignore"):
        keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))
        out = k.astype(np.uint64)
        todo = np.ones(len(out), bool)
        while todo.any():
            left, right = out[todo] >> h, out[todo] & mask
            for r in keys:
                left, right = right, left ^ (mix(right + r) & mask)
            out[todo] = (left << h) | right
            todo = out >= np.uint64(size)
    return out.astype(np.int64)


def permute_windows(k: np.ndarray, size: int, key: int, window: int | None) -> np.ndarray:
    """Slots of ascending k: pi over all of 0..size-1, or within each run of `window` of them."""
    if window is None:
        return permute(k, size, key)
    out = np.empty(len(k), np.int64)
    for w in np.unique(k // window).tolist():
        at = slice(*np.searchsorted(k, (w * window, (w + 1) * window)))
        out[at] = w * window + permute(k[at] - w * window, min(window, size - w * window), key + w)
    return out


def _sequences(tokenizer: Tokenizer, column, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bounds and number of sequences of each text of a column."""
    ids, bounds = tokenizer.ids(column)
    return ids, bounds, (np.diff(bounds) + length) // length


class Runs:
    """Rows of a partition as runs: pieces of batches within one file (or one partition), with the run's name and check sum."""

    def __init__(self):
        self.name, self.last, self.seen, self.check = None, None, 0, 0

    def of(self, batches):
        """Pieces of batches (text, id, file, row) of SLICE_BYTES each; a new run begins with a new file."""
        for b in batches:
            files = b.column(2).dictionary_encode() if b.num_rows else None
            edges = [0, *(np.flatnonzero(np.diff(files.indices.to_numpy())) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for i, j in zip(edges, edges[1:]):
                file, row = b.column(2)[i].as_py(), b.column(3)[i].as_py()
                if file != self.last:
                    self.name, self.last, self.seen, self.check = (file, row), file, 0, 0
                yield from byte_slices(b.slice(i, j - i))

    def add(self, ids: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            places = np.arange(self.seen, self.seen + len(ids), dtype=np.uint64)
            self.check = int(np.uint64(self.check) + mix(ids.view(np.uint64) + places).sum(dtype=np.uint64))
        self.seen += len(ids)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def located(spark: SparkSession, path: str) -> str:
    """path with the scheme and authority of the file system that Spark takes for it, as a small table written there shows;
    paths of the local file system, and those with a scheme, stay as they are."""
    if "://" in path or path.startswith("file:"):
        return path
    spark.range(1).write.mode("overwrite").parquet(f"{path}/_where")
    uri = spark.read.parquet(f"{path}/_where").inputFiles()[0]
    root = uri[: uri.index("/", uri.index("://") + 3)] if "://" in uri else "file:"
    return path if root.startswith("file:") else root + path


def write_shards(docs: DataFrame, path: str, length: int = 512, per_shard: int = 2048, key: int = 20240101, vocabulary: str = VOCABULARY, id_bytes: int = 2, in_order: bool = False, window: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Write the shards of docs below path; returns the number of sequences. Shuffles each sequence once, compressed."""
    place_of = [F.col("_metadata.file_path"), F.col("_metadata.row_index")] if in_order else [F.lpad(F.spark_partition_id().cast("string"), 9, "0"), F.lit(0).cast("long")]
    rows = docs.select(F.col(text_col).cast("string").alias("t"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), place_of[0].alias("file"), place_of[1].alias("row"))
    tokenizer = Tokenizer(vocabulary, id_bytes)
    tokenizer.load()

    def count(batches):
        import pyarrow as pa

        runs, found = Runs(), {}
        for piece in runs.of(batches):
            _, _, k = _sequences(tokenizer, piece.column(0), length)
            runs.add(piece.column(1).to_numpy())
            n, _ = found.get(runs.name, (0, 0))
            found[runs.name] = n + int(k.sum()), runs.check
        names = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in names], pa.string()), pa.array([r for _, r in names], pa.int64()), pa.array([found[x][0] for x in names], pa.int64()), pa.array([str(found[x][1]) for x in names], pa.string())], names=["file", "row", "n", "sum"])

    total, first, sums = 0, {}, {}
    for r in sorted(rows.mapInArrow(count, "file string, row long, n long, sum string").collect(), key=lambda r: (*part_order(r.file), r.row)):
        first[r.file, r.row], sums[r.file, r.row] = total, int(r["sum"])
        total += r.n
    if not total:
        return 0
    shards, stride = -(-total // per_shard), 16 + id_bytes * length
    shards_a_part = max(1, min(PART_BYTES // (per_shard * stride), shards // (4 * docs.sparkSession.sparkContext.defaultParallelism)))
    parts = -(-shards // shards_a_part)
    target = located(docs.sparkSession, path)

    def place(batches):
        import zlib

        import pyarrow as pa

        runs, run = Runs(), None

        def finished(name):
            if name is not None and runs_check[0] != sums.get(name):
                raise RuntimeError("the table changed between the two passes")

        runs_check, at = [0], 0
        for piece in runs.of(batches):
            if runs.name != run:
                finished(run)
                run, at = runs.name, first.get(runs.name, 0)
            ids, bounds, k = _sequences(tokenizer, piece.column(0), length)
            doc = piece.column(1).to_numpy()
            runs.add(doc)
            runs_check[0] = runs.check
            slots = permute_windows(np.arange(at, at + int(k.sum()), dtype=np.int64), total, key, window)
            at += int(k.sum())
            # each text's ids and the end of text, cut after every `length` ids
            flat = np.insert(ids, bounds[1:], END_OF_TEXT).astype(tokenizer.dtype).tobytes()
            text = np.repeat(np.arange(len(k)), k)
            seq = np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)
            starts = (bounds[:-1] + np.arange(len(k)))[text] + seq * length
            sizes = np.minimum(length, (bounds[1:] + np.arange(1, len(k) + 1))[text] - starts)
            heads = np.zeros(len(text), [("doc", "<i8"), ("seq", "<i4"), ("n", "<i4")])
            heads["doc"], heads["seq"], heads["n"] = doc[text], seq, sizes
            heads = heads.tobytes()
            records = [zlib.compress(heads[16 * j : 16 * j + 16] + flat[id_bytes * s : id_bytes * (s + m)], 1) for j, (s, m) in enumerate(zip(starts.tolist(), sizes.tolist()))]
            yield pa.RecordBatch.from_arrays([pa.array((slots // per_shard // shards_a_part).astype(np.int32)), pa.array(slots), pa.array(records, pa.binary())], names=["part", "slot", "record"])
        finished(run)

    def write(batches):
        """Records in the order of their slots: each shard is written when the next one begins."""
        import uuid
        import zlib

        import pyarrow as pa

        system, folder = _open(target)
        system.create_dir(folder, recursive=True)
        shard, block, filled, done = -1, None, 0, []

        def close():
            if shard < 0:
                return
            if filled != len(block):
                raise RuntimeError(f"shard {shard} has {filled} of {len(block)} sequences")
            name, temporary = f"{folder}/shard-{shard:09d}.bin", f"{folder}/_writing-{shard:09d}-{uuid.uuid4().hex}"
            with system.open_output_stream(temporary) as f:
                f.write(block.tobytes())
            system.move(temporary, name)
            done.append((shard, len(block)))

        for b in batches:
            for slot, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if slot // per_shard != shard:
                    close()
                    shard, filled = slot // per_shard, 0
                    block = np.zeros((min(per_shard, total - shard * per_shard), stride), np.uint8)
                x = np.frombuffer(zlib.decompress(record), np.uint8)
                block[slot % per_shard, : len(x)] = x
                filled += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.int64()), pa.array([n for _, n in done], pa.int64())], names=["shard", "n"])

    placed = rows.mapInArrow(place, "part int, slot long, record binary").repartitionById(parts, F.col("part")).sortWithinPartitions("slot")
    done = placed.select("slot", "record").mapInArrow(write, "shard long, n long")
    written = done.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("shards")).first()
    if (written.n, written.shards) != (total, shards):
        raise RuntimeError("not every shard was written")
    return total


def read_shards(spark: SparkSession, path: str, length: int = 512, per_shard: int = 2048, id_bytes: int = 2, first_slot: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, doc_id, seq_no, n_tokens, tokens) from first_slot on; earlier shards aren't opened."""
    stride = 16 + id_bytes * length
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(path)
    files = files.withColumn("shard", F.regexp_extract("path", r"shard-(\d+)\.bin", 1).cast("long")).where(F.col("shard") >= first_slot // per_shard)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)
                slots = np.arange(len(x), dtype=np.int64) + shard * per_shard
                x, slots = x[slots >= first_slot], slots[slots >= first_slot]
                if not len(slots):
                    continue
                doc = np.ascontiguousarray(x[:, :8]).view("<i8")[:, 0]
                head = np.ascontiguousarray(x[:, 8:16]).view("<i4")
                body = np.ascontiguousarray(x[:, 16:]).view(f"<u{id_bytes}").astype(np.int32)
                keep = np.arange(length)[None, :] < head[:, 1:2]
                ends = np.concatenate([[0], np.cumsum(head[:, 1])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(body[keep]))
                ids = pa.array(doc, mask=doc == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.full(len(slots), shard)), pa.array((slots % per_shard) * stride), ids, pa.array(head[:, 0]), pa.array(head[:, 1]), lists], names=["slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", "tokens"])

    return files.select("shard", "content").mapInArrow(run, "slot long, shard long, byte_offset long, doc_id long, seq_no int, n_tokens int, tokens array<int>")


def materialise(docs: DataFrame, **parameters) -> DataFrame:
    """Write docs to new shards in the shared folder and read them back."""
    spark = docs.sparkSession
    path = shared_dir(spark, "shards")
    total = write_shards(docs, path, **parameters)
    if not total:
        return spark.createDataFrame([], "slot long, shard long, byte_offset long, doc_id long, seq_no int, n_tokens int, tokens array<int>")
    return read_shards(spark, path, **{k: v for k, v in parameters.items() if k in ("length", "per_shard", "id_bytes")})
