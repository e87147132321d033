"""Token ids of a corpus in binary files, frequent tokens in one byte.

Ids are renumbered by falling corpus frequency and written byte-aligned: every
rank takes 1 to 4 little-endian bytes, and the lengths stand apart in control
bytes of four 2-bit codes each. A reader turns control bytes into lengths with
one table lookup, lengths into offsets with one running sum, and ranks back
into ids with another lookup; no value is parsed on its own.

Work runs in three Spark passes: texts are tokenised once into a Parquet table
of packed ids; the table is counted (one row per token and task, at most one
per vocabulary entry in all); it is range-partitioned by ``doc_id`` and coded
with the ranks file by file in that order. Tasks write under names of
their own, renamed when complete, and only files named in the manifest count,
so repeated or lost attempts leave the result alone. Files are read back by
Spark's ``binaryFile`` source.

Layout of a file, little-endian: magic (8 bytes), documents, ids, control
bytes (three u64); per document its id (i64), then a null flag each (u8), then
its number of ids (u64 each); control bytes, every document starting a new
one; data bytes; CRC-32 of all before (u32).
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsieve.llm.common import slices, texts
from tabsieve.plans.lineage import checkpoint_dir
from tabsieve.plans.ranking import cumulative_before

MAGIC = b"TSIDS001"
IDS_PER_FILE = 1 << 24  # a file ends with the document that reaches this
MEMO_BYTES = 144 << 20
WORDS_AT_ONCE = 100  # words given to the library in one string
WORDS_HELD = 20_000  # words whose encodings are held at once
DECODE_STEP = 1 << 18  # control bytes decoded at once
BROADCAST_FILES = 500_000  # manifest rows of about 100 bytes; more are joined by a shuffle
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)
TABLE_SCHEMA = "doc_id long, n_tokens long, ids binary"
FILE_SCHEMA = "part int, seq int, name string, n_docs long, n_ids long"
READ_SCHEMA = "name string, at long, doc_id long, n_tokens long, ids binary"

# A space next to text starts a new word of the byte-level splitter; only a
# space inside a longer run of white space may not be cut off.
_WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_CROWDED = f"{_WHITE} {_WHITE}|{_WHITE} $"
_SAFE_CUT = re.compile(r"(?<=\S)(?= )|(?= \S)")
# words of Latin letters and marks after them are split apart by the splitter too
_MARKS = ".,;:!?"
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_WORD = re.compile(f" ?{_LETTERS}")
_LINES = re.compile(f" ?{_LETTERS}[{_MARKS}]*(?:\n{_LETTERS}[{_MARKS}]*)+")
_PARTS = re.compile(f" ?{_LETTERS}|[{_MARKS}]+|\n")


def _gather(flat: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``flat`` named by ``code`` one after another, and where each ends."""
    starts = np.cumsum(lengths) - lengths
    n = lengths[code]
    ends = np.cumsum(n)
    at = np.repeat(starts[code] - (ends - n), n)
    at += np.arange(len(at))
    return flat[at], ends


def _strings(column: pa.Array) -> list[str]:
    try:
        return column.to_numpy(zero_copy_only=False).tolist()
    except (UnicodeDecodeError, pa.ArrowException):  # bytes that are no UTF-8
        return [t.decode("utf-8", "replace") for t in texts(column)]


class _Shown(dict):
    """How a byte-level tokenizer shows a character to its model."""

    def __init__(self, library):
        self.library = library

    def __missing__(self, character: int) -> str:
        text = self[character] = self.library.pre_tokenizer.pre_tokenize_str(chr(character))[0][0]
        return text


class Tokenizer:
    """Texts to packed ids through the ``tokenizers`` library, with a memo of
    the pieces seen (bounded by bytes).

    A byte-level tokenizer without a normaliser treats the pieces between safe
    cuts independently, so each distinct piece is given to the library once;
    with any other tokenizer whole texts are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Library.from_file(path)
        spec = json.loads(self.library.to_str())
        split = spec.get("pre_tokenizer") or {}
        self.cuts = (split.get("type") == "ByteLevel" and split.get("use_regex", True)
                     and not split.get("add_prefix_space") and not spec.get("normalizer")
                     and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"[\s.,;:!?]", t["content"])
                                 for t in spec["added_tokens"]))
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.shown = _Shown(self.library)
        self.model = Library(self.library.model)  # the model alone, on words that single spaces part
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)  # tokens that begin with a space
        self.begins[[i for t, i in vocabulary.items() if t.startswith(self.shown[32])]] = self.cuts
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.memo: dict[str, bytes] = {"": b""}
        self.memo_bytes = 0

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, strings: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Packed ids of words with a space before them. The model reads many
        in one string, and a token that begins with a space begins a word."""
        shown, space = self.shown, self.shown[32]
        text = [space + w[1:] if w.isascii() else w.translate(shown) for w in words]
        found = self.model.encode_batch_fast([" ".join(text[k:k + WORDS_AT_ONCE]) for k in range(0, len(text), WORDS_AT_ONCE)],
                                             add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, dtype=self.kind) for e in found])
        at = np.flatnonzero(self.begins[ids])
        if len(at) != len(words):  # a model that leaves out or renames the space
            return [self.pack([t.id for t in self.library.model.tokenize(w)]) for w in text]
        raw, cut = ids.tobytes(), [*(at * self.kind.itemsize).tolist(), ids.nbytes]
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def _learn(self, pieces: list[str]) -> None:
        """Adds pieces to the memo. Words go to the library's model at once, as
        its splitter leaves them whole; words and marks around single line
        breaks are put together from their parts; all else is encoded."""
        tokens, shown = self.library.model.tokenize, self.shown
        memo, rest, lines = self.memo, [], {}
        spaced = np.array(pc.match_substring_regex(pa.array(pieces, pa.string()), f"^ {_LETTERS}$"))
        words = list(compress(pieces, spaced.tolist()))
        for k in range(0, len(words), WORDS_HELD):
            memo.update(zip(words[k:k + WORDS_HELD], self._spaced(words[k:k + WORDS_HELD])))
        for p in compress(pieces, (~spaced).tolist()):
            if _WORD.fullmatch(p):
                memo[p] = self.pack([t.id for t in tokens(p if p.isascii() else p.translate(shown))])
            elif _LINES.fullmatch(p):
                lines[p] = _PARTS.findall(p)
            else:
                rest.append(p)
        memo.update(zip(rest, self._whole(rest)))
        parts = {q for own in lines.values() for q in own if q not in memo}
        if parts:
            self._learn(list(parts))
        memo.update((p, b"".join([memo[q] for q in own])) for p, own in lines.items())
        self.memo_bytes += 220 * len(pieces) + 3 * sum(map(len, pieces))

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of every piece."""
        if self.memo_bytes > MEMO_BYTES:
            self.memo = {"": b""}
            self.memo_bytes = 0
        out = list(map(self.memo.get, pieces))
        if None in out:
            at = [k for k, ids in enumerate(out) if ids is None]
            new = list(dict.fromkeys([pieces[k] for k in at]))
            self._learn(new)
            for k in at:
                out[k] = self.memo[pieces[k]]
        return out

    def _table(self, words: pa.Array, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (with a space before them where ``spaced``),
        and their number per word. Marks at the end of a word go apart."""
        bodies = pc.utf8_rtrim(words, characters=_MARKS)
        split = pc.match_substring_regex(bodies, f"^{_LETTERS}$")
        before = pa.array([" ", ""]).take(pa.array(np.where(spaced, 0, 1)))
        numbered = pc.binary_join_element_wise(before, pc.if_else(split, bodies, words), "").dictionary_encode()
        body = np.array(numbered.indices).astype(np.int64)
        ids = self.pieces(_strings(numbered.dictionary))
        trimmed = np.array(pc.binary_length(words)) - np.array(pc.binary_length(bodies))
        tailed = np.flatnonzero((trimmed > 0) & np.array(split))
        marks = pc.replace_substring_regex(words.take(pa.array(tailed)), f"^{_LETTERS}", "").dictionary_encode()
        tail = np.zeros(len(words), dtype=np.int64)  # part 0 is empty
        tail[tailed] = 1 + len(ids) + np.array(marks.indices)
        ids = [b"", *ids, *self.pieces(_strings(marks.dictionary))]
        lengths = np.array([len(i) for i in ids], dtype=np.int64) // self.kind.itemsize
        flat, ends = _gather(np.frombuffer(b"".join(ids), self.kind), lengths, np.stack([body + 1, tail], axis=1).ravel())
        return flat, np.diff(ends[1::2], prepend=0)

    def _words(self, column: pa.Array) -> list[bytes]:
        """Texts cut at every space: Arrow numbers the distinct words, the memo
        gives their ids, and numpy lays these out text by text."""
        if not len(column):
            return []
        lists = pc.split_pattern(column, " ")
        counts = np.array(lists.value_lengths())
        numbered = lists.flatten().dictionary_encode()
        code = np.array(numbered.indices).astype(np.int64)
        n, ends = len(numbered.dictionary), np.cumsum(counts)
        code[ends - counts] += n  # the first word of a text has no space before it
        seen = np.zeros(2 * n, dtype=bool)
        seen[code] = True
        used, code = np.flatnonzero(seen), (np.cumsum(seen) - 1)[code]
        flat, lengths = self._table(numbered.dictionary.take(pa.array(used % n)), used < n)
        ids, upto = _gather(flat, lengths, code)
        raw = ids.tobytes()
        cut = [0, *(upto[ends - 1] * self.kind.itemsize).tolist()]
        return [raw[a:b] for a, b in zip(cut, cut[1:])]

    def encode(self, column: pa.Array) -> list[bytes]:
        """Packed ids of an Arrow text column; null is the empty text."""
        column = column.fill_null("")
        if not self.cuts:
            return self._whole(_strings(column))
        crowded = pc.match_substring_regex(column, _CROWDED)
        out = iter(self._words(column.filter(pc.invert(crowded))))
        rest = iter(_strings(column.filter(crowded)))
        return [b"".join(self.pieces(_SAFE_CUT.split(next(rest)))) if c else next(out) for c in crowded.to_pylist()]


_tokenizers: dict[str, Tokenizer] = {}  # one a Python worker


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def encode_table(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """``doc_id, n_tokens, ids`` (packed unsigned ids, ``end_id`` last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        end = own.pack([end_id])
        for batch in batches:
            for part in slices(batch, 6 << 20):
                ids = [i + end for i in own.encode(part.column(1))]
                counts = pa.array([len(i) // own.kind.itemsize for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(ids, pa.binary())],
                                                 ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TABLE_SCHEMA)


def token_counts(table: DataFrame, kind: np.dtype, size: int) -> DataFrame:
    """``token, n`` over packed ids; a task sends a row per token it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 4 << 20):
                total += np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], ["token", "n"])

    return (table.select("ids").mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")))


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of documents that hold ``counts`` of the ranks each."""
    ranks = ranks.astype("<u4")
    code = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    n_control = -(-counts // 4)
    moved = 4 * (np.cumsum(n_control) - n_control) - (np.cumsum(counts) - counts)
    slots = np.zeros(4 * int(n_control.sum()), dtype=np.uint8)
    slots[np.arange(len(ranks)) + np.repeat(moved, counts)] = code
    control = (slots[0::4] | slots[1::4] << 2 | slots[2::4] << 4 | slots[3::4] << 6).tobytes()
    return control, ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of documents whose control and data bytes stand one after another."""
    n_control = -(-counts // 4)
    last = 4 * np.cumsum(n_control)  # slots behind each document's own
    unused = np.concatenate([last[(4 * n_control - counts) > k] - 1 - k for k in range(3)])
    unused.sort()
    out = np.empty(int(counts.sum()), dtype=np.uint32)
    data = np.concatenate([data, np.zeros(4, dtype=np.uint8)])
    at = done = 0
    for c in range(0, len(control), DECODE_STEP):
        lengths = LENGTHS[control[c:c + DECODE_STEP]].ravel()
        lo, hi = np.searchsorted(unused, [4 * c, 4 * c + len(lengths)])
        used = np.ones(len(lengths), dtype=bool)
        used[unused[lo:hi] - 4 * c] = False
        lengths = lengths[used]
        ends = at + np.cumsum(lengths, dtype=np.int64)
        starts = ends - lengths
        values = data[starts].astype(np.uint32)
        more = np.arange(len(lengths))
        for k in range(1, 4):
            more = more[lengths[more] > k]
            values[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
        out[done:done + len(values)] = values
        done += len(values)
        at = int(ends[-1]) if len(ends) else at
    return out


def file_bytes(doc_ids: list[int | None], ids: list[bytes], rank_of: np.ndarray, kind: np.dtype) -> bytes:
    """One file of the documents' packed ids."""
    counts = np.array([len(i) // kind.itemsize for i in ids], dtype=np.int64)
    control, data = [], []
    a = 0
    while a < len(ids):  # coded in steps of about a million ids
        b = max(a + 1, int(np.searchsorted(np.cumsum(counts[a:]), 1 << 20)) + a)
        for to, some in zip((control, data), pack(rank_of[np.frombuffer(b"".join(ids[a:b]), kind)], counts[a:b])):
            to.append(some)
        a = b
    sizes = np.array([len(ids), counts.sum(), sum(map(len, control))], dtype="<u8").tobytes()
    body = b"".join((MAGIC, sizes, np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
                     bytes(d is None for d in doc_ids), counts.astype("<u8").tobytes(), *control, *data))
    return body + zlib.crc32(body).to_bytes(4, "little")


def parse_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids (null: None), numbers of ids and ranks of one file."""
    if raw[:8] != MAGIC or zlib.crc32(memoryview(raw)[:-4]) != int.from_bytes(raw[-4:], "little"):
        raise ValueError("not a token file, or damaged")
    n, _, n_control = (int(x) for x in np.frombuffer(raw, "<u8", 3, 8))
    doc_ids = np.frombuffer(raw, "<i8", n, 32).tolist()
    nulls = np.frombuffer(raw, np.uint8, n, 32 + 8 * n)
    counts = np.frombuffer(raw, "<u8", n, 32 + 9 * n).astype(np.int64)
    at = 32 + 17 * n
    control = np.frombuffer(raw, np.uint8, n_control, at)
    data = np.frombuffer(raw, np.uint8, len(raw) - 4 - at - n_control, at + n_control)
    return [None if z else d for d, z in zip(doc_ids, nulls)], counts, unpack(control, data, counts)


def _writer(folder: str, rank_of: np.ndarray, kind: np.dtype, ids_per_file: int,
            ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        attempt = uuid.uuid4().hex
        part, seq, n = 0, 0, 0
        doc_ids: list[int | None] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            name = f"{part:06d}-{seq:06d}-{attempt}.ids"
            with store.open_output_stream(f"{base}/{name}.part") as out:
                out.write(file_bytes(doc_ids, held, rank_of, kind))
            store.move(f"{base}/{name}.part", f"{base}/{name}")
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "name": [name],
                 "n_docs": [len(held)], "n_ids": [n]})

        for batch in batches:
            for doc_id, ids, part in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "ids", "part")]):
                doc_ids.append(doc_id)
                held.append(ids)
                n += len(ids) // kind.itemsize
                if n >= ids_per_file:
                    yield close()
                    seq, n, doc_ids, held = seq + 1, 0, [], []
        if held:
            yield close()

    return run


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0,
                      ids_per_file: int = IDS_PER_FILE) -> None:
    """Writes ``doc_id, text`` as token files under ``folder``, which must be
    shared and open to pyarrow (a mounted path, HDFS or an object store).

    Documents follow each other by ascending doc_id, a null id first; rows of
    one id by number of ids, then CRC-32 of the packed ids. A null text is an empty
    one and has the end id alone; repeated rows are documents of their own. An
    empty table gives a manifest without files. Other columns are not read. A
    text is one row throughout, however long; a worker holds the ids of a
    batch and of one file."""
    spark = docs.sparkSession
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{base}/files", recursive=True)
    own = tokenizer(tokenizer_path)
    encode_table(docs, tokenizer_path, end_id).write.option("compression", "zstd").parquet(f"{folder}/table")
    table = spark.read.schema(TABLE_SCHEMA).parquet(f"{folder}/table")
    counts = token_counts(table, own.kind, own.size)
    counts.write.parquet(f"{folder}/counts")
    rank_of = np.zeros(own.size, dtype=np.uint32)
    by_rank = ranked_tokens(spark, folder)
    rank_of[by_rank] = np.arange(len(by_rank))
    total = int(spark.read.parquet(f"{folder}/counts").agg(F.sum("n")).first()[0] or 0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ids_per_file))
    order = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("text_key")]
    # the row number in its task tells equal rows apart, so that a crowd of them is split too
    ranged = table.withColumn("text_key", F.crc32("ids")).withColumn("tag", F.monotonically_increasing_id())
    ranged = ranged.repartitionByRange(parts, *order, F.col("tag"))
    ranged = ranged.withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)
    files = ranged.select("doc_id", "ids", "part").mapInArrow(
        _writer(f"{folder}/files", rank_of, own.kind, ids_per_file), FILE_SCHEMA)
    files.write.parquet(f"{folder}/manifest")
    _delete(spark, f"{folder}/table")


def ranked_tokens(spark: SparkSession, folder: str) -> np.ndarray:
    """Tokens by falling count, equal counts by id: a vocabulary at most."""
    rows = spark.read.schema("token int, n long").parquet(f"{folder}/counts").collect()
    return np.array([t for t, _ in sorted(rows, key=lambda r: (-r[1], r[0]))], dtype=np.uint32)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (unsigned 32-bit little-endian) of
    every document in the files under ``folder``."""
    by_rank = ranked_tokens(spark, folder)
    manifest = spark.read.schema(FILE_SCHEMA).parquet(f"{folder}/manifest")
    before = cumulative_before(manifest, [F.col("part"), F.col("seq")], weight="n_ids").select(
        "name", F.col("cum_before").alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, counts, ranks = parse_file(raw.as_buffer().to_pybytes())
                ids = by_rank[ranks].astype("<u4")
                ends = np.cumsum(counts)
                step = max(1, len(doc_ids) * (1 << 20) // max(1, len(ids)))  # rows of about 4 MB of ids
                for a in range(0, len(doc_ids), step):
                    b = min(a + step, len(doc_ids))
                    cells = [ids[e - c:e].tobytes() for c, e in zip(counts[a:b].tolist(), ends[a:b].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * (b - a)), pa.array(ends[a:b] - counts[a:b]),
                         pa.array(doc_ids[a:b], pa.int64()), pa.array(counts[a:b]), pa.array(cells, pa.binary())],
                        ["name", "at", "doc_id", "n_tokens", "ids"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(f"{folder}/files")
    rows = raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, READ_SCHEMA)
    if manifest.count() <= BROADCAST_FILES:
        before = F.broadcast(before)
    return rows.join(before, "name").select("doc_id", (F.col("before") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids")


def token_report(docs: DataFrame, tokenizer_path: str, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, from the files,
    which are written into the session's shared folder."""
    spark = docs.sparkSession
    shared = checkpoint_dir(spark) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared.rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, folder, tokenizer_path, ids_per_file=ids_per_file)
    read = read_token_files(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
