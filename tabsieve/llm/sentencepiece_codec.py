"""SentencePiece encoding and decoding with a shared-prefix Viterbi.

A text gets a leading space and is cut where no piece can cross: before each
run of spaces and around line feeds. The distinct marked words of a batch are
sorted, which is a depth-first walk of their trie: going from one word to the
next, the forward scores of the common prefix stay on the stack and only the
rest is computed. Texts are then put together from the words' ids.

Pieces and scores come from a public vocabulary file whose path is a
parameter. Characters without a piece become byte pieces, so decoding gives
back every text exactly.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabsieve.llm.common import slices

MARK = "▁"
MODEL = "piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0


def model_path(name: str = MODEL) -> str:
    """Where the installed public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


REMEMBER_BYTES = 64 << 20


class Codec:
    """Best-score segmentation over the pieces of one vocabulary file."""

    def __init__(self, path: str, remember: int = 300_000) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.score: dict[str, tuple[float, int]] = {}
        self.byte_id = [-1] * 256
        self.spelled: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.spelled.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.spelled.append(b"")
            else:
                piece = piece.replace(MARK, " ")
                self.score[piece] = (sp.get_score(i), i)
                self.spelled.append(piece.encode())
        if min(self.byte_id) < 0:
            raise ValueError("the vocabulary has no byte pieces; decoding could not be exact")
        if any(" " in p.lstrip(" ") for p in self.score):
            raise ValueError("a piece crosses a word boundary")
        self.unknown = min((s for s, _ in self.score.values()), default=0.0) - UNKNOWN_PENALTY
        # every piece, and every suffix of one (None): where a leftward search may go on
        self.ending: dict[str, tuple[float, int] | None] = {p[k:]: None for p in self.score for k in range(1, len(p))}
        self.ending.update(self.score)
        feed = any("\n" in p for p in self.score)
        self.cut = re.compile(r" +[^ ]*|[^ ]+" if feed else r" +[^ \n]*|\n+|[^ \n]+")
        self.remember, self.known, self.known_bytes = remember, {}, 0

    def words(self, text: str) -> list[str]:
        """Marked words (a space stands for the mark) that make up a text."""
        return self.cut.findall(" " + text) if text else []

    def best(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Sorted distinct words -> their ids as little-endian 32-bit numbers.
        Equal scores prefer the longer last piece."""
        ending, unknown = self.ending, self.unknown
        # 20 bytes a character, so that a long run without spaces fits as well
        last, score, origin, chosen = "", array("d", [0.0]), array("q", [0]), array("i", [-1])
        for word in words:
            shared, top = 0, min(len(last), len(word))
            while shared < top and last[shared] == word[shared]:
                shared += 1
            del score[shared + 1:], origin[shared + 1:], chosen[shared + 1:]
            for j in range(shared + 1, len(word) + 1):
                found, start, piece_id = score[j - 1] + unknown, j - 1, -1
                for i in range(j - 1, -1, -1):
                    piece = ending.get(word[i:j], 0)
                    if piece is None:
                        continue
                    if piece == 0:
                        if i == j - 1:
                            continue
                        break
                    s = score[i] + piece[0]
                    if s >= found:
                        found, start, piece_id = s, i, piece[1]
                score.append(found)
                origin.append(start)
                chosen.append(piece_id)
            ids, j = array("i"), len(word)
            while j > 0:
                i, piece_id = origin[j], chosen[j]
                if piece_id >= 0:
                    ids.append(piece_id)
                else:
                    ids.extend(self.byte_id[b] for b in reversed(word[i:j].encode()))
                j = i
            ids.reverse()
            last = word
            yield word, ids.tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Packed ids of every text; null stays null, the empty text has none."""
        split = [None if t is None else self.words(t) for t in texts]
        if len(self.known) > self.remember or self.known_bytes > REMEMBER_BYTES:
            self.known, self.known_bytes = {}, 0
        fresh = {w for ws in split if ws for w in ws}.difference(self.known)
        self.known.update(self.best(sorted(fresh)))
        self.known_bytes += 5 * sum(map(len, fresh))
        known = self.known
        return [None if ws is None else b"".join([known[w] for w in ws]) for ws in split]

    def decode(self, ids: bytes) -> str:
        """Text of packed ids."""
        spelled = self.spelled
        data = b"".join([spelled[i] for i in np.frombuffer(ids, dtype="<i4").tolist()])
        return data[1:].decode("utf-8", "replace") if data else ""


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker process and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _lists(packed: list[bytes | None]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) // 4 if p else 0 for p in packed)])
    flat = pa.array(np.frombuffer(b"".join([p or b"" for p in packed]), dtype="<i4"), pa.int32())
    out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([p is None for p in packed]))
    return out


def _kind(docs: DataFrame, name: str) -> str:
    return f"`{name}` {docs.schema[name].dataType.simpleString()}"


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_pieces, ids`` per document: whole texts, one row each.
    A null text has null ids and no pieces, an empty text no ids. Repeated
    rows and null ids stay. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            work = codec(vocabulary or model_path())
            for batch in slices(whole, 8 << 20):
                packed = work.encode(batch.column("text").to_pylist())
                n = pa.array([len(p) // 4 if p else 0 for p in packed], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, _lists(packed)],
                                                 ["doc_id", "n_pieces", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"{_kind(docs, 'doc_id')}, n_pieces long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            work = codec(vocabulary or model_path())
            for batch in slices(whole, 8 << 20):
                out = [None if ids is None else work.decode(array("i", ids).tobytes())
                       for ids in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())],
                                                 ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"{_kind(encoded, 'doc_id')}, text string")


def codec_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_pieces, n_byte_pieces, ids_sha256, round_trip`` per
    document, encoded and decoded in one pass where the text already is: the
    digest of its ids (32-bit little-endian) and whether decoding them gave
    back the text. Null texts: no pieces, null digest, a true round trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            work = codec(vocabulary or model_path())
            is_byte = np.zeros(len(work.spelled), dtype=bool)
            is_byte[work.byte_id] = True
            for batch in slices(whole, 8 << 20):
                texts = batch.column("text").to_pylist()
                rows = [(0, 0, None, True) if p is None else
                        (len(p) // 4, int(is_byte[np.frombuffer(p, "<i4")].sum()), sha256(p).hexdigest(),
                         work.decode(p) == t) for p, t in zip(work.encode(texts), texts, strict=True)]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
                cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], [
                    "doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"{_kind(docs, 'doc_id')}, n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean")
