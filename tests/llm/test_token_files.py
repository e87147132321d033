"""Token files: the coding, the files' order and content, against the library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabsieve.llm import token_files

from .helpers import SCHEMA, documents, empty, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def slow_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_pieces_give_the_ids_of_whole_texts(library):
    rng = random.Random(3)
    parts = [" ", " the", "über", ",", "...", " word.\nNext", "\n", "\t", "\r", "a", "Bc", "12", "'s", "é", "　", "\x1c", "\u0085", "<|endoftext|>", "!?", "漢"]
    strings = [r[1] or "" for r in rows()] + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)]
    own = token_files.Tokenizer(PATH)
    assert own.cuts
    for _ in range(2):  # fresh, then from the memo
        found = [np.frombuffer(i, own.kind).tolist() for i in own.encode(pa.array(strings))]
        assert found == [e.ids for e in library.encode_batch(strings, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(12))
def test_control_and_data_bytes_round_trip(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 11, size=rng.integers(0, 60)).astype(np.int64)
    n = int(counts.sum())
    ranks = (rng.integers(0, 1 << 32, size=n, dtype=np.uint64) >> (8 * rng.integers(0, 4, size=n, dtype=np.uint64)))
    ranks = ranks.astype(np.uint32)
    control, data = token_files.pack(ranks, counts)
    assert len(control) == sum(-(-c // 4) for c in counts)
    assert len(data) == sum(max(1, (int(r).bit_length() + 7) // 8) for r in ranks)
    monkeypatch.setattr(token_files, "DECODE_STEP", 1 + seed)
    back = token_files.unpack(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), counts)
    assert (back == ranks).all()


@pytest.mark.parametrize("ids_per_file", [token_files.IDS_PER_FILE, 40])
def test_report_matches_the_library(spark, library, ids_per_file):
    expected, start = [], 0
    ids = [(r[0], slow_ids(library, r[1])) for r in rows()]
    for doc_id, own in sorted(ids, key=lambda r: (r[0] is not None, r[0], len(r[1]), zlib.crc32(
            np.array(r[1], dtype="<u2").tobytes()))):
        expected.append((doc_id, start, len(own), crc(own)))
        start += len(own)
    found = token_files.token_report(documents(spark), PATH, ids_per_file).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected


def test_real_ids_and_long_text(spark, library, tmp_path):
    long = "A very long text, word by word. " * 60_000 + "x" * 50_000
    docs = spark.createDataFrame([(2, long), (1, "short"), (None, None)], "doc_id long, text string")
    token_files.write_token_files(docs, str(tmp_path / "out"), PATH, end_id=50256, ids_per_file=100)
    out = {r["doc_id"]: r for r in token_files.read_token_files(spark, str(tmp_path / "out")).collect()}
    for doc_id, text in ((None, ""), (1, "short"), (2, long)):
        ids = library.encode(text, add_special_tokens=False).ids + [50256]
        assert np.frombuffer(out[doc_id]["ids"], "<u4").tolist() == ids
    assert [out[k]["start"] for k in (None, 1, 2)] == [0, 1, 1 + out[1]["n_tokens"]]
    assert not (tmp_path / "out" / "table").exists()


def test_leftovers_of_lost_attempts_are_ignored_and_damage_is_not(spark, tmp_path):
    token_files.write_token_files(documents(spark), str(tmp_path), PATH)
    files = sorted((tmp_path / "files").glob("*.ids"))
    whole = files[-1].read_bytes()
    (tmp_path / "files" / "000000-000000-other.ids").write_bytes(whole)
    (tmp_path / "files" / "000000-000001-cut.ids.part").write_bytes(whole[:20])
    assert token_files.read_token_files(spark, str(tmp_path)).count() == len(rows())
    files[-1].write_bytes(whole[:-1] + b"\x01\x02")
    with pytest.raises(Exception, match="damaged"):
        token_files.read_token_files(spark, str(tmp_path)).collect()


def test_frequent_tokens_take_one_byte(spark, tmp_path):
    docs = spark.createDataFrame([(i, "zebra " * 50) for i in range(20)], "doc_id long, text string")
    token_files.write_token_files(docs, str(tmp_path), PATH)
    for f in (tmp_path / "files").glob("*.ids"):
        _, counts, ranks = token_files.parse_file(f.read_bytes())
        assert ranks.max() < 10


def test_empty_table_and_one_crowded_id(spark):
    assert token_files.token_report(empty(spark), PATH).count() == 0
    same = spark.createDataFrame([(None, "same", None, None, None, None, None, None)] * 300, SCHEMA)
    out = token_files.token_report(same, PATH, ids_per_file=64).collect()
    assert sorted(r["start"] for r in out) == list(range(0, 600, 2)) and len({r["ids_crc32"] for r in out}) == 1


def invented(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgXYZéüłß") for _ in range(rng.randrange(1, 12))) for _ in range(n)]


class Counted:
    """A library whose model notes each word it is asked for alone."""

    def __init__(self, library):
        self.library, self.model, self.alone = library, self, []

    def tokenize(self, word):
        self.alone.append(word)
        return self.library.model.tokenize(word)

    def __getattr__(self, name):
        return getattr(self.library, name)


@pytest.mark.parametrize("held", [token_files.WORDS_HELD, 130])
def test_new_words_reach_the_library_many_at_once(library, monkeypatch, held):
    monkeypatch.setattr(token_files, "WORDS_HELD", held, raising=False)
    strings = [" ".join(invented(400, seed)) for seed in range(5)]
    own = token_files.Tokenizer(PATH)
    own.library = Counted(own.library)
    found = [np.frombuffer(i, own.kind).tolist() for i in own.encode(pa.array(strings))]
    assert found == [e.ids for e in library.encode_batch(strings, add_special_tokens=False)]
    assert len(own.library.alone) <= len(strings)  # the first word of a text has no space before it


def test_words_of_a_model_without_space_tokens_are_read_alone(library):
    words = [" " + w for w in invented(300)]
    own = token_files.Tokenizer(PATH)
    together = own._spaced(words)
    own.begins[:] = False
    assert own._spaced(words) == together == own._whole(words)


def test_strings_that_are_no_utf8_are_mended():
    raw = b"ab\xff\xfe cd"
    column = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(np.array([0, 2, len(raw)], "<i4")), pa.py_buffer(raw)])
    assert token_files._strings(column) == ["ab", "\ufffd\ufffd cd"]
