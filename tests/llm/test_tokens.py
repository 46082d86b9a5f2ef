"""Token output, packing, token counts and SentencePiece encoding against the libraries and brute force."""

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import common, packing, sentencepieces, token_counts, token_output
from corpusloom.llm.lattice import pieces
from corpusloom.llm.pretokens import ChunkEncoder

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def encoders():
    return {p: (ChunkEncoder(p), Tokenizer.from_file(p)) for p in (BYTE, WORD)}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Zé'19.,!\n\t  _日Σς½\x1c<|>ſİ")), max_size=40))
def test_chunks_encode_as_the_library_does(encoders, text):
    for mine, library in encoders.values():
        assert np.frombuffer(mine.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def ids_of(path, text):
    t = Tokenizer.from_file(path)
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def test_token_files_hold_every_document_in_order(spark, messy, messy_rows, tmp_path):
    manifest = token_output.write_token_files(messy, f"file://{tmp_path}/ids", BYTE, shard_docs=20)
    rows = sorted(token_output.read_token_files(manifest).collect(), key=lambda r: r["start"])
    assert manifest.count() > 1
    order = sorted(messy_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for row, (doc_id, text, *_) in zip(rows, order, strict=True):
        ids = ids_of(BYTE, text)
        assert (row["doc_id"], row["start"], row["n_tokens"]) == (doc_id, start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    wanted = spark.createDataFrame([(3,), (110,), (999,)], "doc_id long")
    got = {r["doc_id"]: r["ids"] for r in token_output.read_documents(manifest, wanted).collect()}
    texts = {r[0]: r[1] for r in messy_rows}
    assert got == {k: ids_of(BYTE, texts[k]) for k in (3, 110)}


def test_token_file_is_plain_zstandard_and_checks_its_frames(tmp_path):
    import pyarrow as pa
    import zstandard

    with open(tmp_path / "x", "wb") as f:
        writer = token_output.FrameWriter(f)
        for k, data in ((1, b"abcd" * 9), (None, b""), (7, b"wxyz")):
            writer.add(k, data)
        writer.close()
    whole = (tmp_path / "x").read_bytes()
    with zstandard.ZstdDecompressor().stream_reader(whole, read_across_frames=True) as r:
        assert r.read() == b"abcd" * 9 + b"wxyz"
    reader = token_output.SeekReader(pa.PythonFile(open(tmp_path / "x", "rb"), mode="r"))
    assert [reader.frame(i) for i in reader.find(7)] == [b"wxyz"] and reader.find(None) == [1]
    broken = bytearray(whole)
    broken[8] ^= 1
    (tmp_path / "y").write_bytes(bytes(broken))
    reader = token_output.SeekReader(pa.PythonFile(open(tmp_path / "y", "rb"), mode="r"))
    with pytest.raises(Exception):
        reader.frame(0)


def test_empty_tables(no_docs, tmp_path):
    assert token_output.read_token_files(token_output.write_token_files(no_docs, f"file://{tmp_path}/none", BYTE)).count() == 0
    assert packing.pack_documents(no_docs, WORD).count() == 0
    assert token_counts.token_counts(no_docs, PIECE).count() == 0
    assert sentencepieces.encode_and_verify(no_docs, PIECE).count() == 0


def check_packed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_keeps_every_token_once(messy, messy_rows):
    rows = packing.pack_documents(messy, WORD, 256).collect()
    n = check_packed(rows, 256)
    assert n - -(-sum(r["length"] for r in rows) // 256) <= 1
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc_id, text, *_ in messy_rows:
        if doc_id is None or doc_id == 5:
            continue
        ids, at = ids_of(WORD, text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["piece"]):
            assert r["start"] == at and (r["length"] == 256 or at + r["length"] == len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert len(by_doc[5]) == 2 * len({r["piece"] for r in by_doc[5]})


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=8), st.integers(0, 40))
def test_fullest_is_the_largest_subset_sum(counts, room):
    chosen = packing.fullest(counts, room)
    assert all(n <= counts[k] for k, n in chosen)
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1)}
    assert sum(k * n for k, n in chosen) == max(s for s in sums if s <= room)


SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "  ", "a", "The", "\n", "é", "1"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(SPECIAL), max_size=9).map("".join))
def test_strings_of_special_tokens_encode_as_the_library_does(encoders, text):
    for path, (mine, library) in encoders.items():
        assert np.frombuffer(mine.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        if path not in _as_text:
            _as_text[path] = ChunkEncoder(path, special_as_text=True), Tokenizer.from_file(path)
            _as_text[path][1].encode_special_tokens = True
        mine, library = _as_text[path]
        assert np.frombuffer(mine.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


_as_text = {}


def test_encoding_is_the_library_s_and_comes_back_whole(messy, messy_rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    encoded = sentencepieces.encode(messy, PIECE).collect()
    counts = {(r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(messy, PIECE).collect()}
    for row, (doc_id, text, *_) in zip(encoded, messy_rows, strict=True):
        assert row["doc_id"] == doc_id and (doc_id, row["n_tokens"]) in counts
        if text is None:
            assert row["ids"] is None and row["n_tokens"] is None
            continue
        assert sentencepieces.decode_ids(row["ids"], PIECE) == text
        if "\0" not in text:  # the library ends a text there
            assert row["ids"] == library.encode(text)
    back = sentencepieces.decode(sentencepieces.encode(messy, PIECE), PIECE).collect()
    assert [r["text"] for r in back] == [r[1] for r in messy_rows]
    assert all(r["round_trip"] for r in sentencepieces.encode_and_verify(messy, PIECE).collect())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", " " * 9, "the", "th", "e", "▁", "日本", "季", "☃", "😀", "\n", "\t", "ing", "and", "1", "23", "é", "x"]), max_size=14).map("".join))
def test_merge_order_gives_the_library_s_ids(text):
    import sentencepiece

    if not _library:
        _library.append(sentencepiece.SentencePieceProcessor(model_file=PIECE))
    want = _library[0].encode(text)
    assert np.frombuffer(sentencepieces.encode_texts([text], PIECE)[0], "<i4").tolist() == want
    assert trie().count([text])[0] == [len(want)]


_library = []


def test_many_long_words_stay_within_the_bound_of_the_trie():
    draw = np.random.default_rng(1)
    words = ["".join(map(chr, draw.integers(0x4E00, 0x9FFF, 20_000))) for _ in range(60)]
    t = token_counts.TokenTrie(pieces(PIECE))
    got = t.count(words)[0]
    assert len(t.score) <= token_counts.TRIE_NODES + 20_001
    assert got == [len(x) // 4 for x in sentencepieces.encode_texts(words, PIECE)]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("then ing\n日é\x00")), max_size=30))
def test_trie_and_suffix_array_agree(text):
    ids = sentencepieces.encode_texts([text], PIECE)[0]
    assert sentencepieces.decode_ids(memoryview(ids).cast("i"), PIECE) == text
    assert token_counts.TokenTrie.count(trie(), [text])[0] == [len(ids) // 4]


_trie = []


def trie():
    if not _trie:
        _trie.append(token_counts.TokenTrie(pieces(PIECE)))
    return _trie[0]


def test_shared_folder_is_the_session_s(spark):
    assert common.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_only_own_tables_are_deleted(spark, tmp_path):
    theirs = f"{tmp_path}/corpusloom-data/documents.parquet"
    spark.range(3).write.parquet(theirs)
    common.discard(spark.read.parquet(theirs))
    assert spark.read.parquet(theirs).count() == 3
    ours, way = common.stored(spark.range(4)), []

    def make():
        way.append(common.stored(ours.filter("id > 0")))
        way.append(common.settled(spark, lambda: common.stored(way[0].filter("id > 1")).filter("id > 2")))
        return way[0].union(way[1])

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    kept = common.settled(spark, make)
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 3, 3]
    assert len({p.name for p in folder.iterdir()} - before) == 1
    common.discard(ours)
    assert len(before - {p.name for p in folder.iterdir()}) == 1


def test_tables_of_a_failed_try_are_deleted(spark):
    before = set(common._written)

    def make():
        return common.stored(spark.range(2)).selectExpr("raise_error('no') as x")

    with pytest.raises(Exception, match="no"):
        common.settled(spark, make)
    assert common._written == before
