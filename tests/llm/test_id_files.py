"""Files of token ids against the tokenizer on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from folioflow.llm import idfiles
from folioflow.llm._work import own_dir, temporary

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, n_tokens int, ids string, row int, start int"


def whole(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]


def odd_texts(n=3000):
    """Texts of the characters at which chunks may or may not end."""
    rng = np.random.default_rng(7)
    some = ["a", "the", "Zz", "1", "22", ".", ",", "'", "'s", "'t", "n't", "-", "—", "é", "ß", "가", "日本", "😀", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", " ", "\u0085", "​", "\x1c", "\x00", "<|endoftext|>", "_"]
    return ["".join(rng.choice(some, rng.integers(0, 14))) for _ in range(n)]


def test_chunks_keep_the_ids_of_whole_texts():
    texts = [*odd_texts(), None, "", "  ", " a  ", "x " * 200_000, "y" * 100_000]
    words = idfiles.ByteTokenizer(PATH, most=500)
    for column in (pa.array(texts), pa.array(texts, pa.large_string())):
        got = list(words.encode(column, 2))
        for text, ours, theirs in zip(texts, got, whole(texts), strict=True):
            assert ours.tolist() == theirs.tolist(), repr(text)[:80]


def test_blocks_of_every_length():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 1000, idfiles.BLOCK):
        ranks = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        raw = idfiles.encode_block(ranks)
        count, size = np.frombuffer(raw[:8], "<u4")
        control = -(-n // 4)
        assert len(raw) == 8 + control + size and count == n
        data = np.frombuffer(raw, np.uint8, offset=8)
        assert (idfiles.decode_block(n, data[:control], data[control:]) == ranks).all()
    assert len(idfiles.encode_block(np.arange(256, dtype=np.uint32))) == 8 + 64 + 256  # a byte each


def test_documents_come_back_in_order(spark):
    texts = ["b c d", None, "", "the the the", "long " * 90_000, *odd_texts(300)]
    rows = [(1000 - 3 * k, t, 1, "x", k, 2) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", None, None, None, None)] + [(500, "copy", 0, "", 0, 0)] * 50
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    got = idfiles.round_trip(docs, PATH, keep_ids=True).orderBy("start").collect()
    assert len(got) == len(rows)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    expected = sorted((str(r[0]), tuple(ids.tolist())) for r, ids in zip(rows, whole([r[1] for r in rows]), strict=True))
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in got) == expected
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    assert idfiles.round_trip(spark.createDataFrame([], DOC), PATH).count() == 0


def test_small_files_ranks_and_what_is_left(spark):
    docs = spark.createDataFrame([(k, "e " * (k % 7) + "rare" * (k == 3)) for k in range(400)], "doc_id long, text string")
    with temporary(spark):
        folder = own_dir(spark, "ids")
        files = idfiles.write_files(docs, PATH, folder, file_ids=100)
        listed = files.orderBy("start").collect()
        assert sum(f.n_docs for f in listed) == 400 and max(f.n_tokens for f in listed) < 120
        assert [f.doc_id for f in listed] == sorted(f.doc_id for f in listed)
        store, root = pafs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{root}/{idfiles.RANKS}") as source:
            by_rank = np.frombuffer(source.read(), "<u4")
        counts = np.bincount(np.concatenate(whole([r.text for r in docs.collect()])))
        assert (np.diff(counts[by_rank]) <= 0).all() and len(by_rank) == (counts > 0).sum()
        some = files.filter(files.start > 200)
        assert idfiles.read_documents(some, folder).count() == sum(f.n_docs for f in listed if f.start > 200)
        with store.open_output_stream(f"{root}/{listed[0].file}", compression=None) as out:
            out.write(b"short")
        with pytest.raises(Exception, match="no file of ids"):
            idfiles.read_documents(files, folder).count()
    assert not store.get_file_info(root).is_file and store.get_file_info(root).type == pafs.FileType.NotFound
