import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_cases import ODD
from tokenizers import Tokenizer

from patchloom.llm import rans
from patchloom.session import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(n, seed=0):
    return (np.random.default_rng(seed).zipf(1.2, n) % 49_000).astype(np.uint32)


@pytest.mark.parametrize("n", [0, 1, 31, 33, 8192, 32_768, 100_001, 3 * 32_768 * rans.GROUP // 2])
def test_round_trip(n):
    ids = ids_of(n)
    names, lengths, got = rans.decode_file(rans.encode_file([4, None], np.array([n // 3, n - n // 3]), ids))
    assert names == [4, None] and lengths.tolist() == [n // 3, n - n // 3] and (got == ids).all() and len(got) == n


def test_one_symbol_and_rare_symbols():
    for ids in (np.full(70_000, 9, np.uint32), np.arange(49_408, dtype=np.uint32), np.array([2**31], np.uint32)[:0]):
        assert (rans.decode_file(rans.encode_file([1], np.array([len(ids)]), ids))[2] == ids).all()


def test_shares():
    for counts in ([1], [1, 10**12], [5] * 49_000, list(range(1, 3000))):
        shares = rans.normalise(np.array(counts))
        assert shares.sum() == 1 << rans.PROBABILITY_BITS and shares.min() >= 1


def test_size_is_near_the_entropy():
    ids = ids_of(400_000)
    p = np.bincount(ids) / len(ids)
    p = p[p > 0]
    assert len(rans.encode_file([1], np.array([len(ids)]), ids)) < 1.1 * len(ids) * -(p * np.log2(p)).sum() / 8 + 4 * len(p)


def test_blocks_stand_alone_and_damage_is_seen():
    ids = ids_of(5 * 32_768 + 17)
    body = rans.encode_file([1], np.array([len(ids)]), ids)
    asked = []
    file = rans.RansFile(len(body), lambda offset, length: asked.append(length) or body[offset : offset + length])
    before = sum(asked)
    assert (file.ids(2, 4) == ids[2 * 32_768 : 4 * 32_768]).all() and sum(asked) - before < len(body) / 2
    assert (file.ids(5) == ids[5 * 32_768 :]).all()
    for at in (20, len(body) // 2, len(body) - 40, len(body) - 3):
        broken = bytearray(body)
        broken[at] ^= 1
        with pytest.raises((rans.CorruptFile, KeyError, UnicodeDecodeError)):
            rans.decode_file(bytes(broken))


def test_files_of_a_table(spark, documents):
    rows = [(k * 13 % 200, f"Text {k} " + "lorem Ipsum " * (k % 17 * 30)) for k in range(150)]
    rows += [(1000 + k, f"short {k}") for k in range(2400)] + ODD
    folder = f"{shared_dir(spark)}/rans-test"
    manifest = rans.write_files(documents(rows).repartition(3), folder, PATH, file_ids=500)
    got = rans.read_files(manifest, folder).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = [
        (d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
        for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ]
    at, listed = 0, []
    for d, ids in want:
        listed.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert Counter((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.tokens))) for r in got) == Counter(listed)
    assert manifest.count() > 4  # several files, as they end after so many ids
    empty = rans.write_files(documents([]), folder, PATH)
    assert rans.read_files(empty, folder).count() == 0
