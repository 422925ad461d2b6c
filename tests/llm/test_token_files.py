"""Operator 11 against the tokenizer's own encoding, the format's rules and a plain decompressor."""

import functools
import os
import struct
import zlib
from array import array

import public_tokenizers
import pytest
import zstandard

from casewise.llm import queries, tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")
FOLDER = "/root/testdata/sf0.001"


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def encoded(text):
    return array("I", [*tokenizer().encode(text or "", add_special_tokens=False).ids, 2]).tobytes()


def crowd(spark):
    rows = [(k, f"Word {k} of a text, with 'quotes' and  spaces\n\n{k * 7919}") for k in range(40)]
    rows += [(7, "again"), (7, "again"), (None, "no id"), (40, None), (41, ""), (42, "a" * 300 + " b " * 4000), (43, "before<|endoftext|> after"), (44, "日本語 текст, été　x")]
    return spark.createDataFrame([(t, d, "x", 1, "y") for d, t in rows], "text string, doc_id long, path string, at int, _part string")


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tokens"))
    files = tokenfiles.write_token_files(crowd(spark), folder, PATH, frame_ids=512, file_ids=3000, file_docs=20)
    return files, folder


def test_round_trip(spark, written):
    files, _ = written
    rows = sorted(crowd(spark).select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(tokenfiles.read_tokens(tokenfiles.token_index(files), frame_ids=512).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    # rows that share a doc_id have one order among them, whichever it is
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got) == sorted((str(r[0]), encoded(r[1])) for r in rows)
    here = 0
    for r in got:
        assert (r["start"], 4 * r["n_tokens"]) == (here, len(r["ids"]))
        here += r["n_tokens"]
    digests = {(r["start"], r["ids_crc32"]) for r in tokenfiles.read_digests(tokenfiles.token_index(files), frame_ids=512).collect()}
    assert digests == {(r["start"], zlib.crc32(r["ids"])) for r in got}


def test_files_follow_the_format(written):
    files, folder = written
    rows = files.orderBy("part", "number").collect()
    assert len(rows) > 3 and sorted(os.path.basename(r["path"]) for r in rows) == sorted(n for n in os.listdir(folder) if n.endswith(".zst"))
    for r in rows:
        with open(r["path"], "rb") as f:
            raw = f.read()
        count, flags, magic = struct.unpack("<IBI", raw[-9:])
        assert (flags, magic) == (0x80, 0x8F92EAB1)
        # a plain decompressor skips index and seek table
        plain = zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True).read()
        assert len(plain) == 4 * r["n_tokens"] and (r["n_docs"] <= 20)
        file = tokenfiles.TokenFile(*tokenfiles.place(r["path"]))
        assert count == len(file.frames) + 1
        assert all(b[2] - a[2] <= 512 for a, b in zip(file.frames, file.frames[1:], strict=False))
        file.close()


def test_only_the_wanted_frames(spark, written):
    files, _ = written
    row = max(files.collect(), key=lambda r: r["n_tokens"])
    file = tokenfiles.TokenFile(*tokenfiles.place(row["path"]))
    assert len(file.frames) > 1
    lengths = file.documents().column("n_tokens").to_pylist()
    assert file.frame(0)[: 4 * lengths[0]] and file.decompressed == 1
    file.close()
    index = tokenfiles.token_index(files).where("doc_id in (7, 41, 42)")
    got = sorted((r["doc_id"], bytes(r["ids"])) for r in tokenfiles.read_tokens(index, frame_ids=512).collect())
    texts = [(7, crowd(spark).where("doc_id = 7 and text like 'Word%'").first()["text"]), (7, "again"), (7, "again"), (41, ""), (42, "a" * 300 + " b " * 4000)]
    assert got == sorted((d, encoded(t)) for d, t in texts)


def test_a_changed_byte_is_found(written):
    files, folder = written
    path = files.orderBy("part", "number").first()["path"]
    with open(path, "rb") as f:
        raw = bytearray(f.read())
    raw[12] ^= 1
    broken = os.path.join(folder, "broken")
    with open(broken, "wb") as f:
        f.write(raw)
    file = tokenfiles.TokenFile(*tokenfiles.place(broken))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        file.frame(0)
    file.close()
    with open(broken, "wb") as f:
        f.write(raw[:-1])
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(*tokenfiles.place(broken))


def test_empty_table(spark, tmp_path):
    files = tokenfiles.write_token_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"), PATH)
    assert files.count() == 0 and tokenfiles.read_digests(tokenfiles.token_index(files)).count() == 0


def test_units_are_exact():
    import random

    coder = tokenfiles.UnitEncoder(PATH)
    assert coder.by_unit
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "\x1c", "\x85", "　", "a", "Zz", "'s", "it's", "1", "!", "é", "日", "ж", ".", ",", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 15))) for _ in range(5000)]
    texts += [" ".join("".join(rng.choices("aé.,\n日1'", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    assert coder.encode(texts) == coder.whole(texts)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_query_on_the_small_table(spark):
    docs = sorted(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(queries.queries()["op11_token_files"](spark, FOLDER).collect(), key=lambda r: r["start"])
    want, here = [], 0
    for d, t in docs:
        ids = encoded(t)
        want.append((d, here, len(ids) // 4, zlib.crc32(ids)))
        here += len(ids) // 4
    assert [tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in got] == want
