import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from conftest_llm import texts_of
from tokenizers import Tokenizer

from rosterloom.llm import bpe, token_counts, token_files
from rosterloom.llm.pretokens import PreTokens, text_parts

POOL = [chr(c) for c in range(0x250)] + list("日本語ΣİЖ́ 😀")


def random_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(POOL if r.random() < 0.4 else "ab 'st\n 1., ") for _ in range(r.randint(0, 16))) for _ in range(n)]


@pytest.fixture(scope="module")
def multi():
    vocabulary = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocabulary)}, special_tokens={})
    return bpe.Encoder(vocabulary, P.PATTERN), library


def ids(raw, kind="<u4"):
    return np.frombuffer(raw, dtype=kind).tolist()


def test_bpe_is_the_library(multi):
    encoder, library = multi
    texts = random_texts(5000) + ["a" * 3000, "ab" * 500 + "!" * 900, " " * 700 + "x", "\n" * 300, "0123456789" * 90, "É" * 65, "ß" * 64]
    assert [ids(x) for x in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_bpe_trees_agree(multi):
    """The trees side by side and the single tree give the same ids."""
    ranks, r = multi[0].ranks, random.Random(3)
    tokens = list({bytes(r.randrange(256) for _ in range(r.randint(2, 64))) for _ in range(800)})
    side = bpe.encode_tokens(tokens, ranks)
    assert all(side[t] == bpe.encode_long(t, ranks) for t in tokens if t not in ranks.alone)


def test_bpe_round_trip(multi):
    encoder, _ = multi
    for t in random_texts(500, 9):
        assert bpe.decode(ids(encoder.encode([t])[0]), encoder.ranks.vocabulary).decode() == t


def test_classes_agree_on_all_characters(multi):
    encoder, library = multi
    points = [*range(0xD800), *range(0xE000, 0x20000)]
    texts = ["".join(f"a{chr(c)} b{chr(c)}1" for c in points[at : at + 500]) for at in range(0, len(points), 500)]
    assert [ids(x) for x in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_forgetting_changes_nothing(multi):
    _, library = multi
    encoder = bpe.Encoder(multi[0].ranks.vocabulary, P.PATTERN)
    encoder.pre_tokens.limit = 40
    for at in range(0, 600, 20):
        texts = random_texts(20, at)
        assert [ids(x) for x in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("name, encode", [("word", "count"), ("byte", "ids")])
def test_library_encoders(name, encode):
    texts = random_texts(6000, 4) + ["<|endoftext|> a<|startoftext|>b", "x" * 4000, "ΣΑΣ Σ", "İA"]
    path = P.path("word_bpe_49k.json" if name == "word" else "byte_bpe_50k.json")
    library, source = Tokenizer.from_file(path), open(path, encoding="utf-8").read()
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    if encode == "count":
        got = token_counts.Counter(source, token_counts.proven_whole(library)).count(texts)
        assert got == [len(w) for w in want]
    else:
        assert [ids(x, "<u2") for x in token_files.LibraryEncoder(source, 2).encode(texts)] == want


def test_proven_whole():
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    proven = token_counts.proven_whole(library)
    assert 10_000 < len(proven) < 49_408 and "the" in proven
    some = sorted(proven)[::97]
    assert all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in some)


def test_op5_query(odd, empty, rows, multi):
    _, library = multi
    got = rows(bpe.encode_documents(odd, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
    want = []
    for i, t in texts_of(odd):
        x = library.encode_ordinary(t)
        want.append((i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert bpe.encode_documents(empty, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, keep_ids=True).count() == 0


def test_op4_query(odd, empty, rows):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    n = {i: 0 for i, _ in texts_of(odd)}
    want = [(i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts_of(odd)]
    got = rows(token_counts.count_tokens(odd, path, limit=100))
    assert sorted(map(str, got)) == sorted(str((*w, w[2] > 100)) for w in want) and n
    assert token_counts.count_tokens(empty, path).count() == 0


@pytest.mark.parametrize("file_tokens, sequence, batch", [(1 << 24, 2048, 64), (500, 16, 4), (1, 8, 1)])
def test_op1_files(spark, odd, tmp_path, file_tokens, sequence, batch):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    folder = str(tmp_path / "files")
    index = token_files.write_token_files(odd, folder, path, end_id=2, file_tokens=file_tokens, sequence=sequence, batch=batch)
    got = token_files.with_start(token_files.read_documents(index, folder), index).collect()
    got = sorted(got, key=lambda r: r["start"])
    assert [r["id"] for r in got] == sorted((i for i, _ in texts_of(odd)), key=lambda i: (i is not None, i or 0))
    start, texts = 0, {}
    for i, t in texts_of(odd):
        texts.setdefault(i, []).append([*library.encode(t, add_special_tokens=False).ids, 2])
    for r in got:
        crcs = {zlib.crc32(np.array(x, dtype="<u4").tobytes()): len(x) for x in texts[r["id"]]}
        assert r["start"] == start and crcs[r["ids_crc32"]] == r["n_tokens"]
        start += r["n_tokens"]


def test_op1_random_access(spark, odd, tmp_path):
    """Sequences have one length, ids are views, masks are false on padding only."""
    path, folder = P.path("byte_bpe_50k.json"), str(tmp_path / "files")
    index = token_files.write_token_files(odd, folder, path, end_id=2, sequence=32, batch=3)
    filesystem, top = token_files.open_folder(token_files.qualified(spark, folder))
    for r in index.groupBy("file").sum("n_tokens").collect():
        reader = token_files.TokenReader(filesystem, f"{top}/{r['file']}")
        n = r["sum(n_tokens)"]
        real = 0
        for k in range(-(-n // 32)):
            values, mask = reader.sequence(k)
            assert len(values) == len(mask) == 32 and not values.flags.owndata
            real += int(mask.sum())
            assert values.tolist()[: int(mask.sum())] == reader.tokens(32 * k, int(mask.sum())).tolist()
        assert real == n
        with pytest.raises(ValueError):
            reader.tokens(n - 1, 2)


def test_op1_empty(empty, tmp_path):
    folder = str(tmp_path / "files")
    index = token_files.write_token_files(empty, folder, P.path("byte_bpe_50k.json"), end_id=2)
    assert token_files.with_start(token_files.read_documents(index, folder), index).count() == 0


def test_text_parts():
    import pyarrow as pa

    texts = ["ab", None, "c" * 50, "", "dé", "f" * 9, "g"]
    for size in (1, 3, 10, 1000):
        parts = list(text_parts(pa.array(["x", *texts]).slice(1), size))
        assert [t for _, p in parts for t in p] == [t or "" for t in texts]
        assert [s for s, _ in parts] == [sum(len(p) for _, p in parts[:i]) for i in range(len(parts))]
        assert all(len(p) == 1 or sum(len(t.encode()) for t in p) <= size for _, p in parts)
    assert list(text_parts(pa.array([], pa.string()))) == []


def test_unsafe_texts_are_left_to_the_library():
    p = PreTokens(r"\p{L}+|\p{N}", lambda words: {w: 1 for w in words}, ["<s>"])
    assert p.cut(["ab1", "日", "a<s>", "\x1c", ""]) == [["ab", "1"], None, None, None, []]
