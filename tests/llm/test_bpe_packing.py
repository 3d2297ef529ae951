import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textloom.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello world, it's 2024! don't",
    None,
    "",
    "  \t\n ",
    "naïve café ÉÈ Straße ΣΑΣ ΌΔΟΣ",
    "a<|endoftext|>b <|startoftext|>",
    "中文 ไทย \U0001f600\U0001f600 ẹ́ ẛ̣",
    "x" * 5000 + " " + "aaaa" * 300,
    "tab\x1cseparated \x85 nel em nb",
    "the " * 9000,
    "Hello world, it's 2024! don't",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_every_vocabulary_entry_and_odd_texts(library):
    own = bpe.encoder(PATH)
    words = [w.replace("</w>", "") for w in library.get_vocab()][::7]
    for texts in ([t or "" for t in TEXTS], words):
        for text, (split, ids) in zip(texts, own.encode_slab(texts), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert list(memoryview(ids).cast("I")) == want
            assert own.decode_words(split) == library.decode(want, skip_special_tokens=False)


def test_query_digests(spark, library):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.encode_digests(docs, PATH).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def brute_bins(lengths, capacity):
    best = len(lengths)

    def place(i, left):
        nonlocal best
        if len(left) >= best:
            return
        if i == len(lengths):
            best = len(left)
            return
        for b in range(len(left)):
            if left[b] >= lengths[i]:
                place(i + 1, [*left[:b], left[b] - lengths[i], *left[b + 1 :]])
        place(i + 1, [*left, capacity - lengths[i]])

    place(0, [])
    return best


def test_bound_never_exceeds_the_best_packing():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 21, rng.integers(1, 8)))[::-1].copy()
        best = brute_bins(lengths.tolist(), 20)
        bins, offsets, left = packing.best_fit_decreasing(lengths, 20)
        assert packing.lower_bound(lengths, 20) <= best <= len(left)
        assert np.all(np.bincount(bins, lengths) + left == 20)


def test_packing(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "word " * (i * 37 % 4000)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.written(packing.tokenize_pieces(docs, PATH))
    got = packing.pack_pieces(pieces, 256, 16).toPandas()
    tokens = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    assert len(got) == sum(-(-len(x) // 4096) for x in tokens.values())
    for r in got.itertuples():
        ids = tokens[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(ids) == r.length <= 4096
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *np.cumsum(seq["length"])[:-1]]
        assert seq["length"].sum() <= 4096
    lengths = np.sort(got["length"].to_numpy())[::-1]
    alone = len(packing.best_fit_decreasing(lengths)[2])
    assert packing.lower_bound(lengths) <= got["sequence_id"].nunique() <= alone + 1


@pytest.mark.parametrize("kind", ["prose", "tiny", "large", "thirds"])
def test_many_partitions_need_no_more_sequences_than_one(spark, kind):
    rng = np.random.default_rng(8)
    lengths = {
        "prose": np.minimum(4096, 1 + rng.lognormal(5.5, 1.3, 9000)).astype(int),
        "tiny": np.ones(9000, int),
        "large": rng.integers(1800, 4097, 1500),
        "thirds": rng.integers(1000, 1700, 3000),
    }[kind]
    pieces = spark.createDataFrame([(i, 0, 0, int(n), i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.written(packing.pack_pieces(packing.written(pieces), 512, 32))
    assert sorted(r.length for r in packed.collect()) == sorted(lengths.tolist())
    used, bound = packing.certificate(packed)
    alone = len(packing.best_fit_decreasing(np.sort(lengths)[::-1])[2])
    assert bound == packing.lower_bound(lengths) <= used <= alone * 1.005 + 1


def test_packing_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, PATH).count() == 0
    assert bpe.encode_digests(docs, PATH).count() == 0


def test_the_librarys_encoder_keeps_no_tables_of_the_trie(library):
    path = public_tokenizers.path("word_bpe_49k.json")
    found = bpe.library_encoder(path)
    assert not hasattr(found, "step") and not hasattr(found, "_joined")
    rng = np.random.default_rng(3)
    odd = ["a", "B", "é", "É", "ß", "µ", "ª", "İ", "Σ", "K", "́", "'", "'s", "'LL", "--", "12", "²", "<|endoftext|>", "<|", "|>", ".", ",", " ", "日", "😀", "\x1c", "\x85", "_", "‍", "ﬁ"]
    texts = ["".join(rng.choice(odd, rng.integers(0, 14))) for _ in range(800)]
    for text, (_, ids) in zip(texts, found.encode_slab(texts)):
        assert list(memoryview(ids).cast("I")) == library.encode(text, add_special_tokens=False).ids


def test_the_library_gets_each_distinct_part_once(library, monkeypatch):
    asked, encode = [], bpe.LibraryBpe.encode_parts

    def noted(self, parts):
        parts = list(parts)
        asked.extend(parts)
        return encode(self, parts)

    monkeypatch.setattr(bpe.LibraryBpe, "encode_parts", noted)
    found = bpe.LibraryBpe(PATH)
    for texts in (["Word word, don't", "(word)"], ["WORD. word's DON", "words word"]):
        for text, (_, ids) in zip(texts, found.encode_slab(texts), strict=True):
            assert list(memoryview(ids).cast("I")) == library.encode(text, add_special_tokens=False).ids
    assert len(asked) == 9  # 's 't ( ) , . don word words


@pytest.mark.parametrize("wide", [False, True])
def test_the_librarys_encoder_cuts_as_the_library(library, wide):
    rng = np.random.default_rng(5)
    signs = ["a", "S", "t", "RE", "ve", "ll", "D", "'", "'", " ", "\n", "1", "½", "É", "µ", "ª", "--", "\x1c", "\x85", "\xa0"]
    if wide:
        signs += ["<|endoftext|>", "<|", "|>", "<", "|", " ", "　", "᠎", "’", "ſ", "日", "́"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 16))) for _ in range(2000)]
    for text, (_, ids) in zip(texts, bpe.LibraryBpe(PATH).encode_slab(texts), strict=True):
        assert list(memoryview(ids).cast("I")) == library.encode(text, add_special_tokens=False).ids
