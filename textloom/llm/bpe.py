"""Byte-pair encoding of whole texts by a prefix-sharing trie traversal.

The distinct words of a batch are visited in sorted order, which is a depth-first
walk of their trie.  At every trie node the *last token* of the prefix's encoding
is kept; a word that shares a prefix with the one before it starts from the state
of the shared node, so each shared prefix is encoded once.  The last token of a
prefix is the one suffix token that may stand after the last token of what is
left of it (``_joins``); following the last tokens backwards gives the ids.

A word is what stands between white space.  It is normalised (NFC, lower case),
split into letter runs, single numbers and other runs, and each part is encoded
with an end-of-word mark, as the tokenizer file says.  Strings of special tokens
become their ids before that.

Cases: a null text counts as empty and gives no ids; very long words are walked
byte by byte in linear time; repeated rows give repeated results.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import unicodedata
from contextlib import contextmanager
from functools import lru_cache
from itertools import batched, chain
from typing import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose ids a worker keeps between batches; beyond it the cache starts anew.
CACHE_WORDS = 800_000
#: Parts of words that the library's encoder keeps, which cost less to encode anew, and parts that it gets at once.
LIBRARY_PARTS, BATCH_PARTS = 400_000, 2000
#: Pairs of tokens and steps of the automaton that a worker keeps; beyond it they start anew.
CACHE_PAIRS = 4_000_000
#: Characters of text worked on at once; by the library's encoder, whose arrays hold some tens of bytes for each.
SLAB_CHARS, LIBRARY_CHARS = 3_000_000, 1_000_000

_SEPARATORS = regex.compile("[\x1c-\x1f]")
_NON_SPACE = regex.compile(r"\S+")
#: Letters below it have the same classes and cases in every Unicode version in use;
#: words with others are normalised and split by the tokenizers library itself.
_STABLE = "\u0530"
#: Kinds of code points: of Latin-1 by themselves, all others in one; and their lower case.
_SPACE, _LETTER, _NUMBER, _SIGN, _ODD = range(5)
_LATIN = [chr(c) for c in range(256)]
_KINDS = np.array([_SPACE if regex.match(r"\s", c) else _LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c) else _SIGN for c in _LATIN] + [_ODD], np.uint8)
_LOWER = np.array([ord(c.lower()) for c in _LATIN] + [0], np.uint8)
#: White space beyond Latin-1, the last of which is U+3000.
_WIDE_SPACES = [ord(c) for c in regex.findall(r"\s", "".join(map(chr, range(0x100, 0x3001))))]
#: What makes a part with an apostrophe before it: a letter, or two.
_SHORT, _LONG = [ord(c) for c in "stmd"], [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {b: chr(b) for b in shown}
    spare = iter(range(0x100, 0x200))
    return [chars[b] if b in chars else chr(next(spare)) for b in range(256)]


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Many small lists and no cycles among them: looking for cycles would take a tenth of the time."""
    collects = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if collects:
            gc.enable()


class PrefixBpe:
    """Encoder of one tokenizer file with end-of-word marks."""

    def __init__(self, path: str):
        spec = self._read(path)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.strings = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self._byte_of = {c: b for b, c in enumerate(alphabet)}
        # symbols: bytes, then bytes that end a word
        symbols = [vocab[c] for c in alphabet] + [vocab[c + suffix] for c in alphabet]
        spelled: dict[int, tuple[int, ...]] = {t: (s,) for s, t in enumerate(symbols)}
        self.rank: dict[tuple[int, int], int] = {}
        left_of, right_of = {}, {}
        self.made_at: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            self.rank[x, y] = rank
            left_of[t], right_of[t], self.made_at[t] = x, y, rank
            spelled[t] = spelled[x] + spelled[y]
        self.length = {t: len(s) for t, s in spelled.items()}
        self.packed = {t: t.to_bytes(4, "little") for t in self.strings}
        self.left_of, self.right_of, self.never = left_of, right_of, len(model["merges"]) + 1
        if max(self.strings) >= 1 << 32 or len(symbols) > 512:
            raise ValueError("ids must fit 32 bits and symbols 9")
        self._automaton(spelled)
        self._joined: dict[int, bool] = {}
        self._decoded: dict[str, str] = {}

    def _read(self, path: str) -> dict:
        """The tokenizer file, and what splits words."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.part_re = regex.compile(pattern)
        self._library = Tokenizer.from_file(path)
        self._words: dict[str, bytes] = {}
        return spec

    def _automaton(self, spelled: dict[int, tuple[int, ...]]) -> None:
        """Suffix automaton of all token spellings: step[state << 9 | symbol]."""
        self.step: dict[int, int] = {}
        token_at, count = {}, 1
        for token, spelling in spelled.items():
            state = 0
            for s in spelling:
                key = state << 9 | s
                nxt = self.step.get(key)
                if nxt is None:
                    nxt = self.step[key] = count
                    count += 1
                state = nxt
            token_at[state] = token
        self.fail = [0] * count
        children: list[list[tuple[int, int]]] = [[] for _ in range(count)]
        for key, nxt in self.step.items():
            children[key >> 9].append((key & 511, nxt))
        self._spelled_steps = dict(self.step)
        #: suffix tokens of each state, longest first
        self.suffixes: list[tuple[tuple[int, int], ...]] = [()] * count
        queue = [nxt for _, nxt in children[0]]
        for state in queue:
            if state in token_at:
                t = token_at[state]
                self.suffixes[state] = ((self.length[t], t), *self.suffixes[self.fail[state]])
            else:
                self.suffixes[state] = self.suffixes[self.fail[state]]
            for s, nxt in children[state]:
                self.fail[nxt] = self._next(self.fail[state], s)
                queue.append(nxt)

    def _next(self, state: int, symbol: int) -> int:
        key = state << 9 | symbol
        nxt = self.step.get(key)
        if nxt is None:
            nxt = self.step[key] = 0 if state == 0 else self._next(self.fail[state], symbol)
        return nxt

    def _edge(self, token: int, child: dict[int, int]) -> list[tuple[int, int]]:
        """Pieces at one edge of the token, each with the rank that ends it."""
        out, ends = [(token, self.never)], self.never
        while token in child:
            ends, token = self.made_at[token], child[token]
            out.append((token, ends))
        return out

    def _joins(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: no merge crosses their border."""
        key = a << 32 | b
        known = self._joined.get(key)
        if known is None:
            rank, known = self.rank, True
            left_edge = self._edge(b, self.left_of)
            for x, x_ends in self._edge(a, self.right_of):
                for y, y_ends in left_edge:
                    r = rank.get((x, y))
                    if r is not None and r < x_ends and r <= y_ends:
                        known = False
            self._joined[key] = known
        return known

    def encode_parts(self, parts: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian unsigned 32 bits) of each distinct part, shared prefixes once."""
        out: dict[bytes, bytes] = {}
        step, suffixes, joined, length, packed = self.step, self.suffixes, self._joined, self.length, self.packed
        path, states, last = b"", [0], [0]
        add_state, add_last = states.append, last.append
        for word in sorted(parts):
            end = len(word) - 1
            most = min(end, len(path))
            # bytes before the first that differs
            depth = most - ((int.from_bytes(path[:most]) ^ int.from_bytes(word[:most])).bit_length() + 7 >> 3)
            del states[depth + 1 :], last[depth + 1 :]
            state, i = states[depth], depth
            path = word[:end]
            for symbol in (*word[depth:end], 256 + word[end]):
                i += 1
                try:
                    state = step[state << 9 | symbol]
                except KeyError:
                    state = self._next(state, symbol)
                for size, token in suffixes[state]:
                    before = i - size
                    if not before:
                        break
                    try:
                        if joined[last[before] << 32 | token]:
                            break
                    except KeyError:
                        if self._joins(last[before], token):
                            break
                add_state(state)
                add_last(token)
            # the node of the end mark is no prefix of other words
            states.pop()
            last.pop()
            if before == 0:
                out[word] = packed[token]
                continue
            ids, at = [packed[token]], before
            while at > 0:
                token = last[at]
                ids.append(packed[token])
                at -= length[token]
            ids.reverse()
            out[word] = b"".join(ids)
        return out

    def _split_word(self, word: str) -> list[bytes | int]:
        """Parts of a word to encode; ints are ids of special tokens."""
        body = word[:-1] if word[-1] in ".,;:!?" else word
        # letters of ASCII and Latin-1 are one part, normalised and with one lower-case letter each
        if body.isalpha() and (body.isascii() or max(body) < "\u0100"):
            return [body.lower().encode()] if body is word else [body.lower().encode(), word[-1].encode()]
        if "<|" in word and self.special_re.search(word):
            return list(chain.from_iterable([self.special[p]] if p in self.special else self._split_word(p) for p in self.special_re.split(word) if p))
        raw = word
        if not word.isascii():
            if not unicodedata.is_normalized("NFC", word):
                word = unicodedata.normalize("NFC", word)
            # lower case is taken letter by letter, so no final sigma
            word = word.replace("Σ", "σ").lower()
            if max(word) >= _STABLE:
                shown = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(raw))
                return [bytes(map(self._byte_of.__getitem__, p)) for p, _ in shown]
        else:
            word = word.lower()
        return [p.encode() for p in self.part_re.findall(word)]

    @staticmethod
    def words(text: str) -> list[str]:
        if _SEPARATORS.search(text):  # str.split takes these for white space, the tokenizer doesn't
            return _NON_SPACE.findall(text)
        return text.split()

    def learn(self, words: Iterable[str]) -> None:
        """Encodes the words that the cache lacks, all in one trie walk."""
        if len(self._words) > CACHE_WORDS:
            self._words.clear()
            self._decoded.clear()
        if len(self._joined) + len(self.step) > CACHE_PAIRS:
            self._joined.clear()
            self.step = dict(self._spelled_steps)
        with _no_cycles():
            split = {w: self._split_word(w) for w in set(words).difference(self._words)}
            known = self.encode_parts({p for parts in split.values() for p in parts if not isinstance(p, int)})
            for w, parts in split.items():
                self._words[w] = known[parts[0]] if len(parts) == 1 and parts[0] in known else b"".join([self.packed[p] if isinstance(p, int) else known[p] for p in parts])

    def encode_slab(self, texts: list[str]) -> Iterator[tuple[list[str], bytes]]:
        """Words and ids of each text."""
        split = [self.words(t) for t in texts]
        self.learn(chain.from_iterable(split))
        ids = self._words.__getitem__
        for words in split:
            yield words, b"".join(map(ids, words))

    def decode_words(self, words: list[str]) -> str:
        """Token strings joined by spaces, from the words' ids: the file names no decoder."""
        known, strings = self._decoded, self.strings
        for w in set(words).difference(known):
            ids = self._words[w]
            known[w] = " ".join([strings[i] for i in memoryview(ids).cast("I")]) if ids else ""
        return " ".join(filter(None, map(known.__getitem__, words)))


def cut_parts(texts: list[str]) -> tuple[pa.DictionaryArray, str, np.ndarray]:
    """Parts of all texts in order, the encoding they are in, and where each text's parts begin, and end after the last.

    Works on arrays of all code points.  Words of Latin-1 are in lower case and split as the
    tokenizer file says; a word with other letters, or with what may be a special token, is one raw part.
    """
    raw = np.frombuffer("\n".join([*texts, "", "", ""]).encode("utf-32-le"), "<u4")
    narrow = np.minimum(raw, 256).astype(np.uint16)
    kind, low = _KINDS[narrow], _LOWER[narrow]
    odd = np.flatnonzero(kind == _ODD)
    kind[odd[np.isin(raw[odd], _WIDE_SPACES)]] = _SPACE
    marked = kind == _ODD
    marked[:-1] |= (narrow[:-1] == ord("<")) & (narrow[1:] == ord("|"))
    odd = np.flatnonzero(marked)
    if len(odd):
        borders = np.flatnonzero(np.diff(kind != _SPACE, prepend=False))
        begins, ends = borders[::2], borders[1::2]
        words = np.unique(np.searchsorted(begins, odd, "right") - 1)
        steps = np.zeros(len(kind), np.int8)
        steps[begins[words]], steps[ends[words]] = 1, -1
        kind[np.cumsum(steps, dtype=np.int8) > 0] = _ODD
    shown = kind != _SPACE
    starts = np.diff(kind, prepend=_SPACE) != 0
    starts |= kind == _NUMBER
    starts &= shown
    # 's, 't, 'm, 'd, 're, 've and 'll are parts where no other run of signs holds the apostrophe
    quotes = np.flatnonzero((narrow == ord("'")) & (kind == _SIGN) & starts)
    pairs = low[quotes + 1].astype(np.uint16) << 8 | low[quotes + 2]
    short, long = quotes[np.isin(pairs >> 8, _SHORT)], quotes[np.isin(pairs, _LONG)]
    starts[short + 1] = starts[long + 1] = False
    starts[short + 2], starts[long + 3] = shown[short + 2], shown[long + 3]
    chars = np.where(kind == _ODD, raw, low)[shown] if len(odd) else low[shown]
    offsets = np.append(np.flatnonzero(starts[shown]), len(chars)) * chars.itemsize
    parts = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(chars)])
    of_texts = np.searchsorted(np.flatnonzero(starts), np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return parts.dictionary_encode(), "utf-32-le" if len(odd) else "latin-1", of_texts


class LibraryBpe:
    """The same ids by the tokenizers library, without the trie's tables: for callers that want ids only.

    Distinct parts of Latin-1 words go through the library once, many at once, between spaces;
    each ends with one token that has the end-of-word mark.  Other words go through it one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        vocab, suffix = self._library.get_vocab(with_added_tokens=False), self._library.model.end_of_word_suffix
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        self._ends[[i for s, i in vocab.items() if s.endswith(suffix)]] = True
        self._parts: dict[str, bytes] = {}

    def _alone(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._library.encode_batch_fast(words, add_special_tokens=False)]

    def encode_parts(self, parts: Iterable[str]) -> dict[str, bytes]:
        """Ids of each distinct part; parts are normalised and of Latin-1."""
        out: dict[str, bytes] = {}
        for some in batched(parts, BATCH_PARTS):
            (ids,) = self._alone([" ".join(some)])
            cuts = np.flatnonzero(self._ends[np.frombuffer(ids, "<u4")]) + 1
            if len(cuts) == len(some):
                ends = (4 * cuts).tolist()
                out.update(zip(some, map(ids.__getitem__, map(slice, [0, *ends], ends))))
            else:
                out.update(zip(some, self._alone(list(some))))
        return out

    def learn(self, parts: Iterable[str]) -> None:
        """Encodes the parts that the cache lacks."""
        if len(self._parts) > LIBRARY_PARTS:
            self._parts.clear()
        new = [p for p in parts if p not in self._parts]
        plain = [p for p in new if (p.isascii() or max(p) < "\u0100") and "<|" not in p]
        if len(plain) < len(new):
            other = list(set(new).difference(plain))
            self._parts.update(zip(other, self._alone(other)))
        self._parts.update(self.encode_parts(plain))

    def encode_slab(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each text and its ids."""
        parts, encoding, of_texts = cut_parts(texts)
        with _no_cycles():
            distinct = [p.decode(encoding) for p in parts.dictionary.to_pylist()]
            self.learn(distinct)
            found = list(map(self._parts.__getitem__, distinct))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        known, begins = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        which = parts.indices.to_numpy()
        ends = np.append(0, np.cumsum(sizes[which]))
        ids = known[np.repeat(begins[which] - ends[:-1], sizes[which]) + np.arange(ends[-1])]
        for text, at, end in zip(texts, ends[of_texts[:-1]], ends[of_texts[1:]]):
            yield text, ids[at:end].tobytes()


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryBpe:
    """The worker's encoder by the library; read once for each Python worker."""
    return LibraryBpe(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixBpe:
    """The worker's encoder of a file; read once for each Python worker."""
    return PrefixBpe(path)


def slabs(column: pa.Array, most: int = SLAB_CHARS) -> Iterator[list[str]]:
    """Runs of whole texts of about so many characters; nulls are empty."""
    texts, size = [], 0
    for value in column:
        text = value.as_py() or ""
        texts.append(text)
        size += len(text)
        if size >= most:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``ids`` (binary, little-endian unsigned 32 bits) and ``decoded``.

    The tokenizer file must exist under the same path on every executor.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for batch in batches:
            at = 0
            for texts in slabs(batch.column(1)):
                rows = [(ids, bpe.decode_words(words)) for words, ids in bpe.encode_slab(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(rows)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )
                at += len(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, f"doc_id {kind}, ids binary, decoded string")


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode_documents`` reduced to n_tokens and SHA-256 digests inside the task."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for texts in slabs(batch.column(1)):
                for words, ids in bpe.encode_slab(texts):
                    counts.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    decoded_sha.append(hashlib.sha256(bpe.decode_words(words).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
