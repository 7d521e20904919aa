"""Byte-pair encoding with a public vocabulary, as a lazily determinised transducer.

``MergeTransducer`` reads bytes and emits tokens as soon as every way to go on
agrees on them; its states and transitions are computed when first met and kept.
``CorpusEncoder`` cuts texts into words for a whole batch at a time with array
operations, sends each different word through the transducer once, and gathers
the ids of all words by position.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd

DEFAULT_TOKENIZER = "byte_bpe_50k"

# Contractions that are words of their own, and the characters of Unicode's White_Space.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """Where the installed public vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeTransducer:
    """Encodes one word, byte by byte.

    A prefix of a word ends with exactly one token of its encoding, the one
    whose pair with the token before is itself an encoding. A state holds, for
    each place where the token being read may have begun, the bytes since then
    and the tokens before it that are not yet emitted. Tokens that all those
    places share are emitted; the lookahead is bounded by the longest token.
    """

    #: Transitions kept; beyond it all are dropped and found again when needed.
    MAX_TRANSITIONS = 1_000_000

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.open = {token[:k] for token in ranks for k in range(1, len(token))}
        self.valid: dict[tuple[int, int], bool] = {}
        self.transitions: dict[tuple, tuple] = {}
        self.start = (-1, ((b"", ()),))

    def merge(self, word: bytes) -> list[int]:
        """Encoding by applying merges in order of rank; quadratic, for short words and checks."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` right after ``before`` (-1: at the start) is what the encoding gives."""
        found = self.valid.get((before, token))
        if found is None:
            own = self.bytes_of[token]
            found = self.merge(own) == [token] if before < 0 else self.merge(self.bytes_of[before] + own) == [before, token]
            self.valid[before, token] = found
        return found

    def _step(self, state: tuple, byte: int) -> tuple[tuple, tuple]:
        last, places = state
        piece = bytes((byte,))
        ended, kept = None, []
        for read, chain in places:
            longer = read + piece
            if ended is None and (token := self.ranks.get(longer)) is not None and self.follows(chain[-1] if chain else last, token):
                ended = (*chain, token)
            if longer in self.open:
                kept.append((longer, chain))
        if ended is None:
            raise ValueError("the vocabulary has no token for a byte")
        kept.append((b"", ended))
        shared = 0
        shortest = min(len(chain) for _, chain in kept)
        first = kept[0][1]
        while shared < shortest and all(chain[shared] == first[shared] for _, chain in kept):
            shared += 1
        out = first[:shared]
        return (out[-1] if out else last, tuple((read, chain[shared:]) for read, chain in kept)), out

    def encode(self, word: bytes) -> tuple[int, ...]:
        state, out = self.start, ()
        for byte in word:
            known = self.transitions.get((state, byte))
            if known is None:
                known = self._step(state, byte)
                if len(self.transitions) >= self.MAX_TRANSITIONS:
                    self.transitions.clear()
                self.transitions[state, byte] = known
            state, emitted = known
            if emitted:
                out += emitted
        return out + state[1][-1][1]


class StreamDecoder:
    """Ids to text piece by piece: an incremental UTF-8 automaton holds back unfinished characters."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.held, self.missing = b"", 0

    def feed(self, ids: Sequence[int]) -> str:
        """The text that is certain after these ids; bytes that are no UTF-8 give U+FFFD."""
        out = bytearray()
        for token in ids:
            for byte in self.bytes_of[token]:
                if self.missing and byte & 0xC0 == 0x80:
                    self.held += bytes((byte,))
                    self.missing -= 1
                    if not self.missing:
                        out += self.held
                        self.held = b""
                    continue
                out += self.held
                self.held, self.missing = b"", 0
                more = 0 if byte < 0xC0 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3 if byte < 0xF8 else 0
                if more:
                    self.held, self.missing = bytes((byte,)), more
                else:
                    out.append(byte)
        return out.decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held, self.missing = self.held, b"", 0
        return rest.decode("utf-8", "replace")


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each code point, and two random numbers for it."""
    kinds = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        k = unicodedata.category(chr(code))[0]
        if k == "L":
            kinds[code] = LETTER
        elif k == "N":
            kinds[code] = NUMBER
    kinds[list(WHITE_SPACE)] = SPACE
    random = np.random.default_rng(20240229)
    return kinds, *(random.integers(1, 2**63, 0x110000, np.uint64) for _ in range(2))


_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@cache
def _powers(size: int) -> tuple[np.ndarray, ...]:
    out = []
    for base in _BASES:
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return tuple(out)


def word_starts(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """True where a word begins, for texts laid end to end.

    A word is a contraction, or letters, or numbers, or other characters, each
    with one space in front if there is one; white space before that is a word
    without its last character, and white space at the end of a text is one word.
    """
    kinds = _tables()[0]
    n = len(codes)
    kind = kinds[codes]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    last = first[1:].copy()
    last[-1] = True
    first = first[:n]
    before = np.concatenate([[255], kind[:-1]]).astype(np.uint8)
    before[first] = 255
    blank = codes == 32
    joined = np.zeros(n, bool)
    joined[1:] = blank[:-1]
    joined &= ~first
    space = kind == SPACE
    start = first | (~space & (kind != before) & ~joined)
    start |= space & (before != SPACE)
    # The last white space before something else begins a word.
    after = np.concatenate([kind[1:], [255]]).astype(np.uint8)
    start |= space & ~last & (after != SPACE)
    quote = np.flatnonzero(codes == 39)
    if len(quote):
        ok = (before[quote] != OTHER) & ~joined[quote]
        quote = quote[ok]
        pad = np.concatenate([codes, [0, 0, 0]])
        end_of = np.concatenate([last, [True] * 3])
        for text in CONTRACTIONS:
            hit = ~end_of[quote] & (pad[quote + 1] == ord(text[0]))
            if len(text) == 2:
                hit &= ~end_of[quote + 1] & (pad[quote + 2] == ord(text[1]))
            at = quote[hit]
            start[at] = True
            start[at + 1] = False
            if len(text) == 2:
                start[at + 2] = False
            follow = at + 1 + len(text)
            follow = follow[follow < n]
            start[follow] |= kind[follow] != SPACE
    return start


class Words:
    """The words of a batch: where they begin, which known word each is, and the texts they belong to."""

    def __init__(self, begin: np.ndarray, known: np.ndarray, text_of: np.ndarray) -> None:
        self.begin, self.known, self.text_of = begin, known, text_of


class CorpusEncoder:
    """Encodes batches of texts; different words are encoded once and kept, up to ``max_words``."""

    CHUNK_CHARS = 1 << 20

    def __init__(self, path: str, max_words: int = 500_000) -> None:
        self.transducer = MergeTransducer(load_ranks(path))
        self.max_words = max_words
        self._clear()

    def _clear(self) -> None:
        self.index = pd.Index(np.zeros(0, np.uint64))
        self.hashes = np.zeros(0, np.uint64)
        self.checks = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)
        self.offsets = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def words(self, texts: Sequence[str]) -> Words:
        """The words of ``texts``; ``known`` indexes ``counts`` and ``offsets`` until the next call."""
        if len(self.hashes) > self.max_words:
            self._clear()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        none = np.zeros(0, np.int64)
        if not len(codes):
            return Words(none, none, none)
        text_starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        begin = np.flatnonzero(word_starts(codes, text_starts[lengths > 0]))
        end = np.concatenate([begin[1:], [len(codes)]])
        _, *randoms = _tables()
        size = 1 << int(len(codes)).bit_length()
        powers = _powers(size)
        signs = []
        for k in range(2):
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(randoms[k][codes] * powers[2 * k][: len(codes)], dtype=np.uint64)])
            signs.append((run[end] - run[begin]) * powers[2 * k + 1][begin])
        known = self.index.get_indexer(signs[0])
        new = np.flatnonzero(known < 0)
        if len(new):
            _, where = np.unique(signs[0][new], return_index=True)
            where = new[where]
            encoded = [self.transducer.encode(codes[begin[i] : end[i]].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")) for i in where]
            counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
            self.hashes = np.concatenate([self.hashes, signs[0][where]])
            self.checks = np.concatenate([self.checks, signs[1][where]])
            self.counts = np.concatenate([self.counts, counts])
            self.ids = np.concatenate([self.ids, np.fromiter((t for e in encoded for t in e), np.int32, int(counts.sum()))])
            self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
            self.index = pd.Index(self.hashes)
            known = self.index.get_indexer(signs[0])
        if (self.checks[known] != signs[1]).any():
            raise RuntimeError("two different words have one 64-bit hash")
        return Words(begin, known, np.searchsorted(text_starts, begin, "right") - 1 if (lengths > 0).all() else np.repeat(np.arange(len(texts)), lengths)[begin])

    def chunks(self, texts: Sequence[str]) -> list[list[int]]:
        """Indices of texts in chunks of bounded size; a longer text is a chunk of its own."""
        out, size = [[]], 0
        for k, text in enumerate(texts):
            if out[-1] and size + len(text) > self.CHUNK_CHARS:
                out.append([])
                size = 0
            out[-1].append(k)
            size += len(text)
        return out

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text)."""
        flat, sizes = [], np.zeros(len(texts), np.int64)
        for chunk in self.chunks(texts):
            w = self.words([texts[k] for k in chunk])
            if not len(w.begin):
                continue
            counts = self.counts[w.known]
            total = np.concatenate([[0], np.cumsum(counts)])
            flat.append(self.ids[np.arange(total[-1]) + np.repeat(self.offsets[w.known] - total[:-1], counts)])
            sizes[chunk] = np.bincount(w.text_of, counts, len(chunk)).astype(np.int64)
        return (np.concatenate(flat) if flat else np.zeros(0, np.int32)), sizes

    def count(self, texts: Sequence[str]) -> np.ndarray:
        """Number of ids of each text."""
        sizes = np.zeros(len(texts), np.int64)
        for chunk in self.chunks(texts):
            w = self.words([texts[k] for k in chunk])
            if len(w.begin):
                sizes[chunk] = np.bincount(w.text_of, self.counts[w.known], len(chunk)).astype(np.int64)
        return sizes


@cache
def encoder(path: str) -> CorpusEncoder:
    """One encoder per process and vocabulary."""
    return CorpusEncoder(path)
