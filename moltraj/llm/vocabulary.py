"""Exact token ids of whole texts, one cached chunk at a time.

A text is cut before each blank and line feed that follows a visible character: no pre-token of either tokenizer
reaches across such a cut, so chunks are encoded alone. Words repeat, so most chunks come from a bounded cache in the
Python worker. Chunks with characters beyond Latin or with special strings go through the tokenizer as a whole; the
others through its own vocabulary and merges, without the cost of building an encoding for each.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

CACHE_ENTRIES = 400_000
CACHE_CHARS = 48
#: White space for Python but not for the tokenizers' patterns.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACED_CHUNK = re.compile(r"\s*\S+|\s+")
BEYOND_LATIN = re.compile("[^\x00-ɏ]")
SPACES = " \n\t\r\x0b\x0c\x85\xa0                　"
#: A space right before a cut; [:12] are those of ASCII.
UNCUT = [space + cut for space in SPACES for cut in " \n"]
WORD_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def vocabulary_text(name: str) -> str:
    """The tokenizer file `name` of the public tokenizers, or any other path, read on the driver."""
    path = name if "/" in name else public_tokenizers.path(name)
    with open(path, encoding="utf-8") as file:
        return file.read()


def loaded(definition: str) -> Tokenizer:
    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def blank_cuts(text: str) -> list[str] | None:
    """The text cut at blanks (which are dropped) and before line feeds (kept); None where a cut is not safe."""
    pairs = UNCUT[:12] if text.isascii() else UNCUT
    if any(pair in text for pair in pairs) or SEPARATORS.search(text):
        return None
    return text.replace("\n", " \n").split(" ")


def plain_word(chunk: str) -> bool:
    return chunk[0] == " " and len(chunk) > 1 and not chunk[1].isspace()


class Cache(dict):
    """A dictionary that computes what it lacks and stays bounded; it starts afresh when it no longer fits the text."""

    missed = 0

    def __missing__(self, chunk):
        value = self.compute(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) < CACHE_ENTRIES:
                self[chunk] = value
            else:
                self.missed += 1
                if self.missed > 8 * CACHE_ENTRIES:
                    self.clear()
                    self.missed = 0
        return value


class ByteLevelIds(Cache):
    """Ids of a byte-level BPE as little-endian unsigned 32-bit integers.

    Keys are chunks without the blank before them; those of a text's first chunk and with a leading line feed have none.
    """

    def __init__(self, definition: str):
        super().__init__()
        self.tokenizer = loaded(definition)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        byte_of = {character: byte for byte, character in byte_alphabet().items()}
        rules = json.loads(definition)["model"]
        ranks = {bytes(byte_of[c] for c in string): i for string, i in rules["vocab"].items()}
        merged = [rules["vocab"]["".join(pair) if isinstance(pair, list) else pair.replace(" ", "")] for pair in rules["merges"]]
        if merged != sorted(merged):
            raise ValueError("the merges are not in the order of the ids")
        self.merges = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def compute(self, chunk: str) -> bytes:
        return self.exact(chunk if chunk[:1] == "\n" else " " + chunk)

    def exact(self, chunk: str) -> bytes:
        if BEYOND_LATIN.search(chunk) or any(special in chunk for special in self.special):
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        else:
            ids = self.merges.encode_ordinary(chunk)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        chunks = blank_cuts(text)
        if chunks is None:
            chunks = [text] if SEPARATORS.search(text) else SPACED_CHUNK.findall(text)
            return b"".join([self[c[1:]] if plain_word(c) else self.exact(c) for c in chunks])
        return self.exact(chunks[0]) + b"".join(map(self.__getitem__, chunks[1:]))


#: What most words are: letters of ASCII and Latin-1, maybe signs behind them that start no contraction; such small letters.
SIGNED = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?)%&$#*]*)")
LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: The bytes of such letters, and others that stand for them at the end of a word.
INNER = [*range(97, 123), 0xC3, *range(0x9F, 0xC0)]
LETTER_BYTES = tuple(bytes.maketrans(bytes(INNER), bytes(range(first, first + len(INNER)))) for first in (1, 1 + len(INNER)))


def letter_merges(definition: str) -> Callable[[bytes], list[int]] | None:
    """The merges of the word BPE on small letters alone, ends of words as bytes of their own; None where its rules are others.

    tiktoken takes a whole word that is in the vocabulary as it is; so all such words are first checked to be one token.
    """
    rules = json.loads(definition)["model"]
    vocab, end = rules["vocab"], rules.get("end_of_word_suffix") or ""
    merged = [vocab["".join(pair) if isinstance(pair, list) else pair.replace(" ", "")] for pair in rules["merges"]]
    if not end or merged != sorted(merged) or rules.get("ignore_merges"):
        return None
    inner, last = (str.maketrans({byte_alphabet()[byte]: chr(table[byte]) for byte in INNER}) for table in LETTER_BYTES)
    known = {byte_alphabet()[byte] for byte in INNER}
    ranks, whole = {}, []
    for string, i in vocab.items():
        bare = string.removesuffix(end) if string != end else string
        if known.issuperset(bare):
            ended = bare != string
            ranks[(bare[:-1].translate(inner) + bare[-1].translate(last if ended else inner)).encode("latin-1")] = i
            whole += [(bare, i)] if ended else []
    tokenize = loaded(definition).model.tokenize
    if any([token.id for token in tokenize(bare)] != [i] for bare, i in whole):
        return None
    used = {key[0] for key in ranks if len(key) == 1}
    ranks |= {bytes([byte]): len(vocab) + byte for byte in range(256) if byte not in used}
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


class WordIds(Cache):
    """Ids of the word BPE, which drops white space, as little-endian unsigned 32-bit integers."""

    def __init__(self, definition: str):
        super().__init__()
        self.tokenizer = loaded(definition)
        self.model = self.tokenizer.model
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = byte_alphabet()
        self.pieces: dict[str, bytes] = {}
        self.letters = letter_merges(definition)

    def compute(self, chunk: str) -> bytes:
        plain = SIGNED.fullmatch(chunk)
        if plain:
            word, signs = plain[1].lower(), plain[2]
            found = self.pieces.get(word) or self.piece(word)
            return found + (self.pieces.get(signs) or self.piece(signs)) if signs else found
        if BEYOND_LATIN.search(chunk) or any(special in chunk for special in self.special):
            return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        return b"".join([self.pieces.get(piece) or self.piece(piece) for piece in WORD_PIECE.findall(chunk.lower())])

    def piece(self, piece: str) -> bytes:
        if self.letters and LETTERS.fullmatch(piece):
            ids = array("I", self.letters(piece.encode().translate(LETTER_BYTES[0])[:-1] + piece[-1:].encode()[-1:].translate(LETTER_BYTES[1]))).tobytes()
        else:
            shown = piece if piece.isascii() else "".join(self.alphabet[byte] for byte in piece.encode())
            if piece.isascii() and not piece.isprintable():
                shown = "".join(self.alphabet[byte] for byte in piece.encode())
            ids = np.array([token.id for token in self.model.tokenize(shown)], "<u4").tobytes()
        if len(self.pieces) < CACHE_ENTRIES and len(piece) <= CACHE_CHARS:
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if SEPARATORS.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


_ENCODERS: dict[tuple[type, int], Cache] = {}


def worker_encoder(kind: type, *definition) -> Cache:
    """The Python worker's encoder; it outlives a task, as its cache should."""
    key = (kind, hash(definition[0]))
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(*definition)
    return _ENCODERS[key]
