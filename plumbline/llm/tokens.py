"""Token ids of whole texts by a public tokenizer, with a bounded cache of pieces of texts.

Both supported pre-tokenizers always break a text before an ASCII white-space character that follows a character which
isn't white space, and what stands after such a break doesn't depend on what stands before it. So texts are cut there,
each different part of some MB of texts is encoded once, and the ids of a text are those of its parts in order. A part of
ASCII and Latin-1 letters alone is split into its pieces here, and only pieces that aren't in the cache go to the
tokenizer's model, as the library's own splitting takes most of its time; any other part is encoded by the whole tokenizer
and kept. A text that holds an added token's content goes to the tokenizer whole, which gives it the token's id.
`exact_cuts=False` encodes whole texts instead; tests hold both ways against each other.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bytesops import slices

#: Pieces kept in the two generations of the cache, and as many parts that aren't simple.
CACHE_PARTS = 800_000
#: Bytes of text that are encoded together, for each piece that may be kept; more takes memory, less takes time.
TEXT_BYTES = 10
#: Longer parts are encoded each time.
LONGEST_PART = 64

#: What keeps a text from being cut at its spaces alone: two of them or of line breaks in a row, or other white space.
#: Each is sought by itself, which takes a tenth of a regular expression's time.
_IRREGULAR = ("  ", " \n", "\n ", "\n\n", *"\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff")
_CUT = re.compile(r"(?<=[^\s᠎​﻿])(?=[ \t\n\r])")
#: The two pre-tokenizers' patterns over ASCII and Latin-1 letters.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SIMPLE = re.compile(rf"[ \n]?[!-~{_LETTER}]+")
#: Stands between simple parts, which don't have it.
_BETWEEN = "\0"
_SPACED_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s\x000-9{_LETTER}]+|\s|\x00")
_BARE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s\x000-9{_LETTER}]+|\x00")


def _printable_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _printable_bytes()
_SPACE = _ALPHABET[32]
_encoders: dict[tuple[str, int], PartEncoder] = {}


class PartCache(dict):
    """Ids of pieces or parts of texts, encoded when they are first asked for.

    Two generations bound its size, also within a text: what is used in the younger one, the mapping itself, stays.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self.encode, self.most = encode, most
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.encode(part)
            if len(part) > LONGEST_PART:
                return ids
        if len(self) >= self.most:
            self.old.clear()
            self.old.update(self)
            self.clear()
        self[part] = ids
        return ids


class PartEncoder:
    """Encodes texts to unsigned 32-bit ids, in the byte order of the machine (little-endian on all that Spark runs on)."""

    def __init__(self, path: str, exact_cuts: bool = True, cache_parts: int = CACHE_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.cuts, self.cache_parts = exact_cuts, cache_parts
        self.lowers = self.tokenizer.normalizer is not None
        self.pattern = _BARE_PIECES if self.lowers else _SPACED_PIECES
        self.pieces = PartCache(self._encode_piece, max(1, cache_parts // 2))
        self.hard = PartCache(lambda part: self._encode([part])[0], max(1, cache_parts // 2))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_piece(self, piece: str) -> bytes:
        if piece == _BETWEEN:
            return b""
        if piece.isascii() and (piece.isalpha() or piece[0] == " " and piece[1:].isalpha()):
            written = piece if piece[0] != " " else _SPACE + piece[1:]
        else:
            written = piece.encode().decode("latin-1").translate(_ALPHABET)
        return array("I", [token.id for token in self.tokenize(written)]).tobytes()

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """The ids of each part. Simple ones are split into pieces together, as one text with a mark between them."""
        simple = list(map(_SIMPLE.fullmatch, parts))
        joined = _BETWEEN.join(compress(parts, simple))
        found = list(map(self.pieces.__getitem__, self.pattern.findall(joined.lower() if self.lowers else joined)))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = b"".join(found)
        marks = np.cumsum(sizes)[sizes == 0].tolist()
        cut = zip(compress(range(len(parts)), simple), [0, *marks], [*marks, len(ids)], strict=True) if joined else ()
        out = [b""] * len(parts)
        for i, start, end in cut:
            out[i] = ids[start:end]
        for i, part in enumerate(parts):
            if not simple[i]:
                out[i] = self.hard[part]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes.

        Each different part of all these texts is encoded once. In most texts a single space or line break stands between
        two words; there the words after the first, without their space, are found and put together by Arrow.
        """
        if not self.cuts:
            return self._encode(texts)
        out, others, spaced = [b""] * len(texts), {}, {}
        for i, text in enumerate(texts):
            if any(content in text for content in self.added):
                out[i] = self._encode([text])[0]
            elif not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _IRREGULAR):
                others[i] = _CUT.split(text)
            else:
                first, _, spaced[i] = text.replace("\n", " \n").partition(" ")
                others[i] = [first]
        parts = list(dict.fromkeys(chain.from_iterable(others.values())))
        ids_of = dict(zip(parts, self._encode_parts(parts), strict=True)).__getitem__
        for i, parts in others.items():
            out[i] = b"".join(map(ids_of, parts))
        words = pc.split_pattern(pa.array(spaced.values(), pa.large_string()), " ")
        coded = words.flatten().dictionary_encode()
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if not self.lowers:  # else spaces don't count; an empty word: the text has no second one
            parts = [part if not part or part[0] == "\n" else " " + part for part in parts]
        ids = pa.array(self._encode_parts(parts), pa.large_binary()).take(coded.indices)
        _, ends, data = ids.buffers()
        if data is not None:
            ends = np.frombuffer(ends, np.int64, len(ids) + 1)[words.offsets.to_numpy()].tolist()
            for i, start, end in zip(spaced, ends, ends[1:], strict=False):
                out[i] += data[start:end].to_pybytes()
        return out


def encoder(path: str, cache_parts: int = CACHE_PARTS) -> PartEncoder:
    """The encoder of this process for a tokenizer file."""
    if (path, cache_parts) not in _encoders:
        _encoders[path, cache_parts] = PartEncoder(path, cache_parts=cache_parts)
    return _encoders[path, cache_parts]


def encoded(batches: Iterator[pa.RecordBatch], path: str, cache_parts: int = CACHE_PARTS) -> Iterator[tuple[list[int | None], list[str], list[bytes]]]:
    """The doc_ids, texts (null: empty) and ids of each slice of the batches; several slices are encoded together."""
    encode, most = encoder(path, cache_parts).encode, TEXT_BYTES * cache_parts
    held: list[tuple[list[int | None], list[str]]] = []
    size = 0

    def done() -> Iterator[tuple[list[int | None], list[str], list[bytes]]]:
        ids = iter(encode(list(chain.from_iterable(texts for _, texts in held))))
        for doc_ids, texts in held:
            yield doc_ids, texts, list(islice(ids, len(texts)))
        held.clear()

    for batch in batches:
        for piece in slices(batch, "text"):
            held.append((piece.column("doc_id").to_pylist(), [text or "" for text in piece.column("text").to_pylist()]))
            size += piece.column("text").nbytes
            if size >= most:
                yield from done()
                size = 0
    yield from done()


def public_path(name: str) -> str:
    """Where an installed public tokenizer file is."""
    import public_tokenizers

    return public_tokenizers.path(name)
