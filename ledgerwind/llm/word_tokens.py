"""Token ids of whole texts by a public tokenizers file, with bounded caches of encoded words."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Chunks that each of a worker's two generations may hold (about 200 bytes each), and bytes of long ones besides.
CHUNKS_KEPT, LONG, LONG_BYTES = 150_000, 64, 8_000_000
#: Pieces of plain chunks, in lower case, that a worker keeps besides.
PIECES_KEPT = 200_000
#: Chunks of these characters need no NFC, have one plain lower case and hold no special token.
PLAIN = re.compile("[!-;=-~À-ÖØ-öø-ÿ]+").fullmatch
#: The pre-tokenizer's pattern for such chunks in lower case.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet for str.translate: printable Latin-1 stands for itself, other bytes follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts chunk by chunk between ASCII white space, which no token of this tokenizer crosses.

    The normalizer (NFC, white space, lower case), the special tokens' search and the pre-tokenizer all work
    within such chunks, so the ids are those of the whole text. Chunks are encoded once and kept in two generations:
    when the newer one is full it becomes the older, whose chunks are taken over when they are met again. Chunks of
    plain Latin letters go to the library's BPE model piece by piece, others through its whole chain.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokens = self.tokenizer.model.tokenize
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pieces: dict[str, bytes] = {}
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.packers = [struct.Struct(f"<{n}{self.code}").pack for n in range(32)]
        self.letters = byte_letters()
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.long = 0

    def encode(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian numbers of self.dtype."""
        chunks = text.split()
        if fresh := set(chunks).difference(self.new):
            if len(self.new) > CHUNKS_KEPT or self.long > LONG_BYTES:
                self.old, self.new, self.long = self.new, {}, 0
                fresh = set(chunks)
            new, old, piece, rest = self.new, self.old.get, self._piece, []
            for chunk in fresh:
                if (ids := old(chunk)) is None:
                    if chunk.isalpha():  # of bytes: ASCII letters only
                        ids = piece(chunk.lower().decode())
                    elif PLAIN(word := chunk.decode("utf-8", "replace")):
                        ids = b"".join(map(piece, PIECES(word.lower())))
                    else:
                        rest.append((chunk, word))
                        continue
                new[chunk] = ids
                if len(ids) > LONG:
                    self.long += len(ids) + len(chunk)
            if rest:
                for (chunk, _), x in zip(rest, self.tokenizer.encode_batch_fast([w for _, w in rest], add_special_tokens=False), strict=True):
                    new[chunk] = np.array(x.ids, self.dtype).tobytes()
                    self.long += len(chunk)
        return b"".join(map(self.new.__getitem__, chunks))

    def _piece(self, piece: str) -> bytes:
        if (known := self.pieces.get(piece)) is not None:
            return known
        if len(self.pieces) >= PIECES_KEPT:
            self.pieces.clear()
        ids = [t.id for t in self.tokens(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))]
        packed = self.pieces[piece] = self.packers[len(ids)](*ids) if len(ids) < 32 else struct.pack(f"<{len(ids)}{self.code}", *ids)
        return packed


#: Rows of a result batch, so that a batch of long texts doesn't have all of its ids in memory at once.
ROWS = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
