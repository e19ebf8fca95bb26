"""Tokenizer ids of whole texts, with a bounded memory of words already seen.

The vocabulary's pre-tokenizer never joins characters across white space, so a
text's ids are those of its white-space chunks, one after the other. Texts that
hold only ASCII or Latin-1 letters, digits and ASCII punctuation are cut into
lower-case pieces at once, and so are such chunks of other texts; the library's model
merges each new piece. Any other chunk, and any text whose white space or
composition the library may see differently, goes to the library as it is.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable
from struct import pack

import numpy as np
import pyarrow as pa

#: Entries in each memory before it starts anew; bounds a worker to some 200 MB.
MOST = 400_000
#: Characters whose missing words go to the library in one call.
SLICE = 1 << 20
LATIN = "A-Za-z0-9!-/:-@\\[-`{-~À-ÖØ-öø-ÿ"
PLAIN = re.compile(f"[{LATIN}]+")
PLAIN_TEXT = re.compile(f"[{LATIN} \\t\\n\\r]*")
SPECIAL = "<|"
#: White space that the two sides may split differently, characters that compose across chunks, special tokens.
ODD = re.compile("[^\\S \\t\\n\\r]|[\u0300-\u036f\u1100-\u11ff]|<\\|")
#: What the vocabulary file's Split rule keeps, for lower-case text of PLAIN's characters.
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
_encoders: dict[str, Callable[[list[str]], list[bytes]]] = {}


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian uint32 bytes; one per process and path."""
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        _encoders[path] = _with_memory(Tokenizer.from_file(path), ByteLevel(add_prefix_space=False, use_regex=False))
    return _encoders[path]


def forget() -> None:
    """A worker is used again by whatever stage comes next; what was remembered for tokenizing goes then."""
    if _encoders:
        _encoders.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def _with_memory(tokenizer, level) -> Callable[[list[str]], list[bytes]]:
    chunks: dict[str, bytes] = {}
    pieces: dict[str, bytes] = {}
    merged = tokenizer.model.tokenize
    # the model sees a character as the byte level's signs for its UTF-8 bytes
    signs = {n: level.pre_tokenize_str(chr(n))[0][0] for n in range(0x80, 0x100)}

    def library(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_pieces(cut: list[list[str]]) -> None:
        for p in set().union(*cut) - pieces.keys():
            ids = [t.id for t in merged(p if p.isascii() else p.translate(signs))]
            pieces[p] = pack(f"<{len(ids)}I", *ids)

    def learn(missing: list[str]) -> None:
        """Puts the ids of chunks into the memory."""
        plain = [c for c in missing if PLAIN.fullmatch(c) and SPECIAL not in c]
        cut = [PIECE.findall(c.lower()) for c in plain]
        learn_pieces(cut)
        get = pieces.__getitem__
        chunks.update((c, b"".join(map(get, parts))) for c, parts in zip(plain, cut))
        rest = [c for c in missing if c not in chunks]
        chunks.update(zip(rest, library(rest)))

    def some(texts: list[str]) -> list[bytes]:
        for memory in (chunks, pieces):
            if len(memory) > MOST:
                memory.clear()
        plain = [PLAIN_TEXT.fullmatch(t) is not None and SPECIAL not in t for t in texts]
        cut = [PIECE.findall(t.lower()) for t, p in zip(texts, plain) if p]
        learn_pieces(cut)
        get = pieces.__getitem__
        whole = (b"".join(map(get, parts)) for parts in cut)
        split = [None if p or (ODD.search(t) and not PLAIN_TEXT.fullmatch(t)) else t.split() for t, p in zip(texts, plain)]
        learn(list({c for parts in split if parts for c in parts if c not in chunks}))
        of_chunk = chunks.__getitem__
        return [next(whole) if p else library([t])[0] if parts is None else b"".join(map(of_chunk, parts)) for t, p, parts in zip(texts, plain, split)]

    def encode(texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        slice_, size = [], 0
        for text in texts:
            slice_.append(text)
            size += len(text)
            if size >= SLICE:
                out += some(slice_)
                slice_, size = [], 0
        return out + some(slice_)

    return encode
