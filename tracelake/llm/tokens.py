"""Subword ids of whole texts, word by word.

The tokenizer drops white space and never joins across it, so a text's ids are
the ids of its space-separated words in order. Words repeat: each worker keeps
the packed ids of the words it has met, within a bound, and asks the tokenizer
only for new ones.
"""

from __future__ import annotations

import ctypes
import os
import re
from array import array

import numpy as np

LONG = 64
#: Printable ASCII and Latin letters without the apostrophe, whose contractions are pre-tokens of their own, and the pre-tokens of such words.
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]{1,64}")
_PLAIN_LONG = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class WordTokenizer:
    #: Words a worker remembers.
    keep = 800_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces: dict[str, bytes] = {}
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.as_bytes = {c: spell(chr(c))[0][0] for c in (*range(33, 127), *range(0xC0, 0x100))}
        self.known: dict[bytes, bytes] = {}

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        out, rest = {}, []
        for w in new:
            text = w.decode()
            if _PLAIN.fullmatch(text) and "<|" not in text:
                out[w] = b"".join(map(self._piece, _PIECE.findall(text.lower())))
            else:
                rest.append((w, text))
        got = self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
        return out | {w: np.array(e.ids, "<u4").tobytes() for (w, _), e in zip(rest, got)}

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token of a plain word, from the model alone: normalising changes nothing but the case of such words."""
        if piece not in self.pieces:
            if len(self.pieces) > self.keep:
                self.pieces.clear()
            self.pieces[piece] = array("I", (t.id for t in self.model.tokenize(piece.translate(self.as_bytes)))).tobytes()
        return self.pieces[piece]

    def pack(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        split = [t.split() for t in texts]
        known = self.known
        if len(known) > self.keep:
            known.clear()
        out = [list(map(known.get, ws)) for ws in split]
        lacking = [i for i, got in enumerate(out) if None in got]
        new = list({w for i in lacking for w, got in zip(split[i], out[i]) if got is None})
        for i in range(0, len(new), 20_000):
            known.update(self._learn(new[i : i + 20_000]))
        for i in lacking:
            out[i] = map(known.__getitem__, split[i])
        out = list(map(b"".join, out))
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out


class RankTokenizer(WordTokenizer):
    """The same over a file of byte-pair ranks; a word is encoded with a space before it."""

    keep = 800_000

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = {}
        #: Whether an id's bytes start with a space, as the first id of every word does.
        self.opens = np.zeros(max(ranks.values()) + 1, bool)
        self.opens[[i for t, i in ranks.items() if t.startswith(b" ")]] = True

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Words of plain letters and signs are encoded many at a time, as a text; spaces part them there as they do alone."""
        encode, fits = self.encoding.encode_ordinary, _PLAIN_LONG.fullmatch
        plain = [w for w in new if fits(w.decode())]
        ids = np.array(encode(b"".join([b" ", b" ".join(plain)]).decode() if plain else ""), "<u4")
        first = np.append(np.flatnonzero(self.opens[ids]), len(ids)) * 4
        out: dict[bytes, bytes] = {}
        if len(first) == len(plain) + 1:
            out = dict(zip(plain, map(ids.tobytes().__getitem__, map(slice, first.tolist(), first[1:].tolist()))))
        for w in new if len(out) < len(new) else ():
            if w not in out:
                out[w] = array("I", encode(" " + w.decode())).tobytes()
        return out


_HERE: dict[tuple, WordTokenizer] = {}


def _once(kind: type, path: str) -> WordTokenizer:
    """One per worker process and file."""
    if (kind, path) not in _HERE:
        _HERE[kind, path] = kind(path)
    return _HERE[kind, path]


def forget() -> None:
    """Drops this worker's tokenizers and the words they remember, up to 200 MB, and gives the memory back: workers live on from stage to stage."""
    _HERE.clear()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def rank_tokenizer(path: str) -> WordTokenizer:
    return _once(RankTokenizer, path)


def word_tokenizer(path: str) -> WordTokenizer:
    return _once(WordTokenizer, path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
