"""Public vocabularies on executors: loaded once a worker process, with bounded word caches.

Both tokenizers used here cut before a single space that has no white space on one of its
sides, so a text's ids are those of the pieces between such spaces, one after another, and
a piece needs to be encoded once.  A cache holds at most twice ``CACHE`` pieces of at most ``LONGEST``
characters: when it is full what was not used since it was last full goes.
"""

from __future__ import annotations

import base64
import re

import numpy as np

CACHE = 60_000
LONGEST = 64
_GAP = re.compile(r"(?<=\S) (?=[^ ])|(?<=[^ ]) (?=\S)")
_ODD = re.compile(r" [^\S ]")
_loaded: dict[tuple[str, str], dict] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str) -> list[str]:
    """Cut at each single space that has no white space on one side; the space itself is dropped."""
    if "  " in text or text[:1] == " " or text[-1:] == " " or _ODD.search(text):
        return _GAP.split(text)
    return text.split(" ")


class _Cache(dict):
    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def sentencepiece_cache(path: str) -> dict:
    """piece -> its ids (uint16, bytes) in a SentencePiece model of at most 65,536 pieces."""
    if ("sp", path) not in _loaded:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.get_piece_size() > 65536:
            raise ValueError("ids must fit 16 bits")
        _loaded["sp", path] = _Cache(lambda s: np.array(sp.encode(s), dtype="<u2").tobytes())
    return _loaded["sp", path]


def piece_ids(cache: dict, text: str) -> np.ndarray:
    """Ids of a whole text, with the model's leading space; an empty text has none."""
    if not text:
        return np.empty(0, dtype="<u2")
    if "\u2581" in text:  # the model's own sign for a space: pieces could meet there
        return np.frombuffer(cache.encode(text), dtype="<u2")
    return np.frombuffer(b"".join([cache[p] for p in pieces(text)]), dtype="<u2")


class ByteLevel:
    """Ids of a byte-level BPE vocabulary as ``tokenizers`` gives them.

    Pieces go through the same vocabulary as ranks, which is several times faster; a text
    with the string of a special token, which ``tokenizers`` may treat apart, goes to it whole.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str) -> None:
        import json

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.json_path, self.whole = json_path, None
        encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = encoding.encode_ordinary
        self.first = _Cache(lambda s: np.array(self.plain(s), dtype="<u2").tobytes())
        self.later = _Cache(lambda s: np.array(self.plain(" " + s), dtype="<u2").tobytes())

    def ids(self, text: str) -> bytes:
        """Little-endian uint16 ids of a whole text."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json_path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()
        head, *rest = pieces(text)
        later = self.later
        return b"".join([self.first[head], *[later[p] for p in rest]])


def byte_level(name: str = "byte_bpe_50k") -> ByteLevel:
    if ("bytes", name) not in _loaded:
        import public_tokenizers

        _loaded["bytes", name] = ByteLevel(vocabulary_path(f"{name}.json"), vocabulary_path(f"{name}.tiktoken"), public_tokenizers.PATTERN)
    return _loaded["bytes", name]
