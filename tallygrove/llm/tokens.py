"""Ids of texts as the libraries of public tokenizer files give them, for texts of any length.

A byte-level BPE file is run by tiktoken, about four times as fast as the
library that the file is made for, with the same ids (tested).  Its pattern
can't take runs of about a million white-space characters: such a run is one
token of the pattern but for its last character, so it is cut out and encoded
by the file's own library.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from functools import cache

import numpy as np

#: Characters of white space from which a run is cut out.
LONG_RUN = 1 << 14
#: White space of the tokenizers' pattern: that of Unicode, which lacks four control characters that Python counts too.
_RUN = re.compile(r"[^\S\x1c-\x1f]{%d,}" % LONG_RUN)


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


@cache
def _file(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def is_byte_level(path: str) -> bool:
    """Whether a file is plain byte-level BPE, whose special tokens stand for exactly their own characters."""
    if not path.endswith(".json"):
        return False
    file = _file(path)
    before, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = not file.get("normalizer") and model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    exact = all(x["special"] and not any(x[y] for y in ("lstrip", "rstrip", "single_word")) and not re.search(r"\s", x["content"]) for x in file["added_tokens"])
    return bool(plain and level and exact)


@cache
def _own_library(path: str, plain: bool):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.encode_special_tokens = plain
    return found


@cache
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def _byte_level(path: str):
    import public_tokenizers
    import tiktoken

    to_byte = _bytes_of_characters()
    special = {x["content"]: x["id"] for x in _file(path)["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in word): i for word, i in _file(path)["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special)


def _parts(text: str, special: tuple[str, ...]):
    """A text cut where the pattern cuts it anyhow, so that long white space stands alone: (part, whether it is such a run).

    The pattern sees the text between special tokens.
    """
    at = 0
    for run in _RUN.finditer(text):
        # the last character of a run that something follows belongs to what follows
        end = run.end() if run.end() == len(text) or text.startswith(special, run.end()) else run.end() - 1
        yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    yield text[at:], False


def encoder(path: str, plain: bool = False) -> Callable[[list[str]], list[list[int]]]:
    """Ids of each text, without any that mark its ends, cut to no length.

    ``path`` is a .json file or a .model file.  With ``plain`` the strings of special tokens inside a text are
    ordinary text; else they are what the file's library makes of them by default.
    """
    if path.endswith(".model"):
        return lambda texts: _pieces(path).encode(texts, num_threads=1)
    if not is_byte_level(path):
        own = _own_library(path, plain)
        return lambda texts: [own.encode(text, add_special_tokens=False).ids for text in texts]
    fast, special = _byte_level(path)

    def one(text: str) -> list[int]:
        if plain or not any(s in text for s in special):
            return fast.encode_ordinary(text)
        return fast.encode(text, allowed_special="all")

    def ids(texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            if len(text) < LONG_RUN or not _RUN.search(text):
                out.append(one(text))
            else:
                own = _own_library(path, plain)
                out.append([i for part, run in _parts(text, () if plain else special) for i in (own.encode(part, add_special_tokens=False).ids if run else one(part))])
        return out

    return ids


def version(path: str, plain: bool = False) -> str:
    """A digest of all that ids depend on: the file, its library's release and how special strings are taken."""
    with open(path, "rb") as f:
        found = hashlib.sha256(f.read())
    import sentencepiece
    import tiktoken
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__} tiktoken {tiktoken.__version__}"
    found.update(f"|{library}|{plain}".encode())
    return found.hexdigest()


@cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes that each id stands for: of byte-level BPE, or of pieces with byte fallback."""
    if path.endswith(".model"):
        from_piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
        return [from_piece(_pieces(path).id_to_piece(i)) for i in range(_pieces(path).get_piece_size())]
    to_byte = _bytes_of_characters()
    special = {x["content"] for x in _file(path)["added_tokens"]}
    words = {i: word.encode() if word in special else bytes(to_byte[c] for c in word) for word, i in _file(path)["model"]["vocab"].items()}
    words |= {x["id"]: x["content"].encode() for x in _file(path)["added_tokens"]}
    return [words.get(i, b"") for i in range(max(words) + 1)]


def narrow(size: int) -> np.dtype:
    """The smallest type of ids below ``size``."""
    return np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
