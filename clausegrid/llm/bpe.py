"""Byte-level BPE of whole texts with the ids of a ``tokenizers`` file.

The file's vocabulary numbers each merged token in the order of its merge, so a rank-based
encoder (tiktoken) over the same vocabulary gives the same ids several times faster; that
order is checked when a file is loaded. Texts on which the two libraries' splitting could
part (control characters, special-token strings, scripts on which Unicode tables may
differ), and files whose ids are not in merge order, go to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex

#: Characters on whose class two pattern engines, or their Unicode tables, may differ, outside Latin-1.
_ODD = regex.compile(r"[\x00-\x09\x0b-\x1f\x7f-\xa0]|[^\x00-ӿ‐-‧‰-⁞€]")
#: How the byte-level pre-tokenizer splits a text: fixed by the vocabulary. Possessive, so that no run is tried twice.
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _byte_characters() -> dict[str, int]:
    """The characters in which byte-level vocabularies spell bytes: printable Latin-1 as itself, the rest from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _is_plain(text: str) -> bool:
    if "<|" in text:
        return False
    if text.replace("\n", "").isprintable():
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            pass
    return _ODD.search(text) is None


class Encoder:
    """Tokens of texts under a ``tokenizers`` file; one per worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return
        spelled = _byte_characters()
        added = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(spelled[c] for c in token): k for token, k in model["vocab"].items() if token not in added}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if all(model["vocab"][a + b] == 256 + k for k, (a, b) in enumerate(pairs)):
            import tiktoken

            self.fast = tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            for token, k in ranks.items():
                self.length[k] = len(token)

    def ids(self, text: str) -> np.ndarray:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.fast is not None and _is_plain(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the tokens in characters; a token spans every character of which it holds a byte."""
        if self.fast is None or not _is_plain(text):
            both = np.array(self.whole.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
            return both[:, 0], both[:, 1]
        ends = np.cumsum(self.length[self.ids(text)])
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        if text.isascii():
            return starts, ends
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[starts], char[ends - 1] + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
