"""Byte-level BPE encoding by a public vocabulary file."""

from __future__ import annotations

import functools
import json

#: The split pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Above so many characters a text goes to the slower library, which copes with any run of spaces or letters.
LONG = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """text -> list of ids, equal to tokenizers' encode(text, add_special_tokens=False).ids.

    Where the file is a plain byte-level BPE whose ids are its merge ranks, a faster library gives the same ids;
    texts that hold an added token's string, and very long ones, stay with the first.
    """
    from tokenizers import Tokenizer

    @functools.cache
    def slow():  # tens of MB that most workers never need
        return Tokenizer.from_file(path)

    plain = lambda text: slow().encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    added = [t["content"] for t in spec.get("added_tokens", [])]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges") or []]
    if not (
        model.get("type") == "BPE"
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and spec.get("normalizer") is None
        and all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    ):
        return plain
    import tiktoken

    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        if len(text) > LONG or any(t in text for t in added):
            return plain(text)
        return fast(text)

    return encode
