"""Token ids of a byte-level BPE file of the ``tokenizers`` library.

The library encodes about 1 MB a second and core; ``tiktoken`` with the same vocabulary gives the same ids about eight times as
fast (``tests/llm/test_encode.py`` holds one against the other). The library itself is kept for files that are no plain
byte-level BPE and for texts on which the fast path fails.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import numpy as np

# Fixed value: how byte-level BPE files of this kind split a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _printable_bytes() -> dict[str, int]:
    """The letters that byte-level files write for bytes: printable bytes as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def _fast(path: str):
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        return None
    special = {x["content"]: x["id"] for x in added}
    of, vocab = _printable_bytes(), {k: v for k, v in model["vocab"].items() if k not in special}
    ranks = {bytes(of[c] for c in k): v for k, v in vocab.items()}
    joined = [vocab["".join(x.split(" ") if isinstance(x, str) else x)] for x in model["merges"]]
    if joined != sorted(joined) or any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in added):
        return None
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to its ids as unsigned 32-bit integers, no special tokens added; one per worker process and file."""
    fast, slow = _fast(path), []

    def whole(text: str) -> np.ndarray:
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(path))
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def ids(text: str) -> np.ndarray:
        if fast is not None:
            try:
                return np.array(fast.encode(text, allowed_special="all"), dtype=np.uint32)
            except BaseException as e:  # a panic of the native code is no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                    raise
        return whole(text)

    return ids
