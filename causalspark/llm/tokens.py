"""Token ids of texts with the word-level public tokenizer, by remembered words.

The tokenizer splits at white space, lower-cases, and encodes each run of letters, single
digit or run of other characters for itself. So the ids of a text are those of its parts in
order, and a part that was met before need not be encoded again; nor need a run between
white space be split again. A new part is normalised and split already, so the tokenizer's
model gets its bytes directly where the tokenizer file has the steps that this stands for.
Texts with characters outside a range where this is certain are encoded whole. Many texts
together are split by Arrow, and each of their distinct parts is looked up once a block.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_PLAIN = re.compile(r"[^\x09-\x0d\x20-\x7e¡«»¿-ɏ]|<\|")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: The tokenizer's own rule for parts, which _PARTS is in the range of _PLAIN.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: All parts but letters, for Arrow, whose \s is another: with blanks around them, white space splits a text into its parts.
_APART = r"'s|'t|'re|'ve|'m|'ll|'d|\pN|[^\x09-\x0d\x20\pL\pN]+"
#: Bytes of texts, about, that are split together.
BLOCK = 5_000_000
#: Parts, and runs between white space, of a generation that one Python worker remembers. When it is
#: full it becomes the old generation, from which what is met again moves to the new one.
REMEMBERED = 350_000
EOS = 2


class _Remembered(dict):
    """A mapping that computes what it lacks and keeps what was asked for lately."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.most = REMEMBERED

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.compute(key)
        self[key] = out
        return out

    def compute(self, key: str) -> bytes:
        raise NotImplementedError


class _Runs(_Remembered):
    """Maps a run between white space, in lower case, to its ids."""

    def __init__(self, parts: WordEncoder) -> None:
        super().__init__()
        self.parts = parts

    def compute(self, run: str) -> bytes:
        if run.isalpha():  # one part
            return self.parts[run]
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(run)))


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _direct(path: str) -> bool:
    """Whether all that happens to a part before and after the model is that its bytes become byte-level characters."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    steps = (file.get("normalizer") or {}).get("normalizers", [])
    splits = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1] == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": _SPLIT}
        and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
        and not splits[1]["add_prefix_space"]
        and not splits[1].get("use_regex", True)
        and file["model"]["type"] == "BPE"
        and not any(file.get(x) for x in ("post_processor", "truncation", "padding"))
        and all(x["content"].startswith("<|") for x in file.get("added_tokens", []))
    )


class WordEncoder(_Remembered):
    """Maps a part to its ids, as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model if _direct(path) else None
        self.characters = {b: c for c, b in _byte_level().items()}
        self.runs = _Runs(self)

    def compute(self, part: str) -> bytes:
        if self.model is None:
            return self.whole(part)
        if not part.isascii():
            part = "".join(map(self.characters.__getitem__, part.encode()))
        return array("I", [t.id for t in self.model.tokenize(part)]).tobytes()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text (null: none) and the end-of-text id."""
        if not text:
            ids = b""
        elif _PLAIN.search(text):
            ids = self.whole(text)
        else:
            ids = b"".join(map(self.runs.__getitem__, text.lower().split()))
        return ids + EOS.to_bytes(4, "little")

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By blocks of texts: the number of ids of each, and all ids one after the other, as `encode` gives them."""
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(texts):
            hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, side="right")), lo + 1)
            yield self._block(texts.slice(lo, hi - lo))
            lo = hi

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _PLAIN.pattern).fill_null(False).to_numpy(zero_copy_only=False)
        every = texts.to_pylist()
        lower = pa.array(["" if o or not t else t.lower() for o, t in zip(odd, every, strict=True)], pa.string())
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(lower, _APART, r" \0 "))
        coded = parts.values.dictionary_encode()
        known = [self[p] for p in coded.dictionary.to_pylist()]
        offsets = np.cumsum([0, *map(len, known)], dtype=np.int64) // 4
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(known), dtype="<u4"))).take(coded.indices)
        bounds = ids.offsets.to_numpy()[parts.offsets.to_numpy()]
        out, sizes = np.insert(ids.values.to_numpy(), bounds[1:], EOS), np.diff(bounds) + 1
        pieces, at, ends = [], 0, np.cumsum(sizes)
        for k in np.flatnonzero(odd):  # the end-of-text id alone so far
            own = np.frombuffer(self.encode(every[k]), dtype="<u4")
            pieces += [out[at : ends[k] - 1], own]
            at, sizes[k] = ends[k], len(own)
        return sizes, np.concatenate([*pieces, out[at:]])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> WordEncoder:
    """The encoder of this Python worker; it lives as long as the worker, and remembers so many parts a generation."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    out = _ENCODERS[path]
    out.most = out.runs.most = remembered
    return out


def forget() -> None:
    """Free what this Python worker's encoders remember: for operators that do not tokenise and run in it later."""
    for e in _ENCODERS.values():
        for m in (e, e.old, e.runs, e.runs.old):
            m.clear()


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
