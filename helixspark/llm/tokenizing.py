"""Public tokenizers behind one small interface, and overlap resynchronisation for huge texts.

A text longer than ``CHUNK`` characters is encoded in overlapping chunks, so that the encoder's memory is bounded by the
chunk and not by the text. Two neighbouring encodings are spliced at a position p of their overlap for which

* the text has a place at p that no piece of any of these vocabularies reaches across: a single space between two
  characters that are no white space (for the byte-level kinds also a line feed, and the border between a CJK letter and a
  CJK punctuation mark), so the encoding right of p depends on nothing left of it, and the other way round, and
* both encodings have a token boundary at p, and agree on the ``AGREE`` tokens left and right of it.

Where no such place exists in the overlap (one endless word, a run of white space), the overlap is doubled, and at last
the chunk goes on to the next stable place behind it, where splicing starts again: only the run itself is encoded in one
piece, and the count stays exact.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np

CHUNK, OVERLAP, AGREE = 1 << 16, 1 << 10, 2
ENDOFTEXT = "<|endoftext|>"
#: No white space by any library's tables (those of Python, and two characters that older tables count in).
_NO_BLANK = "[^\\s\u180e\u200b]"
_LETTER, _MARK = "[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]", "[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f]"
SPACE = re.compile(f"(?<={_NO_BLANK}) (?={_NO_BLANK})")
#: Begins and ends with no white space.
SOLID = re.compile(f"{_NO_BLANK}(?:.*{_NO_BLANK})?\\Z", re.DOTALL)
BYTE_LEVEL = re.compile(f"(?<={_NO_BLANK})[ \n](?={_NO_BLANK})|(?<={_LETTER})(?={_MARK})|(?<={_MARK})(?={_LETTER})")


class ByteRanks:
    """Byte-level BPE from a rank file (.tiktoken); offsets are UTF-8 bytes."""

    unit, stable = "byte", BYTE_LEVEL

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._engine(ranks, 50256)

    def _engine(self, ranks: dict[bytes, int], end: int) -> None:
        import public_tokenizers
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={ENDOFTEXT: end})
        self.sizes = np.zeros(max(end, *ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.sizes[end] = len(ENDOFTEXT)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode(text, allowed_special="all", disallowed_special=()), np.uint32)

    def ids_and_ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = self.ids(text)
        return ids, np.cumsum(self.sizes[ids])

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return [self.ids(t) for t in texts]


class Json:
    """A tokenizers file (.json); offsets are characters."""

    unit, stable = "char", SPACE

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def ids(self, text: str) -> np.ndarray:
        return self.batch([text])[0]

    def ids_and_ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(e.ids, np.uint32), np.array([b for _, b in e.offsets], np.int64)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}


class ByteLevelJson(ByteRanks):
    """A byte-level tokenizers file. Texts of up to CHUNK characters are encoded by the ranks of the file's own vocabulary,
    which takes a third of the time; longer ones (runs on which that engine's pattern search gives up) by the file's library."""

    def __init__(self, tokenizer):
        byte = byte_letters()
        self.library = Json(tokenizer)
        self._engine({bytes(byte[c] for c in token): i for token, i in tokenizer.get_vocab().items() if token != ENDOFTEXT}, tokenizer.token_to_id(ENDOFTEXT))

    def ids(self, text: str) -> np.ndarray:
        return super().ids(text) if len(text) <= CHUNK else self.library.ids(text)


def _json(path: str) -> Json | ByteLevelJson:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = tokenizer.get_added_tokens_decoder()
    plain = isinstance(tokenizer.pre_tokenizer, ByteLevel) and tokenizer.normalizer is None and [t.content for t in special.values()] == [ENDOFTEXT]
    return ByteLevelJson(tokenizer) if plain and _plain_ranks(path) else Json(tokenizer)


def _plain_ranks(path: str) -> bool:
    """Whether a byte-level file splits and merges as its vocabulary's ranks alone say: no option that changes either, merges in the order of ids."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    pre, model = raw["pre_tokenizer"], raw["model"]
    options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(model.get(k) for k in options):
        return False
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    return len(merged) + 256 == len(model["vocab"]) - (ENDOFTEXT in model["vocab"]) and all(a < b for a, b in zip([255, *merged], merged, strict=False))


class Pieces:
    """A sentencepiece model (.model); offsets are UTF-8 bytes."""

    unit, stable = "byte", SPACE

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.uint32)

    def ids_and_ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(text, return_type="proto").pieces
        return np.array([p.id for p in found], np.uint32), np.array([p.end for p in found], np.int64)

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.model.encode(texts, num_threads=1)]


@cache
def load(name: str):
    """The encoder for a file name of the public tokenizers, or a path. One per Python worker."""
    import public_tokenizers

    path = name if os.path.sep in name else public_tokenizers.path(name)
    kinds = {".tiktoken": ByteRanks, ".json": _json, ".model": Pieces}
    return kinds[os.path.splitext(path)[1]](str(path))


def encode_all(encoder, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP, some: int = 64) -> Iterator[tuple[np.ndarray, int, int]]:
    """What encode_spliced gives for each text; texts of a chunk at most go to the library ``some`` at a time."""
    for k in range(0, len(texts), some):
        part = texts[k : k + some]
        short = iter(encoder.batch([t for t in part if len(t) <= chunk]))
        for t in part:
            yield (next(short), 0, 0) if len(t) <= chunk else encode_spliced(encoder, t, chunk, overlap)


def _place(text: str, start: int, p: int, unit: str) -> int:
    return p - start if unit == "char" else len(text[start:p].encode())


def _agree(ids: np.ndarray, i: int, ids2: np.ndarray, j: int) -> bool:
    """Whether the tokens around place i of ids are those around place j of ids2."""
    n = min(AGREE, i, j)
    return bool((ids[i - n : i + AGREE] == ids2[j - n : j + AGREE]).all()) if len(ids) >= i + AGREE and len(ids2) >= j + AGREE else False


def encode_spliced(encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, int, int]:
    """The ids of the whole text, the number of splices and the number of times that an overlap was widened."""
    if len(text) <= chunk:
        return encoder.ids(text), 0, 0
    out, splices, widened = [], 0, 0
    start, end, context = 0, chunk, 0
    ids, ends = encoder.ids_and_ends(text[:end])
    while end < len(text):
        width = overlap
        while True:
            begin = max(start, end - width)
            stop = min(len(text), begin + max(chunk, 2 * width))
            ids2, ends2 = encoder.ids_and_ends(text[begin:stop])
            at = None
            # the last quarter of the overlap may still change with what follows; its first tokens lack what precedes
            for m in encoder.stable.finditer(text, begin + width // 4, end - width // 4):
                a, b = _place(text, start, m.start(), encoder.unit), _place(text, begin, m.start(), encoder.unit)
                i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends2, b, "right"))
                if i and j and ends[i - 1] == a and ends2[j - 1] == b and _agree(ids, i, ids2, j):
                    at = (m.start(), i, j, b)
                    break
            if at or begin == start:
                break
            width, widened = 2 * width, widened + 1
        if at is None:  # no stable place since the last splice: go on to the next one, and splice there
            m = encoder.stable.search(text, end)
            end = len(text) if m is None else min(len(text), m.start() + overlap // 2)
            ids, ends = encoder.ids_and_ends(text[context:end])  # with what precedes: a text's start may be encoded differently
            if start > context:
                cut = _place(text, context, start, encoder.unit)
                k = int(np.searchsorted(ends, cut, "right"))
                ids, ends = ids[k:], ends[k:] - cut
            widened += 1
            continue
        p, i, j, b = at
        out.append(ids[:i])
        splices += 1
        start, end, context, ids, ends = p, stop, begin, ids2[j:], ends2[j:] - b
    out.append(ids)
    return np.concatenate(out), splices, widened
