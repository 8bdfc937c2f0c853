"""Space-delimited chunks of text, the unit that tokenizers are called on once and remembered for.

A space that a non-space character follows always starts a new match in the split patterns used here: only
``\\s+`` can run over a space that is not its first character, and it gives back its last space when text follows.
So the parts between such spaces are tokenized independently, and the ids of a text are those of its parts in order.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space that the plain split would cut at although white space or the end follows.
_MESSY = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")


def parts(text: str) -> list[str]:
    """The text between cutting spaces; every part but the first stands for itself after a space."""
    return _CUT.split(text) if _MESSY.search(text) else text.split(" ")


class _Flat:
    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids per text); null texts have none."""
        ids = self.encode([x or "" for x in texts.to_pylist()])
        return np.frombuffer(b"".join(ids), dtype="<u4"), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4


class IdBytes(_Flat):
    """Ids of texts as little-endian unsigned 32-bit bytes, by a bounded memory of the ids of chunks."""

    def __init__(self, encode_batch: Callable[[list[str]], list[bytes]], most: int = 1_000_000):
        self.encode_batch, self.most = encode_batch, most
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.first) + len(self.rest) > self.most:
            self.first.clear()
            self.rest.clear()
        cut = [parts(x) for x in texts]
        new_first = list({p[0] for p in cut} - self.first.keys())
        new_rest: set[str] = set()
        for p in cut:
            new_rest.update(p[1:])
        rest = list(new_rest - self.rest.keys())
        self.first.update(zip(new_first, self.encode_batch(new_first)))
        self.rest.update(zip(rest, self.encode_batch([" " + x for x in rest])))
        get = self.rest.__getitem__
        return [self.first[p[0]] + b"".join(map(get, p[1:])) for p in cut]


#: The split pattern of byte-level tokenizers that name no other.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose classes all libraries agree; texts with others are left to the library of the file.
_OTHER = re.compile("[^\x00-\u024f]")


def _byte_of() -> dict[str, int]:
    """The byte that a character of such files stands for: printable ones themselves, characters from 256 on the rest."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


def byte_level_ranks(model: dict) -> dict[bytes, int] | None:
    """The rank of each token of a plain byte-level BPE file, whose merges come in the order of their tokens' ids; else None."""
    split = model["pre_tokenizer"] or {}
    bpe = model["model"]
    if model["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    if bpe["type"] != "BPE" or bpe.get("end_of_word_suffix") or bpe.get("continuing_subword_prefix") or bpe.get("ignore_merges"):
        return None
    byte = _byte_of()
    special = {x["content"] for x in model["added_tokens"]}
    vocabulary = {k: v for k, v in bpe["vocab"].items() if k not in special}
    pairs = [x if isinstance(x, list) else x.split(" ") for x in bpe["merges"]]
    if any(set(k) - byte.keys() for k in vocabulary) or [vocabulary.get(a + b) for a, b in pairs] != list(range(256, 256 + len(pairs))):
        return None
    return {bytes(byte[c] for c in k): v for k, v in vocabulary.items()}


def word_end_ranks(model: dict) -> dict[bytes, int] | None:
    """The rank of each token of a BPE file of lower-case words with end marks, whose merges come in the order of their tokens' ids; else None.

    The mark of a word's end stands as byte 0xFF, which no UTF-8 has; it joins the last byte before all other merges.
    """
    bpe, end = model["model"], model["model"].get("end_of_word_suffix")
    if bpe["type"] != "BPE" or not end or bpe.get("continuing_subword_prefix") or bpe.get("ignore_merges"):
        return None
    if model["normalizer"] != _LOWER_WORDS["normalizer"] or model["pre_tokenizer"] != _LOWER_WORDS["pre_tokenizer"]:
        return None
    byte = _byte_of()
    special = {x["content"] for x in model["added_tokens"]}
    vocabulary = {k: v for k, v in bpe["vocab"].items() if k not in special}
    pairs = [x if isinstance(x, list) else x.split(" ") for x in bpe["merges"]]
    if [vocabulary.get(a + b) for a, b in pairs] != list(range(512, 512 + len(pairs))):
        return None
    out = {bytes(byte[c] for c in k.removesuffix(end)) + b"\xff" * k.endswith(end): v for k, v in vocabulary.items()}
    return out if len(out) == len(vocabulary) else None


_LOWER_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class _Known:
    """The ids of words of up to LONGEST bytes, found by 128-bit keys: sums of fixed random numbers by place and byte, all words at once."""

    LONGEST = 32
    _random = np.random.default_rng(20240101).integers(0, 1 << 64, (2, LONGEST, 256), dtype=np.uint64)

    def __init__(self):
        self.key, self.other = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def keys(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, other key, whether the word is short enough to have them)."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        size = np.diff(offsets)
        place = np.minimum(np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], size), self.LONGEST - 1)
        out = []
        for table in self._random:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[place, data], dtype=np.uint64)])
            out.append(total[offsets[1:] - offsets[0]] - total[offsets[:-1] - offsets[0]] + size.astype(np.uint64) * table[0, 0])
        return out[0], out[1], size <= self.LONGEST

    def at(self, key: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Where each is, or -1."""
        if not len(self.key):
            return np.full(len(key), -1)
        order, at = np.argsort(key), np.empty(len(key), dtype=np.int64)
        at[order] = np.searchsorted(self.key, key[order])  # in order, neighbours are looked up together
        at = np.minimum(at, len(self.key) - 1)
        return np.where((self.key[at] == key) & (self.other[at] == other), at, -1)

    def add(self, key: np.ndarray, other: np.ndarray, ids: list[bytes]) -> None:
        order = np.argsort(key, kind="stable")
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        start = np.cumsum(size) - size + len(self.ids)
        at = np.searchsorted(self.key, key[order])
        for name, new in (("key", key), ("other", other), ("start", start), ("size", size)):
            setattr(self, name, np.insert(getattr(self, name), at, new[order]))
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])


class WordIds:
    """Ids of texts whose white space is dropped: parts between spaces are numbered as Arrow columns and merged once each."""

    def __init__(self, ranks: dict[bytes, int], library: IdBytes, most: int = 1_000_000):
        import regex
        import tiktoken

        split = _LOWER_WORDS["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.merge = tiktoken.Encoding("file", pat_str=split, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.find, self.library, self.most = regex.compile(split).findall, library, most
        self.known = _Known()

    def part(self, text: str) -> bytes:
        low = text.lower()  # below 0x250 the text is its own composed form, and letters change one by one
        if _OTHER.search(text) or _OTHER.search(low):
            return self.library.encode([text])[0]
        if low.isalpha():
            return array("I", self.merge(low.encode() + b"\xff")).tobytes()
        return array("I", [i for word in self.find(low) for i in self.merge(word.encode() + b"\xff")]).tobytes()

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known.key) > self.most:
            self.known = _Known()
        parts = pc.split_pattern(texts.cast(pa.string()).fill_null(""), " ")
        counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        coded = parts.flatten().dictionary_encode()
        words, known = coded.dictionary, self.known
        key, other, short = known.keys(words)
        at = known.at(key, other)
        new = np.flatnonzero(short & (at < 0))
        if len(new):
            known.add(key[new], other[new], [self.part(x) for x in words.take(pa.array(new)).to_pylist()])
            at = known.at(key, other)
        size, start, ids = known.size[at], known.start[at], known.ids
        long = np.flatnonzero(~short)
        if len(long):  # not remembered
            own = [self.part(x) for x in words.take(pa.array(long)).to_pylist()]
            size[long] = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
            start[long] = len(ids) + np.cumsum(size[long]) - size[long]
            ids = np.concatenate([ids, np.frombuffer(b"".join(own), "<u4")])
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = size[which]
        total = np.cumsum(n)
        out = ids[np.repeat(start[which] - (total - n), n) + np.arange(total[-1] if len(total) else 0)]
        ends = np.concatenate([[0], total])[np.cumsum(counts)]
        return out, np.diff(ends, prepend=0)


class RankIds(_Flat):
    """Ids of texts by rank merging in one native call each; texts with unusual characters by the library."""

    def __init__(self, ranks: dict[bytes, int], library: IdBytes):
        import tiktoken

        self.coder = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.library = library

    def encode(self, texts: list[str]) -> list[bytes]:
        ordinary = self.coder.encode_ordinary
        return [self.library.encode([x])[0] if _OTHER.search(x) else array("I", ordinary(x)).tobytes() for x in texts]


_coders: dict[str, IdBytes | RankIds | WordIds] = {}


def library_coder(path: str) -> IdBytes | RankIds | WordIds:
    """Of the ``tokenizers`` file at ``path``, without special tokens; one per Python worker."""
    if path not in _coders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True

        def encode(texts: list[str]) -> list[bytes]:
            out: list[bytes] = []
            for at in range(0, len(texts), 4096):
                ids = [x.ids for x in tok.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
                flat = np.fromiter(itertools.chain.from_iterable(ids), dtype="<u4").tobytes()
                end = 0
                for x in ids:
                    out.append(flat[end : (end := end + 4 * len(x))])
            return out

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        ranks, ends = byte_level_ranks(model), word_end_ranks(model)
        _coders[path] = RankIds(ranks, IdBytes(encode)) if ranks else WordIds(ends, IdBytes(encode)) if ends else IdBytes(encode)
    return _coders[path]
