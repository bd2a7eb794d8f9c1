"""Encoding whole texts with a tokenizer file of the tokenizers library, each distinct word once.

Words are what the tokenizer's own pre-tokenizer makes of a text. For texts and chunks of plain characters (ASCII without the
apostrophe, Latin-1 letters, white space) the words are found by a pattern here and the library's model encodes them; everything
else is cut into chunks at spaces at which the pre-tokenizer always splits, and the library encodes those whole. Either way the
ids of a text are the ids of its words and chunks in order.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .blocks import bounded

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Marks the first chunk of a text, which no space precedes. A lone surrogate is in no valid text.
FIRST = "\ud800"
#: Marks a chunk that the library must encode whole.
_WHOLE = "\ud801"
#: Stands between words on their way to the model; it is in no plain text.
_GAP = "\0"

#: A space that is no chunk's beginning: white space or the end follows.
_ODD_SPACE = re.compile(r" (?=\s|\Z)")
_CHUNK_START = re.compile(r"(?= \S)")

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"  # the marks of ASCII but the apostrophe, which begins contractions
_UNSAFE = re.compile(rf"[^{_LETTERS}{_MARKS}0-9 \n\t\r]").search
#: Words of plain text: of the tokenizer that lowers and drops white space, and of the byte-level one.
_FIND = {
    "word": re.compile(rf"[{_LETTERS}]+|[0-9]|[{_MARKS}]+").findall,
    "byte": re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|\s+(?!\S)|\s+").findall,
}


def whole_split(text: str) -> list[str]:
    return [text]


def word_split(text: str) -> list[str]:
    """Chunks for a tokenizer that drops white space."""
    return text.replace("\n", " ").split(" ")


def byte_split(text: str) -> list[str]:
    """Chunks for a byte-level tokenizer: all but the first stand for a space and what follows it."""
    if not text:
        return []
    if _ODD_SPACE.search(text):
        parts = [p[1:] if i else p for i, p in enumerate(_CHUNK_START.split(text))]
        if not parts[0] and len(parts) > 1:
            parts = ["", *parts[1:]]
    else:
        parts = text.split(" ")
    parts[0] = FIRST + parts[0]
    return parts


class Encoder:
    """Ids of texts with one tokenizer file; remembers words, `limit` at most."""

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.path, self.limit = path, limit
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = self.tokenizer.model
        model._resize_cache(0)  # each word comes once
        self.bare = Tokenizer(model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        spec = json.load(open(path))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.kind = self._kind(spec)
        self.split = {"byte": byte_split, "word": word_split, "whole": whole_split}[self.kind]
        self.characters = {b: c for c, b in byte_characters().items()} | {ord(_GAP): " "}
        self.known: dict[str, bytes] = {}
        self._pieces = self._decimals = None

    def _kind(self, spec: dict) -> str:
        """The kind of pre-tokenizer, if it is one whose words are known here."""
        pre = spec.get("pre_tokenizer") or {}
        kinds = [p["type"] for p in pre.get("pretokenizers", [pre])] if pre else []
        if any(c in s for s in self.special for c in " \n"):
            return "whole"
        if kinds == ["ByteLevel"] and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            return "byte"
        if kinds == ["Split", "ByteLevel"] and spec["model"].get("end_of_word_suffix") == "</w>" and pre["pretokenizers"][0].get("behavior") == "Removed":
            return "word"
        return "whole"

    def _plain(self, text: str) -> bool:
        return not _UNSAFE(text) and not any(s in text for s in self.special)

    def _words(self, text: str) -> list[str]:
        """The words of a text, and _WHOLE + chunk for chunks that the library must see."""
        if self.kind == "whole" or any(s in text for s in self.special):
            return [_WHOLE + text]
        if self._plain(text):
            return _FIND[self.kind](text.lower() if self.kind == "word" else text)
        out: list[str] = []
        for chunk in self.split(text):
            out += self._chunk_words(chunk)
        return out

    def spark_words(self, text: Column) -> Column:
        """Chunks of a text, as an array column: the ids of a text are those of its chunks in order."""
        if self.kind == "whole":
            return F.array(text)
        at = r"(?= [\p{L}\p{N}\p{P}\p{S}])" if self.kind == "byte" else r"[ \n\t]"
        split = F.split(text, at)
        for s in self.special:  # white space before them belongs together
            split = F.when(F.contains(text, F.lit(s)), F.array(text)).otherwise(split)
        return split

    def _chunk_words(self, chunk: str) -> list[str]:
        first = chunk.startswith(FIRST)
        said = chunk[1:] if first else " " + chunk if self.kind == "byte" else chunk
        if self.kind != "whole" and self._plain(said):
            return _FIND[self.kind](said.lower() if self.kind == "word" else said)
        return [_WHOLE + said]

    def _learn(self, words: Iterable[str]) -> None:
        """Encode the words (different ones) that are not known yet, each once, many in one call."""
        known = self.known
        if len(known) > self.limit:
            known.clear()
        new = [w for w in words if w not in known]
        whole = [w for w in new if w[0] == _WHOLE]
        if whole:
            new = [w for w in new if w[0] != _WHOLE]
        for a in range(0, len(new), 1 << 14):
            part = new[a : a + (1 << 14)]
            known.update(zip(part, self._model_ids(part), strict=True))
        for a in range(0, len(whole), 1 << 12):
            part = whole[a : a + (1 << 12)]
            found = self.tokenizer.encode_batch_fast([w[1:] for w in part], add_special_tokens=False)
            known.update((w, np.array(e.ids, self.dtype).tobytes()) for w, e in zip(part, found, strict=True))

    def _model_ids(self, words: list[str], each: int = 256) -> list[bytes]:
        """The model's ids of words, which stand between spaces in the model's own characters; none of white space that is dropped."""
        if self.kind == "word":
            words = [w.strip() or _GAP for w in words]
            blank = [i for i, w in enumerate(words) if w == _GAP]
            if blank:
                full = [w for w in words if w != _GAP]
                out = iter(self._model_ids(full)) if full else iter(())
                return [b"" if w == _GAP else next(out) for w in words]
        shown = [_GAP.join(words[i : i + each]).encode().decode("latin-1").translate(self.characters) for i in range(0, len(words), each)]
        found = self.bare.encode_batch(shown, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, self.dtype) for e in found])
        of = np.concatenate([np.array(e.word_ids, np.int64) + each * k for k, e in enumerate(found)])
        edges = (np.searchsorted(of, np.arange(len(words) + 1)) * self.dtype.itemsize).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes of self.dtype."""
        texts, out = list(texts), []
        for a, b in bounded([len(t) for t in texts], 1 << 20):
            split = [self._words(t) for t in texts[a:b]]
            self._learn(set().union(*split))
            out.extend(b"".join(map(self.known.__getitem__, s)) for s in split)
        return out

    def encode_array(self, texts: pa.Array, end: int | None = None, most: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each with `end` behind it, and where each text's ids begin; one more for the last end.

        Only the distinct words of a slice of texts become Python strings.
        """
        found, counts = [], []
        size = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)) if len(texts) else []
        for a, b in bounded(size, most):
            ids, count = self._slice(texts.slice(a, b - a))
            if end is not None:
                edges = np.cumsum(count)
                full = np.full(len(ids) + len(count), end, self.dtype)
                own = np.ones(len(full), bool)
                own[edges + np.arange(len(count))] = False
                full[own] = ids
                ids, count = full, count + 1
            found.append(ids)
            counts.append(count)
        ids = np.concatenate(found) if found else np.zeros(0, self.dtype)
        return ids, np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, np.int64)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of a slice, and how many each has."""
        texts = pa.concat_arrays([texts])  # its buffers begin with its own first text
        begin = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1).astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8, begin[-1]) if begin[-1] else np.zeros(0, np.uint8)
        odd = np.ones(len(texts), bool)
        if self.kind != "whole":
            odd = np.diff(np.searchsorted(_unsafe_bytes(raw), begin)) > 0
            for s in self.special:
                odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        edges = _word_edges(raw, begin, self.kind == "word")
        shown = _lowered(raw) if self.kind == "word" else raw
        words = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(shown))
        owner = np.searchsorted(begin[1:], edges[:-1], "right")
        if odd.any():  # these texts are single segments, which the library sees
            even = ~odd[owner]
            words, owner = words.filter(pa.array(even)), owner[even]
        coded = words.dictionary_encode()
        code, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(distinct)
        found = list(map(self.known.__getitem__, distinct))
        if odd.any():
            code = np.concatenate((code, len(found) + np.arange(odd.sum())))
            owner = np.concatenate((owner, np.flatnonzero(odd)))
            order = np.argsort(owner, kind="stable")
            code, owner = code[order], owner[order]
            found += self.encode(texts.filter(pa.array(odd)).to_pylist())
        data = np.frombuffer(b"".join(found), self.dtype)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        ids, _ = gathered(data, (np.cumsum(sizes) - sizes)[code], sizes[code])
        return ids, np.bincount(owner, sizes[code], len(texts)).astype(np.int64)

    def pieces(self) -> pa.Array:
        """The id-to-piece table of byte-level tokenizers, as large as the vocabulary: the bytes that each id stands for, by id."""
        if self._pieces is None:
            table = byte_characters()
            out = [b""] * self.size
            for s, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                out[i] = bytes(table[c] for c in s) if all(c in table for c in s) else s.encode()
            self._pieces = pa.array(out, pa.binary())
        return self._pieces

    def decimals(self) -> pa.Array:
        """Each id as a number with a comma behind it, by id."""
        if self._decimals is None:
            self._decimals = pa.array([b"%d," % i for i in range(self.size)], pa.binary())
        return self._decimals


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of data one after another, and where each begins there; one more for the end."""
    at = np.concatenate(([0], np.cumsum(size)))
    return data[np.repeat(start - at[:-1], size) + np.arange(at[-1])], at


def _byte_classes() -> np.ndarray:
    """For bytes of plain text: 1 space, 2 other white space, 3 digit, 4 mark, 5 letter or a part of one; 0 for what plain text lacks."""
    out = np.zeros(256, np.uint8)
    out[0x20], out[[0x09, 0x0A, 0x0D]] = 1, 2
    out[0x21:0x7F] = 4
    out[0x27] = 0
    out[0x30:0x3A] = 3
    out[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = 5
    return out


_CLASS = _byte_classes()


def _unsafe_bytes(raw: np.ndarray) -> np.ndarray:
    """Where bytes are that plain text lacks: the letters of two bytes begin with C3, and two of these are signs."""
    bad = _CLASS[raw] == 0
    bad[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    return np.flatnonzero(bad)


def _lowered(raw: np.ndarray) -> np.ndarray:
    """Plain text in lower case: A to Z, and C3 80 to C3 9E."""
    out = raw + (((raw >= 0x41) & (raw <= 0x5A)).view(np.uint8) << 5)
    out[1:] += ((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)).view(np.uint8) << 5
    return out


def _word_edges(raw: np.ndarray, begin: np.ndarray, single_digits: bool) -> np.ndarray:
    """Where the words of plain texts begin, and the end: runs of a class, each with the one space before it.

    Of longer white space the last character stands apart from the others, unless the text ends there.
    """
    kind = _CLASS[raw]
    space = (kind == 1) | (kind == 2)
    edge = np.ones(len(raw) + 1, bool)
    run = np.where(space, 1, kind)
    edge[1:-1] = run[1:] != run[:-1]
    if single_digits:
        edge[:-1] |= kind == 3
    edge[begin] = True
    # The last character of white space that more text follows: an edge before it, and none behind it if it is a space.
    text_end = np.zeros(len(raw) + 1, bool)
    text_end[begin] = True
    last = np.flatnonzero(space & edge[1:] & ~text_end[1:])
    edge[last] = True
    edge[last[kind[last] == 1] + 1] = False
    return np.flatnonzero(edge)


def byte_characters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else one above 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a file; workers that are used again keep what they know."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
