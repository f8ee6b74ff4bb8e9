"""Byte-level BPE with the tokenizers library, each distinct stretch of text encoded once.

A text is cut before every blank that follows a non-blank. The pre-tokenizer's pattern never joins a
non-blank with a blank after it, so each piece encodes on its own to the ids it has within the whole
text. Arrow splits many texts at once and tells their distinct pieces; only those pass through Python, and numpy
lays out the ids of all places. A piece of letters is a word of the pattern; others are split into words, and only
words not met before go through the library's merging. Pieces and words recur, so their ids are kept (see
``stretches``).
Texts with a blank after other white space are cut by a pattern, and those with an added token of the
vocabulary are encoded whole. The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cohesio.llm.stretches import Stretches

#: Characters that are encoded together, at least one text.
AT_ONCE = 8_000_000
#: Pieces and words in each of a worker's two tables.
MOST = 500_000
_INNER = re.compile(r" (?<=\s\s)")
_CUT = re.compile(r"(?<=\S)(?= )")
_loaded: dict[str, "ByteBPE"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str | None = None) -> "ByteBPE":
    """The encoder of a vocabulary file, one for each worker process."""
    path = path or default_path()
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if visible, else one from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ByteBPE:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        # The pattern of byte-level pre-tokenizers, a fixed value.
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = byte_letters() | {255: " "}
        #: Bytes that each id stands for.
        self.n_bytes = np.zeros(self.whole.get_vocab_size(), dtype=np.int64)
        for token, k in self.whole.get_vocab().items():
            self.n_bytes[k] = len(token)
        self.kept = Stretches(MOST)

    def _encode_new(self, words: list[str]) -> np.ndarray:
        """Encodes distinct words of the pattern and keeps them; returns their numbers."""
        found, ends, total = [], [], 0
        for lo in range(0, len(words), 2000):
            spelt = [w.encode() for w in words[lo : lo + 2000]]
            # No UTF-8 text has the byte 255: it parts the words until letters stand for bytes.
            line = b"\xff".join(spelt).decode("latin-1").translate(self.letters)
            found.append(np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u4"))
            ends.append(total + np.searchsorted(np.cumsum(self.n_bytes[found[-1]]), np.cumsum(list(map(len, spelt))), side="right"))
            total += len(found[-1])
        return self.kept.add(words, np.concatenate(found), np.concatenate(ends)) if found else np.zeros(0, dtype=np.int64)

    def _numbers(self, keys: list[str]) -> np.ndarray:
        """The numbers of distinct pieces, each with the blank before it, if any."""
        numbers = self.kept.known(keys)
        lacking = np.flatnonzero(numbers < 0).tolist()
        if not lacking:
            return numbers
        letters, joined, odd = [], [], []
        for k in lacking:
            key = keys[k]
            bare = key[1:]
            if bare.isalpha() and (key[0] == " " or key[0].isalpha()):
                letters.append(k)
            elif bare and key[0] == " " and " " not in bare and not bare[0].isspace() and not bare[-1].isspace():
                joined.append(k)
            else:
                odd.append(k)
        # Joined ones begin with their only blank and end in a non-blank, so the pattern cuts between them.
        words, apart = self.pattern.findall("".join([keys[k] for k in joined])), [self.pattern.findall(keys[k]) for k in odd]
        n_joined = len(words)
        for found in apart:
            words += found
        coded = pa.array(words, type=pa.string()).dictionary_encode()
        place, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = self.kept.known(distinct)
        mine = [keys[k] for k in letters]
        among = set(mine)
        fresh = [k for k in np.flatnonzero(at < 0).tolist() if distinct[k] not in among]
        new = self._encode_new([*mine, *map(distinct.__getitem__, fresh)])
        numbers[letters], at[fresh] = new[: len(mine)], new[len(mine) :]
        rest = np.flatnonzero(at < 0).tolist()
        at[rest] = [self.kept.now.number[distinct[k]] for k in rest]
        # A word that begins with the blank begins a joined piece.
        blank = np.array([w[0] == " " for w in distinct], dtype=bool)
        begins = np.flatnonzero(blank[place[:n_joined]]) if n_joined else np.zeros(0, dtype=np.int64)
        last = np.concatenate([begins[1:], [n_joined] if len(begins) else [], n_joined + np.cumsum([len(x) for x in apart])]).astype(np.int64)
        ids, ends = self.kept.ids_of(at[place])
        numbers[joined + odd] = self.kept.add([keys[k] for k in joined + odd], ids, np.concatenate([[0], ends])[last])
        return numbers

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        start = size = 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= AT_ONCE or k == len(texts) - 1:
                out += self._encode_some(texts[start : k + 1])
                start, size = k + 1, 0
        return out

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        whole = [not self.plain or any(a in t for a in self.added) for t in texts]
        odd = [not w and (t[:1] == " " or _INNER.search(t) is not None) for t, w in zip(texts, whole)]
        plain = [t for t, w, o in zip(texts, whole, odd) if not w and not o]
        cut = [[x if k == 0 else x[1:] for k, x in enumerate(_CUT.split(t))] for t, o in zip(texts, odd) if o]
        lists = pc.split_pattern(pa.array(plain, type=pa.string()), " ")
        if cut:
            lists = pa.concat_arrays([lists, pa.array(cut, type=pa.list_(pa.string()))])
        starts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        place, bare = coded.indices.to_numpy().copy(), coded.dictionary
        pieces = pc.binary_join_element_wise(pa.scalar(" "), bare, "").to_numpy(zero_copy_only=False).tolist()
        # A text's first piece has no blank before it.
        heads = [t.partition(" ")[0] for t in plain] + [c[0] for c in cut]
        first = {h: k for k, h in enumerate(dict.fromkeys(heads), len(pieces))}
        place[starts[:-1]] = [first[h] for h in heads]
        self.kept.turn()
        numbers = self._numbers([*pieces, *first])
        laid, ends = self.kept.ids_of(numbers[place])
        laid = laid.tobytes()
        stops = np.concatenate([[0], 4 * ends])[starts].tolist()
        plain_ids = iter([laid[x:y] for x, y in zip(stops, stops[1:])])
        found: list[bytes | None] = [self._direct(t) if w else None if o else next(plain_ids) for t, w, o in zip(texts, whole, odd)]
        return [next(plain_ids) if x is None else x for x in found]

    def _direct(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
