"""Token ids of whole texts, a batch at a time.

Most words of a corpus repeat. Where a tokenizer treats the pieces between
spaces independently, a batch is cut at spaces and dictionary-encoded by Arrow,
and only words not met before go through the tokenizer. Whether a tokenizer
qualifies is read from its definition; others encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text encoded at once; bounds the memory beside the longest text.
SLICE_BYTES = 4 << 20
#: A text beyond this is cut at spaces and encoded in parts.
LONG_BYTES = 8 << 20
#: Words remembered by a worker; forgotten together when exceeded.
CACHE_WORDS = 250_000

_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
# Fixed values of the tokenizers library: how a definition looks whose pieces are runs of letters, single
# digits and runs of other signs, none of them with white space, in lower case and with bytes for letters.
WORD_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
WORD_PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_SPLITS = [
    {"type": "Split", "pattern": {"Regex": WORD_PIECES}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def splits_at_spaces(definition: dict) -> bool:
    """Whether a tokenizer, by its JSON, gives a text the ids of its words, and a word of letters
    before full stops and commas those of its lower-case letters and of the signs.

    True for exactly the normaliser and pre-tokenizer above, with nothing after the model, and
    special strings that are found as they are and hold no white space.
    """
    special = definition.get("added_tokens") or []
    plain = all(not any(t[k] for k in ("normalized", "lstrip", "rstrip", "single_word")) and not re.search(r"\s", t["content"]) for t in special)
    return (
        plain
        and not any(definition.get(k) for k in ("truncation", "padding", "post_processor"))
        and definition.get("normalizer") == {"type": "Sequence", "normalizers": WORD_NORMALIZERS}
        and definition.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": WORD_SPLITS}
        and not definition["model"].get("dropout")
    )


class TextEncoder:
    """Encode string arrays into flat ids and document offsets."""

    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self._words: dict[str, tuple[int, ...]] = {}
        self._odd: dict[str, tuple[int, ...]] = {}
        with open(path, encoding="utf-8") as f:
            definition = json.load(f)
        self.by_word = splits_at_spaces(definition)
        # A special string of letters, full stops and commas alone would be found inside a plain word.
        special = [t["content"] for t in definition.get("added_tokens") or []]
        self.by_model = self.by_word and all(re.search(r"[^A-Za-zÀ-ÖØ-öø-ÿ.,]", t) for t in special)
        self._bytes = _byte_letters()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model_ids(self, word: str) -> tuple[int, ...]:
        """Ids of a word of Latin-1 letters: its normal form is its lower case, and it is one piece."""
        word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self._bytes)
        return tuple([t.id for t in self.tokenizer.model.tokenize(word)])

    def _learn(self, words: list[str]) -> list:
        """Ids of each distinct word."""
        if len(self._words) + len(self._odd) > CACHE_WORDS:
            self._words.clear()
            self._odd.clear()
        known, other = self._words, self._odd
        out: list = [None] * len(words)
        odd = []
        for i, word in enumerate(words):
            core = word.rstrip(".,")
            # Only words of plain letters are known by their lower case.
            ids = known.get(core.lower())
            if ids is None:
                ids = other.get(word)
                if ids is not None:
                    out[i] = ids
                    continue
                if not self.by_model or _PLAIN.fullmatch(core) is None:
                    odd.append(i)
                    continue
                ids = known[core.lower()] = self._model_ids(core)
            if len(core) < len(word):
                tail = word[len(core) :]
                end = other.get(tail)
                if end is None:
                    end = other[tail] = tuple(self._ids([tail])[0])
                ids = ids + end
            out[i] = ids
        if odd:
            for i, ids in zip(odd, self._ids([words[i] for i in odd])):
                out[i] = ids
                if len(words[i]) < 64:
                    other[words[i]] = tuple(ids)
        return out

    def _flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        if not self.by_word:
            each = self._ids(texts.to_pylist())
            lens = np.fromiter(map(len, each), np.int64, n)
            return np.fromiter((i for x in each for i in x), np.uint32, int(lens.sum())), lens
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        per_text = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        each = self._learn(coded.dictionary.to_pylist())
        word_lens = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((i for x in each for i in x), np.uint32, int(word_lens.sum()))
        starts = np.concatenate([[0], np.cumsum(word_lens)])
        by_word = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(flat)).take(coded.indices)
        bounds = by_word.offsets.to_numpy()
        ids = by_word.values.to_numpy()[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        stops = np.cumsum(per_text)
        return ids, bounds[stops] - bounds[stops - per_text]

    def _long(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            cut = len(text) if len(text) - at <= LONG_BYTES else text.rfind(" ", at, at + LONG_BYTES) + 1 or text.find(" ", at) + 1 or len(text)
            parts.append(self._flat(pa.array([text[at:cut]]))[0])
            at = cut
        return np.concatenate(parts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, length of each), with the end id after each text; null counts as empty."""
        texts = pc.fill_null(texts, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        if self.by_word and len(texts) == 1 and sizes[0] > LONG_BYTES:
            ids = self._long(texts[0].as_py())
            lens = np.array([len(ids)], np.int64)
        else:
            ids, lens = self._flat(texts)
        if self.end_id is not None:
            ids = np.insert(ids, np.cumsum(lens), np.uint32(self.end_id)).astype(np.uint32, copy=False)
            lens = lens + 1
        return ids, lens


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text, or one longer row."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, to
        at = to


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies use for bytes: visible Latin-1
    characters stand for themselves, others follow from code point 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


_encoders: dict[tuple[str, int | None], TextEncoder] = {}


def encoder(path: str, end_id: int | None) -> TextEncoder:
    """This worker's encoder; it is loaded once."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = TextEncoder(path, end_id)
    return _encoders[path, end_id]
