"""Public tokenizers in Python workers. The vocabularies' place is a parameter; nothing is copied or trained."""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(path: str):
    """The library's tokenizer with truncation and padding off; one thread, as a task has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class WordEncoder:
    """Encodes texts with a tokenizer that drops white space, one distinct unit at a time.

    Such a tokenizer never joins what a space or line feed separates: white
    space is normalised to a space, belongs to no pre-token, and no added token
    holds any. So a text's ids are those of its space-separated units in order.
    Each distinct unit of a batch is encoded once, by the library itself, and
    remembered; the ids of all texts are then gathered by index.

    To have fewer distinct units, two things that don't change the ids are done
    ahead: A to Z are lowered, as the normalizer does (only in texts without
    combining marks, where that commutes with its composition, and without
    anything like a special token), and a full stop or comma between a letter
    and a space is set apart, as the pre-tokenizer does.
    """

    LIMIT = 500_000
    JOINED = 256

    def __init__(self, path: str):
        self.path, self.seen = path, {}
        library = tokenizer(path)
        self.ends = np.zeros(library.get_vocab_size() + 1, bool)
        for token, i in library.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _units(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Units of all texts as a list array, and each text's place in it."""
        texts = [t.replace("\n", " ") for t in texts]
        plain = [i for i, t in enumerate(texts) if "<|" not in t and (t.isascii() or max(t) < "\u0300")]
        chosen = set(plain)
        other = [i for i in range(len(texts)) if i not in chosen]
        low = pc.ascii_lower(pa.array([texts[i] for i in plain], pa.large_string()))
        apart = pc.replace_substring_regex(low, "([a-z])([.,]) ", r"\1 \2 ")
        lists = [pc.split_pattern(apart, " "), pc.split_pattern(pa.array([texts[i] for i in other], pa.large_string()), " ")]
        place = np.empty(len(texts), np.int64)
        place[plain + other] = np.arange(len(texts))
        return pa.concat_arrays(lists), place

    def _learn(self, new: list[str]) -> None:
        """Encode units; words of a to z go together in one string and are told apart by their last tokens."""
        library = tokenizer(self.path)
        simple = [x for x in new if x.isascii() and x.isalpha() and x.islower()]
        groups = [simple[i : i + self.JOINED] for i in range(0, len(simple), self.JOINED)]
        for group, found in zip(groups, library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, np.uint16)
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(group):
                raise AssertionError("a word has other than one last token")
            at = 0
            for x, stop in zip(group, stops):
                self.seen[x] = ids[at:stop].tobytes()
                at = stop
        rest = [x for x in new if x not in self.seen]
        for x, found in zip(rest, library.encode_batch_fast(rest, add_special_tokens=False)):
            self.seen[x] = np.array(found.ids, np.uint16).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids (uint16) of each text."""
        if not texts:
            return []
        lists, place = self._units(texts)
        units = lists.flatten().dictionary_encode()
        names = units.dictionary.to_pandas().tolist()
        if len(self.seen) > self.LIMIT:
            self.seen.clear()
        self._learn([x for x in names if x not in self.seen])
        coded = [self.seen[x] for x in names]
        flat = np.frombuffer(b"".join(coded), np.uint16)
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 2
        start = np.cumsum(size) - size
        at = units.indices.to_numpy()
        counts = size[at]
        ends = np.cumsum(counts)
        ids = flat[np.repeat(start[at] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        return [ids[bounds[i] : bounds[i + 1]] for i in place.tolist()]


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def in_slices(texts: list[str], most: int = 4_000_000):
    """Index ranges of a batch with about `most` code points each, so that long texts don't add up."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
