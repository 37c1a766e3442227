"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash of 16 bytes cuts every text into chunks; as cuts depend on
content alone, passages that documents share are cut alike. Of each chunk, the
part between its first and last agreement point is encoded once and found
again by its bytes in later documents. An agreement point is a space or line
feed after a visible ASCII character: the pre-tokenizer always starts a new
pre-token there and looks at nothing on the other side, so both sides' ids are
the same in any context. What lies between the last agreement point of one
chunk and the first of the next is the join: it is encoded anew as one string,
and where a chunk has no agreement point the join grows over it until it
reaches the next. The parts' ids together are exactly the whole text's.

Each Python worker keeps the parts it has encoded, up to CACHE_BYTES.

Strings of code points below U+0250 go through a fast implementation of the
same vocabulary; all others, and strings with very long unbroken runs, go
through the tokenizers library itself. A special token's string in a text is
cut out first, as the library does.

Defined results: null and empty texts have no ids; each row has its own result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.llm.common import documents, map_arrow
from groundline.llm.vocab import BYTE_BPE, BYTE_RANKS, tokenizer, vocabulary
from groundline.llm.winnowing import gram_hashes

ROLL = 16
#: A cut where the hash has its highest bits 0; chunks have 2**CUT_BITS bytes on average.
CUT_BITS = 8
MIN_CHUNK = 48
BLOCK = 1 << 21
CACHE_BYTES = 48 << 20
LONG_RUN = 2000


def cuts(data: np.ndarray) -> np.ndarray:
    """Positions of content-defined cuts in bytes, without 0 and the end."""
    found = []
    for at in range(0, max(0, len(data) - ROLL + 1), BLOCK):
        part = data[at : at + BLOCK + ROLL - 1]
        if len(part) >= ROLL:
            found.append(np.flatnonzero(gram_hashes(part, ROLL) >> np.uint64(64 - CUT_BITS) == 0) + at + ROLL)
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    if len(places) and (np.diff(places) < MIN_CHUNK).any():
        kept, last = [], -MIN_CHUNK
        for p in places.tolist():
            if p - last >= MIN_CHUNK:
                kept.append(p)
                last = p
        places = np.array(kept)
    return places[places < len(data)]


def parts(data: bytes) -> list[bytes]:
    """A text's cores and joins in order; together they are the text, and each starts and ends at an agreement point."""
    codes = np.frombuffer(data, np.uint8)
    if len(codes) < 2 * MIN_CHUNK:
        return [data] if data else []
    after = codes[1:]
    visible = (codes[:-1] > 32) & (codes[:-1] < 127)
    agree = np.flatnonzero(((after == 32) | (after == 10)) & visible) + 1
    if not len(agree):
        return [data]
    bounds = np.concatenate([[0], cuts(codes), [len(codes)]])
    low = np.searchsorted(agree, bounds[:-1])
    high = np.searchsorted(agree, bounds[1:])
    some = low < high
    at = np.unique(np.concatenate([[0], agree[low[some]], agree[high[some] - 1], [len(codes)]])).tolist()
    return [data[a:b] for a, b in zip(at, at[1:])]


class ChunkEncoder:
    """ids of texts under a byte-level BPE vocabulary, with a memory of parts."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        self.library = tokenizer(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        size = max([*ranks.values(), *special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in ranks.items():
            self.bytes[i] = token
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self.decimal = [str(i) for i in range(size)]
        self.seen: dict[bytes, bytes] = {}
        self.held = self.reused = self.encoded = 0

    def _ids(self, part: bytes) -> list[int]:
        text = part.decode()
        plain = text.isascii() or max(map(ord, text)) < 0x250
        if plain and (len(text) < LONG_RUN or max(map(len, text.split(" "))) < LONG_RUN):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def _part(self, part: bytes) -> bytes:
        found = self.seen.get(part)
        if found is None:
            found = np.array(self._ids(part), np.uint32).tobytes()
            self.encoded += 1
            if len(part) <= 1 << 16:
                if self.held > CACHE_BYTES:
                    self.seen.clear()
                    self.held = 0
                self.seen[part] = found
                self.held += len(part) + len(found) + 160
        else:
            self.reused += 1
        return found

    def encode(self, text: str) -> np.ndarray:
        pieces = self.split.split(text) if self.split is not None and any(s in text for s in self.special) else [text]
        out = []
        for piece in pieces:
            if piece in self.special:
                out.append(np.uint32(self.special[piece]).tobytes())
            else:
                out.extend(map(self._part, parts(piece.encode())))
        return np.frombuffer(b"".join(out), np.uint32)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@cache
def chunk_encoder(json_path: str, ranks_path: str, pattern: str) -> ChunkEncoder:
    return ChunkEncoder(json_path, ranks_path, pattern)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, json_path: str, ranks_path: str, pattern: str) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(json_path, ranks_path, pattern)
        for batch in batches:
            counts, coded, back = [], [], []
            for text in batch["text"]:
                ids = encoder.encode(text.as_py() or "").tolist()
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(encoder.decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], [x.split()[0] for x in SCHEMA.split(", ")]
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, SCHEMA)


def encoded(docs: DataFrame, json_path: str, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the general operator."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(json_path, ranks_path, pattern)
        for batch in batches:
            found = [encoder.encode(x.as_py() or "").astype(np.int32) for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, ids array<int>")


def op8_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), vocabulary(BYTE_BPE), vocabulary(BYTE_RANKS), public_tokenizers.PATTERN)
