"""Byte-level BPE encoding and decoding of whole texts, each distinct pre-token encoded once in the whole corpus."""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from pagemill.llm._common import id_text
from pagemill.llm.pretokens import lookup

BLOCK_BYTES = 16 << 20


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(2)
def _encoding(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    by_id = [b""] * (max(table.values()) + 1)
    for token, i in table.items():
        by_id[i] = token
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), by_id


def _encoder(ranks: bytes, pattern: str):
    def encode(words: list[bytes]) -> list[bytes]:
        own = _encoding(ranks, pattern)[0]._core_bpe.encode_single_piece
        return [np.array(own(w), "<u4").tobytes() for w in words]

    return encode


def _joined(codes: list[np.ndarray], answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents one after another, and where each document ends."""
    lens = np.fromiter((len(a) >> 2 for a in answers), np.int64, len(answers))
    flat, offsets = np.frombuffer(b"".join(answers), "<u4"), np.cumsum(lens) - lens
    every = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    each = lens[every]
    upto = np.cumsum(each)
    ids = flat[np.repeat(offsets[every] - (upto - each), each) + np.arange(upto[-1] if len(upto) else 0)]
    doc_ends = np.cumsum([len(c) for c in codes])
    return ids, np.concatenate([[0], upto])[doc_ends]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for each row.

    Pre-tokens are shuffled by distinct word, encoded once each, joined back and put together by position; the ids are
    then decoded by the vocabulary's token-byte table (as many entries as the vocabulary file, so it is broadcast).
    docs must be a stored table. A null text counts as empty and has no tokens; repeated rows give a row each; an empty
    table gives no rows; columns other than the two named are not read.
    """
    if pattern != public_tokenizers.PATTERN:
        raise ValueError("pre-tokens follow public_tokenizers.PATTERN; another pattern would get other ids")
    ranks = read_ranks(vocabulary)

    def finish():
        by_id = _encoding(ranks, pattern)[1].__getitem__

        def rows(doc_ids, codes, answers):
            ids, ends = _joined(codes, answers)
            out = {"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if with_ids else {})
            at = 0
            for end in ends.tolist():
                own, at = ids[at:end], end
                text = b"".join(map(by_id, own.tolist()))
                out["n_tokens"].append(len(own))
                out["ids_sha256"].append(hashlib.sha256(own.tobytes()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
                if with_ids:
                    out["ids"].append(own.astype(np.int32))
                    out["decoded"].append(text.decode())
            kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}
            return pa.RecordBatch.from_pydict({k: v if k == "doc_id" else pa.array(v, kinds[k]) for k, v in out.items()})

        return rows

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return lookup(id_text(docs, id_col, text_col), lambda: _encoder(ranks, pattern), finish, schema, BLOCK_BYTES)
