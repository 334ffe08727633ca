"""Byte-pair encoding through a distinct-word table, decoding through an id-to-piece join.

The tokenizers in use split at white space before anything else, so a text's ids
are those of its white-space separated words in order. Texts become blocks of
word codes (:mod:`tallyframe.llm.blocks`), each distinct word is encoded once, and
its ids are joined back by position. Decoding joins ids with the vocabulary's
pieces, a table whose size the tokenizer file fixes, and puts pieces together as
the tokenizer's decoder does.

Defined results: null and empty texts have no ids and decode to an empty text; a
null id is kept; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallyframe.llm.blocks import answer_words, code_blocks, finish_blocks, pack, ragged, unpack, unpack_words

ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, n_tokens long, ids_sha256 string, text string"
_OUT_BYTES = 8 << 20


@functools.lru_cache(maxsize=2)
def load_tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _word_encoder(path: str):
    """Answers for one bucket: ids of its words, each word encoded when first met."""
    def make():
        tokenizer, known = load_tokenizer(path), {}

        def answer(row: dict) -> bytes:
            words = unpack_words(row["data"])
            new = [w for w in words if w not in known]
            for word, found in zip(new, tokenizer.encode_batch([w.decode() for w in new], add_special_tokens=False)):
                known[word] = np.array(found.ids, np.uint32)
            ids = [known[w] for w in words]
            lengths, values = pack(np.fromiter(map(len, ids), np.int64, len(ids))), pack(np.concatenate(ids))
            return len(lengths).to_bytes(8, "little") + lengths + values
        return answer
    return make


def _join_ids(row: dict, codes: np.ndarray, answers: list[bytes]) -> pa.Table:
    """ids of each document: those of its words, by position."""
    counts = np.array(row["counts"], np.int64)
    lengths, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for data in answers:
        cut = 8 + int.from_bytes(data[:8], "little")
        lengths.append(unpack(data[8:cut]).astype(np.int64))
        values.append(unpack(data[cut:]).astype(np.int32))
    ids, n = ragged(np.concatenate(values), np.concatenate(lengths), codes)
    word_ends, id_ends = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(n)])
    lists = pa.ListArray.from_arrays(pa.array(id_ends[word_ends], pa.int32()), pa.array(ids, pa.int32()))
    return pa.table([pa.array(row["ids"], pa.int64()), lists], ["doc_id", "ids"])


#: Texts in which a tokenizer that looks beyond single words gives itself away.
_PROBES = ("Hello world again", " a  b\n\nc\t", "x, y")


def cuts_at_blanks(tokenizer_path: str) -> bool:
    """Whether a text's ids are those of its words one by one, which a table of distinct words needs."""
    ids = lambda text: load_tokenizer(tokenizer_path).encode(text, add_special_tokens=False).ids
    return all(ids(text) == [i for word in text.split() for i in ids(word)] for text in _PROBES)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text, without special tokens added.

    A tokenizer to which white space is more than a border between words is refused.
    """
    if not cuts_at_blanks(tokenizer_path):
        raise ValueError(f"{tokenizer_path}: the ids of a text are not those of its words")
    blocks, words = code_blocks(docs, id_col, text_col)
    answers = answer_words(words, _word_encoder(tokenizer_path))
    return finish_blocks(blocks, answers, _join_ids, ENCODED)


def vocabulary_pieces(tokenizer_path: str) -> pa.Array:
    """Piece by id; the id-to-piece table, as long as the vocabulary."""
    vocabulary = load_tokenizer(tokenizer_path).get_vocab(with_added_tokens=True)
    pieces: list[str | None] = [None] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        pieces[i] = piece
    return pa.array(pieces, pa.string())


def decode(encoded: DataFrame, tokenizer_path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, text) of (doc_id, ids), special tokens kept; also ids if wanted.

    ``ids_sha256`` is the digest of the ids read, as little-endian 32-bit numbers.
    A tokenizer file without a decoder joins pieces by a space; others are asked.
    """
    def run(batches) -> Iterator[pa.RecordBatch]:
        tokenizer, pieces = load_tokenizer(tokenizer_path), vocabulary_pieces(tokenizer_path)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            cuts = np.searchsorted(np.cumsum(sizes) * 8 // _OUT_BYTES, np.arange(1 + int(sizes.sum()) * 8 // _OUT_BYTES))
            for a, z in zip(cuts, [*cuts[1:], len(sizes)]):
                part = batch.slice(a, z - a)
                ids = part.column("ids")
                if tokenizer.decoder is None:
                    joined = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(sizes[a:z])]), pa.int32()), pieces.take(ids.flatten()))
                    texts = pc.binary_join(joined, " ")
                else:
                    texts = pa.array(tokenizer.decode_batch([x or [] for x in ids.to_pylist()], skip_special_tokens=False),
                                     pa.string())
                raw = np.asarray(ids.flatten(), np.uint32)
                ends = np.concatenate([[0], np.cumsum(sizes[a:z])])
                digests = [hashlib.sha256(raw[x:y].tobytes()).hexdigest() for x, y in zip(ends[:-1], ends[1:])]
                columns = [part.column("doc_id"), pa.array(sizes[a:z], pa.int64()), pa.array(digests, pa.string()), texts]
                names = ["doc_id", "n_tokens", "ids_sha256", "text"]
                if keep_ids:
                    columns, names = [*columns, ids], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)
    return encoded.mapInArrow(run, f"{DECODED}, ids array<int>" if keep_ids else DECODED)
