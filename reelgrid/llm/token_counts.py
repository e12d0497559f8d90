"""Token counts: batches of bounded bytes are encoded in an Arrow function that returns lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.pieces import ByteLevelPieces, SentencePieces, default_path, loaded
from reelgrid.llm.words import small_batches, string_buffers

LONG = 1 << 18


def parts(text: str, most: int = LONG) -> list[str]:
    """text in parts of about `most` characters, cut where a space between two other visible ASCII characters begins.

    Every encoder here gives the parts' tokens in turn for the text; the space stays with the part after it. Where
    there is no such place for long, the part is longer.
    """
    out, at = [], 0
    place = re.compile(r"(?<=[!-~])(?= [!-~])")
    while len(text) - at > most and (cut := place.search(text, at + most)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def _count(path: str, limit: int, batch_bytes: int):
    sentence = path.endswith(".model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(SentencePieces if sentence else ByteLevelPieces, path)

        def lengths(texts: list[str]) -> list[int]:
            return encoder.counts(texts) if sentence else encoder.ids(texts)[1].tolist()

        for batch in batches:
            column = batch.column("text")
            _, edge = string_buffers(column)
            size, counts, lo = np.diff(edge), [], 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + batch_bytes, "right")) - 1)
                texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                if hi == lo + 1 and len(texts[0]) > LONG and (not sentence or encoder.splits and "▁" not in texts[0]):
                    cut = parts(texts[0])
                    # the space at the start of a later part is the one that the library adds
                    counts.append(sum(sum(lengths([p[1:] if sentence and i else p])) for i, p in enumerate(cut)))
                else:
                    counts += lengths(texts)
                lo = hi
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size), n, pa.array(np.array(counts, np.int64) > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return run


def count_tokens(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = 4096, batch_bytes: int = 1 << 19
) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    path: a tokenizer file, .model for sentencepiece or .json for the byte-level BPE of tokenizers; it must lie at the
    same place on all machines. No begin, end or added special tokens, no truncation. null is empty: no tokens.
    Batches hold batch_bytes of text, so long texts don't share one, and a text over 256 KB is encoded in parts. Rows
    pass one by one: repeated rows and null ids stay as they are. Other columns are left aside. No shuffle.
    """
    docs = small_batches(documents).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    path = path or default_path("piece_bpe_32k.model")
    return docs.mapInArrow(_count(path, limit, batch_bytes), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
