"""Exact token counts of texts of any length by overlap resynchronisation.

A huge text is encoded as overlapping chunks with offsets.  Two chunks are spliced in their overlap at a place
where both put a token boundary and that is stable: a space after what is neither a space nor the space mark.  No piece of the
vocabulary has a space after another character (``stable_vocabulary`` proves it from the model), so
no merge reaches across, whatever stands on either side.  Where an overlap has no such place it is widened, in
the end to the whole rest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.text import id_and_text, slices

SPACE = "▁"
CHUNK, OVERLAP = 16_384, 256
_open: dict[str, tuple] = {}


def stable_vocabulary(model) -> bool:
    """Whether no piece has the space mark after another character, and spaces are kept as they are."""
    return not any(SPACE in model.id_to_piece(i).lstrip(SPACE) for i in range(model.get_piece_size())) and model.encode("a  b ", out_type=str)[-1] == SPACE


def opened(path: str) -> tuple:
    """The model, and whether its vocabulary allows splicing."""
    if not path.endswith(".model"):
        raise ValueError(f"token counts take SentencePiece .model files, not {path}")
    if path not in _open:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        _open[path] = model, stable_vocabulary(model)
    return _open[path]


def _starts(model, text: str, start: int, end: int) -> list[int]:
    """The offsets in ``text`` at which the tokens of a chunk begin.

    The model puts a space before each chunk, so a chunk that begins at a space is given without it.
    """
    skip = int(0 < start < end and text[start] == " ")
    found = model.encode(text[start + skip : end], return_type="offset_mapping")
    begins = [start + skip + a for a, _ in found["offsets"]]
    if skip and begins:
        begins[0] = start
    return begins


def count_tokens(model, text: str | None, stable: bool = True, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of the whole text."""
    if not text:
        return 0
    if len(text) <= chunk or not stable or text.isspace():
        return len(model.encode(text))
    total, taken = 0, 0  # tokens counted, and up to which place
    start, end = 0, chunk
    left = _starts(model, text, start, end)
    while end < len(text):
        width, cut = overlap, -1
        while cut < 0:
            begin = max(taken, end - width)
            right_end = min(len(text), begin + max(chunk, 2 * width))
            right = _starts(model, text, begin, right_end)
            common = set(left).intersection(right)
            cut = max((p for p in common if taken < p < end and p > begin and text[p] == " " and text[p - 1] not in (" ", SPACE)), default=-1)
            if cut < 0:
                if begin == taken:  # nothing stable since the last splice: a larger chunk from there
                    end = min(len(text), end + (end - taken))
                    left = _starts(model, text, taken, end)
                    if end == len(text):
                        break
                width *= 2
        if cut < 0:
            break
        total += sum(taken <= p < cut for p in left)
        taken, left, end = cut, [p for p in right if p >= cut], right_end
    return total + sum(p >= taken for p in left)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have no bytes and no tokens, texts of any length are counted whole, repeated rows each give their
    row, other columns are not read, and no rows give no rows.  Only SentencePiece ``.model`` files are taken.
    """
    if not model_path.endswith(".model"):
        raise ValueError(f"token counts take SentencePiece .model files, not {model_path}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, stable = opened(model_path)
        for batch in slices(batches):
            counts = [count_tokens(model, t, stable, chunk, overlap) for t in batch.column("text").to_pylist()]
            sizes = pa.compute.cast(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
