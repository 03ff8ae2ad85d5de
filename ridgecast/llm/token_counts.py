"""Token counts of whole texts, with overlap resynchronisation for huge documents.

Texts of at most `chunk` characters are counted word by word: the tokenizer splits at white space before anything
else that could reach across it, so a text's count is the sum over its maximal runs without ASCII white space, and
each distinct run is encoded once.

Longer texts are encoded in overlapping chunks with offsets. Inside an overlap a splice point is a
place where both encodings have a token boundary whatever surrounds it: white space that follows another character, or
a change between ASCII letters, ASCII digits and plain punctuation (no pre-token holds two of these kinds, and no normalisation
reaches across; apostrophes, which start contractions, and the characters of special strings are left out). The point is accepted
only if the first tokens after it agree in both encodings as well. Without such a point the overlap is doubled; once it covers the
whole left chunk that chunk is doubled itself, so a text without any splice point ends up encoded in one piece after work that is
linear in its length.

Defined cases: null is the empty text with no bytes and no tokens; repeated rows are counted each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, documents, python_workers, single_thread, tokenizer_path

CHUNK = 32_768
OVERLAP = 256
LIMIT = 2048
#: Tokens after a splice point that both encodings must share.
AGREE = 2
#: Distinct words remembered by a worker before it starts afresh.
MEMO_WORDS = 400_000

OUTPUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: Punctuation that begins no contraction and belongs to no special string.
_PLAIN = re.escape("!\"#$%&()*+,-./:;=?@[\\]^_`{}~")
#: Matches the character at which two encodings may be joined.
_BOUNDARY = re.compile(rf"(?<=[^{SPACES}])[{SPACES}]|(?<=[A-Za-z])[0-9{_PLAIN}]|(?<=[0-9])[A-Za-z{_PLAIN}]|(?<=[{_PLAIN}])[A-Za-z0-9]")

_TOKENIZERS: dict[str, object] = {}
_MEMO: dict[str, dict[str, int]] = {}


def tokenizer(path: str):
    single_thread()
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _TOKENIZERS[path] = found
    return _TOKENIZERS[path]


def _window(tok, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Token starts in the whole text, and ids."""
    found = tok.encode(text[start:end], add_special_tokens=False)
    return np.array([a for a, _ in found.offsets], np.int64) + start, np.array(found.ids, np.int64)


def _splice(points: list[int], left, right) -> int | None:
    """The last of the points at which left and right may be joined."""
    for q in reversed(points):
        a, b = (int(np.searchsorted(x[0], q)) for x in (left, right))
        n = min(AGREE, len(left[0]) - a - 1)  # the left's last token may be cut
        if n <= 0 or (np.array_equal(left[0][a : a + n], right[0][b : b + n]) and np.array_equal(left[1][a : a + n], right[1][b : b + n])):
            return q
    return None


def resync_ids(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
    """The token ids of text, piece by piece, from overlapping chunks."""
    n, start, end = len(text), 0, min(len(text), chunk)
    kept_from, left = 0, _window(tok, text, start, end)
    while end < n:
        width, cut = overlap, None
        while cut is None and end - width > kept_from:
            begin = end - width
            points = [m.start() for m in _BOUNDARY.finditer(text, begin + 1, end)]
            if points:
                stop = min(n, begin + max(chunk, 2 * width))
                right = _window(tok, text, begin, stop)
                cut = _splice(points, left, right)
            width *= 2
        if cut is None:  # nowhere to join: twice the left chunk
            end = min(n, 2 * end - start)
            left = _window(tok, text, start, end)
            continue
        yield left[1][np.searchsorted(left[0], kept_from) : np.searchsorted(left[0], cut)]
        start, end, left, kept_from = begin, stop, right, cut
    yield left[1][np.searchsorted(left[0], kept_from) :]


def resync_count(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    return sum(len(x) for x in resync_ids(tok, text, chunk, overlap))


def _by_words(tok, memo: dict[str, int], texts: pa.Array) -> np.ndarray:
    words = pc.ascii_split_whitespace(texts)
    ends = words.offsets.to_numpy() - words.offsets[0].as_py()
    flat = words.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    if len(memo) > MEMO_WORDS:
        memo.clear()
    if new := [x for x in names if x not in memo]:
        memo.update(zip(new, (len(e.ids) for e in tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
    each = np.fromiter((memo[x] for x in names), np.int64, len(names))
    sums = np.concatenate([[0], np.cumsum(each[flat.indices.to_numpy()])]) if len(names) else np.zeros(1, np.int64)
    return sums[ends[1:]] - sums[ends[:-1]]


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. path: a tokenizers file that splits at white space before its merges."""
    python_workers(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, memo = tokenizer(path), _MEMO.setdefault(path, {})
        for batch in batches:
            texts = batch.column("text")
            long = pc.greater(pc.utf8_length(texts), chunk)
            n = _by_words(tok, memo, pc.if_else(long, "", texts))
            for i in np.flatnonzero(long.to_numpy(zero_copy_only=False)):
                n[i] = resync_count(tok, texts[int(i)].as_py(), chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")).mapInArrow(count, OUTPUT)


def op9(spark, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
