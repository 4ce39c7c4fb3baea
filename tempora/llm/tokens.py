"""Token counts of whole texts; huge documents are encoded in overlapping chunks and spliced where both sides agree."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import slices, table, utf8, worker_cache

#: Letters whose class is the same for every tokenizer here: ASCII and Latin-1.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A text made of these alone can be cut between letters and other characters, white space going with what follows.
PLAIN = re.compile(f"[^\\n\\t\\r \\x21-\\x26\\x28-\\x7e¡-©«-±´¶-¸»¿×÷{LETTERS}]|<\\|")
UNITS = {
    True: re.compile(f"\\s*(?:[{LETTERS}]+|[^\\s{LETTERS}]+)|\\s+"),
    False: re.compile("\\s*\\S+|\\s+"),
}
#: The same pieces for a tokenizer that drops white space.
BARE = re.compile(f"[{LETTERS}]+|[^\\s{LETTERS}]+")
#: Control characters that Python takes for white space and the tokenizers do not.
ODD = re.compile("[\\x1c-\\x1f]")
#: Entries kept by a worker for pieces of text that were encoded before.
CACHE_ENTRIES = 400_000
#: Longest text encoded in one call, and the least overlap of two chunks, in code points.
CHUNK_CHARS, OVERLAP_CHARS = 1 << 16, 512
#: Boundaries this close to a chunk's end may change with what follows (longest special string and look-ahead).
MARGIN_CHARS = 64


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer at `path`, one per Python worker. No truncation, no padding."""
    kept = worker_cache("tokenizers")
    if path not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        kept[path] = Tokenizer.from_file(path)
        kept[path].no_truncation()
        kept[path].no_padding()
    return kept[path]


def splice(text: str, encode: Callable, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Ids of a huge text from overlapping chunks.

    `encode(text)` gives (ids, starts, words): for each token its first code point and the number of its pre-token.
    The splitting pattern looks at what follows a match only, so once both chunks start a pre-token at the same place,
    clear of the left chunk's unsure end, the right chunk's tokens are those of the whole text from there on. Where no
    such place exists the overlap is widened, and at last the left chunk itself grows until it reaches the end.
    """
    out: list[int] = []
    begin, done = 0, 0  # the current chunk's start; where in the text its sure tokens start
    end = min(len(text), chunk)
    while True:
        ids, starts, words = encode(text[begin:end])
        starts = starts + begin
        first = np.r_[True, words[1:] != words[:-1]] if len(words) else np.zeros(0, bool)
        from_here = int(np.searchsorted(starts, done)) if done else 0
        if end == len(text):
            return out + list(ids[from_here:])
        sure = set(starts[first & (starts < end - MARGIN_CHARS) & (starts > done)].tolist())
        width, found = overlap, None
        while found is None and width < end - begin:
            right = end - width
            _, other, mark = encode(text[right:end])
            fresh = np.r_[True, mark[1:] != mark[:-1]] if len(mark) else np.zeros(0, bool)
            # The right chunk's own first pre-token may be a cut one.
            both = [x for x in (other[fresh][1:] + right).tolist() if x in sure and x >= right + min(MARGIN_CHARS, width // 4)]
            found = both[0] if both else None
            width *= 2
        if found is None:
            end = min(len(text), end + chunk)
            continue
        out += list(ids[from_here : int(np.searchsorted(starts, found))])
        begin, done = right, found
        end = min(len(text), right + chunk)


class Encoder:
    """Encodes texts by distinct pieces, cut only where the tokenizer cuts too; pieces seen before are looked up.

    value(ids) is what is kept for a piece: a count or the ids' bytes.
    """

    def __init__(self, path: str, value: Callable, lower: bool, strip: bool, chunk: int = CHUNK_CHARS):
        self.tokenizer, self.value, self.lower, self.strip, self.chunk = load(path), value, lower, strip, chunk
        self.kept = worker_cache(f"pieces {path} {value.__name__}")

    def offsets(self, text: str):
        e = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.array([-1 - i if w is None else w for i, w in enumerate(e.word_ids)], dtype=np.int64)
        return e.ids, np.array([a for a, _ in e.offsets], dtype=np.int64), words

    def pieces(self, text: str) -> list[str]:
        plain = not PLAIN.search(text) and "'" not in text
        if not plain and ODD.search(text):
            return [text]
        if plain and self.lower:
            text = text.lower()
        return (BARE if self.strip and plain else UNITS[plain]).findall(text)

    def batch(self, texts: list[str]) -> list[list]:
        """For each text the values of its pieces."""
        kept, tok = self.kept, self.tokenizer
        if len(kept) > CACHE_ENTRIES:
            kept.clear()
        cut = [self.pieces(x) if len(x) <= self.chunk else None for x in texts]
        new = list({p for c in cut if c is not None for p in c if p not in kept})
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for p, e in zip(part, tok.encode_batch_fast(part, add_special_tokens=False)):
                kept[p] = self.value(e.ids)
        get = kept.__getitem__
        return [
            [self.value(splice(x, self.offsets, self.chunk))] if c is None else list(map(get, c))
            for x, c in zip(texts, cut)
        ]


def count_of(ids: list[int]) -> int:
    return len(ids)


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS
) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens as the tokenizers library gives them without added special tokens, over_limit.

    Null counts as empty: 0 bytes, 0 tokens. Special strings inside a text are taken as the library does by default.
    Every row of docs gives one row, repeated ids included; null ids stay null; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer, count_of, lower=False, strip=False, chunk=chunk)
        for whole in batches:
            for b in slices(whole, "text"):
                n_bytes = np.diff(utf8(b.column("text"))[1])
                n = np.array([sum(v) for v in enc.batch([x or "" for x in b.column("text").to_pylist()])], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(n_bytes), pa.array(n), pa.array(n > limit)],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    narrow = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text")
    schema = T.StructType(
        [
            T.StructField(id_col, narrow.schema["id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    return narrow.mapInArrow(run, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
