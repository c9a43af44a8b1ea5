"""Exact token counts with a whole-token shortcut.

For a BPE vocabulary with word ends, it is proved ahead which vocabulary strings encode alone as one token: each
is given to the tokenizer, and those that come back as a single token form a table. A text is cut into
pre-tokens; those in the table count one directly, and only the rest are merged, by the library itself, and
remembered. The proof holds inside a text because merges never cross a pre-token.

Texts with characters whose normalization or classes might differ between libraries, and those that hold a
special string, go to the library whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import fresh, quoted

#: Characters on which this module's cutting provably equals the library's (tests compare all of them): ASCII
#: without control characters but line feed, tab and carriage return, and Latin letters and signs up to U+017F
#: but for those whose lower case is more than one letter.
PLAIN = regex.compile(r"[\x20-\x7E\n\t\r¡-įı-ňŊ-ž]*+")
#: Merged pre-tokens are remembered up to this many and this length.
REMEMBERED, REMEMBERED_CHARS = 300_000, 64


class Counter:
    """Counts tokens as ``Tokenizer.encode(text, add_special_tokens=False)`` does, for a word-end BPE tokenizer."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.special = regex.compile("|".join(regex.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or r"(?!)")
        self.whole = self._whole_tokens()
        self.costs = _Costs(self)

    def _whole_tokens(self) -> frozenset[str]:
        """The proof: vocabulary strings that are one pre-token and encode alone as one token."""
        decoder = {c: b for b, c in _byte_chars().items()}
        names = []
        for token in self.library.get_vocab():
            if not token.endswith("</w>"):
                continue
            try:
                names.append(bytes(decoder[c] for c in token.removesuffix("</w>")).decode("utf-8"))
            except (KeyError, UnicodeDecodeError):
                continue
        plain = [n for n in names if n and n == n.lower() and PLAIN.fullmatch(n) and self.cut(n) == [n]]
        return frozenset(n for n, e in zip(plain, self.library.encode_batch(plain, add_special_tokens=False), strict=True) if len(e.ids) == 1)

    def count(self, text: str) -> int:
        if PLAIN.fullmatch(text) is None or self.special.search(text) is not None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.costs.__getitem__, self.cut(text.lower())))


class _Costs(dict):
    """Tokens by pre-token; starts with the whole tokens and asks the library for others."""

    def __init__(self, counter: Counter):
        super().__init__(dict.fromkeys(counter.whole, 1))
        self.counter = counter

    def __missing__(self, pre_token: str) -> int:
        n = len(self.counter.library.encode(pre_token, add_special_tokens=False).ids)
        if len(pre_token) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED + len(self.counter.whole):
                self.clear()
                self.update(dict.fromkeys(self.counter.whole, 1))
            self[pre_token] = n
        return n


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in out:
            out[b], n = chr(256 + n), n + 1
    return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``n_bytes`` (UTF-8) and ``n_tokens`` of every text beside the columns ``carry``.

    ``vocabulary``: path of the tokenizer's file on every executor. A null text is empty and has 0 of both. Texts
    are counted whole, each on its own; there is no shuffle, and a worker holds one Arrow batch and a bounded table.
    """
    kept, hidden = [F.col(quoted(c)) for c in carry], fresh(carry, "_t")
    base = docs.select(*kept, F.coalesce(F.octet_length(F.col(quoted(text))), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.col(quoted(text)), F.lit("")).alias(hidden))
    schema = base.drop(hidden).schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary).count
        for b in batches:
            n = pa.array([count(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "n_tokens"])

    return base.mapInArrow(run, schema)
