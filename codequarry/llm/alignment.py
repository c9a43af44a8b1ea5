"""Alignment of the tokens of two tokenizers over the bytes that they share.

Each byte of a text has an owner among the tokens of A and one among those of B: token numbers repeated by token
lengths. Where the pair of owners changes, another overlap of an A and a B token begins; where both change at once, both
have a boundary and the text is cut into groups. All texts of a batch are laid end to end, so that one pass of array
operations aligns the batch.

The corpus-wide counts of linked id pairs take two steps: the aligned texts are written with their distinct pairs, and
the pairs are summed per batch before they are shuffled. The counts, whose number the two vocabularies bound, are then met with
the texts one bounded part at a time: a part travels to the texts, which are far larger, and every text's sums add up
over the parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import Scratch, fresh, quoted

#: Texts of a step of the alignment have so many bytes together (a longer text is a step of its own).
STEP_BYTES = 1 << 20
#: Id pairs and their counts that are sent to the workers at once: 13 bytes each.
PART_PAIRS = 1 << 20
#: Characters up to here are classed alike by both libraries of A (tests compare all of them), and runs without white space or of nothing else up to
#: this length are merged fast; other texts are encoded by the slower library.
LAST_PLAIN, LONGEST_RUN = 0x24F, 256
_LONG_RUN = regex.compile(r"\S{%d}|\s{%d}" % (LONGEST_RUN, LONGEST_RUN))
#: Fixed value: how the byte-level tokenizer cuts a text before it merges.
BYTE_LEVEL_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest for characters from U+0100 on, in order."""
    itself = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = [b for b in range(256) if b not in itself]
    return {chr(b): b for b in itself} | {chr(0x100 + i): b for i, b in enumerate(others)}


class _Side:
    """The bytes of each id, and their lengths."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.sizes = pieces, np.array([len(p) for p in pieces], np.int64)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class Bytes(_Side):
    """A: byte-level BPE of a space and the text, by the file's own library or, where that is proved equal, a faster one."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        of, special = byte_characters(), {i for i, t in self.library.get_added_tokens_decoder().items() if t.special}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        pieces = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            pieces[i] = token.encode() if i in special or not all(c in of for c in token) else bytes(of[c] for c in token)
        super().__init__(pieces)
        ranks = {p: i for i, p in enumerate(pieces) if i not in special}
        self.fast = tiktoken.Encoding("pairs", pat_str=BYTE_LEVEL_CUT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if (text.isascii() or max(text) <= chr(LAST_PLAIN)) and not _LONG_RUN.search(text):
            return self.fast.encode_ordinary(" " + text)
        return self.library.encode(" " + text, add_special_tokens=False).ids


class Pieces(_Side):
    """B: sentence pieces of the text, which put a space before it themselves."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = self.library.id_to_piece
        super().__init__([bytes([int(piece(i)[3:-1], 16)]) if self.library.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.library.get_piece_size())])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Bytes(path_a), Pieces(path_b)
        self.width = len(self.b.pieces)
        # how ids are written: in the middle of their side of a group, at the end of A's, at the end of B's
        ids = max(len(self.a.pieces), self.width)
        self.written = [f"{i}{end}" for end in ",|;" for i in range(ids)]
        self.ids = ids

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides; none for texts that are null, empty, or not given back by the tokens."""
        full = [t for t in texts if t]
        out = iter(zip(full, map(self.a.encode, full), self.b.encode(full) if full else [], strict=True))
        found = []
        for t in texts:
            a, b = [], []
            if t:
                same, a, b = next(out)
                raw = b" " + same.encode()
                if self.a.joined(a) != raw or self.b.joined(b) != raw:
                    a, b = [], []
            found.append((a, b))
        return found

    def align(self, encoded: list[tuple[list[int], list[int]]]) -> dict[str, list]:
        """For each text n_a, n_b, n_groups, n_links, groups, and its distinct linked pairs (A id * width + B id, ascending) with how often each is linked."""
        n_a, n_b = (np.array([len(e[side]) for e in encoded], np.int64) for side in (0, 1))
        a, b = (np.fromiter((i for e in encoded for i in e[side]), np.int64, int(n.sum())) for side, n in ((0, n_a), (1, n_b)))
        owner_a, owner_b = np.repeat(np.arange(a.size, dtype=np.int32), self.a.sizes[a]), np.repeat(np.arange(b.size, dtype=np.int32), self.b.sizes[b])
        change_a, change_b = np.diff(owner_a, prepend=-1) != 0, np.diff(owner_b, prepend=-1) != 0
        at = np.flatnonzero(change_a | change_b)
        cuts = np.flatnonzero(change_a & change_b)  # the first byte of each group; texts begin with one
        link_a, link_b = owner_a[at], owner_b[at]
        doc_of_a = np.repeat(np.arange(len(encoded)), n_a)
        link_doc, group_doc = doc_of_a[link_a], doc_of_a[owner_a[cuts]]
        # groups as text: A's tokens of a group, then B's, as one sequence over the batch
        first_a, first_b = owner_a[cuts], owner_b[cuts]
        group_a, group_b = (np.searchsorted(first, np.arange(n), "right") - 1 for first, n in ((first_a, a.size), (first_b, b.size)))
        ends = lambda group: np.diff(group, append=-1) != 0
        place_a = np.arange(a.size) + first_b[group_a]
        place_b = np.arange(b.size) + np.append(first_a, a.size)[group_b + 1]
        shown = np.empty(a.size + b.size, np.int64)
        shown[place_a] = a + self.ids * ends(group_a)
        shown[place_b] = b + self.ids * 2 * ends(group_b)
        parts = list(map(self.written.__getitem__, shown.tolist()))
        stops = np.cumsum(n_a + n_b).tolist()
        groups = ["".join(parts[lo:hi])[:-1] for lo, hi in zip([0, *stops], stops, strict=False)]
        # distinct pairs of each text
        pairs = a[link_a] * self.width + b[link_b]
        order = np.lexsort((pairs, link_doc))
        pairs, docs = pairs[order], link_doc[order]
        new = np.flatnonzero(np.concatenate(([True], (pairs[1:] != pairs[:-1]) | (docs[1:] != docs[:-1])))[: pairs.size])
        times = np.diff(np.append(new, pairs.size))
        bounds = np.searchsorted(docs[new], np.arange(len(encoded) + 1))
        count = lambda x: np.bincount(x, minlength=len(encoded))
        return {"n_a": n_a, "n_b": n_b, "n_groups": count(group_doc), "n_links": count(link_doc), "groups": groups, "pairs": pairs[new], "times": times, "bounds": bounds}


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _steps(texts: list[str | None]) -> Iterator[slice]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > STEP_BYTES:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t or "")
    if begin < len(texts):
        yield slice(begin, len(texts))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def aligned(docs: DataFrame, path_a: str, path_b: str, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``carry`` of each row, and (n_a, n_b, n_groups, n_links, groups, pairs, times) of its text.

    ``groups``: A and B ids as ``a1,a2|b1;a3|b2,b3``; ``pairs``: the distinct linked id pairs as A id * (size of B's vocabulary) +
    B id; ``times``: how often each is linked in the text. A text that is null, empty or not given back by the
    tokens has no tokens: zeros, no groups, no pairs. Repeated rows stay. A carried column with one of these names is left to the caller.
    """
    schema = ", ".join([*[f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in carry], "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"])
    inner = fresh(carry, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        for b in batches:
            texts = b.column(len(carry)).to_pylist()
            for step in _steps(texts):
                r = al.align(al.encode(texts[step]))
                own = [c.slice(step.start, step.stop - step.start) for c in b.columns[: len(carry)]]
                new = [*(pa.array(r[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(r["groups"], pa.string()), _lists(r["pairs"], r["bounds"]), _lists(r["times"].astype(np.int32), r["bounds"])]
                yield pa.RecordBatch.from_arrays([*own, *new], names=[*b.schema.names[: len(carry)], "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

    return docs.select(*[F.col(quoted(c)) for c in carry], F.col(quoted(text)).alias(inner)).mapInArrow(run, schema)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, n, best) over the corpus from ``pairs`` and ``times``: links that hold the pair, and whether no pair with its B id has more."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                pair, at = np.unique(b.column("pairs").flatten().to_numpy(), return_inverse=True)
                n = np.bincount(at, weights=b.column("times").flatten().to_numpy(), minlength=pair.size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    per_pair = rows.select("pairs", "times").mapInArrow(summed, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # the most for each B id is combined on the map side before it is shuffled, and there are no more of them than B has ids
    most = per_pair.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("most"))
    return per_pair.withColumn("b", F.col("pair") % width).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(rows: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with n_best and count_sum over their links in place of ``pairs`` and ``times``.

    ``counts`` go to the rows in parts of about ``PART_PAIRS``; their number is taken first. One part is the usual case; of several, each
    adds its share to the sums of a row, which are written in between.
    """
    spark = rows.sparkSession
    n_parts = -(-counts.count() // PART_PAIRS) or 1
    part_of = F.pmod(F.xxhash64("pair"), F.lit(n_parts))
    rows = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(n_parts):
        found = counts.filter(part_of == k).orderBy("pair").toArrow()
        table = spark.sparkContext.broadcast(tuple(found.column(c).to_numpy() for c in ("pair", "n", "best")))
        before, rows = rows, rows.mapInArrow(_adder(table), rows.schema)
        if n_parts > 1:
            rows = scratch.table(rows)
            table.destroy()
            if k:
                scratch.drop(before)
    return rows.drop("pairs", "times")


def _adder(table):  # noqa: ANN001, ANN202
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = table.value
        for b in batches:
            lists = b.column("pairs")
            own, times = lists.flatten().to_numpy(), b.column("times").flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().fill_null(0).to_numpy())
            at = np.minimum(np.searchsorted(pair, own), max(pair.size - 1, 0))
            known = np.flatnonzero(pair[at] == own) if pair.size else np.zeros(0, np.int64)
            at, times, row = at[known], times[known], row[known]
            sums = []
            for value in (best[at].astype(np.int64), n[at]):
                total = np.zeros(b.num_rows, np.int64)
                np.add.at(total, row, value * times)
                sums.append(total)
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            for c, s in zip(("n_best", "count_sum"), sums, strict=True):
                columns[c] = pa.array(b.column(c).to_numpy() + s)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return add


def align(docs: DataFrame, path_a: str, path_b: str, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``carry`` of each row and its (n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum), all longs but the digest of the groups.

    A null, empty or untokenizable text has zeros and the digest ''. Repeated rows each count, and stay. Without rows the result is
    empty. Further columns are ignored; carried ones may have any name but these.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = aligned(docs, path_a, path_b, carry, text)
    rows = scratch.table(rows.select(*[F.col(quoted(c)) for c in carry], "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"))
    counts = scratch.table(pair_counts(rows, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()))
    return with_counts(rows, counts, scratch)
