import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from codequarry.llm import alignment, queries

A, B = public_tokenizers.path(queries.BYTE_VOCABULARY), public_tokenizers.path(queries.PIECE_VOCABULARY)


def brute_force(texts):
    """Byte ranges of both sides compared token by token, with the libraries alone."""
    import sentencepiece

    t, p = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    of = alignment.byte_characters()
    rows = []
    for text in texts:
        a, b = ([], [])
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, p.encode(text)
            show_a = [bytes(of[c] for c in t.id_to_token(i)) for i in a]
            show_b = [bytes([int(p.id_to_piece(i)[3:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(show_a) != b" " + text.encode() or b"".join(show_b) != b" " + text.encode():
                a, b = [], []
        ranges = []
        for shown in (show_a, show_b) if a else ([], []):
            at, out = 0, []
            for x in shown:
                out.append((at, at + len(x)))
                at += len(x)
            ranges.append(out)
        links, groups, j0 = [], [], 0
        if a:
            for i, (lo, hi) in enumerate(ranges[0]):
                while ranges[1][j0][1] <= lo:
                    j0 += 1
                j = j0
                while j < len(b) and ranges[1][j][0] < hi:
                    links.append((a[i], b[j]))
                    j += 1
            ends = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
            i = j = 0
            for e in ends:
                ga, gb = [], []
                while i < len(a) and ranges[0][i][1] <= e:
                    ga.append(str(a[i]))
                    i += 1
                while j < len(b) and ranges[1][j][1] <= e:
                    gb.append(str(b[j]))
                    j += 1
                groups.append(",".join(ga) + "|" + ",".join(gb))
        rows.append((a, b, links, groups))
    counts = Counter(x for r in rows for x in r[2])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return [(len(a), len(b), len(g), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, links, g in rows]


def odd_texts():
    rng = random.Random(3)
    alphabets = ["abc de ", "日本語 テスト", "é ü ß ñ", "\n\t ", "👩‍👩‍👧 ", "1 23,4. ", "▁x ", "αβγ", "a"]
    out = [None, "", " ", "  ", "<|endoftext|>", "<s> hi </s>", "<0x41>", "▁", "a▁b", "x" * 3000, " " * 3000, "word " * 20_000, " ​﻿", "\x00\x01", "it's we'll I'd"]
    return out + ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 120))) for _ in range(300)]


@pytest.mark.parametrize("part", [alignment.PART_PAIRS, 40])
def test_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(alignment, "PART_PAIRS", part)
    texts = odd_texts() if part > 40 else odd_texts()[:40]
    texts += texts[20:30]  # repeated rows
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pairs string").repartition(3)
    rows = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in alignment.align(docs, A, B).collect()}
    for i, want in enumerate(brute_force(texts)):
        assert rows[i] == want, (i, texts[i] and texts[i][:80])


def test_the_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_token_alignment(spark, sf).collect()}
    assert rows == {d["doc_id"]: w for d, w in zip(docs, brute_force([d["text"] for d in docs]), strict=True)}


def test_no_rows_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, A, B).collect() == []
    docs = spark.createDataFrame([("a", "one two", 5), (None, None, None)], "doc_id string, text string, `_text` int")
    out = alignment.align(docs, A, B, carry=("doc_id", "_text")).collect()
    assert {(r["doc_id"], r["_text"], r["n_groups"]) for r in out} == {("a", 5, 2), (None, None, 0)}


def test_both_libraries_cut_plain_characters_alike():
    side = alignment.Bytes(A)
    for c in map(chr, range(alignment.LAST_PLAIN + 1)):
        for text in (c, f"a{c}b", f" {c} ", f"1{c}2", f".{c}'s", f"{c}{c} x", f"\n{c}\n"):
            assert side.fast.encode_ordinary(" " + text) == side.library.encode(" " + text, add_special_tokens=False).ids, (hex(ord(c)), text)
