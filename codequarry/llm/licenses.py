"""License scans by a positional index of rare words.

The templates are whole licence texts and notices, and short phrases. The index holds, for the rarest words of each
template's key phrase (by inverse template frequency), their positions in it. A file's licence words are looked up; the
postings of one template, each shifted by its position, are intersected, and a start that all of them agree on is a
candidate. It is kept if the key phrase stands there word for word, and if the words of the template that stand in the
stretch it would cover have enough of its weight, so that a changed name or a line more does no harm.

Everything is one projection: no shuffle and no user functions. The index is one constant of the plan and expressions
don't grow with it. Work is in proportion to the words of the file and the postings that they hit.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import license_texts as texts
from .shared import ALNUM_WORD, fresh, let, quoted, words


@dataclass(frozen=True)
class Template:
    """``text``: of the licence. ``key``: the phrase, part of the text, that must be there. ``base``: a phrase to count."""

    label: str
    text: str
    key: str
    base: bool = False


TEMPLATES = (
    Template("mit", "mit license", "mit license", base=True),
    Template("apache", "apache license", "apache license", base=True),
    Template("gpl", "general public license", "general public license", base=True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    Template("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc0", "creative commons cc0 1 0 universal", "cc0 1 0"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    Template("mit", texts.MIT, "permission is hereby granted free of charge to any person obtaining a copy"),
    Template("bsd-3-clause", texts.BSD_3_CLAUSE, "may be used to endorse or promote products derived from this software"),
    Template("isc", texts.ISC, "distribute this software for any purpose with or without fee is hereby granted"),
    Template("zlib", texts.ZLIB, "the origin of this software must not be misrepresented"),
    Template("bsl-1.0", texts.BSL_1_0, "obtaining a copy of the software and accompanying documentation covered by this license"),
    Template("unlicense", texts.UNLICENSE, "free and unencumbered software released into the public domain"),
    Template("apache-2.0", texts.APACHE_NOTICE, "you may not use this file except in compliance with the license"),
    Template("gpl-2.0", texts.GPL_2_NOTICE, "either version 2 of the license"),
    Template("gpl-3.0", texts.GPL_3_NOTICE, "either version 3 of the license"),
    Template("lgpl", texts.LGPL_NOTICE, "under the terms of the gnu lesser general public license"),
    Template("agpl", texts.AGPL_NOTICE, "under the terms of the gnu affero general public license"),
    Template("mpl-2.0", texts.MPL_2_NOTICE, "subject to the terms of the mozilla public license v 2 0"),
    Template("epl-2.0", texts.EPL_2_NOTICE, "under the terms of the eclipse public license 2 0"),
    Template("wtfpl", texts.WTFPL, "permitted to copy and distribute verbatim or modified copies of this license document"),
)
#: Share of a template's weight that must stand where the template would.
LEAST_SCORE = 0.6
#: Words of a key phrase that are looked up.
RARE_WORDS = 3
#: A stretch reaches beyond the template's own length by one word in so many, on either side.
SLACK = 10


@dataclass(frozen=True)
class Entry:
    """A template in the index. ``start``: of the key phrase in the text. ``rare``: (word, position in the key phrase), rarest
    first. ``weights``: of the text's distinct words."""

    label: str
    base: bool
    key: tuple[str, ...]
    start: int
    n: int
    slack: int
    rare: tuple[tuple[str, int], ...]
    weights: tuple[tuple[str, int], ...]

    @property
    def total(self) -> int:
        return sum(weight for _, weight in self.weights)


def _split(text: str) -> tuple[str, ...]:
    return tuple(re.findall("[0-9a-z]+", text.lower()))


def build_index(templates: tuple[Template, ...] = TEMPLATES, rare_words: int = RARE_WORDS) -> tuple[Entry, ...]:
    """Index each template under the words of its key phrase with the highest idf.

    As the key phrase is mandatory, every true occurrence holds these words at their positions, so looking up
    no others loses none. Weights are whole thousandths of the idf.
    """
    split = [_split(t.text) for t in templates]
    df: dict[str, int] = {}
    for w in split:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    idf = {x: round(1000 * math.log((1 + len(templates)) / n)) for x, n in df.items()}
    out = []
    for t, w in zip(templates, split, strict=True):
        key = _split(t.key)
        start = next(i for i in range(len(w)) if w[i : i + len(key)] == key)
        best = sorted(range(len(key)), key=lambda i: (-idf[key[i]], i))[:rare_words]
        out.append(Entry(t.label, t.base, key, start, len(w), len(w) // SLACK, tuple((key[i], i) for i in best), tuple((x, idf[x]) for x in dict.fromkeys(w))))
    return tuple(out)


INDEX = build_index()


def _literal(index: tuple[Entry, ...]) -> Column:
    """The index as a constant, which the optimizer folds into one value."""
    split = lambda values: F.split(F.lit(" ".join(str(v) for v in values)), " ")

    def pairs(values: tuple[tuple[str, int], ...]) -> Column:
        return F.arrays_zip(split(x for x, _ in values).alias("word"), split(n for _, n in values).cast("array<int>").alias("n"))

    return F.array(*[
        F.struct(
            F.lit(e.label).alias("label"), F.lit(e.base).alias("base"), split(e.key).alias("key"), F.lit(e.start).alias("start"), F.lit(e.n).alias("n"),
            F.lit(e.slack).alias("slack"), pairs(e.rare).alias("rare"), pairs(e.weights).alias("weights"), F.lit(e.total).alias("total"),
        )
        for e in index
    ])


def _starts(hits: Column, entry: Column) -> Column:
    """Where all rare words of a template stand at their positions, as starts of its key phrase."""
    shifted = lambda rare: F.transform(F.filter(hits, lambda h: h["x"] == rare["word"]), lambda h: h["i"] - rare["n"]).cast("array<int>")
    others = F.slice(entry["rare"], 2, F.lit(RARE_WORDS))
    return F.aggregate(others, shifted(F.get(entry["rare"], F.lit(0))), lambda starts, rare: F.array_intersect(starts, shifted(rare)).cast("array<int>"))


def _score(w: Column, at: Column, entry: Column) -> Column:
    """Share of the template's weight whose words stand in the stretch that a template with its key phrase at ``at`` covers."""
    first = F.greatest(at - entry["start"] - entry["slack"], F.lit(0))
    stretch = F.slice(w, first + 1, at - entry["start"] + entry["n"] + entry["slack"] - first)

    def weight(held: Column) -> Column:
        return F.aggregate(F.filter(entry["weights"], lambda x: F.array_contains(held, x["word"])), F.lit(0), lambda total, x: total + x["n"])

    return F.round(let(F.array_intersect(stretch, F.transform(entry["weights"], lambda x: x["word"])), weight) / entry["total"], 6)


def _found(w: Column, entries: Column, index: tuple[Entry, ...]) -> Column:
    """All verified occurrences of ``entries`` in the words ``w``."""
    rare = sorted({x for e in index for x, _ in e.rare})

    def of_template(hits: Column, entry: Column) -> Column:
        stands = lambda at: F.when(at >= 0, F.slice(w, at + 1, F.size(entry["key"])) == entry["key"]).otherwise(F.lit(False))
        judged = F.transform(
            F.filter(_starts(hits, entry), stands),
            lambda at: F.struct(entry["label"].alias("label"), entry["base"].alias("base"), at.cast("long").alias("start"), _score(w, at, entry).alias("score")),
        )
        return F.filter(judged, lambda f: f["base"] | (f["score"] >= LEAST_SCORE))

    hits = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: h["x"].isin(*rare))
    return let(hits, lambda h: F.flatten(F.transform(entries, lambda e: of_template(h, e))))


def scan(docs: DataFrame, index: tuple[Entry, ...] = INDEX, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``n_words`` and ``found`` of every text: array of (label, base, start word of the key phrase, score).

    A null text is empty, and an empty table gives an empty one. Only A-Z are lower-cased. Templates whose rare words are
    no substrings of a text, nearly always all of them, are done after that test; for the others all words are looked at,
    whatever the length. Overlapping and repeated occurrences each count, and repeated rows stay. Carried columns may
    have any names but ``n_words`` and ``found``.
    """
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    empty = F.array().cast("array<struct<label:string,base:boolean,start:long,score:double>>")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    possible = let(F.lower(t), lambda low: F.filter(_literal(index), lambda e: F.forall(e["rare"], lambda x: F.contains(low, x["word"]))))
    found = let(possible, lambda entries: F.when(F.size(entries) > 0, let(words(F.translate(t, upper, upper.lower()), ALNUM_WORD), lambda w: _found(w, entries, index))).otherwise(empty))
    hidden = fresh((*carry, "n_words"), "_f")
    kept = [F.col(quoted(c)) for c in carry]
    return docs.select(*kept, F.regexp_count(t, F.lit(ALNUM_WORD)).cast("long").alias("n_words"), found.alias(hidden)).select(*kept, "n_words", F.col(hidden).cast("array<struct<label:string,base:boolean,start:long,score:double>>").alias("found"))
