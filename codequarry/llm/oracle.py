"""DuckDB SQL for the queries that SQL can express, on the whole tables."""

from __future__ import annotations

from . import licenses, lm, mixing, quality

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _weights() -> str:
    return "CASE rank % {} {} END".format(len(mixing.WEIGHTS), " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS)))


OP1 = f"""
WITH d AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
r AS (SELECT *, ({_weights()})::DOUBLE AS weight, (source_size * {mixing.MAX_COPIES})::DOUBLE AS cap
      FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s)),
l AS (SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER w, 0.0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0) AS weights
      FROM r WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap < rest * weight / weights AS cut FROM l),
p AS (SELECT *, max(CASE WHEN NOT cut THEN rest / weights END) OVER () AS per FROM c),
t AS (SELECT source, source_size, least(CASE WHEN cut THEN cap ELSE weight * per END, cap) AS target, ceil(n / {float(mixing.LANE_ROWS)})::BIGINT AS lanes,
      ('0x' || substr(md5('mix:' || coalesce(source, chr(0) || 'null')), 1, 6))::BIGINT AS off FROM p),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * {mixing.UNIT}) ELSE 0 END::BIGINT AS step FROM t),
x AS (SELECT d.*, u.* EXCLUDE (source), sum(step) OVER (PARTITION BY d.source ORDER BY floor(sqrt(size::DOUBLE))::BIGINT, doc_id % lanes, size, doc_id ROWS UNBOUNDED PRECEDING) + off AS point
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, (size * (floor(point / {float(mixing.UNIT)}) - floor((point - step) / {float(mixing.UNIT)})))::BIGINT AS taken FROM x
"""


def _rules() -> str:
    measures = {
        "n_words": "n_words", "mean_word_chars": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words", "stop_word_ratio": "n_stop / n_words",
        "dup_line_ratio": "n_dup_lines / n_lines", "mark_line_ratio": "n_mark / n_lines", "repeat_word_ratio": "n_repeat_words / n_words",
    }
    out = []
    for r in quality.RULES:
        if r.least is not None:
            out.append(f"coalesce({measures[r.measure]} >= {r.least!r}::DOUBLE, true)")
        if r.most is not None:
            out.append(f"coalesce({measures[r.measure]} <= {r.most!r}::DOUBLE, true)")
    return " AND ".join(out)


OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {WORDS} AS ws,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
rw AS (SELECT rid, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2), (3), (4)) v(j) GROUP BY rid),
c AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words, nullif(len(ls), 0) AS n_lines,
      len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•|]|(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_mark,
      len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in quality.STOP_WORDS)}))) AS n_stop FROM d LEFT JOIN rw USING (rid)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND ({_rules()}) AS kept FROM b
"""


def _templates() -> str:
    listed = lambda values: "[" + ", ".join(repr(v) for v in values) + "]"
    return ",\n".join(
        f"({k}, '{e.label}', {str(e.base).lower()}, {listed(e.key)}, {e.start}, {e.n}, {e.slack}, {listed(x for x, _ in e.weights)}, {listed(n for _, n in e.weights)}, {e.total})" for k, e in enumerate(licenses.INDEX)
    )


OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ALNUM_WORDS} AS w FROM documents),
t(k, label, base, phrase, lead, n, slack, ws, weights, total) AS (VALUES {_templates()}),
spot AS (SELECT rid, w, i, w[i] AS first FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE w[i] IN (SELECT phrase[1] FROM t)),
f AS (SELECT rid, label, base, i - 1 AS place, w[greatest(i - lead - slack, 1):i - lead - 1 + n + slack] AS stretch, ws, weights, total
      FROM spot JOIN t ON first = phrase[1] AND w[i:i + len(phrase) - 1] = phrase),
s AS (SELECT rid, label, base, place, round(list_sum(list_transform(range(1, len(ws) + 1), lambda j: CASE WHEN list_contains(stretch, ws[j]) THEN weights[j] ELSE 0 END))::DOUBLE / total, 6) AS score FROM f),
a AS (SELECT rid, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
      FROM s WHERE base OR score >= {licenses.LEAST_SCORE!r} GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN a USING (rid)
"""

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ALNUM_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {ALNUM_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS gram FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw))),
hits AS (SELECT rid, i, dw.m, item FROM dw JOIN bw ON dw.m = bw.m AND dw.gram = bw.gram),
n AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT rid, i, m FROM hits)) GROUP BY rid),
k AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)
"""

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {ALNUM_WORDS} AS w FROM documents),
p AS (SELECT rid, i, w[i] AS w1, CASE WHEN i > 1 THEN w[i - 1:i] END AS w2, CASE WHEN i > 2 THEN w[i - 2:i] END AS w3 FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT w1, count(*) AS n FROM p GROUP BY w1),
c2 AS (SELECT w2, count(*) AS n FROM p WHERE w2 IS NOT NULL GROUP BY w2),
c3 AS (SELECT w3, count(*) AS n FROM p WHERE w3 IS NOT NULL GROUP BY w3),
s1 AS (SELECT p.*, c1.n AS n1, ln(c1.n::DOUBLE / (SELECT count(*) FROM p)) AS l1 FROM p JOIN c1 USING (w1)),
s2 AS (SELECT s1.*, coalesce(c2.n, 0) AS n2, c0.n AS of2 FROM s1 LEFT JOIN c2 USING (w2) LEFT JOIN c1 c0 ON c0.w1 = s1.w2[1]),
b AS (SELECT *, CASE WHEN w2 IS NULL THEN l1 WHEN n2 >= {lm.MIN_COUNT} THEN ln(n2::DOUBLE / of2) ELSE ln({lm.BACKOFF}::DOUBLE) + l1 END AS l2 FROM s2),
s3 AS (SELECT b.*, coalesce(c3.n, 0) AS n3, c0.n AS of3 FROM b LEFT JOIN c3 USING (w3) LEFT JOIN c2 c0 ON c0.w2 = b.w3[1:2]),
t AS (SELECT rid, sum(CASE WHEN w3 IS NULL THEN l2 WHEN n3 >= {lm.MIN_COUNT} THEN ln(n3::DOUBLE / of3) ELSE ln({lm.BACKOFF}::DOUBLE) + l2 END) AS total FROM s3 GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(total, 0.0), 6) AS log_prob, CASE WHEN len(w) > 0 THEN round(total / len(w), 6) END AS score FROM d LEFT JOIN t USING (rid)
"""

_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda p, q: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384::UBIGINT) ELSE p >> 1 END))"

OP11 = f"""
WITH t AS (SELECT conv_id, list({{'k': coalesce(role, '') || chr(0) || coalesce(text, ''), 'b': strlen(coalesce(text, ''))}}
             ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, (xor({_CRC}, 4294967295::UBIGINT) % 9)::BIGINT AS h FROM t),
c AS (SELECT h.conv_id, coalesce(b.own, [])[1:h.h] || h.own[h.h + 1:] AS turns FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(turns) AS n, d::BIGINT AS depth, turns[d].b AS bytes, sha256(d || ':' || array_to_string(list_transform(turns[1:d], lambda x: sha256(x.k)), ',')) AS node,
             sha256((d - 1) || ':' || array_to_string(list_transform(turns[1:d - 1], lambda x: sha256(x.k)), ',')) AS above
      FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM c)),
g AS (SELECT node, any_value(above) AS above, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(coalesce(bytes, 0)) AS bytes,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM p GROUP BY node),
k AS (SELECT g.*, up.conv_id AS parent_conv_id, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN g up ON up.node = g.above AND g.depth > 0
      LEFT JOIN (SELECT above, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY above) x ON x.above = g.node),
s AS (SELECT a.node, sum((k.n_convs - 1) * k.bytes)::BIGINT AS saved_tokens, count(*) FILTER (k.n_children = 0) AS n_leaves
      FROM k JOIN p q ON q.conv_id = k.conv_id AND q.depth = k.depth JOIN p a ON a.conv_id = k.conv_id AND a.depth <= k.depth GROUP BY a.node)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM k JOIN s USING (node)
"""

OP12 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLES = {"op1_mix_sources": OP1, "op3_quality_rules": OP3, "op5_license_scan": OP5, "op8_decontaminate": OP8, "op10_lm_scores": OP10, "op11_prefix_trie": OP11, "op12_nearest_neighbours": OP12}
