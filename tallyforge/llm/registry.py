"""Queries of the training-data operators and the SQL that says the same, where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontamination, embeddings, html_text, jaccard, kneser_ney, language_id, licenses, merkle, packing, pii, quotes, secrets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.op1_packing,
    "op2_quotation_links": quotes.op2_quotation_links,
    "op3_kneser_ney": kneser_ney.op3_kneser_ney,
    "op4_language_id": language_id.op4_language_id,
    "op5_embeddings": embeddings.op5_embeddings,
    "op6_secrets": secrets.op6_secrets,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_html_text": html_text.op9_html_text,
    "op10_licenses": licenses.op10_licenses,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_pii": pii.op12_pii,
    "op13_collocations": collocations.op13_collocations,
}

WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def template_rows() -> str:
    """The templates' grams as SQL rows: template, label, base, k, n_grams, place, gram."""
    every = [(label, text, licenses.PHRASE_K, base) for label, text, base in licenses.PHRASES] + [(label, text, licenses.TEXT_K, False) for label, text in licenses.TEXTS]
    rows = []
    for i, (label, text, k, base) in enumerate(every):
        w = re.findall("[a-z0-9]+", text.lower())
        rows += [f"({i}, '{label}', {base}, {k}, {len(w) - k + 1}, {p}, '{' '.join(w[p : p + k])}')" for p in range(len(w) - k + 1)]
    return ", ".join(rows)


ORACLES: dict[str, str] = {
    "op10_licenses": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g(template, label, base, k, n_grams, place, gram) AS (VALUES {template_rows()}),
dw AS (SELECT doc_id, k, i - 1 AS spot, array_to_string(w[i : i + k - 1], ' ') AS gram
       FROM d, (VALUES ({licenses.PHRASE_K}), ({licenses.TEXT_K})) AS ks(k), unnest(range(1, greatest(1, len(w) - k + 2))) AS u(i)),
lines AS (SELECT doc_id, template, label, base, g.k, n_grams, spot - place AS diagonal, count(DISTINCT place) AS votes, min(spot) AS lo, max(spot) AS hi
          FROM dw JOIN g ON dw.gram = g.gram AND dw.k = g.k GROUP BY ALL),
fresh AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > CASE WHEN k = {licenses.TEXT_K} THEN {licenses.NEAR} ELSE 0 END, true) AS f FROM lines),
numbered AS (SELECT *, sum(f::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS line FROM fresh),
merged AS (SELECT doc_id, template, label, base, k, n_grams, line, sum(votes) AS votes, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY ALL),
spans AS (SELECT *, least(1.0::DOUBLE, votes / n_grams) AS cover FROM merged
          WHERE CASE WHEN k = {licenses.TEXT_K} THEN votes / n_grams >= {licenses.LEAST_COVER}::DOUBLE AND hi - lo < 2 * n_grams ELSE votes = n_grams END),
q AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(lo) FILTER (base) AS first_word, max(lo) FILTER (base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN q USING (doc_id)""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS t
       FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS t
       FROM d, (SELECT DISTINCT k FROM bw) AS ks, unnest(range(1, greatest(1, len(w) - k + 2))) AS u(i)),
h AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.k = bw.k),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM h, unnest(range(i, i + k)) AS u(pos) GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, sha256(concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'), coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
  sha256(concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-'), coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))) AS cut,
  xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 2 = 0 AS tampered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS many FROM d),
tree AS (SELECT source, 0 AS level, place AS i, leaf AS h, many AS n FROM l
         UNION ALL SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY source, level, n, i // 3),
sub AS (SELECT source, level AS top, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
forest AS (SELECT 0 AS level, i, h, n FROM sub UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM forest WHERE n > 1 GROUP BY level, n, i // 3),
every AS (SELECT source, level, i, h FROM tree WHERE n > 1),
own AS (SELECT a.source, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lo, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS hi
        FROM every AS a JOIN every AS b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.i // 3 = b.i // 3 GROUP BY ALL),
shared AS (SELECT a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lo, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS hi
           FROM forest AS a JOIN forest AS b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
up AS (SELECT source, place AS leaf_place, 0 AS level, place AS i, CASE WHEN tampered THEN cut ELSE leaf END AS h, '' AS proof FROM l
       UNION ALL SELECT up.source, leaf_place, up.level + 1, up.i // 3, sha256(concat(lo, h, hi)), concat(proof, lo, hi) FROM up JOIN own ON up.source IS NOT DISTINCT FROM own.source AND up.level = own.level AND up.i = own.i),
over AS (SELECT up.source, leaf_place, 0 AS level, sub.i, up.h, proof FROM up JOIN sub ON up.source IS NOT DISTINCT FROM sub.source AND up.level = sub.top
         UNION ALL SELECT source, leaf_place, over.level + 1, over.i // 3, sha256(concat(lo, h, hi)), concat(proof, lo, hi) FROM over JOIN shared ON over.level = shared.level AND over.i = shared.i),
root AS (SELECT level, h FROM forest WHERE n = 1)
SELECT l.doc_id, l.leaf, sub.h AS subroot, root.h AS root, sha256(over.proof) AS proof_sha256, over.h AS folded_root, over.h = root.h AS verified
FROM l JOIN sub ON l.source IS NOT DISTINCT FROM sub.source JOIN root ON true JOIN over ON over.source IS NOT DISTINCT FROM l.source AND over.leaf_place = l.place AND over.level = root.level""",
    "op13_collocations": r"""
WITH p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*)::HUGEINT AS a
      FROM p, (VALUES (1), (2), (3), (4), (5)) AS ks(k), unnest(range(1, greatest(1, len(w) - k + 2))) AS u(i) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
inside AS (SELECT DISTINCT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, a AS longer FROM c, (VALUES (2), (3), (4)) AS sizes(s), unnest(range(1, greatest(1, k - s + 2))) AS u(i) WHERE s < k),
alone AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inside AS x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.longer >= 100 * c.a)),
cuts AS (SELECT alone.lang, alone.phrase, alone.a, x.a AS l, y.a AS r, t.n, j, 1000 * alone.a * t.n // (x.a * y.a) AS score
         FROM alone JOIN t USING (lang), unnest(range(1, alone.k)) AS u(j), g AS x, g AS y
         WHERE x.lang = alone.lang AND y.lang = alone.lang AND x.phrase = array_to_string(alone.w[1 : j], ' ') AND y.phrase = array_to_string(alone.w[j + 1 :], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
}
