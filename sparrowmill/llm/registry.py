"""The queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .bpe_tree import op10_byte_bpe
from .materialise import op6_materialise
from .packing import op1_packing
from .passages import op3_passages
from .quality import op8_quality
from .simhash import op4_simhash
from .sketches import op7_fingerprints
from .suffixes import op9_suffix_dedup
from .toxicity import op2_toxicity
from .urls import RULES, op5_url_filters

QUERIES = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_passages": op3_passages,
    "op4_simhash": op4_simhash,
    "op5_url_filters": op5_url_filters,
    "op6_materialise": op6_materialise,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality": op8_quality,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLES: dict[str, str] = {}


def _columns(name: str, query: str, columns: list[str], sql: str) -> None:
    """A query for those columns of an operator's that SQL can express, as it gives them, and their SQL."""
    QUERIES[name] = lambda spark, sf_dir: QUERIES[query](spark, sf_dir).select(*columns)
    ORACLES[name] = sql


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_columns("quality_base_counts", "op8_quality", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], f"""
WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS i FROM documents),
g AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d, lead(word, 4) OVER o AS e FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c, d, e) AS n FROM g WHERE e IS NOT NULL),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS i FROM r WHERE n > 1), rep AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
n AS (SELECT doc_id, len({_WORDS})::BIGINT AS n_words, coalesce(list_sum(list_transform({_WORDS}, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM documents)
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(rep.n, 0) > 20 * n_words AS base_failed
FROM n LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)""")

_columns("edited_texts", "op7_fingerprints", ["doc_id", "n_chars", "edited_sha256"], """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS u, length(t) // 4 AS q FROM t)
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - q) || left(u, q)) AS edited_sha256 FROM x""")

_HOST = "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_columns("listed_url_rules", "op5_url_filters", ["page_id", "host", "path", "rule"], f"""
WITH u AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(h, p) AS (VALUES {", ".join(f"('{h}', '{p}')" for _, h, p in RULES)}),
f AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule FROM u LEFT JOIN f USING (page_id)""")
