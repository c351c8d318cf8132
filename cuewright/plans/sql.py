"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations


def IN_LIST(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


NORM = "trim(regexp_replace(replace(lower({0}), '’', ''''), '[^a-z0-9'']+', '', 'g'), '''')"

_COLUMNS = "CAST(((job_id * 31 + word_idx * 17) % 101) / 100.0 AS DOUBLE) AS confidence"

WORDS_CONV = f"""WITH RECURSIVE spoken AS (SELECT conv_id, turn, role, regexp_extract_all(text, '\\S+') AS ws FROM conversations),
 ofs AS (SELECT *, coalesce(sum(len(ws)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM spoken),
 ex AS (SELECT conv_id AS job_id, turn, role AS speaker, unnest(ws) AS word, CAST(o + generate_subscripts(ws, 1) - 1 AS BIGINT) AS word_idx FROM ofs),
 words AS (SELECT job_id, word_idx, word, 400 * word_idx + 1000 * turn AS start_ms, 400 * word_idx + 1000 * turn + 300 AS end_ms, {_COLUMNS}, speaker FROM ex)
"""

WORDS_DOC = f"""WITH RECURSIVE ex AS (SELECT doc_id AS job_id, unnest(ws) AS word, CAST(generate_subscripts(ws, 1) - 1 AS BIGINT) AS word_idx
  FROM (SELECT doc_id, regexp_extract_all(text, '\\S+') AS ws FROM documents)),
 words AS (SELECT job_id, word_idx, word, 400 * word_idx + 700 * (word_idx // 12) AS start_ms, 400 * word_idx + 700 * (word_idx // 12) + 300 AS end_ms, {_COLUMNS}, CAST(NULL AS VARCHAR) AS speaker FROM ex)
"""


def edge_norm_sql(c: str) -> str:
    return f"""trim(lower({c}), '"“”‘’''()[]{{}}.,!?;:')"""


def soundex_sql(c: str) -> str:
    letters = f"regexp_replace(upper({c}), '[^A-Z]', '', 'g')"
    code = f"translate({letters}, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '111122222222334556')"
    for d in "123456":
        code = f"regexp_replace({code}, '{d}+', '{d}', 'g')"
    return (
        f"CASE WHEN {letters} = '' THEN '' ELSE rpad(left({letters}, 1) || left(CASE WHEN regexp_matches({letters}, '^[BFPVCGJKQSXZDTLMNR]') "
        f"THEN substr({code}, 2) ELSE {code} END, 3), 4, '0') END"
    )


def similarity_sql(a: str, b: str) -> str:
    return (
        f"CASE WHEN {a} = {b} THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))"
        f" + CASE WHEN {soundex_sql(a)} = {soundex_sql(b)} THEN 0.15 ELSE 0.0 END + CASE WHEN left({a}, 1) = left({b}, 1) THEN 0.1 ELSE 0.0 END)) END"
    )


def vocab_similarity_sql(a: str, b: str) -> str:
    longest = f"greatest(length({a}), length({b}))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 WHEN {longest} <= 2 THEN 0.0 ELSE 1.0 - levenshtein({a}, {b}) / {longest} END"
