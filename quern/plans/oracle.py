"""DuckDB SQL for the queries: shared pieces."""

from __future__ import annotations

from ..functions.analysis import STOPWORDS

_STOPS = ", ".join(f"'{w}'" for w in STOPWORDS)


def stem(w: str) -> str:
    return f"""CASE WHEN length({w}) <= 3 THEN {w}
        WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN left({w}, length({w}) - 3) WHEN {w} LIKE '%edly' THEN left({w}, length({w}) - 4)
        WHEN {w} LIKE '%ed' AND length({w}) > 4 THEN left({w}, length({w}) - 2) WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y'
        WHEN {w} LIKE '%es' AND length({w}) > 4 THEN left({w}, length({w}) - 2) WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END"""


def tokens(source: str = "documents", doc_id: str = "doc_id", text: str = "text") -> str:
    """CTE `tokens`: doc_id, term."""
    return f"""words AS (SELECT {doc_id} AS doc_id, unnest(regexp_split_to_array(lower({text}), '[^a-z0-9]+')) AS w FROM {source}),
    tokens AS (SELECT doc_id, {stem('w')} AS term FROM words WHERE w <> '' AND w NOT IN ({_STOPS}))"""


def index(source: str = "documents", doc_id: str = "doc_id", text: str = "text") -> str:
    """CTEs postings, term_stats, doc_stats, corpus_stats."""
    return f"""{tokens(source, doc_id, text)},
    postings AS (SELECT term, doc_id, count(*) AS tf FROM tokens GROUP BY term, doc_id),
    term_stats AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    doc_stats AS (SELECT d.{doc_id} AS doc_id, CAST(coalesce(t.len, 0) AS BIGINT) AS len FROM {source} d LEFT JOIN (SELECT doc_id, count(*) AS len FROM tokens GROUP BY doc_id) t ON t.doc_id = d.{doc_id}),
    corpus_stats AS (SELECT count(*) AS n, CAST(coalesce(sum(len), 0) AS BIGINT) AS total_tokens, coalesce(CAST(sum(len) AS DOUBLE) / nullif(count(*), 0), 0) AS avgdl FROM doc_stats)"""


def terms(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def matches(words: list[str], k1: float = 1.5, b: float = 0.75, source: str = "documents", doc_id: str = "doc_id", text: str = "text") -> str:
    """CTEs of the index, `matches` (doc_id, term, tf, idf, contribution) and `scores` (doc_id, score, n_terms)."""
    return f"""{index(source, doc_id, text)},
    matches AS (SELECT p.doc_id, p.term, p.tf, ln((c.n - t.df + 0.5) / (t.df + 0.5) + 1.0) AS idf,
        ln((CAST(c.n AS DOUBLE) - t.df + 0.5) / (t.df + 0.5) + 1.0) * (p.tf * {k1 + 1}::DOUBLE) / (p.tf + {k1}::DOUBLE * (1.0::DOUBLE - {b}::DOUBLE + {b}::DOUBLE * d.len / c.avgdl)) AS contribution
        FROM postings p JOIN term_stats t USING (term) JOIN doc_stats d USING (doc_id), corpus_stats c WHERE p.term IN ({terms(words)}) AND c.avgdl > 0),
    scores AS (SELECT doc_id, round(sum(contribution), 6) AS score, count(*) AS n_terms FROM matches GROUP BY doc_id)"""


def extension(x: str) -> str:
    base = f"regexp_extract(lower({x}), '([^/\\\\]*)$', 1)"
    return f"(CASE WHEN regexp_matches({base}, '^.+\\.') THEN regexp_extract({base}, '([^.]*)$', 1) ELSE {base} END)"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def shorten(x: str, most: int) -> str:
    return f"CASE WHEN length({x}) > {most} THEN regexp_replace(left({x}, {most}), '\\s+$', '') || '…' ELSE {x} END"
