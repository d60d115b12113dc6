"""The queries of this subpackage by name."""

from __future__ import annotations

from skein.llm.decontaminate import op3_decontamination
from skein.llm.langid import op5_language_id
from skein.llm.licenses import op1_license_scan
from skein.llm.neighbours import op7_nearest_neighbours
from skein.llm.packing import op6_best_fit_packing
from skein.llm.pii import op8_pii
from skein.llm.quality import op10_quality_classifier
from skein.llm.simhash import op2_simhash_near_dedup
from skein.llm.substrings import op4_substring_dedup
from skein.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_pii": op8_pii,
    "op9_toxicity": op9_toxicity,
    "op10_quality_classifier": op10_quality_classifier,
}
SQL: dict[str, str] = {
    "op4_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM d),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM p),
        r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS later FROM g),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE later),
        x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS v FROM d),
        k AS (SELECT x.doc_id, count(c.i) AS gone, coalesce(string_agg(CASE WHEN c.i IS NULL THEN x.v END, ' ' ORDER BY x.i), '') AS kept
              FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id
    """,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
