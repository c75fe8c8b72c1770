"""The corpus queries by name, and SQL for those that SQL can express.

The others depend on trained models, vocabularies or 64-bit hashes; tests hold them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reverie.llm import bpe, hilbert, jaccard, langid, mixing, quality, substrings, syncmers, toxicity, wordpiece


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.op1_language_id,
        "op2_bpe_encode_decode": bpe.op2_bpe_encode_decode,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
        "op5_fingerprints": syncmers.op5_fingerprints,
        "op6_quality": quality.op6_quality,
        "op7_substring_dedup": substrings.op7_substring_dedup,
        "op8_token_counts": wordpiece.op8_token_counts,
        "op9_nearest_neighbours": hilbert.op9_nearest_neighbours,
        "op10_mixing": mixing.op10_mixing,
    }


#: Words as the contract has them, of a text that may be null.
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links by an inverted index of shingles, then the least doc_id that each one reaches.
OP4 = f"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents WHERE doc_id IS NOT NULL),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT w.doc_id, count(sh.s) AS n FROM (SELECT DISTINCT doc_id FROM w) w LEFT JOIN sh USING (doc_id) GROUP BY w.doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS to_id FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.to_id)
SELECT d.doc_id, n.n AS n_shingles, c.component_id FROM documents d JOIN n USING (doc_id) JOIN (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

#: A window's words as text; the smallest doc_id that has it; the words that repeated windows cover.
OP7 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents WHERE doc_id IS NOT NULL),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS least FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT DISTINCT doc_id, i FROM win JOIN least USING (h) WHERE least < doc_id), (SELECT unnest(range(50)) AS j)),
cut AS (SELECT doc_id, list(pos) AS pos FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(len(c.pos), 0) AS n_removed, sha256(coalesce(array_to_string(CASE WHEN c.pos IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(c.pos, i)) END, ' '), '')) AS kept_sha256 FROM w LEFT JOIN cut c USING (doc_id)
"""

#: Brute force. It is what the operator must give where its windows see the whole table (up to 512 vectors); beyond, recall is measured.
OP9 = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard": OP4, "op7_substring_dedup": OP7, "op9_nearest_neighbours": OP9}
