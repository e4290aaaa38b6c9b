"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapewatch.llm.elias_fano import op10_elias_fano
from tapewatch.llm.exact_dedup import op1_radix_dedup
from tapewatch.llm.hnsw import op13_hnsw
from tapewatch.llm.html_text import op3_dom_messages
from tapewatch.llm.mixing import op2_weighted_mix
from tapewatch.llm.packing import op4_min_bin_slack
from tapewatch.llm.periodic_runs import op11_recompression_runs
from tapewatch.llm.sharding import op5_hilbert_sharding
from tapewatch.llm.simhash import op8_simhash_bktree
from tapewatch.llm.token_counts import op6_token_counts
from tapewatch.llm.topk import op7_pivot_distance
from tapewatch.llm.toxicity import op9_fair_toxicity
from tapewatch.llm.whitening import op12_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_radix_dedup": op1_radix_dedup,
    "op2_weighted_mix": op2_weighted_mix,
    "op3_dom_messages": op3_dom_messages,
    "op4_min_bin_slack": op4_min_bin_slack,
    "op5_hilbert_sharding": op5_hilbert_sharding,
    "op6_token_counts": op6_token_counts,
    "op7_pivot_distance": op7_pivot_distance,
    "op8_simhash_bktree": op8_simhash_bktree,
    "op9_fair_toxicity": op9_fair_toxicity,
    "op10_elias_fano": op10_elias_fano,
    "op11_recompression_runs": op11_recompression_runs,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_hnsw": op13_hnsw,
}

ORACLES: dict[str, str] = {
    "op1_radix_dedup": """
        WITH normal AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS n
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
               doc_id = first_value(doc_id) OVER best AS kept, sha256(n) AS text_sha256
        FROM normal WINDOW best AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)""",
    "op7_pivot_distance": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
}
