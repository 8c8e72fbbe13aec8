"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from linkspark.llm import backoff, html_text, itq, langid, licences, mixing, packing, quality, repeats, shingle_join


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.query,
        "op2_licences": licences.query,
        "op3_quality": quality.query,
        "op4_itq": itq.query,
        "op5_backoff": backoff.query,
        "op6_langid": langid.query,
        "op7_mixing": mixing.query,
        "op8_html": html_text.query,
        "op9_repeats": repeats.query,
        "op10_shingle_join": shingle_join.query,
        "pipeline": corpus_pipeline.run,
    }


#: Components of links e (a, b, both ways) among nodes n (id), as the least id reached.
_REACH = "reach(v, r) AS (SELECT id, id FROM n UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.v), comp AS (SELECT v, min(r) AS component_id FROM reach GROUP BY 1)"

OP4 = f"""WITH RECURSIVE ok AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len([x for x in embedding if NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
e AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)) >= 0.93),
n AS (SELECT vec_id AS id FROM embeddings), {_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM e WHERE e.a = id)::bigint AS n_links, component_id, id = component_id AS kept FROM n JOIN comp ON v = id"""

OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::varchar[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] END) AS t FROM w),
c AS MATERIALIZED (SELECT doc_id, count(*) AS k FROM s GROUP BY 1), p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * met >= 85 * (x.k + y.k - met)), n AS (SELECT doc_id AS id FROM documents), {_REACH}
SELECT id AS doc_id, coalesce(k, 0)::bigint AS n_shingles, component_id FROM n JOIN comp ON v = id LEFT JOIN c ON c.doc_id = id"""


def oracle_sql() -> dict[str, str]:
    """Of the queries whose results SQL can give on whole tables; tests hold the others against brute force."""
    return {"op4_itq": OP4, "op10_shingle_join": OP10}
