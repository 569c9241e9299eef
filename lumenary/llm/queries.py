"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, conversations, exact_dedup, html_extract, lang_id, licenses, near_dup, packing, quality, sharding, token_counts, vector_codes
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": lambda s, d: quality.predict(table(s, d, "documents"), table(s, d, "labels")),
    "op2_minhash_near_dedup": _documents(lambda docs: near_dup.near_duplicates(docs, k=2)),
    "op3_bpe_round_trip": _documents(bpe.round_trip),
    "op4_token_counts": _documents(token_counts.count_edited),
    "op5_html_extraction": lambda s, d: html_extract.extract(table(s, d, "pages")),
    "op6_language_id": _documents(lang_id.predict),
    "op7_packing": _documents(packing.pack),
    "op8_nearest_neighbours": lambda s, d: ann.search(table(s, d, "embeddings")),
    "op9_exact_dedup": _documents(exact_dedup.exact_duplicates),
    "op10_sharding": _documents(sharding.shard),
    "op11_conversation_repair": lambda s, d: conversations.repair_damaged(table(s, d, "conversations")),
    "op12_vector_codes": lambda s, d: vector_codes.compress(table(s, d, "embeddings")),
    "op13_license_scan": _documents(licenses.label_licenses),
}

#: Parts of op12's SQL: nearest entries, and codebooks after a round.
_NEAREST = """{a} AS MATERIALIZED (
            SELECT vec_id, part, arg_min(entry, distance * 64 + entry) AS entry, min(distance) AS distance FROM (
                SELECT vec_id, p.part, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM p JOIN {c} ON p.part = {c}.part
            ) GROUP BY vec_id, part
        )"""
_MOVED = """{d} AS MATERIALIZED (
            SELECT part, entry, coalesce(moved, c) AS c FROM {c} LEFT JOIN (
                SELECT part, entry, list(floor_mean ORDER BY place) AS moved FROM (
                    SELECT part, entry, place, (sum(x[place]) - ((sum(x[place]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
                    FROM {a} JOIN p USING (vec_id, part), range(1, 1 + (SELECT max(len(x)) FROM p)) AS r(place) GROUP BY part, entry, place
                ) GROUP BY part, entry
            ) USING (part, entry)
        )"""

#: DuckDB SQL where SQL can express the result.
ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op12_vector_codes": f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS MATERIALIZED (SELECT vec_id, part, q[part * (len(q) // 16) + 1 : (part + 1) * (len(q) // 16)] AS x FROM v, range(16) AS r(part)),
        c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 64) USING (vec_id)),
        {", ".join(f"{_NEAREST.format(a=f'a{i}', c=f'c{i}')}, {_MOVED.format(a=f'a{i}', c=f'c{i}', d=f'c{i + 1}')}" for i in range(2))}, {_NEAREST.format(a="a2", c="c2")},
        books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2),
        e AS (SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(distance)::BIGINT AS error FROM a2 JOIN v USING (vec_id) GROUP BY vec_id, label)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e, books
    """,
}
