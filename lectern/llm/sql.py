"""SQL statements of the queries that SQL can express over whole tables."""

#: The same words in the same sets, and the cut rule, are stated independently of the operators.
SQL: dict[str, str] = {
    "p4_found": r"""
        WITH t AS (
            SELECT id, regexp_replace(regexp_replace(text, '^[\s\p{Z}\x{1c}-\x{1f}\x{85}]+', ''), '[\s\p{Z}\x{1c}-\x{1f}\x{85}]+$', '') AS x
            FROM transcripts WHERE text IS NOT NULL
        ), long AS (SELECT id, x FROM t WHERE length(x) > 800)
        SELECT id AS transcript_id,
               CASE WHEN list_max(list_transform(regexp_extract_all(x, '[^\s\p{Z}\x{1c}-\x{1f}\x{85}.!?。！？]*[.!?。！？]|[^\s\p{Z}\x{1c}-\x{1f}\x{85}.!?。！？]+'), lambda s: length(s))) > 800
                    THEN 'forced' ELSE 'natural' END AS cut
        FROM long
    """,
    "p5_found": r"""
        WITH w AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM transcripts WHERE text IS NOT NULL),
        s AS (SELECT id, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS sh FROM w WHERE len(ws) >= 20),
        e AS (SELECT id, len(sh) AS n, unnest(sh) AS t FROM s),
        p AS (SELECT a.id AS id_a, b.id AS id_b, any_value(a.n) + any_value(b.n) AS n, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)
        SELECT id_a, id_b FROM p WHERE c + 1e-9 >= 0.6 * (n - c)
    """,
    "p9_found": r"""
        WITH w AS (
            SELECT 0 AS kind, doc_id AS id, regexp_extract_all(regexp_replace(strip_accents(lower(text)), '[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}\p{Mn}]', '', 'g'), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL
            UNION ALL
            SELECT 1, item_id, regexp_extract_all(strip_accents(lower(passage)), '[\p{L}\p{N}]+') FROM eval_items WHERE passage IS NOT NULL
        ), g AS (
            SELECT kind, id, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS phrase FROM w WHERE len(ws) >= 13
        )
        SELECT DISTINCT a.id AS doc_id, b.id AS item_id
        FROM g a JOIN g b ON a.phrase = b.phrase AND a.kind = 0 AND b.kind = 1
    """,
}
