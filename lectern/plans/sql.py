"""The queries of this package as SQL over the same tables."""

from __future__ import annotations

SPACE = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAK = r"\r\n|[\n\x0b\x0c\r\x{85}\x{2028}\x{2029}]"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WHITE}+', ''), '{WHITE}+$', '')"


def blank(x: str) -> str:
    return f"(trim(coalesce({x}, '')) = '')"


def field(name: str) -> str:
    return f"CASE WHEN json_valid(json_metadata) THEN json_extract_string(json_metadata, '$.{name}') END"


def chunks(rows: str) -> str:
    """(key, ordinal, chunk) of rows (key, text)."""
    return f"""
        SELECT key, (row_number() OVER (PARTITION BY key ORDER BY i) - 1)::INTEGER AS ordinal, chunk FROM (
            SELECT key, i, CASE WHEN n <= 800 THEN x ELSE {strip('substring(x, i * 600 + 1, 800)')} END AS chunk, n
            FROM (SELECT key, x, length(x) AS n, unnest(range(greatest(ceil((length(x) - 200) / 600.0), 1)::BIGINT)) AS i
                  FROM (SELECT key, {strip('text')} AS x FROM ({rows})))
        ) WHERE chunk <> '' OR n <= 800"""


_OVERVIEW = f"""
    SELECT v.video_id, title, channel, watch_date, {field('upload_date')} AS upload_date,
           EXISTS (SELECT 1 FROM transcripts t WHERE t.video_id = v.video_id AND t.shorty IS NOT NULL) AS has_brief,
           (SELECT count(*) FROM synthetic_questions q WHERE q.video_id = v.video_id) AS question_count,
           (SELECT count(*) FROM entities e WHERE e.video_id = v.video_id) AS entity_count
    FROM videos v"""
_TEXT_SEARCH = "SELECT t.id, v.video_id, v.title FROM transcripts t JOIN videos v ON v.video_id = t.video_id WHERE contains(lower(t.text), 'camera rig')"
_MISSING_BLANK = f"""SELECT video_id FROM videos WHERE video_id IN
    (SELECT video_id FROM transcripts WHERE {blank('shorty')} AND NOT {blank('text')} AND video_id IS NOT NULL)"""
_KEYWORDS = f"""
    SELECT query_id, video_id, row_id, score::INTEGER AS score, rank::INTEGER AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id, row_id) AS rank FROM (
            SELECT q.id AS query_id, b.video_id, b.row_id, len(list_filter(q.ws, lambda w: contains(b.text, w))) AS score
            FROM (SELECT id, list_filter(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3) AS ws FROM ask_jobs WHERE id % 50 = 0 AND question IS NOT NULL) q
            CROSS JOIN (SELECT t.video_id, t.id AS row_id, lower(t.shorty || ' ' || coalesce(v.title, '')) AS text
                        FROM transcripts t JOIN videos v ON v.video_id = t.video_id WHERE NOT {blank('t.shorty')}) b
        ) WHERE score > 0
    ) WHERE rank <= 10"""
_NEWEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM transcripts WHERE video_id IS NOT NULL {also}) WHERE rn = 1"
_VECTORS = """
    SELECT query_id, id, distance, rank::INTEGER AS rank, label FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
            SELECT q.vec_id AS query_id, q.label, r.vec_id AS id, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) AS distance
            FROM embeddings q CROSS JOIN embeddings r WHERE q.vec_id % 50 = 0)) WHERE rank <= 10"""

TYPE_CASE = """CASE lower(trim(type))
    WHEN 'person' THEN 'person' WHEN 'per' THEN 'person' WHEN 'human' THEN 'person' WHEN 'individual' THEN 'person'
    WHEN 'organization' THEN 'organization' WHEN 'organisation' THEN 'organization' WHEN 'org' THEN 'organization' WHEN 'company' THEN 'organization' WHEN 'agency' THEN 'organization'
    WHEN 'system' THEN 'system' WHEN 'sys' THEN 'system' WHEN 'infrastructure' THEN 'system' WHEN 'platform' THEN 'system'
    WHEN 'protocol' THEN 'protocol' WHEN 'standard' THEN 'protocol'
    WHEN 'software' THEN 'software' WHEN 'app' THEN 'software' WHEN 'application' THEN 'software' WHEN 'program' THEN 'software'
    WHEN 'location' THEN 'location' WHEN 'place' THEN 'location' WHEN 'city' THEN 'location' WHEN 'country' THEN 'location' WHEN 'region' THEN 'location'
    WHEN 'concept' THEN 'concept' WHEN 'idea' THEN 'concept' WHEN 'topic' THEN 'concept' WHEN 'theme' THEN 'concept' WHEN 'product' THEN 'product' END"""

LIBRARY: dict[str, str] = {
    "library_overview": _OVERVIEW,
    "library_page": _OVERVIEW.replace("FROM videos v", "FROM (SELECT * FROM videos ORDER BY created_at DESC NULLS LAST, video_id LIMIT 50) v"),
    "library_counts": """
        SELECT channel, count(*) AS videos, count(b.video_id) AS with_brief, count(*) - count(b.video_id) AS missing_brief
        FROM videos v LEFT JOIN (SELECT DISTINCT video_id FROM transcripts WHERE shorty IS NOT NULL AND video_id IS NOT NULL) b ON v.video_id = b.video_id GROUP BY channel""",
    "channel_list": "SELECT DISTINCT channel FROM videos WHERE channel IS NOT NULL AND channel <> ''",
    "library_stats": """SELECT (SELECT count(*) FROM videos) AS videos, (SELECT count(*) FROM videos WHERE has_transcript) AS with_transcript,
        (SELECT count(*) FROM transcripts) AS transcripts, (SELECT count(*) FROM transcripts WHERE shorty IS NOT NULL) AS with_brief""",
    "latest_transcripts": f"SELECT video_id, id, language, confidence FROM ({_NEWEST.format(also='')})",
    "newest_questions": """
        SELECT video_id, (max(rank) OVER (PARTITION BY video_id) - rank + 1)::INTEGER AS position, id, question FROM (
            SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC NULLS LAST, id DESC) AS rank
            FROM (SELECT DISTINCT id, video_id, question, created_at FROM synthetic_questions WHERE video_id IS NOT NULL)) WHERE rank <= 10""",
    "missing_briefs": f"""
        SELECT DISTINCT 'null' AS rule, video_id FROM videos WHERE video_id NOT IN (SELECT video_id FROM transcripts WHERE shorty IS NOT NULL AND video_id IS NOT NULL)
        UNION ALL SELECT DISTINCT 'any_row_null', video_id FROM videos WHERE video_id IN (SELECT video_id FROM transcripts WHERE shorty IS NULL AND video_id IS NOT NULL)
        UNION ALL SELECT DISTINCT 'blank', video_id FROM ({_MISSING_BLANK})""",
    "backfill_tasks": f"""
        SELECT DISTINCT video_id, task FROM ({_MISSING_BLANK}) m CROSS JOIN (VALUES ('shorty'), ('synthetic_questions'), ('entities')) k(task)
        WHERE video_id NOT IN (SELECT video_id FROM processing_queue WHERE status IN ('pending', 'completed') AND video_id IS NOT NULL)""",
    "queue_next": """SELECT id, video_id, task FROM (SELECT DISTINCT id, video_id, task, created_at FROM processing_queue WHERE status = 'pending')
        ORDER BY created_at NULLS FIRST, id, video_id NULLS FIRST, task NULLS FIRST LIMIT 10""",
    "queue_batches": """SELECT id, (row_number() OVER (ORDER BY created_at NULLS FIRST, id) - 1) // 10 AS batch_no
        FROM (SELECT id, min(created_at) AS created_at FROM processing_queue GROUP BY id)""",
    "queue_rollup": """
        SELECT task, status, count(*) AS tasks, round(avg(epoch_us(completed_at) - epoch_us(started_at)) / 1e6, 3) AS mean_seconds,
               max(floor((epoch_us(completed_at) - epoch_us(started_at)) / 1e6))::BIGINT AS longest_seconds
        FROM (SELECT DISTINCT * FROM processing_queue) GROUP BY task, status""",
    "queue_failures": r"""
        SELECT q.video_id || chr(9) || regexp_replace(coalesce(v.title, ''), '[\t\r\n]', ' ', 'g') || chr(9) || regexp_replace(coalesce(q.error, ''), '[\t\r\n]', ' ', 'g') AS line
        FROM (SELECT DISTINCT video_id, error FROM processing_queue WHERE status = 'failed' AND video_id IS NOT NULL) q LEFT JOIN videos v ON v.video_id = q.video_id""",
    "queue_states": f"""
        SELECT q.id, q.video_id, q.task, t.id AS transcript_id,
               CASE WHEN coalesce(q.task NOT IN ('shorty', 'synthetic_questions', 'entities'), true) THEN 'unknown task' WHEN t.id IS NULL THEN 'no transcript' WHEN v.video_id IS NULL THEN 'no video' END AS problem
        FROM (SELECT DISTINCT id, video_id, task FROM processing_queue) q
        LEFT JOIN ({_NEWEST.format(also='AND text IS NOT NULL')}) t ON t.video_id = q.video_id LEFT JOIN videos v ON v.video_id = q.video_id""",
    "token_totals": """SELECT id, tokens, (sum(tokens) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING))::BIGINT AS running
        FROM (SELECT id, coalesce(length(text) // 4, 0) AS tokens FROM transcripts)""",
    "compression": f"SELECT language, count(*) AS briefs, round(sum(length(shorty)) / sum(length(text)), 6) AS ratio FROM transcripts WHERE NOT {blank('shorty')} AND NOT {blank('text')} GROUP BY language",
    "text_search": _TEXT_SEARCH,
    "text_search_top": f"{_TEXT_SEARCH} ORDER BY title NULLS FIRST, id LIMIT 10",
    "keyword_search": _KEYWORDS,
    "metadata_search": """
        SELECT b.bound, video_id, channel, watch_date FROM videos, (VALUES ('lexical'), ('inclusive_day')) b(bound)
        WHERE video_id IS NOT NULL AND channel IN ('Lantern Quay Sessions', 'Paper Bench') AND watch_date >= '2025-01-01'
          AND CASE WHEN b.bound = 'lexical' THEN watch_date ELSE substring(watch_date, 1, 10) END <= '2025-12-31'""",
    "chunk_transcripts": f"SELECT key AS id, ordinal, chunk FROM ({chunks('SELECT id AS key, text FROM transcripts WHERE text IS NOT NULL')})",
    "chunk_stats": f"SELECT key AS id, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars FROM ({chunks('SELECT id AS key, text FROM transcripts WHERE text IS NOT NULL')}) GROUP BY key",
    "clean_transcripts": f"""
        SELECT id, array_to_string(list_filter(list_transform(string_split_regex(text, '{BREAK}'), lambda s: {strip('s')}),
               lambda s: s <> '' AND NOT regexp_full_match(s, '\\p{{Nd}}{{1,2}}:\\p{{Nd}}{{2}}(:\\p{{Nd}}{{2}})?{WHITE}*[-–—]?')), chr(10) || chr(10)) AS text
        FROM transcripts WHERE text IS NOT NULL""",
    "question_words": r"SELECT id, array_to_string(list_filter(regexp_extract_all(lower(question), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 3), ' ') AS words FROM ask_jobs WHERE question IS NOT NULL",
    "video_metadata": f"""
        SELECT video_id, {field('upload_date')} AS upload_date, TRY_CAST({field('view_count')} AS BIGINT) AS view_count,
               CASE WHEN json_valid(json_metadata) THEN coalesce(json_array_length(json_metadata, '$.tags'), 0) ELSE 0 END::INTEGER AS tags FROM videos""",
    "link_ids": r"""
        SELECT doc_id, place, coalesce(nullif(regexp_extract(u, '(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/embed/)([^&\n?#]+)', 1), ''), nullif(regexp_extract(u, 'youtube\.com/watch\?.*v=([^&\n?#]+)', 1), '')) AS loose_id,
               nullif(regexp_extract(u, '(?:youtube\.com/watch\?v=|youtu\.be/)([a-zA-Z0-9_-]{11})', 1), '') AS strict_id
        FROM (SELECT doc_id, (i - 1)::INTEGER AS place, 'https://www.youtube.com/' || l AS u
              FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, 'https?://clips\.example/(\S+)', 1) AS ls FROM documents)))""",
    "entity_types": f"SELECT {TYPE_CASE} AS canonical, count(*) AS rows FROM entities GROUP BY 1",
    "entity_aliases": "SELECT DISTINCT id, coalesce(array_to_string(aliases, ', '), '') AS aliases FROM entities",
    "listed_questions": f"""
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS place, q AS question FROM (
            SELECT doc_id, i, {strip("regexp_replace(" + strip('line') + ", '^-+', '')")} AS q
            FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '{BREAK}') AS ls FROM documents WHERE doc_kind = 'question_list' AND text IS NOT NULL))
        ) WHERE q LIKE '%?'""",
    "response_entities": f"""
        SELECT video_id, f.form, count(*) * f.n AS entities, (sum(len(list_filter(coalesce(aliases, []), lambda a: {strip('a')} <> ''))) * f.n)::BIGINT AS aliases
        FROM entities CROSS JOIN (VALUES ('fenced', 1), ('object', 2), ('bare', 1), ('lone', 1)) f(form, n) WHERE video_id IS NOT NULL AND name IS NOT NULL AND {strip('name')} <> '' GROUP BY video_id, f.form, f.n""",
    "brief_sections": f"""
        WITH l AS (SELECT id, trim(unnest(ls)) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT id, string_split_regex(shorty, '{BREAK}') AS ls FROM transcripts WHERE NOT {blank('shorty')})),
        h AS (SELECT id, line, i, CASE WHEN regexp_matches(line, '\\p{{Lu}}') AND NOT regexp_matches(line, '[\\p{{Ll}}:]') AND NOT regexp_matches(line, '^[\\d\\-]') THEN line END AS head FROM l WHERE line <> ''),
        s AS (SELECT id, head, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING), 'HEADER') AS section FROM h)
        SELECT section, count(*) AS lines, count(DISTINCT id) AS briefs FROM s WHERE head IS NULL GROUP BY section""",
    "brief_headers": f"""
        SELECT video_id, 'SOURCE: ' || coalesce(nullif({strip('title')}, ''), 'Untitled') || chr(10) || 'CHANNEL: ' || c || chr(10) || 'DATE: ' || coalesce(nullif({strip(field('upload_date'))}, ''), 'unknown') || chr(10) || 'CREATOR: ' || c || chr(10) || chr(10) AS header
        FROM (SELECT *, coalesce(nullif({strip('channel')}, ''), 'Unknown channel') AS c FROM videos)""",
    "video_details": f"""
        SELECT * FROM (
            SELECT video_id, 'transcript' AS part, '' AS sort_key, id::VARCHAR AS value FROM ({_NEWEST.format(also='')})
            UNION ALL SELECT DISTINCT video_id, 'question', coalesce(strftime(created_at, '%Y-%m-%d %H:%M:%S'), '-') || '/' || lpad(coalesce(question_index::VARCHAR, '-'), 6, '0') || '/' || id::VARCHAR, question FROM synthetic_questions
            UNION ALL SELECT DISTINCT video_id, 'entity', name, name FROM entities WHERE name IS NOT NULL
        ) c WHERE EXISTS (SELECT 1 FROM videos v WHERE v.video_id = c.video_id)""",
    "video_status": """
        SELECT w.video_id, v.video_id IS NOT NULL AS known, t.video_id IS NOT NULL AS has_transcript, v.title, v.channel
        FROM (SELECT DISTINCT video_id FROM processing_queue WHERE video_id IS NOT NULL) w LEFT JOIN videos v ON v.video_id = w.video_id
        LEFT JOIN (SELECT DISTINCT video_id FROM transcripts) t ON t.video_id = w.video_id""",
    "replace_videos": """
        SELECT m.mode, video_id, CASE WHEN channel = 'Lantern Quay Sessions' THEN 'new ' || coalesce(title, '') ELSE title END AS title,
               CASE WHEN m.mode = 'replace' AND channel = 'Lantern Quay Sessions' THEN false ELSE has_transcript END AS has_transcript,
               CASE WHEN m.mode = 'replace' AND channel = 'Lantern Quay Sessions' THEN NULL ELSE watch_date END AS watch_date
        FROM videos, (VALUES ('replace'), ('merge')) m(mode)""",
    "update_briefs": """
        WITH r AS (SELECT DISTINCT video_id FROM video_removals WHERE video_id IS NOT NULL),
        t AS (SELECT id, video_id, shorty, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM transcripts)
        SELECT s.scope, t.id, md5(CASE WHEN r.video_id IS NOT NULL AND (s.scope = 'all' OR t.rn = 1) THEN '(withdrawn)' ELSE t.shorty END) AS brief
        FROM t LEFT JOIN r ON r.video_id = t.video_id CROSS JOIN (VALUES ('latest'), ('all')) s(scope)""",
    "replace_questions": """
        WITH r AS (SELECT DISTINCT video_id FROM video_removals WHERE video_id IS NOT NULL)
        SELECT * FROM (SELECT DISTINCT id, video_id, question FROM synthetic_questions) q WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.video_id = q.video_id)
        UNION ALL SELECT -1, video_id, 'What happened?' FROM r""",
    "patched_metadata": """
        WITH p AS (SELECT video_id, nullif(trim(replace(substring(watch_date, 1, 10), '-', '')), '') AS day, CASE WHEN json_valid(json_metadata) AND json_type(json_metadata) = 'OBJECT' THEN json_metadata ELSE '{}' END::JSON AS j FROM videos),
        k AS (SELECT video_id, j, unnest(json_keys(j)) AS field FROM p),
        f AS (SELECT video_id, field, json_extract(j, '$."' || field || '"')::VARCHAR AS value FROM k WHERE field <> 'upload_date' UNION ALL SELECT video_id, 'upload_date', '"' || day || '"' FROM p WHERE day IS NOT NULL)
        SELECT * FROM f UNION ALL SELECT video_id, NULL, NULL FROM p WHERE coalesce(video_id NOT IN (SELECT video_id FROM f), true)""",
    "quarantine": f"""
        SELECT table_name, reason, count(*) AS rows FROM (
            SELECT 'videos' AS table_name, 'no title' AS reason FROM videos WHERE {blank('title')} UNION ALL SELECT 'videos', 'no channel' FROM videos WHERE {blank('channel')}
            UNION ALL SELECT 'videos', 'no url' FROM videos WHERE {blank('url')} UNION ALL SELECT 'ask_jobs', 'no question' FROM ask_jobs WHERE {blank('question')}
            UNION ALL SELECT 'transcripts', 'no text' FROM transcripts WHERE {blank('text')} UNION ALL SELECT 'transcripts', 'no video' FROM transcripts WHERE video_id IS NULL
        ) GROUP BY ALL""",
    "stream_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}

_CONTEXT = f"""
    SELECT j.id AS question_id, count(k.row_id)::INTEGER AS passages,
           md5(CASE WHEN count(k.row_id) > 0 THEN string_agg('[shorty] video_id=' || k.video_id || chr(10) || t.shorty || chr(10), chr(10) || '---' || chr(10) ORDER BY k.rank)
                    ELSE 'I could not find any relevant information in your indexed videos to answer that.' END) AS context
    FROM ask_jobs j LEFT JOIN ({_KEYWORDS}) k ON k.query_id = j.id LEFT JOIN transcripts t ON t.id = k.row_id WHERE j.id % 50 = 0 GROUP BY j.id"""
_ORDINALS = f"""
    SELECT id, video_id || ':sq:' || (row_number() OVER (PARTITION BY video_id ORDER BY question_index NULLS LAST, created_at NULLS FIRST, id) - 1) AS record_id
    FROM (SELECT DISTINCT id, video_id, question, question_index, created_at FROM synthetic_questions WHERE video_id IS NOT NULL AND NOT {blank('question')})"""
_LAYERED = """
    WITH q AS (SELECT id AS question_id, video_ids FROM ask_jobs WHERE id % 50 = 0 AND question IS NOT NULL),
    var AS (SELECT question_id, e.vec_id - question_id AS variant, e.embedding FROM q JOIN embeddings e ON e.vec_id >= question_id AND e.vec_id <= question_id + 2),
    rec AS (SELECT e.vec_id AS id, t.video_id, ['chunk', 'shorty', 'synthetic_question'][(e.vec_id % 3 + 1)::INTEGER] AS layer, (e.vec_id % 7)::INTEGER AS ordinal, e.embedding FROM embeddings e LEFT JOIN transcripts t ON t.id = e.vec_id),
    cand AS (SELECT question_id, v.video_id FROM q CROSS JOIN videos v WHERE question_id % 100 = 0 AND v.channel = 'Lantern Quay Sessions' AND v.video_id IS NOT NULL),
    dist AS (SELECT question_id, variant, id, layer, video_id, ordinal, round(1 - list_cosine_similarity(var.embedding::DOUBLE[], rec.embedding::DOUBLE[]), 9) AS distance FROM var CROSS JOIN rec),
    near AS (SELECT *, row_number() OVER (PARTITION BY question_id, variant, layer ORDER BY distance, id) AS n FROM dist),
    flat AS (SELECT question_id, layer, id, video_id, ordinal, distance, row_number() OVER (PARTITION BY question_id, layer ORDER BY distance, variant, n) AS place FROM near WHERE layer <> 'shorty' AND n <= 4),
    brief AS (SELECT question_id, layer, id, video_id, ordinal, min(distance) AS distance FROM near WHERE layer = 'shorty' AND n <= 10 AND question_id NOT IN (SELECT question_id FROM cand) GROUP BY ALL
              UNION ALL SELECT question_id, layer, id, video_id, ordinal, min(distance) FROM dist WHERE layer = 'shorty' AND (question_id, video_id) IN (SELECT (question_id, video_id) FROM cand) GROUP BY ALL),
    every AS (SELECT * FROM flat UNION ALL SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS place FROM brief) WHERE place <= 10),
    kept AS (SELECT e.* FROM every e JOIN q ON q.question_id = e.question_id WHERE coalesce(len(q.video_ids), 0) = 0 OR list_contains(q.video_ids, e.video_id)),
    again AS (SELECT * EXCLUDE (place), (row_number() OVER (PARTITION BY question_id, layer ORDER BY place))::INTEGER AS place FROM kept),
    hits AS (SELECT * FROM again WHERE layer = 'shorty' OR place <= 4)"""
RETRIEVAL: dict[str, str] = {
    "knn_exact": f"SELECT query_id, id, round(distance, 6) AS distance, rank FROM ({_VECTORS})",
    "knn_best": f"""
        SELECT question_id, id, round(distance, 6) AS distance, rank::INTEGER AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, id) AS rank FROM (SELECT label::BIGINT AS question_id, id, min(distance) AS distance FROM ({_VECTORS}) GROUP BY 1, 2)) WHERE rank <= 10""",
    "self_similarity": """
        WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
        m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY 1, 2), c AS (SELECT label, list(m ORDER BY i) AS centre FROM m GROUP BY label)
        SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.centre), 6) AS similarity FROM embeddings e JOIN c ON c.label = e.label""",
    "index_records": f"""
        WITH n AS ({_NEWEST.format(also='AND text IS NOT NULL')})
        SELECT key || ':chunk:' || ordinal AS record_id, key AS video_id, 'chunk' AS kind, ordinal, md5(chunk) AS document FROM ({chunks("SELECT video_id AS key, text FROM n WHERE trim(text) <> ''")})
        UNION ALL SELECT video_id || ':shorty', video_id, 'shorty', NULL, md5(shorty) FROM n WHERE NOT {blank('shorty')}
        UNION ALL SELECT video_id || ':sq:' || o, video_id, 'synthetic_question', o, md5(question) FROM (
            SELECT video_id, question, (row_number() OVER (PARTITION BY video_id ORDER BY question_index NULLS LAST, created_at NULLS FIRST, id) - 1)::INTEGER AS o
            FROM (SELECT DISTINCT id, video_id, question, question_index, created_at FROM synthetic_questions WHERE video_id IS NOT NULL AND NOT {blank('question')}))""",
    "question_ids": f"SELECT DISTINCT q.id, coalesce(r.record_id, q.embedding_id) AS embedding_id FROM synthetic_questions q LEFT JOIN ({_ORDINALS}) r ON r.id = q.id",
    "layered_vectors": f"{_LAYERED} SELECT question_id, layer, place, video_id, ordinal, round(distance, 6) AS distance FROM hits",
    "answered_questions": f"""{_LAYERED},
        k AS (SELECT query_id AS question_id, 'shorty' AS layer, rank AS place, k.video_id, NULL::INTEGER AS ordinal, t.shorty AS document FROM ({_KEYWORDS}) k JOIN transcripts t ON t.id = k.row_id),
        v AS (SELECT question_id, layer, place, video_id, ordinal, 'passage ' || id AS document FROM hits),
        m AS (SELECT 'vector' AS mode, * FROM v UNION ALL SELECT 'keyword', * FROM k UNION ALL SELECT 'auto', * FROM v UNION ALL SELECT 'auto', * FROM k WHERE question_id NOT IN (SELECT question_id FROM v)),
        b AS (SELECT mode, question_id, count(*) AS n, string_agg('[' || layer || '] video_id=' || coalesce(video_id, 'unknown_video') || CASE WHEN ordinal IS NULL THEN '' ELSE ' chunk=' || ordinal END || chr(10) || document || chr(10), chr(10) || '---' || chr(10)
                     ORDER BY list_position(['chunk', 'shorty', 'synthetic_question'], layer), place) AS context FROM m GROUP BY 1, 2)
        SELECT o.mode, j.id AS question_id, coalesce(n, 0)::INTEGER AS passages, md5(coalesce(context, 'I could not find any relevant information in your indexed videos to answer that.')) AS answer
        FROM (SELECT id FROM ask_jobs WHERE id % 50 = 0 AND question IS NOT NULL) j CROSS JOIN (VALUES ('vector'), ('keyword'), ('auto')) o(mode) LEFT JOIN b ON b.mode = o.mode AND b.question_id = j.id""",
    "keyword_hits": f"SELECT query_id AS question_id, 'shorty' AS layer, rank AS place, video_id, -score::DOUBLE AS distance FROM ({_KEYWORDS})",
    "keyword_contexts": _CONTEXT,
}
_RECORDS = RETRIEVAL["index_records"]
RETRIEVAL["dangling_ids"] = f"SELECT count(*) AS questions, count_if(record_id NOT IN (SELECT record_id FROM ({_RECORDS}))) AS absent, count(DISTINCT record_id) AS ids FROM ({_ORDINALS})"
_AGAIN = "(SELECT * FROM transcripts WHERE video_id IS NOT NULL AND text IS NOT NULL AND id % 10 = 0)"
RETRIEVAL["index_counts"] = f"SELECT kind, count(*) AS records FROM ({_RECORDS}) GROUP BY kind"
RETRIEVAL["index_upsert"] = f"""
    SELECT record_id, kind, document FROM ({_RECORDS}) WHERE video_id NOT IN (SELECT video_id FROM {_AGAIN})
    UNION ALL SELECT record_id, kind, document FROM ({_RECORDS.replace('FROM transcripts WHERE', f'FROM {_AGAIN} WHERE').split('UNION ALL SELECT video_id || ' + "':sq:'")[0]})"""
