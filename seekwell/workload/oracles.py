"""The same results in SQL, over the same tables. Used to check the queries."""

from ..constants import EMBEDDING_DIM, INDEXED_EXTENSIONS

_NAMES = ", ".join(f"'{e}'" for e in INDEXED_EXTENSIONS)
_EXT = "CASE doc_id % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'py' WHEN 2 THEN 'rs' ELSE 'txt' END"
_MIXED = "CASE doc_id % 4 WHEN 0 THEN 'md' WHEN 1 THEN 'py' WHEN 2 THEN 'log' ELSE 'bin' END"
_PATH = f"lang || '/doc_' || doc_id || '.' || {_EXT}"

FILES = f"""
files AS (SELECT doc_id, lang, source AS folder, {_PATH} AS path, text AS content,
                 strlen(text)::BIGINT AS size FROM documents)"""
CORPUS = f"""
files AS (SELECT doc_id, lang, 'corpus' AS folder, source || '/' || {_PATH} AS path,
                 text AS content, strlen(text)::BIGINT AS size FROM documents)"""
MIXED_FILES, MIXED_CORPUS = (s.replace(_EXT, _MIXED) for s in (FILES, CORPUS))
# what the index keeps of a snapshot
INDEXED = """
indexed AS (SELECT folder, path, content, sha256(content) AS hash FROM files
            WHERE regexp_matches(content, '\\S'))"""

_LABELLED = f"""
labelled AS (SELECT d.*, d.source AS folder, {_PATH} AS path,
                    coalesce(toxic, 0) = 1 AS is_toxic, coalesce(quality, 1) = 0 AS is_low,
                    coalesce(quality, 0) = 1 AS is_high
             FROM documents d LEFT JOIN labels l USING (doc_id))"""
SNAPSHOTS = f"""{_LABELLED},
edited AS (SELECT *, CASE WHEN is_high THEN text || ' edited' ELSE text END AS body FROM labelled),
v1 AS (SELECT folder, path, text AS content, sha256(text) AS hash FROM labelled WHERE NOT is_toxic),
v2 AS (SELECT folder, path, body AS content, sha256(body) AS hash FROM edited WHERE NOT is_low),
v3 AS (SELECT folder, path, content, sha256(content) AS hash FROM (
         SELECT folder, CASE WHEN lang = 'de' THEN 'moved/' || path ELSE path END AS path,
                CASE WHEN lang = 'fr' THEN split_part(body, chr(10), 1) ELSE body END AS content
         FROM edited WHERE NOT is_low))"""


def _kept(state: str) -> str:
    """What the index keeps of one of the three states."""
    return f"SELECT * FROM {state} WHERE regexp_matches(content, '\\S')"


def line_chunks(source: str) -> str:
    return f"""
parted AS (SELECT *, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS parts
           FROM {source}),
lined AS (SELECT *, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS ls FROM parted),
placed AS (SELECT *, unnest(CASE WHEN len(ls) = 0 THEN []::BIGINT[] WHEN len(ls) <= 50 THEN [0]::BIGINT[]
                                 ELSE range(0, ceil((len(ls) - 50) / 40.0)::BIGINT * 40 + 1, 40) END) AS s
           FROM lined),
windows AS (SELECT *, array_to_string(ls[s + 1 : s + 50], chr(10)) AS text FROM placed),
chunks AS (SELECT * EXCLUDE (parts, ls, content),
                  row_number() OVER (PARTITION BY folder, path ORDER BY s) - 1 AS chunk_index
           FROM windows WHERE regexp_matches(text, '\\S'))"""


def _uuid5(namespace: str, name: str) -> str:
    digest = f"sha1(from_hex('{namespace}') || encode({name}))"
    return f"""(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' ||
                translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32]
                FROM (SELECT {digest} AS h))"""


_CHUNK_ID = _uuid5(
    "6ba7b8109dad11d180b400c04fd430c8", "folder || '/' || path || ':' || chunk_index"
)
_HASH_ID = _uuid5("6ba7b8129dad11d180b400c04fd430c8", "path") + " || '#' || chunk_index"

# -- vector search ---------------------------------------------------------------

VECTORS = """
chunks AS (SELECT 'set_' || label AS folder, 'file_' || (vec_id // 5) AS path,
                  printf('%012d', vec_id) AS chunk_id, vec_id % 5 AS chunk_index,
                  embedding::DOUBLE[] AS v FROM embeddings),
entries AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
            FROM embeddings),
means AS (SELECT label, i, avg(x) AS m FROM entries GROUP BY label, i),
queries AS (SELECT label::BIGINT AS query_id, list(m ORDER BY i) AS q FROM means GROUP BY label)"""
_COS = "list_inner_product(v, q) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q)))"
_L2SIM = f"1 / (1 + (2 - 2 * {_COS}))"


def _vector_top(score: str = _COS, match: str = "true", cutoff: str = "0.3") -> str:
    return f"""{VECTORS},
scored AS (SELECT query_id, folder, path, chunk_id, chunk_index, round({score}, 9) AS score,
                  {cutoff} AS cutoff FROM chunks, queries WHERE {match}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
           FROM scored),
top AS (SELECT * FROM ranked WHERE rank <= 100 AND score >= cutoff)"""


#: The labels' means as cells: each vector in the nearest, each query into three.
_CELLED = f"""{VECTORS},
cells AS (SELECT query_id AS cell, q AS c, list_inner_product(q, q) AS cc FROM queries),
away AS (SELECT chunk_id, cell, cc - 2 * list_inner_product(v, c) / sqrt(list_inner_product(v, v)) AS d
         FROM chunks, cells),
housed AS (SELECT chunk_id, arg_min(cell, d) AS cell FROM away GROUP BY chunk_id),
near AS (SELECT query_id, cell, row_number() OVER (PARTITION BY query_id ORDER BY
           cc - 2 * list_inner_product(q, c) / sqrt(list_inner_product(q, q)), cell) AS n FROM queries, cells)"""
_IN_PROBED_CELL = """(query_id, chunk_id) IN (SELECT (query_id, chunk_id) FROM housed JOIN near USING (cell)
                      WHERE n <= 3)"""

_BEST = """
best AS (SELECT query_id, path, max(score) AS exact FROM top GROUP BY query_id, path),
ordered AS (SELECT query_id, path, floor(exact * 1e6 + 0.5) / 1e6 AS score,
                   row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, path) AS rank
            FROM best)"""
_VECTOR_FILES = f"WITH {_vector_top()}, {_BEST} SELECT * FROM ordered"


def _listed(body: str) -> str:
    return f"WITH {_vector_top()}, {_BEST} SELECT query_id, {body} FROM queries LEFT JOIN ordered USING (query_id) GROUP BY query_id"


# -- text search -----------------------------------------------------------------


def _embedded(chunks: str, key: str, out: str) -> str:
    """Unit float vectors as (key, bucket, x) plus their double length."""
    bucket = f"('0x' || md5(word)[1:8])::BIGINT % {EMBEDDING_DIM}"
    return f"""
{out}_words AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word
                FROM {chunks}),
{out}_counts AS (SELECT {key}, {bucket} AS bucket, count(*) AS n FROM {out}_words GROUP BY ALL),
{out}_norms AS (SELECT {key}, sqrt(sum(n * n)) AS norm FROM {out}_counts GROUP BY ALL),
{out} AS (SELECT {key}, bucket, (n / norm)::FLOAT::DOUBLE AS x
          FROM {out}_counts JOIN {out}_norms USING ({key})),
{out}_lengths AS (SELECT {key}, sqrt(sum(x * x)) AS length FROM {out} GROUP BY ALL)"""


def token_chunks(source: str, size: int = 64) -> str:
    return f"""
cut AS (SELECT *, regexp_extract_all(content, '\\s*[^\\s]+|\\s+') AS tokens FROM {source}),
placed AS (SELECT *, unnest(range(0, len(tokens), {size})) AS s FROM cut WHERE len(tokens) <= 200000),
windows AS (SELECT *, array_to_string(tokens[s + 1 : s + {size}], '') AS text FROM placed),
chunks AS (SELECT * EXCLUDE (tokens, content),
                  row_number() OVER (PARTITION BY folder, path ORDER BY s) - 1 AS chunk_index
           FROM windows WHERE regexp_matches(text, '\\S'))"""


def _text_top(
    files: str, requests: str, indexed: str = INDEXED, chunked: str = line_chunks("indexed")
) -> str:
    return f"""{files}, {indexed}, {chunked},
known AS (SELECT *, {_CHUNK_ID} AS chunk_id FROM chunks),
requests AS ({requests}),
{_embedded("known", "chunk_id", "cv")}, {_embedded("requests", "query_id", "qv")},
dots AS (SELECT query_id, chunk_id, sum(cv.x * qv.x) AS dot FROM cv JOIN qv USING (bucket) GROUP BY ALL),
scored AS (SELECT d.query_id, k.folder, k.path, d.chunk_id, k.text,
                  round(dot / (cl.length * ql.length), 9) AS score, r.cutoff
           FROM dots d JOIN cv_lengths cl USING (chunk_id) JOIN qv_lengths ql USING (query_id)
           JOIN known k USING (chunk_id) JOIN requests r USING (query_id)
           WHERE r.folder = k.folder),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
           FROM scored),
top AS (SELECT * FROM ranked WHERE rank <= 100 AND score >= cutoff)"""


_REQUESTS = "SELECT item_id AS query_id, text, 'corpus' AS folder, 0.3 AS cutoff FROM benchmark"
_FOLDER_REQUESTS = """SELECT item_id AS query_id, text, 'src' || item_id % 20 AS folder,
                      CASE WHEN item_id % 2 = 1 THEN 0.5 ELSE 0.3 END AS cutoff FROM benchmark"""
_TURNS = """SELECT conv_id * 1000 + turn AS query_id, text, 'corpus' AS folder,
            CASE WHEN turn > 0 THEN 0.5 ELSE 0.3 END AS cutoff
            FROM conversations WHERE role NOT IN ('assistant', 'system')"""
_FIRST_TEXT = """SELECT 0::BIGINT AS query_id, arg_min(text, doc_id) AS text, 'corpus' AS folder,
                 0.7 AS cutoff FROM documents"""
_ANSWERS = f"""WITH {_text_top(CORPUS, _REQUESTS)}, {_BEST}
SELECT query_id,
  '{{"files_by_relevance":[' || coalesce(string_agg('[' || score || ',' || to_json(path) || ']', ','
      ORDER BY rank), '') || ']}}' AS pairs,
  '{{"query":' || to_json(any_value(text)) || ',"cutoff":0.3,"files_by_relevance":[' ||
      coalesce(string_agg('{{"file":' || to_json(path) || ',"relevance":' || score || '}}', ','
      ORDER BY rank), '') || ']}}' AS answer
FROM requests LEFT JOIN ordered USING (query_id) GROUP BY query_id"""

_CHUNK_ROWS = f"SELECT folder, path, hash, chunk_index, {_CHUNK_ID} AS chunk_id, text FROM chunks"
_AFTER_THREE = f"WITH {SNAPSHOTS}, kept AS ({_kept('v3')}), {line_chunks('kept')} {_CHUNK_ROWS}"


def _diff(old: str, new: str) -> str:
    return f"""{SNAPSHOTS},
diffed AS (SELECT coalesce(a.folder, b.folder) AS folder, coalesce(a.path, b.path) AS path,
                  CASE WHEN a.hash IS NULL THEN 'added' WHEN b.hash IS NULL THEN 'deleted'
                       WHEN a.hash <> b.hash THEN 'modified' ELSE 'same' END AS status,
                  a.hash AS old_hash, b.hash AS new_hash
           FROM {old} a FULL JOIN {new} b ON a.folder = b.folder AND a.path = b.path)"""


_COUNT = r"len(regexp_extract_all(content, '\s*[^\s]+|\s+'))"
_SHARD = "('0x' || md5(folder || '/' || path)[1:8])::BIGINT % greatest(1, ceil((SELECT count(*) FROM files) / {n}))::BIGINT"
_PACKED = f"""WITH RECURSIVE {FILES},
counted AS (SELECT folder, path, {_COUNT} AS n_tokens, ceil({_COUNT} / 8192.0)::BIGINT AS n_chunks,
                   {_SHARD.format(n="256.0")} AS shard FROM files),
docs AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY path, folder) AS rn
         FROM counted WHERE n_tokens <= 200000),
walk AS (
  SELECT *, n_tokens AS t, n_chunks AS c, 0::BIGINT AS request_no FROM docs WHERE rn = 1
  UNION ALL
  SELECT d.*, CASE WHEN w.c + d.n_chunks > 24 OR w.t + d.n_tokens > 200000 THEN d.n_tokens
                   ELSE w.t + d.n_tokens END,
         CASE WHEN w.c + d.n_chunks > 24 OR w.t + d.n_tokens > 200000 THEN d.n_chunks
              ELSE w.c + d.n_chunks END,
         CASE WHEN w.c + d.n_chunks > 24 OR w.t + d.n_tokens > 200000 THEN w.request_no + 1
              ELSE w.request_no END
  FROM walk w JOIN docs d ON d.shard = w.shard AND d.rn = w.rn + 1)"""

_TURN_CHECK = """SELECT conv_id * 1000 + turn AS query_id,
  CASE WHEN role <> 'assistant' THEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) END AS query,
  CASE WHEN role <> 'system' THEN 'corpus' END AS folder,
  CASE WHEN turn > 0 THEN 0.5 ELSE 0.3 END::DOUBLE AS cutoff,
  CASE WHEN role = 'assistant' THEN 'missing query' WHEN role = 'system' THEN 'missing folder'
       WHEN NOT regexp_matches(text, '\\S') THEN 'blank query' END AS reason
  FROM conversations"""

ORACLES: dict[str, str] = {
    "search_cosine": _VECTOR_FILES,
    "search_l2sim": f"WITH {_vector_top(_L2SIM)}, {_BEST} SELECT * FROM ordered",
    "search_top_chunks": f"""WITH {_vector_top()}
        SELECT query_id, path, floor(score * 1e6 + 0.5) / 1e6 AS score, rank, chunk_id, chunk_index FROM top""",
    "search_many_requests": f"""WITH chunks AS (
            SELECT 'set_' || label AS folder, 'file_' || (vec_id // 5) AS path,
                lpad(vec_id::VARCHAR, 12, '0') AS chunk_id, embedding::DOUBLE[] AS v FROM embeddings),
        queries AS (
            SELECT vec_id * 12 + step AS query_id, (step * 5 + 10) / 100::DOUBLE AS cutoff,
                CASE WHEN step % 2 = 1 THEN 'set_' || label END AS only_in, vec_id, embedding::DOUBLE[] AS q
            FROM embeddings, unnest(range(12)) AS steps(step)),
        pairs AS (SELECT a.vec_id, c.*, round(list_inner_product(v, q) /
                (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(q, q))), 9) AS score
            FROM chunks c, (SELECT vec_id, q FROM queries WHERE query_id % 12 = 0) a),
        ranked AS (SELECT query_id, cutoff, folder, path, chunk_id, score, row_number() OVER
                (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
            FROM queries JOIN pairs USING (vec_id) WHERE only_in IS NULL OR folder = only_in)
        SELECT query_id, path, floor(score * 1e6 + 0.5) / 1e6 AS score, rank, folder, chunk_id
        FROM ranked WHERE rank <= 100 AND score >= cutoff""",
    "search_batch_per_query_cutoff": f"""WITH {_vector_top(
            match="folder = 'set_' || query_id",
            cutoff="CASE WHEN query_id % 2 = 1 THEN 0.8 ELSE 0.3 END")}, {_BEST}
        SELECT *, 'set_' || query_id AS folder FROM ordered""",
    "search_json": _listed(
        """'{"files_by_relevance":[' || coalesce(string_agg('[' || score || ',' || to_json(path) || ']',
        ',' ORDER BY rank), '') || ']}' AS json"""
    ),
    "search_json_object": _listed(
        """'{"query":"label ' || query_id || '","cutoff":0.3,"files_by_relevance":[' ||
        coalesce(string_agg('{"file":' || to_json(path) || ',"relevance":' || score || '}', ','
        ORDER BY rank), '') || ']}' AS json"""
    ),
    "render_prompt": _listed(
        """'The relevant data may be in these files:' || chr(10) ||
        coalesce(string_agg('- ' || path, chr(10) ORDER BY rank), '') AS text"""
    ),
    "render_add": _listed("coalesce(string_agg('/add ' || path, chr(10) ORDER BY rank), '') AS text"),
    "ann_search_all_cells": _VECTOR_FILES,
    "ann_search_given_cells": f"""WITH {_vector_top(match=_IN_PROBED_CELL).replace(VECTORS, _CELLED)}, {_BEST}
        SELECT * FROM ordered""",
    "ann_bounded": _VECTOR_FILES,
    "ann_recall": f"""WITH {_vector_top().replace(VECTORS, _CELLED)},
        hits AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER
                (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM scored WHERE {_IN_PROBED_CELL})
            WHERE n <= 100 AND score >= cutoff)
        SELECT query_id, round(avg((hits.chunk_id IS NOT NULL)::INTEGER), 6) AS recall
        FROM top LEFT JOIN hits USING (query_id, chunk_id) GROUP BY query_id""",
    "search_floors": _VECTOR_FILES,
    "vector_norms": """SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[],
        embedding::DOUBLE[])), 6) AS norm FROM embeddings""",
    "normalize_vectors": """WITH lengths AS (SELECT vec_id, embedding::DOUBLE[] AS v,
            sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
        SELECT vec_id, generate_subscripts(v, 1) - 1 AS pos,
               round((unnest(v) / n)::FLOAT::DOUBLE, 6) AS value FROM lengths""",
    "distance_to_mean": f"""WITH {VECTORS},
        sides AS (SELECT vec_id, embedding::DOUBLE[] AS v, q FROM embeddings JOIN queries ON query_id = label),
        measured AS (SELECT vec_id, list_inner_product(v, q) AS dot,
            list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM sides)
        SELECT vec_id, round(dot, 6) AS dot, round(d, 6) AS distance,
               round(1 / (1 + d), 6) AS similarity FROM measured""",
    "filter_paths": f"WITH {CORPUS} SELECT path, size FROM files WHERE path = 'src1' OR starts_with(path, 'src1/')",
    "filter_extension": f"WITH {MIXED_FILES} SELECT folder, path FROM files WHERE split_part(path, '.', 2) IN ({_NAMES})",
    "path_parts": f"""WITH {FILES} SELECT path, split_part(path, '/', 2) AS base_name,
        split_part(path, '.', 2) AS extension FROM files""",
    "filter_size": "SELECT page_id, strlen(html)::BIGINT AS size FROM pages WHERE strlen(html) <= 1000",
    "filter_blank": r"""SELECT doc_id, n_chars FROM documents
        WHERE lang <> 'fr' AND regexp_matches(text, '\S')""",
    "filter_utf8": """SELECT source AS folder, doc_id::VARCHAR AS path, strlen(text)::BIGINT AS size,
        md5(text) AS content_md5 FROM documents WHERE lang <> 'fr'""",
    "rejected_files": f"""WITH {MIXED_FILES},
        sized AS (SELECT *, size + (lang = 'fr')::BIGINT AS bytes FROM files),
        judged AS (SELECT folder, path, bytes AS size,
            CASE WHEN split_part(path, '.', 2) NOT IN ({_NAMES}) THEN 'name' WHEN bytes > 20000 THEN 'size'
                 WHEN lang = 'fr' THEN 'encoding' WHEN NOT regexp_matches(content, '\\S') THEN 'blank'
                 WHEN {_COUNT} > 1000 THEN 'tokens' END AS reason FROM sized)
        SELECT * FROM judged WHERE reason IS NOT NULL""",
    "scan_pages": """SELECT 'pages' AS folder, strlen(html)::BIGINT + 1 AS size,
        md5(html || chr(10)) AS content_md5 FROM pages""",
    "relative_path": f"""WITH {FILES} SELECT folder || '/' || path AS absolute, path AS in_folder,
        CASE WHEN folder = 'src1' AND lang = 'en' THEN path[4:] END AS in_src1_en FROM files""",
    "normalize_paths": """WITH raw AS (SELECT page_id,
            string_split('/srv/' || regexp_replace(url, '^https?:/', '') || '/../x/./' || page_id, '/') AS parts
            FROM pages)
        SELECT page_id, list_reduce(list_prepend('', parts), lambda done, part:
            CASE WHEN part IN ('', '.') THEN done
                 WHEN part = '..' THEN regexp_replace(done, '/[^/]*$', '')
                 ELSE done || '/' || part END) AS path FROM raw""",
    "file_hash": f"WITH {FILES} SELECT folder, path, sha256(content) AS hash FROM files",
    "folder_key": """SELECT source AS folder, count(*) AS files, 'idx-' || sha256(source)[1:16] AS key
        FROM documents GROUP BY source""",
    "ignore_filter": rf"""WITH {MIXED_CORPUS} SELECT path, size FROM files
        WHERE NOT (starts_with(path, 'src1/') OR starts_with(path, 'src2/en/')
            OR path LIKE '%.bin' OR path LIKE '%.log'
            OR regexp_matches(path, '^src3/(.*/)?doc_[^/]*5\.md$')
            OR (regexp_matches(path, '/doc_[0-3][^/]\.py$') AND NOT regexp_matches(path, '/doc_1[^/]\.py$')))""",
    "ignore_defaults": f"""WITH {MIXED_FILES} SELECT folder, 'lib/' || path AS path FROM files
        WHERE lang <> 'fr' AND path NOT LIKE '%.log'""",
    "ignore_by_folder": rf"""WITH {MIXED_FILES} SELECT folder, path FROM files
        WHERE path NOT LIKE '%.log' AND CASE WHEN folder LIKE '%1'
            THEN NOT (lang = 'fr' OR (path LIKE '%.py' AND NOT regexp_matches(path, '/doc_1[^/]*\.py$')))
            ELSE NOT regexp_matches(path, '^en/doc_[^/]\.md$') END""",
    "chunk_lines": f"WITH {FILES}, {line_chunks('files')} SELECT folder, path, chunk_index, text FROM chunks",
    "line_counts": r"""SELECT page_id, CASE WHEN html = '' THEN 0 ELSE
        len(string_split(html, chr(10))) - (CASE WHEN html LIKE '%' || chr(10) THEN 1 ELSE 0 END) END::BIGINT
        AS lines FROM pages""",
    "chunk_tokens": rf"""WITH {FILES},
        cut AS (SELECT folder, path, regexp_extract_all(content, '\s*[^\s]+|\s+') AS tokens FROM files),
        placed AS (SELECT folder, path, tokens, unnest(range(0, len(tokens), 64)) AS s FROM cut),
        windows AS (SELECT folder, path, s, array_to_string(tokens[s + 1 : s + 64], '') AS text FROM placed)
        SELECT folder, path, row_number() OVER (PARTITION BY folder, path ORDER BY s) - 1 AS chunk_index, text
        FROM windows WHERE regexp_matches(text, '\S')""",
    "token_counts": f"WITH {FILES} SELECT folder, path, {_COUNT} AS n_tokens FROM files",
    "token_ceiling": f"""WITH {FILES} SELECT folder, path, {_COUNT} AS n_tokens,
        'more than 1000 tokens' AS reason FROM files WHERE {_COUNT} > 1000""",
    "chunk_estimate": f"WITH {FILES} SELECT folder, path, ceil({_COUNT} / 8192.0)::BIGINT AS n_chunks FROM files",
    "pack_batches": _PACKED + " SELECT shard, folder, path, n_tokens, n_chunks, request_no FROM walk",
    "pack_batches_global": _PACKED.replace(_SHARD.format(n="256.0"), "0")
    + " SELECT folder, path, n_tokens, n_chunks, request_no FROM walk",
    "batch_sums": _PACKED + """ SELECT shard, request_no, sum(n_tokens)::BIGINT AS tokens,
        sum(n_chunks)::BIGINT AS chunks, count(*) AS documents FROM walk GROUP BY shard, request_no""",
    "fixed_batches": f"""WITH {FILES}, sharded AS (SELECT folder, path, {_SHARD.format(n="512.0")} AS shard FROM files)
        SELECT folder, path, shard,
            (row_number() OVER (PARTITION BY shard ORDER BY path, folder) - 1) // 100 AS batch_no FROM sharded""",
    "chunk_id_uuid5": f"WITH {FILES}, {line_chunks('files')} SELECT folder, path, {_CHUNK_ID} AS chunk_id FROM chunks",
    "chunk_id_uuid5_hash": f"WITH {FILES}, {line_chunks('files')} SELECT folder, path, {_HASH_ID} AS chunk_id FROM chunks",
    "hashed_embedding_sparse": f"WITH {_embedded('documents', 'doc_id', 'e')} SELECT doc_id, bucket, n FROM e_counts",
    "chunk_custom_tokens": f"""WITH {FILES},
        placed AS (SELECT folder, path, content, unnest(range(0, length(content), 500)) AS s FROM files
                   WHERE length(content) <= 200000),
        windows AS (SELECT folder, path, s, substring(content, s + 1, 500) AS text FROM placed)
        SELECT folder, path, row_number() OVER (PARTITION BY folder, path ORDER BY s) - 1 AS chunk_index, text
        FROM windows WHERE regexp_matches(text, '\\S')""",
    "embed_custom": """WITH counted AS (SELECT doc_id, unnest([0, 1, 2, 3]) AS pos, unnest(['a', 'e', 'i', 'o']) AS c,
            text FROM documents),
        numbers AS (SELECT doc_id, pos::BIGINT AS pos, length(text) - length(replace(text, c, '')) AS n FROM counted),
        lengths AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM numbers GROUP BY doc_id)
        SELECT doc_id, pos, round((CASE WHEN norm = 0 THEN 0 ELSE n / norm END)::FLOAT::DOUBLE, 5) AS value
        FROM numbers JOIN lengths USING (doc_id)""",
    "snapshot_diff": f"WITH {_diff('v1', 'v2')} SELECT * FROM diffed",
    "diff_stats": f"""WITH {_diff('v1', 'v2')} SELECT count(*) AS files,
        count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'modified') AS modified,
        count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (status = 'same') AS same FROM diffed""",
    "delete_paths": f"""WITH {_diff('v1', 'v2')} SELECT folder, path FROM diffed
        WHERE status IN ('deleted', 'modified')""",
    "surviving_files": f"""WITH {_diff('v1', 'v2')} SELECT folder, path, old_hash AS hash FROM diffed
        WHERE status = 'same'""",
    "rename_pairs": f"""WITH {_diff('v2', 'v3')},
        gone AS (SELECT folder, old_hash AS hash, path AS old_path, row_number() OVER
            (PARTITION BY folder, old_hash ORDER BY md5(path), path) AS place FROM diffed WHERE status = 'deleted'),
        come AS (SELECT folder, new_hash AS hash, path AS new_path, row_number() OVER
            (PARTITION BY folder, new_hash ORDER BY md5(path), path) AS place FROM diffed WHERE status = 'added')
        SELECT folder, hash, old_path, new_path FROM gone JOIN come USING (folder, hash, place)""",
    "unique_files": f"""WITH {FILES} SELECT folder, path, sha256(content) AS hash, 2::BIGINT AS copies,
        0::BIGINT AS conflict FROM files""",
    "index_rejects": f"""WITH {MIXED_FILES},
        given AS (SELECT folder, path, size, content, 1::BIGINT AS version FROM files WHERE size <= 20000
            UNION ALL SELECT folder, path, size, CASE WHEN lang = 'fr' THEN '' ELSE content END, 2 FROM files),
        judged AS (SELECT folder, path, size, version,
            CASE WHEN split_part(path, '.', 2) NOT IN ({_NAMES}) THEN 'name' WHEN size > 20000 THEN 'size'
                 WHEN NOT regexp_matches(content, '\\S') THEN 'blank' END AS reason FROM given)
        SELECT * FROM judged WHERE reason IS NOT NULL""",
    "live_after_build": f"WITH {SNAPSHOTS}, kept AS ({_kept('v1')}), {line_chunks('kept')} {_CHUNK_ROWS}",
    "live_after_refresh": _AFTER_THREE,
    "compacted_index": _AFTER_THREE,
    "stream_refresh": _AFTER_THREE,
    "stream_refresh_keyed": _AFTER_THREE,
    "stream_out_of_order": _AFTER_THREE,
    "live_after_reuse": _AFTER_THREE,
    "embedded_chunks": f"""WITH {SNAPSHOTS},
        kept AS (SELECT 1 AS version, folder, path, hash, content FROM ({_kept('v1')})
            UNION ALL SELECT 2, folder, path, hash, content FROM ({_kept('v2')})
            UNION ALL SELECT 3, folder, path, hash, content FROM ({_kept('v3')})),
        {line_chunks("kept")},
        files AS (SELECT DISTINCT version, folder, path, hash FROM kept),
        steps AS (SELECT coalesce(n.version, o.version + 1) AS version, coalesce(n.folder, o.folder) AS folder,
                coalesce(n.path, o.path) AS path, o.hash AS old_hash, n.hash AS new_hash
            FROM files n FULL JOIN files o
            ON n.folder = o.folder AND n.path = o.path AND n.version = o.version + 1),
        changed AS (SELECT * FROM steps WHERE version <= 3 AND old_hash IS DISTINCT FROM new_hash),
        known AS (SELECT DISTINCT g.version, text FROM changed g JOIN chunks c
            ON c.version = g.version - 1 AND c.folder = g.folder AND c.path = g.path),
        written AS (SELECT c.version, text FROM changed g JOIN chunks c
            ON c.version = g.version AND c.folder = g.folder AND c.path = g.path)
        SELECT version::BIGINT AS version, count(*) AS embedded
        FROM written w WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.version = w.version AND k.text = w.text)
        GROUP BY version""",
    "live_files": f"WITH {SNAPSHOTS} SELECT folder, path, hash FROM ({_kept('v3')})",
    "index_inspection": f"""WITH {SNAPSHOTS}, kept AS ({_kept('v3')}), {line_chunks('kept')},
        counted AS (SELECT folder, count(*) AS chunks FROM chunks GROUP BY folder)
        SELECT folder, count(*) AS files, any_value(chunks) AS chunks, 0::BIGINT AS files_without_chunks,
               0::BIGINT AS orphan_chunks, 0::BIGINT AS wrong_dim
        FROM kept JOIN counted USING (folder) GROUP BY folder""",
    "run_stats": f"""WITH {SNAPSHOTS}, k1 AS ({_kept('v1')}), k2 AS ({_kept('v2')}), k3 AS ({_kept('v3')}),
        steps AS (
            SELECT 2 AS version, a.hash AS o, b.hash AS n FROM k1 a FULL JOIN k2 b USING (folder, path)
            UNION ALL
            SELECT 3, a.hash, b.hash FROM k2 a FULL JOIN k3 b USING (folder, path)
            UNION ALL SELECT 1, NULL, hash FROM k1)
        SELECT version::BIGINT AS version, count(*) FILTER (o IS NULL) AS added,
               count(*) FILTER (o <> n) AS modified, count(*) FILTER (n IS NULL) AS deleted
        FROM steps GROUP BY version""",
    "text_search": f"WITH {_text_top(CORPUS, _REQUESTS)}, {_BEST} SELECT * FROM ordered",
    "text_search_by_folder": f"""WITH {_text_top(FILES, _FOLDER_REQUESTS)}, {_BEST}
        SELECT ordered.*, folder FROM ordered JOIN requests USING (query_id)""",
    "ann_text_search_after_refresh": f"""WITH {_text_top(
            SNAPSHOTS, _FOLDER_REQUESTS, f"indexed AS ({_kept('v3')})")}, {_BEST}
        SELECT ordered.*, folder FROM ordered JOIN requests USING (query_id)""",
    "text_search_not_ignored": f"""WITH {_text_top(CORPUS, _REQUESTS).replace("top AS (", "found AS (")},
        top AS (SELECT * FROM found WHERE NOT (starts_with(path, 'src1/') OR path LIKE '%/de/%')), {_BEST}
        SELECT * FROM ordered""",
    "text_search_by_folder_rules": rf"""WITH {_text_top(FILES, _FOLDER_REQUESTS).replace("top AS (", "found AS (")},
        top AS (SELECT * FROM found WHERE CASE WHEN folder LIKE '%1'
            THEN NOT (starts_with(path, 'fr/') OR (path LIKE '%.py' AND NOT regexp_matches(path, '/doc_1[^/]*\.py$')))
            ELSE NOT regexp_matches(path, '^en/doc_[^/]\.md$') END), {_BEST}
        SELECT ordered.*, folder FROM ordered JOIN requests USING (query_id)""",
    "text_search_tokens": f"""WITH {_text_top(CORPUS, _REQUESTS, chunked=token_chunks("indexed"))}, {_BEST}
        SELECT * FROM ordered""",
    "text_search_l2sim": f"""WITH {_text_top(CORPUS, _REQUESTS.replace("0.3", "0.4")).replace(
            "round(dot / (cl.length * ql.length), 9)",
            "round(1 / (1 + (2 - 2 * dot / (cl.length * ql.length))), 9)")}, {_BEST}
        SELECT * FROM ordered""",
    "text_search_default_cutoff": f"""WITH {_text_top(CORPUS, _FIRST_TEXT)}, {_BEST} SELECT * FROM ordered""",
    "search_user_turns": f"WITH {_text_top(CORPUS, _TURNS)}, {_BEST} SELECT * FROM ordered",
    "best_snippet": f"""WITH {_text_top(CORPUS, _REQUESTS)}, {_BEST},
        texts AS (SELECT query_id, path, arg_min(text, rank) AS content FROM top GROUP BY query_id, path)
        SELECT * FROM ordered JOIN texts USING (query_id, path)""",
    "answers_json": _ANSWERS,
    "stream_answers": _ANSWERS,
    "request_checks": _TURN_CHECK,
    "request_defaults": f"SELECT query_id, folder, cutoff FROM ({_TURN_CHECK}) WHERE reason IS NULL",
}
