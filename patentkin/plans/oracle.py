"""The same results in plain SQL, for a check by another engine (DuckDB) on the same tables."""

from __future__ import annotations

from patentkin.functions.names import LEGAL_FORMS
from patentkin.plans.catalog import PAGE_ROWS, SHARD_BYTES
from patentkin.sources.samples import VIEWS

# Pieces that later ones use several times and that are dear.
SHARED: set[str] = set()
# Named pieces; a query lists the ones it needs and gets everything they stand on.
PIECES: dict[str, tuple[tuple[str, ...], str]] = {name: ((), text.strip()) for name, text in VIEWS.items()}


def _piece(name: str, needs: str, text: str) -> None:
    PIECES[name] = (tuple(needs.split()), text.strip())


def _with(needs: str, text: str, other_jobs: str | None = None) -> str:
    """The text behind the pieces it needs; `other_jobs` names a view that stands in for the job table."""
    order: list[str] = []
    swap = {"ip_landscapes": other_jobs or "ip_landscapes"}

    def visit(name: str) -> None:
        if name not in order:
            for other in PIECES[name][0]:
                visit(other)
            order.append(name)

    for name in needs.split():
        visit(name)
    heads = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in SHARED else ''}(\n{PIECES[swap.get(name, name)][1]}\n)" for name in order)
    return f"WITH {heads}\n{text.strip()}" if heads else text.strip()


def _text(values: str) -> str:
    return f"array_to_string([coalesce(v::VARCHAR, '-') FOR v IN {values}], '|')"


_piece("scored", "patents", """
SELECT *,
       CASE WHEN authority IS NULL THEN -1
            ELSE coalesce(nullif(list_position(['EP','WO','US','CN','JP','KR','GB','CA','TW','DE','ES','RU','AU','FR','MX','UA','NZ'],
                                               authority), 0), 999) END AS authority_strict,
       coalesce(nullif(list_position(['EP','WO','US','CN','JP','KR','GB','CA','TW','DE','ES','RU','AU','FR','MX','UA','NZ'],
                                     upper(authority)), 0), 99) AS authority_priority,
       CASE WHEN upper(authority) = 'EP' AND kind IN ('B2','B3','B1','A1','A3','A2')
                 THEN list_position(['B2','B3','B1','A1','A3','A2'], kind)
            WHEN upper(authority) = 'EP' AND kind IN ('B9','B8','A9','A8') THEN 9
            WHEN upper(authority) = 'WO' AND kind IN ('A1','A3','A2','A4') THEN list_position(['A1','A3','A2','A4'], kind)
            WHEN kind ILIKE 'B%' THEN 1 WHEN kind = 'A1' THEN 2 WHEN kind ILIKE 'A%' THEN 3 ELSE 99 END AS kind_priority,
       2 - (coalesce(trim(title), '') <> '')::INT - (coalesce(trim(abstract), '') <> '')::INT AS content_priority
FROM patents
""")
_piece("rep", "scored", """
SELECT family_id, id AS rep_id, authority AS rep_authority, kind AS rep_kind, publication_date AS rep_pub_date,
       title AS rep_title, abstract AS rep_abstract
FROM scored
QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY authority_priority, kind_priority, content_priority,
                           publication_date DESC NULLS LAST, doc_number NULLS LAST, id) = 1
""")
_piece("best", "scored", """
SELECT family_id,
       list(title ORDER BY authority_priority, kind_priority, publication_date DESC NULLS LAST, doc_number NULLS LAST, id)
           FILTER (WHERE trim(title) <> '')[1] AS best_title,
       list(abstract ORDER BY authority_priority, kind_priority, publication_date DESC NULLS LAST, doc_number NULLS LAST, id)
           FILTER (WHERE trim(abstract) <> '')[1] AS best_abstract
FROM scored WHERE family_id IS NOT NULL GROUP BY family_id
""")
_piece("grouped", "scored", """
SELECT family_id, list(id ORDER BY publication_date NULLS LAST, id) AS family_members,
       min(publication_date) FILTER (WHERE kind LIKE 'A%') AS first_application_pub_date,
       min(publication_date) FILTER (WHERE kind LIKE 'B%') AS first_grant_pub_date
FROM scored WHERE family_id IS NOT NULL GROUP BY family_id
""")
_piece("auths", "scored", """
SELECT family_id, list(authority ORDER BY authority_priority, authority) AS family_authorities
FROM (SELECT DISTINCT family_id, authority, authority_priority FROM scored WHERE authority IS NOT NULL)
GROUP BY family_id
""")
for _name, _column in (("cpc", "cpc_classes"), ("applicants", "applicants"), ("inventors", "inventors")):
    _piece(f"{_name}_of", "patents", f"""
SELECT family_id, list(e ORDER BY e NULLS LAST) AS {_name}
FROM (SELECT DISTINCT family_id, unnest({_column}) AS e FROM patents) GROUP BY family_id
""")
_piece("fam", "rep best grouped auths cpc_of applicants_of inventors_of", """
SELECT family_id, family_members, family_authorities,
       coalesce(nullif(trim(rep_title), ''), best_title) AS title,
       coalesce(nullif(trim(rep_abstract), ''), best_abstract) AS abstract,
       coalesce(cpc, []) AS cpc, coalesce(applicants, []) AS applicants, coalesce(inventors, []) AS inventors,
       first_application_pub_date, first_grant_pub_date, rep_id, rep_authority, rep_kind, rep_pub_date
FROM rep LEFT JOIN grouped USING (family_id) LEFT JOIN auths USING (family_id) LEFT JOIN best USING (family_id)
LEFT JOIN cpc_of USING (family_id) LEFT JOIN applicants_of USING (family_id) LEFT JOIN inventors_of USING (family_id)
""")
_piece("raw_codes", "patents", "SELECT DISTINCT unnest(cpc_classes) AS raw_code FROM patents")


def _expand(digits: int, source: str) -> str:
    norm = "upper(replace(raw_code, ' ', ''))"
    parts = [
        ("regexp_extract({n}, '^[A-HY]')", 1),
        ("regexp_extract({n}, '^[A-HY][0-9]{{2}}')", 2),
        ("regexp_extract({n}, '^[A-HY][0-9]{{2}}[A-Z]')", 3),
        ("regexp_extract({n}, '^([A-HY][0-9]{{2}}[A-Z][0-9]{{1,%d}})', 1) || CASE WHEN "
         "regexp_matches({n}, '^[A-HY][0-9]{{2}}[A-Z][0-9]') THEN '/00' ELSE '' END" % digits, 4),
        ("CASE WHEN contains({n}, '/') THEN {n} ELSE '' END", 5),
    ]
    selects = [f"SELECT *, {p.format(n=norm)} AS code, {r} AS hier_rank FROM {source}" for p, r in parts]
    return "SELECT * FROM (" + " UNION ALL ".join(selects) + ") WHERE code <> ''"


_piece("family_raw_codes", "fam", "SELECT family_id, unnest(cpc) AS raw_code FROM fam")
_piece("codes", "family_raw_codes cpc_titles", f"""
SELECT DISTINCT e.family_id, e.code, t.title, t.level
FROM ({_expand(3, 'family_raw_codes')}) e
JOIN (SELECT cpc_code, min(title) AS title, arg_min(level, title) AS level FROM cpc_titles GROUP BY cpc_code) t
  ON t.cpc_code = e.code
""")

_LEGAL = "|".join(sorted(LEGAL_FORMS, key=len, reverse=True))


def _normal_name(name: str) -> str:
    text = f"replace(strip_accents(lower(trim({name}))), '&', ' and ')"
    text = f"regexp_replace({text}, '\\b({_LEGAL})\\b', ' ', 'g')"
    text = f"regexp_replace({text}, '^the\\s+', '')"
    text = f"regexp_replace({text}, '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g')"
    return f"nullif(trim(regexp_replace({text}, '\\s+', ' ', 'g')), '')"


_piece("applicant_rows", "fam", f"""
SELECT family_id, raw, {_normal_name('raw')} AS applicant
FROM (SELECT family_id, unnest(applicants) AS raw FROM fam)
""")
_piece("by_family", "applicant_rows", """
SELECT applicant, family_id, list(DISTINCT raw ORDER BY raw) AS raw_variants
FROM applicant_rows WHERE applicant IS NOT NULL GROUP BY applicant, family_id
""")
_piece("ready", "fam", """
SELECT family_id::BIGINT AS family_id, title, abstract FROM fam
WHERE regexp_full_match(family_id, '[0-9]+') AND trim(title) <> '' AND trim(abstract) <> ''
""")
_piece("waiting", "ready export_embeddings", """
SELECT * FROM ready WHERE family_id NOT IN (SELECT id FROM export_embeddings)
""")
_piece("token_means", "ready", """
SELECT family_id AS id, d AS dim,
       round(avg((instr('0123456789abcdef', substr(h, 2 * d + 1, 1)) - 1) * 16
                 + instr('0123456789abcdef', substr(h, 2 * d + 2, 1)) - 1) / 127.5 - 1.0, 9) AS mean
FROM (SELECT family_id, md5(unnest(regexp_extract_all(lower(title || ' ' || abstract), '[a-z0-9]+'))) AS h FROM ready),
     range(16) AS r(d)
GROUP BY ALL
""")
_piece("pairs", "export_embeddings", """
SELECT a.id AS seed_id, b.id AS family_id,
       round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity
FROM export_embeddings a JOIN export_embeddings b ON a.id <> b.id
""")
_piece("nearest", "pairs", """
SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY similarity DESC, family_id) AS rank FROM pairs
""")
_piece("memberships", "ip_patent_lists ip_patent_list_items", """
SELECT client_uid, patent_family_id,
       string_agg(coalesce(name, '-') || '#' || coalesce(uid::VARCHAR, '-') || 'x' || times, '|'
                  ORDER BY name NULLS FIRST, uid NULLS FIRST) AS lists
FROM (SELECT i.client_uid, i.patent_family_id, l.name, l.uid, count(*) AS times
      FROM ip_patent_list_items i LEFT JOIN ip_patent_lists l ON l.uid = i.list_uid AND l.client_uid = i.client_uid
      GROUP BY ALL)
GROUP BY ALL
""")
_piece("watched", "ip_patent_sonars", """
SELECT DISTINCT client_uid, patent_family_id FROM ip_patent_sonars WHERE deactivated_at IS NULL
""")
_piece("jobs", "ip_landscapes", """
SELECT uid AS job_uid, client_uid, search_vectors, CASE WHEN json_valid(search_vectors) THEN search_vectors::JSON END AS j
FROM ip_landscapes WHERE _status = 'to_calculate'
""")
_piece("children", "jobs", """
SELECT job_uid, i AS place, json_extract(j, '$.children[' || i || ']') AS c
FROM (SELECT job_uid, j, unnest(range(json_array_length(j, '$.children')::BIGINT)) AS i FROM jobs WHERE j IS NOT NULL)
""")
_piece("child_problems", "children", """
SELECT job_uid, place,
       CASE WHEN c->>'$.node.type' NOT IN ('seed_patents', 'cpc', 'seed_docs') THEN 'node.type: wrong value'
            WHEN c->>'$.node.type' = 'seed_patents' AND json_extract(c, '$.node.seeds') IS NULL THEN 'node.seeds: missing'
            WHEN len([k FOR k IN json_keys(c, '$.node')
                      IF k NOT IN ('type', 'name', 'description', 'filters', 'k', 'seeds', 'classes', 'docs')]) > 0
                 THEN 'node.' || [k FOR k IN json_keys(c, '$.node')
                      IF k NOT IN ('type', 'name', 'description', 'filters', 'k', 'seeds', 'classes', 'docs')][1] || ': unknown field'
            WHEN len([e FOR e IN json_extract(c, '$.node.seeds.patentFamilyIds[*]') IF json_type(e) <> 'VARCHAR']) > 0
                 THEN 'node.seeds.patentFamilyIds: wrong value' END AS problem
FROM children
""")
_piece("errors", "jobs child_problems", """
SELECT job_uid,
       CASE WHEN search_vectors IS NULL THEN 'Missing ''search_vectors'' in record'
            WHEN j IS NULL THEN 'Invalid search vectors: no JSON'
            WHEN coalesce(j->>'$.v', '') <> '1' THEN 'Invalid search vectors: v: wrong value'
            WHEN coalesce(j->>'$.type', '') <> 'hybrid' THEN 'Invalid search vectors: type: wrong value'
            WHEN len([k FOR k IN json_keys(j) IF k NOT IN ('v', 'type', 'children')]) > 0
                 THEN 'Invalid search vectors: ' || [k FOR k IN json_keys(j) IF k NOT IN ('v', 'type', 'children')][1] || ': unknown field'
            WHEN problem IS NOT NULL THEN 'Invalid search vectors: ' || problem
            WHEN client_uid IS NULL THEN 'Missing ''client_uid'' in record' END AS error
FROM jobs LEFT JOIN (SELECT job_uid, arg_min(problem, place) AS problem FROM child_problems WHERE problem IS NOT NULL GROUP BY job_uid)
  USING (job_uid)
""")
_piece("valid", "errors", "SELECT job_uid FROM errors WHERE error IS NULL")
_piece("nodes", "children valid", "SELECT job_uid, c->>'$.node.type' AS type, c FROM children JOIN valid USING (job_uid)")
_piece("depths", "nodes valid", """
SELECT job_uid, coalesce(k, 200) AS k
FROM valid LEFT JOIN (SELECT job_uid, max((c->>'$.node.k')::INT) AS k FROM nodes
                      WHERE type = 'seed_patents' AND (c->>'$.node.k')::INT > 0 GROUP BY job_uid) USING (job_uid)
""")
_piece("asked_codes", "nodes", """
SELECT DISTINCT job_uid, unnest(json_extract_string(c, '$.node.classes[*].code')) AS code FROM nodes WHERE type = 'cpc'
""")
_piece("code_seeds", "asked_codes codes", "SELECT DISTINCT job_uid, family_id FROM asked_codes JOIN codes USING (code)")
_piece("listed", "nodes", """
SELECT job_uid, unnest(json_extract_string(c, '$.node.seeds.patentFamilyIds[*]')) AS id, false AS negative
FROM nodes WHERE type = 'seed_patents'
UNION ALL
SELECT job_uid, unnest(json_extract_string(c, '$.node.seeds.negativePatentFamilyIds[*]')), true
FROM nodes WHERE type = 'seed_patents'
""")
_piece("seeds", "listed code_seeds", """
SELECT job_uid, family_id FROM (
  SELECT job_uid, id::BIGINT AS family_id FROM listed WHERE NOT negative AND regexp_full_match(id, '-?[0-9]+')
  UNION
  SELECT job_uid, family_id::BIGINT FROM code_seeds WHERE regexp_full_match(family_id, '[0-9]+'))
WHERE (job_uid, family_id) NOT IN
      (SELECT (job_uid, id::BIGINT) FROM listed WHERE negative AND regexp_full_match(id, '-?[0-9]+'))
""")
_piece("final_errors", "errors valid seeds", """
SELECT job_uid, CASE WHEN error IS NOT NULL THEN error
                     WHEN job_uid NOT IN (SELECT job_uid FROM seeds) THEN 'No seed family IDs found from search vectors' END AS error
FROM errors
""")
_piece("items", "seeds depths nearest fam", """
SELECT job_uid, family_id::VARCHAR AS family_id, coalesce(title, '') AS title, is_seed
FROM (SELECT job_uid, family_id, bool_or(is_seed) AS is_seed FROM (
        SELECT job_uid, family_id, true AS is_seed FROM seeds
        UNION ALL
        SELECT s.job_uid, n.family_id, false FROM seeds s JOIN depths d USING (job_uid)
        JOIN nearest n ON n.seed_id = s.family_id AND n.rank <= d.k)
      GROUP BY ALL) i
LEFT JOIN (SELECT family_id AS id, title FROM fam) f ON f.id = i.family_id::VARCHAR
""")
_piece("label_vectors", "", "SELECT label AS grp, vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings")
_piece("edges", "label_vectors", """
SELECT a.grp, a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS distance,
       row_number() OVER (PARTITION BY a.grp, a.id ORDER BY list_distance(a.v, b.v), b.id) AS place
FROM label_vectors a JOIN label_vectors b ON a.grp = b.grp AND a.id <> b.id
QUALIFY place <= 2
""")

ORACLE: dict[str, str] = {}


def _oracle(name: str, needs: str, text: str, other_jobs: str | None = None) -> None:
    ORACLE[name] = _with(needs, text, other_jobs)


_oracle("family_scored", "scored", """
SELECT id, authority_priority, authority_strict, kind_priority, content_priority FROM scored
""")
_oracle("family_representative", "rep", """
SELECT family_id, rep_id, rep_authority, rep_kind, rep_pub_date::VARCHAR AS rep_pub_date FROM rep
""")
_oracle("family_members", "fam", f"SELECT family_id, {_text('family_members')} AS family_members FROM fam")
_oracle("family_authorities", "fam", f"SELECT family_id, {_text('family_authorities')} AS family_authorities FROM fam")
_oracle("family_dates", "rep grouped", """
SELECT family_id, first_application_pub_date::VARCHAR AS first_application_pub_date,
       first_grant_pub_date::VARCHAR AS first_grant_pub_date
FROM rep LEFT JOIN grouped USING (family_id)
""")
_oracle("family_unions", "rep cpc_of applicants_of inventors_of", f"""
SELECT family_id, {_text("coalesce(cpc, [])")} AS cpc, {_text("coalesce(applicants, [])")} AS applicants,
       {_text("coalesce(inventors, [])")} AS inventors
FROM rep LEFT JOIN cpc_of USING (family_id) LEFT JOIN applicants_of USING (family_id) LEFT JOIN inventors_of USING (family_id)
""")
_oracle("family_best_text", "rep best", """
SELECT family_id, best_title, best_abstract FROM rep LEFT JOIN best USING (family_id)
""")
_oracle("family_rollup", "fam", f"""
SELECT family_id, title, abstract, rep_id, rep_authority, rep_kind,
       {", ".join(f"{_text(c)} AS {c}" for c in ("family_members", "family_authorities", "cpc", "applicants", "inventors"))},
       first_application_pub_date::VARCHAR AS first_application_pub_date,
       first_grant_pub_date::VARCHAR AS first_grant_pub_date, rep_pub_date::VARCHAR AS rep_pub_date
FROM fam
""")
_oracle("cpc_expand", "raw_codes", _expand(3, "raw_codes"))
_oracle("cpc_expand_whole_groups", "raw_codes", _expand(4, "raw_codes"))
_oracle("cpc_index", "codes", "SELECT family_id, code, title, level FROM codes")
_oracle("family_cpc_titles", "fam codes", """
SELECT f.family_id, coalesce(c.cpc_titles, '') AS cpc_titles
FROM fam f LEFT JOIN (SELECT family_id, string_agg(code || ':' || title || ':' || level, '|' ORDER BY code) AS cpc_titles
                      FROM codes GROUP BY family_id) c USING (family_id)
""")
_oracle("cpc_exact_seeds", "code_seeds", "SELECT job_uid, family_id FROM code_seeds")
_oracle("applicant_norm", "patents", f"""
SELECT raw, {_normal_name('raw')} AS applicant FROM (SELECT DISTINCT unnest(applicants) AS raw FROM patents)
""")
_oracle("applicant_family", "by_family", f"SELECT applicant, family_id, {_text('raw_variants')} AS raw_variants FROM by_family")
_oracle("applicant_candidates", "applicant_rows", """
SELECT applicant, count(DISTINCT family_id)::INT AS family_count, string_agg(DISTINCT raw, '|' ORDER BY raw) AS variants
FROM applicant_rows WHERE applicant IS NOT NULL GROUP BY applicant
""")
_oracle("pending_families", "waiting", "SELECT family_id, title, abstract FROM waiting")
_oracle("pending_page", "waiting", f"SELECT family_id, title, abstract FROM waiting ORDER BY family_id LIMIT {PAGE_ROWS}")
_oracle("backlog", "waiting", "SELECT count(*) AS families_pending FROM waiting")
_oracle("combined_texts", "ready", """
SELECT family_id, regexp_replace(regexp_replace(title, '^\\s+', ''), '\\s+$', '') || chr(10) || chr(10)
                  || regexp_replace(regexp_replace(abstract, '^\\s+', ''), '\\s+$', '') AS combined_text
FROM ready
""")
_oracle("row_sizes", "ready", "SELECT family_id, strlen(title) + strlen(abstract) + 32 AS row_size FROM ready")
def _shards(abstract_bytes: str, target: int = SHARD_BYTES) -> str:
    """Shards one after the other: the next one starts with the row that would bring this one to the target."""
    return f"""
SELECT * FROM (
  WITH RECURSIVE summed AS (
    SELECT family_id, size, sum(size) OVER (ORDER BY family_id) AS upto, row_number() OVER (ORDER BY family_id) AS n
    FROM (SELECT family_id, strlen(title) + {abstract_bytes} + 32 AS size FROM ready)
  ), starts AS (
    SELECT 1::BIGINT AS n, 0::HUGEINT AS before, 0::BIGINT AS shard
    UNION ALL
    SELECT min(x.n), arg_min(x.upto - x.size, x.n)::HUGEINT, s.shard + 1
    FROM starts s JOIN summed x ON x.n > s.n AND x.upto - s.before >= {target}
    GROUP BY s.shard
  )
  SELECT family_id, max(shard) AS shard FROM summed x JOIN starts s ON s.n <= x.n GROUP BY family_id
)
"""


_oracle("shard_plan", "ready", _shards("strlen(abstract)"))
_oracle("shard_plan_in_ranges", "ready", _shards("strlen(abstract)", SHARD_BYTES // 16))
_oracle("shard_plan_large_rows", "ready", _shards(
    f"CASE family_id % 97 WHEN 5 THEN {SHARD_BYTES * 99 // 100} WHEN 50 THEN {2 * SHARD_BYTES} ELSE strlen(abstract) END"
))
_oracle("embedding_insert_if_absent", "export_embeddings", """
SELECT vec_id AS id, len(embedding)::INT AS dimension FROM embeddings WHERE vec_id NOT IN (SELECT id FROM export_embeddings)
""")
_oracle("parse_embedding_text", "vector_texts", """
SELECT l_orderkey, l_linenumber, text,
       CASE WHEN contains(text, 'x') THEN NULL
            ELSE array_to_string([trim(p) FOR p IN string_split(regexp_replace(text, '[\\[\\](){}]', '', 'g'), ',') IF trim(p) <> ''], '|')
       END AS numbers
FROM vector_texts
""")
_oracle("vectors_of_families", "fam export_embeddings", """
SELECT id, len(embedding)::INT AS dimension, round(embedding[1]::DOUBLE, 5) AS first_value
FROM export_embeddings WHERE id::VARCHAR IN (SELECT family_id FROM fam WHERE family_id IS NOT NULL)
""")
_oracle("mean_pool", "", """
SELECT label AS doc, d AS dim,
       round((sum(embedding[d + 1]::DOUBLE * m) / greatest(sum(m), 1e-9))::FLOAT::DOUBLE, 5) AS v
FROM (SELECT label, embedding, least(vec_id % 3, 1) AS m, unnest(range(len(embedding))) AS d FROM embeddings)
GROUP BY label, d
""")
_oracle("embed_documents", "token_means ready", """
SELECT f.family_id AS id, r.d::INT AS dim, round(coalesce(m.mean, 0)::FLOAT::DOUBLE, 5) AS v
FROM ready f JOIN range(16) AS r(d) ON true LEFT JOIN token_means m ON m.id = f.family_id AND m.dim = r.d
""")
_oracle("embedding_stream_run", "waiting", "SELECT family_id AS id, 1::BIGINT AS times FROM waiting")
_oracle("similarity_pairs", "", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity,
       round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
_oracle("knn_by_id", "nearest", "SELECT seed_id, family_id, similarity, rank FROM nearest WHERE rank <= 10")
_oracle("knn_by_id_in_cells", "nearest", "SELECT seed_id, family_id, similarity, rank FROM nearest WHERE rank <= 10")
_oracle("knn_by_vector", "export_embeddings", """
SELECT query_id, id, round(greatest(distance, 0), 6) AS distance, rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
      FROM (SELECT q.vec_id AS query_id, e.id,
                   1 - list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance
            FROM embeddings q JOIN export_embeddings e ON true))
WHERE rank <= 5
""")
_oracle("knn_enriched", "nearest fam watched memberships", f"""
SELECT n.seed_id, n.client_uid, n.family_id, n.similarity, n.rank, f.title, f.abstract,
       {_text('f.family_authorities')} AS family_authorities,
       f.first_application_pub_date::VARCHAR AS first_application_pub_date,
       w.client_uid IS NOT NULL AS sonar_is_active, m.lists
FROM (SELECT *, (seed_id % 5)::VARCHAR AS client_uid FROM nearest WHERE rank <= 10) n
LEFT JOIN fam f ON f.family_id = n.family_id::VARCHAR
LEFT JOIN watched w ON w.client_uid = n.client_uid AND w.patent_family_id = n.family_id::VARCHAR
LEFT JOIN memberships m ON m.client_uid = n.client_uid AND m.patent_family_id = n.family_id::VARCHAR
""")
_oracle("sonars_active", "watched", "SELECT client_uid, patent_family_id FROM watched")
_oracle("list_memberships", "memberships", "SELECT client_uid, patent_family_id, lists FROM memberships")
_oracle("neighbour_merge", "", """
WITH found AS (
  SELECT a.label AS job_uid, a.vec_id AS seed_id, b.vec_id AS family_id,
         round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY similarity DESC, b.vec_id) <= 5)
SELECT job_uid, family_id, max(similarity) AS similarity, string_agg(DISTINCT seed_id, '|' ORDER BY seed_id) AS source_seeds
FROM found WHERE (job_uid, family_id) NOT IN (SELECT (label, vec_id) FROM embeddings)
GROUP BY job_uid, family_id
""")
_oracle("safe_ids", "id_texts", """
SELECT event_id, text, CASE WHEN regexp_full_match(trim(text), '[+-]?[0-9]+') THEN trim(text)::BIGINT::VARCHAR END AS id FROM id_texts
""")
_oracle("jobs_to_run", "ip_landscapes", """
SELECT uid AS job_uid, client_uid, search_vectors FROM ip_landscapes WHERE _status = 'to_calculate'
""")
_oracle("job_errors", "errors", "SELECT job_uid, error FROM errors")
_oracle("job_k", "depths", "SELECT job_uid, k FROM depths")
_oracle("job_seeds", "seeds", "SELECT job_uid, family_id FROM seeds")
_oracle("job_without_seeds", "final_errors", """
SELECT job_uid, error FROM final_errors WHERE error LIKE 'No seed%'
""")
_oracle("landscape_items", "items", "SELECT job_uid, family_id, title, is_seed FROM items")
_oracle("landscape_item_owners", "items jobs", """
SELECT client_uid, count(*) AS items, count(DISTINCT job_uid) AS jobs
FROM items JOIN (SELECT job_uid, client_uid FROM jobs) USING (job_uid) GROUP BY client_uid
""")
_oracle("landscape_output", "items final_errors", """
SELECT e.job_uid AS uid, CASE WHEN error IS NULL THEN 'done' ELSE 'error' END AS status, error AS message,
       CASE WHEN error IS NULL THEN 0 END AS part, CASE WHEN error IS NULL THEN 1 END AS parts,
       d.n AS neighbor_count, d.items, CASE WHEN error IS NULL THEN true END AS same
FROM final_errors e LEFT JOIN (
  SELECT job_uid, count(*) AS n, string_agg(family_id || ':' || is_seed || ':' || title, '|' ORDER BY family_id::BIGINT) AS items
  FROM items GROUP BY job_uid) d USING (job_uid)
""")
_oracle("landscape_output_parts", "items", """
SELECT job_uid, ((n - 1) // 50)::INT AS part, ceil(total / 50)::INT AS parts, total AS neighbor_count, ((n - 1) % 50)::INT AS place,
       family_id, family_id::DOUBLE / 8 AS x, length(title)::DOUBLE AS y
FROM (SELECT *, row_number() OVER (PARTITION BY job_uid ORDER BY family_id::BIGINT) AS n, count(*) OVER (PARTITION BY job_uid) AS total
      FROM items)
""")
_oracle("landscape_sizes", "items", """
SELECT job_uid, count(*) AS neighbor_count, count(*)::INT AS items, min(family_id::BIGINT)::VARCHAR AS first_family_id, 1 AS v
FROM items GROUP BY job_uid
""")
_oracle("landscape_status", "final_errors", """
SELECT job_uid AS uid, CASE WHEN error IS NULL THEN 6 WHEN error LIKE 'No seed%' THEN 2 ELSE 1 END::BIGINT AS steps,
       CASE WHEN error IS NULL THEN 'done' ELSE 'error' END AS status
FROM final_errors
""")
_oracle("layout_graph", "edges", """
SELECT grp AS "group", src, dst, round(sum(w) - CASE WHEN count(*) > 1 THEN min(w) * max(w) ELSE 0 END, 6) AS weight
FROM (SELECT grp, src, dst, w FROM weighted UNION ALL SELECT grp, dst, src, w FROM weighted)
GROUP BY ALL
""".replace("weighted", """(
  SELECT *, CASE WHEN distance > min(CASE WHEN distance > 0 THEN distance END) OVER (PARTITION BY grp, src)
                 THEN log2(3) - 1 ELSE 1 END AS w FROM edges)"""))
# Principal axes by squaring the covariance until only the largest axis is left, then once more without it.
SQUARINGS = 14
SHARED.add("centred")
_piece("centred", "label_vectors", """
SELECT grp, id, i, v[i] - avg(v[i]) OVER (PARTITION BY grp, i) AS e FROM label_vectors, unnest(range(1, len(v) + 1)) AS r(i)
""")
_piece("scatter", "centred", """
SELECT a.grp, a.i, b.i AS j, sum(a.e * b.e) AS m FROM centred a JOIN centred b ON a.grp = b.grp AND a.id = b.id GROUP BY ALL
""")


def _axis(name: str, matrix: str) -> None:
    """Piece `name` (grp, i, a, strength): the first axis of a matrix piece, its largest entry positive."""
    power = matrix
    for k in range(SQUARINGS):
        _piece(f"{name}_{k}", power, f"""
SELECT a.grp, a.i, b.j, sum(a.m * b.m) AS m
FROM (SELECT s.grp, i, j, m / nullif(t, 0) AS m
      FROM {power} s JOIN (SELECT grp, sum(m) AS t FROM {power} WHERE i = j GROUP BY grp) USING (grp)) a
JOIN (SELECT s.grp, i, j, m / nullif(t, 0) AS m
      FROM {power} s JOIN (SELECT grp, sum(m) AS t FROM {power} WHERE i = j GROUP BY grp) USING (grp)) b
  ON a.grp = b.grp AND a.j = b.i
GROUP BY ALL
""")
        power = f"{name}_{k}"
        SHARED.add(power)
    SHARED.update((name, matrix))
    _piece(f"{name}_column", power, f"""
SELECT s.grp, s.i, s.m FROM {power} s JOIN (SELECT grp, arg_max(i, m) AS top FROM {power} WHERE i = j GROUP BY grp) p
  ON s.grp = p.grp AND s.j = p.top
""")
    _piece(f"{name}_unit", f"{name}_column", f"""
SELECT grp, i, m / sqrt(sum(m * m) OVER (PARTITION BY grp)) * sign(arg_max(m, abs(m)) OVER (PARTITION BY grp)) AS a FROM {name}_column
""")
    _piece(name, f"{name}_unit scatter", f"""
SELECT u.grp, u.i, u.a, s.strength
FROM {name}_unit u JOIN (SELECT x.grp, sum(x.a * c.m * y.a) AS strength FROM {name}_unit x JOIN scatter c ON c.grp = x.grp AND c.i = x.i
      JOIN {name}_unit y ON y.grp = x.grp AND y.i = c.j GROUP BY x.grp) s ON s.grp = u.grp
""")


_axis("first_axis", "scatter")
_piece("scatter_left", "scatter first_axis", """
SELECT c.grp, c.i, c.j, c.m - x.strength * x.a * y.a AS m
FROM scatter c JOIN first_axis x ON x.grp = c.grp AND x.i = c.i JOIN first_axis y ON y.grp = c.grp AND y.i = c.j
""")
_axis("second_axis", "scatter_left")
_oracle("project_pca_by_label", "centred first_axis second_axis", """
SELECT c.grp AS "group", c.id,
       round(coalesce(sum(c.e * f.a), 0), 4) + 0.0 AS x,
       round(coalesce(sum(CASE WHEN s.strength > 1e-9 * f.strength THEN c.e * s.a ELSE 0 END), 0), 4) + 0.0 AS y
FROM centred c LEFT JOIN first_axis f ON f.grp = c.grp AND f.i = c.i LEFT JOIN second_axis s ON s.grp = c.grp AND s.i = c.i
GROUP BY ALL
""")
_oracle("status_latest", "status_log", """
SELECT uid, arg_max(status, batch_id * 100 + progress) AS status, arg_max(progress, batch_id * 100 + progress) AS progress,
       arg_max(message, batch_id * 100 + progress) AS message
FROM status_log GROUP BY uid
""")
_oracle("job_stream_run", "final_errors", """
SELECT job_uid AS uid, CASE WHEN error IS NULL THEN 'done' ELSE 'error' END AS status, 100 AS progress, error AS message
FROM final_errors
""")

_oracle("job_stream_late_events", "final_errors items", """
SELECT job_uid AS uid, CASE WHEN error IS NULL THEN 'done' ELSE 'error' END AS status, 100 AS progress, error AS message,
       CASE WHEN error IS NULL THEN (SELECT count(*) FROM items i WHERE i.job_uid = e.job_uid) ELSE 0 END AS items
FROM (SELECT job_uid, CASE WHEN job_uid::BIGINT % 3 = 0 THEN 'Missing ''search_vectors'' in record' ELSE error END AS error
      FROM final_errors) e
""")
_oracle("embedding_stream_recovered", "waiting", "SELECT family_id AS id, 1::BIGINT AS times, 16 AS dimension FROM waiting")


def _filter(name: str, needs: str, condition: str) -> None:
    _oracle(f"filter_{name}", f"fam {needs}", f"SELECT family_id, rep_id FROM fam WHERE {condition}")


_filter("publication_date", "", "first_application_pub_date BETWEEN DATE '1995-01-01' AND DATE '2009-12-31'")
_filter("grant_date", "", "first_grant_pub_date >= DATE '2001-01-01'")
_filter("authority", "", "list_has_any(family_authorities, ['US', 'JP'])")
_filter("kind", "", "rep_kind IN ('B1', 'A1')")
_filter("assignee", "by_family", """
family_id IN (SELECT family_id FROM by_family WHERE applicant = 'acme')
AND family_id NOT IN (SELECT family_id FROM by_family WHERE applicant = 'kyoto robotics')
""")
_TRIGRAMS = (
    "list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN string_split({}, ' ')]))"
)
_piece("fuzzy", "by_family", f"""
SELECT DISTINCT family_id
FROM (SELECT family_id, {_TRIGRAMS.format("applicant")} AS a, {_TRIGRAMS.format("'societe generalle'")} AS b FROM by_family)
WHERE len(list_intersect(a, b)) >= 0.3 * len(list_distinct(list_concat(a, b)))
""")
_filter("assignee_fuzzy", "fuzzy", "family_id IN (SELECT family_id FROM fuzzy)")
_filter("inventor", "", "list_contains(inventors, 'Inv 3') AND NOT list_contains(inventors, 'Inv 5')")
_filter("applicant", "", "list_has_any(applicants, ['src3 Group', 'src4 Group'])")
_filter("cpc", "codes", """
family_id IN (SELECT family_id FROM codes WHERE code IN ('F16H', 'A61K'))
AND family_id NOT IN (SELECT family_id FROM codes WHERE code = 'B60W5/00')
""")
_filter("family_size", "", "coalesce(len(family_members), 0) BETWEEN 2 AND 3")
_filter("collection", "ip_patent_list_items", """
family_id IN (SELECT patent_family_id FROM ip_patent_list_items WHERE list_uid IN (3, 7))
""")
_filter("text", "", """
contains(lower(concat_ws(' ', title, abstract)), 'an') AND NOT contains(lower(concat_ws(' ', title, abstract)), 'the')
""")
_oracle("filter_cpc_children", "codes", "SELECT DISTINCT family_id FROM codes WHERE regexp_full_match(code, 'F16[A-Z]')")
_oracle("filter_cpc_subtree", "codes", "SELECT DISTINCT family_id FROM codes WHERE code = 'F16H'")

_piece("asked_documents", "nodes", """
SELECT job_uid, row_number() OVER () AS query_id, coalesce((d->>'$.weight')::DOUBLE, 1) AS weight, k,
       coalesce(d->>'$.title', '') || ' ' || coalesce(d->>'$.abstract', '') AS text
FROM (SELECT job_uid, coalesce((c->>'$.node.k')::INT, 200) AS k, unnest(json_extract(c, '$.node.docs[*]')) AS d
      FROM nodes WHERE type = 'seed_docs')
""")
_piece("document_vectors", "asked_documents", """
SELECT text, list(mean ORDER BY dim) AS v FROM (
  SELECT text, d AS dim,
         avg((instr('0123456789abcdef', substr(h, 2 * d + 1, 1)) - 1) * 16
             + instr('0123456789abcdef', substr(h, 2 * d + 2, 1)) - 1) / 127.5 - 1.0 AS mean
  FROM (SELECT text, md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS h
        FROM (SELECT DISTINCT text FROM asked_documents)), range(16) AS r(d)
  GROUP BY ALL)
GROUP BY text
""")
_piece("family_vectors", "token_means", "SELECT id, list(mean::FLOAT::DOUBLE ORDER BY dim) AS v FROM token_means GROUP BY id")
_piece("document_nearest", "document_vectors family_vectors", """
SELECT text, id, similarity, row_number() OVER (PARTITION BY text ORDER BY round(similarity, 12) DESC, id) AS rank
FROM (SELECT d.text, f.id, list_cosine_similarity([x::FLOAT::DOUBLE FOR x IN d.v], f.v) AS similarity
      FROM document_vectors d JOIN family_vectors f ON true)
""")
_oracle("filter_seed_documents", "asked_documents document_nearest", """
SELECT job_uid, id AS family_id, round(similarity * weight, 4) AS similarity
FROM asked_documents JOIN document_nearest USING (text) WHERE rank <= k
""")

# Documents beside families as seeds, all in the vectors of one model.
_piece("family_nearest", "family_vectors seeds", """
SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY similarity DESC, family_id) AS rank
FROM (SELECT a.id AS seed_id, b.id AS family_id, round(list_cosine_similarity(a.v, b.v), 4) AS similarity
      FROM family_vectors a JOIN family_vectors b ON a.id <> b.id WHERE a.id IN (SELECT family_id FROM seeds))
""")
_oracle("landscape_document_items", "seeds depths family_nearest asked_documents document_nearest fam", """
SELECT job_uid, family_id::VARCHAR AS family_id, coalesce(title, '') AS title, is_seed
FROM (SELECT job_uid, family_id, bool_or(is_seed) AS is_seed FROM (
        SELECT job_uid, family_id, true AS is_seed FROM seeds
        UNION ALL
        SELECT s.job_uid, n.family_id, false FROM seeds s JOIN depths d USING (job_uid)
        JOIN family_nearest n ON n.seed_id = s.family_id AND n.rank <= d.k
        UNION ALL
        SELECT job_uid, id, false FROM asked_documents JOIN document_nearest USING (text) WHERE rank <= k)
      GROUP BY ALL) i
LEFT JOIN (SELECT family_id AS id, title FROM fam) f ON f.id = i.family_id::VARCHAR
""")

# Filters, evaluated node by node for every family a job may show.
_piece("filter_problems", "nodes", """
SELECT job_uid, arg_min(problem, place) AS problem FROM (
  SELECT job_uid, row_number() OVER () AS place,
         CASE WHEN c->>'$.node.filters.date.field' IN ('priority', 'filing')
                   THEN 'no column holds the ' || (c->>'$.node.filters.date.field') || ' date'
              WHEN json_array_length(c, '$.node.filters.status') > 0 THEN 'no column holds status' END AS problem
  FROM nodes)
WHERE problem IS NOT NULL GROUP BY job_uid
""")
_piece("deep_codes", "nodes", """
SELECT DISTINCT job_uid, upper(replace(x->>'$.code', ' ', '')) AS norm, x->>'$.code' AS code,
       coalesce(x->>'$.depth', 'exact') AS depth
FROM (SELECT job_uid, unnest(json_extract(c, '$.node.classes[*]')) AS x FROM nodes WHERE type = 'cpc')
""")
# A step down adds one kind of sign: two digits, a letter, a group number, or what stands behind the stroke.
_piece("code_steps", "codes", """
SELECT DISTINCT code,
       CASE WHEN regexp_full_match(code, '[A-HY][0-9]{2}') THEN code[1:1]
            WHEN regexp_full_match(code, '[A-HY][0-9]{2}[A-Z]') THEN code[1:3]
            WHEN regexp_full_match(code, '[A-HY][0-9]{2}[A-Z][0-9]+/00') THEN code[1:4]
            WHEN contains(code, '/') THEN split_part(code, '/', 1) || '/00' END AS above
FROM codes
""")
_piece("deep_seeds", "deep_codes codes code_steps", """
SELECT DISTINCT job_uid, family_id FROM (
  SELECT job_uid, family_id FROM deep_codes d JOIN codes c ON c.code = CASE d.depth WHEN 'exact' THEN d.code ELSE d.norm END
  WHERE d.depth <> 'children'
  UNION ALL
  SELECT job_uid, family_id FROM deep_codes d JOIN code_steps s ON s.above = d.norm JOIN codes c ON c.code = s.code
  WHERE d.depth = 'children')
""")
_piece("listed_ids", "listed", """
SELECT DISTINCT job_uid, id::BIGINT AS family_id FROM listed WHERE NOT negative AND regexp_full_match(id, '-?[0-9]+')
""")
_piece("sound", "valid filter_problems", "SELECT job_uid FROM valid WHERE job_uid NOT IN (SELECT job_uid FROM filter_problems)")
_piece("node_filters", "nodes sound jobs", """
SELECT job_uid, client_uid, c->'$.node.filters' AS f
FROM nodes JOIN sound USING (job_uid) JOIN (SELECT job_uid, client_uid FROM jobs) USING (job_uid)
WHERE json_extract(c, '$.node.filters') IS NOT NULL
""")
_piece("asked_names", "node_filters", f"""
SELECT DISTINCT raw, fuzzy, {_normal_name("raw")} AS name
FROM (SELECT unnest(list_concat(json_extract_string(f, '$.assignee.include[*]'),
                                json_extract_string(f, '$.assignee.exclude[*]'))) AS raw,
             coalesce((f->>'$.assignee.fuzzy')::BOOLEAN, false) AS fuzzy FROM node_filters)
""")
_piece("name_families", "asked_names by_family", f"""
SELECT raw, fuzzy, list(DISTINCT family_id) AS ids
FROM asked_names n JOIN by_family b
  ON CASE WHEN fuzzy THEN len(list_intersect({_TRIGRAMS.format("applicant")}, {_TRIGRAMS.format("name")}))
                          >= 0.3 * len(list_distinct(list_concat({_TRIGRAMS.format("applicant")}, {_TRIGRAMS.format("name")})))
          ELSE applicant = name END
GROUP BY raw, fuzzy
""")
_piece("held", "fam codes", """
SELECT f.family_id, family_authorities, rep_kind, inventors, applicants, first_application_pub_date, first_grant_pub_date,
       coalesce(len(family_members), 0) AS size, lower(concat_ws(' ', title, abstract)) AS words,
       coalesce(codes_of, []) AS codes_of
FROM fam f LEFT JOIN (SELECT family_id, list(code) AS codes_of FROM codes GROUP BY family_id) USING (family_id)
WHERE f.family_id IS NOT NULL
""")


def _any_held(path: str, values: str) -> str:
    return f"coalesce(len(json_extract_string(f, '$.{path}[*]')) = 0 OR list_has_any({values}, json_extract_string(f, '$.{path}[*]')), false)"


def _named(path: str) -> str:
    return f"""EXISTS (SELECT 1 FROM name_families n
            WHERE n.fuzzy = coalesce((f->>'$.assignee.fuzzy')::BOOLEAN, false)
              AND list_contains(json_extract_string(f, '$.assignee.{path}[*]'), n.raw) AND list_contains(n.ids, h.family_id))"""


def _none_held(path: str, values: str) -> str:
    return f"NOT coalesce(list_has_any({values}, json_extract_string(f, '$.{path}[*]')), false)"


_DATE = "CASE f->>'$.date.field' WHEN 'grant' THEN first_grant_pub_date ELSE first_application_pub_date END"
_HOLDS = " AND ".join((
    f"""(json_extract(f, '$.date') IS NULL OR coalesce({_DATE} >= coalesce((f->>'$.date.from')::DATE, DATE '0001-01-01')
         AND {_DATE} <= coalesce((f->>'$.date.to')::DATE, DATE '9999-12-31'), false))""",
    """(json_extract(f, '$.familySize') IS NULL
        OR coalesce(size BETWEEN coalesce((f->>'$.familySize.min')::INT, 0) AND coalesce((f->>'$.familySize.max')::INT, 1000000000), false))""",
    _any_held("authority", "family_authorities"), _any_held("kindCodes", "[rep_kind]"),
    _any_held("inventor.include", "inventors"), _none_held("inventor.exclude", "inventors"),
    _any_held("applicant.include", "applicants"), _none_held("applicant.exclude", "applicants"),
    _any_held("cpcInclude", "codes_of"), _none_held("cpcExclude", "codes_of"),
    f"(len(json_extract_string(f, '$.assignee.include[*]')) = 0 OR {_named('include')})", f"NOT {_named('exclude')}",
    """(len(json_extract_string(f, '$.collections[*]')) = 0 OR EXISTS (SELECT 1 FROM ip_patent_list_items l
        WHERE l.client_uid = n0.client_uid AND l.patent_family_id = m.family_id::VARCHAR
          AND list_contains(json_extract_string(f, '$.collections[*]'), l.list_uid::VARCHAR)))""",
    "len([w FOR w IN json_extract_string(f, '$.textMustContain[*]') IF NOT coalesce(contains(words, lower(w)), false)]) = 0",
    "len([w FOR w IN json_extract_string(f, '$.textMustNotContain[*]') IF contains(words, lower(w))]) = 0",
))
_piece("may_show", "deep_seeds sound listed_ids depths nearest", """
SELECT DISTINCT job_uid, family_id::BIGINT AS family_id
FROM (SELECT job_uid, family_id::VARCHAR AS family_id FROM deep_seeds
      WHERE regexp_full_match(family_id, '[0-9]+')
      UNION ALL
      SELECT job_uid, n.family_id::VARCHAR FROM (SELECT job_uid, family_id FROM listed_ids UNION
                                        SELECT job_uid, family_id::BIGINT FROM deep_seeds WHERE regexp_full_match(family_id, '[0-9]+')) s
      JOIN depths d USING (job_uid) JOIN nearest n ON n.seed_id = s.family_id AND n.rank <= d.k)
JOIN sound USING (job_uid)
""")
_piece("shown", "may_show node_filters held name_families ip_patent_list_items", f"""
SELECT m.job_uid, m.family_id FROM may_show m
WHERE NOT EXISTS (SELECT 1 FROM node_filters x WHERE x.job_uid = m.job_uid)
UNION ALL
SELECT job_uid, family_id::BIGINT FROM (
  SELECT n0.job_uid, m.family_id, bool_and({_HOLDS}) AS holds
  FROM may_show m JOIN node_filters n0 ON n0.job_uid = m.job_uid LEFT JOIN held h ON h.family_id = m.family_id::VARCHAR
  GROUP BY n0.job_uid, m.family_id)
WHERE holds
""")
_piece("filtered_seeds", "deep_seeds shown listed_ids sound", """
SELECT job_uid, family_id FROM listed_ids JOIN sound USING (job_uid)
UNION
SELECT job_uid, family_id::BIGINT FROM deep_seeds
WHERE regexp_full_match(family_id, '[0-9]+') AND (job_uid, family_id::BIGINT) IN (SELECT (job_uid, family_id) FROM shown)
""")
_oracle("job_filter_errors", "errors filter_problems", """
SELECT job_uid, coalesce(error, 'Unsupported filter: ' || problem) AS error FROM errors LEFT JOIN filter_problems USING (job_uid)
""", "filtered_landscapes")
_oracle("job_depth_seeds", "deep_seeds listed_ids sound", """
SELECT job_uid, family_id FROM listed_ids JOIN sound USING (job_uid)
UNION
SELECT job_uid, family_id::BIGINT FROM deep_seeds JOIN sound USING (job_uid) WHERE regexp_full_match(family_id, '[0-9]+')
""", "filtered_landscapes")
_oracle("landscape_filtered_items", "filtered_seeds shown depths nearest fam", """
SELECT job_uid, family_id::VARCHAR AS family_id, coalesce(title, '') AS title, is_seed
FROM (SELECT job_uid, family_id, bool_or(is_seed) AS is_seed FROM (
        SELECT job_uid, family_id, true AS is_seed FROM filtered_seeds
        UNION ALL
        SELECT s.job_uid, n.family_id, false FROM filtered_seeds s JOIN depths d USING (job_uid)
        JOIN nearest n ON n.seed_id = s.family_id AND n.rank <= d.k
        WHERE (s.job_uid, n.family_id) IN (SELECT (job_uid, family_id) FROM shown))
      GROUP BY ALL) i
LEFT JOIN (SELECT family_id AS id, title FROM fam) f ON f.id = i.family_id::VARCHAR
""", "filtered_landscapes")
_oracle("applicant_similar", "by_family", f"""
SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity
FROM (SELECT name, {_TRIGRAMS.format("name")} AS g FROM (SELECT DISTINCT applicant AS name FROM by_family)) a
JOIN (SELECT name, {_TRIGRAMS.format("name")} AS g FROM (SELECT DISTINCT applicant AS name FROM by_family)) b ON a.name < b.name
WHERE len(list_intersect(a.g, b.g)) >= 0.3 * len(list_distinct(list_concat(a.g, b.g)))
""")
