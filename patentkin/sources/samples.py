"""Patent tables derived from the general test tables.

Each view is one SQL text that Spark and DuckDB read alike, so a query and its check start
from the same rows. Every view runs over the whole of its source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PATENTS = """
SELECT concat('P', cast(doc_id AS string)) AS id,
       CASE WHEN doc_id % 97 = 5 THEN NULL
            WHEN doc_id % 89 = 7 THEN concat('X', cast(doc_id AS string))
            ELSE cast(cast(floor(doc_id / 3) AS bigint) AS string) END AS family_id,
       CASE WHEN doc_id % 31 = 30 THEN NULL
            ELSE split_part('EP,WO,US,CN,JP,DE,ep,XX', ',', cast(1 + (doc_id * 7) % 8 AS int)) END AS authority,
       cast((doc_id * 7919) % 1000003 AS string) AS doc_number,
       CASE WHEN doc_id % 37 = 36 THEN NULL
            ELSE split_part('A1,A2,A3,B1,B2,B9,A8,b1,U', ',', cast(1 + (doc_id * 5) % 9 AS int)) END AS kind,
       CASE WHEN doc_id % 23 = 22 THEN NULL
            ELSE make_date(cast(1990 + (doc_id * 13) % 30 AS int), cast(1 + doc_id % 12 AS int),
                           cast(1 + doc_id % 28 AS int)) END AS publication_date,
       CASE WHEN doc_id % 11 = 10 THEN '  ' ELSE split_part(text, chr(10), 1) END AS title,
       CASE WHEN doc_id % 13 = 12 THEN NULL
            ELSE substr(text, length(split_part(text, chr(10), 1)) + 2) END AS abstract,
       CASE WHEN doc_id % 17 = 16 THEN NULL ELSE split(concat(
            split_part('A01B|F16H|G06F|H04L|Y10T|A61K', '|', cast(1 + doc_id % 6 AS int)), ' ',
            cast(1 + (doc_id * 3) % 2100 AS string), '/',
            split_part('00|02|505', '|', cast(1 + doc_id % 3 AS int)), ',',
            split_part('b60w|G06F', '|', cast(1 + doc_id % 2 AS int)),
            cast(1 + doc_id % 9 AS string), '/00'), ',') END AS cpc_classes,
       CASE WHEN doc_id % 19 = 18 THEN NULL ELSE split(concat(
            split_part('Société Générale|The Müller & Söhne|Acme Holdings|Kyoto Robotics|Grupo Peña', '|',
                       cast(1 + doc_id % 5 AS int)), ' ',
            split_part('GmbH|Inc|S A|Ltd|sa de cv|Co Ltd', '|', cast(1 + (doc_id * 11) % 6 AS int)), ',',
            source, ' Group'), ',') END AS applicants,
       split(concat('Inv ', cast(doc_id % 50 AS string), ',Inv ', cast(doc_id % 7 AS string)), ',') AS inventors
FROM documents
"""

# Ids are spread out, so that some families have no vector and some vectors no family.
EXPORT_EMBEDDINGS = """
SELECT cast(floor(vec_id * 4 / 3) AS bigint) AS id, embedding
FROM embeddings
"""

CPC_TITLES = """
SELECT cpc_code, title, level FROM (VALUES
  ('A', 'Human necessities', 1), ('B', 'Operations', 1), ('F', 'Mechanical engineering', 1), ('G', 'Physics', 1),
  ('A01', 'Agriculture', 2), ('A61', 'Medical', 2), ('B60', 'Vehicles', 2), ('F16', 'Engineering elements', 2),
  ('G06', 'Computing', 2), ('A01B', 'Soil working', 3), ('A61K', 'Preparations', 3), ('B60W', 'Vehicle control', 3),
  ('F16H', 'Gearing', 3), ('G06F', 'Digital data', 3)
) AS t(cpc_code, title, level)
UNION ALL SELECT concat('A01B', cast(p_partkey AS string), '/00'), concat('Soil working: ', p_name), 4 FROM part
UNION ALL SELECT concat('F16H', cast(p_partkey AS string), '/00'), concat('Gearing: ', p_name), 4 FROM part
UNION ALL SELECT concat('G06F', cast(p_partkey AS string), '/00'), concat('Digital data: ', p_name), 4 FROM part
UNION ALL SELECT concat('B60W', cast(p_partkey AS string), '/00'), concat('Vehicle control: ', p_name), 4 FROM part
"""

SONARS = """
SELECT o_orderkey AS uid, cast(o_custkey % 5 AS string) AS client_uid,
       cast(cast(floor(o_orderkey / 40) AS bigint) AS string) AS patent_family_id,
       o_totalprice AS radius, o_orderdate AS created_at,
       CASE WHEN o_orderstatus <> 'O' OR o_orderkey % 80 < 40 THEN o_orderdate END AS deactivated_at
FROM orders
"""

LISTS = """
SELECT s_suppkey AS uid, cast(s_suppkey % 5 AS string) AS client_uid, s_name AS name FROM supplier
"""

LIST_ITEMS = """
SELECT l_suppkey AS list_uid, cast(l_partkey AS string) AS patent_family_id,
       cast((l_suppkey + CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) % 5 AS string) AS client_uid
FROM lineitem
"""

# Requests of every kind: valid ones with ids, negatives and codes, and ones with each sort of error.
LANDSCAPES = """
SELECT cast(event_id AS string) AS uid,
       CASE WHEN event_id % 70 = 3 THEN NULL ELSE cast(user_id % 5 AS string) END AS client_uid,
       ts AS created_at,
       CASE WHEN event_type IN ('click', 'view') THEN 'to_calculate' ELSE 'draft' END AS _status,
       CASE WHEN event_id % 90 = 4 THEN NULL WHEN event_id % 90 = 34 THEN '{"v":1' ELSE
       concat('{"v":', CASE WHEN event_id % 20 = 19 THEN '2' ELSE '1' END,
              ',"type":"', CASE WHEN event_id % 60 = 5 THEN 'other' ELSE 'hybrid' END, '"',
              CASE WHEN event_id % 60 = 25 THEN ',"extra":1' ELSE '' END,
              ',"children":[{"node":{"type":"', CASE WHEN event_id % 60 = 45 THEN 'seed_text' ELSE 'seed_patents' END,
              '","k":', cast(5 + event_id % 4 AS string),
              CASE WHEN event_id % 60 = 15 THEN ',"depth":2' ELSE '' END,
              CASE WHEN event_id % 60 = 35 THEN '' ELSE concat(
                  ',"seeds":{"patentFamilyIds":["', cast(cast(floor(event_id / 30) AS bigint) AS string), '",',
                  CASE WHEN event_id % 60 = 55 THEN cast(user_id AS string)
                       WHEN event_id % 6 = 2 THEN '"n/a"'
                       ELSE concat('"', cast(user_id AS string), '"') END,
                  '],"negativePatentFamilyIds":["',
                  CASE WHEN event_id % 10 = 0 THEN cast(cast(floor(event_id / 30) AS bigint) AS string) ELSE '-1' END,
                  '","',
                  CASE WHEN event_id % 10 = 0 THEN cast(user_id AS string) ELSE '-2' END,
                  '"]}') END,
              '},"order":1}',
              CASE WHEN event_id % 1000 = 501
                   THEN ',{"node":{"type":"cpc","classes":[{"code":"F16H","depth":"subtree"}]},"order":2}'
                   WHEN event_id % 50 = 1
                   THEN concat(',{"node":{"type":"cpc","name":"group","classes":[{"code":"F16H',
                               cast(1 + event_id % 300 AS string), '/00","depth":"exact"}]},"order":2}')
                   ELSE '' END,
              CASE WHEN event_id % 40 = 2
                   THEN ',{"node":{"type":"seed_docs","k":3,"docs":[{"title":"Gear","abstract":"A gear.","weight":0.5}]}}'
                   ELSE '' END,
              ']}') END AS search_vectors
FROM events
"""

# Requests with every kind of filter, alone and together, and with codes at every depth.
FILTERED_LANDSCAPES = """
SELECT cast(event_id AS string) AS uid, cast(user_id % 5 AS string) AS client_uid, ts AS created_at,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 'to_calculate' ELSE 'draft' END AS _status,
       concat('{"v":1,"type":"hybrid","children":[{"node":{"type":"seed_patents","k":', cast(10 + event_id % 20 AS string),
              ',"seeds":{"patentFamilyIds":["', cast(user_id AS string), '","', cast(4 * (event_id % 50) AS string), '"]}',
              CASE event_id % 16
                WHEN 0 THEN ',"filters":{"date":{"field":"publication","from":"1995-01-01","to":"2009-12-31"}}'
                WHEN 1 THEN ',"filters":{"date":{"field":"grant","from":"2001-01-01"}}'
                WHEN 2 THEN ',"filters":{"authority":["US","JP"]}'
                WHEN 3 THEN ',"filters":{"kindCodes":["B1","A1"]}'
                WHEN 4 THEN ',"filters":{"assignee":{"include":["Acme Holdings","müller söhne"],"exclude":["KYOTO ROBOTICS Inc"]}}'
                WHEN 5 THEN ',"filters":{"assignee":{"include":["societe generalle"],"fuzzy":true}}'
                WHEN 6 THEN ',"filters":{"inventor":{"include":["Inv 3","Inv 6"],"exclude":["Inv 5"]}}'
                WHEN 7 THEN ',"filters":{"applicant":{"exclude":["src3 Group","src4 Group"]}}'
                WHEN 8 THEN ',"filters":{"cpcInclude":["F16H","A61K"],"cpcExclude":["B60W5/00"]}'
                WHEN 9 THEN ',"filters":{"familySize":{"min":2,"max":3},"textMustContain":["an","E"]}'
                WHEN 10 THEN ',"filters":{"collections":["3","7","9"]}'
                WHEN 11 THEN ',"filters":{"textMustNotContain":["The","qu"]}'
                WHEN 12 THEN ',"filters":{"status":["granted"]}'
                WHEN 13 THEN ',"filters":{"date":{"field":"filing","from":"2001-01-01"}}'
                WHEN 14 THEN ',"filters":{"authority":["EP","US","WO"],"cpcExclude":["A01B"],"familySize":{"min":2}}'
                ELSE '' END,
              '}}',
              CASE event_id % 5
                WHEN 1 THEN ',{"node":{"type":"cpc","filters":{"kindCodes":["A1","A2","B1"]},"classes":[{"code":"f 16h","depth":"children"}]}}'
                WHEN 2 THEN ',{"node":{"type":"cpc","classes":[{"code":"A61K2","depth":"children"},{"code":"g06","depth":"children"}]}}'
                WHEN 3 THEN concat(',{"node":{"type":"cpc","classes":[{"code":"A01B', cast(1 + event_id % 300 AS string),
                                   '/00","depth":"children"},{"code":"g06f ', cast(1 + event_id % 200 AS string),
                                   '/00","depth":"subtree"}]}}')
                ELSE '' END,
              ']}') AS search_vectors
FROM events
"""

# Vectors written as text, with every bracket, blank pieces and a piece that is no number.
VECTOR_TEXTS = """
SELECT l_orderkey, l_linenumber,
       concat(split_part('[ |(|{|', '|', cast(1 + l_linenumber % 4 AS int)), cast(cast(l_quantity AS bigint) AS string),
              CASE WHEN l_returnflag = 'A' THEN ',,' ELSE ', ' END,
              CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'x' ELSE cast(l_suppkey AS string) END,
              split_part(' ]|)|}|', '|', cast(1 + l_linenumber % 4 AS int))) AS text
FROM lineitem
"""

# Ids as texts: whole numbers with blanks and signs, and texts that are none.
ID_TEXTS = """
SELECT event_id,
       CASE WHEN event_type = 'click' THEN concat(' ', cast(user_id AS string), ' ')
            WHEN event_type = 'view' THEN concat('-', cast(event_id AS string))
            WHEN event_type = 'signup' THEN concat(cast(user_id AS string), '.5')
            WHEN event_type = 'error' THEN props
            ELSE concat('+', cast(user_id AS string)) END AS text
FROM events
"""

# Steps of runs: an event is a step, a user a job, and every hundred events a batch.
STATUS_LOG = """
SELECT cast(user_id AS string) AS uid, cast(floor(event_id / 100) AS bigint) AS batch_id,
       CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'done' ELSE 'calculating' END AS status,
       event_id % 100 AS progress, concat('step ', cast(event_id AS string)) AS message
FROM events
"""

VIEWS = {
    "patents": PATENTS,
    "export_embeddings": EXPORT_EMBEDDINGS,
    "cpc_titles": CPC_TITLES,
    "ip_patent_sonars": SONARS,
    "ip_patent_lists": LISTS,
    "ip_patent_list_items": LIST_ITEMS,
    "ip_landscapes": LANDSCAPES,
    "filtered_landscapes": FILTERED_LANDSCAPES,
    "vector_texts": VECTOR_TEXTS,
    "id_texts": ID_TEXTS,
    "status_log": STATUS_LOG,
}

SOURCES = {
    "patents": ["documents"],
    "export_embeddings": ["embeddings"],
    "cpc_titles": ["part"],
    "ip_patent_sonars": ["orders"],
    "ip_patent_lists": ["supplier"],
    "ip_patent_list_items": ["lineitem"],
    "ip_landscapes": ["events"],
    "filtered_landscapes": ["events"],
    "vector_texts": ["lineitem"],
    "id_texts": ["events"],
    "status_log": ["events"],
}


def sample(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """One of the views over the Parquet tables in `sf_dir`."""
    for name in SOURCES[view]:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(VIEWS[view])


def with_views(*names: str) -> str:
    """The views as the beginning of a WITH clause."""
    return "WITH " + ", ".join(f"{name} AS ({VIEWS[name].strip()})" for name in names)
