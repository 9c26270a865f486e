"""The pN_ queries of the general problems, and their SQL."""

from sangam.operators import nested
from sangam.session import table


def p2_found(spark, sf):
    return nested.found(table(spark, sf, "job_records"))


def p2_objects(spark, sf):
    return nested.objects(nested.occurrences(table(spark, sf, "job_records")))


def p2_bridge(spark, sf):
    return nested.bridge(nested.occurrences(table(spark, sf, "job_records")))


def p2_records(spark, sf):
    return nested.records(nested.occurrences(table(spark, sf, "job_records")))


def queries():
    return {f.__name__: f for f in (p2_found, p2_objects, p2_bridge, p2_records)}


LISTED = "k IN ('rules', 'examples', 'layers', 'entries', 'schemes', 'fallbacks', 'stages', 'steps', 'checks', 'history', 'notes')"
# A walk over the JSON text, by paths and without hashes.
P2_FOUND = f"""WITH RECURSIVE b AS (SELECT rec_id, body::JSON AS j FROM job_records WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
 one AS (SELECT rec_id, v FROM (SELECT rec_id, json_extract(j, '$."' || unnest(json_keys(j)) || '"') AS v FROM b) WHERE json_type(v) = 'OBJECT'),
 two AS (SELECT rec_id, v FROM (SELECT rec_id, json_extract(v, '$."' || unnest(json_keys(v)) || '"') AS v FROM one) WHERE json_type(v) = 'OBJECT'),
 c AS (SELECT rec_id, 0 AS d, j->'$.pipeline_config' AS c FROM b UNION ALL SELECT rec_id, 1, v->'$.pipeline_config' FROM one UNION ALL SELECT rec_id, 2, v->'$.pipeline_config' FROM two),
 near AS (SELECT rec_id, arg_min(c, d) AS c FROM c WHERE c IS NOT NULL AND json_type(c) <> 'NULL' GROUP BY rec_id),
 tops AS (SELECT rec_id, 'pipeline_config' AS path, CASE WHEN json_type(c) <> 'VARCHAR' THEN c WHEN json_valid(c->>'$') THEN (c->>'$')::JSON END AS v FROM near UNION ALL SELECT rec_id, 'status', j->'$.status' FROM b),
 n AS (SELECT rec_id, path, '$' AS parent_path, '$' AS inside, false AS element, false AS direct, v FROM tops WHERE json_type(v) = 'OBJECT'
  UNION ALL SELECT rec_id, path, inside, CASE WHEN element THEN path ELSE inside END, element, direct, v FROM (
   SELECT rec_id, inside, path || '.' || k || CASE WHEN json_type(x) = 'OBJECT' AND {LISTED} THEN '[0]' ELSE '' END AS path, json_type(x) = 'OBJECT' AND {LISTED} AS element, {LISTED} AS direct, x AS v
    FROM (SELECT *, json_extract(v, '$."' || k || '"') AS x FROM (SELECT rec_id, path, inside, v, unnest(json_keys(v)) AS k FROM n WHERE json_type(v) = 'OBJECT')) WHERE json_type(x) IN ('OBJECT', 'ARRAY')
   UNION ALL SELECT rec_id, inside, path || '[' || i || ']', json_type(x) = 'OBJECT' AND direct, false, x
    FROM (SELECT *, json_extract(v, '$[' || i || ']') AS x FROM (SELECT rec_id, path, inside, direct, v, unnest(range(json_array_length(v)::BIGINT)) AS i FROM n WHERE json_type(v) = 'ARRAY')) WHERE json_type(x) IN ('OBJECT', 'ARRAY')))
 SELECT rec_id, path, parent_path FROM n WHERE element"""


def oracle_sql():
    return {"p2_found": P2_FOUND}
