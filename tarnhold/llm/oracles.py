"""DuckDB SQL of the training-data queries that SQL can express, written from their contracts, not from the plans."""

from __future__ import annotations

from . import mixing, toolcalls

_ASSIGN = """(?i:password|passwd|secret|token|api_?key)["''']?\\x20*[:=]\\x20*["''']?([A-Za-z0-9+/_.=-]+)""".replace("'''", "''")

#: Matches of a pattern in order, told apart by what follows each: lengths of the pieces before and of the matches add up.
_SPANS = """
SELECT doc_id, kind, pos AS s, pos + length(m) AS e FROM (
  SELECT doc_id, kind, m, v, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) - length(m) AS pos FROM (
    SELECT doc_id, kind, unnest(ms) AS m, unnest(vs) AS v, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM (
      SELECT doc_id, {k} AS kind, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {g}) AS vs, string_split_regex(t, '{p}') AS gaps FROM docs)))
WHERE length(v) >= {n}"""

_PARTS = [(0, _ASSIGN, 1, 12), (1, "AKIA[A-Z0-9]+", 0, 18), (2, "[0-9a-f]+", 0, 16)]

SECRETS = (
    "WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ("
    + " UNION ALL ".join(_SPANS.format(k=k, p=p, g=g, n=n) for k, p, g, n in _PARTS)
    + ") SELECT d.doc_id, "
    + ", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(("assign", "access", "hex")))
    + ", coalesce(string_agg(concat(['assign', 'access', 'hex'][kind + 1], ':', s, ':', e), ',' ORDER BY s, kind) FILTER (kind IS NOT NULL), '') AS spans FROM docs d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"
)

_WORDS = "len(regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+'))"
_RULES = toolcalls.DIALOGUE["reply"]["properties"]
_LIMITS = {"most": _RULES["prompt"]["maxLength"], "least": _RULES["words"]["minimum"]}

#: Plain dialogue: asks are calls, the turn after one answers it; a user's turn follows on from the user's turn two before
#: and from a system's turn right before it.
TOOL_CALLS = (
    "WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations), asks AS (SELECT * FROM m WHERE role IN ('user', 'system')),"
    " edges AS (SELECT a.conv_id, a.turn, b.turn AS dep FROM asks a JOIN asks b ON a.conv_id = b.conv_id AND a.role = 'user' AND (b.turn = a.turn - 1 AND b.role = 'system' OR b.turn = a.turn - 2 AND b.role = 'user')),"
    " ways AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS depth FROM asks UNION SELECT e.conv_id, e.turn, w.depth + 1 FROM edges e JOIN ways w ON w.conv_id = e.conv_id AND w.turn = e.dep),"
    " levels AS (SELECT conv_id, turn, max(depth) AS level FROM ways GROUP BY ALL),"
    f" calls AS (SELECT a.conv_id, a.turn, a.role, a.t, l.level, {_WORDS.format('a.t')} AS words, r.t AS answer FROM asks a JOIN levels l USING (conv_id, turn) LEFT JOIN m r ON r.role = 'assistant' AND r.conv_id = a.conv_id AND r.turn = a.turn + 1),"
    " wrong AS (SELECT *, list_filter([CASE WHEN length(t) < 1 THEN 'prompt: minLength' END, CASE WHEN length(t) > {most} THEN 'prompt: maxLength' END,"
    " CASE WHEN role = 'system' AND turn > 0 THEN 'turn: maximum' END, CASE WHEN words < {least} THEN 'words: minimum' END], lambda x: x IS NOT NULL) AS errors FROM calls)"
    " SELECT conv_id, CAST(turn AS VARCHAR) AS call_id, turn, CAST(0 AS BIGINT) AS idx, level, CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END AS name, CASE WHEN answer IS NULL THEN 'unanswered' ELSE 'linked' END AS status,"
    " len(errors) = 0 AS valid, array_to_string(errors, '; ') AS errors, concat('{{\"arguments\":{{\"prompt\":', to_json(t), ',\"turn\":', turn, ',\"words\":', words, '}},\"id\":\"', turn, '\",\"name\":\"', CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END, '\"', CASE WHEN answer IS NULL THEN '' ELSE concat(',\"result\":', to_json(answer)) END, '}}') AS canonical FROM wrong"
    " UNION ALL SELECT conv_id, CAST(turn - 1 AS VARCHAR), turn, NULL, NULL, NULL, 'orphan_result', false, 'no such call', concat('{{\"id\":\"', turn - 1, '\",\"result\":', to_json(t), '}}') FROM m WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM asks a WHERE a.conv_id = m.conv_id AND a.turn = m.turn - 1)"
).format(**_LIMITS)

_N = "CAST(concat('0x', substr(md5({}), 1, 15)) AS BIGINT)"
#: Sainte-Lague by its definition: every quotient that a seat could go to, the highest first.
_SEATS = "SELECT {keys}, count(*) FILTER (r <= seats) AS {out} FROM (SELECT *, row_number() OVER ({part} ORDER BY {claim} / (2 * k + 1) DESC, {order}, k) AS r FROM (SELECT *, unnest(range({most})) AS k FROM {rows} WHERE {claim} > 0)) GROUP BY ALL"

MIX = f"""
WITH RECURSIVE docs AS (SELECT doc_id, source, {_WORDS.format("coalesce(text, '')")} AS size, {_N.format("coalesce(text, '')")} AS key, concat(CASE WHEN source IS NULL THEN 'n' ELSE 's' END, coalesce(source, '')) AS name FROM documents),
same AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, key ORDER BY size) - 1 AS copy FROM docs),
rows_ AS (SELECT *, copy // {mixing.STRETCH} * {mixing.STRETCH} AS first, {_N.format(f"concat_ws(':', '{mixing.SEED}', coalesce(CAST(doc_id AS VARCHAR), 'null'), key, copy // {mixing.STRETCH} * {mixing.STRETCH})")} AS place FROM same),
dealt AS (SELECT *, place % greatest(1, CAST(ceil((SELECT count(*) FROM documents) / {mixing.DOCS_PER_SHARD}) AS BIGINT)) AS shard FROM rows_),
sources AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM (SELECT source, name, sum(size)::BIGINT AS source_size FROM docs GROUP BY ALL)),
-- water filling: whatever is above its cap is held there, and the rest shared anew, until nothing is
fill AS (SELECT 0 AS round, source, name, source_size, weight, false AS held FROM sources
  UNION ALL SELECT round + 1, source, name, source_size, weight, held OR over FROM (
    SELECT *, NOT held AND ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(CASE WHEN held THEN {mixing.COPIES} * source_size END) OVER (), 0)) * weight > {mixing.COPIES} * source_size * (sum(CASE WHEN held THEN 0 ELSE weight END) OVER ()) AS over FROM fill WHERE round < (SELECT count(*) FROM sources))),
last AS (SELECT * FROM fill WHERE round = (SELECT max(round) FROM fill)),
targets AS (SELECT source, name, source_size, CASE WHEN held THEN {mixing.COPIES}::DOUBLE * source_size ELSE least({mixing.COPIES}::DOUBLE * source_size, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(CASE WHEN held THEN {mixing.COPIES} * source_size END) OVER (), 0)::DOUBLE) / greatest(1, sum(CASE WHEN held THEN 0 ELSE weight END) OVER ())::DOUBLE * weight) END AS target FROM last),
asked AS (SELECT *, (SELECT greatest(sum(size) // {mixing.BLOCK}, least(sum(size), 1))::BIGINT FROM docs) AS seats FROM targets),
won AS ({_SEATS.format(keys="name", out="quota", part="", claim="target", order="source NULLS LAST", most="seats + 1", rows="asked")}),
shards AS (SELECT name, shard, sum(size)::BIGINT AS shard_size, coalesce(any_value(quota), 0) AS seats FROM dealt LEFT JOIN won USING (name) GROUP BY name, shard),
given AS ({_SEATS.format(keys="name, shard", out="quota", part="PARTITION BY name", claim="shard_size", order="shard", most="seats + 1", rows="shards")}),
cells AS (SELECT s.name, s.shard, shard_size, least(coalesce(quota, 0) * {mixing.BLOCK}, {mixing.COPIES} * shard_size) AS wanted, greatest(shard_size, 1) AS held, {_N.format(f"concat_ws(':', '{mixing.SEED}', s.name, s.shard)")} % CAST(ceil(greatest(shard_size, 1) / {mixing.BLOCK}) AS BIGINT) * {mixing.BLOCK} AS start FROM shards s LEFT JOIN given USING (name, shard)),
line AS (SELECT d.*, c.* EXCLUDE (name, shard), (sum(size) OVER (PARTITION BY d.name, d.shard ORDER BY place, doc_id NULLS FIRST, key, first, copy ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS pos FROM dealt d JOIN cells c USING (name, shard))
SELECT doc_id, size, source_size, target, (wanted // held * size + greatest(0, least(pos + size, start + wanted % held, shard_size) - greatest(pos, start)) + greatest(0, least(pos + size, start - shard_size + wanted % held) - greatest(pos, start - shard_size)))::BIGINT AS taken
FROM line JOIN targets USING (name)"""

ORACLES = {"secret_base_spans": SECRETS, "op7_tool_calls": TOOL_CALLS, "op10_source_mixing": MIX}
