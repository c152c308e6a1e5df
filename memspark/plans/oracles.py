"""DuckDB SQL that gives the rows of the queries, from the same constants."""

from __future__ import annotations

from memspark.config import DEFAULTS as D
from memspark.fixtures import AS_OF
from memspark.functions.lexical import STOP_WORDS, TOKEN
from memspark.functions.scoring import HIGH_SIGNALS, MEDIUM_SIGNALS
from memspark.operators.contradict import FILLERS, MOVES, NEGATIONS, POSITIVES
from memspark.schemas import MEMORY_TYPES, SEMANTIC_TYPES


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _count(text: str, signals: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{s}') AS INTEGER)" for s in signals) + ")"


def _words(text: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: w <> ''))"


def _importance(text: str) -> str:
    low = f"lower({text})"
    return f"least(1.0::DOUBLE, 0.4::DOUBLE + {_count(low, HIGH_SIGNALS)} * 0.08::DOUBLE + {_count(low, MEDIUM_SIGNALS)} * 0.04::DOUBLE + (CAST(length({text}) > 200 AS INTEGER) + CAST(length({text}) > 500 AS INTEGER)) * 0.05::DOUBLE)"


def _memories(user: str = "source") -> str:
    layer = f"list_contains({_list(SEMANTIC_TYPES)}, memory_type)"
    return f"""
acc AS (SELECT event_id % (SELECT count(*) FROM documents) AS doc_id, count(*) AS access_count FROM events GROUP BY 1),
typed AS (SELECT *, ({_list(MEMORY_TYPES)})[doc_id % 7 + 1] AS memory_type FROM documents),
memories AS (
  SELECT CAST(doc_id AS VARCHAR) AS memory_id, doc_id, {user} AS user_id, 'user:' || {user} AS namespace, text AS content, memory_type,
         CASE WHEN {layer} THEN 'semantic' ELSE 'episodic' END AS memory_layer,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS updated_at,
         CASE WHEN doc_id % 10 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) END AS event_time,
         CASE WHEN doc_id % 17 = 0 THEN 'superseded' ELSE 'active' END AS status,
         {_importance("text")} AS importance_score,
         CASE WHEN doc_id % 23 = 0 THEN 'confirmed' ELSE 'none' END AS contradiction_status,
         CASE WHEN doc_id % 23 = 0 THEN 0.5::DOUBLE + (doc_id % 5) / 10.0::DOUBLE END AS contradiction_confidence,
         coalesce(access_count, 0) AS access_count
  FROM typed LEFT JOIN acc USING (doc_id))"""


def _recency(decay: str) -> str:
    return f"exp(-greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(updated_at)) / 3.6e9::DOUBLE, 0.0::DOUBLE) / {decay})"


def _composite(semantic: str) -> str:
    penalty = f"CASE WHEN contradiction_status = 'confirmed' AND coalesce(contradiction_confidence, 1.0) >= {D.penalty_from} THEN {D.penalty}::DOUBLE ELSE 0.0::DOUBLE END"
    total = f"{semantic} * {D.weight_semantic}::DOUBLE + {_recency(f'{D.decay_hours}::DOUBLE')} * {D.weight_recency}::DOUBLE + importance_score * {D.weight_importance}::DOUBLE + (ln(1.0::DOUBLE + access_count) / ln(101.0::DOUBLE)) * {D.weight_access}::DOUBLE - {penalty}"
    return f"round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, least(1.0::DOUBLE, {total})) + CASE WHEN memory_layer = 'semantic' THEN {D.layer_boost}::DOUBLE ELSE 0.0::DOUBLE END), 6)"


_COSINE = "round(list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])) + 1e-9), 6)"

_ASKED = """
asked AS (SELECT 'q' || e.vec_id AS query_id, e.vec_id, d.source AS user_id, e.embedding, e.label FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 25 = 0)"""


def _retrieved(filters: str = "true", top_k: int = 5, n: int = 30) -> str:
    shared = "len(list_intersect(x, c.w))"
    return f"""WITH RECURSIVE {_memories()}, {_ASKED},
near AS (
  SELECT a.query_id, m.*, {_COSINE.format("a.embedding", "e.embedding")} AS semantic_score
  FROM asked a JOIN memories m ON m.user_id = a.user_id AND m.status = 'active' JOIN embeddings e ON e.vec_id = m.doc_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC, memory_id) AS place FROM near),
fit AS (
  SELECT *, {_composite("semantic_score")} AS composite_score FROM top WHERE place <= {n} AND semantic_score BETWEEN 0 AND 1),
kept AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total_found FROM fit WHERE {filters}),
cands AS (
  SELECT *, {_words("content")} AS w, row_number() OVER (PARTITION BY query_id ORDER BY composite_score DESC, semantic_score DESC, memory_id) AS k FROM kept),
walk AS (
  SELECT query_id, k, [w] AS words, [memory_id] AS ids FROM cands WHERE k = 1
  UNION ALL
  SELECT query_id, k, CASE WHEN alike THEN words ELSE list_append(words, w) END, CASE WHEN alike THEN ids ELSE list_append(ids, memory_id) END
  FROM (SELECT c.query_id, c.k, c.w, c.memory_id, walk.words, walk.ids,
               len(list_filter(walk.words, lambda x: len(x) > 0 AND len(c.w) > 0 AND {shared} / (len(x) + len(c.w) - {shared})::DOUBLE > {D.diversity})) > 0 AS alike
        FROM walk JOIN cands c ON c.query_id = walk.query_id AND c.k = walk.k + 1)),
last AS (SELECT query_id, arg_max(ids, k) AS ids FROM walk GROUP BY 1),
ranked AS (SELECT query_id, unnest(ids[1:{top_k}]) AS memory_id, unnest(range(1, least(len(ids), {top_k}) + 1)) AS rank FROM last),
results AS (SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank, c.* EXCLUDE (query_id) FROM ranked r JOIN cands c USING (query_id, memory_id))
"""


_JUDGED = f"""
pairs AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, CAST(a.doc_id AS VARCHAR) AS a, CAST(b.doc_id AS VARCHAR) AS b,
         lower(coalesce(CASE WHEN a.doc_id % 4 = 2 THEN 'user hates the ' ELSE '' END || a.text, '')) AS x,
         lower(coalesce(CASE WHEN b.doc_id % 4 = 0 THEN 'now joined ' ELSE '' END || b.text, '')) AS y
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND a.lang = b.lang),
signs AS (
  SELECT *, {_count("x", NEGATIONS)} > 0 AS na, {_count("y", NEGATIONS)} > 0 AS nb, {_count("x", POSITIVES)} > 0 AS pa, {_count("y", POSITIVES)} > 0 AS pb,
         {_count("x", MOVES)} > 0 AND {_count("y", MOVES)} > 0 AS moves,
         len(list_intersect(list_filter({_words("x")}, lambda w: NOT list_contains({_list(FILLERS)}, w)), list_filter({_words("y")}, lambda w: NOT list_contains({_list(FILLERS)}, w)))) AS overlap,
         CAST('0x' || substr(md5(x || y), 1, 8) AS BIGINT) % 100 AS bucket
  FROM pairs),
judged AS (
  SELECT *, (na AND pb) OR (nb AND pa) AS opposed, moves AND overlap >= 1 AS moved, overlap >= 3 AND bucket < 30 AS close,
         opposed OR moved OR close AS contradicts,
         CASE WHEN moved THEN 0.80 WHEN opposed AND overlap >= 1 THEN 0.85 WHEN opposed THEN 0.65 WHEN close THEN 0.55 ELSE 0.5 END::DOUBLE AS confidence
  FROM signs),
reports AS (SELECT a, b, doc_a, doc_b, confidence, CASE WHEN doc_a % 2 = 0 THEN 'temporal_update' ELSE 'direct_conflict' END AS kind FROM judged WHERE contradicts)"""

_OBSERVED = f"""
observed AS (
  SELECT event_id, 'u' || user_id AS user_id, 's' || (user_id % 10) AS source_ref, ts AS event_time,
         CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type || ' ' || props END AS content,
         CASE WHEN event_id % 19 = 0 THEN 'rumour' ELSE ({_list(MEMORY_TYPES)})[event_id % 7 + 1] END AS memory_type,
         CASE WHEN event_id % 23 = 0 THEN 1.5 WHEN event_id % 11 = 0 THEN (event_id % 13) / 10.0 END::DOUBLE AS given
  FROM events),
scored AS (
  SELECT *, coalesce(nullif(given, 0), {_importance("content")}) AS importance_score FROM observed),
checked AS (
  SELECT *, CASE WHEN content = '' THEN 'empty content' WHEN importance_score < 0 OR importance_score > 1 THEN 'importance_score out of range' WHEN memory_type = 'rumour' THEN 'unknown memory_type' END AS reject_reason FROM scored)"""

_TEXT_VECTORS = """
tv_words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents),
tv_runs AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) ELSE [array_to_string(w, ' ')] END) AS run FROM tv_words),
tv_hash AS (SELECT doc_id, CAST('0x' || substr(md5(run), 1, 8) AS BIGINT) AS h FROM tv_runs),
tv_sums AS (SELECT doc_id, h % 64 AS bucket, sum(CASE WHEN (h // 64) % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS s FROM tv_hash GROUP BY 1, 2),
tv_norm AS (SELECT doc_id, sqrt(sum(s * s)) AS n FROM tv_sums GROUP BY 1)"""


def _chosen_memories(close: str) -> str:
    """Memories after reports whose first memory's number divides by 3 were resolved for the second."""
    return f"SELECT m.memory_id, CASE WHEN m.memory_id IN (SELECT a FROM reports WHERE doc_a % 3 = 0) THEN 'superseded' ELSE m.status END AS status FROM memories m {close}"


def _matched() -> str:
    return f"""WITH {_memories()}, {_ASKED},
near AS (
  SELECT 'q' || a.vec_id AS decision_id, a.vec_id, m.user_id, m.memory_id, {_COSINE.format("a.embedding", "e.embedding")} AS score
  FROM asked a JOIN memories m ON m.user_id = a.user_id AND m.status = 'active' AND m.doc_id <> a.vec_id JOIN embeddings e ON e.vec_id = m.doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY score DESC, memory_id) AS k FROM near),
matched AS (
  SELECT a.query_id AS decision_id, a.vec_id, a.user_id, CASE WHEN b.score >= 0.3 THEN b.memory_id END AS existing_memory_id, b.score,
         CASE WHEN b.score >= 0.3 THEN NULL ELSE 'create' END AS action
  FROM asked a LEFT JOIN best b ON b.decision_id = a.query_id AND b.k = 1)
"""


def _evaluated() -> str:
    return _retrieved() + """,
wanted AS (SELECT a.query_id, CAST(e.vec_id AS VARCHAR) AS memory_id FROM asked a JOIN embeddings e USING (label) JOIN documents d ON d.doc_id = e.vec_id AND d.source = a.user_id),
hits AS (SELECT r.query_id, r.rank, CASE WHEN w.memory_id IS NULL THEN 0 ELSE 1 END AS rel FROM results r LEFT JOIN wanted w USING (query_id, memory_id)),
got AS (
  SELECT query_id, CAST(sum(rel) FILTER (rank <= 1) AS BIGINT) AS h1, CAST(sum(rel) FILTER (rank <= 3) AS BIGINT) AS h3, CAST(sum(rel) FILTER (rank <= 5) AS BIGINT) AS h5, min(rank) FILTER (rel = 1) AS first,
         count(*) AS returned, sum(rel / log2(rank + 1)) AS dcg FROM hits GROUP BY 1),
need AS (SELECT query_id, count(*) AS relevant FROM wanted GROUP BY 1),
full_rows AS (
  SELECT a.query_id, coalesce(h1, 0) AS h1, coalesce(h3, 0) AS h3, coalesce(h5, 0) AS h5, first, coalesce(returned, 0) AS returned, coalesce(dcg, 0) AS dcg, coalesce(relevant, 0) AS relevant
  FROM asked a LEFT JOIN got USING (query_id) LEFT JOIN need USING (query_id)),
ideal AS (
  SELECT *, coalesce(list_sum(list_transform(range(1, h5 + 1), lambda i: 1 / log2(i + 1))), 0) + coalesce(list_sum(list_transform(range(returned + 1, least(5, relevant) + 1), lambda i: 1 / log2(i + 1))), 0) AS idcg FROM full_rows),
quality AS (
  SELECT query_id, h1 / 1.0 AS p1, h3 / 3.0 AS p3, h5 / 5.0 AS p5, CASE WHEN relevant > 0 THEN h1 / relevant ELSE 0.0 END AS r1, CASE WHEN relevant > 0 THEN h3 / relevant ELSE 0.0 END AS r3,
         CASE WHEN relevant > 0 THEN h5 / relevant ELSE 0.0 END AS r5, CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 / first END AS rr, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg5 FROM ideal)
"""


def _lexical() -> str:
    stop = _list(STOP_WORDS)
    tokens = lambda t: f"list_filter(regexp_extract_all(lower({t}), '{TOKEN.replace(chr(39), chr(39) * 2)}'), lambda t: NOT list_contains({stop}, t))"
    run = lambda k: f"len(list_filter(range(1, len(qw) - {k - 2}), lambda i: contains(low, array_to_string(qw[i:i+{k - 1}], ' ')))) > 0"
    return f"""WITH asked AS (SELECT 'b' || item_id AS query_id, text AS q, 'src' || (item_id % 20) AS user_id FROM benchmark),
both_texts AS (
  SELECT query_id, CAST(doc_id AS VARCHAR) AS memory_id, lower(text) AS low, trim(lower(q)) AS ql, list_distinct({tokens("q")}) AS qt, {tokens("text")} AS ct,
         list_filter(regexp_split_to_array(trim(lower(q)), '\\s+'), lambda w: w <> '') AS qw
  FROM asked JOIN documents ON source = user_id),
parts AS (
  SELECT *, CASE WHEN len(qt) = 0 THEN 0.0 ELSE len(list_intersect(qt, ct)) / len(qt)::DOUBLE END AS o, CASE WHEN len(qt) = 0 THEN 0.0 ELSE len(list_filter(qt, lambda t: contains(low, t))) / len(qt)::DOUBLE END AS k,
         CASE WHEN contains(low, ql) THEN 1.0 WHEN len(qw) < 3 THEN 0.0 WHEN len(qw) >= 4 AND {run(4)} THEN 4 / len(qw)::DOUBLE WHEN {run(3)} THEN 3 / len(qw)::DOUBLE ELSE 0.0 END AS p
  FROM both_texts)
SELECT query_id, memory_id, round(o, 6) AS overlap, round(k, 6) AS keyword, round(p, 6) AS phrase, round(least(1.0, 0.5 * o + 0.3 * k + 0.2 * p), 6) AS lexical FROM parts"""


def _merged() -> str:
    """The greedy walk, one memory of each user after the other, and then its steps, one after the other: events (turn, met, winner, loser) and totals."""
    return f"""WITH RECURSIVE {_memories("lang")}, {_TEXT_VECTORS},
prom AS (SELECT *, coalesce(status = 'active' AND memory_layer = 'episodic' AND access_count >= {D.promote_accesses} AND importance_score >= {D.promote_importance}, false) AS promoted FROM memories),
own AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, memory_id) AS place FROM prom WHERE status = 'active' AND (memory_layer = 'semantic' OR promoted)),
v AS (SELECT doc_id, place, importance_score AS imp, user_id, bucket, s / n AS s FROM own JOIN tv_sums USING (doc_id) JOIN tv_norm USING (doc_id) WHERE n > 0),
near AS (SELECT x.user_id, x.place AS p, y.place AS q, any_value(y.imp) AS imp FROM v x JOIN v y ON x.user_id = y.user_id AND x.bucket = y.bucket AND x.place < y.place GROUP BY x.user_id, x.place, y.place HAVING round(sum(x.s * y.s), 6) >= {D.merge_from}),
ends AS (SELECT user_id, p AS place FROM near UNION SELECT user_id, q FROM near),
later AS (SELECT user_id, p AS place, list({{'q': q, 'imp': imp}} ORDER BY q) AS nb FROM near GROUP BY 1, 2),
seq AS (SELECT user_id, place, importance_score AS imp, doc_id, access_count, nb, row_number() OVER (PARTITION BY user_id ORDER BY place) AS k FROM own JOIN ends USING (user_id, place) LEFT JOIN later USING (user_id, place)),
walk AS (
  SELECT user_id, 0::BIGINT AS k, []::BIGINT[] AS lost, 0::BIGINT AS place, 0.0::DOUBLE AS imp, []::STRUCT(q BIGINT, imp DOUBLE)[] AS met FROM seq GROUP BY 1
  UNION ALL
  SELECT user_id, k, list_concat(list_concat(lost, list_transform(list_filter(met, lambda x: imp >= x.imp), lambda x: x.q)), CASE WHEN len(list_filter(met, lambda x: imp < x.imp)) > 0 THEN [place] ELSE [] END), place, imp, met
  FROM (SELECT w.user_id, s.k, w.lost, s.place, s.imp, CASE WHEN s.nb IS NULL OR list_contains(w.lost, s.place) THEN [] ELSE list_filter(s.nb, lambda x: NOT list_contains(w.lost, x.q)) END AS met
        FROM walk w JOIN seq s ON s.user_id = w.user_id AND s.k = w.k + 1) step),
meets AS (SELECT user_id, place AS turn, imp, unnest(met) AS x FROM walk),
events AS (
  SELECT m.user_id, turn, m.x.q AS met, CASE WHEN m.imp >= m.x.imp THEN a.doc_id ELSE b.doc_id END AS winner, CASE WHEN m.imp >= m.x.imp THEN b.doc_id ELSE a.doc_id END AS loser,
         CASE WHEN m.imp >= m.x.imp THEN b.access_count ELSE a.access_count END AS n, row_number() OVER (ORDER BY m.user_id, turn, m.x.q) AS e
  FROM meets m JOIN seq a ON a.user_id = m.user_id AND a.place = turn JOIN seq b ON b.user_id = m.user_id AND b.place = m.x.q),
fold AS (
  SELECT 0::BIGINT AS e, MAP([]::BIGINT[], []::BIGINT[]) AS gained
  UNION ALL
  SELECT n.e, map_concat(gained, MAP([n.winner], [(coalesce(gained[n.winner], 0) + n.n + coalesce(gained[n.loser], 0))::BIGINT])) FROM fold f JOIN events n ON n.e = f.e + 1),
totals AS (SELECT t.entry.key AS doc_id, t.entry.value AS gained FROM (SELECT unnest(map_entries(gained)) AS entry FROM fold WHERE e = (SELECT max(e) FROM fold)) t),
won AS (SELECT winner AS doc_id, string_agg(loser, ',' ORDER BY e) AS merged_ids FROM events GROUP BY 1),
fell AS (SELECT loser AS doc_id, CAST(arg_max(winner, e) AS VARCHAR) AS merged_into FROM events GROUP BY 1)
"""


def _chains() -> str:
    return """WITH RECURSIVE up AS (
  SELECT doc_id, doc_id // 2 AS anc, 1 AS hops FROM documents WHERE doc_id > 0
  UNION ALL SELECT doc_id, anc // 2, hops + 1 FROM up WHERE anc > 0)
SELECT CAST(doc_id AS VARCHAR) AS memory_id, CAST(anc AS VARCHAR) AS ancestor, CAST(min(hops) AS INTEGER) AS hops FROM up WHERE anc <> doc_id GROUP BY 1, 2"""


def _related() -> str:
    return """WITH edges AS (
  SELECT DISTINCT n_name AS src, r_name AS dst, 'in_region' AS rel FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT DISTINCT s_name, n_name, 'in_nation' FROM supplier JOIN nation ON s_nationkey = n_nationkey),
ways AS (SELECT src, dst, rel, src || '|' || dst || '|' || rel AS id FROM edges UNION ALL SELECT dst, src, rel, src || '|' || dst || '|' || rel FROM edges),
one AS (SELECT n_name AS seed, dst AS node, rel, id FROM nation JOIN ways ON src = n_name),
two AS (SELECT seed, w.dst AS node, o.rel, o.id || ',' || w.id AS used FROM one o JOIN ways w ON w.src = o.node AND w.id <> o.id),
paths AS (SELECT seed, node, rel, 1 AS hops, id AS used FROM one UNION ALL SELECT seed, node, rel, 2, used FROM two),
placed AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops, node, rel, used) AS place FROM paths WHERE node <> seed)
SELECT seed, node, rel, hops, CAST(place AS INTEGER) AS place FROM placed WHERE place <= 50"""


def oracle_sql() -> dict[str, str]:
    m = f"WITH {_memories()}"
    ml = f"WITH {_memories('lang')}"
    mj = f"WITH {_memories()}, {_JUDGED}"
    newest = """, obs AS (SELECT *, row_number() OVER (PARTITION BY user_id, namespace ORDER BY created_at DESC, memory_id) AS place FROM memories WHERE status = 'active' AND memory_type = 'observation'),
due AS (SELECT user_id, namespace, list(memory_id ORDER BY place) AS ids, string_agg('- ' || content, chr(10) ORDER BY place) AS text FROM obs WHERE place <= 20 GROUP BY 1, 2 HAVING count(*) >= 3)"""
    reply = "event_id % 3 = 0"
    return {
        "retrieve_topk": _retrieved() + "SELECT query_id, rank, memory_id, semantic_score, composite_score FROM results",
        "retrieve_full": _retrieved("importance_score >= 0.45 AND memory_layer = 'semantic' AND memory_type IN ('fact', 'summary', 'reflection') AND (event_time IS NULL OR event_time <= TIMESTAMP '2024-01-01 05:00:00') AND starts_with(namespace, 'user:src')", 3)
        + "SELECT query_id, rank, memory_id, composite_score, total_found, substr(content, 1, 200) AS preview FROM results",
        "context_window": _retrieved() + """SELECT query_id, md5(string_agg('[' || rank || '] ' || content, chr(10) ORDER BY rank)) AS api_md5,
  CAST(length('# Relevant Memories' || chr(10) || chr(10)) + sum(length(rank || '. [' || memory_type || '] ' || content || printf(' (importance=%.2f, score=%.2f)', importance_score, composite_score))) + count(*) - 1 AS INTEGER) AS context_chars FROM results GROUP BY 1""",
        "score_recency": f"{m} SELECT memory_id, round({_recency('(CASE doc_id % 3 WHEN 1 THEN 24.0 ELSE 168.0 END)::DOUBLE')}, 6) AS recency FROM memories",
        "score_importance": f"{m} SELECT memory_id, round(importance_score, 6) AS importance FROM memories",
        "score_composite": f"{m} SELECT memory_id, {_composite('((doc_id % 100) / 100.0::DOUBLE)')} AS composite FROM memories",
        "lexical_score": _lexical(),
        "lexical_topk": f"""WITH scores AS ({_lexical()}), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, memory_id) AS rank FROM scores WHERE lexical > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, memory_id, overlap, keyword, phrase, lexical FROM placed WHERE rank <= 10""",
        "ingest_memories": f"WITH {_OBSERVED} SELECT 'user:' || user_id AS namespace, user_id, memory_type, CASE WHEN list_contains({_list(SEMANTIC_TYPES)}, memory_type) THEN 'semantic' ELSE 'episodic' END AS memory_layer, content, source_ref, event_time, round(importance_score, 6) AS importance, 'active' AS status, 1 AS version FROM checked WHERE reject_reason IS NULL",
        "ingest_rejects": f"WITH {_OBSERVED} SELECT reject_reason, count(*) AS n FROM checked WHERE reject_reason IS NOT NULL GROUP BY 1",
        "ingest_summary": f"WITH {_OBSERVED} SELECT count(*) FILTER (reject_reason IS NULL) AS ingested, count(*) FILTER (reject_reason IS NOT NULL) AS failed FROM checked",
        "list_memories": f"{m}, placed AS (SELECT user_id, memory_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, memory_id) AS place FROM memories WHERE status = 'active') SELECT user_id, memory_id, CAST(place AS INTEGER) AS place FROM placed WHERE place > 5 AND place <= 15",
        "user_stats": f"{m} SELECT user_id, count(*) AS total_memories, string_agg(DISTINCT namespace, ',' ORDER BY namespace) AS namespaces, count(*) FILTER (status = 'active') AS active FROM memories GROUP BY 1 HAVING count(*) FILTER (status = 'active') > 0",
        "facts_of_user": "SELECT 'u' || (c_custkey % 10) AS user_id, 'f' || c_custkey AS fact_id, c_name AS subject, 'lives_in' AS predicate, n_name AS object, 1.0::DOUBLE AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 0",
        "operation_log": f"{m} SELECT memory_id, user_id, CASE WHEN doc_id % 29 = 0 THEN 'create' WHEN doc_id % 13 = 0 THEN 'delete' ELSE 'update' END AS operation FROM memories WHERE doc_id % 29 = 0 OR doc_id % 13 = 0 OR doc_id % 31 = 0",
        "promote": f"{m}, p AS (SELECT *, status = 'active' AND memory_layer = 'episodic' AND access_count >= 3 AND importance_score >= 0.45 AS promoted FROM memories) SELECT memory_id, CASE WHEN promoted THEN 'semantic' ELSE memory_layer END AS memory_layer, promoted FROM p",
        "audit_trail": f"""{m}, log AS (SELECT memory_id, 1 AS hour, CASE WHEN doc_id % 29 = 0 THEN 'create' WHEN doc_id % 13 = 0 THEN 'delete' ELSE 'update' END AS operation FROM memories WHERE doc_id % 29 = 0 OR doc_id % 13 = 0 OR doc_id % 31 = 0
UNION ALL SELECT memory_id, 2, 'update' FROM memories WHERE doc_id % 11 = 0)
SELECT memory_id, CAST(row_number() OVER (PARTITION BY memory_id ORDER BY hour) AS INTEGER) AS place, operation FROM log""",
        "promote_metadata": f"""{m}, p AS (SELECT *, doc_id % 3 AS k, status = 'active' AND memory_layer = 'episodic' AND access_count >= 3 AND importance_score >= 0.45 AS promoted FROM memories)
SELECT memory_id, CASE WHEN k > 0 THEN memory_type END AS topic, CASE WHEN promoted THEN 'true' END AS stamp, CASE WHEN promoted THEN false WHEN k = 2 THEN true END AS old,
       CAST(CASE WHEN promoted AND k > 0 THEN 3 WHEN promoted THEN 2 WHEN k > 0 THEN k END AS INTEGER) AS entries FROM p""",
        "near_duplicate_pairs": f"""{ml}, {_TEXT_VECTORS}, own AS (SELECT memory_id, doc_id, user_id FROM memories WHERE status = 'active' AND memory_layer = 'semantic'),
v AS (SELECT doc_id, memory_id, user_id, bucket, s / n AS s FROM own JOIN tv_sums USING (doc_id) JOIN tv_norm USING (doc_id) WHERE n > 0),
dots AS (SELECT x.user_id, x.memory_id AS a, y.memory_id AS b, sum(x.s * y.s) AS score FROM v x JOIN v y ON x.user_id = y.user_id AND x.bucket = y.bucket AND x.memory_id < y.memory_id GROUP BY ALL)
SELECT user_id, a, b, round(round(score, 6), 5) AS score FROM dots WHERE round(score, 6) >= {D.merge_from}""",
        "merge_similar": f"""{_merged()} SELECT memory_id, CASE WHEN merged_into IS NULL THEN status ELSE 'superseded' END AS status, merged_into, merged_ids, access_count + coalesce(gained, 0) AS access_count
FROM prom LEFT JOIN totals USING (doc_id) LEFT JOIN won USING (doc_id) LEFT JOIN fell USING (doc_id)""",
        "consolidation_summary": f"{_merged()} SELECT p.user_id, p.promoted, coalesce(m.merged, 0) AS merged FROM (SELECT user_id, CAST(count(*) FILTER (promoted) AS BIGINT) AS promoted FROM prom GROUP BY 1) p LEFT JOIN (SELECT user_id, count(*) AS merged FROM events GROUP BY 1) m USING (user_id)",
        "contradiction_candidates": f"""{m}, near AS (
  SELECT f.memory_id AS f, f.doc_id AS fd, x.memory_id AS x, x.doc_id AS xd, {_COSINE.format("e.embedding", "g.embedding")} AS score
  FROM memories f JOIN embeddings e ON e.vec_id = f.doc_id JOIN memories x ON x.user_id = f.user_id AND x.status = 'active' JOIN embeddings g ON g.vec_id = x.doc_id WHERE f.status = 'active'),
top AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY score DESC, x) AS k FROM near)
SELECT CAST(least(fd, xd) AS VARCHAR) AS a, CAST(greatest(fd, xd) AS VARCHAR) AS b, max(score) AS score FROM top WHERE k <= 5 AND f <> x AND score >= 0.3 GROUP BY 1, 2""",
        "contradiction_judge": f"WITH {_JUDGED} SELECT a, b, CAST(overlap AS INTEGER) AS overlap, contradicts, confidence FROM judged",
        "contradiction_apply": f"""{mj}, ends AS (
  SELECT a AS memory_id, b AS other, confidence, kind = 'temporal_update' AND confidence >= 0.7 AS older FROM reports
  UNION ALL SELECT b, a, confidence, false FROM reports),
change AS (SELECT memory_id, max(confidence) >= 0.7 AS sure, max(confidence) FILTER (confidence >= 0.7) AS confidence, string_agg(DISTINCT other, ',' ORDER BY other) FILTER (confidence >= 0.7) AS others, bool_or(older) AS older FROM ends GROUP BY 1)
SELECT m.memory_id, CASE WHEN sure THEN 'confirmed' WHEN sure IS NOT NULL THEN 'suspected' ELSE contradiction_status END AS contradiction_status,
       round(coalesce(c.confidence, contradiction_confidence), 6) AS confidence, coalesce(others, '') AS contradicted_by, CASE WHEN older THEN 'superseded' ELSE status END AS status
FROM memories m LEFT JOIN change c USING (memory_id)""",
        "contradiction_resolve": f"{mj} {_chosen_memories('')}",
        "contradiction_list": f"WITH {_JUDGED} SELECT a AS memory_a_id, b AS memory_b_id, kind AS contradiction_type, confidence, 'newer' AS resolution_note, least(a, b) AS low, greatest(a, b) AS high FROM reports WHERE doc_a % 3 = 0",
        "update_match": _matched() + "SELECT decision_id, existing_memory_id, round(score, 6) AS score, action FROM matched",
        "update_apply": _matched() + """, decided AS (
  SELECT *, CASE WHEN action = 'create' THEN 'create' ELSE (['skip', 'update', 'supersede', 'merge'])[vec_id % 4 + 1] END AS act FROM matched),
chain AS (SELECT *, row_number() OVER (PARTITION BY existing_memory_id ORDER BY decision_id) AS step, count(*) OVER (PARTITION BY existing_memory_id) AS n FROM decided WHERE act IN ('update', 'supersede', 'merge'))
SELECT user_id, md5(content) AS content_md5, CASE WHEN memory_id IN (SELECT existing_memory_id FROM chain) THEN 'superseded' ELSE status END AS status, 1 AS version, 0 AS parents FROM memories
UNION ALL SELECT user_id, md5(CASE WHEN act = 'merge' THEN 'merged ' || decision_id ELSE 'news of ' || decision_id END), CASE WHEN step = n THEN 'active' ELSE 'superseded' END, CAST(1 + step AS INTEGER), CAST(step AS INTEGER) FROM chain
UNION ALL SELECT user_id, md5('news of ' || decision_id), 'active', 1, 0 FROM decided WHERE act = 'create'""",
        "reflection_due": f"{m} SELECT user_id, namespace, count(*) AS n FROM memories WHERE status = 'active' GROUP BY 1, 2 HAVING count(*) % 3 = 0",
        "reflection_input": f"{ml} {newest} SELECT user_id, namespace, array_to_string(ids, ',') AS ids, md5(text) AS text_md5 FROM due",
        "reflection_store": f"{ml} {newest} SELECT user_id, 'a habit' AS content, 'reflection' AS memory_type, 'semantic' AS memory_layer, 0.9::DOUBLE AS confidence, ids[1] || ',' || ids[3] AS support FROM due UNION ALL SELECT user_id, 'a wish', 'reflection', 'semantic', 0.7::DOUBLE, ids[2] FROM due",
        "graph_related": _related(),
        "version_chain": _chains(),
        "access_feedback": _retrieved() + ", hit AS (SELECT memory_id, count(*) AS n FROM results GROUP BY 1) SELECT m.memory_id, m.access_count + coalesce(n, 0) AS access_count, n IS NOT NULL AS touched FROM memories m LEFT JOIN hit USING (memory_id)",
        "session_memory": """WITH late AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS k FROM conversations)
SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(count(*) FILTER (role <> 'system') AS INTEGER) AS n_turns, md5(coalesce(string_agg(role || ':' || text, chr(10) ORDER BY turn) FILTER (role <> 'system'), '')) AS turns_md5,
       coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'system' AND k <= 2), '') AS outputs FROM late GROUP BY 1""",
        "vector_upsert": "SELECT CAST(vec_id AS VARCHAR) AS memory_id, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS seq, round(CASE WHEN vec_id % 3 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) AS first FROM embeddings WHERE vec_id % 2 = 0 AND vec_id % 7 <> 0",
        "eval_retrieval": _evaluated() + "SELECT query_id, round(p1, 6) AS p1, round(p3, 6) AS p3, round(p5, 6) AS p5, round(r1, 6) AS r1, round(r3, 6) AS r3, round(r5, 6) AS r5, round(rr, 6) AS rr, round(ndcg5, 6) AS ndcg5 FROM quality",
        "eval_retrieval_summary": _evaluated()
        + ", mean AS (SELECT avg(p1) AS p1, avg(p3) AS p3, avg(p5) AS p5, avg(r1) AS r1, avg(r3) AS r3, avg(r5) AS r5, avg(rr) AS rr, avg(ndcg5) AS ndcg5 FROM quality) SELECT "
        + ", ".join(f"round({c}, 6) AS {c}" for c in ("p1", "p3", "p5", "r1", "r3", "r5", "rr", "ndcg5"))
        + ", "
        + ", ".join(f"round(CASE WHEN p{k} + r{k} > 0 THEN 2 * p{k} * r{k} / (p{k} + r{k}) ELSE 0 END, 6) AS f{k}" for k in (1, 3, 5))
        + " FROM mean",
        "eval_contradiction": f"""WITH {_JUDGED}, cases AS (SELECT contradicts AS c, x.toxic <> y.toxic AS t FROM judged JOIN labels x ON x.doc_id = doc_a JOIN labels y ON y.doc_id = doc_b),
n AS (SELECT count(*) FILTER (c AND t) AS tp, count(*) FILTER (c AND NOT t) AS fp, count(*) FILTER (NOT c AND t) AS fn, count(*) FILTER (NOT c AND NOT t) AS tn FROM cases),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS r FROM n)
SELECT tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM pr""",
        "eval_update": _matched() + "SELECT count(*) AS cases, round(avg(CASE WHEN coalesce(action, 'update') = CASE WHEN vec_id % 3 = 0 THEN 'create' ELSE 'update' END THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM matched",
        "stream_ingest": f"WITH o AS (SELECT 'u' || user_id AS user_id, event_type || ' ' || props AS content FROM events) SELECT user_id, count(*) AS n, round(sum({_importance('content')}), 4) AS importance FROM o GROUP BY 1",
        "stream_reflection_trigger": "SELECT 'u' || user_id AS user_id, 'user:u' || user_id AS namespace, unnest(range(10, count(*) + 1, 10)) AS n FROM events GROUP BY user_id",
        "stream_sessions": """WITH e AS (SELECT *, event_id % 3 = 0 AS tool, row_number() OVER (PARTITION BY user_id, event_id % 3 = 0 ORDER BY event_id DESC) AS k FROM events)
SELECT 'u' || user_id AS session_id, count(*) AS n_events, CAST(count(*) FILTER (NOT tool) AS INTEGER) AS n_turns, md5(coalesce(string_agg(event_type || ':' || props, chr(10) ORDER BY event_id) FILTER (NOT tool), '')) AS turns_md5,
       coalesce(string_agg(event_type || ':' || props, chr(10) ORDER BY event_id) FILTER (tool AND k <= 20), '') AS outputs FROM e GROUP BY user_id""",
        "eval_queries": """WITH q AS (SELECT printf('b%012d', item_id) AS query_id, text FROM benchmark UNION ALL SELECT printf('c%012d.%06d', conv_id, turn), text FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY query_id) AS k FROM q) SELECT query_id, md5(text) AS text_md5 FROM k WHERE k = 1""",
        "eval_saved": """SELECT 'update' AS eval_name, run_id, count(*) AS cases, round(avg(CASE WHEN event_type = guess THEN 1.0 ELSE 0.0 END), 6) AS accuracy, guess, 2 AS settings
FROM events, (VALUES ('r1', 'click'), ('r2', 'view')) g (run_id, guess) GROUP BY run_id, guess""",
        "embed_seeded": "SELECT doc_id, 1.0::DOUBLE AS norm, 64 AS dim FROM documents",
        "vector_cosine": "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine, round(a.embedding[1]::DOUBLE / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS first FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "text_jaccard": f"WITH w AS (SELECT doc_id, {_words('text')} AS w FROM documents) SELECT a.doc_id, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE END, 6) AS jaccard FROM w a JOIN w b ON b.doc_id = a.doc_id + 1",
        "decider_replies": """SELECT event_id, CASE WHEN event_id % 11 > 0 AND event_id % 3 > 0 THEN 'merge' ELSE 'skip' END AS action, CASE WHEN event_id % 11 > 0 AND event_id % 4 > 0 THEN event_type ELSE '' END AS reason,
       CASE WHEN event_id % 11 > 0 AND event_id % 5 > 0 THEN 'now ' || props END AS merged_content, round(CASE WHEN event_id % 11 > 0 AND event_id % 7 > 0 THEN coalesce(value, 0.8) ELSE 0.8 END::DOUBLE, 6) AS confidence FROM events""",
        "reflector_replies": """SELECT event_id, 0 AS place, event_type AS content, round(CASE WHEN event_id % 3 > 0 THEN coalesce(value, 0.7) ELSE 0.7 END::DOUBLE, 6) AS confidence, '0,' || (event_id % 4) AS support FROM events WHERE event_id % 5 > 0
UNION ALL SELECT event_id, 1, 'a habit', 0.9::DOUBLE, '' FROM events WHERE event_id % 5 > 0""",
        "retrieve_reranked": _retrieved() + "SELECT query_id, CAST(k AS INTEGER) AS rank, memory_id, semantic_score, composite_score, total_found FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_score, memory_id) AS k FROM kept) x WHERE k <= 5",
        "classify_reply": f"SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'other' END AS label, event_id % 2 = 0 AS contradicts, round(CASE WHEN {reply} THEN value ELSE 0.5 END::DOUBLE, 6) AS confidence, CASE WHEN event_id % 5 = 0 THEN 'direct_conflict' ELSE 'none' END AS kind, CAST(length('Is ' || event_type || ' like ' || props || '?') AS INTEGER) AS prompt_chars FROM events",
    }
