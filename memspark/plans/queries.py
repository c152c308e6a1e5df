"""The queries of the library over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark import fixtures as X
from memspark.config import Defaults
from memspark.functions import lexical, replies, scoring, vectors
from memspark.operators import catalog, consolidate, contradict, evaluate, graph, ingest, lexical_index, reflect, retrieve, sessions, update
from memspark.sources import tables
from memspark.streaming import jobs

#: The given vectors are nearly orthogonal, so queries on them ask for less.
LOW = 0.3


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.retrieve(X.vector_queries(spark, sf_dir), X.memories(spark, sf_dir), X.vectors(spark, sf_dir), X.as_of())


def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retrieved(spark, sf_dir).select("query_id", "rank", "memory_id", "semantic_score", "composite_score")


def retrieve_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = X.vector_queries(spark, sf_dir).withColumns({
        "top_k": F.lit(3), "min_importance": F.lit(0.45), "memory_layers": F.array(F.lit("semantic")), "memory_types": F.array(F.lit("fact"), F.lit("summary"), F.lit("reflection"), F.lit("nonsense")),
        "time_range_end": F.to_timestamp(F.lit("2024-01-01 05:00:00")), "namespace": F.lit("user:src"),
    })
    found = retrieve.retrieve(asked, X.memories(spark, sf_dir), X.vectors(spark, sf_dir), X.as_of())
    return found.select("query_id", "rank", "memory_id", "composite_score", "total_found", catalog.preview(F.col("content")).alias("preview"))


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.context_window(_retrieved(spark, sf_dir)).select("query_id", F.md5(F.col("api_context").cast("binary")).alias("api_md5"), F.length("context").alias("context_chars"))


def score_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.memories(spark, sf_dir)
    decay = F.when(F.col("doc_id") % 3 == 0, 0.0).when(F.col("doc_id") % 3 == 1, 24.0)
    score = scoring.recency(X.as_of(), F.col("updated_at"), F.col("created_at"), decay)
    return m.select("memory_id", F.round(score, 6).alias("recency"))


def score_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.memories(spark, sf_dir).select("memory_id", F.round("importance_score", 6).alias("importance"))


def score_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    semantic = (F.col("doc_id") % 100) / 100
    return X.memories(spark, sf_dir).select("memory_id", F.round(scoring.retrieval_score(semantic, X.as_of()), 6).alias("composite"))


def lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every memory of a query's user, by whole texts; each text is cut into tokens once, before the join."""
    m = X.memories(spark, sf_dir).select("memory_id", "user_id", *lexical.content_parts(F.col("content")))
    q = X.text_queries(spark, sf_dir).select("query_id", "user_id", *lexical.query_parts(F.col("query_text")))
    scores = lexical.scores_of_parts()
    return q.join(m, "user_id").select("query_id", "memory_id", *scores).select("query_id", "memory_id", *(F.round(c, 6).alias(c) for c in ("overlap", "keyword", "phrase")), F.round(lexical.total("overlap", "keyword", "phrase"), 6).alias("lexical"))


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best memories of each benchmark text's user by lexical score, through the index."""
    m = X.table(spark, sf_dir, "documents").select(F.col("source").alias("user_id"), F.col("doc_id").cast("string").alias("memory_id"), F.col("text").alias("content"))
    return lexical_index.top_k(X.text_queries(spark, sf_dir), m, 10)


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations, some of them with an empty content, an unknown type or an importance out of range."""
    o = X.observations(spark, sf_dir)
    n = F.substring("observation_id", 2, 20).cast("long")
    return o.withColumn("content", F.when(n % 17 == 0, "").otherwise(F.col("content"))).withColumn("memory_type", F.when(n % 19 == 0, "rumour").otherwise(F.col("memory_type"))).withColumn("importance_override", F.when(n % 23 == 0, 1.5).otherwise(F.col("importance_override")))


def ingest_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = ingest.ingest(_faulty(spark, sf_dir), X.as_of())
    return valid.select("namespace", "user_id", "memory_type", "memory_layer", "content", "source_ref", "event_time", F.round("importance_score", 6).alias("importance"), "status", "version").withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = ingest.ingest(_faulty(spark, sf_dir), X.as_of())
    return rejected.groupBy("reject_reason").agg(F.count("*").alias("n"))


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest_summary(*ingest.ingest(_faulty(spark, sf_dir), X.as_of()))


def list_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_memories(X.memories(spark, sf_dir), status="active", limit=10, offset=5).select("user_id", "memory_id", "place")


def user_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = catalog.user_stats(X.memories(spark, sf_dir)).join(catalog.count_active(X.memories(spark, sf_dir)), "user_id")
    return stats.select("user_id", "total_memories", F.array_join("namespaces", ",").alias("namespaces"), F.col("n").alias("active"))


def facts_of_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.table(spark, sf_dir, "customer").join(X.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    facts = c.select(
        F.concat(F.lit("f"), F.col("c_custkey")).alias("fact_id"), F.concat(F.lit("u"), F.col("c_custkey") % 10).alias("user_id"), F.col("c_name").alias("subject"), F.lit("lives_in").alias("predicate"),
        F.col("n_name").alias("object"), F.lit(1.0).alias("confidence"), F.when(F.col("c_custkey") % 5 == 0, "superseded").otherwise("active").alias("status"),
    )
    return catalog.facts_of_user(facts)


def operation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.memories(spark, sf_dir)
    before = m.filter("doc_id % 29 <> 0")
    after = catalog.soft_delete(consolidate.promote(m, X.as_of()).select(*m.columns), m.filter("doc_id % 13 = 0").select("memory_id"), X.as_of()).withColumn("access_count", F.col("access_count") + F.when(F.col("doc_id") % 31 == 0, 1).otherwise(0))
    return catalog.audit_log(before, after, X.as_of()).select("memory_id", "user_id", "operation")


def promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Defaults(promote_importance=0.45)
    return consolidate.promote(X.memories(spark, sf_dir), X.as_of(), d).select("memory_id", "memory_layer", "promoted")


def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creations, deletions and accesses of one hour, and new versions of the next."""
    m = X.memories(spark, sf_dir)
    before, n = m.filter("doc_id % 29 <> 0"), F.col("doc_id")
    middle = catalog.soft_delete(m, m.filter("doc_id % 13 = 0").select("memory_id"), X.as_of()).withColumn("access_count", F.col("access_count") + F.when(n % 31 == 0, 1).otherwise(0))
    after = middle.withColumn("status", F.when(n % 11 == 0, "archived").otherwise(F.col("status")))
    log = catalog.audit_log(before, middle, X.as_of()).unionByName(catalog.audit_log(middle, after, X.as_of() + F.expr("INTERVAL 1 HOUR")))
    return catalog.audit_trail(log).select("memory_id", "place", "operation")


def promote_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promotion stamps metadata, whether there is none, some, or an older stamp."""
    topic = (F.lit("topic"), F.col("memory_type"))
    held = F.when(F.col("doc_id") % 3 == 1, F.create_map(*topic)).when(F.col("doc_id") % 3 == 2, F.create_map(*topic, F.lit("promoted_at"), F.lit("old")))
    out = consolidate.promote(X.memories(spark, sf_dir).withColumn("metadata", held), X.as_of(), Defaults(promote_importance=0.45))
    at = lambda k: F.col("metadata")[k]
    return out.select("memory_id", at("topic").alias("topic"), at("promoted_from_episodic").alias("stamp"), (at("promoted_at") == "old").alias("old"), F.size("metadata").alias("entries"))


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidate.near_duplicate_pairs(X.memories(spark, sf_dir, "lang"), tables.materialise(X.text_vectors(spark, sf_dir), "vectors")).select("user_id", "a", "b", F.round("score", 5).alias("score"))


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return consolidate.consolidate(X.memories(spark, sf_dir, "lang"), tables.materialise(X.text_vectors(spark, sf_dir), "vectors"), X.as_of())


def merge_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[0].select("memory_id", "status", "merged_into", F.array_join("merged_ids", ",").alias("merged_ids"), "access_count")


def consolidation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)[1]


def contradiction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.memories(spark, sf_dir)
    found = contradict.candidates(m.filter("status = 'active'"), m, X.vectors(spark, sf_dir), Defaults(contradiction_from=LOW))
    return found.select("a", "b", "score")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that follow each other in one language."""
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    a, b = (docs.select((F.col("doc_id") + k).alias("k"), F.col("lang").alias(f"lang_{x}"), F.col("doc_id").alias(f"doc_{x}"), F.concat(F.when(F.col("doc_id") % 4 == k * 2, extra).otherwise(""), "text").alias(f"content_{x}")) for x, k, extra in (("a", 1, F.lit("user hates the ")), ("b", 0, F.lit("now joined "))))
    pairs = a.join(b, "k").filter("lang_a = lang_b").withColumn("a", F.col("doc_a").cast("string")).withColumn("b", F.col("doc_b").cast("string"))
    return contradict.judge(pairs)


def contradiction_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("a", "b", "overlap", "contradicts", "confidence")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_a") % 2 == 0, "temporal_update").otherwise("direct_conflict")
    return contradict.reports(_judged(spark, sf_dir).withColumn("contradiction_type", kind), X.as_of())


def contradiction_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contradict.apply_reports(X.memories(spark, sf_dir), _reports(spark, sf_dir))
    return out.select("memory_id", "contradiction_status", F.round("contradiction_confidence", 6).alias("confidence"), F.array_join("contradicted_by", ",").alias("contradicted_by"), "status")


def contradiction_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _reports(spark, sf_dir)
    chosen = found.filter(F.col("memory_a_id").cast("long") % 3 == 0).select("report_id", F.col("memory_b_id").alias("winning_memory_id"), F.lit("newer").alias("note"))
    _, memories = contradict.resolve(found, X.memories(spark, sf_dir), chosen, X.as_of())
    return memories.select("memory_id", "status")


def contradiction_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _reports(spark, sf_dir)
    chosen = found.filter(F.col("memory_a_id").cast("long") % 3 == 0).select("report_id", F.col("memory_b_id").alias("winning_memory_id"), F.lit("newer").alias("note"))
    closed, _ = contradict.resolve(found, X.memories(spark, sf_dir), chosen, X.as_of())
    return catalog.list_contradictions(closed, True).select("memory_a_id", "memory_b_id", "contradiction_type", "confidence", "resolution_note").join(contradict.contradiction_edges(closed).select(F.col("src").alias("low"), F.col("dst").alias("high")), (F.least("memory_a_id", "memory_b_id") == F.col("low")) & (F.greatest("memory_a_id", "memory_b_id") == F.col("high")))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = X.vector_queries(spark, sf_dir)
    contents = q.select(F.col("query_id").alias("decision_id"), "user_id", F.concat(F.lit("news of "), F.col("query_id")).alias("new_content"), "embedding")
    contents = contents.withColumn("own_memory_id", F.expr("substring(decision_id, 2)"))
    return update.match(contents, X.memories(spark, sf_dir), X.vectors(spark, sf_dir), Defaults(update_from=LOW)).drop("embedding", "own_memory_id")


def update_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("decision_id", "existing_memory_id", F.round("score", 6).alias("score"), "action")


def update_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("decision_id", 2, 20).cast("long") % 4
    matched = _matched(spark, sf_dir)
    action = F.element_at(F.array(*map(F.lit, ["skip", "update", "supersede", "merge"])), (k + 1).cast("int"))
    given = matched.select("decision_id", action.alias("action"), F.lit("by rule").alias("reason"), F.concat(F.lit("merged "), F.col("decision_id")).alias("merged_content"), F.lit(0.9).alias("confidence"))
    memories, _ = update.apply_decisions(X.memories(spark, sf_dir), update.decide(matched, given), X.as_of())
    return memories.select("user_id", F.md5(F.col("content").cast("binary")).alias("content_md5"), "status", "version", F.size("parent_memory_ids").alias("parents"))


def reflection_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reflect.due(X.memories(spark, sf_dir), Defaults(reflect_every=3)).select("user_id", "namespace", "n")


def reflection_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reflect.inputs(X.memories(spark, sf_dir, "lang"))
    return found.select("user_id", "namespace", F.array_join("ids", ",").alias("ids"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def reflection_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = reflect.inputs(X.memories(spark, sf_dir, "lang"))
    one = lambda content, confidence, *i: F.struct(F.lit(content).alias("content"), F.lit(confidence).cast("double").alias("confidence"), F.array(*map(F.lit, i)).alias("supporting_indices"))
    given = asked.select("user_id", "namespace", F.array(one("a habit", 0.9, 0, 2, 99), one("a wish", None, 1)).alias("reflections"))
    memories, _ = reflect.store(asked, given, X.as_of())
    return memories.select("user_id", "content", "memory_type", "memory_layer", F.col("confidence_score").alias("confidence"), F.array_join("parent_memory_ids", ",").alias("support"))


def graph_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = X.table(spark, sf_dir, "nation"), X.table(spark, sf_dir, "region")
    edge = lambda df, src, dst, rel: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(rel).alias("rel"))
    supplier = X.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    edges = edge(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "r_name", "in_region").unionByName(edge(supplier, "s_name", "n_name", "in_nation"))
    entities = edges.select(F.col("src").alias("entity_id")).union(edges.select("dst")).distinct()
    edges = graph.link(edges.withColumn("props", F.expr("map('w', '1')")), entities)
    return graph.related(nation.select(F.col("n_name").alias("entity_id")), edges)


def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's parent is that of half its number."""
    m = X.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("memory_id"), F.when(F.col("doc_id") > 0, F.array(F.floor(F.col("doc_id") / 2).cast("string"))).otherwise(F.array().cast("array<string>")).alias("parent_memory_ids"))
    return graph.ancestors(m)


def access_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A memory was touched if it was returned: its count is raised. Its time says less, as one may have been made at that very time."""
    m = X.memories(spark, sf_dir).withColumn("before", F.col("access_count"))
    out = retrieve.access_feedback(m, _retrieved(spark, sf_dir), X.as_of())
    return out.select("memory_id", "access_count", (F.col("access_count") > F.col("before")).alias("touched"))


def session_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "tool").otherwise("turn")
    events = c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), kind.alias("kind"), F.col("role").alias("role_or_tool"), F.col("text").alias("content"))
    found = sessions.working_memory(events, Defaults(tool_outputs=2))
    return found.select("session_id", F.size("turns").alias("n_turns"), F.md5(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n").cast("binary")).alias("turns_md5"), F.array_join(F.transform("tool_outputs", lambda x: x["output"]), "\n").alias("outputs"))


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.vectors(spark, sf_dir).withColumn("seq", F.lit(1))
    n = F.col("memory_id").cast("long")
    changed = v.filter(n % 3 == 0).withColumn("embedding", F.transform("embedding", lambda x: -x)).withColumn("seq", F.lit(2))
    out = tables.upsert_vectors(v, changed, v.filter(n % 7 == 0))
    return tables.get_vectors(out, v.filter(n % 2 == 0)).select("memory_id", "seq", F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = X.vector_queries(spark, sf_dir)
    held = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("memory_id"), "label").join(X.memories(spark, sf_dir).select("memory_id", "user_id"), "memory_id")
    relevance = q.select("query_id", "label", "user_id").join(held, ["label", "user_id"])
    return evaluate.per_query(q, _retrieved(spark, sf_dir).select("query_id", "memory_id", "rank"), relevance)


def eval_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _evaluated(spark, sf_dir)
    return rows.select("query_id", *(F.round(c, 6).alias(c) for c in rows.columns if c != "query_id"))


def eval_retrieval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluate.summary(_evaluated(spark, sf_dir))
    return rows.select(*(F.round(c, 6).alias(c) for c in rows.columns))


def eval_contradiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = X.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = _judged(spark, sf_dir).join(labels.toDF("doc_a", "toxic_a"), "doc_a").join(labels.toDF("doc_b", "toxic_b"), "doc_b")
    rows = evaluate.contradiction_quality(j.select("contradicts", (F.col("toxic_a") != F.col("toxic_b")).alias("is_contradiction")))
    return rows.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def eval_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _matched(spark, sf_dir).select(F.coalesce("action", F.lit("update")).alias("action"), F.when(F.substring("decision_id", 2, 20).cast("long") % 3 == 0, "create").otherwise("update").alias("expected_action"))
    return evaluate.update_accuracy(cases).select("cases", F.round("accuracy", 6).alias("accuracy"))


def eval_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts and first turns as questions; the first of each text stays, the benchmark's before the turns."""
    asked = X.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.format_string("%012d", "item_id")).alias("query_id"), F.col("text").alias("query_text"))
    harder = X.table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.format_string("%012d.%06d", F.col("conv_id"), F.col("turn"))).alias("query_id"), F.col("text").alias("query_text"))
    return evaluate.first_of_text(asked.unionByName(harder), "query_id").select("query_id", F.md5(F.col("query_text").cast("binary")).alias("text_md5"))


def eval_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended to the table of evaluations, and read back."""
    path = f"{tables.new_folder(spark, 'evals')}/table"
    for run, kind in (("r1", "click"), ("r2", "view")):
        cases = X.table(spark, sf_dir, "events").select(F.lit(kind).alias("action"), F.col("event_type").alias("expected_action"))
        evaluate.eval_row(evaluate.update_accuracy(cases), "update", run, {"guess": kind, "k": "5"}, X.as_of()).write.mode("append").parquet(path)
    metric = lambda name, kind: F.get_json_object("metrics", f"$.{name}").cast(kind)
    return spark.read.parquet(path).select("eval_name", "run_id", metric("cases", "long").alias("cases"), F.round(metric("accuracy", "double"), 6).alias("accuracy"), F.col("config")["guess"].alias("guess"), F.size("config").alias("settings"))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet" if name == "events" else "*.parquet").parquet(sf_dir if name == "events" else f"{sf_dir}/{name}.parquet")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files, ingested into a table."""
    events = _stream(spark, sf_dir, "events")
    o = events.select(
        F.concat(F.lit("e"), F.col("event_id")).alias("observation_id"), F.concat(F.lit("s"), F.col("user_id") % 10).alias("session_id"), F.concat(F.lit("u"), F.col("user_id")).alias("user_id"), F.lit("agent").alias("agent_id"),
        F.concat_ws(" ", "event_type", "props").alias("content"), F.lit("user_message").alias("source_type"), F.col("ts").cast("timestamp").alias("observed_at"), F.lit("observation").alias("memory_type"), F.lit(None).cast("double").alias("importance_override"),
    )
    path = tables.new_folder(spark, "stream-ingest")
    jobs.stream_ingest(o, X.as_of(), f"{path}/table", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/table").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("importance_score"), 4).alias("importance"))


def _drain(spark: SparkSession, df: DataFrame, label: str, mode: str) -> DataFrame:
    """All of a stream's output, appended to a table batch by batch."""
    path = tables.new_folder(spark, label)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, k: batch.write.mode("append").parquet(f"{path}/table")).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/table")


def stream_reflection_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("user_id"), F.concat(F.lit("user:u"), F.col("user_id")).alias("namespace"), F.lit("active").alias("status"))
    return _drain(spark, jobs.reflection_triggers(events), "stream-trigger", "append")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("session_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "tool").otherwise("turn").alias("kind"), F.col("event_type").alias("role_or_tool"), F.col("props").alias("content"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    jobs.keep_state_in_rocksdb(spark)
    try:
        updates = _drain(spark, jobs.session_updates(events, idle=None), "stream-sessions", "update")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    last = jobs.whole_sessions(updates)
    joined = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat(x[a], F.lit(":"), x[b])), "\n")
    return last.select("session_id", "n_events", F.size("turns").alias("n_turns"), F.md5(joined("turns", "role", "content").cast("binary")).alias("turns_md5"), joined("tool_outputs", "tool", "output").alias("outputs"))


def embed_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.embed(X.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), dim=64)
    return out.select("doc_id", F.round(vectors.norm(F.col("embedding")), 4).alias("norm"), F.size("embedding").alias("dim"))


def vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(other, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"), F.round(F.get(vectors.normalise(F.col("embedding")), F.lit(0)), 6).alias("first"))


def text_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next")), "doc_id").select("doc_id", F.round(lexical.jaccard(F.col("text"), F.col("next")), 6).alias("jaccard"))


def classify_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events")
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct((F.col("event_id") % 2 == 0).alias("contradicts"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("confidence"), F.when(F.col("event_id") % 5 == 0, "odd").alias("contradiction_type"))), F.lit("\n```"))
    r = replies.contradiction_reply(reply)
    label = replies.classify(F.concat(F.lit(" "), F.upper("event_type")), ["other", "click", "view", "purchase"])
    return e.select("event_id", label.alias("label"), r["contradicts"].alias("contradicts"), F.round(r["confidence"], 6).alias("confidence"), r["contradiction_type"].alias("kind"), F.length(replies.prompt("Is {a} like {b}?", a=F.col("event_type"), b=F.col("props"))).alias("prompt_chars"))


def decider_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update decisions from fenced, bare, partial and broken replies."""
    e, n = X.table(spark, sf_dir, "events"), F.col("event_id")
    whole = F.to_json(F.struct(F.when(n % 3 > 0, "merge").alias("action"), F.when(n % 4 > 0, F.col("event_type")).alias("reason"), F.when(n % 5 > 0, F.concat(F.lit("now "), "props")).alias("merged_content"), F.when(n % 7 > 0, F.col("value")).alias("confidence")))
    reply = F.when(n % 11 == 0, "I can't say").when(n % 2 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)
    r = replies.update_reply(reply)
    return e.select("event_id", r["action"].alias("action"), r["reason"].alias("reason"), r["merged_content"].alias("merged_content"), F.round(r["confidence"], 6).alias("confidence"))


def reflector_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each reflection of a reply; those without content go."""
    e, n = X.table(spark, sf_dir, "events"), F.col("event_id")
    item = lambda content, confidence, indices: F.struct(content.alias("content"), confidence.alias("confidence"), indices.alias("supporting_indices"))
    items = F.array(item(F.col("event_type"), F.when(n % 3 > 0, F.col("value")), F.array(F.lit(0), (n % 4).cast("int"))), item(F.when(n % 2 == 0, F.lit("")), F.lit(0.5), F.array(F.lit(1))), item(F.lit("a habit"), F.lit(0.9), F.lit(None).cast("array<int>")))
    reply = F.concat(F.lit("```\n"), F.to_json(F.struct(F.when(n % 5 > 0, items).alias("reflections"))), F.lit("\n```"))
    found = e.select("event_id", F.posexplode(replies.reflections_reply(reply)).alias("place", "x"))
    return found.select("event_id", "place", F.col("x.content").alias("content"), F.round("x.confidence", 6).alias("confidence"), F.array_join("x.supporting_indices", ",").alias("support"))


def retrieve_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval with a reranker of one's own: the least similar candidates first."""

    def farthest(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("semantic_score", "memory_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= F.col("top_k")).select("query_id", "memory_id", "rank")

    out = retrieve.retrieve(X.vector_queries(spark, sf_dir), X.memories(spark, sf_dir), X.vectors(spark, sf_dir), X.as_of(), reranker=farthest)
    return out.select("query_id", "rank", "memory_id", "semantic_score", "composite_score", "total_found")


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    retrieve_topk, retrieve_full, context_window, score_recency, score_importance, score_composite, lexical_score, lexical_topk, ingest_memories, ingest_rejects, ingest_summary, list_memories, user_stats, facts_of_user,
    operation_log, audit_trail, promote, promote_metadata, near_duplicate_pairs, merge_similar, consolidation_summary, contradiction_candidates, contradiction_judge, contradiction_apply, contradiction_resolve, contradiction_list, update_match,
    update_apply, reflection_due, reflection_input, reflection_store, graph_related, version_chain, access_feedback, session_memory, vector_upsert, eval_retrieval, eval_retrieval_summary, eval_contradiction,
    eval_update, eval_queries, eval_saved, stream_ingest, stream_reflection_trigger, stream_sessions, embed_seeded, vector_cosine, text_jaccard, classify_reply,
    decider_replies, reflector_replies, retrieve_reranked,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
