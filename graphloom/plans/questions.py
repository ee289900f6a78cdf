"""Questions: their intent, domain and keywords, the tags they hint at, fallbacks, and the ranking of what is retrieved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import rules as R
from graphloom.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Words that tell the domain of a question.
DOMAINS = R.lists("""
    vacuum: vacuum, autovacuum, analyze, freeze, wraparound
    wal: wal, write-ahead, log, checkpoint, recovery, replay
    mvcc: mvcc, transaction, isolation, snapshot, visibility, xid
    query-planning: planner, optimizer, execution, plan, cost, statistics
    memory: shared_buffers, memory, cache, buffer, palloc, malloc
    replication: replication, standby, primary, streaming, logical, physical
    storage: heap, toast, page, tuple, relation, tablespace
    indexes: btree, index, gin, gist, brin, hash, spgist
    locking: lock, deadlock, lightweight, spinlock, lwlock, heavyweight
    parallel: parallel, worker, background, gather, partition
    partition: partition, partitioning, pruning, constraint
    jsonb: jsonb, json, document, key-value
    security: authentication, authorization, scram, password, role, grant
    background: autovacuum, bgwriter, checkpointer, walwriter, archiver
    extension: extension, hook, plugin, contrib
    performance: performance, bottleneck, slow, optimization, tuning
""")
# Patterns of the intents.
INTENTS = R.lists(r"""
    find-function: \bfind\b, \bsearch\b, \blocate\b, \bidentify\b, \bwhich function\b, \bwhat function\b, \blist.*function\b
    explain-concept: \bhow does\b, \bwhat is\b, \bexplain\b, \bdescribe\b, \bwhy does\b, \bwhat role\b, \bwhat.*purpose\b
    security-check: \bsecurity\b, \bvulnerability\b, \bunsafe\b, \brisk\b, \battack\b, \bexploit\b, \bbuffer overflow\b
    code-analysis: \banalyze\b, \bcheck\b, \breview\b, \binspect\b, \bdata flow\b, \btaint\b, \breachable\b
""")
# Words of code, and topics of the domains.
CODE_TERMS = "function method call struct class pointer memory buffer array loop variable parameter return malloc free".split()
TOPICS = R.lists("""
    vacuum: autovacuum, vacuum, maintenance
    wal: wal, recovery, replication
    mvcc: transaction, concurrency, isolation
    query-planning: planner, optimizer, execution
    memory: memory, buffer, cache
    indexes: index, btree, access-method
""")
# The tags each domain hints at, by layer.
HINTS = {
    "subsystems": R.lists("""
        vacuum: autovacuum, vacuum
        wal: wal, xlog
        mvcc: snapshot, visibility, procarray
        query-planning: optimizer, planner, executor
        memory: mem, aset, mcxt
        replication: replication, walreceiver, walsender
        storage: storage, smgr, md
        indexes: nbtree, index, access
        locking: lock, lmgr
        parallel: parallel, shm_mq
        jsonb: jsonb, json
        background: bgworker, postmaster
        security: auth, scram, ssl
        partition: partition, partdesc
    """),
    "function_purposes": R.lists("""
        vacuum: utilities, storage-access
        wal: wal-logging, storage-access
        mvcc: transaction-control, concurrency-control
        query-planning: query-planning, query-execution
        memory: memory-management, utilities
        replication: networking, wal-logging
        storage: storage-access, utilities
        indexes: query-execution, storage-access
        locking: concurrency-control, transaction-control
        parallel: query-execution, utilities
        security: networking, utilities
        partition: query-planning, storage-access
        error: error-handling, utilities
        catalog: catalog-access, utilities
    """),
    "data_structures": R.lists("""
        vacuum: relation, buffer
        wal: buffer, queue
        mvcc: relation, buffer
        query-planning: binary-tree, array
        memory: array, linked-list
        indexes: binary-tree, hash-table, array
        locking: hash-table, queue
        parallel: queue, array
        security: hash-table, array
        partition: array, relation
    """),
    "algorithms": R.lists("""
        vacuum: mark-sweep, reference-counting
        query-planning: dynamic-programming, cost-based
        indexes: binary-search, hashing
        locking: two-phase-locking, deadlock-detection
        parallel: producer-consumer, work-stealing
    """),
    "domain_concepts": R.lists("""
        vacuum: vacuum
        wal: vacuum
        mvcc: mvcc
        query-planning: jit, parallelism
        replication: replication
        indexes: mvcc
        locking: mvcc
        parallel: parallelism
        security: extension
        partition: partitioning
        extension: extension
        foreign-data: foreign-data
    """),
    "architectural_roles": R.lists("""
        vacuum: maintenance-component
        wal: logging-component
        mvcc: concurrency-component
        query-planning: execution-component
        memory: resource-management
        replication: replication-component
        storage: storage-component
        indexes: access-method
        background: background-service
    """),
    "api_categories": R.lists("""
        memory: memory-management, allocation
        locking: synchronization, concurrency
        io: file-io, buffer-management
        networking: connection-handling
        error: error-handling
    """),
}
# Words of keywords that add a structure, a feature, or without a domain a purpose or concept.
STRUCTURES = {k: k for k in "btree hash list array tree queue".split()}
FEATURES = {k: k.upper() for k in "mvcc wal vacuum toast jsonb parallel partition".split()}
PURPOSES = {"manage": "management", "allocate": "allocation", "store": "storage", "retrieve": "retrieval", "process": "processing", "execute": "execution", "optimize": "optimization", "maintain": "maintenance", "track": "tracking", "monitor": "monitoring"}
CONCEPTS = {k: k for k in "transaction buffer cache connection session tuple table index".split()}
PLAIN_STRUCTURES = {k: k for k in "buffer list array hash tree".split()}
# Patterns of keywords and the tags they stand for; the later of two equal patterns holds.
KEYWORD_TAGS = [
    tuple(line.split(" => "))
    for line in r"""
\b(allocat|alloc|malloc)\w* => function-purpose => memory-management
\b(free|dealloc)\w* => function-purpose => memory-management
\b(lock|unlock|mutex|spinlock)\w* => function-purpose => locking
\b(read|write|io)\w* => function-purpose => io-operations
\b(parse|parsing)\w* => function-purpose => parsing
\b(hash|hashing)\w* => function-purpose => hashing
\b(search|find|lookup)\w* => function-purpose => search
\b(insert|add|append)\w* => function-purpose => insertion
\b(delete|remove)\w* => function-purpose => deletion
\b(update|modify)\w* => function-purpose => update
\b(init|initialize)\w* => function-purpose => initialization
\b(cleanup|clean)\w* => function-purpose => cleanup
\b(validate|check)\w* => function-purpose => validation
\b(lwlock|heavyweight.*lock)\w* => function-purpose => locking
\b(bgwriter|checkpointer)\w* => function-purpose => background-process
\b(stat.*collect|statistics)\w* => function-purpose => monitoring
\b(elog|ereport|log)\w* => function-purpose => logging
\b(assert|abort|panic)\w* => function-purpose => error-handling
\b(vacuum|autovacuum)\w* => domain-concept => vacuum
\b(wal|xlog)\w* => domain-concept => wal
\b(transaction|xact)\w* => domain-concept => transaction
\b(snapshot|visibility)\w* => domain-concept => mvcc
\b(buffer|page)\w* => data-structure => buffer-page
\b(index|btree|gin|gist)\w* => domain-concept => indexing
\b(planner|optimizer)\w* => domain-concept => query-planning
\b(executor|execution)\w* => domain-concept => execution
\b(checkpoint|checkpointing)\w* => domain-concept => checkpoint
\b(recovery|replay)\w* => domain-concept => recovery
\b(brin|bloom|spgist|hash.*index)\w* => domain-concept => indexing
\b(toast|oversized|datum)\w* => domain-concept => storage
\b(clog|slru|commit.*log)\w* => domain-concept => transaction
\b(replication|standby|primary)\w* => domain-concept => replication
\b(xid|multixact|transaction.*id)\w* => domain-concept => transaction
\b(fsm|visibility.*map|free.*space)\w* => domain-concept => storage
\b(mvcc|multi.*version)\w* => domain-concept => mvcc
\b(catalog|syscache|catcache)\w* => domain-concept => catalog
\bautovacuum\b => subsystem-name => autovacuum
\bvacuum\b => subsystem-name => vacuum
\bstorage\b => subsystem-name => storage
\bwal\b => subsystem-name => wal
\bbuffer\b => subsystem-name => buffer
\bbgwriter\b => subsystem-name => background-writer
\bcheckpointer\b => subsystem-name => checkpointer
\bpostmaster\b => subsystem-name => postmaster
\breplication\b => subsystem-name => replication
\b(heap|tuple)\w* => data-structure => heap-tuple
\b(hash\s*table)\w* => data-structure => hash-table
\b(list|array)\w* => data-structure => list
\b(tree|btree)\w* => data-structure => tree
\b(snapshot|snap)\w* => data-structure => snapshot
\b(syscache|catcache|catalog.*cache)\w* => data-structure => catalog-cache
\b(relcache|relation.*cache)\w* => data-structure => relation-cache
\b(shmem|shared.*memory)\w* => data-structure => shared-memory
\b(proc.*array|backend.*array)\w* => data-structure => process-array
""".strip().splitlines()
]

_DOMAIN_WORDS = list(dict.fromkeys(w for ws in DOMAINS.values() for w in ws))
_Q = "lower(question)"


def keywords_of(c: Column) -> Column:
    """Names in camel and snake case, quoted terms, acronyms and words of the domains: the first ten, sorted."""
    found = [F.regexp_extract_all(c, F.lit(p), F.lit(g)) for p, g in ((r"\b[a-z]+[A-Z][a-zA-Z]*\b", 0), (r"\b[a-z]+_[a-z_]+\b", 0), ("[\"']([^\"']+)[\"']", 1), (r"\b[A-Z]{2,}\b", 0))]
    words = F.array_compact(F.array(*[F.when(F.lower(c).contains(w), w) for w in _DOMAIN_WORDS]))
    every = F.filter(F.array_distinct(F.concat(*found, words)), lambda k: F.trim(k) != "")
    return F.slice(F.array_sort(every), 1, 10)


_NAMES_SQL = r'''regexp_extract_all(question, '\b[a-z]+[A-Z][a-zA-Z]*\b') || regexp_extract_all(question, '\b[a-z]+_[a-z_]+\b') || regexp_extract_all(question, '["'']([^"'']+)["'']', 1) || regexp_extract_all(question, '\b[A-Z]{2,}\b')'''
_KEYWORDS = f"list_sort(list_distinct(list_filter({_NAMES_SQL} || list_filter([" + ", ".join(f"case when contains({_Q}, '{w}') then '{w}' end" for w in _DOMAIN_WORDS) + "], lambda x: x is not null), lambda x: trim(x) <> '')))[1:10]"
_DOMAIN_SQL, _TOP_SQL = R.best_sql("q", DOMAINS, "general")
_INTENT_SQL, _ = R.best_sql("q", INTENTS, "explain-concept", True)
#: The analysis of all questions, for the SQL of the queries below.
_ANALYSED = f"with l as (select qa_key, question, {_Q} as q, {_KEYWORDS} as kws from all_qa_merged where question is not null), an as (select *, {_DOMAIN_SQL} as domain, {_TOP_SQL} as top, {_INTENT_SQL} as intent, list_transform(kws, lambda k: lower(k)) as low from l)"


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_qa_merged").where("question is not null").select("qa_key", "question")


def analysed(df: DataFrame) -> DataFrame:
    """Adds intent, domain, the hits of the domain, keywords and keywords in lower case to ``question``."""
    q = F.lower("question")
    domain, top = R.best(q, DOMAINS, "general")
    kws = keywords_of(F.col("question"))
    return df.withColumns({"domain": domain, "top": top, "intent": R.best(q, INTENTS, "explain-concept", True)[0], "kws": kws}).withColumn("low", F.transform("kws", lambda k: F.lower(k)))


@query(_ANALYSED + " select qa_key, intent from an")
def fn_classify_intent(spark: SparkSession, d: str) -> DataFrame:
    """The intent of most matching patterns; ties go to the first, none to explaining."""
    return analysed(questions(spark, d)).select("qa_key", "intent")


@query(_ANALYSED + " select qa_key, domain, case when top = 0 then 0.3 else least(0.5 + top * 0.2, 1.0) end::double as confidence from an")
def fn_identify_domain(spark: SparkSession, d: str) -> DataFrame:
    confidence = F.when(F.col("top") == 0, 0.3).otherwise(F.least(0.5 + F.col("top") * 0.2, F.lit(1.0)))
    return analysed(questions(spark, d)).select("qa_key", "domain", confidence.alias("confidence"))


@query(_ANALYSED + " select qa_key, kws as keywords from an")
def fn_extract_keywords(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("qa_key", keywords_of(F.col("question")).alias("keywords"))


@query(_ANALYSED + f" select qa_key, {R.hits_sql('q', CODE_TERMS)} > 0 as code_terms from an")
def fn_has_code_terms(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("qa_key", R.holds_any(F.lower("question"), CODE_TERMS).alias("code_terms"))


_CONFIDENCE = "least((case when top = 0 then 0.3 else least(0.5 + top * 0.2, 1.0) end::double) * 0.6 + least(len(kws) * 0.05, 0.3)::double + case when intent <> 'explain-concept' then 0.1 else 0.0 end::double, 1.0)"


@query(_ANALYSED + f" select qa_key, round({_CONFIDENCE}, 6) as confidence from an")
def fn_analysis_confidence(spark: SparkSession, d: str) -> DataFrame:
    a = analysed(questions(spark, d))
    return a.select("qa_key", F.round(confidence_of_analysis(), 6).alias("confidence"))


def confidence_of_analysis() -> Column:
    domain = F.when(F.col("top") == 0, 0.3).otherwise(F.least(0.5 + F.col("top") * 0.2, F.lit(1.0)))
    return F.least(domain * 0.6 + F.least(F.size("kws") * 0.05, F.lit(0.3)) + F.when(F.col("intent") != "explain-concept", 0.1).otherwise(0.0), F.lit(1.0))


@query(_ANALYSED + f" select qa_key, intent, domain, len(kws) as keywords, round({_CONFIDENCE}, 6) as confidence, length(question) as question_length from an")
def batch_analyze(spark: SparkSession, d: str) -> DataFrame:
    """The whole analysis of every question."""
    return analysed(questions(spark, d)).select("qa_key", "intent", "domain", F.size("kws").alias("keywords"), F.round(confidence_of_analysis(), 6).alias("confidence"), F.length("question").alias("question_length"))


@query(_ANALYSED + f", t as (select qa_key, case when domain = 'general' then null when domain in ({', '.join(repr(k) for k in TOPICS)}) then {R.looked_up_sql('domain', TOPICS)} else [domain] end as topics from an) select qa_key, topics from t")
def fn_domain_filter(spark: SparkSession, d: str) -> DataFrame:
    """Topics to filter by; none for a question without a domain, the domain itself where no list is given."""
    domain = F.col("domain")
    topics = F.when(domain == "general", None).when(domain.isin(*TOPICS), R.looked_up(domain, TOPICS)).otherwise(F.array(domain))
    return analysed(questions(spark, d)).select("qa_key", topics.alias("topics"))


@query(_ANALYSED + """ select r.ragas_key, coalesce(nullif(json_extract_string(try_cast(nullif(regexp_extract(r.ground_truth, '\\{[^}]+\\}'), '') as json), '$.intent'), ''), an.intent) as intent, case when json_extract_string(try_cast(nullif(regexp_extract(r.ground_truth, '\\{[^}]+\\}'), '') as json), '$.intent') is not null then 0.8 else round(""" + _CONFIDENCE + ", 6) end as confidence from ragas_dataset r join an using (qa_key)")
def analyze_llm(spark: SparkSession, d: str) -> DataFrame:
    """The intent a model's text names in a JSON object, trusted at 0.8; else that of the rules."""
    said = F.get_json_object(F.regexp_extract("ground_truth", r"\{[^}]+\}", 0), "$.intent")
    rows = table(spark, d, "ragas_dataset").select("ragas_key", "qa_key", said.alias("said")).join(analysed(questions(spark, d)), "qa_key")
    return rows.select("ragas_key", F.coalesce(F.nullif("said", F.lit("")), "intent").alias("intent"), F.when(F.col("said").isNotNull(), 0.8).otherwise(F.round(confidence_of_analysis(), 6)).alias("confidence"))


# ---- hints

_BASE = ", b as (select qa_key, question, q, kws, low, domain, intent, " + ", ".join(f"{R.looked_up_sql('domain', t)} as {k}" for k, t in HINTS.items()) + " from an)"
_STRUCT_SQL, _FEAT_SQL = R.matching_sql("low", STRUCTURES), R.matching_sql("low", FEATURES)
_WORDED = f", k as (select * replace (list_distinct_ordered(data_structures || {_STRUCT_SQL}) as data_structures), {_FEAT_SQL} as features from b)".replace("list_distinct_ordered(data_structures || ", "data_structures || list_filter(").replace(") as data_structures)", ", lambda x: not list_contains(data_structures, x)) as data_structures)")
_EMPTY_SQL = "domain = 'general' and " + " and ".join(f"len({k}) = 0" for k in [*HINTS, "features"])
_GENERAL = f", h as (select * replace (case when {_EMPTY_SQL} then {R.matching_sql('low', PURPOSES)} else function_purposes end as function_purposes, case when {_EMPTY_SQL} then {R.matching_sql('low', CONCEPTS)} else domain_concepts end as domain_concepts, case when {_EMPTY_SQL} then {R.matching_sql('low', PLAIN_STRUCTURES)} else data_structures end as data_structures) from k)"
_PAIRS_SQL = "(" + " || ".join(f"list_transform({c}, lambda v: '{t}=' || v)" for c, t in (("function_purposes", "function-purpose"), ("data_structures", "data-structure"), ("domain_concepts", "domain-concept"), ("features", "Feature"))) + ")"
_COVERAGE_SQL = "(" + " + ".join(f"(len({k}) > 0)::int" for k in [*HINTS, "features"]) + ")"
_HINTED = _ANALYSED + _BASE + _WORDED + _GENERAL + f", g as (select *, {_PAIRS_SQL} as tags, {_COVERAGE_SQL} / 8.0 as coverage from h)"
_LAYERS = [*HINTS, "features"]


def _named(tag: str):
    return lambda v: F.concat(F.lit(tag + "="), v)


def hinted(df: DataFrame) -> DataFrame:
    """Adds the eight layers of hints, the tags they filter by (as name=value) and the share of layers filled."""
    a = analysed(df)
    b = a.withColumns({k: R.looked_up(F.col("domain"), t) for k, t in HINTS.items()})
    more = R.matching(F.col("low"), STRUCTURES)
    k = b.withColumns({"data_structures": F.array_distinct(F.concat("data_structures", more)), "features": R.matching(F.col("low"), FEATURES)})
    empty = reduce(lambda x, y: x & y, [F.size(c) == 0 for c in _LAYERS]) & (F.col("domain") == "general")
    k = k.withColumn("bare", empty)
    fill = lambda c, t: F.when(F.col("bare"), R.matching(F.col("low"), t)).otherwise(F.col(c))
    h = k.withColumns({"function_purposes": fill("function_purposes", PURPOSES), "domain_concepts": fill("domain_concepts", CONCEPTS), "data_structures": fill("data_structures", PLAIN_STRUCTURES)})
    pairs = [F.transform(c, _named(t)) for c, t in (("function_purposes", "function-purpose"), ("data_structures", "data-structure"), ("domain_concepts", "domain-concept"), ("features", "Feature"))]
    covered = reduce(lambda x, y: x + y, [(F.size(c) > 0).cast("int") for c in _LAYERS]) / 8.0
    return h.withColumns({"tags": F.concat(*pairs), "coverage": covered})


@query(_HINTED + " select qa_key, subsystems, algorithms, architectural_roles, api_categories, function_purposes, data_structures, domain_concepts, features from g")
def hints(spark: SparkSession, d: str) -> DataFrame:
    return hinted(questions(spark, d)).select("qa_key", "subsystems", "algorithms", "architectural_roles", "api_categories", "function_purposes", "data_structures", "domain_concepts", "features")


@query(_ANALYSED + f" select qa_key, {_STRUCT_SQL} as structures, {_FEAT_SQL} as features from an")
def hints_keyword(spark: SparkSession, d: str) -> DataFrame:
    a = analysed(questions(spark, d))
    return a.select("qa_key", R.matching(F.col("low"), STRUCTURES).alias("structures"), R.matching(F.col("low"), FEATURES).alias("features"))


@query(_ANALYSED + f" select qa_key, {R.matching_sql('low', PURPOSES)} as purposes, {R.matching_sql('low', CONCEPTS)} as concepts, {R.matching_sql('low', PLAIN_STRUCTURES)} as structures from an")
def hints_general(spark: SparkSession, d: str) -> DataFrame:
    low = F.col("low")
    return analysed(questions(spark, d)).select("qa_key", R.matching(low, PURPOSES).alias("purposes"), R.matching(low, CONCEPTS).alias("concepts"), R.matching(low, PLAIN_STRUCTURES).alias("structures"))


@query("select * from (values " + ", ".join(f"('{layer}', '{k}', {i + 1}, '{v}')" for layer, t in HINTS.items() for k, vs in t.items() for i, v in enumerate(vs)) + ") x(layer, domain, place, hint)")
def domain_hints(spark: SparkSession, d: str) -> DataFrame:
    """The hint table in long form."""
    rows = [(layer, k, i + 1, v) for layer, t in HINTS.items() for k, vs in t.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "layer string, domain string, place int, hint string")


_FRAGMENT = "'_.tag.nameExact(\"' || split_part({t}, '=', 1) || '\").valueExact(\"' || split_part({t}, '=', 2) || '\")'"


def fragment(tag: Column) -> Column:
    return F.concat(F.lit('_.tag.nameExact("'), F.split_part(tag, F.lit("="), F.lit(1)), F.lit('").valueExact("'), F.split_part(tag, F.lit("="), F.lit(2)), F.lit('")'))


@query(_HINTED + f" select qa_key, list_transform(tags, lambda t: {_FRAGMENT.format(t='t')}) as filters from g")
def hint_filters(spark: SparkSession, d: str) -> DataFrame:
    """Purposes, structures, concepts and features as conditions of a traversal."""
    return hinted(questions(spark, d)).select("qa_key", F.transform("tags", fragment).alias("filters"))


@query(_HINTED + " select qa_key, coverage::double as coverage, case when coverage < 0.4 then (coverage * 8 + (len(tags) > 0)::int) / 9.0 else coverage end::double as with_tags from g")
def hint_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Layers filled of eight; after a fallback the tags count as a ninth."""
    later = F.when(F.col("coverage") < 0.4, (F.col("coverage") * 8 + (F.size("tags") > 0).cast("int")) / 9.0).otherwise(F.col("coverage"))
    return hinted(questions(spark, d)).select("qa_key", "coverage", later.alias("with_tags"))


_JOINED = "array_to_string(low, chr(10))"
_KEYTAG_SQL = "list_filter([" + ", ".join("case when regexp_matches({j}, '{p}') then '{n}={v}' end".format(j=_JOINED, p=p.replace(".*", "[^\\n]*"), n=n, v=v) for p, n, v in KEYWORD_TAGS) + "], lambda x: x is not null)"


def keyword_tag_list(low: Column) -> Column:
    """Tags of the patterns that some keyword fits, in the order of the patterns, once each."""
    joined = F.array_join(low, "\n")
    return F.array_distinct(F.array_compact(F.array(*[F.when(joined.rlike(p), f"{n}={v}") for p, n, v in KEYWORD_TAGS])))


_MORE_SQL = f"(select list(t order by i) from (select t, min(i) as i from (select unnest({_KEYTAG_SQL}) as t, generate_subscripts({_KEYTAG_SQL}, 1) as i) where not list_contains(g.tags, t) group by 1))"


@query(_HINTED + f" select qa_key, coalesce({_MORE_SQL}, []::varchar[]) as added from g")
def keyword_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags that keywords stand for and the hints lack."""
    return hinted(questions(spark, d)).select("qa_key", F.array_except(keyword_tag_list(F.col("low")), F.col("tags")).alias("added"))


def hybrid(keyword: Column, tag: Column, domain: Column) -> Column:
    """Up to three traversals that combine a name, or the domain's files, with a tag."""
    k, t = keyword.isNotNull(), tag.isNotNull()
    like = F.concat(F.lit('".*'), keyword, F.lit('.*"'))
    where = F.concat(F.lit(".where("), fragment(tag), F.lit(").name.l"))
    name = F.split_part(tag, F.lit("="), F.lit(1))
    return F.array_compact(F.array(
        F.when(k & t, F.concat(F.lit("cpg.method.name("), like, F.lit(")"), where)),
        F.when((domain != "general") & t, F.concat(F.lit('cpg.file.name(".*'), domain, F.lit('.*").method'), where)),
        F.when(k & t, F.concat(F.lit('cpg.method.where(_.tag.nameExact("'), name, F.lit('")).where(_.name('), like, F.lit(")).name.l"))),
    ))


_TAG1 = _FRAGMENT.format(t="tags[1]")


@query(_HINTED + f" select qa_key, list_filter([case when len(kws) > 0 and len(tags) > 0 then 'cpg.method.name(\".*' || kws[1] || '.*\").where(' || {_TAG1} || ').name.l' end, case when domain <> 'general' and len(tags) > 0 then 'cpg.file.name(\".*' || domain || '.*\").method.where(' || {_TAG1} || ').name.l' end, case when len(kws) > 0 and len(tags) > 0 then 'cpg.method.where(_.tag.nameExact(\"' || split_part(tags[1], '=', 1) || '\")).where(_.name(\".*' || kws[1] || '.*\")).name.l' end], lambda x: x is not null) as patterns from g")
def hybrid_patterns(spark: SparkSession, d: str) -> DataFrame:
    h = hinted(questions(spark, d))
    return h.select("qa_key", hybrid(F.try_element_at("kws", F.lit(1)), F.try_element_at("tags", F.lit(1)), F.col("domain")).alias("patterns"))


# Purposes that a question without a domain is given.
BROAD = ["function-purpose=initialization", "function-purpose=cleanup", "function-purpose=validation", "function-purpose=processing"]


@query(_HINTED + f", f as (select *, tags || coalesce({_MORE_SQL}, []::varchar[]) as more from g), e as (select *, case when domain = 'general' then more || {R.quoted(BROAD)}[1:greatest(0, least(4, 10 - len(more)))] else more end as every from f) select qa_key, case when coverage < 0.4 then every else tags end as tags, coverage < 0.4 as applied from e")
def fallback_apply(spark: SparkSession, d: str) -> DataFrame:
    """Where fewer than 0.4 of the layers are filled: tags of the keywords, then broad purposes up to ten tags."""
    h = hinted(questions(spark, d))
    more = F.concat("tags", F.array_except(keyword_tag_list(F.col("low")), F.col("tags")))
    broad = F.when(F.col("domain") == "general", F.slice(R.strings(BROAD), F.lit(1), F.greatest(F.lit(0), F.least(F.lit(4), 10 - F.size("more"))))).otherwise(R.strings([]))
    low = F.col("coverage") < 0.4
    return h.withColumn("more", more).select("qa_key", F.when(low, F.concat("more", broad)).otherwise(F.col("tags")).alias("tags"), low.alias("applied"))


_EXAMPLE_SQL = f"case when split_part(t, '=', 1) in ('function-purpose', 'data-structure') then 'cpg.method.where(' || {_FRAGMENT.format(t='t')} || ').name.l.take(10)' when split_part(t, '=', 1) = 'Feature' then 'cpg.file.where(' || {_FRAGMENT.format(t='t')} || ').name.l.take(10)' else 'cpg.method.where(' || {_FRAGMENT.format(t='t')} || ').l.take(10)' end"


@query(_HINTED + f" select qa_key, list_transform(tags[1:5], lambda t: {_EXAMPLE_SQL}) as examples from g")
def hint_examples(spark: SparkSession, d: str) -> DataFrame:
    """A traversal for each of the first five tags."""

    def one(t: Column) -> Column:
        name = F.split_part(t, F.lit("="), F.lit(1))
        of = lambda root, end: F.concat(F.lit(f"cpg.{root}.where("), fragment(t), F.lit(end))
        return F.when(name.isin("function-purpose", "data-structure"), of("method", ").name.l.take(10)")).when(name == "Feature", of("file", ").name.l.take(10)")).otherwise(of("method", ").l.take(10)"))

    return hinted(questions(spark, d)).select("qa_key", F.transform(F.slice("tags", 1, 5), one).alias("examples"))


_SECTIONS = [("Features", "features"), ("Relevant Subsystems", "subsystems"), ("Function Purposes", "function_purposes"), ("Data Structures", "data_structures"), ("Domain Concepts", "domain_concepts")]


@query(_HINTED + " select qa_key, array_to_string(list_filter([" + ", ".join(f"case when len({c}) > 0 then '{n}: ' || array_to_string({c}, ', ') end" for n, c in _SECTIONS) + "], lambda x: x is not null), chr(10)) as prompt from g")
def hints_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The filled layers as lines of a prompt."""
    lines = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.concat(F.lit(n + ": "), F.array_join(c, ", "))) for n, c in _SECTIONS]))
    return hinted(questions(spark, d)).select("qa_key", F.array_join(lines, "\n").alias("prompt"))


@query(_ANALYSED + " select qa_key, array_to_string(list_filter([question, case when domain <> 'general' then 'domain ' || domain end, case when len(kws) > 0 then array_to_string(kws[1:5], ' ') end, case when intent = 'security-check' then 'error handling' end], lambda x: x is not null), ' ') as search_text from an")
def search_query_text(spark: SparkSession, d: str) -> DataFrame:
    """What is searched for: the question, its domain, five keywords and a word for the intent."""
    parts = F.array_compact(F.array(F.col("question"), F.when(F.col("domain") != "general", F.concat(F.lit("domain "), "domain")), F.when(F.size("kws") > 0, F.array_join(F.slice("kws", 1, 5), " ")), F.when(F.col("intent") == "security-check", "error handling")))
    return analysed(questions(spark, d)).select("qa_key", F.array_join(parts, " ").alias("search_text"))


# ---- ranking of what is retrieved: each record's candidates are the runs over it


def ranked(df: DataFrame, group: str, score: str, key: str, k: int) -> DataFrame:
    """The best ``k`` of each group by score; groups of ``k`` or fewer keep the order of their keys."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    order = Window.partitionBy(group).orderBy(F.when(F.col("_n") > k, -F.round(F.col(score), 9)).otherwise(0.0), key)
    return df.withColumn("_n", n).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("_n")


_CANDIDATES = ", c as (select r.ragas_key, r.qa_key, coalesce(r.answer, '') as text, lower(coalesce(r.answer, '')) as low_text, lower(coalesce(r.ground_truth, '')) as told, r.model_run, (r.ragas_key * 37 % 100) / 100.0 as similarity, g.* exclude (qa_key, question, q) from ragas_dataset r join g using (qa_key))"
_RANKED = " select qa_key, ragas_key, place from (select *, row_number() over (partition by qa_key order by case when n > {k} then -round(score, 9) else 0.0 end, ragas_key) as place from (select *, count(*) over (partition by qa_key) as n from s)) where place <= {k}"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "ragas_dataset").select("ragas_key", "qa_key", F.coalesce("answer", F.lit("")).alias("text"), F.lower(F.coalesce("answer", F.lit(""))).alias("low_text"), F.lower(F.coalesce("ground_truth", F.lit(""))).alias("told"), "model_run", ((F.col("ragas_key") * 37 % 100) / 100.0).alias("similarity"))
    return r.join(hinted(questions(spark, d)), "qa_key")


@query(_HINTED + _CANDIDATES + ", s as (select *, similarity * case when model_run like '%1' then 1.1 else 1.0 end as score from c)" + _RANKED.format(k=2))
def rerank_qa(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a trusted source weigh a tenth more (here: runs whose name ends in 1)."""
    c = candidates(spark, d).withColumn("score", F.col("similarity") * F.when(F.col("model_run").endswith("1"), 1.1).otherwise(1.0))
    return ranked(c, "qa_key", "score", "ragas_key", 2).select("qa_key", "ragas_key", "place")


_EXAMPLE_SCORE = "similarity * case when domain <> 'general' and contains(low_text, domain) then 1.3 else 1.0 end * (1.0 + 0.1 * len(list_filter(low, lambda k: contains(low_text, k) or contains(told, k)))) * case when contains(text, '.tag.') then 1.2 else 1.0 end * case when intent = 'find-function' and contains(told, 'method') or intent = 'security-check' and contains(told, 'security') then 1.2 else 1.0 end * case when length(text) > 100 then 1.1 else 1.0 end"


@query(_HINTED + _CANDIDATES + f", s as (select *, {_EXAMPLE_SCORE} as score from c)" + _RANKED.format(k=2))
def rerank_examples(spark: SparkSession, d: str) -> DataFrame:
    """Similarity times boosts: 1.3 for the domain, a tenth for every keyword, 1.2 for use of tags, 1.2 for the category
    of the intent, 1.1 for fitting length."""
    c, low, told = candidates(spark, d), F.col("low_text"), F.col("told")
    met = F.size(F.filter("low", lambda k: F.contains(low, k) | F.contains(told, k)))
    category = ((F.col("intent") == "find-function") & told.contains("method")) | ((F.col("intent") == "security-check") & told.contains("security"))
    boost = lambda hit, by: F.when(hit, by).otherwise(1.0)
    score = F.col("similarity") * boost((F.col("domain") != "general") & F.contains(low, F.col("domain")), 1.3) * (1.0 + 0.1 * met) * boost(F.col("text").contains(".tag."), 1.2) * boost(category, 1.2) * boost(F.length("text") > 100, 1.1)
    return ranked(c.withColumn("score", score), "qa_key", "score", "ragas_key", 2).select("qa_key", "ragas_key", "place")


_BOOSTS = [("subsystems", 1.3), ("function_purposes", 1.15), ("data_structures", 1.15), ("domain_concepts", 1.2), ("features", 1.1)]
_ENRICH_SCORE = "similarity * " + " * ".join(f"case when len(list_filter({c}, lambda v: contains(low_text, lower(v)) or contains(told, lower(v)))) > 0 then {b} else 1.0 end" for c, b in _BOOSTS) + " * case when contains(low_text, '.tag.') then 1.2 else 1.0 end"


def enriched_score() -> Column:
    """Each layer of hints boosts once where one of its values occurs."""
    low, told = F.col("low_text"), F.col("told")
    out = F.col("similarity")
    for c, b in _BOOSTS:
        out = out * F.when(F.exists(c, lambda v: F.contains(low, F.lower(v)) | F.contains(told, F.lower(v))), b).otherwise(1.0)
    return out * F.when(low.contains(".tag."), 1.2).otherwise(1.0)


@query(_HINTED + _CANDIDATES + f", s as (select *, {_ENRICH_SCORE} as score from c)" + _RANKED.format(k=2))
def rerank_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return ranked(candidates(spark, d).withColumn("score", enriched_score()), "qa_key", "score", "ragas_key", 2).select("qa_key", "ragas_key", "place")


@query(_HINTED + _CANDIDATES + f", o as (select * from (select *, row_number() over (partition by qa_key order by -round(similarity, 9), ragas_key) as r0 from c) where r0 <= 10), s as (select *, {_ENRICH_SCORE} as score from o)" + _RANKED.format(k=5))
def retrieve_enriched(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar, ranked anew by the hints, the best five."""
    first = Window.partitionBy("qa_key").orderBy(-F.round("similarity", 9), "ragas_key")
    over = candidates(spark, d).withColumn("r0", F.row_number().over(first)).where("r0 <= 10")
    return ranked(over.withColumn("score", enriched_score()), "qa_key", "score", "ragas_key", 5).select("qa_key", "ragas_key", "place")


@query(_HINTED + _CANDIDATES + " select qa_key, count(*) as retrieved, round(avg(similarity), 6) as mean_similarity, max(domain <> 'general') as domain_known from c group by 1")
def retrieve_stats(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).groupBy("qa_key").agg(F.count(F.lit(1)).alias("retrieved"), F.round(F.avg("similarity"), 6).alias("mean_similarity"), F.max(F.col("domain") != "general").alias("domain_known"))


@query(_ANALYSED + " select md5(concat_ws('|', trim(question), domain, intent, array_to_string(list_sort(kws), ','), '3', '5')) as cache_key, count(*) as n from an group by 1")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    """Questions by the key of their cache entry: text, domain, intent, sorted keywords and how many are asked for."""
    key = F.md5(F.concat_ws("|", F.trim("question"), "domain", "intent", F.array_join(F.array_sort("kws"), ","), F.lit("3"), F.lit("5")))
    return analysed(questions(spark, d)).groupBy(key.alias("cache_key")).agg(F.count(F.lit(1)).alias("n"))


@query(_HINTED + " select domain, count(*) as total, count(*) filter (where coverage >= 0.4) as valid, round(avg(coverage), 6) as coverage from g group by 1")
def agg_domain_validity(spark: SparkSession, d: str) -> DataFrame:
    return hinted(questions(spark, d)).groupBy("domain").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("coverage") >= 0.4).alias("valid"), F.round(F.avg("coverage"), 6).alias("coverage"))
