"""Retrieval over documents, chat history and chunk builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import alerts as al
from granary.operators import reports as rp
from granary.operators import retrieval as rt
from granary.plans import inputs
from granary.plans.memo import remembered
from granary.plans.queries_fraud import rule_and_statistical_alerts
from granary.plans.queries_reports import SHOWN_CTES, shown
from granary.plans.registry import query
from granary.plans.sql import MEMBERS, OUTLETS, with_
from granary.plans.sql import half_even as r
from granary.sources import fixtures

# Common words of the test languages, passed to the operator and to the SQL alike.
STOP_WORDS = ["the", "and", "of", "to", "in", "is", "it", "that", "le", "la", "et", "un", "une", "der", "die", "das"]
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _terms_sql(name: str, table: str, key: str) -> str:
    return f"""{name}_words as (select {key}, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w not in ({_STOP})) as w
  from {table} where text is not null),
{name} as (select {key}, term, count(*) as uses from (
  select {key}, unnest(w) as term from {name}_words
  union all select {key}, w[i] || ' ' || w[i + 1] as term from (select {key}, w, unnest(range(1, len(w))) as i from {name}_words))
  group by 1, 2)"""


DOC_TERMS = _terms_sql("doc_terms", "documents", "doc_id")
VOCAB = """vocab as (select *, ln((1.0::double + (select count(*) from documents)) / (1.0::double + docs)) + 1.0::double as idf from (
  select term, sum(uses) as total, count(*) as docs from doc_terms group by 1))"""


def _weights_sql(name: str, terms: str, key: str) -> str:
    return f"""{name} as (select {key}, term, raw / sqrt(sum(raw * raw) over (partition by {key})) as weight
  from (select t.{key}, t.term, t.uses * v.idf as raw from {terms} t join vocab v using (term)))"""


INDEX = _weights_sql("index", "doc_terms", "doc_id")
ASKED = (
    "questions as (select item_id as question_id, text from benchmark),\n"
    + _terms_sql("q_terms", "questions", "question_id")
    + ",\n"
    + _weights_sql("asked", "q_terms", "question_id")
)


def _retrieve_sql(pool: str) -> str:
    return f"""pool as ({pool}),
found as (select question_id, doc_id, {r("sum(a.weight * i.weight)", 6)} as similarity from asked a join index i using (term)
  where doc_id in (select doc_id from pool) group by 1, 2),
everything as (select q.question_id, p.doc_id, coalesce(similarity, 0.0::double) as similarity
  from questions q cross join pool p left join found f on f.question_id = q.question_id and f.doc_id = p.doc_id),
answers as (select * from (select question_id, cast(row_number() over (partition by question_id order by similarity desc, doc_id) as integer) as rank,
  doc_id, similarity from everything) where rank <= 6)"""


def documents(spark, d):
    return fixtures.table(spark, d, "documents")


@remembered
def doc_terms(spark, d):
    return inputs.keep(rt.terms(documents(spark, d), "doc_id", STOP_WORDS))


@remembered
def vocab(spark, d):
    return inputs.keep(rt.vocabulary(doc_terms(spark, d), "doc_id", documents(spark, d)))


@remembered
def index(spark, d):
    return inputs.keep(rt.weights(doc_terms(spark, d), vocab(spark, d), "doc_id"))


@remembered
def blocks(spark, d):
    return inputs.keep(rt.blocked_weights(doc_terms(spark, d), vocab(spark, d)))


def questions(spark, d):
    return fixtures.table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")


@query("document_terms", "T2", with_(DOC_TERMS) + "select * from doc_terms")
def q_terms(spark, d):
    return doc_terms(spark, d)


@query(
    "document_vocabulary",
    "T3",
    with_(DOC_TERMS, VOCAB) + "select term, cast(total as bigint) as total, docs, idf from vocab",
    doubles=["idf"],
)
def q_vocab(spark, d):
    return vocab(spark, d)


@query("tfidf_weights", "T4", with_(DOC_TERMS, VOCAB, INDEX) + "select * from index", doubles=["weight"], digits=7)
def q_weights(spark, d):
    return index(spark, d)


@query(
    "retrieve_documents",
    "T5 K7",
    with_(DOC_TERMS, VOCAB, INDEX, ASKED, _retrieve_sql("select doc_id from documents"))
    + "select question_id, rank, doc_id, source, similarity from answers join documents using (doc_id)",
)
def q_retrieve(spark, d):
    return rt.retrieve(documents(spark, d), None, vocab(spark, d), questions(spark, d), stop_words=STOP_WORDS, blocks=blocks(spark, d))


@query(
    "retrieve_documents_of_sources",
    "T5",
    with_(DOC_TERMS, VOCAB, INDEX, ASKED, _retrieve_sql("select doc_id from documents where source in ('src1', 'src7')"))
    + "select question_id, rank, doc_id, source, similarity from answers join documents using (doc_id)",
)
def q_retrieve_sources(spark, d):
    return rt.retrieve(
        documents(spark, d), None, vocab(spark, d), questions(spark, d), sources=["src1", "src7"], stop_words=STOP_WORDS,
        blocks=blocks(spark, d),
    )


@query(
    "retrieval_context",
    "T6",
    with_(DOC_TERMS, VOCAB, INDEX, ASKED, _retrieve_sql("select doc_id from documents"))
    + f"""select question_id, string_agg('[' || rank || '] (source: ' || source || ', relevance: ' || {r("similarity", 2)} || ')' || chr(10) || text,
       chr(10) || chr(10) order by rank) as context from answers join documents using (doc_id) group by 1""",
)
def q_context(spark, d):
    return rt.context(q_retrieve(spark, d), documents(spark, d))


@query(
    "store_stats",
    "T7",
    with_(DOC_TERMS, VOCAB)
    + """select source, count(*) as documents, (select count(*) from documents) as total_documents,
       (select count(*) from vocab) as vocabulary from documents group by 1""",
)
def q_stats(spark, d):
    return rt.store_stats(documents(spark, d), vocab(spark, d))


def history(spark, d):
    return fixtures.table(spark, d, "conversations").withColumnRenamed("conv_id", "session_id")


@query(
    "recent_messages",
    "W9 T8",
    """select session_id, turn, role, text from (select conv_id as session_id, turn, role, text,
       row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn <= 3""",
)
def q_recent(spark, d):
    return rt.recent_messages(history(spark, d), 3)


@query(
    "chat_sessions",
    "T8 W9",
    "select conv_id as session_id, count(*) as messages, max(turn) as last_turn from conversations group by 1",
)
def q_sessions(spark, d):
    return rt.sessions(history(spark, d))


@query(
    "cleared_sessions",
    "T8",
    """select conv_id as session_id, count(*) as messages, max(turn) as last_turn from conversations
       where conv_id not in (select doc_id from labels where toxic = 1) group by 1""",
)
def q_clear(spark, d):
    """Sessions whose number is a document marked toxic are the ones to clear."""
    marked = fixtures.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("session_id"))
    return rt.sessions(rt.clear_sessions(history(spark, d), marked))


@query(
    "network_chunks",
    "T1",
    with_(OUTLETS, MEMBERS)
    + """select 'outlets_overview' as doc_id, 'Network: ' || count(*) || ' outlets, ' || count(*) filter (is_active) || ' active, in '
       || count(distinct region) || ' regions.' as text, 'outlets' as source from outlets
     union all select 'outlets_region_' || region, 'Region ' || region || ': ' || count(*) || ' outlets, ' || count(*) filter (is_active) || ' active.',
       'outlets_by_region' from outlets group by region
     union all select 'members_overview', 'Members: ' || count(*) || ' registered in ' || count(distinct region) || ' regions.', 'members' from members""",
)
def q_network_chunks(spark, d):
    return rt.network_chunks(fixtures.outlets(spark, d), fixtures.members(spark, d))


@query(
    "alert_chunks",
    "T1 G18",
    with_(*SHOWN_CTES)
    + """, reg as (select shown_region, count(*) as n from shown where shown_region <> 'Unknown' group by 1),
      pat as (select shown_region, pattern, count(*) as n, row_number() over (partition by shown_region order by count(*) desc, pattern) as p
        from shown where shown_region <> 'Unknown' group by 1, 2),
      three as (select shown_region, string_agg(pattern || ': ' || n, ', ' order by p) as patterns from pat group by 1)
     select 'alert_summary' as doc_id, 'Alert summary: ' || count(*) || ' alerts, ' || count(*) filter (severity = 'Critical') || ' critical, '
       || count(*) filter (severity = 'High') || ' high, ' || count(*) filter (severity = 'Medium') || ' medium, '
       || count(*) filter (severity = 'Low') || ' low, ' || count(*) filter (model = 'rings') || ' rings.' as text, 'alert_summary' as source from alerts
     union all select 'alerts_by_region', 'Alerts by region: ' || string_agg(shown_region || ': ' || n, '; ' order by n desc, shown_region) || '.',
       'alerts_by_region' from reg
     union all select 'alerts_region_' || shown_region, 'Region ' || shown_region || ': ' || n || ' alerts. Main patterns: ' || patterns || '.', 'alerts_by_region'
       from reg join three using (shown_region)
     union all select 'alerts_by_pattern', 'Alerts by pattern: ' || string_agg(pattern || ': ' || n, '; ' order by n desc, pattern) || '.', 'alerts_by_pattern'
       from (select pattern, count(*) as n from shown group by 1)
     union all select 'alert_' || alert_id, 'Alert (' || severity || '): outlet ' || outlet_id || ' in ' || region || ', pattern ' || pattern || '.', 'alerts'
       from (select * from alerts where severity in ('Critical', 'High'))""",
)
def q_alert_chunks(spark, d):
    found = rule_and_statistical_alerts(spark, d)
    return rt.alert_chunks(
        al.alert_summary(found, inputs.features(spark, d)), shown(spark, d), rp.severe_alerts(found, None)
    )
