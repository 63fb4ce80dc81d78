"""Named queries over requests, answers, documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leeward.functions.numeric import quantize
from leeward.operators import audit, search
from leeward.plans.catalog import q6, query
from leeward.plans.exposure_queries import near_cities
from leeward.plans.weather_queries import CITY_PAIRS
from leeward.sources.fixtures import Tables, with_views

# an answer log derived from orders; urgent ones name a number their result does not hold
ANSWERS = """select o_orderkey as answer_id, o_orderpriority as topic,
    concat('P exceed is ', cast(o_custkey % 100 as string), case when o_orderkey % 2 = 0 then ',5' else '.5' end, ' percent for ', cast(cast(floor(o_totalprice) as bigint) as string), ' people',
      case when o_orderpriority = '1-URGENT' then concat(' within ', cast(o_orderkey % 90 + 10 as string), ' km') else '' end,
      case when o_orderstatus <> 'P' then '. Comparative tool, not a crisis forecast.' else '.' end) as answer from {orders}"""
RESULTS = """select o_orderkey as answer_id, o_custkey % 100 + cast(0.5 as double) as value from {orders}
    union all select o_orderkey, cast(floor(o_totalprice) as double) from {orders}"""

# a question log derived from all user turns of conversations
QUESTIONS = """select conv_id * 1000 + turn as question_id, case when conv_id % 2 = 0 then 'en' else 'pl' end as lang, concat(case conv_id % 6
      when 0 then 'How likely is it that a release will contaminate the town? ' when 1 then 'Co oznacza ten próg? '
      when 2 then 'What is the method, and how many people are exposed? ' when 3 then 'Czy uwolnienie skazi miasto i dlaczego? '
      when 4 then 'Which cities lie in the way? ' else '' end, text) as question, conv_id % 6 as site_no, (conv_id + turn) % 7 as slip
    from {conversations} where role = 'user'"""


def answers(t: Tables) -> DataFrame:
    return t.spark.sql(ANSWERS, orders=t.read("orders"))


def questions(t: Tables) -> DataFrame:
    return t.spark.sql(QUESTIONS, conversations=t.read("conversations"))


def plain(text: str) -> str:
    return text.replace("{orders}", "orders").replace("{conversations}", "conversations")


@query(f"""with a as ({plain(ANSWERS)}), r as ({plain(RESULTS)}),
    said as (select distinct answer_id, cast(replace(unnest(regexp_extract_all(answer, '[0-9]+(?:[.,][0-9]+)?')), ',', '.') as double) as number from a),
    wrong as (select s.answer_id, count(*) as n from said s where not exists (
      select 1 from r where r.answer_id = s.answer_id and r.value = s.number) group by 1)
    select a.answer_id, coalesce(w.n, 0) as n_unsupported, case when w.n > 0 then 'rejected' else 'accepted' end as verdict
    from a left join wrong w on w.answer_id = a.answer_id""")
def answer_audit(t: Tables) -> DataFrame:
    results = t.spark.sql(RESULTS, orders=t.read("orders"))
    return audit.audited(answers(t), results).select("answer_id", "n_unsupported", "verdict")


@query(f"""with a as ({plain(ANSWERS)}) select topic, count(*) as n_missing from a
    where not contains(lower(answer), 'comparative tool, not a crisis forecast') group by 1""")
def limitation_check(t: Tables) -> DataFrame:
    return audit.missing_limitation(answers(t)).groupBy("topic").agg(F.count(F.lit(1)).alias("n_missing"))


def cue_sql(cues) -> str:
    return " or ".join(f"contains(lower(question), '{c}')" for c in cues)


@query(f"""with q as ({plain(QUESTIONS)}) select lang, case when n and m then 'mixed' when n then 'numbers' when m then 'method' else 'other' end as intent,
    count(*) as n_questions from (select *, {cue_sql(audit.NUMBER_CUES)} as n, {cue_sql(audit.METHOD_CUES)} as m from q) group by 1, 2""")
def intent_counts(t: Tables) -> DataFrame:
    return audit.intent(questions(t)).groupBy("lang", "intent").agg(F.count(F.lit(1)).alias("n_questions"))


EVAL = """select question_id, lang, site_no >= 4 as expects_refusal, cast(site_no * 1.5 as double) as expected_value,
    (site_no >= 4 and slip <> 3) or (site_no = 1 and slip = 5) as refused, cast(site_no * 1.5 + (case when slip = 2 then 1 else 0 end) as double) as value"""


@query(f"""with q as ({plain(QUESTIONS)}), e as ({EVAL} from q) select lang, cast(expects_refusal as bigint) as refusal_class, count(*) as n_questions,
    count(*) filter (ok) as n_right, {q6('avg(cast(ok as int))')} as accuracy from (select *, case when expects_refusal then refused
      else not refused and value = expected_value end as ok from e) group by 1, 2""")
def eval_report(t: Tables) -> DataFrame:
    log = t.spark.sql(EVAL + " from {q}", q=questions(t))
    joined = audit.eval_join(log.select("question_id", "lang", "expects_refusal", "expected_value"),
                             log.select("question_id", "refused", "value"))
    out = audit.execution_accuracy(joined.withColumn("refusal_class", F.col("expects_refusal").cast("bigint")), ["lang", "refusal_class"])
    return out.withColumn("accuracy", quantize(F.col("accuracy")))


# spellings a city answers to; one that several cities share has no id
ALIASES = """(select alias_key, case when count(distinct c_custkey) = 1 then min(c_custkey) end as city_id from (
    select lower(c_name) as alias_key, c_custkey from customer union all select concat('gdansk-', c_custkey % 900), c_custkey from customer) group by 1) a
    on a.alias_key = translate(lower(trim(r.city_alias)), 'ń', 'n')"""


def resolved(t: Tables) -> DataFrame:
    return audit.resolve_alias(t.requests(), audit.city_aliases(t.cities(), aliases="aliases"))


@query(with_views("v_requests", f"""select r.request_id, r.city_alias, a.city_id, case when a.city_id is not null then 'found'
    when a.alias_key is not null then 'ambiguous' else 'unknown' end as alias_status from v_requests r left join {ALIASES}"""))
def alias_resolution(t: Tables) -> DataFrame:
    return resolved(t).select("request_id", "city_alias", "city_id", "alias_status")


@query(with_views("v_requests v_sites v_cities", f"""select r.request_id, r.site_no, a.city_id, case when n.city_id is null then 'not_modelled' else 'modelled' end as answer_status
    from v_requests r left join {ALIASES}
    left join near n on n.site_no = r.site_no and n.city_id = a.city_id""", {"near": CITY_PAIRS}))
def request_status(t: Tables) -> DataFrame:
    return audit.answerable(resolved(t), near_cities(t)).select("request_id", "site_no", "city_id", "answer_status")


@query(with_views("v_requests v_sites v_cities", f"""select r.site_no, count(*) as n_refused
    from v_requests r left join {ALIASES}
    where not exists (select 1 from near n where n.site_no = r.site_no and n.city_id = a.city_id) group by 1""", {"near": CITY_PAIRS}))
def unmodelled_requests(t: Tables) -> DataFrame:
    return audit.not_modelled(resolved(t), near_cities(t)).groupBy("site_no").agg(F.count(F.lit(1)).alias("n_refused"))


@query("""with w as (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> '') as words from documents),
    c as (select doc_id, words, unnest(range(greatest(0, cast(ceil((len(words) - 200) / 160.0) as bigint)) + 1)) as chunk_no from w where len(words) > 0),
    p as (select doc_id, chunk_no, words[chunk_no * 160 + 1 : chunk_no * 160 + 200] as part from c)
    select doc_id, chunk_no, len(part) as n_words, md5(concat_ws(':', cast(doc_id as varchar), cast(chunk_no as varchar), array_to_string(part, ' '))) as chunk_id from p""")
def doc_chunks(t: Tables) -> DataFrame:
    return search.chunk(t.read("documents"), 200, 40).select("doc_id", "chunk_no", "n_words", "chunk_id")


@query(f"""with parts as (select label, generate_subscripts(embedding, 1) as pos, cast(unnest(embedding) as double) as x from embeddings),
    means as (select label, pos, avg(x) as m from parts group by 1, 2),
    cent as (select label as query_id, list(m order by pos) as qv from means group by 1),
    scored as (select query_id, vec_id, list_sum(list_transform(range(1, 65), lambda i: qv[i] * cast(embedding[i] as double))) as score from cent, embeddings)
    select cast(query_id as bigint) as query_id, vec_id, {q6('score')} as score, place from (select *, row_number() over (partition by query_id order by score desc, vec_id) as place from scored)
    where place <= 10""")
def knn_top10(t: Tables) -> DataFrame:
    """The ten vectors nearest to the mean of each label, over all vectors."""
    vectors = t.read("embeddings")
    queries = search.centroids(vectors).withColumnRenamed("label", "query_id")
    out = search.knn(queries, vectors, 10)
    return out.select(F.col("query_id").cast("bigint").alias("query_id"), "vec_id", quantize(F.col("score")).alias("score"),
                      F.col("place").cast("bigint").alias("place"))
