"""Registered queries over the collection, its topics and its judgments, with their SQL equivalents."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.languages import LANGUAGES, name_of
from ..operators import codeswitch, ordering, passages, retrieval, topics, translation
from ..session import shared_dir, stored, table
from ..sources import files, markup, sinks

#: Where the public tokenizers lie.
TOKENIZERS = os.environ.get("BABELFRAME_TOKENIZERS", "/opt/tokenizers")
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- SQL fragments -----------------------------------------------------------------------------------------------------------------------------
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'), ' ')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _terms(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


_WINDOWS = f"""d as (select doc_id, case when {_clean('text')} = '' then [] else string_split({_clean('text')}, ' ') end w from documents where text is not null),
p as (select doc_id, cast(k as int) k, array_to_string(w[k * 90 + 1 : k * 90 + 180], ' ') passage
      from (select doc_id, w, unnest(case when len(w) <= 90 then [0] else range(0, (len(w) + 89) // 90) end) k from d))"""
_TOPICS = f"""t0 as (select row_no, topic_id, unnest(topics) t, generate_subscripts(topics, 1) a from topics where topic_id is not null),
t1 as (select row_no, a, topic_id, t.lang lang, coalesce({_strip('t.topic_title')}, '') title, coalesce({_strip('t.topic_description')}, '') description from t0 where t is not null and t.lang is not null),
tl as (select topic_id, lang, title, description, first_row from
       (select *, row_number() over (partition by topic_id, lang order by row_no desc, a desc) r, min(row_no) over (partition by topic_id, lang) first_row from t1) where r = 1)"""
_JUDGED = f"""jl as (select distinct right(file_name, 3) lang, w[1] query_id from (select file_name, string_split({_clean('raw_line')}, ' ') w from qrels_lines) where len(w) = 4 and w[4] <> '0')"""
_PAIRS = "pairs as (select distinct try_cast(substr(query_id, 2) as int) qid, doc_id from qrels where try_cast(relevance as int) <> 0 and doc_id is not null and try_cast(substr(query_id, 2) as int) is not null)"
_LEXICON = _TOPICS + f"""
, lw as (select e.topic_id, string_split({_clean('e.title')}, ' ') a, string_split({_clean('g.title')}, ' ') b from tl e join tl g using (topic_id) where e.lang = 'eng' and g.lang = 'deu' and {_clean('e.title')} <> '' and {_clean('g.title')} <> ''),
lp as (select lower(a[i]) word, lower(b[i]) cand from (select a, b, unnest(range(1, least(len(a), len(b)) + 1)) i from lw)),
lc as (select word, cand, n, row_number() over (partition by word order by n desc, cand) r from (select word, cand, count(*) n from lp group by 1, 2)),
lex as (select word, list(cand order by r) candidates from lc where r <= 3 group by word)"""
_EN = "en as (select lang || '/' || query_id || '/' || coll_year row_key, max(titles) \"text\" from process_queries where lang = 'en' and query_id is not null and titles is not null and coll_year is not null group by 1)"


_WORDS = r"regexp_extract_all(x, '[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]')"


def _switch(probability: float, seed: int, words: bool = False) -> str:
    cut = _WORDS if words else "case when c = '' then [] else string_split(c, ' ') end"
    join = "string_agg(w, ' ' order by i)"
    if words:
        join = rf"regexp_replace(regexp_replace({join}, ' ([.,;:!?)\]}}”»%])', '\1', 'g'), '([(\[{{“«]) ', '\1', 'g')"
    h = f"md5('{seed}:' || row_key || ':' || (i - 1))"
    return f"""
sw0 as (select row_key, "text" x, {_clean('"text"')} c from en),
sw1 as (select row_key, x, unnest({cut}) token, generate_subscripts({cut}, 1) i from sw0),
sw2 as (select row_key, x, i, token, case when candidates is not null and ('0x' || substr({h}, 1, 8))::bigint / 4294967296.0 < {probability}
        then candidates[1 + ('0x' || substr({h}, 9, 8))::bigint % len(candidates)] end pick from sw1 left join lex on lower(token) = word),
sw3 as (select row_key, x, i, pick, case when pick is null then token when token = upper(token) and token <> lower(token) then upper(replace(pick, 'ß', 'ss'))
        when substr(token, 1, 1) = upper(substr(token, 1, 1)) and substr(token, 1, 1) <> lower(substr(token, 1, 1)) then upper(substr(pick, 1, 1)) || lower(substr(pick, 2)) else pick end w from sw2),
sw as (select row_key, case when count(pick) = 0 then any_value(x) else {join} end "text", cast(count(pick) as int) n_switches from sw3 group by row_key
       union all select row_key, x, 0 from sw0 where len({cut}) = 0)"""


def _bm25(queries: str, docs: str, k: int) -> str:
    return f"""
bw as (select doc_id, w, len(w) dl from (select doc_id, {_terms('"text"')} w from {docs}) where len(w) > 0),
bt as (select doc_id, dl, term, count(*) tf from (select doc_id, dl, unnest(w) term from bw) group by all),
bs as (select count(*)::double n, avg(dl) mean from bw),
bd as (select term, count(*)::double df from bt group by term),
bq as (select distinct qid, unnest({_terms('"text"')}) term from {queries}),
bx as (select qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9::double * (0.6::double + 0.4::double * dl / mean))), 4) score
       from bq join bt using (term) join bd using (term), bs group by 1, 2),
br as (select qid, doc_id, score, cast(row_number() over (partition by qid order by score desc, doc_id) as int) rank from bx qualify row_number() over (partition by qid order by score desc, doc_id) <= {k})"""


_ITEMS = "items as (select item_id qid, \"text\" from eval_items)"
_JUDGMENTS = "jd as (select query_id qid, doc_id, max(try_cast(relevance as int)) rel from qrels where query_id is not null and doc_id is not null and try_cast(relevance as int) is not null group by 1, 2)"
_RUN = f"""{_JUDGMENTS},
rk as (select qid, doc_id, rank from (select qid, doc_id, row_number() over (partition by qid order by ('0x' || substr(md5(qid || ':' || doc_id), 1, 8))::bigint desc, doc_id) rank from jd) where rank <= 100)"""


# --- documents and passages ---------------------------------------------------------------------------------------------------------------------
def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"select doc_id, {_clean('text')} \"text\" from documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query(f"select doc_id || chr(9) || coalesce({_clean('text')}, '') as value from documents")
def docs_tsv(spark: SparkSession, d: str) -> DataFrame:
    return sinks.tsv_lines(clean_text(spark, d), "doc_id", "text")


@query("select doc_id, documents \"text\" from load_documents where doc_id is not null and documents is not null and lang in ('deu', 'eng', 'fra', 'rus', 'fas', 'zho') and coll_year between 2000 and 2003")
def docs_load(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "load_documents")
    registered = [x[1] for x in LANGUAGES]
    own = docs.where(F.col("doc_id").isNotNull() & F.col("documents").isNotNull() & F.col("lang").isin(registered))
    years = [own.where(F.col("coll_year") == y) for y in range(2000, 2004)]
    got = years[0]
    for y in years[1:]:
        got = got.unionByName(y)
    return got.select("doc_id", F.col("documents").alias("text"))


def _escaped(x: Column) -> Column:
    """Text as it stands in markup; empty for null."""
    return F.replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _marked(spark: SparkSession, d: str) -> DataFrame:
    safe = _escaped(F.col("text"))
    doc = F.concat(F.lit("<DOC>\n<DOCID>"), F.col("doc_id").cast("string"), F.lit("</DOCID>\n<TITLE>"), F.coalesce("text_kind", F.lit("")), F.lit("</TITLE>\n<TEXT>"), safe, F.lit("</TEXT>\n</DOC>\n"))
    return markup.fragments(_docs(spark, d).select(F.col("source").alias("path"), doc.alias("text")), "DOC")


@query(f"select cast(doc_id as varchar) doc_id, {_clean("coalesce(text_kind, '') || ' ' || ' ' || coalesce(text, '')")} \"text\" from documents")
def sgml_extract(spark: SparkSession, d: str) -> DataFrame:
    return markup.documents(_marked(spark, d), "german_derspiegel")


@query("select cast(doc_id as varchar) doc_id, coalesce(\"text\", '') \"text\" from documents")
def docs_body_only(spark: SparkSession, d: str) -> DataFrame:
    return markup.documents(_marked(spark, d), "german_derspiegel", body_only=True)


#: For each extraction rule, the markup of a document with the title K and the text T.
_MARKUPS = {
    "english_gh": "<DOCID>{}</DOCID><HEADLINE>K</HEADLINE><TEXT>T</TEXT>",
    "english_latimes": "<DOCNO>{}</DOCNO><HEADLINE><P>K</P></HEADLINE><TEXT><P>T</P></TEXT>",
    "german_derspiegel": "<DOCID>{}</DOCID><TITLE>K</TITLE><TEXT>T</TEXT>",
    "german_frrundschau": "<DOCID>{}</DOCID><TITLE>K</TITLE><TEXT>T</TEXT>",
    "german_sda": "<DOCID>{}</DOCID><TX>T</TX><TI>K</TI>",
    "russian": "<DOCID>{}</DOCID><TEXT>T</TEXT><TITLE>K</TITLE>",
    "dutch": "<DOCID>{}</DOCID><BODY><TI><P>K</P></TI><TE><P>T</P></TE></BODY>",
    "italian_lastampa": "<DOCID>{}</DOCID><TITLE>K</TITLE><TEXT>T</TEXT>",
    "italian_sda9495": "<DOCID>{}</DOCID><TI>K</TI><TX>T</TX>",
    "finnish_aamulehti": "<DOCID>{}</DOCID><TEXT>T</TEXT>",
}
_RULES = list(_MARKUPS)
_TITLE_LAST = ("german_sda", "russian", "dutch", "italian_lastampa")


@query(f"""with r as (select doc_id, coalesce(text_kind, '') k, coalesce("text", '') t, {_RULES}[1 + doc_id % 10] "rule" from documents)
select "rule", cast(doc_id as varchar) doc_id, {_clean(f"case when rule = 'finnish_aamulehti' then t when rule in {_TITLE_LAST} then t || ' ' || k else k || ' ' || t end")} "text" from r""")
def extract_files(spark: SparkSession, d: str) -> DataFrame:
    """The documents written as newswire files, a tenth for each rule, and read from there."""
    root = f"{shared_dir(spark)}/newswire-{uuid.uuid4().hex}"
    rule = F.element_at(F.array(*map(F.lit, _RULES)), (F.col("doc_id") % 10 + 1).cast("int"))
    inside = F.element_at(F.create_map(*[F.lit(x) for pair in _MARKUPS.items() for x in pair]), rule)
    # the places of id, title and text in the markup, none of which is in what is put there before it
    marked = F.replace(F.replace(F.replace(inside, F.lit(">K<"), F.concat(F.lit(">"), F.coalesce("text_kind", F.lit("")), F.lit("<"))), F.lit("{}"), F.col("doc_id").cast("string")), F.lit(">T<"), F.concat(F.lit(">"), _escaped(F.col("text")), F.lit("<")))
    _docs(spark, d).select(rule.alias("rule"), F.concat(F.lit("<DOC>"), marked, F.lit("</DOC>")).alias("value")).write.partitionBy("rule").text(root)
    got = None
    for name in _RULES:
        parts = markup.fragments(markup.read_whole(spark, f"{root}/rule={name}", "UTF-8"), "DOC") if sinks.path_exists(spark, f"{root}/rule={name}") else None
        if parts is not None:
            own = markup.documents(parts, name).select(F.lit(name).alias("rule"), "doc_id", "text")
            got = own if got is None else got.unionByName(own)
    return spark.createDataFrame([], "rule string, doc_id string, text string") if got is None else got


def _written_lines(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """The lines (value) written to files in the shared folder and read from there."""
    root = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    sinks.write_lines(lines, root)
    return spark.read.text(root)


@query(f"select cast(doc_id as varchar) id, coalesce({_clean('text')}, '') \"text\" from documents")
def docs_tsv_read(spark: SparkSession, d: str) -> DataFrame:
    """The documents as TSV files, read back."""
    return files.two_columns(_written_lines(spark, docs_tsv(spark, d)))


@query("select cast(doc_id as varchar) id, regexp_replace(coalesce(\"text\", ''), '[\\n\\r]', '', 'g') \"text\" from documents")
def quoted_tsv_read(spark: SparkSession, d: str) -> DataFrame:
    """The documents as TSV files with quoted texts, tabs and quotes included, read back."""
    text = F.replace(T.drop_newlines(F.coalesce("text", F.lit(""))), F.lit('"'), F.lit('""'))
    lines = _docs(spark, d).select(F.concat(F.col("doc_id").cast("string"), F.lit('\t"'), text, F.lit('"')).alias("value"))
    return files.quoted_columns(_written_lines(spark, lines)).select(F.col("cols")[0].alias("id"), F.col("cols")[1].alias("text"))


@query("select doc_id, source from documents qualify row_number() over (partition by source order by doc_id) <= 100")
def docs_limit(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select(F.col("source").alias("path"), "doc_id")
    return files.limited_per_file(rows, 100, "doc_id").select("doc_id", F.col("path").alias("source"))


@query(f"with {_WINDOWS} select doc_id, k, passage from p")
def passages_ws(spark: SparkSession, d: str) -> DataFrame:
    return passages.passages(_docs(spark, d))


_PIECES = f"regexp_extract_all(\"text\", '{_WS}*[^{_WS[1:-1]}]+')"


@query(f"""with w as (select doc_id, "text", {_PIECES} w from documents where "text" is not null),
k as (select doc_id, "text", w, unnest(case when len(w) <= 90 then [0] else range(0, (len(w) + 89) // 90) end) k from w)
select doc_id, cast(k as int) k, case when len(w) <= 90 then "text" else regexp_replace(array_to_string(w[k * 90 + 1 : k * 90 + 180], ''), '^{_WS}+', '') end passage from k""")
def passages_offsets(spark: SparkSession, d: str) -> DataFrame:
    return passages.offset_passages(_docs(spark, d))


def passages_subword(spark: SparkSession, d: str) -> DataFrame:
    """Passages by the tokens of a public subword vocabulary; no SQL knows these."""
    return passages.offset_passages(_docs(spark, d), passages.subword_offsets(f"{TOKENIZERS}/byte_bpe_50k.json"))


QUERIES["passages_subword"] = passages_subword


@query(f"with {_WINDOWS} select doc_id, count(*) n_passages from p group by doc_id")
def passage_counts(spark: SparkSession, d: str) -> DataFrame:
    return passages.passage_counts(_docs(spark, d))


@query(f"with {_WINDOWS} select row_number() over (order by doc_id, k) - 1 passage_idx, doc_id || '_' || k original_id from p")
def passage_mapping(spark: SparkSession, d: str) -> DataFrame:
    return passages.passage_mapping(passages.passage_counts(_docs(spark, d)))


@query(f"select cast(doc_id as varchar) doc_id, {_clean("coalesce(text_kind, '') || ' ' || coalesce(\"text\", '')")} \"text\" from documents where {_clean("coalesce(text_kind, '') || ' ' || coalesce(\"text\", '')")} <> ''")
def jsonl_normalize(spark: SparkSession, d: str) -> DataFrame:
    record = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text_kind").alias("title"), "text"))
    return files.json_documents(_docs(spark, d).select(record.alias("value")))


@query(f"""with e as (select item_id query_id, list_filter(string_split(regexp_replace({_clean('"text"')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') s from eval_items)
select query_id, cast(generate_subscripts(s, 1) - 1 as int) sent_no, unnest(s) sentence from e""")
def sentence_explode(spark: SparkSession, d: str) -> DataFrame:
    return translation.query_sentences(table(spark, d, "eval_items"), "item_id")


@query(f"""with q as (select lang, query_id, coll_year, 'titles' field, titles "text" from process_queries union all select lang, query_id, coll_year, 'descs', descs from process_queries),
e as (select lang, query_id, coll_year, field, list_filter(string_split(regexp_replace({_clean('"text"')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') s from q)
select lang, query_id, coll_year, field, cast(generate_subscripts(s, 1) - 1 as int) sent_no, unnest(s) sentence from e""")
def sentence_explode_queries(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of all titles and descriptions; sentence_explode has those of the held-out items, whose number is fixed."""
    q = table(spark, d, "process_queries").select(F.struct("lang", "query_id", "coll_year").alias("key"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in ("titles", "descs")])).alias("t"))
    got = translation.query_sentences(q.select(F.struct("key.*", "t.field").alias("key"), "t.text"), "key")
    return got.select("query_id.lang", "query_id.query_id", "query_id.coll_year", "query_id.field", "sent_no", "sentence")


#: The words that the backend of translate_sentences knows.
_KNOWN_WORDS = {"the": "der", "of": "von", "and": "und", "for": "für", "on": "über", "with": "mit"}
_TRANSLATED = "case lower(w) " + " ".join(f"when '{a}' then '{b}'" for a, b in _KNOWN_WORDS.items()) + " else w end"


@query(f"select *, array_to_string(list_transform(string_split(sentence, ' '), lambda w: {_TRANSLATED}), ' ') translation from ({ORACLE['sentence_explode_queries']})")
def translate_sentences(spark: SparkSession, d: str) -> DataFrame:
    """All sentences of titles and descriptions through the translation hook, with a backend that knows a few words."""
    return translation.translated(sentence_explode_queries(spark, d), lambda: translation.word_by_word(_KNOWN_WORDS))


@query("select doc_id, row_number() over (order by doc_id) - 1 pos, cast((row_number() over (order by doc_id) - 1) % 4 as int) shard from documents")
def shard_stride(spark: SparkSession, d: str) -> DataFrame:
    return ordering.shard(ordering.numbered(_docs(spark, d).select("doc_id"), ["doc_id"], "pos"), "pos", 4)


@query("select doc_id, loaded_at, case lang when 'deu' then 'german' when 'eng' then 'english' when 'fra' then 'french' when 'rus' then 'russian' when 'fas' then 'farsi' when 'zho' then 'chinese' else lang end lang_name from load_documents")
def lang_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "load_documents").select("doc_id", "loaded_at", name_of(F.col("lang")).alias("lang_name"))


@query("select file_name, right(file_name, 3) lang, count(*) n from qrels_lines group by all")
def lang_from_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qrels_lines").groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).select("file_name", files.language_of_file(F.col("file_name")).alias("lang"), "n")


# --- judgments ----------------------------------------------------------------------------------------------------------------------------------
def _qrels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qrels")


@query("select qrel_id, query_id, doc_id, try_cast(relevance as int) rel from qrels where try_cast(relevance as int) <> 0")
def qrels_positive(spark: SparkSession, d: str) -> DataFrame:
    return topics.positives(_qrels(spark, d)).select("qrel_id", "query_id", "doc_id", "rel")


@query("select qrel_id, query_id, doc_id, try_cast(relevance as int) rel from qrels where try_cast(relevance as int) = 0")
def qrels_negative(spark: SparkSession, d: str) -> DataFrame:
    return topics.positives(_qrels(spark, d), negatives=True).select("qrel_id", "query_id", "doc_id", "rel")


@query("select query_id, row_number() over (partition by query_id order by qrel_id) - 1 pos, doc_id from qrels where try_cast(relevance as int) <> 0 and query_id is not null")
def qrels_grouped(spark: SparkSession, d: str) -> DataFrame:
    rows = topics.positives(_qrels(spark, d)).where("query_id is not null").select("query_id", "qrel_id", "doc_id")
    return ordering.per_group_position(rows, "query_id", ["qrel_id"]).select("query_id", "pos", "doc_id")


@query("select line_no, string_split(raw_line, ' ')[1] query_id, string_split(raw_line, ' ')[3] doc_id, cast(trim(string_split(raw_line, ' ')[-1], chr(9) || chr(13)) as int) rel from qrels_lines where regexp_matches(string_split(raw_line, ' ')[-1], '^[\\t\\r]*[+-]?[0-9]+[\\t\\r]*$')")
def qrels_spaced(spark: SparkSession, d: str) -> DataFrame:
    rows = files.spaced_judgments(table(spark, d, "qrels_lines").withColumnRenamed("raw_line", "value")).where("rel is not null")
    return rows.select("line_no", "query_id", "doc_id", "rel")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    rows = files.four_field_judgments(table(spark, d, "qrels_lines").withColumnRenamed("raw_line", "value"))
    return topics.judged_ids(rows.withColumn("lang", files.language_of_file(F.col("file_name"))), ["lang", "query_id"])


@query(f"with {_JUDGED} select lang, query_id from jl")
def judged_query_ids(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)


@query(f"with {_PAIRS} select qid, doc_id from pairs where starts_with(doc_id, 'LA')")
def qrels_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return topics.aggregated_judgments(_qrels(spark, d), "LA")


@query(f"with {_PAIRS} select qid || chr(9) || '0' || chr(9) || doc_id || chr(9) || '1' as value from pairs")
def trec_qrels(spark: SparkSession, d: str) -> DataFrame:
    return sinks.trec_lines(topics.aggregated_judgments(_qrels(spark, d)))


# --- topics and queries -------------------------------------------------------------------------------------------------------------------------
def _topics(spark: SparkSession, d: str) -> DataFrame:
    return topics.topics_by_language(table(spark, d, "topics"))


@query(f"with {_TOPICS} select topic_id, lang, title, description, first_row from tl")
def topics_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return _topics(spark, d)


@query(f"with {_TOPICS} select topic_id, lang, title, description, title || ' ' || description concat from tl")
def topic_concat(spark: SparkSession, d: str) -> DataFrame:
    return topics.views(_topics(spark, d)).select("topic_id", "lang", "title", "description", "concat")


_TITLE, _DESC = (_strip(f"regexp_replace(coalesce({c}, ''), '[\\n\\r]', '', 'g')") for c in ("titles", "descs"))


@query(f"select try_cast(substr(query_id, 2) as int) qid, {_TITLE} title, {_DESC} description from process_queries where query_id is not null")
def topics_parse(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "process_queries").where("query_id is not null")
    part = lambda tag, c: F.concat(F.lit(f"\n<XX-{tag}> "), _escaped(c), F.lit(f" </XX-{tag}>"))
    text = F.concat(F.lit("<top>\n<num> "), "query_id", F.lit(" </num>"), part("title", F.col("titles")), part("desc", F.col("descs")), F.lit("\n</top>"))
    return markup.topics(markup.fragments(q.select(F.col("lang").alias("path"), text.alias("text")), "top"), "XX")


@query(f"select try_cast(substr(query_id, 2) as int) qid, {_clean("coalesce(titles, '')")} title, {_clean("coalesce(descs, '')")} description from process_queries where try_cast(substr(query_id, 2) as int) between 41 and 90")
def lowres_year_filter(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "process_queries").where("query_id is not null")
    block = F.concat(F.lit("query_id: "), "query_id", F.lit("\ntitle: "), T.clean_text(F.coalesce("titles", F.lit(""))), F.lit("\ndescription: "), T.clean_text(F.coalesce("descs", F.lit(""))))
    return markup.block_topics(q.select(block.alias("text"))).where(topics.in_year(F.col("qid"), 2001))


@query("select lang, coll_year, query_id from (select lang, coll_year, query_id, row_number() over (partition by lang, coll_year order by query_id) - 1 pos from (select distinct lang, coll_year, query_id from process_queries)) where pos <= 50")
def topics_limit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "process_queries").select("lang", "coll_year", "query_id").distinct()
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("lang", "coll_year").orderBy(F.col("query_id").asc_nulls_last())) - 1).where("pos <= 50").drop("pos")


@query("select distinct lang, query_id, titles from process_queries where coll_year between 2000 and 2003")
def union_years(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "process_queries")
    got = q.where("coll_year = 2000")
    for year in (2001, 2002, 2003):
        got = got.unionByName(q.where(F.col("coll_year") == year))
    return got.select("lang", "query_id", "titles").distinct()


@query(f"with {_TOPICS}, {_JUDGED} select topic_id, lang, title, description from tl where exists (select 1 from jl where jl.lang = tl.lang and query_id = topic_id)")
def queries_judged(spark: SparkSession, d: str) -> DataFrame:
    return topics.judged_queries(_topics(spark, d), _judged(spark, d)).select("topic_id", "lang", "title", "description")


@query(f"with {_TOPICS}, {_JUDGED} select jl.lang target_lang, topic_id, title, description from tl join jl on query_id = topic_id where tl.lang = 'eng' and jl.lang <> 'eng'")
def queries_judged_eng(spark: SparkSession, d: str) -> DataFrame:
    return topics.english_for_targets(_topics(spark, d), _judged(spark, d)).select("target_lang", "topic_id", "title", "description")


_AGGREGATED = """q as (select lang, try_cast(substr(query_id, 2) as int) qid, coll_year, coalesce(titles, '') title, coalesce(descs, '') description from process_queries),
qa as (select lang, qid, title, description from (select *, row_number() over (partition by lang, qid order by coll_year desc nulls last, title desc, description desc) r from q where qid is not null and lang is not null) where r = 1 and qid in (select qid from pairs where starts_with(doc_id, 'LA')))"""


@query(f"with {_PAIRS}, {_AGGREGATED} select qid, doc_id from pairs where starts_with(doc_id, 'LA') and qid in (select qid from qa)")
def qrels_kept(spark: SparkSession, d: str) -> DataFrame:
    """Aggregated judgments of the queries that the aggregation keeps."""
    pairs = topics.aggregated_judgments(_qrels(spark, d), "LA")
    return topics.kept_judgments(pairs, topics.aggregated_queries(table(spark, d, "process_queries"), pairs))


@query(f"with {_PAIRS}, {_AGGREGATED} select lang, qid, title, description from qa")
def queries_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return topics.aggregated_queries(table(spark, d, "process_queries"), topics.aggregated_judgments(_qrels(spark, d), "LA"))


# --- lexicon and code-switching -----------------------------------------------------------------------------------------------------------------
def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Lexicon entries out of the topics: words at the same place of the English and the German title; a built lexicon has the three most
    frequent candidates of a word, the best first."""
    own = stored(_topics(spark, d))
    e = own.where("lang = 'eng'").select("topic_id", T.tokens(F.col("title")).alias("a"))
    g = own.where("lang = 'deu'").select("topic_id", T.tokens(F.col("title")).alias("b"))
    pairs = e.join(g, "topic_id").select(F.explode(F.arrays_zip("a", "b")).alias("p")).where("p.a is not null and p.b is not null")
    n = pairs.select(F.lower("p.a").alias("word"), F.lower("p.b").alias("cand")).groupBy("word", "cand").count()
    best = n.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("count"), "cand"))).where("r <= 3")
    lists = best.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("r", "cand"))).alias("c"))
    return lists.select(F.lit(0).cast("bigint").alias("pos"), F.concat(F.lit(" "), F.initcap("word"), F.lit("\t")).alias("key"), F.to_json(F.transform("c.cand", lambda x: F.concat(x, F.lit(" ")))).alias("value"))


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    return stored(codeswitch.normalized_lexicon(_entries(spark, d)))


@query(f"with {_LEXICON} select word, array_to_string(candidates, '|') candidates from lex")
def lexicon_normalize(spark: SparkSession, d: str) -> DataFrame:
    return codeswitch.normalized_lexicon(_entries(spark, d)).select("word", F.array_join("candidates", "|").alias("candidates"))


def _english(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "process_queries").where("lang = 'en' and query_id is not null and titles is not null and coll_year is not null")
    return q.groupBy(F.concat_ws("/", "lang", "query_id", F.col("coll_year").cast("string")).alias("row_key")).agg(F.max("titles").alias("text"))


@query(f"with {_LEXICON}, {_EN}, {_switch(0.5, 42)} select row_key, \"text\", n_switches from sw")
def codeswitch_queries(spark: SparkSession, d: str) -> DataFrame:
    return codeswitch.switched(_english(spark, d), _lexicon(spark, d), 0.5, 42)


@query(f"with {_LEXICON}, {_EN}, {_switch(0.5, 13, words=True)} select row_key, \"text\", n_switches from sw")
def codeswitch_words(spark: SparkSession, d: str) -> DataFrame:
    return codeswitch.switched(_english(spark, d), _lexicon(spark, d), 0.5, 13, tokenizer="words")


@query(f"""with {_LEXICON}, {_EN}, {_switch(0.5, 42)}
select count(*) total_rows, count(*) filter (n_switches > 0) switched_rows, cast(sum(n_switches) as bigint) switches, round(100.0::double * count(*) filter (n_switches > 0) / count(*), 4) rate,
round(sum(n_switches)::double / count(*) filter (n_switches > 0), 4) per_switched_row from sw""")
def codeswitch_stats(spark: SparkSession, d: str) -> DataFrame:
    return codeswitch.switch_statistics(codeswitch_queries(spark, d))


@query(f"with {_LEXICON}, {_EN}, {_switch(1.0, 1)} select row_key, \"text\" translation from sw")
def translate_words(spark: SparkSession, d: str) -> DataFrame:
    return codeswitch.switched(_english(spark, d), _lexicon(spark, d), 1.0, 1).select("row_key", F.col("text").alias("translation"))


@query(f"""with {_LEXICON}, {_EN}, k as (select distinct unnest(string_split({_clean('"text"')}, ' ')) token from en)
select token, case when token = upper(token) and token <> lower(token) then upper(replace(candidates[1], 'ß', 'ss'))
when substr(token, 1, 1) = upper(substr(token, 1, 1)) and substr(token, 1, 1) <> lower(substr(token, 1, 1)) then upper(substr(candidates[1], 1, 1)) || lower(substr(candidates[1], 2)) else candidates[1] end matched
from k join lex on lower(token) = word""")
def match_case(spark: SparkSession, d: str) -> DataFrame:
    words = _english(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    got = words.join(_lexicon(spark, d), F.lower("token") == F.col("word"))
    return got.select("token", T.match_case(F.col("candidates")[0], F.col("token")).alias("matched"))


# --- order and integrity ------------------------------------------------------------------------------------------------------------------------
def _last(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "load_documents").where("doc_id is not null").select(F.col("doc_id").alias("id"), "loaded_at", F.col("documents").alias("text"))
    return ordering.last_wins(rows, ["id"], ["loaded_at"], ["text"])


_LAST = "ld as (select doc_id id, documents \"text\" from (select *, row_number() over (partition by doc_id order by loaded_at desc nulls last, documents desc nulls last) r from load_documents where doc_id is not null) where r = 1)"


@query(f"with {_LAST} select row_number() over (order by md5(id), id) - 1 pos, id, \"text\" from ld")
def reorder_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "load_documents").where("doc_id is not null").select(F.col("doc_id").alias("id")).distinct().withColumn("h", F.md5("id"))
    return ordering.reordered(ordering.numbered(ids, ["h", "id"], "pos"), _last(spark, d)).select("pos", "id", "text")


@query("select distinct doc_id id from qrels where doc_id is not null and doc_id not in (select doc_id from load_documents where doc_id is not null)")
def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = _qrels(spark, d).select(F.col("doc_id").alias("id"))
    return ordering.missing_ids(ids, table(spark, d, "load_documents").select(F.col("doc_id").alias("id")))


@query(f"""with {_LAST}, x as (select id, md5({_strip('id')} || coalesce({_strip('"text"')}, '')) found, md5({_strip('id')} || coalesce({_clean('"text"')}, '')) expected from ld)
select id, expected, found from x where expected <> found""")
def md5_mismatch(spark: SparkSession, d: str) -> DataFrame:
    docs = stored(_last(spark, d))
    listed = docs.select("id", T.document_hash(F.col("id"), T.clean_text(F.col("text"))).alias("md5"))
    return ordering.hash_mismatches(docs, listed, F.col("id"), F.col("text"))


# --- retrieval and evaluation -------------------------------------------------------------------------------------------------------------------
def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), "text")


@query(f"select term, doc_id, count(*) tf from (select doc_id, unnest({_terms('\"text\"')}) term from documents) group by 1, 2")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.inverted_index(_docs(spark, d))


@query(f"with {_ITEMS}, {_bm25('items', 'documents', 20)} select qid, doc_id, score, rank from br")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_items(spark, d), _docs(spark, d).select("doc_id", "text"))


def _passage_run(spark: SparkSession, d: str, k: int = 100) -> DataFrame:
    cut = passages.passages(_docs(spark, d)).select(F.concat_ws("_", "doc_id", "k").alias("doc_id"), F.col("passage").alias("text"))
    return retrieval.bm25(_items(spark, d), cut, k)


_PASSAGES = f"{_ITEMS}, {_WINDOWS}, ps as (select doc_id || '_' || k doc_id, passage \"text\" from p)"


@query(f"with {_PASSAGES}, {_bm25('items', 'ps', 100)} select qid, regexp_replace(doc_id, '_[0-9]+$', '') doc_id, max(score) score from br group by 1, 2")
def maxp_docs(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.best_passage(_passage_run(spark, d).withColumnRenamed("doc_id", "original_id"))


@query(f"with {_PASSAGES}, {_bm25('items', 'ps', 6)} select qid, doc_id, score, rank from br")
def nway_candidates(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.best_candidates(_passage_run(spark, d).drop("rank"), 6)


@query("""with q as (select vec_id qid, embedding e from embeddings where vec_id % 20 = 0),
s as (select qid, v.vec_id doc_id, round(list_dot_product(e::double[], v.embedding::double[]) / (sqrt(list_dot_product(e::double[], e::double[])) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[]))), 6) score from q, embeddings v)
select qid, doc_id, score, cast(row_number() over (partition by qid order by score desc, doc_id) as int) rank from s qualify row_number() over (partition by qid order by score desc, doc_id) <= 20""")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return retrieval.dense(v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid"), v)


def _judgments(spark: SparkSession, d: str) -> DataFrame:
    rel = F.col("relevance").try_cast("int")
    rows = _qrels(spark, d).where("query_id is not null and doc_id is not null").withColumn("rel", rel).where("rel is not null")
    return stored(rows.groupBy(F.col("query_id").alias("qid"), "doc_id").agg(F.max("rel").alias("rel")))


def _run(judged: DataFrame) -> DataFrame:
    """A ranking that depends on the ids only, of the judged documents of each query."""
    score = F.conv(F.substring(F.md5(F.concat_ws(":", "qid", "doc_id")), 1, 8), 16, 10).cast("bigint")
    return retrieval.top_k(judged.select("qid", "doc_id", score.alias("score")), "qid", 100)


@query("with " + _RUN + " select qid, doc_id, cast(rank as int) rank from rk")
def ranking_topk(spark: SparkSession, d: str) -> DataFrame:
    return _run(_judgments(spark, d)).select("qid", "doc_id", "rank")


@query("with " + _RUN + " select doc_id, loaded_at from load_documents where doc_id in (select doc_id from rk where rank <= 10)")
def rerank_corpus(spark: SparkSession, d: str) -> DataFrame:
    top = files.rerank_corpus(_run(_judgments(spark, d)), 11)
    return table(spark, d, "load_documents").join(top, "doc_id", "left_semi").select("doc_id", "loaded_at")


_LOADED = f"{_TOPICS}, tq as (select topic_id qid, title \"text\" from tl where lang = 'eng'), {_LAST}, lt as (select id doc_id, \"text\" from ld)"
_TITLE_RUN = f"{_LOADED}, {_bm25('tq', 'lt', 20)}"


def _title_run(spark: SparkSession, d: str) -> DataFrame:
    """BM25 of every English topic title over the loaded documents."""
    asked = _topics(spark, d).where("lang = 'eng'").select(F.col("topic_id").alias("qid"), F.col("title").alias("text"))
    return retrieval.bm25(asked, _last(spark, d).select(F.col("id").alias("doc_id"), "text"), 20)


@query(f"with {_TITLE_RUN} select qid, doc_id, score, rank from br")
def bm25_titles(spark: SparkSession, d: str) -> DataFrame:
    return _title_run(spark, d)


_IDEAL = "g as (select qid, sum((pow(2, greatest(coalesce(rel, 0), 0)) - 1) / log2(rank + 1)) dcg from rk join jd using (qid, doc_id) where rank <= 20 group by qid), i as (select qid, sum((pow(2, rel) - 1) / log2(r + 1)) ideal from (select qid, rel, row_number() over (partition by qid order by rel desc, doc_id) r from jd where rel > 0) where r <= 20 group by qid)"


@query(f"with {_RUN}, {_IDEAL} select qid, round(coalesce(dcg, 0) / ideal, 4) ndcg from i left join g using (qid)")
def metric_ndcg20(spark: SparkSession, d: str) -> DataFrame:
    judged = _judgments(spark, d)
    return retrieval.ndcg(_run(judged), judged, 20)


@query(f"""with {_TITLE_RUN}, {_JUDGMENTS}, rk as (select qid, doc_id, rank from br), {_IDEAL} select qid, round(coalesce(dcg, 0) / ideal, 4) ndcg from i left join g using (qid)""")
def metric_bm25_ndcg20(spark: SparkSession, d: str) -> DataFrame:
    """The same measure of a retrieval run."""
    return retrieval.ndcg(_title_run(spark, d), _judgments(spark, d), 20)


@query(f"""with {_RUN}, h as (select qid, rank, row_number() over (partition by qid order by rank) c from rk join jd using (qid, doc_id) where rel > 0)
select qid, round(coalesce(p, 0) / n, 4) ap from (select qid, count(*) n from jd where rel > 0 group by qid) left join (select qid, sum(c::double / rank) p from h group by qid) using (qid)""")
def metric_map(spark: SparkSession, d: str) -> DataFrame:
    judged = _judgments(spark, d)
    return retrieval.average_precision(_run(judged), judged)


@query(f"with {_RUN} select qid, round(coalesce(h, 0)::double / n, 4) recall from (select qid, count(*) n from jd where rel > 0 group by qid) left join (select qid, count(*) h from rk join jd using (qid, doc_id) where rel > 0 and rank <= 100 group by qid) using (qid)")
def metric_recall100(spark: SparkSession, d: str) -> DataFrame:
    judged = _judgments(spark, d)
    return retrieval.recall(_run(judged), judged, 100)
