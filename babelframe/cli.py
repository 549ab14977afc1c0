"""Command line: python -m babelframe.cli COMMAND ... ; each command reads files or tables and writes one output folder."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import codeswitch, ordering, passages, retrieval, topics, translation
from .plans import preparation
from .session import scratch
from .sources import campaigns, files, markup, sinks
from .sources.catalog import Catalog


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="babelframe")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        c.add_argument("input")
        c.add_argument("output")
        c.add_argument("--overwrite", action="store_true", help="write even if a finished output is there")
        return c

    c = command("documents", "documents out of newswire markup")
    c.add_argument("--corpus", required=True, choices=sorted(markup.EXTRACTIONS))
    c.add_argument("--encoding", default="ISO-8859-1")
    c.add_argument("--body-only", action="store_true")
    command("jsonl", "documents out of JSON lines, as id and text")
    c = command("passages", "passages and their mapping out of id and text")
    c.add_argument("--length", type=int, default=passages.LENGTH)
    c.add_argument("--overlap", type=int, default=passages.OVERLAP)
    c = command("topics", "topics out of JSON lines, per language")
    c.add_argument("--languages", nargs="+")
    c.add_argument("--view", choices=("title", "description", "concat"), default="concat")
    c = command("codeswitch", "queries switched by a lexicon")
    c.add_argument("--lexicon", required=True)
    c.add_argument("--probability", type=float, default=0.5)
    c.add_argument("--seed", type=int, default=13)
    c = command("reorder", "JSON lines in the order of an id list")
    c.add_argument("--ids", required=True)
    c.add_argument("--check-hash", action="store_true")
    command("sentences", "queries as one sentence per row")
    c = command("translate", "queries translated word by word through a lexicon, sentence by sentence")
    c.add_argument("--lexicon", required=True)
    for name, text in (("qrels", "judgments of languages and years"), ("queries", "queries of languages and years"), ("aggregate", "queries and judgments of all years together"), ("collection", "documents of languages and years")):
        c = command(name, text + ", out of the folder of a campaign")
        c.add_argument("--languages", nargs="+")
        c.add_argument("--years", nargs="+", choices=campaigns.YEARS)
        c.add_argument("--preset", choices=sorted(preparation.PRESETS), default="newswire", help="languages and years where none are given")
        if name == "aggregate":
            c.add_argument("--judgments", required=True, help="folder of the judgments")
        if name in ("queries", "aggregate"):
            c.add_argument("--low-resource", help="folder of topics of languages with few resources")
            c.add_argument("--no-description", action="store_true")
    c = command("search", "BM25 ranking of queries (id, text) over documents (id, text), as TREC lines")
    c.add_argument("--queries", required=True)
    c.add_argument("--top", type=int, default=100)
    c = command("evaluate", "measures of a ranking (TREC lines) per query")
    c.add_argument("--judgments", required=True)
    return p


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"babelframe {a.command}").getOrCreate()

    def write(lines, path: str, order: list[str] | None = None) -> None:
        done = sinks.write_lines(lines, path, order, skip_finished=not a.overwrite)
        print(f"[{a.command}] {'wrote' if done else 'kept'} {path}")

    def texts():
        return files.two_columns(spark.read.text(a.input))

    if a.command == "documents":
        parts = markup.fragments(markup.read_whole(spark, a.input, a.encoding), "DOC")
        write(sinks.tsv_lines(markup.documents(parts, a.corpus, a.body_only), "doc_id", "text"), a.output)
    elif a.command == "jsonl":
        write(sinks.tsv_lines(files.json_documents(spark.read.text(a.input)), "doc_id", "text"), a.output)
    elif a.command == "passages":
        cut = passages.numbered_passages(passages.passages(texts().withColumnRenamed("id", "doc_id"), a.length, a.overlap)).persist()
        numbered = F.lpad(F.col("passage_idx").cast("string"), 20, "0")
        for kind, column in (("passages", "passage"), ("mapping", "original_id")):
            write(cut.select(numbered.alias("n"), F.concat_ws("\t", F.col("passage_idx").cast("string"), column).alias("value")), f"{a.output}/{kind}", ["n"])
    elif a.command == "topics":
        kind = "topic_id string, topics array<struct<lang:string,topic_title:string,topic_description:string>>"
        rows = spark.read.schema(kind).json(a.input).withColumn("row_no", F.monotonically_increasing_id())
        for lang in a.languages or [r[0] for r in topics.topics_by_language(rows).select("lang").distinct().collect()]:
            write(sinks.tsv_lines(topics.views(topics.topics_by_language(rows, [lang])), "topic_id", a.view), f"{a.output}/{lang}")
    elif a.command == "codeswitch":
        lexicon = codeswitch.normalized_lexicon(files.lexicon_entries(spark, a.lexicon))
        got = codeswitch.switched(texts().withColumnRenamed("id", "row_key"), lexicon, a.probability, a.seed).persist()
        write(sinks.tsv_lines(got, "row_key", "text"), a.output)
        print(codeswitch.switch_statistics(got).first().asDict())
    elif a.command == "reorder":
        raw = spark.read.text(a.input).select(F.get_json_object("value", "$.id").alias("id"), "value", F.monotonically_increasing_id().alias("at"))
        ids = files.id_list(files.lines(spark, a.ids)).persist()
        docs = ordering.last_wins(raw.where("id is not null"), ["id"], ["at"], ["value"])
        write(ordering.reordered(ids, docs), a.output, ["pos"])
        if a.check_hash:
            bad = ordering.hash_mismatches(docs, ids, F.get_json_object("value", "$.title"), F.get_json_object("value", "$.text"))
            print(f"[reorder] {bad.count()} documents differ from their listed hash")
    elif a.command == "sentences":
        rows = translation.query_sentences(texts(), "id", "text")
        write(sinks.tsv_lines(rows, "query_id", "sentence"), a.output)
    elif a.command == "translate":
        lexicon = codeswitch.normalized_lexicon(files.lexicon_entries(spark, a.lexicon))
        # a lexicon is one JSON file, which was read whole
        known = {r["word"]: r["c"] for r in lexicon.select("word", F.element_at("candidates", 1).alias("c")).toLocalIterator()}
        done = translation.translated(translation.query_sentences(texts(), "id", "text"), lambda: translation.word_by_word(known))
        write(sinks.tsv_lines(translation.regrouped(done), "query_id", "text"), a.output)
    elif a.command in ("qrels", "queries", "aggregate", "collection"):
        preset, keep = preparation.PRESETS[a.preset], not a.overwrite
        if a.command == "qrels":
            got = preparation.judgments_of(spark, a.input, a.languages or preset.judgment_languages, a.years or preset.judgment_years)
            preparation.write_judgments(got, a.output, keep)
        elif a.command == "collection":
            preparation.write_documents(spark, Catalog(a.input), a.languages or preset.document_languages, a.years or preset.document_years, a.output, keep)
        else:
            languages = campaigns.registered(a.languages or preset.query_languages)
            got = preparation.queries_of(spark, a.input, languages, a.years or preset.query_years, not a.no_description, a.low_resource)
            if a.command == "queries":
                preparation.write_queries(got, a.output, keep)
            else:
                judged = preparation.judgments_of(spark, a.judgments, ["en"], a.years or preset.judgment_years)
                preparation.write_aggregated(*preparation.aggregated(judged, got, languages), a.output, keep)
    elif a.command == "search":
        asked = files.two_columns(spark.read.text(a.queries)).withColumnRenamed("id", "qid")
        with scratch(spark):
            run = retrieval.bm25(asked, texts().withColumnRenamed("id", "doc_id"), a.top)
            write(run.select("qid", "rank", F.concat_ws(" ", "qid", F.lit("Q0"), "doc_id", F.col("rank").cast("string"), F.col("score").cast("string"), F.lit("bm25")).alias("value")), a.output, ["qid", "rank"])
    elif a.command == "evaluate":
        run = spark.read.text(a.input).select(F.split("value", r"\s+").alias("w")).select(F.col("w")[0].alias("qid"), F.col("w")[2].alias("doc_id"), F.col("w")[3].cast("int").alias("rank"))
        judged = spark.read.text(a.judgments).select(F.split("value", r"\s+").alias("w")).select(F.col("w")[0].alias("qid"), F.col("w")[2].alias("doc_id"), F.col("w")[3].cast("int").alias("rel"))
        judged = judged.groupBy("qid", "doc_id").agg(F.max("rel").alias("rel"))
        measures = retrieval.ndcg(run, judged).join(retrieval.average_precision(run, judged), "qid").join(retrieval.recall(run, judged), "qid")
        write(measures.select("qid", sinks.tsv_line("qid", "ndcg", "ap", "recall").alias("value")), a.output, ["qid"])


if __name__ == "__main__":
    main()
