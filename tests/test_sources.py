import gzip
import json

from pyspark.sql import functions as F

from babelframe.functions import text as T
from babelframe.sources import files, markup, sinks
from babelframe.sources.catalog import Catalog, Corpus, newswire_corpora
from babelframe.streaming import row_local

SGML = """<DOC>
<DOCNO> LA010194-0001 </DOCNO><HEADLINE><P>Head one</P></HEADLINE><TEXT><P>Body <B>bold</B> tail<P>second &amp; last</TEXT></DOC>
<doc><HEADLINE><P>no id</P></HEADLINE></doc>
<DOC><DOCID>Ü2</DOCID><TEXT></TEXT></DOC>"""


def test_newswire(spark, tmp_path):
    folder = tmp_path / "la"
    folder.mkdir()
    (folder / "one.sgml").write_bytes(SGML.encode("latin-1"))
    with gzip.open(folder / "two.sgml.gz", "wb") as f:
        f.write(SGML.replace("LA010194", "LA010195").encode("latin-1"))
    (folder / "x.dtd").write_text(SGML)
    (folder / "README.txt").write_text(SGML)
    catalog = Catalog(str(tmp_path), {("en", "2001"): [Corpus("la", "english_latimes")], ("fi", "2001"): []})
    got = sorted(tuple(r) for r in catalog.documents(spark, "en", ["2001"]).collect())
    assert got == [("LA010194-0001", "Head one Body second & last"), ("LA010195-0001", "Head one Body second & last"), ("Ü2", ""), ("Ü2", "")]
    body = catalog.documents(spark, "en", "2001", body_only=True, only_ids=spark.createDataFrame([("LA010194-0001",)], "doc_id string")).collect()
    assert [tuple(r) for r in body] == [("LA010194-0001", "Body  second & last")]
    assert catalog.documents(spark, "fi", "2001").count() == 0


def test_newswire_corpora():
    found = newswire_corpora()
    assert found["fi", "2001"] == [] and len(found["de", "2002"]) == 4 and ("ru", "2002") not in found
    assert all(c.rule in markup.EXTRACTIONS for corpora in found.values() for c in corpora)


def test_every_extraction_rule():
    for name, rule in markup.EXTRACTIONS.items():
        def inside(path, text):
            head, _, rest = path.partition("/")
            return f"<{head}>{inside(rest, text) if rest else text}</{head}>"

        fields = "".join(inside(p, f"{i}-a") + inside(p, f"{i}-b") for i, (p, _) in enumerate(rule.full))
        doc = f"<DOC>{inside(rule.ids[-1], ' id ')}{fields}</DOC>"
        own, text = markup.extract_fields(doc, rule)
        assert own == "id", name
        assert text == " ".join(f"{i}-a {i}-b" if every else f"{i}-a" for i, (_, every) in enumerate(rule.full)), name
        at = [p for p, _ in rule.full].index(rule.body[0])
        assert markup.extract_fields(doc, rule, body_only=True)[1] == (f"{at}-a {at}-b" if rule.body[1] else f"{at}-a")


def test_topic_files(spark):
    text = "<top>\n<num> C041 </num>\n<DE-title> Pest\nizide </DE-title>\n<DE-desc> Was? </DE-desc>\n</top>\n<top><num>\nC042\n<DE-title> Zwei\n<DE-desc> Drei</top>"
    parts = markup.fragments(spark.createDataFrame([("f", text)], "path string, text string"), "top")
    assert sorted(tuple(r) for r in markup.topics(parts, "DE").collect()) == [(41, "Pestizide", "Was?"), (42, "Zwei", "Drei")]
    assert sorted(r["description"] for r in markup.topics(parts, "DE", with_description=False).collect()) == ["", ""]
    blocks = "query_id: C041\ntitle: one\n more\ndescription: two\n\n\nquery_id: C200\ntitle: x\ndescription:\n"
    got = markup.block_topics(spark.createDataFrame([(blocks,)], "text string")).collect()
    assert sorted(tuple(r) for r in got) == [(41, "one more", "two"), (200, "x", "")]


def test_line_files(spark, tmp_path):
    (tmp_path / "qrels.zho").write_text("1\t0 d1  1\n1 0 d2 0\n1 0 d3\n1 0 d4 00\n")
    rows = files.lines(spark, str(tmp_path / "qrels.zho")).withColumn("lang", files.language_of_file(F.col("file_name")))
    assert {r["lang"] for r in rows.collect()} == {"zho"}
    assert sorted((r["doc_id"], r["relevance"]) for r in files.four_field_judgments(rows).collect()) == [("d1", "1"), ("d2", "0"), ("d4", "00")]
    spaced = {r["line_no"]: (r["query_id"], r["doc_id"], r["rel"]) for r in files.spaced_judgments(rows).collect()}
    assert spaced[1] == ("1", "d2", 0) and spaced[2][2] is None
    folder = tmp_path / "rank"
    folder.mkdir()
    (folder / "41.txt").write_text(" a \t2.5\nb\t1\nc\n")
    (folder / "7.txt").write_text("b\t1\n")
    ranked = files.rankings(files.lines(spark, str(folder)))
    assert sorted((r["qid"], r["rank"], r["doc_id"], r["score"]) for r in ranked.collect()) == [(7, 0, "b", 1.0), (41, 0, "a", 2.5), (41, 1, "b", 1.0), (41, 2, "c", None)]
    assert sorted(r[0] for r in files.rerank_corpus(ranked, 2).collect()) == ["a", "b"]
    for n in (2, 10):
        (tmp_path / f"ids.{n}.jsonl").write_text("".join(json.dumps({"id": f"{n}{c}", "md5": "m"}) + "\n" for c in "ab"))
    ids = files.id_list(files.lines(spark, str(tmp_path / "ids.*.jsonl")))
    assert [r["id"] for r in ids.orderBy("pos").collect()] == ["2a", "2b", "10a", "10b"]


def test_names(spark):
    row = spark.createDataFrame([("/data/zho/docs.jsonl", "english_french", "french")], "p string, a string, b string")
    got = row.select(files.language_of_folder(F.col("p")), files.target_of_name(F.col("a")), files.target_of_name(F.col("b"))).first()
    assert list(got) == ["zho", "french", "french"]
    assert sinks.name_of("de", "2001", "docs") == "de_2001_docs.tsv"
    assert sinks.name_of("de", "2001", "passages", "org/model") == "de_2001_passages_org_model_180_90.tsv"


JSONL = ['{"id":"d1","title":" T ","text":"a\\n\\tb"}', '{"id":"","title":"x","text":"y"}', "{bad", "", "[1]", '{"id":7,"title":null}', '{"id":"n","title":null,"text":"t"}', '{"id":" s ","text":"　x y\\u001cz"}', '{"id":"e","title":" ","text":"\\n"}', None]


def test_json_documents(spark):
    df = spark.createDataFrame([(x,) for x in JSONL], "value string")
    assert sorted(tuple(r) for r in files.json_documents(df).collect()) == [("d1", "T a b"), ("n", "t"), ("s", "x y z")]
    assert ("7", "None") in [tuple(r) for r in files.json_documents(df, null_as_text=True).collect()]


def test_two_columns(spark):
    df = spark.createDataFrame([('1\t "a\tb" ',), ("2",), ("",), (" 3 \t",)], "value string")
    assert sorted(tuple(r) for r in files.two_columns(df).collect()) == [("1", '"a\tb"'), ("3", "")]


def test_long_fields_and_words(spark):
    n = 100_000
    got = files.quoted_columns(spark.createDataFrame([('1\t"' + 'a""\t' * n + '"\tz',)], "value string")).first()["cols"]
    assert got == ["1", 'a"\t' * n, "z"]
    assert spark.createDataFrame([("a-" * n + "b c",)], "x string").select(T.word_tokens(F.col("x")).alias("w")).first()["w"] == ["a-" * n + "b", "c"]


def test_quoted_columns(spark):
    lines = ['a\t"b\tc ""d"""\te', "", "one", '"x', 'a\t"q" y', "\t\t", '""\tz']
    got = [r["cols"] for r in files.quoted_columns(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")).orderBy("i").collect()]
    assert got == [["a", 'b\tc "d"', "e"], ["one"], ['"x'], ["a", '"q" y'], ["", "", ""], ["", "z"]]


def test_lexicon_file(spark, tmp_path):
    from babelframe.operators.codeswitch import normalized_lexicon

    (tmp_path / "lex.json").write_text('{"House":["maison"," demeure "],"CAT":"chat","":["x"],"empty":[],"n":null,"q":"a \\"b\\""}')
    got = {r["word"]: r["candidates"] for r in normalized_lexicon(files.lexicon_entries(spark, str(tmp_path / "lex.json"))).collect()}
    assert got == {"house": ["maison", "demeure"], "cat": ["chat"], "q": ['a "b"']}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b\tc\nd", "d1", None), (1, 'say "hi"', "d2", 0)], "qid int, text string, doc_id string, rel int")
    path = str(tmp_path / "out")
    lines = sinks.tsv_lines(df, "qid", "text")
    assert sinks.write_lines(lines, path, order=["value"]) and not sinks.write_lines(lines, path)
    assert [r[0] for r in spark.read.text(path).collect()] == ['1\tsay "hi"', "2\tb c d"]
    assert sorted(r[0] for r in sinks.trec_lines(df, F.col("rel")).collect()) == ["1\t0\td2\t0", "2\t0\td1\t1"]
    assert sorted(r[0] for r in sinks.quoted_lines(df, "qid", "text").collect())[0] == '1\t"say ""hi"""'


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text("\n".join(json.dumps({"id": f"d{i}", "text": "the house " * (60 * i)}) for i in range(1, 4)))
    docs = row_local.json_stream(spark, str(source))
    switched = row_local.switched_stream(docs, {"house": ["maison"]}, 1.0)
    row_local.append(row_local.passage_stream(switched), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["doc_id"], r["n"]) for r in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {("d1", 2), ("d2", 3), ("d3", 4)}
    assert got.where("passage like '%house%'").count() == 0


def test_command_line(spark, tmp_path, capsys):
    from babelframe import cli

    (tmp_path / "d.jsonl").write_text("\n".join(json.dumps({"id": i, "title": "T", "text": "The house is red. Yes."}) for i in "ba"))
    (tmp_path / "lex.json").write_text('{"house": "maison"}')
    (tmp_path / "ids.1.jsonl").write_text("".join(json.dumps({"id": i, "md5": "m"}) + "\n" for i in "ab"))
    (tmp_path / "t.jsonl").write_text(json.dumps({"topic_id": "1", "topics": [{"lang": "eng", "topic_title": "t", "topic_description": "d"}]}))
    at = lambda x: str(tmp_path / x)
    read = lambda x: [r[0] for r in spark.read.text(at(x)).collect()]
    cli.main(["jsonl", at("d.jsonl"), at("docs")])
    cli.main(["jsonl", at("d.jsonl"), at("docs")])
    assert sorted(read("docs")) == ["a\tT The house is red. Yes.", "b\tT The house is red. Yes."]
    cli.main(["passages", at("docs"), at("cut"), "--length", "4", "--overlap", "2"])
    assert read("cut/mapping") == ["0\ta_0", "1\ta_1", "2\ta_2", "3\tb_0", "4\tb_1", "5\tb_2"]
    assert read("cut/passages")[1] == "1\thouse is red. Yes."
    cli.main(["codeswitch", at("docs"), at("switched"), "--lexicon", at("lex.json"), "--probability", "1"])
    assert all("maison" in x for x in read("switched"))
    cli.main(["reorder", at("d.jsonl"), at("sorted"), "--ids", at("ids.1.jsonl"), "--check-hash"])
    assert [json.loads(x)["id"] for x in read("sorted")] == ["a", "b"]
    cli.main(["topics", at("t.jsonl"), at("topics")])
    assert read("topics/eng") == ["1\tt d"]
    cli.main(["sentences", at("docs"), at("sent")])
    assert len(read("sent")) == 4
    said = capsys.readouterr().out
    assert "kept" in said and "2 documents differ" in said
