import glob
import json

import pytest
from pyspark.sql import functions as F

from babelframe import cli
from babelframe.functions import text as T
from babelframe.operators import passages
from babelframe.plans import preparation as P
from babelframe.sources import campaigns as C
from babelframe.sources import files, markup
from babelframe.sources.catalog import Catalog, Corpus


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("campaign")

    def put(name, text, encoding="latin-1"):
        path = at / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode(encoding))

    put("2000rels/biling_qrels", "1 0 LA1 1\n1 0 GH1 1\n2 0 LA2 0\n")
    put("2001rels/qrels_bilingual", "41 0 LA3 1\n41 0 LA3 1\n42 0 LA4 -1\n")
    put("2002rels/qrels_EN", "91 0 LA5 2\n")
    put("2003rels/qrels_english", "141 0 LA6 0\n141 0 LA7 1\n")
    put("2001rels/qrels_german", "41 0 SP1 x\n")
    put("topics2000/TOP-G.txt", "<top>\n<num>\nC001\n<G-title> Erste\nZeile\n\n<G-desc> a < b\n\n<G-narr> n\n<top>\n<num> C002\n<G-title> Zwei\n<G-desc> Zwei d")
    for y, n in (("2001", 41), ("2002", 91), ("2003", 141)):
        put(f"topics{y}/Top-de{y[-2:]}.txt", "".join(f"<top>\n<num> C{n + i:03d} </num>\n<DE-title> Titel {y} {i} ä &amp; ö </DE-title>\n<DE-desc> d </DE-desc>\n</top>\n" for i in range(4)))
    put("low/clef-en-2000-2003-wo-narrative-Day-2_SOMALI.txt", "query_id: C001\ntitle: kow\ndescription: d\n\nquery_id: C041\ntitle: laba\ndescription: e\n", "utf-8")
    put("rankings/7.txt", "A\t3\nB\t2\n")
    put("rankings/95.tsv", "C\t3\nD\t2\n")
    for i in range(3):
        put(f"docs/la/f{i}.sgml", "".join(f"<DOC><DOCNO>LA{i}{k}</DOCNO><TEXT><P>t</P></TEXT></DOC>" for k in range(4)))
    return str(at)


def test_judgments_by_language_and_year(spark, rows_of, root):
    assert rows_of(C.judgments(spark, root, "english", ["2000", "2001", "2002", "2003"]), "year", "qid", "doc_id", "rel") == [("2000", 1, "GH1", 1), ("2000", 1, "LA1", 1), ("2001", 41, "LA3", 1), ("2001", 41, "LA3", 1), ("2001", 42, "LA4", -1), ("2002", 91, "LA5", 2), ("2003", 141, "LA7", 1)]
    assert rows_of(C.judgments(spark, root, "en", "2003", negatives=True), "doc_id") == [("LA6",)]
    assert C.judgments(spark, root, "fi", "2002").count() == 0
    with pytest.raises(Exception, match="relevance is no number"):
        C.judgments(spark, root, "de", "2001").collect()
    with pytest.raises(ValueError):
        C.judgments(spark, root, "en", "1999")
    with pytest.raises(ValueError):
        C.judgments(spark, root, "xx", "2000")
    assert C.registered(["en", "xx", "German"]) == ["en", "de"]


def test_queries_by_language_and_year(spark, rows_of, root):
    assert rows_of(C.queries(spark, root, "de", "2000")) == [("de", "2000", 1, "ErsteZeile", "a < b"), ("de", "2000", 2, "Zwei", "Zwei d")]
    assert rows_of(C.queries(spark, root, "de", "2002", limit=1), "qid", "title") == [(91, "Titel 2002 0 ä & ö"), (92, "Titel 2002 1 ä & ö")]
    assert rows_of(C.queries(spark, root, "so", ["2000", "2001"], low_resource_root=root + "/low"), "year", "qid", "title") == [("2000", 1, "kow"), ("2001", 41, "laba")]
    with pytest.raises(ValueError):
        C.queries(spark, root, "ru", "2000")


def test_rankings_by_year(spark, rows_of, root):
    assert rows_of(C.rankings(spark, root + "/rankings", "2002"), "qid", "rank", "doc_id") == [(95, 0, "C"), (95, 1, "D")]
    assert len(rows_of(C.rankings(spark, root + "/rankings"))) == 4


def test_aggregation(spark, rows_of, root):
    years = list(C.YEARS)
    judged = P.judgments_of(spark, root, ["en", "xx"], years)
    queries = P.queries_of(spark, root, ["de"], years)
    kept, pairs = P.aggregated(judged, queries, ["de"])
    assert rows_of(kept, "qid", "concat")[0] == (1, "ErsteZeile a < b") and [r[0] for r in rows_of(kept, "qid")] == [1, 41, 42, 91, 141]
    assert rows_of(pairs) == [(1, "LA1"), (41, "LA3"), (42, "LA4"), (91, "LA5"), (141, "LA7")]
    with pytest.raises(Exception, match="out of range"):
        P.aggregated(judged.withColumn("qid", F.lit(201)), queries, ["de"])[1].collect()


def test_limit_over_files(spark, root):
    catalog = Catalog(root + "/docs", {("en", "2001"): [Corpus("la", "english_latimes")]})
    for limit, n in ((1, 1), (3, 3), (4, 4), (5, 8), (100, 12)):
        assert catalog.documents(spark, "en", "2001", limit=limit).count() == n, limit
    with pytest.raises(ValueError):
        catalog.documents(spark, "en", "1999")
    triple = Catalog(root + "/docs", {("en", "2002"): [Corpus("la", "english_latimes")]}).collection(spark, "en", "2002", "de", root, root, root + "/rankings", 1)
    assert triple.documents.count() == 0 and triple.queries.count() == 4 and triple.judgments.count() == 1


def test_commands(spark, root, tmp_path):
    out = str(tmp_path)

    def lines(name):
        return [x for p in sorted(glob.glob(f"{out}/{name}/part-*")) for x in open(p, encoding="utf-8").read().splitlines()]

    cli.main(["qrels", root, out, "--languages", "en", "--years", "2001"])
    assert lines("qrels/en_2001_qrel.tsv") == ["41\t0\tLA3\t1", "41\t0\tLA3\t1", "42\t0\tLA4\t1"]
    cli.main(["queries", root, out, "--languages", "de", "xx", "--years", "2000"])
    assert lines("queries/de_2000_queries_title.tsv") == ["1\tErsteZeile", "2\tZwei"]
    cli.main(["aggregate", root, out, "--judgments", root, "--languages", "de"])
    assert lines("qrels/en_2000-2003_qrels.tsv")[:2] == ["1\t0\tLA1\t1", "41\t0\tLA3\t1"]
    (tmp_path / "d.tsv").write_text("d1\tthe red cat\nd2\tthe dog\nd3\tred red\n")
    (tmp_path / "q.tsv").write_text("1\tred cat\n2\tdog\n")
    (tmp_path / "j.txt").write_text("1 0 d1 1\n2 0 d1 1\n")
    (tmp_path / "lex.json").write_text(json.dumps({"Red": ["rouge"], "cat": "chat"}))
    cli.main(["search", f"{out}/d.tsv", f"{out}/run", "--queries", f"{out}/q.tsv", "--top", "2"])
    assert [x.split()[:4] for x in lines("run")] == [["1", "Q0", "d1", "1"], ["1", "Q0", "d3", "2"], ["2", "Q0", "d2", "1"]]
    cli.main(["evaluate", f"{out}/run", f"{out}/measures", "--judgments", f"{out}/j.txt"])
    assert lines("measures") == ["1\t1.0\t1.0\t1.0", "2\t0.0\t0.0\t0.0"]
    cli.main(["translate", f"{out}/q.tsv", f"{out}/fr", "--lexicon", f"{out}/lex.json"])
    assert sorted(lines("fr")) == ["1\trouge chat", "2\tdog"]


def test_treebank_tokens(spark):
    cases = {
        'He said, "I can\'t go." Really?': ["He", "said", ",", "``", "I", "ca", "n't", "go.", "''", "Really", "?"],
        "It's 3,000 (cannot) -- they'll wait...": ["It", "'s", "3,000", "(", "can", "not", ")", "--", "they", "'ll", "wait", "..."],
        "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.treebank_tokens(F.col("t")).alias("w"))
    got = {r["t"]: r for r in df.withColumn("back", T.join_treebank(F.col("w"))).collect()}
    assert {k: r["w"] for k, r in got.items()} == cases
    assert got['He said, "I can\'t go." Really?']["back"] == 'He said, "I can\'t go." Really?'


def test_subword_passages(spark):
    import os

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    text = "Straße <|endoftext|> " + " ".join(f"word{i}" for i in range(100))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id bigint, text string")
    rows = passages.offset_passages(df, passages.subword_offsets(path), 50, 10).orderBy("doc_id", "k").collect()
    assert rows[-1]["passage"] == "" and all(r["passage"] in text for r in rows) and len(rows) > 4
    offsets = passages.subword_offsets(path)()(text)
    assert len(rows) - 1 == -(-len(offsets) // 40) and rows[0]["passage"] == text[offsets[0][0] : offsets[49][1]]


def test_open_topics_and_ranking_folders(spark, rows_of):
    frame = spark.createDataFrame([("f", "head<top><num>C001<E-title>a</top>x<TOP>\n<num>C002\n<E-title>b\n")], "path string, text string")
    assert rows_of(markup.topics(markup.open_topics(frame), "E"), "qid", "title") == [(1, "a"), (2, "b")]
    rows = spark.createDataFrame([("part-0", "/x/qid=7/part-0", 0, "A\t1"), ("9.txt", "/x/9.txt", 0, "B")], "file_name string, file_path string, line_no int, value string")
    assert rows_of(files.rankings(rows), "qid", "doc_id") == [(7, "A"), (9, "B")]
