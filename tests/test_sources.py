import json

import pytest
from pyspark.sql import functions as F

from lodestone.plans import build, hypothesis
from lodestone.session import register, scratch
from lodestone.sources import readers, sinks
from lodestone.streaming import slices

XML = """<PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID Version="2">11</PMID><Article><ArticleTitle>A &amp; B <i>x</i> rest</ArticleTitle><Abstract><AbstractText>One.</AbstractText><AbstractText>Two.</AbstractText></Abstract><PublicationTypeList><PublicationType>Journal Article</PublicationType></PublicationTypeList></Article><KeywordList><Keyword>heart attack</Keyword></KeywordList></MedlineCitation><PubmedData><History><PubMedPubDate><Year>2003</Year></PubMedPubDate><PubMedPubDate><Year>2001</Year></PubMedPubDate></History></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID Version="1">12</PMID><Article><ArticleTitle>Retracted: no</ArticleTitle></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID Version="1">13</PMID><Article><ArticleTitle>C</ArticleTitle><PublicationTypeList><PublicationType>Comment</PublicationType></PublicationTypeList></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID Version="1">14</PMID><Article><ArticleTitle>D</ArticleTitle></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>"""


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    rows = readers.articles_xml(spark, str(tmp_path / "a.xml"))
    found = {r.doc: (r.year, r.text) for r in readers.extract_articles(rows, keywords="also").collect()}
    assert found == {"PMID11_2": (2001, "A & B . One. . Two. . heart_attack"), "PMID14_1": (None, "D")}
    assert [r.doc for r in readers.extract_articles(rows, until=2002).collect()] == ["PMID11_2"]
    assert [r.text for r in readers.extract_articles(rows, until=2002, keywords="only").collect()] == ["heart_attack"]


def test_concepts(spark, tmp_path):
    (tmp_path / "con").write_text("\n".join("|".join([c, *(["x"] * 13), t, "y"]) for c, t in (("C1", "b"), ("C1", "a"), ("C1", "b"), ("C2", "z"))))
    texts = readers.concept_texts(spark, str(tmp_path / "con"))
    assert {r.label: r.text for r in readers.distinct_texts(texts).collect()} == {"C1": "a b", "C2": "z"}
    (tmp_path / "rel").write_text("C1|a|b|SY|C2|z\n")
    assert [tuple(r) for r in readers.concept_relations(spark, str(tmp_path / "rel")).collect()] == [("C1", "SY", "C2")]


def test_binary_edges(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.25), (4_000_000_000, 1, 1.0)], "src long, dst long, w double")
    path = scratch(spark, "edges")
    sinks.binary_edges(e, path)
    assert sorted(tuple(r) for r in readers.binary_edges(spark, path, split=12).collect()) == sorted(tuple(r) for r in e.collect())
    assert sorted(r.src for r in readers.binary_edges(spark, path, spark.createDataFrame([(1,)], ["id"])).collect()) == [1, 4_000_000_000]
    bad = scratch(spark, "bad").removeprefix("file://")
    open(bad, "wb").write(b"x" * 13)
    with pytest.raises(ValueError, match="12-byte"):
        readers.binary_edges(spark, f"file://{bad}")


def test_text_files(spark, tmp_path):
    (tmp_path / "v").write_text("2 3\nheart 0.5 1 -2\n</s> 1 2 3\n")
    assert {r.label: r.vec for r in readers.vectors(spark, str(tmp_path / "v")).collect()} == {"heart": [0.5, 1, -2], "</s>": [1, 2, 3]}
    (tmp_path / "e").write_text("a b 0.5\nc d inf?\n")
    assert sorted(tuple(r) for r in readers.text_edges(spark, str(tmp_path / "e")).collect()) == [("a", "b", 0.5), ("c", "d", 0.0)]
    (tmp_path / "view").write_text("TOPIC: 0 9.5\nheart 3\nlung 2.7\n\nTOPIC: 1 1\nskin 1\n")
    assert sorted(tuple(r) for r in readers.topic_view(spark, str(tmp_path / "view")).collect()) == [(0, 0, "heart", 3), (0, 1, "lung", 2), (1, 0, "skin", 1)]
    (tmp_path / "ev").write_text("L2\t0.5\tTopic_1 a b\nCSim\t0.25\n")
    assert {(r.metric, r.positive, r.score) for r in readers.evaluations(spark, [str(tmp_path / "ev")], []).collect()} == {("L2", True, 0.5), ("CSim", True, 0.25)}
    (tmp_path / "labels").write_text("x\ny\nz\n")
    assert sorted(tuple(r) for r in readers.label_file(spark, str(tmp_path / "labels")).collect()) == [(0, "x"), (1, "y"), (2, "z")]


def test_parameters_and_plugins(spark, tmp_path):
    (tmp_path / "p").write_text("L2 1 2 0 1\nNope 1 1 1 1\n")
    with pytest.raises(ValueError, match="Illegal hyperparam file"):
        readers.parameters(spark, str(tmp_path / "p"), {"L2"}, [])
    assert readers.parameters(spark, None, {"L2"}, [("L2", 1.0, 1.0, 0.0, 1.0)]).count() == 1
    (tmp_path / "j").write_text(json.dumps({"text-plugins": ["t"], "edge-plugins": [["e", 2]]}))
    assert readers.plugins(str(tmp_path / "j")) == (["t"], [("e", 2.0)])


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("PMID1_1", None, ["a", "b"])], "doc string, year int, tokens array<string>")
    sinks.documents(docs, str(tmp_path / "docs"))
    assert [r.value for r in spark.read.text(str(tmp_path / "docs")).collect()] == ["PMID1_1 2147483647 a b"]
    vec = spark.createDataFrame([("PMID1_1", [0.5, 1.0]), ("heart", [1.0, 2.0])], "label string, vec array<float>")
    sinks.vector_tables(vec, str(tmp_path / "vec"))
    routed = readers.by_kind(spark.read.parquet(str(tmp_path / "vec")), spark.createDataFrame([("heart",)], ["label"]))
    assert [r.label for r in routed.collect()] == ["heart"]
    view = spark.createDataFrame([(0, 0, "heart", 3)], "topic int, rank int, word string, cnt long")
    assert json.loads(sinks.topics_json(view).first().json) == {"name": "Topic_0", "children": [{"name": "heart", "size": "3"}]}
    papers = spark.createDataFrame([(0, 1, "7", 0.5)], "topic int, rank int, paper string, score double")
    titles = spark.createDataFrame([("8", "t")], "paper string, title string")
    assert json.loads(sinks.papers_json(papers, titles).first().json) == {"topic": "Topic_0", "papers": [{"pmid": "7", "title": None}]}
    rows = spark.createDataFrame([("L2", 0.5, [(1, ["a", "b"])])], "metric string, score double, topics array<struct<topic:int,words:array<string>>>")
    assert sinks.evaluation_lines(rows).first().value == "L2\t0.5\tTopic_1 a b"
    assert json.loads(sinks.eval_json(rows).first().json) == {"name": "L2", "score": 0.5, "topics": [["a", "b"]]}
    net = json.loads(sinks.network_json([("heart*", "Topic_1", 0.5)]))
    assert net["nodes"] == [{"id": "Topic_1", "group": 1}, {"id": "heart", "group": 2}] and net["links"][0]["value"] == 0.5


def test_stream(spark):
    register(spark, "/root/testdata/sf0.001")
    assert spark.sql("select count(*) from region").first()[0] == 5
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = scratch(spark, "events")
    events.write.parquet(folder)
    out = slices.counts(slices.read(spark, folder, events.schema))
    q = out.writeStream.format("memory").outputMode("complete").queryName("sliced").option("checkpointLocation", scratch(spark, "stream")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(spark.table("sliced")) == key(slices.counts(events))


def test_build_and_ask(spark):
    words = [["heart", "attack", "risk", "aspirin"], ["skin", "rash", "cream", "burn"], ["aspirin", "burn", "pain", "dose"]]
    rows = [(f"PMID{k}_1", [words[k % 3][(k + j * j) % 4] for j in range(12)] + [f"w{k % 7}"]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc string, tokens array<string>")
    folder = scratch(spark, "net")
    options = build.Options(size=8, neighbors=3, min_count=1, min_length=3)
    made = build.build(docs, folder, options)
    assert made["edges"].count() > 0 and made["labels"].count() == made["labels"].select("id").distinct().count()
    again = build.build(docs, folder, options)
    assert again["edges"].count() == made["edges"].count()
    found = hypothesis.ask(["Heart", "skin"], made["network"].select("a", "b", "w"), made["documents"], made["vectors"].select("label", "vec"), k=3, cloud_size=10, papers=2, rounds=3)
    assert found.path.where("label in ('heart', 'skin')").count() == 2
    assert found.scores.where("metric = 'PolyMultiple'").first().score is not None and found.papers.count() > 0
    only = hypothesis.ask(["heart", "skin"], made["network"].select("a", "b", "w"), made["documents"], made["vectors"], path_only=True)
    assert only.cloud is None
    with pytest.raises(ValueError, match="Failed to find: nothing"):
        hypothesis.ask(["heart", "nothing"], made["network"], made["documents"], made["vectors"])
    assert found.path.select(F.max("leg")).first()[0] == 0


def test_numbered_lines_of_several_files_and_splits(spark, tmp_path):
    """Numbers follow the files' names and lines, whatever the sizes of files and splits are."""
    sizes = [3, 400, 1, 90]
    n = 0
    for k, size in enumerate(sizes):
        (tmp_path / f"part-{k}").write_text("".join(f"line{n + j:05d}\n" for j in range(size)))
        n += size
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("700b", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            assert sorted(tuple(r) for r in readers.label_file(spark, str(tmp_path)).collect()) == [(k, f"line{k:05d}") for k in range(n)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_strict_vectors_and_cut(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0])], "label string, vec array<float>")
    asked = spark.createDataFrame([("a",), ("b",)], "label string")
    assert readers.vectors_of(v, asked).count() == 1
    with pytest.raises(KeyError, match="no vector of b"):
        readers.vectors_of(v, asked, strict=True)
    (tmp_path / "c").write_text("C1|x|A text. With more. And more\nC2|y|None at all.\n")
    assert sorted(tuple(r) for r in readers.concept_texts(spark, str(tmp_path / "c"), 3, cut=True).collect()) == [("C1", "A text"), ("C2", "None at all.")]
    assert readers.concept_texts(spark, str(tmp_path / "c"), 3).where("label = 'C1'").first().text == "A text. With more. And more"


def test_subword_vectors(spark):
    from lodestone.operators import topics

    known = spark.createDataFrame([("heart", [1.0, 0.0]), ("hearts", [0.0, 1.0]), ("skin", [5.0, 5.0])], "label string, vec array<float>")
    asked = spark.createDataFrame([("heartz",), ("qq",), ("skin",)], "label string")
    made = {r.label: r.vec for r in topics.subword_vectors(asked, known).collect()}
    assert set(made) == {"heartz"} and 0 < made["heartz"][0] < 1 and sum(made["heartz"]) == pytest.approx(1, abs=1e-5)
