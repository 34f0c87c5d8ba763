import gzip
import io
import tarfile

from pyspark.sql import functions as F

from glossweave.operators import extract
from glossweave.plans import registry
from glossweave.sources import dictionary, readers, sinks
from glossweave.streaming import incremental


def rows(spark, *records):
    return spark.createDataFrame([(r,) for r in records], "record string")


def test_ukwac(spark):
    text = '<text id="ukwac:http://observer.html">\n<s>\nThe\tDT\tthe\ncat\tNN\tcat\n</s>\n<s>\nVi&#7879;t\tNP\tx\n</s>\n</text>'
    got = readers.ukwac(rows(spark, text)).first()
    assert (got.key, got.title, got.source_corpus, got.raw_text) == ("ukwac:http://observer.html", "ukwac:http://observer.html", "ukwac", "The cat Việt")
    h = 0
    for c in got.key:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    assert got.id == h - (1 << 32) * (h >> 31)


def test_pubmed(spark):
    one = "<MedlineCitation><PMID>12345</PMID><Article><ArticleTitle>CHICKEN</ArticleTitle><Abstract><AbstractText>Some text.</AbstractText><CopyrightInformation>mine</CopyrightInformation></Abstract></Article><MeshHeadingList><MeshHeading><DescriptorName>Anit-Chicken Agents</DescriptorName></MeshHeading><MeshHeading><DescriptorName>Non-geese</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>"
    two = "<MedlineCitation><PMID>7</PMID><Article><ArticleTitle>B</ArticleTitle></Article></MedlineCitation>"
    a, b = readers.pubmed(rows(spark, one, two)).orderBy(F.desc("id")).collect()
    assert (a.key, a.id, a.title, a.raw_text, sorted(a.categories)) == ("12345", 12345, "CHICKEN", "Some text.", ["Anit-Chicken Agents", "Non-geese"])
    assert (b.raw_text, b.categories) == ("", [])


def test_senseeval2007(spark):
    good = '<instance id="explain.v.4" corpus="wsj">\n I will <head> explains </head> it \n</instance>'
    got = readers.senseeval2007(rows(spark, good, "<instance>broken")).collect()
    assert [(r.key, r.title, r.id, r.raw_text) for r in got] == [("explain.v.4", "explain", 2, "I will explains it")]


def test_semeval2010(spark):
    got = readers.semeval2010(rows(spark, "<class.n.4>Two classes met. <TargetSentence>The class sat</TargetSentence></class.n.4>"), "train").first()
    assert (got.key, got.source_corpus, got.raw_text) == ("class.n.4", "semeval2010_train", "Two classes met. The class sat")
    assert got.id == 4


def test_all_words(spark):
    text = '<text>\nHe\n<head id="d1.s1.t2" sats="d1.s1.t3">set</head>\n<sat id="d1.s1.t3">up</sat>\n\'s\n*x\n0\n.\nEnd\n</text>'
    got = readers.all_words(spark.createDataFrame([("d", text)], ["doc", "record"])).collect()
    assert [(r.sent, r.tok, r.word, r.id) for r in got] == [(0, 0, "He", ""), (0, 1, "set_up", "d1.s1.t2"), (0, 2, "is", ""), (0, 3, ".", ""), (1, 0, "End", "")]


def test_tagged_and_semantic_words(spark):
    tagged = readers.tagged_words(spark.createDataFrame([("d", '<s><w>The</w><h id="a.1" pos="NN">cat</h></s>')], ["doc", "record"])).collect()
    assert [(r.word, r.id, r.pos) for r in tagged] == [("The", "", ""), ("cat", "a.1", "NN")]
    cor = readers.semcor(spark.createDataFrame([("d", "<s snum=1><wf cmd=done pos=NN lemma=cat lexsn=1:05:00::>cat</wf></s>")], ["doc", "record"])).first()
    assert (cor.lemma, cor.lexsn, cor.pos) == ("cat", "1:05:00::", "NN")


def test_news(spark):
    text = '<nitf><head><meta name="online_sections" content="Arts"/><docdata><doc-id id-string="99"/><identified-content><classifier type="taxonomic_classifier">Top/Arts</classifier></identified-content></docdata><pubdata date.publication="19870101T000000" ex-ref="http://u"/></head><body><body.head><hedline><hl1>Title</hl1></hedline></body.head><body.content><block class="full_text"><p>One.</p><p>Two.</p></block></body.content></body></nitf>'
    got = readers.news(rows(spark, text)).first()
    assert (got.key, got.id, got.title, got.raw_text, got.categories) == ("http://u", 99, "Title", "One.\nTwo.", ["Top/Arts"])
    fields = readers.news_fields(rows(spark, text)).withColumn("key", F.col("url"))
    assert fields.first().published.year == 1987
    assert extract.online_sections(fields).first().section == "Arts"


def test_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<d><doc x="1">A\n</doc><doc>B</doc><docs>no</docs></d>')
    assert [r.record for r in readers.xml_files(spark, str(tmp_path / "a.xml"), "doc").orderBy("pos").collect()] == ['<doc x="1">A\n</doc>', "<doc>B</doc>"]
    assert readers.xml_files(spark, str(tmp_path / "a.xml"), None).first().path == "a.xml"
    (tmp_path / "a.xml.gz").write_bytes(gzip.compress(b"<doc>Z</doc>"))
    (tmp_path / "gz.list").write_text(f"{tmp_path}/a.xml.gz\n")
    assert readers.gzip_xml_list(spark, str(tmp_path / "gz.list"), "doc").first().record == "<doc>Z</doc>"
    with tarfile.open(tmp_path / "a.tgz", "w:gz") as out:
        info = tarfile.TarInfo("in/x.txt")
        info.size = 2
        out.addfile(info, io.BytesIO(b"hi"))
    (tmp_path / "tar.list").write_text(f"{tmp_path}/a.tgz\n")
    assert [(r.name, r.record) for r in readers.tar_list(spark, str(tmp_path / "tar.list")).collect()] == [("in/x.txt", "hi")]
    (tmp_path / "l.txt").write_text("one\ntwo\n")
    assert [(r.line, r.value) for r in readers.line_documents(spark, str(tmp_path / "l.txt")).orderBy("line").collect()] == [(1, "one"), (2, "two")]
    (tmp_path / "h.txt").write_text("cat::1::2::the cat :: sat\nbad\n")
    assert readers.headword_lines(spark, str(tmp_path / "h.txt")).collect()[0].text == "the cat :: sat"
    (tmp_path / "c.conll").write_text("1\tThe\t_\tDT\tDT\t_\t2\tdet\n2\tcat\t_\tNN\tNN\t_\t0\tnull\n\n1\tGo\t_\tVB\tVB\t_\t0\tnull\n")
    got = readers.conll_documents(spark, str(tmp_path / "c.conll")).orderBy("sent", "tok").collect()
    assert [(r.sent, r.word, r.head, r.rel) for r in got] == [(0, "The", 2, "det"), (0, "cat", 0, "null"), (1, "Go", 0, "null")]
    (tmp_path / "w.sql").write_bytes(b"-- x\nINSERT INTO `page` VALUES (1,'a\\'b',2),(3,'c,(d)',4);\n")
    assert [r.row for r in readers.sql_dump(spark, str(tmp_path / "w.sql")).collect()] == [["1", "a'b", "2"], ["3", "c,(d)", "4"]]


def test_dictionary_round_trip(spark, tmp_path):
    synset = spark.createDataFrame([(f"s{k}", "n", [f"w{k}", "shared"], f"thing {k}") for k in range(12)], ["id", "pos", "lemmas", "definition"])
    rel = spark.createDataFrame([(f"s{k}", "@", f"s{k // 3}") for k in range(1, 12)], ["src", "rel", "dst"])
    data = dictionary.data_lines(synset, rel)
    lines = [r.line for r in data.orderBy("offset").collect()]
    (tmp_path / "data.noun").write_text("\n".join(lines) + "\n")
    raw = (tmp_path / "data.noun").read_bytes()
    got = dictionary.read_data(spark, str(tmp_path / "data.noun")).collect()
    assert len(got) == 12
    for r in got:  # every offset is where its line begins
        assert int(raw[r.offset :].split(b" ", 1)[0]) == r.offset
        for p in r.pointers or []:
            assert int(raw[p.offset :].split(b" ", 1)[0]) == p.offset
    ids = {r.definition: r.offset for r in got}
    offsets = spark.createDataFrame([(f"s{k}", ids[f"thing {k}"]) for k in range(12)], ["id", "offset"])
    senses = spark.createDataFrame([("shared", "n", f"s{k}", k + 1) for k in range(12)], ["lemma", "pos", "id", "number"])
    (tmp_path / "index.noun").write_text("\n".join(r.line for r in dictionary.index_lines(senses, offsets).collect()))
    back = dictionary.read_index(spark, str(tmp_path / "index.noun")).orderBy("number").collect()
    assert [r.offset for r in back] == [ids[f"thing {k}"] for k in range(12)]
    (tmp_path / "index.sense").write_text("\n".join(r.line for r in dictionary.sense_index_lines(senses, offsets).collect()))
    assert dictionary.read_sense_index(spark, str(tmp_path / "index.sense")).where("pos_number = 1 and lemma = 'shared'").count() == 12


def test_dictionary_details(spark, tmp_path):
    (tmp_path / "data.x").write_text('  1 licence\n00001740 02 r 02 a_cappella 0 alone(p) 1 002 \\ 01 a 0101 ! 00000005 r 0201 01 + 08 01 | without music; "they sang"; truly\n')
    got = dictionary.read_data(spark, str(tmp_path / "data.x")).first()
    assert [(x.lemma, x.marker, x.lex_id) for x in got.lemmas] == [("a_cappella", "", 0), ("alone", "p", 1)]
    assert [(p.rel, p.offset, p.source, p.target) for p in got.pointers] == [("\\", 1, 1, 1), ("!", 5, 2, 1)]
    assert (got.definition, got.examples, got.frames[0].frame) == ("without music; truly", ["they sang"], 8)
    (tmp_path / "x.exc").write_text("geese goose gander\n")
    assert dictionary.read_exceptions(spark, str(tmp_path / "x.exc"), "n").first().base == "goose"
    (tmp_path / "ic").write_text("wnver::x\n1740n 12.5 ROOT\n")
    assert dictionary.read_content(spark, str(tmp_path / "ic")).first()["count"] == 12.5
    (tmp_path / "m").write_text("a.n.1 b.n.1\n")
    assert dictionary.read_merged_senses(spark, str(tmp_path / "m")).count() == 2
    (tmp_path / "t").write_text("a;b;|c;\n")
    assert dictionary.read_tag_pairs(spark, str(tmp_path / "t")).first().left == ["a", "b"]
    feats = spark.createDataFrame([(0.5, 1)], ["hso", "class"])
    assert [r.line for r in dictionary.arff_lines(feats, "r", ["hso"], "class").orderBy("k").collect()][-2:] == ["@data", "0.5,1"]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], ["row_key", "version", "v"])
    new = spark.createDataFrame([("a", 2, "z")], ["row_key", "version", "v"])
    assert {r.row_key: r.v for r in sinks.upserted(old, new, ["row_key"], "version").collect()} == {"a": "z", "b": "y"}
    assert [r.row_key for r in sinks.unprocessed(old, new).collect()] == ["b"]
    sinks.write_tsv(old.select("row_key", "v"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).where("value = 'a\tx'").count() == 1


def test_streams(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.limit(20).write.parquet(str(tmp_path / "in"))
    stream = incremental.read_files(spark, str(tmp_path / "in"), docs.schema)
    incremental.upsert_stream(stream.select("doc_id"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    assert incremental.word_counts(docs).count() > 0
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert incremental.event_windows(events).agg(F.sum("n")).first()[0] == events.count()
    assert incremental.sessions(events).agg(F.sum("n")).first()[0] == events.count()


def test_registry():
    assert registry.get("reader", "pubmed") is readers.pubmed
    registry.register("parser", "flat", lambda forms, tags: [(0, "root")] * len(forms))
    assert "flat" in registry.names("parser")


def test_instance_lines(spark):
    assert extract.instance_lines(spark.createDataFrame([("a |||| cat b",)], ["value"])).first().value == "<instance>a <head> cat </head> b</instance>"
