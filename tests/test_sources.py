import json

from pyspark.sql import functions as F

from tessera.operators import anchors as A
from tessera.sources import markup, records


def test_tei_lines_and_translations(spark):
    xml = '<TEI xmlns="urn:x"><l id="c1.1" corresp="t1.p1"><w form="ud"/> <w form="X"/><w form="re-a&d;"/></l><l id="c1.2">plain &h; text</l><l id="c1.3"> </l></TEI>'
    tr = '<TEI><p id="t1.p1" corresp="c1.1">In those days</p><p id="t1.p2">lost</p></TEI>'
    docs = spark.createDataFrame([(1, xml), (2, "<broken")], "doc int, xml string")
    lines = markup.scan(docs, markup.TeiLines, "xml", ["doc"])
    assert [(r["line_id"], r["text"]) for r in lines.orderBy("ord").collect()] == [("c1.1", "ud re-a_d_"), ("c1.2", "plain _h_ text")]
    keys = markup.scan(spark.createDataFrame([(1, tr)], "doc int, xml string"), markup.TeiTranslations, "xml", []).collect()
    t = spark.createDataFrame([(r["key"], r["ord"], r["text"]) for r in keys], "key string, ord int, text string")
    got = {r["line_id"]: r["translation"] for r in A.match_translations(spark.createDataFrame([("c1.1", "t1.p1"), ("c1.2", None)], "line_id string, corresp string"), t).collect()}
    assert got == {"c1.1": "In those days", "c1.2": None}


def test_tablet_words(spark):
    xml = '<T><docID>D1</docID><lb/><w trans="a" mrp0sel=" 2 " mrp1="x@y" mrp2="lem@glo@feat@cat"><sGr>LUGAL</sGr></w><w trans="b" mrp0sel="DEL" mrp1="x@y"/><lb/><w trans="c" mrp1="m@g@f"/><w trans="" mrp0sel="9" mrp1="z@z"/></T>'
    words = markup.scan(spark.createDataFrame([(xml,)], "xml string"), markup.TabletWords, "xml", [])
    got = words.orderBy("ord").collect()
    assert [(r["line_no"], r["trans"], r["lemma"]) for r in got] == [(0, "a", "lem"), (0, "b", None), (1, "c", "m"), (1, "", None)]
    assert got[0]["doc_id"] == "D1" and got[0]["sumerograms"] == ["LUGAL"]
    assert [(r["cf"], r["has_sumerogram"]) for r in markup.lemma_records(words).orderBy("cf").collect()] == [("lem", True), ("m", False)]


def test_dictionaries(spark):
    mw = "<mw><H1><h><key1>deva</key1></h><body>(<ab>fr.</ab> <s>div</s>) heavenly, divine</body></H1><H1A><h><key1>deva</key1></h><body>again</body></H1A></mw>"
    e = markup.scan(spark.createDataFrame([(mw,)], "xml string"), markup.DictionaryEntries, "xml", [])
    from tessera.functions.text import gloss_segments
    from tessera.operators.corpus import best_per_key

    first = best_per_key(e, ["key"], [F.col("ord")]).select("key", gloss_segments(F.col("body")).alias("g")).collect()
    assert [(r["key"], r["g"]) for r in first] == [("deva", ["heavenly", "divine"])]
    lsj = '<x><entryFree key="lo/gos"><tr>word,</tr> and <tr>reason</tr></entryFree><entryFree key="no"/></x>'
    got = markup.scan(spark.createDataFrame([(lsj,)], "xml string"), markup.LexiconEntries, "xml", []).collect()
    assert [(r["key"], r["glosses"]) for r in got] == [("lo/gos", ["word", "reason"])]


def test_atf(spark):
    text = "\n".join(["&P100001 = A", "#atf: lang sux", "@tablet", "1. lugal e2", "2' mu", "3'. no", "$ blank", "# note", "&P100002 = B", "#atf: lang akk", "1. szarrum", "&P100003 = C", "1. lost", "#atf: lang sux", "1. kept", "&X = bad", "1. no"])
    got = {r["p_number"]: (r["designation"], r["lines"]) for r in records.parse_atf(spark.createDataFrame([(text,)], "text string")).collect()}
    assert got == {"P100001": ("A", ["lugal e2", "mu"]), "P100003": ("C", ["kept"])}


def test_cdl(spark):
    doc = {"cdl": [{"type": "line-start"}, {"f": {"lang": "sux", "form": "lugal", "cf": "lugal"}}, {"cdl": [{"f": {"lang": "sux-x", "form": "e2"}}, {"f": {"lang": "akk", "form": "bitum"}}]}, {"ftype": "line-start", "cdl": [{"f": {"lang": "sux", "form": "mu"}}]}]}
    leaves = records.walk_cdl(spark.createDataFrame([("d", json.dumps(doc)), ("x", "{bad")], "doc string, js string"), "js", "doc")
    assert records.cdl_lemmas(leaves).count() == 3
    assert [r["line"] for r in records.cdl_lines(leaves).orderBy("line_no").collect()] == ["lugal e2", "mu"]
    pairs = A.bilingual_pairs(leaves.select("doc_id", "line_no", "lang", "ord", F.col("form").alias("word"))).collect()
    assert [(r["sumerian"], r["akkadian"]) for r in pairs] == [("lugal", "bitum")]


def test_conllu(spark):
    rows = ["## chapter: 1,2", "# c", "1\ta\tA\tNOUN\t_\t_\t0\t_\t_\t_", "1-2\tx\tX\tNOUN\t_\t_\t0\t_\t_\t_", "2.1\tx\tX\tNOUN\t_\t_\t0\t_\t_\t_", "bad\trow\tof\tfour", "2\t.\t.\tPUNCT\t_\t_\t0\t_\t_\t_", "", "1\tb\t_\tVERB\t_\t_\t0\t_\t_\t_"]
    files = spark.createDataFrame([("f", "\n".join(rows))], "path string, text string")
    tokens, counts = records.parse_conllu(files)
    assert [(r["sent"], r["form"], r["lemma"]) for r in tokens.orderBy("ord").collect()] == [(0, "a", "A"), (1, "b", "")]
    assert counts.first()["bad_lines"] == 1
    assert records.conllu_headers(files).first()["value"] == "1,2"


def test_beta_code_and_sentences(spark):
    assert records.beta_to_unicode("lo/gos") == "λόγος" and records.beta_to_unicode("*)aqhna=") == "Ἀθηνᾶ" and records.beta_to_unicode("123") == "123"
    js = json.dumps({"sentences": [{"tokens": [{"type": "word", "form": "lo/gos", "lemma": {"entry": "logos", "POS": "noun"}}, {"type": "punct", "form": "."}]}]})
    got = records.parse_sentences_json(spark.createDataFrame([("f", js)], "path string, text string")).collect()
    assert [(r["form"], r["lemma"]) for r in got] == [("λόγος", "logos")]


def test_vector_text(spark):
    good = spark.createDataFrame([(0, "king 0.5 1"), (1, "sea 2 3")], "row_idx long, value string")
    assert [(r["word"], list(r["vec"])) for r in records.parse_vectors_text(good, 2).orderBy("row_idx").collect()] == [("king", [0.5, 1.0]), ("sea", [2.0, 3.0])]
    bad = spark.createDataFrame([(0, "king 0.5")], "row_idx long, value string")
    try:
        records.parse_vectors_text(bad, 2).collect()
    except Exception as e:
        assert "has not 2 numbers" in str(e)
    else:
        raise AssertionError("no error")


def test_space_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(i, f"w{i}", [i * 0.1, 1.0]) for i in range(20)], "row_idx long, word string, vec array<double>")
    records.write_space(s, str(tmp_path / "s"), half=True)
    back = records.read_space(spark, str(tmp_path / "s"), 2).orderBy("row_idx").collect()
    assert [r["word"] for r in back] == [f"w{i}" for i in range(20)]
    assert abs(back[3]["vec"][0] - 0.3) < 1e-3


def test_html(spark):
    df = spark.createDataFrame([(1, "<p>a <!-- x --><script>no</script> b</p><a class='q' href=\"/u\">c</a>")], "page_id int, html string")
    assert df.select(markup.html_text(F.col("html")).alias("t")).first()["t"] == "a b c"
    assert markup.html_links(df).first()["href"] == "/u"


def test_zip_archives(spark, tmp_path):
    import zipfile

    from tessera.sources import archives

    leaf = lambda form, lang="sux": {"f": {"lang": lang, "form": form, "cf": form, "gw": "g", "pos": "N"}}
    tree = lambda *forms: json.dumps({"cdl": [{"type": "line-start", "cdl": [leaf(f) for f in forms]}]})
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("p/corpusjson/P1.json", tree("lugal", "e"))
        z.writestr("p/corpusjson/P2.json", tree("an"))
        z.writestr("p/corpusjson/P3.json", "{broken")
        z.writestr("p/other/P4.json", tree("no"))
        z.writestr("p/catalogue.json", json.dumps({"members": {"P1": {"genre": "Incantation"}, "P2": {"genre": "letter"}, "P9": {}}}))
        z.writestr("etc/transliterations/c.1.1.xml", "<a/>")
        z.writestr("etc/translations/t.1.1.xml", b"<b>\xff</b>")
    path = str(tmp_path / "p.zip")
    leaves = archives.project_leaves(spark, path)
    lemmas, texts = archives.project_texts(leaves, "project")
    assert sorted(r["form"] for r in lemmas.collect()) == ["an", "e", "lugal"]
    assert {r["p_number"]: (r["lines"], r["source"]) for r in texts.collect()} == {"P1": (["lugal e"], "project"), "P2": (["an"], "project")}
    assert [(r["doc_id"], r["tokens"]) for r in archives.incantations(spark, path).collect()] == [("P1", ["lugal", "e"])]
    assert sorted((r["kind"], r["comp_id"], r["xml"]) for r in archives.composition_files(spark, path).collect()) == [("translation", "t.1.1", "<b>\ufffd</b>"), ("transliteration", "c.1.1", "<a/>")]
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("q/corpusjson/Q1.json", tree("re"))
    assert [r["doc_id"] for r in archives.incantations(spark, str(tmp_path / "q.zip")).collect()] == ["Q1"]


def test_vectors_text_round_trip(spark, tmp_path):
    space = spark.createDataFrame([(0, "a", [0.5, -1.25]), (1, "b", [3.0, 0.1])], "row_idx long, word string, vec array<float>")
    records.write_vectors_text(space.coalesce(1), str(tmp_path / "v"))
    lines = spark.read.text(str(tmp_path / "v")).withColumn("row_idx", F.when(F.col("value").startswith("a"), 0).otherwise(1))
    assert sorted(map(tuple, records.parse_vectors_text(lines, 2).collect())) == sorted(map(tuple, space.collect()))
