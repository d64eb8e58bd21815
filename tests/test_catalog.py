import pytest
from pyspark.sql import functions as F

from weftscan.plans import catalog, views
from weftscan.plans.catalog import Parser, Plugin, UnknownName, customize_plugin
from weftscan.plans.extract import extract, parsed, register_udtf, serving
from weftscan.sources import files as sources


def plugin():
    return Plugin("p", [Parser("a", "go", ("x", "y"), {"comment": True, "code": False}), Parser("b", "java", ("y", "z"), {"comment": True, "code": False})])


def test_names_are_checked():
    for bad in ("", "*", "a"):
        with pytest.raises(ValueError):
            plugin().customize().add_parser(Parser("c", "go"), bad)
    with pytest.raises(ValueError):
        Plugin("q", [Parser("a", "go"), Parser("a", "go")])
    with pytest.raises(UnknownName, match="nobody.*It has"):
        plugin().get_parser("nobody")


def test_questions():
    p = plugin()
    assert p.parser_names() == ["a", "b"] and p.supported_file_types == ["x", "y", "z"]
    assert p.has_parser("a") and not p.has_parser("c") and p.parser_names_for("y") == ["a", "b"]
    assert p.language_settings() == [{"languageId": "x", "parser": "a"}, {"languageId": "y,z", "parser": "b"}]
    assert p.language_settings_for("a") == [{"languageId": "x,y", "parser": "a"}]
    assert p.language_settings_for("a", ["q", "r"]) == [{"languageId": "q,r", "parser": "a"}]
    assert p.language_settings_for("a", []) == []
    assert p.language_settings_for_file_type(["z", "x", "z"]) == [{"languageId": "x", "parser": "a"}, {"languageId": "z", "parser": "b"}]
    with pytest.raises(UnknownName):
        p.language_settings_for_file_type("q")
    with pytest.raises(ValueError):
        p.language_settings_for("*", ["x"])


def test_a_builder_leaves_its_plugin_alone():
    p = plugin()
    b = p.customize("mine").rename_parser("a", "c").add_file_types("c", ["x", "w"]).remove_file_types("*", ["y"]).filter_tags("*", {"code": True})
    assert b.build().parser_names() == ["c", "b"] and b.get_parser("c").file_types == ("x", "w") and b.name == "mine"
    assert p.parser_names() == ["a", "b"] and p.get_parser("a").filter_tags is None
    assert b.set_name("n").build().name == "n" and b.rename_parser("c", "c").parser_names() == ["c", "b"]
    assert b.remove_parser("*").parser_names() == []
    with pytest.raises(UnknownName):
        p.customize().remove_parser(["a", "nobody"])
    assert p.customize().duplicate_parser("a", "d").language_settings()[-1] == {"languageId": "x,y", "parser": "d"}
    assert p.customize().duplicate_parser("a", "d").parser_names_for("y")[-1] == "d"


def test_filters_replace_one_another():
    b = plugin().customize().filter_tags("a", {"comment": False}).filter_tags("a", {"code": True})
    assert dict(b.get_parser("a").filter_tags) == {"code": True}
    assert b.filter_tags("a", {"code": None}).get_parser("a").filter_tags is None
    c = plugin().customize().filter_tags_for_file_type("y", {"comment": False}, "only-y")
    assert c.get_parser("only-y").scanner == "java" and c.language_settings()[-1] == {"languageId": "y", "parser": "only-y"}
    for bad, error in (("*", ValueError), ("q", UnknownName)):
        with pytest.raises(error):
            plugin().customize().filter_tags_for_file_type(bad, {}, "n")


def test_configurations():
    made = plugin().define_config({"languageSettings": [{"languageId": "x", "parser": "other"}], "plugins": ["theirs"], "words": [1]})
    assert [getattr(x, "name", x) for x in made["plugins"]] == ["p", "theirs"] and made["words"] == [1]
    assert made["languageSettings"][-1] == {"languageId": "x", "parser": "other"} and len(made["languageSettings"]) == 3
    assert catalog.recommended(plugin()).keys() == {"plugins", "languageSettings"} and catalog.settings(plugin()).keys() == {"plugins"}
    with pytest.raises(TypeError):
        customize_plugin(plugin(), "a")
    with pytest.raises(ValueError):
        customize_plugin(plugin(), {"name": "a"})
    assert dict(customize_plugin(plugin(), {"tags": {"code": True}}).get_parser("b").filter_tags) == {"code": True}


def test_ready_made_plugins():
    assert catalog.STRINGS_COMMENTS.parser_names()[0] == "c-cpp-strings-comments" and len(catalog.STRINGS_COMMENTS.parsers) == 10
    assert catalog.JAVASCRIPT.parser_names() == ["javascript", "javascriptreact"]
    assert catalog.TYPESCRIPT.parser_names() == catalog.SYNTAX_TREE.parser_names()


def test_relations_agree_with_plugins(spark):
    p = catalog.STRINGS_COMMENTS.customize().add_parser(catalog.EXAMPLE.parsers[0]).build()
    df = p.to_df(spark)
    assert {r.file_type: r.parser for r in views.serving(df).collect()} == {t: q.name for t, q in serving(p).items()}
    assert [(r.language_id, r.parser) for r in views.language_settings(df).orderBy("ordinal").collect()] == [(x["languageId"], x["parser"]) for x in p.language_settings()]
    assert [r.file_type for r in views.supported_file_types(df).orderBy("position").collect()] == p.supported_file_types
    assert views.check_names(df).isEmpty()


FILES = [(1, "a.go", "go", "// hi\nx := \"it's\""), (2, "b.rb", "ruby", "# yo"), (3, "c.txt", "text", "// no"), (4, "d.tsx", "typescriptreact", "<p>text</p>"), (5, "e.go", "go", None)]


def test_files_run_through_their_parsers(spark):
    df = spark.createDataFrame(FILES, "file_id long, filename string, file_type string, content string")
    both = Plugin("all", catalog.STRINGS_COMMENTS.customize().remove_parser("typescript-strings-comments").parsers + catalog.SYNTAX_TREE.customize().remove_parser("javascript").remove_parser("javascriptreact").parsers)
    rows = extract(df, both).orderBy("file_id", "pos").collect()
    assert [(r.file_id, r.parser, r.text) for r in rows] == [(1, "go-strings-comments", "hi"), (1, "go-strings-comments", "it's"), (2, "ruby-strings-comments", "yo"), (4, "typescriptreact", "p"), (4, "typescriptreact", "text"), (4, "typescriptreact", "p")]
    assert parsed(df, both).where("file_id = 3").first().segments is None
    plan = parsed(df, both)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_later_settings_win(spark):
    p = catalog.SINGLE["go"].customize().add_parser(catalog.EXAMPLE.parsers[0]).build()
    made = p.define_config({"languageSettings": [{"languageId": "go", "parser": "c-style-comments"}]})
    assert serving(p, made["languageSettings"])["go"].name == "c-style-comments"


def test_table_function(spark):
    register_udtf(spark)
    spark.createDataFrame(FILES[:1], "file_id long, filename string, file_type string, content string").createOrReplaceTempView("some_files")
    rows = spark.sql("SELECT file_id, pos, text FROM some_files, LATERAL scan_segments(content, 'go') ORDER BY pos").collect()
    assert [r.text for r in rows] == ["hi", "\nx := ", "it's"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.py").write_text("# hi\n")
    (tmp_path / "in/sub/b.zzz").write_text("x")
    for read, end in ((sources.read_tree, "\n"), (sources.read_text, "")):
        rows = {r.filename.rsplit("/", 1)[1]: (r.file_type, r.content) for r in read(spark, str(tmp_path / "in")).collect()}
        assert rows == {"a.py": ("python", "# hi" + end), "b.zzz": (None, "x")}
    assert sources.read_tree(spark, str(tmp_path / "in"), "*.py").count() == 1
    df = spark.createDataFrame([("a,b", 'q"r', 2, 1), ("a", "x\ny", 1, 3)], "uri string, text string, row int, col int")
    sources.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    assert 'a,b","q""r"' in next((tmp_path / "csv").glob("part*")).read_text()
    sources.write_issues(df.coalesce(1), str(tmp_path / "issues"))
    assert [r.uri for r in spark.read.json(str(tmp_path / "issues")).collect()] == ["a", "a,b"]


def test_streams_need_no_state(spark, tmp_path):
    from weftscan.streaming.files import stream_segments

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.go").write_text("// streamed\n")
    out = stream_segments(spark, str(tmp_path / "in"), catalog.STRINGS_COMMENTS)
    query = out.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    assert [r.text for r in spark.sql("SELECT text FROM streamed").collect()] == ["streamed"]


def test_gaps_as_rows_and_as_array(spark):
    from weftscan.operators import gaps

    content = "..AAA..BBB..CCC.."
    segs = [(0, 2, 5), (1, 7, 10), (2, 12, 15)]
    files = spark.createDataFrame([(1, content), (2, ""), (3, "all code"), (4, "x")], "file_id long, content string")
    rows = spark.createDataFrame([(1, p, a, b, content[a:b], None, None, ["comment"]) for p, a, b in segs] + [(4, 0, 0, 1, "x", None, None, ["comment"])], "file_id long, pos int, start int, end int, text string, raw_text string, map array<int>, tags array<string>")
    filled = gaps.fill_rows(files, rows).orderBy("file_id", "pos").collect()
    assert [(r.start, r.end, r.tags[0]) for r in filled if r.file_id == 1] == [(0, 2, "code"), (2, 5, "comment"), (5, 7, "code"), (7, 10, "comment"), (10, 12, "code"), (12, 15, "comment"), (15, 17, "code")]
    assert [(r.file_id, r.text) for r in filled if r.file_id > 1] == [(3, "all code"), (4, "x")]
    grouped = rows.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("pos", "start", "end", "text", "raw_text", "map", "tags"))).alias("s"))
    by_array = files.join(grouped, "file_id", "left").select("file_id", F.explode(gaps.fill_array(F.coalesce("s", F.array().cast(grouped.schema["s"].dataType)), F.col("content"))).alias("x"))
    assert sorted((r.file_id, r.x.pos, r.x.start, r.x.text) for r in by_array.collect()) == sorted((r.file_id, r.pos, r.start, r.text) for r in filled)
