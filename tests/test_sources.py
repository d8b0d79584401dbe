"""Sources, sinks, caches, artifacts and made-up benchmarks on files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from gatelens.sources import artifacts, embedders, fixtures, tables

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "k.csv").write_bytes("id,글\n1,한국어\n".encode("cp949"))
    df, encoding = tables.read_csv(spark, str(tmp_path / "k.csv"))
    assert encoding in ("euc-kr", "cp949") and df.first()["글"] == "한국어"
    (tmp_path / "b.csv").write_text('﻿id,t\n1,"a\n""b"""\n', encoding="utf-8")
    df, _ = tables.read_csv(spark, str(tmp_path / "b.csv"))
    assert df.columns == ["id", "t"] and df.first().t == 'a\n"b"'


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], {"k": 1.0})], "id long, l array<string>, m map<string, double>")
    tables.write_rows(df, str(tmp_path / "c"), "csv")
    row = spark.read.csv(str(tmp_path / "c"), header=True, escape='"').first()
    assert row.l == "a|b" and json.loads(row.m) == {"k": 1.0}
    tables.write_rows(df, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).first().l == ["a", "b"]


def test_json_lines(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"key": 1, "instruction_id_list": ["a"], "prompt": "p", "kwargs": [{"n": "1"}]}\n')
    assert tables.read_instruction_rows(spark, str(tmp_path / "i.jsonl")).first().kwargs == [{"n": "1"}]
    (tmp_path / "r.jsonl").write_text('{"prompt": "p", "response": "x"}\n{"prompt": "p", "response": "y"}\n')
    assert [tuple(r) for r in tables.prompt_responses(spark, str(tmp_path / "r.jsonl")).collect()] == [("p", "y")]


def test_traces(spark):
    system, user = {"role": "system", "content": " be brief "}, {"role": "user", "content": "hi"}
    rows = [
        ("'t1'", json.dumps([system, user]), json.dumps({"role": "assistant", "content": "yes"}), " incorrect "), (None, json.dumps({"messages": [user]}), json.dumps({"answer": "42"}), None), ("t3", "plain", "text", ""),
    ]
    df = spark.createDataFrame(rows, "traceId string, input string, output string, label string")
    got = {r.id: r for r in tables.trace_rows(df).collect()}
    assert (got["t1"].Prompt, got["t1"].input, got["t1"].expectedOutput, got["t1"].eval) == ("be brief", "hi", "yes", "incorrect")
    assert (got["t3"].Prompt, got["t3"].input, got["t3"].expectedOutput, got["t3"].eval) == ("", "plain", "text", "correct")
    assert sorted(r.expectedOutput for r in got.values()) == ["42", "text", "yes"]
    with pytest.raises(ValueError):
        tables.trace_rows(df.drop("output"))


def workbook(path):
    cells = lambda row, n: "".join(f'<c r="{chr(65 + i)}{n}" t="s"><v>{v}</v></c>' if isinstance(v, int) else "" if v is None else f'<c r="{chr(65 + i)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for i, v in enumerate(row))
    sheet = lambda rows: f"<worksheet {NS}><sheetData>" + "".join(f'<row r="{n}">{cells(r, n)}</row>' for n, r in enumerate(rows, 1)) + "</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" r:id="a"/><sheet name="two" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>idx</t></si><si><r><t>user_</t></r><r><t>input</t></r></si><si><t>shared</t></si></sst>")
        z.writestr("xl/worksheets/s1.xml", sheet([[0, 1, "kind"], ["1", 2, None], ["2", None, "Idea"]]))
        z.writestr("xl/worksheets/s2.xml", sheet([[0, "kind"], ["3", "Acceptable"]]))


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "w.xlsx")
    df = artifacts.read_workbook(spark, str(tmp_path / "w.xlsx"))
    assert sorted(tuple(r) for r in df.select("_sheet", "idx", "user_input", "kind").fillna("-").collect()) == [("one", "1", "shared", "-"), ("one", "2", "-", "Idea"), ("two", "3", "-", "Acceptable")]
    u = artifacts.union_sources([df], {"idx": "id"}, F.when(F.col("kind").isin("Acceptable", "Idea"), "correct").otherwise("incorrect"))
    assert sorted((r.id, r.eval) for r in u.collect()) == [("1", "incorrect"), ("2", "correct"), ("3", "correct")]
    assert artifacts.read_workbook(spark, str(tmp_path / "w.xlsx"), ["two"]).count() == 1
    with pytest.raises(ValueError):
        artifacts.read_workbook(spark, str(tmp_path / "w.xlsx"), ["none"])


def test_caches(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b", "c"), (2, "d", "e f")], "id long, i string, o string")
    e = embedders.make("hash", dim=64)
    own = artifacts.cache_paths(str(tmp_path), "tag", "stem")
    assert "nomask" not in own.inputs + own.outputs + own.meta
    got = artifacts.load_or_rebuild(spark, own, "id", rows, e, {"x": "i", "y": "o"})
    assert got.count() == 2
    made = (tmp_path / "_temp/embeddings/tag_stem_embedding_cache.json").stat().st_mtime_ns
    assert artifacts.load_or_rebuild(spark, own, "id", rows, e, {"x": "i", "y": "o"}).count() == 2
    assert (tmp_path / "_temp/embeddings/tag_stem_embedding_cache.json").stat().st_mtime_ns == made  # not made again
    with pytest.raises(ValueError):
        artifacts.load_cache(spark, own, "id", "hash:768")
    with pytest.raises(ValueError):
        artifacts.load_cache(spark, own, "id", e.name, 3)
    more = rows.union(rows.selectExpr("id + 10", "i", "o"))
    assert artifacts.load_or_rebuild(spark, own, "id", more, e, {"x": "i", "y": "o"}).count() == 4
    former = artifacts.cache_paths(str(tmp_path), "tag", "old", "nomask")
    artifacts.write_cache(spark, former, embedders.embed(rows, {"x": "i", "y": "o"}, e, "id"), "id", e.name)
    assert artifacts.resolve_cache(spark, str(tmp_path), "tag", "old") == former
    assert artifacts.resolve_cache(spark, str(tmp_path), "tag", "stem") == own
    assert artifacts.resolve_cache(spark, str(tmp_path), "tag", "stem", "/m.json").meta == "/m.json"


def test_peers_and_summaries(spark, tmp_path):
    rows = tmp_path / "a_row_results.csv"
    assert artifacts.peer_cache(str(rows), str(tmp_path), "t", "s")[1] == "usual place"
    (tmp_path / "a_run_config.json").write_text(json.dumps({"run_config": {"embedding_cache": {"meta_json": "/x.json"}}}))
    assert artifacts.peer_cache(str(rows), str(tmp_path), "t", "s") == ("/x.json", "nested run configuration")
    assert artifacts.peer_cache(str(rows), str(tmp_path), "t", "s", "/g.json") == ("/g.json", "given")
    with pytest.raises(FileNotFoundError):
        artifacts.latest_summary(str(tmp_path))
    (tmp_path / "one_summary.csv").write_text("hard_gate_pass_rate,n\n93,10\n")
    (tmp_path / "thresholds_summary.csv").write_text("hard_gate_pass_rate\n1\n")
    (tmp_path / "two_summary.csv").write_text("other\n1\n")
    assert artifacts.latest_summary(str(tmp_path)).endswith("one_summary.csv")
    r = artifacts.hard_gate_summary(spark, artifacts.latest_summary(str(tmp_path))).first()
    assert (r.pass_rate, r.score) == (0.93, 4)


def test_fixtures(spark):
    a, b = (sorted(map(tuple, fixtures.benchmark(spark, 30, 12).collect())) for _ in range(2))
    assert a == b and len({r[6] for r in a if r[4] == "incorrect"}) == 12
    ok = [r for r in a if r[4] == "correct"]
    assert all(set(json.loads(r[3])) == {"is_correct", "feedback"} for r in ok)
    deep = [r for r in fixtures.nested_benchmark(spark, 5, 0, depth=2).collect()]
    assert all(json.loads(r.expectedOutput)["level_1"]["level_2"]["feedback"] for r in deep)
