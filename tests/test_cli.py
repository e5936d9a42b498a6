"""The command line over a small workspace."""

import json

import pytest

from loomgraph import settings
from loomgraph.cli import VERSION, main
from test_workspace import XML, module, write


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "env").write_text("# a\nLOOMGRAPH_MAX_UNITS=7\nexport LOOMGRAPH_WORKSPACE='w x'\nOTHER=1\n", encoding="utf-8")
    monkeypatch.setenv("LOOMGRAPH_MAX_UNITS", "9")
    s = settings.load(str(tmp_path / "env"))
    assert (s.max_units, s.workspace, s.max_chars) == (9, "w x", 60_000)
    monkeypatch.setenv("LOOMGRAPH_MAX_CHARS", "many")
    with pytest.raises(ValueError, match="LOOMGRAPH_MAX_CHARS"):
        settings.load(str(tmp_path / "none"))


def test_every_command(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    root = write(tmp_path / "src", {"CommonModules/М/Ext/Module.bsl": module("Б()", 'Т = "ВЫБРАТЬ 1 ИЗ Справочник.Товары"', names=("А",)) + "\n" + module("Нет()", names=("Б",)), "Catalogs/Товары.xml": XML.format("Catalog", "Товары"), "x.json": "{}"})

    def run(*arguments, fails=False):
        status = main(["--workspace", str(tmp_path / "space"), *arguments], spark)
        said = capsys.readouterr()
        assert status == int(fails), said.err
        return said.err if fails else [json.loads(line) for line in said.out.splitlines()]

    assert main(["version"]) == 0 and capsys.readouterr().out.strip() == VERSION
    assert run("init") == [{"workspace": str(tmp_path / "space"), "projects": 0}]
    assert run("project", "add", "p", root) == [{"added": "p"}] and run("project", "list") == [{"name": "p", "root": root}]
    assert "there is a project" in run("project", "add", "p", str(tmp_path), fails=True) and "no project q" in run("audit", "q", fails=True)
    assert run("project", "scan", "p")[0]["added"] == 3
    done = run("project", "analyze", "p")[0]
    assert (done["analyzed"], done["calls_resolved"], done["errors"]) == (2, 2, [])
    assert run("doctor")[0]["projects"] == 1
    shown = run("project", "show", "p")
    assert (shown[0]["symbols"], shown[0]["files"]) == (2, 3) and [f["relative_path"] for f in shown[1:]] == ["Catalogs/Товары.xml", "CommonModules/М/Ext/Module.bsl", "x.json"]
    assert run("project", "summary", "p")[0]["unresolved"] == 1
    assert [x["full_name"] for x in run("find", "p", "М.А")] == ["М.А"]
    assert [x["name"] for x in run("project", "find", "p", "товар")] == ["Справочник.Товары"]
    assert [x["resolution"] for x in run("calls", "p", "М.А", "--direction", "outgoing")] == ["same_module"]
    assert [x["relation"] for x in run("impact", "p", "Справочник.Товары", "--depth", "1")] == ["query_read"]
    assert run("audit", "p", "--group-by", "name") == [{"value": "Нет", "n": 1}]
    assert [x["caller"] for x in run("project", "callers", "p", "М.Б")] == ["М.А"] and [x["callee"] for x in run("project", "callees", "p", "М.Б")] == ["Нет"]
    assert {x["relation"] for x in run("project", "dependencies", "p", "М.А", "--outgoing")} == {"calls", "query_read"}
    assert [x["resolved"] for x in run("project", "queries", "p")] == [True] and run("project", "queries", "p", "нет") == []
    assert json.loads((tmp_path / run("context", "p", "М.А", "out/c.json")[0]["written"]).read_text(encoding="utf-8"))["matches"][0]["full_name"] == "М.А"
    assert run("ask", "p", "Где М.А?", "--output", "runs")[0]["status"] == "prepared"
    assert run("project", "snapshot", "p", str(tmp_path / "snap")) and list((tmp_path / "snap").glob("part-*"))
    assert run("project", "resolve", "p")[0]["calls_resolved"] == 0
    assert run("project", "remove", "p") == [{"removed": "p"}] and run("project", "list") == []
    with pytest.raises(SystemExit):
        main(["impact", "p", "x", "--depth", "11"], spark)
