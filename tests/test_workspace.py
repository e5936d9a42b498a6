"""A workspace that follows its sources: scans, partial analysis, resolution of what changed, versions."""

import os
import random

import pytest

from loomgraph import workspace as W
from loomgraph.project import Project
from loomgraph.sources import export

XML = '<MetaDataObject><{0}><Properties><Name>{1}</Name></Properties></{0}></MetaDataObject>'


def write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")
    return str(root)


def module(*calls, names=("А",), export_=True):
    body = "\n".join(f"    {c};" for c in calls)
    return "\n".join(f"Процедура {n}(){' Экспорт' if export_ else ''}\n{body}\nКонецПроцедуры" for n in names)


@pytest.fixture
def space(spark, tmp_path):
    return W.Workspace(spark, str(tmp_path / "space"))


def counters(r):
    return r.added, r.updated, r.unchanged, r.removed, r.opened


def calls_of(ws, name):
    """Calls without their ids' order: what a full rebuild has to give as well."""
    return sorted(map(str, ws._table(ws._manifest()[1][name], "calls").collect()))


def edges_of(ws, name):
    return sorted(map(str, ws._table(ws._manifest()[1][name], "edges").collect()))


def test_listing_level_by_level(spark, tmp_path):
    write(tmp_path, {p: "x" for p in ("b.txt", "A/c.bsl", "A/.hidden", "_x/y.xml", ".git/z", "A/B/C/D/e.os", "A/node_modules/f.bsl", ".dot/g.json")})
    (tmp_path / "empty" / "below").mkdir(parents=True)
    os.symlink(tmp_path / "A", tmp_path / "link")
    got = {r.relative_path: (r.size_bytes, r.modified_ns, r.language) for r in export.listing(spark, str(tmp_path)).collect()}
    assert sorted(got) == [".dot/g.json", "A/B/C/D/e.os", "A/c.bsl", "_x/y.xml", "b.txt"]
    assert got["A/c.bsl"] == (1, (tmp_path / "A/c.bsl").stat().st_mtime_ns, "bsl") and got["A/B/C/D/e.os"][2] == "bsl"
    with pytest.raises(NotADirectoryError):
        export.listing(spark, str(tmp_path / "none"))


def test_scan_opens_only_what_changed(space, spark, tmp_path):
    root = tmp_path / "src"
    write(root, {"CommonModules/Demo/Module.bsl": "procedure Test()", "Configuration.xml": "<Configuration />", ".git/config": "x"})
    space.add("Demo", str(root))
    assert counters(space.scan("Demo")) == (2, 0, 0, 0, 2)
    assert counters(space.scan("Demo")) == (0, 0, 2, 0, 0)
    stat = (root / "Configuration.xml").stat()
    os.utime(root / "Configuration.xml", ns=(stat.st_atime_ns, stat.st_mtime_ns + 5))
    assert counters(space.scan("Demo")) == (0, 0, 2, 0, 1)  # another time, the same hash
    assert counters(space.scan("Demo")) == (0, 0, 2, 0, 0)  # and the new time is kept
    write(root, {"CommonModules/Demo/Module.bsl": "procedure Changed()", "Language.json": '{"lang": "ru"}'})
    (root / "Configuration.xml").unlink()
    assert counters(space.scan("Demo")) == (1, 1, 0, 1, 2)
    assert [(r.relative_path, r.language) for r in space.files("Demo").collect()] == [("CommonModules/Demo/Module.bsl", "bsl"), ("Language.json", "json")]


def test_projects_outlast_the_session_and_stay_apart(space, spark, tmp_path):
    for name in ("Я", "a/b c"):
        root = write(tmp_path / f"src{ord(name[0])}", {"CommonModules/М/Ext/Module.bsl": module("М.А()", "Нет()"), "CommonModules/М.xml": XML.format("CommonModule", "М")})
        space.add(name, root)
        r = space.analyze(name)
        assert (r.analyzed, r.skipped, r.rebuilt, r.errors) == (2, 0, True, [])
    with pytest.raises(W.ProjectExists):
        space.add("Я", str(tmp_path))
    with pytest.raises(W.ProjectExists):
        space.add("other", space.projects()[0]["root"])
    with pytest.raises(NotADirectoryError):
        space.add("other", str(tmp_path / "none"))
    with pytest.raises(W.ProjectNotFound):
        space.scan("other")
    later = W.Workspace(spark, space.folder)
    assert [p["name"] for p in later.projects()] == ["a/b c", "Я"]
    p = later.open("Я")
    fresh = Project(spark, p.root, name="Я")
    for mine, theirs in ((p.own_calls, fresh.own_calls), (p.own_edges, fresh.own_edges), (p.own_facts.symbols, fresh.own_facts.symbols)):
        assert sorted(map(str, mine.collect())) == sorted(map(str, theirs.select(*mine.columns).collect()))
    assert p.summary().first() == fresh.summary().first() and later.status("Я")["symbols"] == 1
    plan = p.own_calls._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "project" in plan.split("PartitionFilters: [")[1].split("]")[0]
    bytes_of = lambda: {f: f.read_bytes() for f in sorted((tmp_path / "space").rglob("part-*.parquet"))}
    before, gone = bytes_of(), later._manifest()[1]["a/b c"]["id"]
    later.remove("a/b c")
    assert bytes_of() == {f: b for f, b in before.items() if f"project={gone}" not in str(f)} and len(bytes_of()) < len(before)
    assert [p["name"] for p in later.projects()] == ["Я"]


def test_a_broken_file_keeps_its_facts_and_is_tried_again(space, tmp_path):
    root = tmp_path / "src"
    write(root, {"Catalogs/А.xml": XML.format("Catalog", "А"), "Catalogs/Б.xml": XML.format("Catalog", "Б"), "CommonModules/М/Ext/Module.bsl": module("Справочники.А.Найти()")})
    space.add("p", str(root))
    space.analyze("p")
    names = lambda: sorted(r.full_name for r in space.open("p").facts.objects.collect())
    write(root, {"Catalogs/А.xml": "<broken"})
    r = space.analyze("p")
    assert (r.analyzed, r.skipped, r.rebuilt) == (0, 2, False) and [e.split(":")[0] for e in r.errors] == ["Catalogs/А.xml"]
    assert names() == ["Справочник.А", "Справочник.Б"] and space.open("p").summary().first().errors == 1
    write(root, {"Catalogs/А.xml": XML.format("Catalog", "Новый")})
    assert space.analyze("p", scan=True).errors == [] and names() == ["Справочник.Б", "Справочник.Новый"]
    # A claimed name: the stored file keeps it, the file that changed keeps what it had.
    write(root, {"Catalogs/А.xml": XML.format("Catalog", "Б")})
    assert space.analyze("p").errors == ["Catalogs/А.xml: a full name is taken"] and names() == ["Справочник.Б", "Справочник.Новый"]
    # Tried again, though the file is the same.
    (root / "Catalogs/Б.xml").unlink()
    r = space.analyze("p")
    assert (r.scan.removed, r.analyzed, r.errors) == (1, 1, []) and names() == ["Справочник.Б"]


def test_resolution_of_what_changed_equals_a_full_one(space, spark, tmp_path):
    rng = random.Random(8)
    names, modules = ["А", "Б", "В", "Год", "Г"], ["М", "Н", "О", "П"]
    call = lambda: rng.choice([f"{rng.choice(names)}()", f"{rng.choice([*modules, 'Х', 'ЭтотОбъект', 'Документы'])}.{rng.choice(names)}()"])

    def text():
        return "\n".join(module(*(call() for _ in range(3)), names=(rng.choice(names),), export_=rng.random() < 0.6) for _ in range(rng.randrange(1, 4)))

    roots = {n: tmp_path / n for n in ("own", "other")}
    for n, root in roots.items():
        write(root, {f"CommonModules/{m}/Ext/Module.bsl": text() for m in modules[: 4 if n == "own" else 2]})
        space.add(n, str(root), buckets=5)
    space.analyze("other")
    total = space.analyze("own", include=["other"]).calls_resolved
    assert total == len(calls_of(space, "own"))
    r = space.analyze("own")
    assert (r.analyzed, r.calls_resolved, r.rebuilt, r.scan.opened) == (0, 0, False, 0)
    for changed in ("other", "own"):
        (roots[changed] / f"CommonModules/{modules[0]}/Ext/Module.bsl").write_text(text() + "\n", encoding="utf-8")
    space.analyze("other")
    partial = space.analyze("own", include=["other"]).calls_resolved
    for include in (["other"], []):
        if not include:
            space.resolve("own")
        got = calls_of(space, "own"), edges_of(space, "own")
        space.resolve("own", include=include, force=True)
        assert (calls_of(space, "own"), edges_of(space, "own")) == got
    assert 0 < partial < total


def test_a_step_that_lost_is_refused_and_old_versions_go(space, spark, tmp_path):
    root = write(tmp_path / "src", {"a.bsl": module("Б()")})
    space.add("p", root)
    number, projects = space._manifest()
    space.analyze("p")
    with pytest.raises(W.Conflict):
        space._commit(number, projects)
    write(tmp_path / "src", {"a.bsl": module("Б2()")})
    space.analyze("p")
    assert space.clean(1) > 0
    assert [r.name for r in space.open("p").own_calls.collect()] == ["Б2"] and space.analyze("p").analyzed == 0
