"""A small export from files to answers."""

import json
import random
from pathlib import Path

import pytest

from loomgraph.ask import Answer, AskError, ask, plan, prefers_code, prompt_context, search_terms
from loomgraph.context import build_context, write_context, write_snapshot
from loomgraph.functions.metadata_parser import parse_metadata
from loomgraph.functions.module_parser import parse_module
from loomgraph.operators.extract import merged_profile
from loomgraph.project import Project

COMMON = '''#Область Запросы
&НаСервере
Функция Остатки(Склад, Знач Дата = "") Экспорт
    Текст = "ВЫБРАТЬ * ИЗ РегистрНакопления.Запасы.Остатки
    |ГДЕ Склад = 1";
    Возврат Свернуть(Текст);
КонецФункции
#КонецОбласти

Процедура Вложенная()
    Остатки(1, 2);
    Если (Истина И (Ложь ИЛИ Не (Истина))) Тогда КонецЕсли;
    Документы.Заказ.СоздатьДокумент();
КонецПроцедуры
'''
OBJECT = '''Процедура ОбработкаПроведения(Отказ)
    Склады.Остатки(1, 2);
    Неизвестно.Метод();
    Справочники.Товары.НайтиПоКоду(1);
КонецПроцедуры
'''
XML = '<MetaDataObject xmlns:v8="v"><{0} uuid="u-{1}"><Properties><Name>{1}</Name><Synonym><v8:item><v8:content>{1} s</v8:content></v8:item></Synonym></Properties>{2}</{0}></MetaDataObject>'


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("export")
    child = "<ChildObjects><Attribute><Properties><Name>Товар</Name><Type>cfg:CatalogRef.Товары</Type></Properties></Attribute></ChildObjects>"
    files = {
        "CommonModules/Склады/Ext/Module.bsl": COMMON, "Documents/Заказ/Ext/ObjectModule.bsl": OBJECT, ".git/x.bsl": COMMON, "_notes/a.txt": "x",
        "CommonModules/Склады.xml": XML.format("CommonModule", "Склады", ""), "Documents/Заказ.xml": XML.format("Document", "Заказ", child),
        "Catalogs/Товары.xml": XML.format("Catalog", "Товары", ""), "AccumulationRegisters/Запасы.xml": XML.format("AccumulationRegister", "Запасы", ""),
        "Z/Товары.xml": XML.format("Catalog", "Товары", ""), "Documents/Broken.xml": "<a>",
    }
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")
    return Project(spark, str(root))


def test_module_facts():
    facts = parse_module(COMMON)
    first = facts["symbols"][0]
    assert [s["name"] for s in facts["symbols"]] == ["Остатки", "Вложенная"]
    assert (first["is_export"], first["directive"], first["region"], first["line_start"], first["line_end"]) == (True, "НаСервере", "Запросы", 3, 7)
    assert first["parameters"] == [{"name": "Склад", "by_value": False, "default": None}, {"name": "Дата", "by_value": True, "default": '""'}]
    assert [(c["qualifier"], c["name"]) for c in facts["calls"]] == [(None, "Свернуть"), (None, "Остатки"), ("Документы.Заказ", "СоздатьДокумент")]
    assert facts["queries"][0]["tables"] == [{"name": "РегистрНакопления.Запасы.Остатки", "operation": "read"}]
    assert [r["target"] for r in facts["references"]] == ["Документ.Заказ"]
    assert parse_module("") == {"symbols": [], "calls": [], "queries": [], "references": [], "directives": []}
    assert facts["directives"] == [{"name": "НаСервере", "line": 2}]
    assert parse_module('&Перед("Имя")\nПроцедура А()\nКонецПроцедуры')["calls"] == []


def test_metadata_of_unknown_kinds_stays_apart():
    names = [parse_metadata(f"<MetaDataObject><{t}><Properties><Name>X</Name></Properties></{t}></MetaDataObject>", "a/X.xml")["objects"][0]["full_name"] for t in ("FirstKind", "SecondKind")]
    assert names == ["firstkind.X", "secondkind.X"]


def test_graph(project):
    s = project.summary().first()
    assert (s.metadata, s.modules, s.symbols, s.queries, s.errors) == (5, 2, 3, 1, 2)
    got = {(r.qualifier, r.name): r.resolution for r in project.calls_table.collect()}
    assert got == {
        (None, "Свернуть"): "unresolved_unqualified", (None, "Остатки"): "same_module", ("Документы.Заказ", "СоздатьДокумент"): "platform_api",
        ("Склады", "Остатки"): "qualified_module", ("Неизвестно", "Метод"): "dynamic_qualified", ("Справочники.Товары", "НайтиПоКоду"): "platform_api",
    }
    assert {r.relation for r in project.edges.filter("target_id IS NOT NULL").collect()} == {"calls", "manager_access", "metadata_type_reference", "query_read", "contains_module", "contains"}
    assert [(r.table, r.operation, r.resolved) for r in project.query_usage().collect()] == [("РегистрНакопления.Запасы.Остатки", "read", True)]


def test_answers(project):
    assert [r.full_name for r in project.find("Склады.Остатки").collect()] == ["Склады.Остатки"]
    assert {r.kind for r in project.find("Заказ").collect()} == {"metadata"}
    incoming = project.calls("Остатки", "incoming").collect()
    assert sorted(r.path for r in incoming) == ["CommonModules/Склады/Ext/Module.bsl", "Documents/Заказ/Ext/ObjectModule.bsl"]
    names = {r.id: r.name for r in project.entities().collect()}
    hit = project.impact("РегистрНакопления.Запасы", depth=2).collect()
    assert {(names[r.source_id], r.depth) for r in hit} == {("Остатки", 1), ("Вложенная", 2), ("ОбработкаПроведения", 2)}
    assert project.audit("name").first().value == "Свернуть"
    with pytest.raises(ValueError):
        project.calls("x", depth=0)


def test_context_package(project, tmp_path):
    package = json.loads(write_context(project, "Склады.Остатки", tmp_path / "a" / "context.json").read_text(encoding="utf-8"))
    assert [m["full_name"] for m in package["matches"]] == ["Склады.Остатки"]
    units = package["source_units"]
    assert units[0]["symbol"] == "Склады.Остатки" and (units[0]["line_start"], units[0]["line_end"]) == (1, 10)
    assert units[0]["source"] == "\n".join(COMMON.split("\n")[0:10])
    assert {u["symbol"].rpartition(".")[2] for u in units} == {"Остатки", "Вложенная", "ОбработкаПроведения"}
    assert {c["caller_name"] for c in package["calls"]} >= {"Склады.Остатки", "Склады.Вложенная"}
    assert [q["tables"][0]["name"] for q in package["queries"]] == ["РегистрНакопления.Запасы.Остатки"]
    assert {u["call"] for u in package["unresolved_near_context"]} == {"Свернуть", "Неизвестно.Метод"}
    small = build_context(project, "Склады.Остатки", max_chars=50)
    assert small["limits"]["actual_source_characters"] == 50 and len(small["source_units"]) == 1
    nothing = build_context(project, "НетТакого")
    assert nothing["matches"] == nothing["source_units"] == nothing["calls"] == nothing["impact"] == []


def test_symbols_for_entities(project):
    modules = project.entities().filter("kind = 'module' AND name = 'Склады'")
    assert [r.name for r in project.symbols_for_entities(modules, 1).collect()] == ["Остатки"]
    assert project.symbols_for_entities(modules).count() == 2


def test_snapshot_is_one_ordered_document(project, spark, tmp_path):
    def lines(folder):
        write_snapshot(project, str(folder))
        return "".join(f.read_text(encoding="utf-8") for f in sorted(folder.glob("part-*"))).splitlines()

    first = lines(tmp_path / "a")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert lines(tmp_path / "b") == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = [json.loads(x) for x in first]
    of = lambda section: [json.loads(r["row"]) for r in rows if r["section"] == section]
    assert list(dict.fromkeys(r["section"] for r in rows)) == ["project", "summary", "metadata", "modules", "symbols", "queries", "dependencies"]
    for section in {r["section"] for r in rows}:
        assert [r["ordinal"] for r in rows if r["section"] == section] == list(range(1, len(of(section)) + 1))
    assert [s["name"] for s in of("symbols")] == ["ОбработкаПроведения", "Остатки", "Вложенная"] and of("summary")[0]["metadata"] == 5
    names = [m["full_name"] for m in of("metadata")]
    assert names == sorted(names) and len(of("dependencies")) == project.edges.count()


def test_planner_and_runs(project, tmp_path):
    terms, roots = search_terms('Как формирует остатки метод Склады.Остатки и "Заказ"?')
    assert terms[:2] == ["Склады.Остатки", "Заказ"] and "остатк" in roots
    assert prefers_code("Как это") and not prefers_code("Товары")
    best = plan(project, "Как считаются остатки в модуле?")
    assert best.selected_term == "Склады.Остатки" and best.matches[0]["score"] > best.matches[1]["score"]
    assert plan(project, "x", term="Остатки").matches[0]["score"] == 10_000
    with pytest.raises(AskError):
        plan(project, " ")
    assert ask(project, "Как считаются остатки?", tmp_path)["status"] == "prepared"

    class Fake:
        def answer(self, **request):
            assert "Склады.Остатки" in request["input_text"]
            return Answer("готово", total_tokens=3)

    run = ask(project, "Как считаются остатки?", tmp_path, Fake(), model="m")
    kept = json.loads((Path(run["folder"]) / "run.json").read_text(encoding="utf-8"))
    assert (kept["status"], kept["provider"]["total_tokens"], kept["answer"]) == ("completed", 3, "готово")
    with pytest.raises(AskError):
        ask(project, "qqqzzz", tmp_path)


def test_prompt_budget():
    row = {"x": "y" * 50}
    package = {"schema": "s", "unresolved_near_context": [row] * 200, "impact": [row] * 10, "calls": [], "queries": [], "source_units": [{"source": "z" * 30_000}]}
    assert len(prompt_context(package, 20_000)) <= 20_000
    with pytest.raises(AskError):
        prompt_context(package | {"source_units": [{"source": "z" * 800}] * 50}, 20_000)


def test_knowledge_answers(project):
    s = project.summary().first()
    assert (s.files, s.exported, s.calls, s.resolved, s.platform, s.dynamic, s.unresolved, s.ambiguous, s.built_in) == (9, 1, 6, 2, 2, 1, 1, 0, 0) and len(s) == 16
    assert s.dependencies > s.unresolved_dependencies == project.edges.filter("target_id IS NULL").count()
    assert len(project.audit_counters().first()) == 8
    assert {r.caller for r in project.callers("склады.остатки").collect()} == {"Склады.Вложенная", next(r.full_name for r in project.entities().filter("name = 'ОбработкаПроведения'").collect())}
    assert [r.callee for r in project.callees("Вложенная").collect()] == ["Склады.Остатки", "Документы.Заказ.СоздатьДокумент"]
    assert [(r.table, r.query_kind, r.symbol, r.resolved) for r in project.query_usage("запасы").collect()] == [("РегистрНакопления.Запасы.Остатки", "select", "Остатки", True)]
    assert project.query_usage("нет").count() == 0
    assert {r.relation for r in project.dependencies("апасы").collect()} == {"query_read"}
    # Both sides are lowered in any script.
    assert [r.name for r in project.search("статки").collect()] == [r.name for r in project.search("ОСТАТКИ").collect()] == ["Склады.Остатки"]
    assert project.search("овары").first().kind.startswith("metadata:")


def test_included_projects(spark, tmp_path):
    def export(name, files):
        for path, text in files.items():
            (tmp_path / name / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name / path).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    base_root = export("base", {"CommonModules/Общий/Ext/Module.bsl": "Функция Расчет() Экспорт\nКонецФункции\nФункция Скрытая()\nКонецФункции\n", "CommonModules/Общий.xml": XML.format("CommonModule", "Общий", "")})
    call = "Процедура Вызов() Экспорт\n    Общий.Расчет();\n    Расчет();\n    Общий.Скрытая();\nКонецПроцедуры\n"
    more_root = export("more", {"CommonModules/Доп/Ext/Module.bsl": call})
    base, alone = Project(spark, base_root, name="base"), Project(spark, more_root, name="more")
    assert {r.resolution for r in alone.calls_table.collect()} == {"dynamic_qualified", "unresolved_unqualified"}
    both = Project(spark, more_root, name="more", include=[base, base])
    assert {(r.qualifier, r.name): r.resolution for r in both.own_calls.collect()} == {("Общий", "Расчет"): "included_qualified_module", (None, "Расчет"): "included_global_common_module", ("Общий", "Скрытая"): "unresolved_qualified"}
    assert [r.direction for r in both.calls("Расчет", "incoming").collect()] == ["incoming"] * 2
    assert both.impact("Общий.Расчет", depth=1).filter("relation = 'calls'").count() == 2
    assert {r.project for r in both.facts.symbols.collect()} == {"base", "more"}
    # A call that was resolved without the other project is followed as a candidate where exactly one symbol fits.
    both.calls_table = alone.own_calls.unionByName(base.own_calls)
    hops = both.calls("Вызов", "outgoing").collect()
    assert sorted(r.resolution for r in hops) == ["cross_project_candidate", "cross_project_candidate", "dynamic_qualified", "dynamic_qualified", "unresolved_unqualified"]


def write(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")
    return str(root)


def test_two_projects_with_the_same_path(spark, tmp_path):
    path = "CommonModules/М/Ext/Module.bsl"
    one = Project(spark, write(tmp_path / "one", {path: 'Процедура Явная() Экспорт\n    З = "ВЫБРАТЬ 1 ИЗ Справочник.Товары";\nКонецПроцедуры\n', "Catalogs/Товары.xml": XML.format("Catalog", "Товары", "")}))
    two = Project(spark, write(tmp_path / "two", {path: 'Процедура Тайна() Экспорт\n    З = "ВЫБРАТЬ 1 ИЗ Справочник.Нет";\n    М.Явная();\nКонецПроцедуры\n', "CommonModules/Б/Ext/Module.bsl": "Процедура Дело()\n    Тайна();\nКонецПроцедуры\n"}), include=[])
    both = Project(spark, one.root, include=[two, two])
    package = build_context(both, "М.Тайна", depth=1)
    units = {u["symbol"]: u for u in package["source_units"]}
    assert "Тайна" in units["М.Тайна"]["source"] and "Явная" not in units["М.Тайна"]["source"].split("М.")[0] and units["М.Тайна"]["project"] == "two"
    assert "Тайна" in units["Б.Дело"]["source"] and package["source_units"][0]["symbol"] == "М.Тайна"
    assert [(p["name"]) for p in package["projects"]] == ["one", "two"]
    # Neither project marks the other's tables, nor counts the other's rows; names of the asked project come first.
    assert [(r.project, r.table, r.resolved) for r in both.query_usage().collect()] == [("one", "Справочник.Товары", True), ("two", "Справочник.Нет", False)]
    s = both.summary().first()
    assert (s.files, s.metadata, s.modules, s.symbols, s.calls) == (2, 1, 1, 1, 0) and both.audit().count() == 0
    assert [(r.project, r.kind) for r in both.find("М").collect()] == [("one", "module"), ("two", "module")]
    assert plan(both, "x", term="М").matches[0]["entity"]["project"] == "one"
    with pytest.raises(ValueError, match="one name"):
        Project(spark, two.root, name="one", include=[one])


def test_primary_project_scores_more(spark, tmp_path):
    text = "Процедура СформироватьПечать() Экспорт\nКонецПроцедуры\n"
    base = Project(spark, write(tmp_path / "base", {"CommonModules/Печать/Ext/Module.bsl": text}))
    extension = Project(spark, write(tmp_path / "extension", {"CommonModules/Печать/Ext/Module.bsl": '&Вместо("СформироватьПечать")\n' + text}), include=[base])
    matches = plan(extension, "Где формирует печать модуль?").matches
    symbols = [m for m in matches if m["entity"]["kind"] == "symbol"]
    assert [m["entity"]["project"] for m in symbols] == ["extension", "base"] and symbols[0]["score"] - symbols[1]["score"] == 45 + 70


def test_names_of_the_platform(spark, tmp_path):
    text = """Процедура ВыполнитьПроверку()
    Таблица = Новый Структура();
    Оповещение = Новый ОписаниеОповещения("После", ЭтотОбъект);
    Текст = СтрШаблон("%1", Лев("Тест", 1));
    ОткрытьФорму("Форма");
    НачатьТранзакцию();
    ЗафиксироватьТранзакцию();
КонецПроцедуры
"""
    s = Project(spark, write(tmp_path, {"CommonModules/Проверка/Ext/Module.bsl": text})).summary().first()
    assert (s.unresolved, s.built_in, s.platform) == (0, 2, 5)


def test_noise_is_left_out_of_resolution(spark, project):
    from pyspark.sql import functions as F

    from loomgraph.operators.extract import Facts
    from loomgraph.operators.resolve import resolve_calls

    noise = project.own_facts.calls.limit(1).withColumns({"name": F.lit("И"), "qualifier": F.lit(None).cast("string")})
    facts = Facts(**{**vars(project.own_facts), "calls": project.own_facts.calls.unionByName(noise)})
    assert resolve_calls(facts).count() == project.own_calls.count()


def test_references_to_types(spark):
    facts = parse_module("Процедура А()\n    Т = Тип(СправочникСсылка.Товары); Т = СправочникСсылка.Товары;\n    Справочники.Товары.Найти(1);\nКонецПроцедуры\n&НаКлиенте\nПерем Х;")
    assert [(r["target"], r["relation"], r["line"], r["caller"]) for r in facts["references"]] == [("Справочник.Товары", "type_reference", 2, 0), ("Справочник.Товары", "manager_access", 3, 0)]
    assert facts["directives"] == [{"name": "НаКлиенте", "line": 5}]


def test_properties_and_profile(spark, tmp_path):
    text = """<MetaDataObject xmlns:cfg="urn:test"><Catalog uuid="cat-1"><Properties>
    <Name>Номенклатура</Name><CompatibilityMode>Version8_3_17</CompatibilityMode><Comment>  a <b>b</b>\n c </Comment><Other>x</Other><Global/>
    <Synonym><item><content>Номенклатура</content></item></Synonym></Properties>
    <ChildObjects><Attribute uuid="attr-1"><Properties><Name>ОсновнойСклад</Name>
    <Type><Type>cfg:CatalogRef.Склады</Type></Type></Properties></Attribute></ChildObjects></Catalog></MetaDataObject>"""
    facts = parse_metadata(text, "Catalogs/Номенклатура.xml")
    assert [(o["kind"], o["name"], o["uuid"]) for o in facts["objects"]] == [("catalog", "Номенклатура", "cat-1"), ("attribute", "ОсновнойСклад", "attr-1")]
    assert [r["target"] for r in facts["references"]] == ["Справочник.Склады"] * 2 and facts["profile"] == {"CompatibilityMode": "Version8_3_17"}
    assert facts["objects"][0]["properties"] == {"Comment": "a b c", "CompatibilityMode": "Version8_3_17", "Name": "Номенклатура"}
    long = parse_metadata(f"<Constant><Properties><Name>A</Name><Comment>{'x' * 5000}</Comment></Properties></Constant>", "Constants/A.xml")
    assert len(long["objects"][0]["properties"]["Comment"]) == 4096
    assert parse_metadata("<MetaDataObject/>", "My-Own Kind/X.xml")["objects"][0]["full_name"] == "my_own_kind.X"
    other = text.replace("Номенклатура", "Я").replace("_17", "_20").replace("<Other>x</Other>", "<DefaultRunMode>M</DefaultRunMode>")
    p = Project(spark, write(tmp_path, {"Catalogs/Номенклатура.xml": text, "Catalogs/Я.xml": other}))
    assert [r.profile for r in merged_profile(p.facts).collect()] == [{"CompatibilityMode": "Version8_3_20", "DefaultRunMode": "M"}]
    assert p.facts.objects.filter("kind = 'attribute'").first().properties == {"Name": "ОсновнойСклад"}


def test_children_find_their_parent_by_any_spelling(spark):
    from loomgraph.operators.extract import Facts, facts_of
    from loomgraph.operators.extract import FACTS as schema
    from loomgraph.operators.resolve import edges, resolve_calls

    def file(path, *objects):
        return {"path": path, "symbols": [], "calls": [], "queries": [], "refs": [], "directives": [], "profile": {}, "objects": [{"kind": k, "name": n, "full_name": f, "parent": p} for k, n, f, p in objects]}

    raw = spark.createDataFrame([
        file("a.xml", ("document", "Заказ", "Документ.Заказ", None)), file("b.xml", ("attribute", "Цена", "Документ.Заказ.Attribute.Цена", "Документ.Заказ")),
        file("c.xml", ("form", "Ф", "x.Form.Ф", "document.Заказ")), file("d.xml", ("form", "Г", "x.Form.Г", "Документ.ЗаказПокупателя")), file("e.xml", ("form", "Нет", "x.Form.Нет", "Прочее")),
    ], schema)
    facts: Facts = facts_of(raw, "p")
    met = edges(facts, resolve_calls(facts)).filter("relation = 'contains'")
    names = {r.object_id: r.full_name for r in facts.objects.collect()}
    assert sorted((names[r.source_id], r.target_name) for r in met.collect()) == [("Документ.Заказ", "x.Form.Г"), ("Документ.Заказ", "x.Form.Ф"), ("Документ.Заказ", "Документ.Заказ.Attribute.Цена")]


def test_files_claim_names_one_after_another(spark):
    from loomgraph.operators.extract import settle

    def run(new, old=(), taken=()):
        frame = lambda rows, schema: spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
        got = settle(frame(new, "path string, full_name string"), frame(old, "path string, full_name string"), frame(taken, "full_name string"))
        return sorted(r.path for r in got.collect())

    def plain(new, old, taken):
        holds, bad = {}, []
        for p, n in old:
            holds.setdefault(p, set()).add(n)
        for p in sorted({p for p, _ in new}):
            names = {n for q, n in new if q == p}
            others = set(taken).union(*(v for q, v in holds.items() if q != p))
            if names & others:
                bad.append(p)
            else:
                holds[p] = names
        return bad

    assert run([("a", "X"), ("b", "X"), ("b", "Y"), ("c", "Y")]) == ["b"]  # a rejected file leaves its other names to later ones
    rng = random.Random(6)
    for _ in range(3):
        pick = lambda n, files="abcdefg": sorted({(rng.choice(files), rng.choice("UVWXYZ")) for _ in range(n)})
        new, old, taken = pick(rng.randrange(1, 9)), pick(rng.randrange(4), "abcdefgh"), rng.sample("UVW", rng.randrange(2))
        assert run(new, old, taken) == plain(new, old, taken)
