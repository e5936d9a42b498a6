"""Vocabularies of exported configurations. They must be these for names and kinds to come out right."""

from __future__ import annotations

import re

#: Directory of an export, and the kind of what lies in it.
DIRECTORY_KINDS = {
    "AccountingRegisters": "accounting_register",
    "AccumulationRegisters": "accumulation_register",
    "BusinessProcesses": "business_process",
    "CalculationRegisters": "calculation_register",
    "Catalogs": "catalog",
    "ChartsOfAccounts": "chart_of_accounts",
    "ChartsOfCalculationTypes": "chart_of_calculation_types",
    "ChartsOfCharacteristicTypes": "chart_of_characteristic_types",
    "CommonAttributes": "common_attribute",
    "CommonModules": "common_module",
    "Constants": "constant",
    "DataProcessors": "data_processor",
    "DefinedTypes": "defined_type",
    "DocumentJournals": "document_journal",
    "Documents": "document",
    "Enums": "enumeration",
    "Enumerations": "enumeration",
    "ExchangePlans": "exchange_plan",
    "EventSubscriptions": "event_subscription",
    "FilterCriteria": "filter_criterion",
    "FunctionalOptions": "functional_option",
    "FunctionalOptionsParameters": "functional_options_parameter",
    "HTTPServices": "http_service",
    "InformationRegisters": "information_register",
    "Reports": "report",
    "Roles": "role",
    "ScheduledJobs": "scheduled_job",
    "SessionParameters": "session_parameter",
    "SettingsStorages": "settings_storage",
    "Sequences": "sequence",
    "Subsystems": "subsystem",
    "Tasks": "task",
    "WebServices": "web_service",
    "WSReferences": "ws_reference",
    "XDTOPackages": "xdto_package",
}

#: Kind, and the prefix of its full names.
KIND_PREFIXES = {
    "accounting_register": "РегистрБухгалтерии",
    "accumulation_register": "РегистрНакопления",
    "business_process": "БизнесПроцесс",
    "calculation_register": "РегистрРасчета",
    "catalog": "Справочник",
    "chart_of_accounts": "ПланСчетов",
    "chart_of_calculation_types": "ПланВидовРасчета",
    "chart_of_characteristic_types": "ПланВидовХарактеристик",
    "common_attribute": "ОбщийРеквизит",
    "common_module": "ОбщийМодуль",
    "constant": "Константа",
    "data_processor": "Обработка",
    "defined_type": "ОпределяемыйТип",
    "document": "Документ",
    "document_journal": "ЖурналДокументов",
    "enumeration": "Перечисление",
    "exchange_plan": "ПланОбмена",
    "event_subscription": "ПодпискаНаСобытие",
    "filter_criterion": "КритерийОтбора",
    "functional_option": "ФункциональнаяОпция",
    "functional_options_parameter": "ПараметрФункциональныхОпций",
    "http_service": "HTTPСервис",
    "information_register": "РегистрСведений",
    "report": "Отчет",
    "role": "Роль",
    "scheduled_job": "РегламентноеЗадание",
    "session_parameter": "ПараметрСеанса",
    "settings_storage": "ХранилищеНастроек",
    "sequence": "Последовательность",
    "subsystem": "Подсистема",
    "task": "Задача",
    "web_service": "WebСервис",
    "ws_reference": "WSСсылка",
    "xdto_package": "ПакетXDTO",
}

#: Manager collections, normalised.
MANAGER_KINDS = {
    "документы": "document",
    "documents": "document",
    "обработки": "data_processor",
    "dataprocessors": "data_processor",
    "отчеты": "report",
    "reports": "report",
    "перечисления": "enumeration",
    "enumerations": "enumeration",
    "enums": "enumeration",
    "планыобмена": "exchange_plan",
    "exchangeplans": "exchange_plan",
    "планысчетов": "chart_of_accounts",
    "chartsofaccounts": "chart_of_accounts",
    "регистрыбухгалтерии": "accounting_register",
    "accountingregisters": "accounting_register",
    "регистрынакопления": "accumulation_register",
    "accumulationregisters": "accumulation_register",
    "регистрырасчета": "calculation_register",
    "calculationregisters": "calculation_register",
    "регистрысведений": "information_register",
    "informationregisters": "information_register",
    "справочники": "catalog",
    "catalogs": "catalog",
    "бизнеспроцессы": "business_process",
    "businessprocesses": "business_process",
    "задачи": "task",
    "tasks": "task",
    "константы": "constant",
    "constants": "constant",
}

#: Files of modules, suffixes of languages, directories passed over, tags of child objects.
MODULE_STEMS = [
    "CommandModule", "ExternalConnectionModule", "ManagerModule", "ManagedApplicationModule", "Module", "ObjectModule", "OrdinaryApplicationModule",
    "RecordSetModule", "SessionModule", "ValueManagerModule",
]
LANGUAGES = {
    "bsl": "bsl",
    "json": "json",
    "mdo": "mdo",
    "os": "bsl",
    "toml": "toml",
    "txt": "text",
    "xml": "xml",
    "yaml": "yaml",
    "yml": "yaml",
}
IGNORED_DIRECTORIES = frozenset({
    ".git", ".hg", ".idea", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".svn", ".venv", "__pycache__", "node_modules",
})
CHILD_TAGS = [
    "Attribute", "Command", "Dimension", "Form", "Resource", "TabularSection", "Template",
]
#: Words of the language that stand before a parenthesis without being calls.
NO_CALLS = frozenset({
    "and", "do", "else", "elseif", "for", "function", "if", "new", "not", "or", "procedure", "return", "then", "to", "try", "while", "возврат", "для", "если",
    "и", "иначе", "иначеесли", "или", "не", "новый", "по", "пока", "попытка", "процедура", "тогда", "функция", "цикл",
})
#: Qualifiers of the platform, normalised.
PLATFORM_QUALIFIERS = frozenset({
    "этотобъект", "thisobject", "объект", "object", "элементы", "elements", "параметры", "parameters", "команды", "commands", "пользователиинформационнойбазы",
    "регламентныезадания", "фоновыезадания", "метаданные", "metadata",
})
SELF_QUALIFIERS = ("этотобъект", "thisobject")
#: Types that name an object, and the kind of that object.
TYPE_KINDS = {
    "AccountingRegisterRecordKey": "accounting_register",
    "AccumulationRegisterRecordKey": "accumulation_register",
    "BusinessProcessRef": "business_process",
    "CalculationRegisterRecordKey": "calculation_register",
    "CatalogRef": "catalog",
    "ChartOfAccountsRef": "chart_of_accounts",
    "ChartOfCalculationTypesRef": "chart_of_calculation_types",
    "ChartOfCharacteristicTypesRef": "chart_of_characteristic_types",
    "DocumentRef": "document",
    "EnumRef": "enumeration",
    "ExchangePlanRef": "exchange_plan",
    "InformationRegisterRecordKey": "information_register",
    "TaskRef": "task",
    "БизнесПроцессСсылка": "business_process",
    "ДокументСсылка": "document",
    "ЗадачаСсылка": "task",
    "ПеречислениеСсылка": "enumeration",
    "ПланВидовРасчетаСсылка": "chart_of_calculation_types",
    "ПланВидовХарактеристикСсылка": "chart_of_characteristic_types",
    "ПланОбменаСсылка": "exchange_plan",
    "ПланСчетовСсылка": "chart_of_accounts",
    "СправочникСсылка": "catalog",
}
#: Properties of an object that are kept, and those that make up the profile of a configuration.
PROFILE_PROPERTIES = frozenset({"CompatibilityMode", "DataLockControlMode", "DefaultRunMode"})
OBJECT_PROPERTIES = PROFILE_PROPERTIES | {
    "ClientManagedApplication", "ClientOrdinaryApplication", "Comment", "ExternalConnection", "Global", "Name", "Privileged", "ReturnValuesReuse", "Server", "ServerCall",
}
#: Functions of the language itself.
BUILT_IN_NAMES = [
    "Base64Строка", "Number", "String", "Type", "Булево", "ВРег", "Вопрос", "Вычислить", "Год", "Дата", "День", "ДеньГода", "ДеньНедели", "ДобавитьМесяц",
    "ЗаполнитьЗначенияСвойств", "ЗначениеВСтрокуВнутр", "ЗначениеЗаполнено", "ЗначениеИзСтрокиВнутр", "ИнформацияОбОшибке", "КонецГода", "КонецДня",
    "КонецКвартала", "КонецМесяца", "КонецНедели", "Лев", "Макс", "Месяц", "Мин", "Минута", "НРег", "НСтр", "Найти", "НачалоГода", "НачалоДня",
    "НачалоКвартала", "НачалоМесяца", "НачалоНедели", "НеделяГода", "Окр", "ОписаниеОшибки", "Прав", "ПредопределенноеЗначение", "Предупреждение",
    "ПустаяСтрока", "Секунда", "Символ", "СокрЛ", "СокрЛП", "СокрП", "Сообщить", "Сред", "СтрДлина", "СтрЗаканчиваетсяНа", "СтрЗаменить", "СтрНайти",
    "СтрНачинаетсяС", "СтрПолучитьСтроку", "СтрРазделить", "СтрСоединить", "СтрСравнить", "СтрЧислоВхождений", "СтрШаблон", "Строка", "ТекущаяДата",
    "ТекущаяДатаСеанса", "Тип", "ТипЗнч", "Формат", "Цел", "Час", "Число",
]
#: Procedures and constructors of the platform.
PLATFORM_NAMES = [
    "XMLСтрока", "ВыполнитьОбработкуОповещения", "ДанныеФормыВЗначение", "ДвоичныеДанные", "ЗаписьЖурналаРегистрации", "Запрос", "ЗафиксироватьТранзакцию",
    "ЗначениеВДанныеФормы", "ЗначениеВРеквизитФормы", "КвалификаторыДаты", "КвалификаторыСтроки", "КвалификаторыЧисла", "КопироватьДанныеФормы", "Линия",
    "Массив", "НачатьТранзакцию", "ОписаниеОповещения", "ОписаниеТипов", "Оповестить", "ОповеститьОВыборе", "ОповеститьОбИзменении", "ОткрытьФорму",
    "ОтменитьТранзакцию", "ОчиститьСообщения", "ПараметрВыбора", "ПодключитьОбработчикОжидания", "ПодробноеПредставлениеОшибки", "ПоказатьВопрос",
    "ПоказатьЗначение", "ПоказатьОповещениеПользователя", "ПоказатьПредупреждение", "ПолеКомпоновкиДанных", "ПолучитьИзВременногоХранилища",
    "ПолучитьИмяВременногоФайла", "ПолучитьМакет", "ПолучитьНавигационнуюСсылку", "ПолучитьФорму", "ПолучитьФункциональнуюОпцию",
    "ПоместитьВоВременноеХранилище", "ПравоДоступа", "ПредставлениеПериода", "ПустаяСсылка", "РеквизитФормыВЗначение", "СжатиеДанных", "СоздатьНаборЗаписей",
    "Соответствие", "Состояние", "Структура", "ТекущаяУниверсальнаяДата", "ТекущаяУниверсальнаяДатаВМиллисекундах", "УдалитьИзВременногоХранилища",
    "УдалитьФайлы", "УстановитьОтключениеБезопасногоРежима", "УстановитьПривилегированныйРежим", "Файл", "ФиксированнаяСтруктура", "ФиксированноеСоответствие",
    "ФиксированныйМассив", "ХранилищеЗначения", "Цвет", "Шрифт", "ЭтоАдресВременногоХранилища",
]
#: Normalised names that are no calls, whatever an older table of calls says.
NOISE_NAMES = NO_CALLS | {"вместо", "вызватьисключение", "изменениеиконтроль", "перед", "после"}

_CLEAN = re.compile(r"[^0-9a-zа-яё_]+")


def normalize(name: str) -> str:
    return _CLEAN.sub("", name.casefold())


BUILT_INS = frozenset(map(normalize, BUILT_IN_NAMES))
PLATFORM_GLOBALS = frozenset(map(normalize, PLATFORM_NAMES))
TYPE_PREFIXES = {normalize(name): kind for name, kind in TYPE_KINDS.items()}


def snake(name: str) -> str:
    """HTTPService -> http_service."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def tag_kind(tag: str) -> str | None:
    """The kind that an XML tag names; null for unknown tags."""
    kind = "enumeration" if tag == "Enum" else snake(tag)
    return kind if kind == "configuration" or kind in KIND_PREFIXES else None


def full_name(kind: str, name: str) -> str:
    return f"{KIND_PREFIXES.get(kind, kind)}.{name}"


def module_identity(path: str) -> dict:
    """What a module's path says: name, full_name, module_kind, owner_kind, owner_name."""
    parts = path.split("/")
    stem = parts[-1].rpartition(".")[0] or parts[-1]
    module_kind = snake(stem) if stem in MODULE_STEMS else "module"
    at = next((i for i, p in enumerate(parts[:-1]) if p in DIRECTORY_KINDS), None)
    if at is None or at + 1 >= len(parts):
        return {"name": stem, "full_name": path, "module_kind": module_kind, "owner_kind": None, "owner_name": None}
    kind, owner = DIRECTORY_KINDS[parts[at]], parts[at + 1].removesuffix(".bsl")
    if kind == "common_module":
        return {"name": owner, "full_name": owner, "module_kind": module_kind, "owner_kind": kind, "owner_name": owner}
    return {"name": f"{owner}.{module_kind}", "full_name": f"{full_name(kind, owner)}.{module_kind}", "module_kind": module_kind, "owner_kind": kind, "owner_name": owner}
