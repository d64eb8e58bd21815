"""Parsers, plugins and their customisation: small immutable values on the driver, and DataFrame views of them.

A plugin is an ordered list of uniquely named parsers. Of the parsers that list a file type the last one serves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions.tags import defaults
from ..operators import filters
from ..operators.extract import scan

Target = "str | Iterable[str]"


def _unique(items: Iterable[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(items))


@dataclass(frozen=True)
class Parser:
    """A named scanner with the file types it serves and the rules that filter its tags.

    ``scanner`` names one of this package, or is a function from a text column to array<segment>: that is how users
    add their own.
    """

    name: str
    scanner: str | Callable[[Column], Column]
    file_types: tuple[str, ...] = ()
    tags: Mapping[str, bool] = field(default_factory=dict)
    filter_tags: Mapping[str, bool] | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "file_types", _unique(self.file_types))
        object.__setattr__(self, "tags", MappingProxyType(dict(self.tags)))
        rules = filters.normalised(self.filter_tags)
        object.__setattr__(self, "filter_tags", MappingProxyType(rules) if rules else None)

    def parse_all(self, content: Column) -> Column:
        """All segments of a text column."""
        return self.scanner(content) if callable(self.scanner) else scan(content, self.scanner)

    def kept(self, segments: Column) -> Column:
        return filters.filter_segments(segments, self.filter_tags, self.tags)

    def parse(self, content: Column) -> Column:
        """The segments that the parser's rules keep. Rules always apply to all segments, never to an earlier filter's."""
        return self.kept(self.parse_all(content))


class UnknownName(ValueError):
    """A name that a plugin does not know; the message lists those it does."""


def _listed(names: Iterable[str]) -> str:
    return ", ".join(f'"{n}"' for n in names)


class _Queries:
    """What can be asked of a plugin and of one in the making."""

    name: str

    def _parsers(self) -> tuple[Parser, ...]:
        raise NotImplementedError

    def snapshot(self) -> Plugin:
        raise NotImplementedError

    @property
    def parsers(self) -> list[Parser]:
        return list(self._parsers())

    def parser_names(self) -> list[str]:
        return [p.name for p in self._parsers()]

    @property
    def supported_file_types(self) -> list[str]:
        return list(_unique(t for p in self._parsers() for t in p.file_types))

    def has_parser(self, name: str) -> bool:
        return name in self.parser_names()

    def get_parser(self, name: str) -> Parser:
        return next(p for p in self._parsers() if p.name in self._resolve([name]))

    def parser_names_for(self, file_type: str) -> list[str]:
        return [p.name for p in self._parsers() if file_type in p.file_types]

    def _resolve(self, target: Target) -> set[str]:
        known = self.parser_names()
        if target == "*":
            return set(known)
        names = [target] if isinstance(target, str) else list(target)
        if unknown := [n for n in names if n not in known]:
            raise UnknownName(f'Plugin "{self.name}" has no parser {_listed(unknown)}. It has: {_listed(known) or "none"}.')
        return set(names)

    def _server(self, parsers: Iterable[Parser] | None = None) -> dict[str, str]:
        """File type to the parser that serves it."""
        return {t: p.name for p in (self._parsers() if parsers is None else parsers) for t in p.file_types}

    def language_settings_for(self, target: Target = "*", file_types: Iterable[str] | None = None) -> list[dict[str, str]]:
        """Rows that map file types, joined by commas, to parsers; with ``file_types`` those, verbatim, to one parser."""
        if file_types is not None:
            if not isinstance(target, str) or target == "*":
                raise ValueError("Explicit file types need the name of one parser.")
            self._resolve(target)
            types = list(file_types)
            return [{"languageId": ",".join(types), "parser": target}] if types else []
        names = self._resolve(target)
        chosen = [p for p in self._parsers() if p.name in names]
        server = self._server(chosen)
        return [{"languageId": ",".join(own), "parser": p.name} for p in chosen if (own := [t for t in p.file_types if server[t] == p.name])]

    def language_settings(self) -> list[dict[str, str]]:
        return self.language_settings_for("*")

    def language_settings_for_file_type(self, file_type: Target) -> list[dict[str, str]]:
        if file_type == "*":
            return self.language_settings()
        types = _unique([file_type] if isinstance(file_type, str) else file_type)
        server = self._server()
        if unknown := [t for t in types if t not in server]:
            raise UnknownName(f'No parser in plugin "{self.name}" lists {_listed(unknown)}. Listed are: {", ".join(server) or "none"}. language_settings_for(name, file_types) maps one anyway.')
        return [{"languageId": ",".join(own), "parser": p.name} for p in self._parsers() if (own := [t for t in types if server[t] == p.name])]

    def define_config(self, settings: Mapping | None = None) -> dict:
        """A configuration: this plugin and its rows come first, so that those of ``settings`` win; its other keys stay."""
        plugin, given = self.snapshot(), dict(settings or {})
        return given | {"plugins": [plugin, *given.get("plugins", [])], "languageSettings": [*plugin.language_settings(), *given.get("languageSettings", [])]}

    def customize(self, name: str | None = None) -> PluginBuilder:
        return PluginBuilder(self.name if name is None else name, self._parsers())

    def to_df(self, spark: SparkSession) -> DataFrame:
        """plugin, ordinal, name, scanner, file_types, filter."""
        rows = [(self.name, k, p.name, p.scanner if isinstance(p.scanner, str) else "custom", list(p.file_types), dict(p.filter_tags) if p.filter_tags else None) for k, p in enumerate(self._parsers())]
        return spark.createDataFrame(rows, "plugin string, ordinal int, name string, scanner string, file_types array<string>, filter map<string,boolean>")


def _check_name(plugin: str, name: str, taken: Iterable[str]) -> None:
    if not name or name == "*":
        raise ValueError(f'Plugin "{plugin}" cannot have a parser named {name!r}.')
    if name in taken:
        raise ValueError(f'Plugin "{plugin}" already has a parser "{name}".')


class Plugin(_Queries):
    """An immutable, ordered list of parsers with unique names."""

    def __init__(self, name: str, parsers: Iterable[Parser]):
        seen: list[Parser] = []
        for p in parsers:
            _check_name(name, p.name, [q.name for q in seen])
            seen.append(p)
        self.name, self._all = name, tuple(seen)

    def _parsers(self) -> tuple[Parser, ...]:
        return self._all

    def snapshot(self) -> Plugin:
        return self


class PluginBuilder(_Queries):
    """A plugin in the making; what it was forked from never changes."""

    def __init__(self, name: str, parsers: Iterable[Parser]):
        self.name, self._all = name, list(parsers)

    def _parsers(self) -> tuple[Parser, ...]:
        return tuple(self._all)

    def set_name(self, name: str) -> PluginBuilder:
        self.name = name
        return self

    def add_parser(self, parser: Parser, as_name: str | None = None) -> PluginBuilder:
        """Append a parser; being last, it serves its file types."""
        name = parser.name if as_name is None else as_name
        _check_name(self.name, name, self.parser_names())
        self._all.append(replace(parser, name=name))
        return self

    def duplicate_parser(self, name: str, new_name: str) -> PluginBuilder:
        return self.add_parser(self.get_parser(name), new_name)

    def rename_parser(self, name: str, new_name: str) -> PluginBuilder:
        """Rename in place; renaming to the same name does nothing."""
        parser = self.get_parser(name)
        if name != new_name:
            _check_name(self.name, new_name, self.parser_names())
            self._all[self._all.index(parser)] = replace(parser, name=new_name)
        return self

    def remove_parser(self, target: Target) -> PluginBuilder:
        names = self._resolve(target)
        self._all = [p for p in self._all if p.name not in names]
        return self

    def _change(self, target: Target, change: Callable[[Parser], Parser]) -> PluginBuilder:
        names = self._resolve(target)
        self._all = [change(p) if p.name in names else p for p in self._all]
        return self

    def set_file_types(self, target: Target, file_types: Iterable[str]) -> PluginBuilder:
        types = tuple(file_types)
        return self._change(target, lambda p: replace(p, file_types=types))

    def add_file_types(self, target: Target, file_types: Iterable[str]) -> PluginBuilder:
        types = tuple(file_types)
        return self._change(target, lambda p: replace(p, file_types=p.file_types + types))

    def remove_file_types(self, target: Target, file_types: Iterable[str]) -> PluginBuilder:
        gone = set(file_types)
        return self._change(target, lambda p: replace(p, file_types=tuple(t for t in p.file_types if t not in gone)))

    def filter_tags(self, target: Target, options: filters.Options | None) -> PluginBuilder:
        """Replace the rules of the parsers; earlier ones do not remain in force."""
        return self._change(target, lambda p: replace(p, filter_tags=options))

    def filter_tags_for_file_type(self, file_type: str, options: filters.Options, new_name: str) -> PluginBuilder:
        """A copy of the parser that serves ``file_type``, for that type alone, with these rules."""
        if file_type == "*":
            raise ValueError('One file type is needed, not "*"; filter_tags("*", ...) filters all.')
        names = self.parser_names_for(file_type)
        if not names:
            raise UnknownName(f'No parser in plugin "{self.name}" lists "{file_type}". Listed are: {", ".join(self.supported_file_types) or "none"}.')
        return self.duplicate_parser(names[-1], new_name).set_file_types(new_name, [file_type]).filter_tags(new_name, options)

    def build(self) -> Plugin:
        return Plugin(self.name, self._all)

    snapshot = build


def create_plugin(name: str, parsers: Iterable[Parser]) -> Plugin:
    return Plugin(name, parsers)


def customize_plugin(plugin: Plugin, options: Mapping | None = None) -> PluginBuilder:
    """A fork of ``plugin``; ``options["tags"]`` are rules for all its parsers."""
    if options is not None and not isinstance(options, Mapping):
        raise TypeError(f'Options are a mapping; for one file type use filter_tags_for_file_type (plugin "{plugin.name}").')
    if options and options.get("name") is not None:
        raise ValueError(f'"name" is no option; use rename_parser (plugin "{plugin.name}").')
    builder = plugin.customize()
    return builder.filter_tags("*", options["tags"]) if options and options.get("tags") else builder


def _parser(name: str, scanner: str, *file_types: str, family: str | None = None) -> Parser:
    return Parser(name, scanner, file_types, defaults(family or scanner))


# Names of parsers and the file types that they serve.
EXAMPLE = Plugin("example", [_parser("c-style-comments", "example", "c", "cpp", "csharp", "java", "javascript", "typescript")])
SINGLE = {
    "c-cpp": Plugin("c-cpp-strings-comments", [_parser("c-cpp-strings-comments", "c-cpp", "c", "cpp")]),
    "csharp": Plugin("csharp-strings-comments", [_parser("csharp-strings-comments", "csharp", "csharp")]),
    "go": Plugin("go-strings-comments", [_parser("go-strings-comments", "go", "go")]),
    "java": Plugin("java-strings-comments", [_parser("java-strings-comments", "java", "java")]),
    "php": Plugin("php-strings-comments", [_parser("php-strings-comments", "php", "php")]),
    "python": Plugin("python-strings-comments", [_parser("python-strings-comments", "python", "python")]),
    "ruby": Plugin("ruby-strings-comments", [_parser("ruby-strings-comments", "ruby", "ruby")]),
    "rust": Plugin("rust-strings-comments", [_parser("rust-strings-comments", "rust", "rust")]),
    "typescript": Plugin("typescript-strings-comments", [
        _parser("javascript-strings-comments", "typescript", "javascript", "javascriptreact"), _parser("typescript-strings-comments", "typescript", "typescript", "typescriptreact"),
    ]),
}
STRINGS_COMMENTS = Plugin("strings-comments", [p for plugin in SINGLE.values() for p in plugin.parsers])
#: The syntax-tree parsers: each is named after the one file type that it serves.
SYNTAX_TREE = Plugin("typescript-syntax-tree", [
    _parser("javascript", "tree-javascript", "javascript", family="syntax-tree"), _parser("javascriptreact", "tree-javascript", "javascriptreact", family="syntax-tree"),
    _parser("typescript", "tree-typescript", "typescript", family="syntax-tree"), _parser("typescriptreact", "tree-tsx", "typescriptreact", family="syntax-tree"),
])
TYPESCRIPT = Plugin("typescript", SYNTAX_TREE.parsers)
JAVASCRIPT = SYNTAX_TREE.customize("javascript").remove_parser(["typescript", "typescriptreact"]).build()
PLUGINS = {p.name: p for p in [EXAMPLE, *SINGLE.values(), STRINGS_COMMENTS, SYNTAX_TREE, TYPESCRIPT, JAVASCRIPT]}


def settings(plugin: Plugin) -> dict:
    """What a host registers: the plugin alone."""
    return {"plugins": [plugin]}


def recommended(plugin: Plugin) -> dict:
    """The plugin with its own mapping of file types."""
    return plugin.define_config()
