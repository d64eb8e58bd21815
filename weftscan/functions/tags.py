"""Tag vocabularies of every parser family, in declaration order, and functions over tag names."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tags that each family may emit, in the order that breaks ties between equally specific rules.
VOCABULARY: dict[str, list[str]] = {
    "c-cpp": ["comment", "comment.line", "comment.line.doc", "comment.block", "comment.block.doc", "string", "string.singleQuote", "string.doubleQuote", "string.raw", "code"],
    "csharp": ["comment", "comment.line", "comment.line.doc", "comment.block", "comment.block.doc", "string", "string.singleQuote", "string.doubleQuote", "string.verbatim", "string.interpolated", "string.raw", "code"],
    "go": ["comment", "comment.line", "comment.block", "comment.block.doc", "string", "string.singleQuote", "string.doubleQuote", "string.raw", "code"],
    "java": ["comment", "comment.line", "comment.block", "comment.block.doc", "string", "string.singleQuote", "string.doubleQuote", "string.textBlock", "code"],
    "php": ["comment", "comment.line", "comment.block", "comment.block.doc", "string", "string.singleQuote", "string.doubleQuote", "string.heredoc", "string.nowdoc", "html", "code"],
    "python": ["comment", "comment.line", "string", "string.singleQuote", "string.doubleQuote", "string.tripleQuote", "string.raw", "string.interpolated", "code"],
    "ruby": ["comment", "comment.line", "comment.block", "string", "string.singleQuote", "string.doubleQuote", "string.heredoc", "string.backtick", "code"],
    "rust": ["comment", "comment.line", "comment.line.doc", "comment.block", "comment.block.doc", "string", "string.byte", "string.raw", "string.byte.raw", "string.c", "string.c.raw", "code"],
    "typescript": ["comment", "comment.line", "comment.block", "comment.block.doc", "string", "string.singleQuote", "string.doubleQuote", "string.singleQuote.module", "string.doubleQuote.module", "string.templateLiteral", "module", "module.specifier", "module.specifier.literal", "code"],
    "syntax-tree": ["string", "string.singleQuote", "string.doubleQuote", "string.module", "string.singleQuote.module", "string.doubleQuote.module", "string.templateLiteral", "module", "module.specifier", "module.specifier.literal", "comment", "comment.line", "comment.block", "comment.block.doc", "identifier", "identifier.variable", "identifier.property", "identifier.privateProperty", "identifier.type", "identifier.shorthandProperty", "identifier.label", "identifier.importBinding", "identifier.exportBinding", "jsx", "jsx.text", "code"],
    "example": ["comment", "comment.line", "comment.block", "comment.block.doc", "code"],
}
OFF_BY_DEFAULT = frozenset(["code", "html"])

#: What each tag covers, where it does not depend on the family.
MEANINGS = {
    "comment": "Comments of every kind",
    "comment.line": "Comments that end with their line",
    "comment.line.doc": "Documentation comments of one line",
    "comment.block": "Comments between an opening and a closing marker",
    "comment.block.doc": "Documentation comments in a block",
    "string": "Literals that hold text",
    "string.singleQuote": "Literals in single quotes",
    "string.doubleQuote": "Literals in double quotes",
    "string.raw": "Literals without escapes",
    "string.verbatim": "Verbatim literals",
    "string.interpolated": "Literals with interpolated parts",
    "string.textBlock": "Text blocks",
    "string.heredoc": "Here-documents",
    "string.nowdoc": "Here-documents without interpolation",
    "string.tripleQuote": "Literals in triple quotes",
    "string.backtick": "Command literals",
    "string.byte": "Byte literals",
    "string.byte.raw": "Byte literals without escapes",
    "string.c": "C string literals",
    "string.c.raw": "C string literals without escapes",
    "string.module": "Literals that name a module",
    "string.singleQuote.module": "Module names in single quotes",
    "string.doubleQuote.module": "Module names in double quotes",
    "string.templateLiteral": "Text parts of template literals",
    "module": "What concerns modules",
    "module.specifier": "Module specifiers",
    "module.specifier.literal": "Module specifiers written as a literal",
    "identifier": "Names in the program",
    "identifier.variable": "Names of variables and functions",
    "identifier.property": "Names of properties",
    "identifier.privateProperty": "Names of private members",
    "identifier.type": "Names of types",
    "identifier.shorthandProperty": "Properties named like their variable",
    "identifier.label": "Labels of statements",
    "identifier.importBinding": "Local names of imports",
    "identifier.exportBinding": "Names given to exports",
    "jsx": "What concerns markup in expressions",
    "jsx.text": "Text between markup tags",
    "html": "Markup outside of the program's tags",
    "code": "All that no other segment covers",
}
LINE_MARKERS = {"c-cpp": "//", "csharp": "//", "go": "//", "java": "//", "php": "// or #", "python": "#", "ruby": "#", "rust": "//", "typescript": "//", "syntax-tree": "//", "example": "//"}


def meaning(family: str, tag: str) -> str:
    return f"Comments from {LINE_MARKERS[family]} to the end of the line" if tag == "comment.line" else MEANINGS[tag]


@lru_cache(maxsize=None)
def chain(tag: str) -> tuple[str, ...]:
    """A tag after all its dotted ancestors."""
    parts = tag.split(".")
    return tuple(".".join(parts[:k]) for k in range(1, len(parts) + 1))


def tag_set(*leaves: str) -> tuple[str, ...]:
    """The union of some tags' chains, in order of first mention."""
    return tuple(dict.fromkeys(t for leaf in leaves for t in chain(leaf)))


def defaults(family: str) -> dict[str, bool]:
    """Tags of a family in declaration order, with whether they are on by default."""
    return {t: t not in OFF_BY_DEFAULT for t in VOCABULARY[family]}


def hierarchical_tags(tag: Column) -> Column:
    """A tag and all its ancestors, shortest first, as an array."""
    parts = F.split(tag, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))


def first_segment(tag: Column) -> Column:
    return F.substring_index(tag, ".", 1)


def catalog(spark: SparkSession) -> DataFrame:
    """family, ordinal, tag, meaning, default_on of all families."""
    rows = [(f, k, t, meaning(f, t), t not in OFF_BY_DEFAULT) for f, tags in VOCABULARY.items() for k, t in enumerate(tags)]
    return spark.createDataFrame(rows, "family string, ordinal int, tag string, meaning string, default_on boolean")
