"""A tolerant parser: it records names with their kinds and scopes, literals and markup text, and builds no tree.

Precedence does not matter for that, so an expression is a run of operands and operators. What cannot be parsed
costs the token it stands at. Where only what follows tells two readings apart (arrow functions, type arguments),
one is tried and taken back; outcomes are remembered by position, so nested trials stay linear.
"""

from __future__ import annotations

from .reader import MARKUP_NAME, MARKUP_STRING, MARKUP_TEXT, REGEX, TEMPLATE_STOP, Reader, Token

#: Words that never are names of variables.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
BINARY = frozenset("+ - * / % ** == != === !== < > <= << & | ^ && || ?? ,".split()) | ASSIGN
PREDEFINED = frozenset("any number boolean string symbol void unknown never object".split())
MODIFIERS = frozenset("public private protected static readonly abstract override declare accessor async get set".split())


class Scope:
    """Names that hide imports of the same name within a block or a function."""

    __slots__ = ("parent", "names")

    def __init__(self, parent: Scope | None):
        self.parent, self.names = parent, set()

    def hides(self, name: str) -> bool:
        at: Scope | None = self
        while at is not None:
            if name in at.names:
                return True
            at = at.parent
        return False


class Fail(Exception):
    """A trial reading does not fit."""


#: What an operand is rooted in, if that could be an import: its name and scope. ``Module`` marks import() and require().
Root = tuple[str, Scope] | None


class Parser:
    def __init__(self, text: str, typed: bool, markup: bool):
        self.r = Reader(text)
        self.text, self.typed, self.markup = text, typed, markup
        self.scope = Scope(None)
        #: ("name", start, end, kind, scope, root of the object) and ("string", ...), ("template", ...), ("markup", ...).
        self.events: list[tuple] = []
        self.local: set[str] = set()
        self.external: set[str] = set()
        self.arrows: dict[tuple[int, bool], bool] = {}
        self.in_choice = 0

    # -- tokens ---------------------------------------------------------------------------------------------------

    @property
    def t(self) -> Token:
        return self.r.token()

    def is_(self, *texts: str) -> bool:
        t = self.t
        return t.text in texts and t.kind in ("mark", "word")

    def step(self) -> Token:
        t = self.t
        self.r.at = t.end
        return t

    def take(self, *texts: str) -> Token | None:
        return self.step() if self.is_(*texts) else None

    def need(self, text: str) -> Token:
        t = self.take(text)
        if t is None:
            raise Fail
        return t

    def after(self) -> Token:
        return self.r.peek_after(self.t)

    def close_angle(self) -> bool:
        """Take one closing angle bracket, which may begin a longer mark."""
        t = self.t
        if t.kind == "mark" and t.text.startswith(">"):
            self.r.at = t.start + 1
            return True
        return False

    def name(self, t: Token, kind: str, root: Root = None, own: bool = False) -> None:
        self.events.append(("name", t.start, t.end, kind, self.scope, root, own))

    def string(self, t: Token, module: bool = False, plain: bool = False) -> None:
        self.events.append(("string", t.start, t.end, module, plain))

    def attempt(self, reading) -> bool:
        """Try a reading; take everything back if it fails."""
        at, n, scope, choice = self.r.at, len(self.events), self.scope, self.in_choice
        try:
            reading()
            return True
        except Fail:
            self.r.at, self.scope, self.in_choice = at, scope, choice
            del self.events[n:]
            return False

    # -- statements -----------------------------------------------------------------------------------------------

    def program(self) -> None:
        while self.t.kind != "end":
            self.safely(self.statement)

    def safely(self, reading) -> None:
        at, scope = self.r.at, self.scope
        try:
            reading()
        except Fail:
            self.scope = scope
        if self.r.at == at:
            t = self.step()
            if t.kind == "word" and t.text not in RESERVED:
                self.name(t, "variable")

    def block(self) -> None:
        """A block of statements, whose direct declarations hide imports within it."""
        self.need("{")
        outer, self.scope = self.scope, Scope(self.scope)
        while not self.is_("}") and self.t.kind != "end":
            self.safely(lambda: self.statement(direct=True))
        self.take("}")
        self.scope = outer

    def statement(self, direct: bool = False) -> None:
        t = self.t
        if t.kind == "mark":
            if t.text == "{":
                return self.block()
            if t.text == ";":
                self.step()
                return None
            if t.text == "@":
                return self.decorators()
        if t.kind == "word":
            made = getattr(self, f"s_{t.text}", None)
            if made is not None and t.text not in ("type", "namespace", "module", "declare", "abstract", "interface", "async", "let", "enum", "global", "using"):
                return made(direct)
            if made is not None and self.starts_declaration(t):
                return made(direct)
            if self.after().text == ":" and self.after().kind == "mark" and t.text not in RESERVED:
                self.name(self.step(), "label", own=True)
                self.step()
                return self.statement()
        self.expression()
        self.take(";")
        return None

    def starts_declaration(self, t: Token) -> bool:
        n = self.after()
        if t.text == "let":
            return n.kind == "word" and n.text not in ("in", "instanceof", "of") or n.text in ("[", "{")
        if t.text == "async":
            return n.text == "function" and not n.broken
        if not self.typed or n.broken:
            return False
        if t.text in ("namespace", "module"):
            return n.kind in ("word", "string")
        if t.text == "global":
            return n.text == "{"
        return n.kind == "word" and n.text not in ("in", "instanceof", "of", "as", "satisfies")

    def decorators(self) -> None:
        while self.take("@"):
            self.operand()

    def s_import(self, direct: bool) -> None:
        n = self.after()
        if n.text in ("(", ".") and n.kind == "mark":
            self.expression()
            self.take(";")
            return
        self.step()
        if self.t.kind == "string":
            self.string(self.step(), module=True)
            return self.attributes()
        if self.is_("type", "typeof") and self.typed:
            n = self.after()
            if n.text in ("{", "*") or (n.kind == "word" and n.text != "from") or (n.text == "from" and self.r.peek_after(n).text == "from"):
                self.step()
        if self.t.kind == "word" and self.t.text not in RESERVED:
            t = self.step()
            if self.typed and self.is_("="):
                self.name(t, "variable")
                self.step()
                if self.is_("require") and self.after().text == "(":
                    self.step()
                    self.step()
                    if self.t.kind == "string":
                        self.string(self.step())
                    self.take(")")
                else:
                    self.expression()
                self.take(";")
                return
            self.name(t, "importBinding", own=True)
            self.local.add(t.text)
            self.take(",")
        if self.take("*"):
            self.take("as")
            if self.t.kind == "word":
                t = self.step()
                self.name(t, "importBinding", own=True)
                self.local.add(t.text)
        elif self.take("{"):
            while not self.is_("}") and self.t.kind in ("word", "string") or self.is_(","):
                if self.take(","):
                    continue
                t, alias = self.specifier()
                if alias is not None:
                    self.name(alias, "importBinding", own=True)
                    self.local.add(alias.text)
                elif t.kind == "word":
                    self.local.add(t.text)
                    self.external.add(t.text)
            self.take("}")
        if self.take("from") and self.t.kind == "string":
            self.string(self.step(), module=True)
        self.attributes()

    def specifier(self) -> tuple[Token, Token | None]:
        """A name of an import or export list, and its alias."""
        t = self.step()
        n = self.t
        if self.typed and t.text == "type" and n.kind in ("word", "string") and (n.text != "as" or self.after().text == "as"):
            t = self.step()
        if self.is_("as"):
            self.step()
            return t, self.step() if self.t.kind in ("word", "string") else None
        return t, None

    def attributes(self) -> None:
        if self.is_("with", "assert") and self.after().text == "{" and not self.t.broken:
            self.step()
            self.object_literal()
        self.take(";")

    def s_export(self, direct: bool) -> None:
        self.step()
        if self.take("default"):
            if self.is_("function", "class", "abstract", "interface") or (self.is_("async") and self.after().text == "function") or self.is_("@"):
                return self.statement()
            self.expression(comma=False)
            self.take(";")
            return None
        if self.typed and self.take("="):
            self.expression()
            self.take(";")
            return None
        if self.typed and self.is_("as") and self.after().text == "namespace":
            self.step()
            self.step()
            if self.t.kind == "word":
                self.name(self.step(), "variable")
            self.take(";")
            return None
        if self.typed and self.is_("type") and self.after().text in ("{", "*"):
            self.step()
        if self.take("*"):
            if self.take("as") and self.t.kind in ("word", "string"):
                t = self.step()
                if t.kind == "word":
                    self.name(t, "variable")
            if self.take("from") and self.t.kind == "string":
                self.string(self.step(), module=True)
            return self.attributes()
        if self.take("{"):
            found = []
            while not self.is_("}") and self.t.kind in ("word", "string") or self.is_(","):
                if not self.take(","):
                    found.append(self.specifier())
            self.take("}")
            source = self.take("from") if self.is_("from") else None
            for t, alias in found:
                if source is None and t.kind == "word":
                    self.name(t, "variable")
                if alias is not None and alias.kind == "word":
                    self.name(alias, "exportBinding", own=True)
            if source is not None and self.t.kind == "string":
                self.string(self.step(), module=True)
            return self.attributes()
        return self.statement(direct=False)

    def declaration(self, direct: bool) -> None:
        self.step()
        while True:
            t = self.t
            if t.kind == "word" and t.text not in RESERVED:
                self.step()
                self.name(t, "variable")
                if direct:
                    self.scope.names.add(t.text)
            else:
                self.pattern()
            if self.typed:
                self.take("!")
                if self.take(":"):
                    self.type_()
            if self.take("="):
                module = self.module_value()
                self.expression(comma=False, stop_in=True)
                if module and self.r.text[module : self.r.at].strip() == "" and t.kind == "word":
                    self.local.add(t.text)
            if not self.take(","):
                break
        if not self.is_("of", "in"):
            self.take(";")

    def module_value(self) -> int:
        """Where a value that is exactly a call of import or require, awaited or not, ends; 0 for other values."""
        at = self.r.at
        end = 0
        self.take("await")
        t = self.t
        if t.text in ("import", "require") and t.kind == "word" and self.after().text == "(":
            self.step()
            depth = 0
            while self.t.kind != "end":
                u = self.step()
                depth += (u.text == "(") - (u.text == ")") if u.kind == "mark" else 0
                if not depth:
                    end = self.r.at
                    break
            if self.t.kind == "mark" and self.t.text in (".", "?.", "[", "(", "!", "?"):
                end = 0
        self.r.at = at
        return end

    s_const = s_let = s_var = declaration

    def s_using(self, direct: bool) -> None:
        self.declaration(direct)

    def s_function(self, direct: bool) -> None:
        self.function(direct)

    def s_async(self, direct: bool) -> None:
        self.step()
        self.function(direct)

    def function(self, direct: bool = False) -> None:
        """From the word ``function``: a declaration or an expression. Parameters hide imports in all of it."""
        self.need("function")
        star = self.take("*") is not None
        outer, self.scope = self.scope, Scope(self.scope)
        if self.t.kind == "word" and not self.is_("("):
            t = self.step()
            self.name(t, "variable")
            if direct and not star:
                outer.names.add(t.text)
        self.signature()
        if self.is_("{"):
            self.block()
        else:
            self.take(";")
        self.scope = outer

    def signature(self) -> None:
        """Type parameters, parameters and the type of the result."""
        if self.typed and self.is_("<"):
            self.type_parameters()
        if self.is_("("):
            self.parameters()
        if self.typed and self.take(":"):
            self.result_type()

    def parameters(self, strict: bool = False) -> None:
        self.need("(")
        while not self.is_(")"):
            if self.t.kind == "end":
                raise Fail
            self.decorators()
            while self.typed and self.is_("public", "private", "protected", "readonly", "override") and (self.after().kind == "word" or self.after().text in ("{", "[")):
                self.step()
            rest = self.take("...") is not None
            t = self.t
            if t.kind == "word" and (t.text not in RESERVED or t.text == "this"):
                self.step()
                if t.text != "this":
                    self.name(t, "variable")
                    if not rest:
                        self.scope.names.add(t.text)
            else:
                self.pattern()
            if self.typed:
                self.take("?")
                if self.take(":"):
                    self.type_()
            if self.take("="):
                self.expression(comma=False)
            if not self.take(",") and not self.is_(")"):
                raise Fail
        self.step()

    def pattern(self) -> None:
        """A destructuring pattern, or a name."""
        t = self.t
        if self.take("["):
            while not self.is_("]"):
                if self.t.kind == "end":
                    raise Fail
                if self.take(","):
                    continue
                self.take("...")
                self.pattern()
                if self.take("="):
                    self.expression(comma=False)
                if not self.is_(",", "]"):
                    raise Fail
            self.step()
        elif self.take("{"):
            while not self.is_("}"):
                if self.take(","):
                    continue
                if self.take("..."):
                    self.pattern()
                elif self.t.kind == "word" and self.after().text != ":":
                    self.name(self.step(), "shorthandProperty")
                else:
                    self.key()
                    self.need(":")
                    self.pattern()
                if self.take("="):
                    self.expression(comma=False)
                if not self.is_(",", "}"):
                    raise Fail
            self.step()
        elif t.kind == "word" and t.text not in RESERVED:
            self.name(self.step(), "variable")
        else:
            raise Fail

    def key(self) -> None:
        """The name of a member or property."""
        t = self.t
        if t.kind == "word":
            self.name(self.step(), "property", own=True)
        elif t.kind == "private":
            self.name(self.step(), "privateProperty", own=True)
        elif t.kind == "string":
            self.string(self.step())
        elif t.kind == "number":
            self.step()
        elif self.take("["):
            self.expression()
            self.need("]")
        else:
            raise Fail

    def s_class(self, direct: bool) -> None:
        self.class_(direct)

    def class_(self, direct: bool = False) -> None:
        self.need("class")
        if self.t.kind == "word" and not self.is_("extends", "implements"):
            t = self.step()
            self.name(t, "type" if self.typed else "variable")
            if direct:
                self.scope.names.add(t.text)
        if self.typed and self.is_("<"):
            self.type_parameters()
        if self.take("extends"):
            self.operand(heritage=True)
            if self.typed and self.is_("<"):
                self.type_arguments()
        if self.typed and self.take("implements"):
            self.type_()
            while self.take(","):
                self.type_()
        if not self.take("{"):
            return
        while not self.is_("}") and self.t.kind != "end":
            if not self.take(";"):
                self.safely(self.member)
        self.take("}")

    def member(self) -> None:
        self.decorators()
        while self.t.kind == "word" and self.t.text in MODIFIERS:
            n = self.after()
            if n.kind in ("mark", "end") and n.text not in ("[", "*", "{") or (n.text == "{" and self.t.text != "static") or (n.broken and self.t.text in ("get", "set", "static", "accessor")):
                break
            self.step()
            if self.is_("{"):
                return self.block()
        self.take("*")
        if self.typed and self.is_("[") and self.index_signature():
            self.take(";", ",")
            return None
        outer, self.scope = self.scope, Scope(self.scope)
        self.key()
        self.take("?", "!")
        if self.is_("(", "<"):
            self.signature()
            if self.is_("{"):
                self.block()
        else:
            self.scope = outer
            if self.typed and self.take(":"):
                self.type_()
            if self.take("="):
                self.expression(comma=False)
        self.scope = outer
        self.take(";")
        return None

    def index_signature(self) -> bool:
        def reading() -> None:
            self.take("+", "-")
            self.need("[")
            t = self.step()
            if t.kind != "word":
                raise Fail
            if self.take(":"):
                self.name(t, "variable")
                self.type_()
            elif self.take("in"):
                self.name(t, "type")
                self.type_()
                if self.take("as"):
                    self.type_()
            else:
                raise Fail
            self.need("]")
            self.take("+", "-")
            self.take("?")
            if self.take(":"):
                self.type_()

        return self.attempt(reading)

    def s_abstract(self, direct: bool) -> None:
        self.step()
        self.statement(direct)

    s_declare = s_abstract

    def s_interface(self, direct: bool) -> None:
        self.step()
        if self.t.kind == "word":
            self.name(self.step(), "type")
        if self.is_("<"):
            self.type_parameters()
        if self.take("extends"):
            self.type_()
            while self.take(","):
                self.type_()
        if self.is_("{"):
            self.object_type()

    def s_type(self, direct: bool) -> None:
        self.step()
        self.name(self.step(), "type")
        if self.is_("<"):
            self.type_parameters()
        if self.take("="):
            self.type_()
        self.take(";")

    def s_enum(self, direct: bool) -> None:
        self.step()
        if self.t.kind == "word":
            self.name(self.step(), "variable")
        self.need("{")
        while not self.is_("}") and self.t.kind != "end":
            if self.take(","):
                continue
            self.key()
            if self.take("="):
                self.expression(comma=False)
        self.take("}")

    def s_namespace(self, direct: bool) -> None:
        self.step()
        if self.t.kind == "string":
            self.string(self.step())
        else:
            self.name(self.step(), "variable")
            while self.take("."):
                self.name(self.step(), "property", own=True)
        if self.is_("{"):
            self.block()
        self.take(";")

    s_module = s_namespace

    def s_global(self, direct: bool) -> None:
        self.step()
        self.block()

    def s_if(self, direct: bool) -> None:
        self.step()
        self.grouped()
        self.statement()
        if self.take("else"):
            self.statement()

    def grouped(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_while(self, direct: bool) -> None:
        self.step()
        self.grouped()
        self.statement()

    s_with = s_while

    def s_do(self, direct: bool) -> None:
        self.step()
        self.statement()
        if self.take("while"):
            self.grouped()
        self.take(";")

    def s_for(self, direct: bool) -> None:
        self.step()
        self.take("await")
        self.need("(")
        if self.is_("const", "var") or (self.is_("let", "using") and self.starts_declaration(self.t)):
            self.declaration(False)
        elif not self.take(";"):
            self.expression(stop_in=True)
            self.take(";")
        if self.take("of", "in"):
            self.expression()
        else:
            while not self.is_(")") and self.t.kind != "end":
                if not self.take(";"):
                    self.expression()
        self.need(")")
        self.statement()

    def s_switch(self, direct: bool) -> None:
        self.step()
        self.grouped()
        self.need("{")
        while not self.is_("}") and self.t.kind != "end":
            if self.take("case"):
                self.expression()
                self.take(":")
            elif self.is_("default"):
                self.step()
                self.take(":")
            else:
                self.safely(self.statement)
        self.take("}")

    def s_try(self, direct: bool) -> None:
        self.step()
        self.block()
        if self.take("catch"):
            if self.take("("):
                self.pattern()
                if self.typed and self.take(":"):
                    self.type_()
                self.need(")")
            self.block()
        if self.take("finally"):
            self.block()

    def s_return(self, direct: bool) -> None:
        self.step()
        if not (self.t.broken or self.is_(";", "}") or self.t.kind == "end"):
            self.expression()
        self.take(";")

    s_throw = s_return

    def s_break(self, direct: bool) -> None:
        self.step()
        if self.t.kind == "word" and not self.t.broken:
            self.name(self.step(), "label", own=True)
        self.take(";")

    s_continue = s_break

    def s_debugger(self, direct: bool) -> None:
        self.step()
        self.take(";")

    # -- expressions ----------------------------------------------------------------------------------------------

    def expression(self, comma: bool = True, stop_in: bool = False) -> None:
        while True:
            self.operand()
            if not self.operator(comma, stop_in):
                return

    def operator(self, comma: bool, stop_in: bool) -> bool:
        """Take an operator that another operand follows."""
        while True:
            t = self.t
            if t.kind == "word":
                if self.typed and t.text in ("as", "satisfies") and not t.broken:
                    self.step()
                    if not self.take("const"):
                        self.type_()
                    continue
                if t.text == "instanceof" or (t.text == "in" and not stop_in):
                    self.step()
                    return True
                return False
            if t.kind != "mark":
                return False
            if t.text == "?":
                self.step()
                self.in_choice += 1
                self.expression(comma=False)
                self.in_choice -= 1
                if self.take(":"):
                    return True
                continue
            if t.text == ">":  # longer marks of this kind are read piecewise, as types end with it
                self.step()
                while self.r.at < len(self.text) and self.text[self.r.at] in ">=":
                    self.r.at += 1
                return True
            if t.text in BINARY and (t.text != "," or comma):
                self.step()
                return True
            return False

    def operand(self, heritage: bool = False) -> Root:
        while True:
            t = self.t
            if t.kind == "mark" and t.text in ("!", "~", "+", "-", "++", "--", "..."):
                self.step()
            elif t.kind == "word" and t.text in ("typeof", "void", "delete", "new"):
                self.step()
                if t.text == "new" and self.take("."):  # new.target
                    self.step()
                    return self.postfix(None, heritage)
            elif t.kind == "word" and t.text in ("await", "yield") and self.begins_operand(self.after(), t.text):
                self.step()
                self.take("*")
            else:
                break
        return self.postfix(self.primary(), heritage)

    def begins_operand(self, n: Token, word: str) -> bool:
        if n.broken and word == "yield":
            return False
        return n.kind in ("word", "string", "number", "template", "private") and n.text not in ("in", "of", "instanceof", "as") or n.text in ("(", "[", "{", "<", "!", "+", "-", "/", "*" if word == "yield" else "(")

    def postfix(self, root: Root, heritage: bool = False) -> Root:
        while True:
            t = self.t
            if t.kind == "template":
                self.template()
                root = None
            elif t.kind != "mark":
                return root
            elif t.text in (".", "?."):
                self.step()
                n = self.t
                if n.kind == "word":
                    self.name(self.step(), "property", root, own=True)
                elif n.kind == "private":
                    self.name(self.step(), "privateProperty", root, own=True)
                elif t.text == "?." and n.text in ("(", "["):
                    continue
                else:
                    return None
            elif t.text == "[":
                self.step()
                self.expression()
                self.take("]")
                root = None
            elif t.text == "(":
                self.arguments(False)
                root = None
            elif t.text == "!" and self.typed and not t.broken:
                self.step()
                root = None
            elif t.text in ("++", "--") and not t.broken:
                self.step()
                root = None
            elif t.text == "<" and self.typed and not heritage and self.attempt(self.called_type_arguments):
                root = None
            else:
                return root

    def called_type_arguments(self) -> None:
        self.type_arguments()
        if not (self.is_("(") or self.t.kind == "template"):
            raise Fail

    def arguments(self, module: bool) -> None:
        """Arguments of a call; the first string of import() names a module."""
        self.need("(")
        first = True
        while not self.is_(")") and self.t.kind != "end":
            if self.take(","):
                first = False
                continue
            at = self.r.at
            if first and module and self.t.kind == "string" and self.after().text in (")", ","):
                self.string(self.step(), module=True)
            else:
                self.take("...")
                self.expression(comma=False)
            first = False
            if not self.is_(",", ")"):
                if self.r.at == at:
                    self.step()
                if self.is_(";", "}"):
                    return
        self.take(")")

    def primary(self) -> Root:
        t = self.t
        if t.kind == "string":
            self.string(self.step())
        elif t.kind == "number":
            self.step()
        elif t.kind == "template":
            self.template()
        elif t.kind == "private":
            self.name(self.step(), "privateProperty", own=True)
        elif t.kind == "word":
            return self.word()
        elif t.text == "(":
            return self.parenthesis()
        elif t.text == "[":
            self.step()
            while not self.is_("]") and self.t.kind != "end":
                if self.take(","):
                    continue
                at = self.r.at
                self.take("...")
                self.expression(comma=False)
                if self.r.at == at:
                    raise Fail
            self.take("]")
        elif t.text == "{":
            self.object_literal()
        elif t.text in ("/", "/="):
            m = REGEX.match(self.text, t.start)
            if not m:
                raise Fail
            self.r.at = m.end()
        elif t.text == "<":
            self.angle()
        elif t.text == "@":
            self.decorators()
            self.class_()
        else:
            raise Fail
        return None

    def word(self) -> Root:
        t = self.t
        n = self.after()
        if t.text == "function":
            self.function()
        elif t.text == "class":
            self.class_()
        elif t.text == "async" and n.text == "function" and not n.broken:
            self.step()
            self.function()
        elif t.text == "async" and not n.broken and n.kind == "word" and n.text not in RESERVED | {"in", "of"} and self.r.peek_after(n).text == "=>":
            self.step()
            self.arrow_of_one()
        elif t.text == "async" and not n.broken and n.text in ("(", "<") and self.try_arrow(n):
            pass
        elif t.text == "import":
            self.step()
            if self.take("."):
                self.step()
            elif self.is_("("):
                self.arguments(True)
        elif t.text in ("this", "super", "null", "true", "false", "undefined"):
            self.step()
        elif t.text in RESERVED:
            raise Fail
        elif n.text == "=>" and n.kind == "mark":
            self.arrow_of_one()
        else:
            self.step()
            self.name(t, "variable")
            return t.text, self.scope
        return None

    def arrow_of_one(self) -> None:
        outer, self.scope = self.scope, Scope(self.scope)
        t = self.step()
        self.name(t, "variable")
        self.scope.names.add(t.text)
        self.need("=>")
        self.arrow_body()
        self.scope = outer

    def arrow_body(self) -> None:
        if self.is_("{"):
            self.block()
        else:
            self.expression(comma=False)

    def try_arrow(self, at: Token) -> bool:
        """An arrow function whose parameters, or type parameters, begin at ``at``."""
        key = (at.start, bool(self.in_choice))
        if self.arrows.get(key) is False:
            return False

        def reading() -> None:
            self.r.at = at.start
            self.scope = Scope(self.scope)
            if self.is_("<"):
                self.type_parameters()
            self.parameters()
            if self.typed and self.is_(":"):
                if self.in_choice and not self.text[self.r.at :].lstrip().startswith(": "):
                    raise Fail
                self.step()
                self.result_type()
            if self.t.broken:
                raise Fail
            self.need("=>")

        outer = self.scope
        self.arrows[key] = self.attempt(reading)
        if not self.arrows[key]:
            return False
        self.arrow_body()
        self.scope = outer
        return True

    def parenthesis(self) -> Root:
        if self.try_arrow(self.t):
            return None
        self.step()
        roots = []
        while not self.is_(")") and self.t.kind != "end":
            roots.append(self.operand())
            if not self.operator(True, False):
                break
            roots.append(None)
        self.take(")")
        return roots[0] if len(roots) == 1 else None

    def object_literal(self) -> None:
        self.need("{")
        while not self.is_("}") and self.t.kind != "end":
            if self.take(","):
                continue
            if self.take("..."):
                self.expression(comma=False)
                continue
            t, n = self.t, self.after()
            if t.kind == "word" and n.text in (",", "}", "=") and n.kind == "mark":
                self.name(self.step(), "shorthandProperty")
                if self.take("="):
                    self.expression(comma=False)
                continue
            while self.t.kind == "word" and self.t.text in ("get", "set", "async", "static") and (self.after().kind != "mark" or self.after().text in ("[", "*")):
                self.step()
            self.take("*")
            outer, self.scope = self.scope, Scope(self.scope)
            self.key()
            if self.is_("(", "<"):
                self.signature()
                self.block()
                self.scope = outer
            else:
                self.scope = outer
                self.need(":")
                self.expression(comma=False)
        self.take("}")

    def template(self, types: bool = False) -> None:
        """A template literal: runs of text between substitutions."""
        at = run = self.step().end
        text = self.text
        while True:
            m = TEMPLATE_STOP.search(text, at)
            if not m:
                self.run(run, len(text))
                self.r.at = len(text)
                return
            if m[0] == "\\":
                at = min(len(text), m.end() + 1)
                continue
            self.run(run, m.start())
            self.r.at = m.end()
            if m[0] == "`":
                return
            if types:
                self.type_()
            elif not self.is_("}"):
                self.expression()
            while not self.is_("}") and self.t.kind != "end":
                self.safely(self.statement)
            if self.t.kind == "end":
                return
            at = run = self.step().end

    def run(self, start: int, end: int) -> None:
        if end > start:
            self.events.append(("template", start, end))

    # -- markup ---------------------------------------------------------------------------------------------------

    def angle(self) -> None:
        """A markup element, a generic arrow function, or a type assertion."""
        if self.typed and self.try_arrow(self.t):
            return
        if self.markup:
            return self.element()
        if not self.typed:
            raise Fail
        self.step()
        self.type_()
        if not self.close_angle():
            raise Fail
        self.operand()
        return None

    def element(self) -> None:
        """An element or fragment with its children."""
        open_ = self.need("<")
        if not self.is_(">"):
            self.tag_name()
            if self.typed and self.is_("<"):
                self.type_arguments()
            while not self.is_(">", "/"):
                if self.take("{"):
                    self.take("...")
                    self.expression()
                    self.need("}")
                    continue
                self.r.at = self.t.start
                m = MARKUP_NAME.match(self.text, self.r.at)
                if not m:
                    raise Fail
                self.attribute_name(m.end())
                if self.take("="):
                    self.attribute_value()
            if self.take("/"):
                self.markup_close()
                return
        self.markup_close()
        self.children()
        del open_

    def markup_close(self) -> None:
        t = self.t
        if t.kind != "mark" or not t.text.startswith(">"):
            raise Fail
        self.r.at = t.start + 1

    def attribute_name(self, end: int) -> None:
        start = self.r.at
        self.events.append(("name", start, end, "property", self.scope, None, True))
        self.r.at = end
        if self.text.startswith(":", end) and (m := MARKUP_NAME.match(self.text, end + 1)):
            self.events.append(("name", m.start(), m.end(), "property", self.scope, None, True))
            self.r.at = m.end()

    def attribute_value(self) -> None:
        at = self.t.start
        quote = self.text[at : at + 1]
        if quote in ("'", '"') and quote:
            m = MARKUP_STRING[quote].match(self.text, at)
            if not m:
                raise Fail
            self.events.append(("string", at, m.end(), False, True))
            self.r.at = m.end()
        elif self.take("{"):
            if not self.is_("}"):
                self.expression()
            self.need("}")
        else:
            self.element()

    def tag_name(self) -> None:
        self.r.at = self.t.start
        m = MARKUP_NAME.match(self.text, self.r.at)
        if not m:
            raise Fail
        root: Root = (m[0], self.scope)
        self.events.append(("name", m.start(), m.end(), "variable", self.scope, None, False))
        self.r.at = m.end()
        if self.text.startswith(":", self.r.at) and (n := MARKUP_NAME.match(self.text, self.r.at + 1)):
            self.events.append(("name", n.start(), n.end(), "variable", self.scope, None, False))
            self.r.at = n.end()
        while self.take("."):
            if self.t.kind == "word":
                self.name(self.step(), "property", root, own=True)

    def children(self) -> None:
        """Children up to and with the closing tag; runs of text and references become one event."""
        text, at = self.text, self.r.at
        run = at
        while at < len(text):
            c = text[at]
            if c not in "{}<>":
                at = MARKUP_TEXT.match(text, at).end()
                continue
            if c in "}>":
                at += 1
                continue
            self.markup_text(run, at)
            self.r.at = at
            if c == "{":
                self.step()
                self.take("...")
                if not self.is_("}"):
                    self.expression()
                self.need("}")
            elif self.after().text == "/":
                self.step()
                self.step()
                if not self.is_(">"):
                    self.tag_name()
                self.markup_close()
                return
            else:
                self.element()
            at = run = self.r.at
        self.markup_text(run, at)
        self.r.at = at

    def markup_text(self, start: int, end: int) -> None:
        if end > start:
            self.events.append(("markup", start, end))

    # -- types ----------------------------------------------------------------------------------------------------

    def result_type(self) -> None:
        if self.is_("asserts") and self.after().kind == "word" and not self.after().broken:
            self.step()
            t = self.step()
            if t.text != "this":
                self.name(t, "variable")
            if self.take("is"):
                self.type_()
            return
        if self.t.kind == "word" and self.after().text == "is" and self.after().kind == "word" and not self.after().broken:
            t = self.step()
            if t.text != "this":
                self.name(t, "variable")
            self.step()
        self.type_()

    def type_(self) -> None:
        self.take("|", "&")
        while True:
            self.type_operand()
            if self.take("|", "&"):
                continue
            if self.is_("extends") and not self.t.broken:
                self.step()
                self.type_()
                if self.take("?"):
                    self.type_()
                    if self.take(":"):
                        continue
            return

    def type_operand(self) -> None:
        while self.t.kind == "word" and self.t.text in ("keyof", "readonly", "unique", "infer", "asserts", "abstract") and (self.after().kind in ("word", "string", "template") or self.after().text in ("(", "[", "{")):
            self.step()
        t = self.t
        if t.kind == "string":
            self.string(self.step())
        elif t.kind == "number":
            self.step()
        elif t.kind == "template":
            self.template(types=True)
        elif t.text == "-" and self.after().kind == "number":
            self.step()
            self.step()
        elif t.text == "typeof" and t.kind == "word":
            self.step()
            if self.is_("import"):
                self.type_operand()
            else:
                u = self.step()
                root: Root = None
                if u.kind == "word" and u.text != "this":
                    self.name(u, "variable")
                    root = (u.text, self.scope)
                while self.take("."):
                    self.name(self.step(), "property", root, own=True)
            if self.is_("<"):
                self.type_arguments()
        elif t.text == "import" and t.kind == "word":
            self.step()
            if self.is_("("):
                self.arguments(True)
            while self.take("."):
                self.name(self.step(), "type")
            if self.is_("<"):
                self.type_arguments()
        elif t.text == "new" and t.kind == "word":
            self.step()
            self.function_type()
        elif t.kind == "word":
            self.step()
            if t.text not in PREDEFINED and t.text not in ("this", "null", "undefined", "true", "false"):
                parts = [t]
                while self.is_(".") and self.after().kind == "word":
                    self.step()
                    parts.append(self.step())
                for k, part in enumerate(parts[:-1]):
                    self.name(part, "variable" if k == 0 else "property", own=k > 0)
                self.name(parts[-1], "type")
            if self.is_("<") and not self.t.broken:
                self.type_arguments()
        elif t.text == "(":
            if not self.attempt(self.function_type):
                self.step()
                self.type_()
                self.need(")")
        elif t.text == "<":
            self.function_type()
        elif t.text == "{":
            self.object_type()
        elif t.text == "[":
            self.step()
            while not self.is_("]"):
                if self.t.kind == "end":
                    raise Fail
                if self.take(","):
                    continue
                self.take("...")
                n = self.after()
                if self.t.kind == "word" and (n.text == ":" or (n.text == "?" and self.r.peek_after(n).text == ":")):
                    self.name(self.step(), "variable")
                    self.take("?")
                    self.take(":")
                self.type_()
                self.take("?")
                if not self.is_(",", "]"):
                    raise Fail
            self.step()
        else:
            raise Fail
        while self.is_("[") and not self.t.broken:
            self.step()
            if not self.is_("]"):
                self.type_()
            self.need("]")

    def function_type(self) -> None:
        outer, self.scope = self.scope, Scope(self.scope)
        if self.is_("<"):
            self.type_parameters()
        self.parameters()
        self.scope = outer
        self.need("=>")
        self.result_type()

    def object_type(self) -> None:
        self.need("{")
        while not self.is_("}"):
            if self.t.kind == "end":
                raise Fail
            if self.take(";", ","):
                continue
            if self.is_("+", "-") and self.after().text == "readonly":
                self.step()
            while self.t.kind == "word" and self.t.text in ("readonly", "get", "set") and (self.after().kind != "mark" or self.after().text == "["):
                self.step()
            if self.is_("[") and self.index_signature():
                continue
            outer, self.scope = self.scope, Scope(self.scope)
            if self.is_("new") and self.after().text in ("(", "<"):
                self.step()
            if not self.is_("(", "<"):
                self.key()
                self.take("?")
            if self.is_("(", "<"):
                self.signature()
                self.scope = outer
            else:
                self.scope = outer
                if self.take(":"):
                    self.type_()
            if not (self.is_(";", ",", "}") or self.t.broken):
                raise Fail
        self.step()

    def type_arguments(self) -> None:
        self.need("<")
        while True:
            self.type_()
            if self.take(","):
                continue
            if not self.close_angle():
                raise Fail
            return

    def type_parameters(self) -> None:
        self.need("<")
        while True:
            while self.is_("const", "in", "out") and self.after().kind == "word":
                self.step()
            if self.t.kind != "word":
                raise Fail
            self.name(self.step(), "type")
            if self.take("extends"):
                self.type_()
            if self.take("="):
                self.type_()
            if self.take(","):
                if self.close_angle():
                    return
                continue
            if not self.close_angle():
                raise Fail
            return

