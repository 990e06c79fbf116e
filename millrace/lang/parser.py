"""Lexer and parser of the query language: text to statements over expression nodes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*|//[^\n]*|/\*.*?\*/)|(?P<str>'''.*?'''|\"\"\".*?\"\"\"|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<path>`[^`]*`)
    |(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)|(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(?P<op><-|->|::|\|\||\*\*|<=|>=|!=|<>|[-+*/%=<>()\[\]{},;:?~@.|])""",
    re.S | re.X,
)
AGGREGATES = {"count", "count_distinct", "sum", "avg", "min", "max", "stddev", "variance", "array_agg", "bool_or", "bool_and", "any", "grouping", "grouping_id"}
WINDOWS = {"row_number", "rank", "dense_rank", "lag", "lead"}
PURPOSES = {"key", "property", "unique", "metric", "auto", "const", "constant"}
PLAIN_TYPES = {"string", "bytes", "bool", "int", "bigint", "float", "double", "number", "numeric", "decimal", "date", "datetime", "timestamp", "geography", "any"}


class TypeName(str):
    """A type's name, with the values it allows, ("range", low, high), ("value", v) or ("match", pattern), and its trait."""

    domain: tuple = ()
    trait: str | None = None


def typed(name: str, domain: tuple = (), trait: str | None = None) -> TypeName:
    out = TypeName(name)
    out.domain, out.trait = domain, trait
    return out


class LanguageError(ValueError):
    """A text that is no valid statement, or a query that has no safe meaning."""


@dataclass(frozen=True)
class Node:
    """kind: lit, ref, call, agg, win, case, in, filter, cast, array, struct, macro, scalar, subselect. Each kind's data is in name, args and extra."""

    kind: str
    name: Any = None
    args: tuple = ()
    extra: tuple = ()

    def walk(self):
        yield self
        for x in (*self.args, *self.extra):
            if isinstance(x, Node):
                yield from x.walk()
            elif isinstance(x, tuple):
                for y in x:
                    if isinstance(y, Node):
                        yield from y.walk()

    def map(self, f) -> Node:
        """A copy with f applied to the nodes right below."""
        one = lambda x: f(x) if isinstance(x, Node) else tuple(one(y) for y in x) if isinstance(x, tuple) else x
        return Node(self.kind, self.name, one(self.args), one(self.extra))


@dataclass
class Statement:
    kind: str
    data: dict = field(default_factory=dict)


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        #: Comments, each with the place of the token after it; the place of each statement's first token.
        self.comments: list[tuple[int, str]] = []
        self.begins: list[int] = []
        at = 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise LanguageError(f"can't read {text[at : at + 30]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0]))
            elif not m[0].isspace():
                self.comments.append((len(self.tokens), m[0].rstrip()))
        self.tokens.append(("end", ""))
        self.at = 0

    # Tokens

    def peek(self, ahead: int = 0) -> str:
        kind, value = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return value.lower() if kind == "name" else value if kind == "op" else f"<{kind}>"

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def accept(self, *values: str) -> bool:
        if all(self.peek(k) == v for k, v in enumerate(values)):
            self.at += len(values)
            return True
        return False

    def expect(self, *values: str) -> None:
        if not self.accept(*values):
            near = " ".join(t[1] for t in self.tokens[max(0, self.at - 4) : self.at + 4])
            raise LanguageError(f"expected {' '.join(values)} near: {near}")

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name":
            raise LanguageError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def listed(self, item, close: str = ")") -> list:
        out = []
        while self.peek() != close:
            out.append(item())
            if not self.accept(","):
                break
        self.expect(close)
        return out

    # Expressions, by precedence

    def expression(self) -> Node:
        left = self.conjunction()
        while self.accept("or"):
            left = Node("call", "or", (left, self.conjunction()))
        return left

    def conjunction(self) -> Node:
        left = self.negation()
        while self.accept("and"):
            left = Node("call", "and", (left, self.negation()))
        return left

    def negation(self) -> Node:
        return Node("call", "not", (self.negation(),)) if self.accept("not") else self.comparison()

    def comparison(self) -> Node:
        left = self.sum()
        if self.accept("?"):
            left = Node("filter", None, (left, self.expression()))
        while True:
            op = self.peek()
            if op in ("=", "!=", "<>", "<", ">", "<=", ">="):
                self.take()
                left = Node("call", {"<>": "!="}.get(op, op), (left, self.sum()))
            elif self.accept("is"):
                no = self.accept("not")
                if self.accept("null"):
                    left = Node("call", "is_null", (left,))
                else:
                    left = Node("call", "is_not_distinct", (left, self.sum()))
                left = Node("call", "not", (left,)) if no else left
            elif op in ("like", "ilike", "between", "in") or op == "not" and self.peek(1) in ("like", "ilike", "between", "in"):
                no = self.accept("not")
                op = self.take().lower()
                if op == "between":
                    low = self.sum()
                    self.expect("and")
                    left = Node("call", "between", (left, low, self.sum()))
                elif op == "in":
                    left = self.membership(left)
                else:
                    left = Node("call", op, (left, self.sum()))
                left = Node("call", "not", (left,)) if no else left
            else:
                return left

    def membership(self, left: Node) -> Node:
        if not self.accept("("):
            return Node("in", "set", (left, self.sum()))
        if self.peek() in ("select", "where", "from"):
            inner = self.select()
            self.expect(")")
            return Node("in", "select", (left,), (Query(inner),))
        items = self.listed(self.expression)
        if left.kind == "call" and left.name == "tuple" or len(items) == 1 and items[0].kind not in ("lit", "array"):
            return Node("in", "set", (left, items[0] if len(items) == 1 else Node("call", "tuple", tuple(items))))
        return Node("in", "list", (left, *items))

    def sum(self) -> Node:
        left = self.product()
        while self.peek() in ("+", "-", "||"):
            op = self.take()
            left = Node("call", {"+": "add", "-": "subtract", "||": "concat_strict"}[op], (left, self.product()))
        return left

    def product(self) -> Node:
        left = self.power()
        while self.peek() in ("*", "/", "%"):
            op = self.take()
            left = Node("call", {"*": "multiply", "/": "divide", "%": "mod"}[op], (left, self.power()))
        return left

    def power(self) -> Node:
        left = self.unary()
        return Node("call", "power", (left, self.power())) if self.accept("**") else left

    def unary(self) -> Node:
        if self.accept("-"):
            x = self.unary()
            return Node("lit", -x.name) if x.kind == "lit" and isinstance(x.name, (int, float)) else Node("call", "negate", (x,))
        x = self.primary()
        while True:
            if self.accept("::"):
                x = Node("cast", self.type(declared=False), (x,))
            elif self.accept("["):
                x = Node("call", "index", (x, self.expression()))
                self.expect("]")
            elif self.peek() == "." and self.tokens[self.at + 1][0] == "name":
                self.take()
                x = Node("call", "getattr", (x, Node("lit", self.name())))
            else:
                return x

    def type(self, declared: bool = True) -> TypeName:
        """A type; in declarations it may be followed by the values it allows."""
        name, domain = self.name(), ()
        if self.accept("<"):
            inner = []
            while True:
                field = self.name() + ":" if self.peek(1) == ":" else ""
                if field:
                    self.expect(":")
                inner.append(field + self.type())
                if not self.accept(","):
                    break
            self.expect(">")
            if name.lower() == "enum":
                self.expect("[")
                name, domain = inner[0], tuple(("value", v) for v in self.listed(self.literal, "]"))
            else:
                name = f"{name}<{','.join(inner)}>"
        elif self.accept("("):
            name = f"{name}({','.join(self.listed(self.take))})"
        if declared and self.accept("["):
            domain = tuple(self.listed(lambda: self.allowed(name), "]"))
        trait = None
        if self.peek() == "::" and self.peek(1) not in PLAIN_TYPES and self.tokens[self.at + 1][0] == "name":
            self.take()
            trait = self.name()
        return typed(name, domain, trait)

    def literal(self):
        sign = -1 if self.accept("-") else 1
        kind, value = self.tokens[self.at]
        if kind not in ("num", "str"):
            raise LanguageError(f"expected a value, found {value!r}")
        self.take()
        return self.string(value) if kind == "str" else sign * (float(value) if "." in value else int(value))

    def allowed(self, name: str) -> tuple:
        if self.accept(".", "."):
            return "range", None, self.literal()
        low = self.literal()
        if not self.accept(".", "."):
            return ("match", low) if name.lower() == "string" else ("value", low)
        return "range", low, None if self.peek() in (",", "]") else self.literal()

    def primary(self) -> Node:
        kind, value = self.tokens[self.at]
        word = self.peek()
        if kind == "num":
            self.take()
            return Node("lit", float(value) if "." in value else int(value))
        if kind == "str":
            self.take()
            return Node("lit", self.string(value))
        if self.accept("("):
            if self.peek() in ("select", "where", "from"):
                inner = self.select()
                self.expect(")")
                return Node("scalar", None, (), (Query(inner),))
            items = self.listed(self.expression)
            return items[0] if len(items) == 1 else Node("call", "tuple", tuple(items))
        if self.accept("["):
            return Node("array", None, tuple(self.listed(self.expression, "]")))
        if self.accept("{"):
            pairs = self.listed(lambda: (self.expression(), self.expect(":"), self.expression()), "}")
            return Node("call", "map", tuple(x for a, _, b in pairs for x in (a, b)))
        if self.accept("@"):
            name = self.name()
            return Node("macro", name, tuple(self.listed(self.expression))) if self.accept("(") else Node("macro", name, ())
        if kind != "name":
            raise LanguageError(f"unexpected {value!r}")
        if word in ("true", "false", "null"):
            self.take()
            return Node("lit", {"true": True, "false": False, "null": None}[word])
        if word == "case":
            return self.case()
        if word == "filter" and self.tokens[self.at + 1][0] == "name" and self.peek(2) == "where":
            self.take()
            x = Node("ref", self.name())
            self.expect("where")
            return Node("filter", None, (x, self.expression()))
        if word == "group" and self.tokens[self.at + 1][0] == "name" and self.peek(2) == "by":
            self.take()
            x = Node("ref", self.name())
            self.expect("by")
            return Node("agg", "any", (x,), (tuple(self.names_or_list()),))
        if word in ("rank", "lag", "lead", "row_number", "dense_rank") and self.peek(1) != "(":
            return self.old_window()
        self.take()
        if not self.accept("("):
            if word in ("date", "datetime", "timestamp") and self.tokens[self.at][0] == "str":
                return Node("cast", word, (Node("lit", self.string(self.take())),))
            return Node("ref", value)
        return self.call(word)

    @staticmethod
    def string(value: str) -> str:
        if value[:3] in ("'''", '"""'):
            return value[3:-3]
        return re.sub(r"\\(['\"\\])", r"\1", value[1:-1])

    def case(self) -> Node:
        self.expect("case")
        of = None if self.peek() == "when" else self.expression()
        whens, other = [], None
        while self.accept("when"):
            cond = self.expression()
            self.expect("then")
            whens.append((cond if of is None else Node("call", "=", (of, cond)), self.expression()))
        if self.accept("else"):
            other = self.expression()
        self.expect("end")
        return Node("case", None, tuple(whens), () if other is None else (other,))

    def call(self, name: str) -> Node:
        if name == "cast":
            x = self.expression()
            self.expect("as")
            out = Node("cast", self.type(declared=False), (x,))
            self.expect(")")
            return out
        if name == "struct":
            items = self.listed(lambda: (self.expression(), self.accept("->") or self.accept("as"), self.name()))
            return Node("struct", tuple(n for _, _, n in items), tuple(x for x, _, _ in items))
        if name == "subselect":
            x = self.expression()
            cond = self.expression() if self.accept("where") else None
            order = self.order() if self.accept("order", "by") else []
            limit = int(self.take()) if self.accept("limit") else None
            self.expect(")")
            return Node("subselect", limit, (x,), (cond, tuple((e, d, n) for e, d, n in order)))
        distinct = name == "count" and self.accept("distinct")
        args = tuple(self.listed(self.expression if name not in ("date_trunc", "date_part", "date_add", "date_sub", "date_diff", "hash") else self.expression))
        if name in AGGREGATES or distinct:
            name = "count_distinct" if distinct else name
            if self.accept("over"):
                return self.window(name, args)
            return Node("agg", name, args, self.by())
        if name in WINDOWS:
            if self.accept("over"):
                return self.window(name, args)
            return Node("win", name, args, ((), ()))
        if name in ("group",) and self.accept("by"):
            return Node("agg", "any", args, (tuple(self.names_or_list()),))
        return Node("call", name, args)

    def by(self) -> tuple:
        """(): the select's grain; (keys,): pinned."""
        if not self.accept("by"):
            return ()
        if self.accept("*"):
            return ((),)
        return (tuple(self.names_or_list()),)

    def names_or_list(self) -> list[Node]:
        if self.accept("("):
            return self.listed(self.expression)
        out = [Node("ref", self.name())]
        while self.peek() == "," and self.tokens[self.at + 1][0] == "name" and self.peek(2) in (",", ";", ")", "as", "->", "having", "order", "limit", "<end>", "*", "/", "+", "-"):
            self.take()
            out.append(Node("ref", self.name()))
        return out

    def window(self, name: str, args: tuple) -> Node:
        self.expect("(")
        part = []
        if self.accept("partition", "by"):
            part = [self.expression()]
            while self.accept(","):
                part.append(self.expression())
        order = self.order() if self.accept("order", "by") else []
        self.expect(")")
        if not order and name in AGGREGATES:  # an unordered aggregate window is a pinned aggregate
            return Node("agg", name, args, (tuple(part),))
        return Node("win", name, args, (tuple(part), tuple(order)))

    def old_window(self) -> Node:
        name = self.take().lower()
        args = [self.expression_simple()]
        if name in ("lag", "lead") and args[0].kind == "lit":
            args = [self.expression_simple(), args[0]]
        part = [Node("ref", n.name) for n in (self.names_or_list() if self.accept("over") or self.accept("partition", "by") else [])]
        order = self.order() if self.accept("order", "by") or self.accept("by") else []
        return Node("win", name, tuple(args), (tuple(part), tuple(order)))

    def expression_simple(self) -> Node:
        return self.sum()

    def order(self) -> list:
        out = []
        while True:
            x = self.expression()
            desc = self.accept("desc") or (self.accept("asc") and False)
            nulls = "last"
            if self.accept("nulls"):
                nulls = self.take().lower()
            out.append((x, desc, nulls))
            if not self.accept(",") or self.peek() in ("limit", ")", ";", "<end>"):
                return out

    # Selects

    def select(self) -> dict:
        q: dict = {"from": None, "where": [], "joins": [], "items": [], "by": None, "having": None, "order": [], "limit": None}
        while True:
            if self.accept("from"):
                if self.peek() in ("union", "except", "intersect"):
                    q["setop"] = self.setop()
                else:
                    q["from"] = [self.name()]
                    while self.accept(","):
                        q["from"].append(self.name())
            elif self.accept("where"):
                q["where"].append(self.expression())
                while self.accept("then"):
                    self.expect("where")
                    q["where"].append(self.expression())
            elif self.joined(q):
                pass
            else:
                break
        self.expect("select")
        while True:
            hidden = self.peek() == "-" and self.peek(1) == "-"
            if hidden:
                self.at += 2
            self.accept("~")
            x = self.expression()
            alias = self.name() if self.accept("as") or self.accept("->") else None
            q["items"].append((alias or (x.name if x.kind == "ref" else f"col{len(q['items']) + 1}"), x, hidden))
            if not self.accept(",") or self.peek() in ("having", "order", "limit", ";", "merge", "where", ")", "<end>") or self.peek() in ("subset", "union") and self.peek(1) == "join" or self.grouping():
                break
        while True:
            if self.grouping():
                self.take()
                kind = self.take().lower()
                if kind == "grouping":
                    self.expect("sets")
                    self.expect("(")
                    q["by"] = ("sets", self.listed(lambda: (self.expect("("), self.listed(self.expression))[1]))
                else:
                    self.expect("(")
                    q["by"] = (kind, self.listed(self.expression))
            elif self.accept("where"):
                q["where"].append(self.expression())
            elif self.accept("having"):
                q["having"] = self.expression()
            elif self.accept("order", "by"):
                q["order"] = self.order()
            elif self.accept("limit"):
                q["limit"] = int(self.take())
            elif not self.joined(q):
                break
        if self.peek() == "merge" and self.peek(1) in ("select", "where"):
            arms = [q]
            while self.accept("merge"):
                arms.append(self.select_arm())
            return self.aligned(arms)
        return q

    def grouping(self) -> bool:
        return self.peek() == "by" and self.peek(1) in ("rollup", "cube", "grouping")

    def joined(self, q: dict) -> bool:
        """A join clause, which stands before or after the outputs."""
        if self.peek() in ("left", "right", "full", "inner", "cross") and self.peek(1) in ("join", "outer"):
            raise LanguageError(f"{self.peek()} join isn't part of the language: use subset join or union join, and is not null to intersect")
        if self.peek() not in ("subset", "union") or self.peek(1) != "join":
            return False
        kind = self.take().lower()
        self.take()
        while True:
            chain = [self.sum()]
            while self.accept("="):
                chain.append(self.sum())
            q["joins"].append((kind, chain))
            if not self.accept("and"):
                return True

    def select_arm(self) -> dict:
        self.in_arm = True
        return Parser.select(self)

    def aligned(self, arms: list[dict]) -> dict:
        if isinstance(arms[-1], dict) and "arms" in arms[-1]:
            tail = arms.pop()
            tail["arms"] = arms + tail["arms"]
            return tail
        self.expect("align")
        align = []
        while True:
            name = self.name()
            self.expect(":")
            align.append((name, [self.name()]))
            while self.accept(",") and self.tokens[self.at][0] == "name" and self.peek() not in ("and", "derive", "order", "limit", "having", "where"):
                align[-1][1].append(self.name())
            if not self.accept("and"):
                break
        derive = []
        if self.accept("derive"):
            while True:
                x = self.expression()
                if not (self.accept("->") or self.accept("as")):
                    raise LanguageError("derive needs a name")
                derive.append((self.name(), x))
                if not self.accept(","):
                    break
        out = {"arms": arms, "align": align, "derive": derive, "having": None, "order": [], "limit": None}
        while True:
            if self.accept("having") or self.accept("where"):
                out["having"] = self.expression()
            elif self.accept("order", "by"):
                out["order"] = self.order()
            elif self.accept("limit"):
                out["limit"] = int(self.take())
            else:
                return out

    def setop(self) -> dict:
        kind = self.take().lower()
        self.expect("(")
        arms = self.listed(lambda: (self.expect("("), self.select(), self.expect(")"))[1])
        self.expect("->")
        self.expect("(")

        def output():
            name = self.name()
            kind = None
            if self.peek() not in (",", ")"):
                self.accept("key") or self.accept("property")
                kind = self.type()
                self.accept("?")
            self.metadata()
            return name, kind

        return {"op": kind, "arms": arms, "names": self.listed(output)}

    # Statements

    def statements(self) -> list[Statement]:
        out = []
        while self.peek() != "<end>":
            if self.accept(";"):
                continue
            first = self.at
            out.append(self.statement())
            self.begins.append(first)
            if self.peek() != "<end>":
                self.expect(";")
        return out

    def statement(self) -> Statement:
        word, after = self.peek(), self.peek(1)
        if word == "import":
            self.take()
            path = self.model_path()
            return Statement("import", {"path": path, "alias": self.name() if self.accept("as") else None})
        if word == "self" and after == "import":
            self.expect("self", "import", "as")
            return Statement("self_import", {"alias": self.name()})
        if word == "from" and self.is_import():
            self.take()
            path = self.model_path()
            alias = self.name() if self.accept("as") else None
            self.expect("import")
            names = [self.name()]
            while self.accept(",") and self.tokens[self.at][0] == "name":
                names.append(self.name())
            return Statement("import", {"path": path, "alias": alias, "names": names})
        if word in ("parameter", "param"):
            self.take()
            name, kind = self.name(), self.type()
            self.accept("?")
            return Statement("parameter", {"name": name, "type": kind, "default": self.expression() if self.accept("default") else None})
        if word == "-" and after == "-":  # a hidden concept is one like any other to the planner
            self.at += 2
            return self.statement()
        if word == "properties":
            self.take()
            keys = self.listed(self.name, ">") if self.accept("<") else [self.name()]
            self.expect("(")
            items = self.listed(lambda: (self.accept("-", "-"), self.name(), self.type(), self.accept("?"))[1:3])
            return Statement("properties", {"keys": keys, "items": items})
        if word == "call" and self.tokens[self.at + 1][0] in ("str", "path"):
            self.take()
            program = self.take().strip("`'\"")
            return Statement("call", {"program": program, "select": self.select() if self.accept("from") else None})
        if word == "mock":
            self.take()
            what = self.take().lower()
            names = []
            while self.tokens[self.at][0] == "name":
                names.append(self.name())
                self.accept(",")
            return Statement("mock", {"names": names if what == "datasources" else []})
        if word in PURPOSES:
            return self.concept()
        if word == "type":
            self.take()
            name, bases, drop = self.name(), [self.type()], []
            while self.accept("|"):
                bases.append(self.type())
            if self.accept("drop"):
                drop = [self.name()]
                while self.accept("|"):
                    drop.append(self.name())
            return Statement("type", {"name": name, "base": bases[0], "others": bases[1:], "drop": drop})
        if word == "def":
            self.take()
            table = self.accept("table")
            name = self.name()

            def parameter():
                p = self.name()
                if self.accept(":"):
                    self.type()
                return p, self.expression() if self.accept("=") else None

            params = self.listed(parameter) if self.accept("(") else []
            self.expect("->")
            if table:
                self.expect("select")
                x = self.expression()
                cond = self.expression() if self.accept("where") else None
                order = self.order() if self.accept("order", "by") else []
                limit = int(self.take()) if self.accept("limit") else None
                return Statement("def", {"name": name, "params": params, "body": Node("subselect", limit, (x,), (cond, tuple(order)))})
            return Statement("def", {"name": name, "params": params, "body": self.expression()})
        if word == "datasource" or word in ("root", "partial", "~") and "datasource" in (after, self.peek(2)):
            return self.datasource()
        if word == "merge":
            self.take()
            a = self.name()
            if self.accept(".", "*"):
                a += ".*"
            self.expect("into")
            partial = self.accept("~")
            b = self.name()
            if self.accept(".", "*"):
                b += ".*"
            return Statement("merge", {"from": a, "into": b, "partial": partial})
        if word in ("with", "rowset"):
            self.take()
            name = self.name()
            self.accept("as") or self.expect("<-")
            body = {"setop": self.setop()} if self.peek() in ("union", "except", "intersect") and self.peek(1) == "(" else self.select()
            return Statement("rowset", {"name": name, "select": body})
        if word in ("persist", "overwrite", "append"):
            self.take()
            name = self.name() if self.peek() != "into" else None
            if self.peek() in ("where", ";", "<end>"):
                return Statement("rebuild", {"name": name, "where": self.expression() if self.accept("where") else None, "mode": "append" if word == "append" else "overwrite"})
            into = self.name() if self.accept("into") else None
            name = name or into
            keys = [self.name()] if self.accept("by") else []
            while keys and self.accept(","):
                keys.append(self.name())
            self.expect("from")
            return Statement("persist", {"name": name, "into": into, "by": keys, "mode": "append" if word == "append" else "overwrite", "select": self.select()})
        if word == "copy":
            self.take()
            self.expect("into")
            kind = self.take().lower()
            path = self.string(self.take())
            options = {}
            if self.accept("("):
                options = dict(self.listed(lambda: (self.name(), self.expect("="), self.primary().name)[::2]))
            self.expect("from")
            if self.peek() == "chart" and self.peek(1) in ("layer", "place", "set"):
                return Statement("copy", {"format": kind, "path": path, "options": options, "select": {"chart": self.chart()}})
            return Statement("copy", {"format": kind, "path": path, "options": options, "select": self.select()})
        if word == "chart" and after in ("layer", "place", "set"):
            return Statement("chart", self.chart())
        if word == "create":
            self.take()
            mode = "error"
            if self.accept("if", "not", "exists"):
                mode = "ignore"
            elif self.accept("or", "replace"):
                mode = "overwrite"
            self.accept("datasource") or self.expect("datasources")
            return Statement("create", {"name": self.name(), "mode": mode, "data": self.accept("with", "data")})
        if word in ("publish", "unpublish"):
            self.take()
            self.accept("datasource") or self.accept("datasources")
            return Statement("publish", {"name": self.name(), "on": word == "publish"})
        if word == "raw_sql":
            self.take()
            self.expect("(")
            sql = self.string(self.take())
            self.expect(")")
            return Statement("raw_sql", {"sql": sql})
        if word == "show":
            self.take()
            if self.peek() in ("concepts", "datasources"):
                return Statement("show", {"what": self.take().lower()})
            return Statement("show", {"what": "plan", "select": self.select()})
        if word == "validate":
            self.take()
            what = self.take().lower()
            names = []
            while self.tokens[self.at][0] == "name":
                names.append(self.name())
                self.accept(",")
            return Statement("validate", {"what": what, "names": names})
        if word in ("union", "except", "intersect") and after == "(":
            return Statement("select", {"select": {"setop": self.setop()}})
        return Statement("select", {"select": self.select()})

    def chart(self) -> dict:
        """Layers of bindings (role, expression, name), lines at values, switches and scales."""
        self.expect("chart")
        out: dict = {"layers": [], "places": [], "flags": [], "scales": {}}
        while self.peek() in ("layer", "place", "set"):
            what = self.take().lower()
            if what == "layer":
                kind = self.name().lower()
                self.expect("(")
                bindings = self.listed(lambda: (self.name().lower(), self.expect("<-"), self.expression(), self.name() if self.accept("as") else None))
                layer = {"type": kind, "bindings": [(r, x, a) for r, _, x, a in bindings], "select": None, "order": [], "limit": None}
                if self.accept("from"):
                    inside = self.accept("(")
                    layer["select"] = self.select()
                    if inside:
                        self.expect(")")
                if self.accept("order", "by"):
                    layer["order"] = self.order()
                if self.accept("limit"):
                    layer["limit"] = int(self.take())
                out["layers"].append(layer)
            elif what == "place":
                kind = self.name().lower()
                self.expect("at")
                out["places"].append((kind, self.literal(), self.name() if self.accept("as") else None))
            else:
                name = self.name().lower()
                if self.accept(":"):
                    out["scales"][name] = self.name().lower()
                else:
                    out["flags"].append(name)
        if not out["layers"]:
            raise LanguageError("a chart needs a layer")
        return out

    def model_path(self) -> str:
        """A dotted path; leading dots are kept."""
        dots = ""
        while self.accept("."):
            dots += "."
        return dots + self.name()

    def is_import(self) -> bool:
        """Whether a from clause at hand imports names from a model."""
        k = 1
        while self.peek(k) == ".":
            k += 1
        return self.peek(k + 1) == "import" or self.peek(k + 1) == "as" and self.peek(k + 3) == "import"

    def concept(self) -> Statement:
        purpose = self.take().lower().replace("constant", "const")
        if purpose == "unique":
            self.expect("property")
        keys = None
        if self.accept("<"):
            keys = []
            while not self.accept(">"):
                if self.accept("*"):
                    continue
                keys.append(self.name())
                self.accept(",")
            self.expect(".")
        name = self.name()
        if purpose in ("property", "unique") and keys is None and "." in name:
            keys = [None]  # the part before the last dot, if it is a concept
        kind = None
        if self.peek() not in ("<-", ";", "<end>"):
            kind = self.type() if self.peek() != "metadata" else None
            self.accept("?")
        self.metadata()
        lineage = self.expression() if self.accept("<-") else None
        self.metadata()
        return Statement("concept", {"purpose": purpose, "name": name, "keys": keys, "type": kind, "lineage": lineage})

    def metadata(self) -> None:
        """Descriptions of a concept, which say nothing to the planner."""
        if self.peek() == "metadata" and self.peek(1) == "(":
            self.at += 2
            self.listed(lambda: (self.name(), self.expect("="), self.primary()))

    def datasource(self) -> Statement:
        flags = set()
        while self.peek() in ("root", "partial", "~"):
            flags.add(self.take().lower().replace("~", "partial"))
        self.expect("datasource")
        d: dict = {"name": self.name(), "partial": "partial" in flags, "root": "root" in flags, "grain": None, "where": None, "complete": None, "source": None, "incremental": None, "partition": []}
        self.expect("(")

        def binding():
            marks = ""
            while self.peek() in ("~", "?"):  # before a column that is named as its concept
                marks += self.take()
            if self.peek() == "raw":
                self.take()
                self.expect("(")
                column: Any = ("raw", self.string(self.take()))
                self.expect(")")
            else:
                column = self.expression()
            if not self.accept(":"):
                return column, column.name, marks
            while self.peek() in ("~", "?"):
                marks += self.take()
            return column, self.name(), marks

        d["columns"] = self.listed(binding)
        while True:
            if self.accept("grain"):
                self.expect("(")
                d["grain"] = self.listed(self.name)
            elif self.accept("complete", "where"):
                d["complete"] = self.expression()
            elif self.accept("where"):
                d["where"] = self.expression()
            elif self.peek() in ("incremental", "freshness") and self.peek(1) == "by":
                how = self.take().lower()
                self.take()
                d[how] = self.take().strip("`")
                while self.accept(","):
                    self.take()
            elif self.accept("within"):
                n = int(self.take())
                d["within"] = f"{n} {self.name().lower()}" if self.peek().rstrip("s") in ("second", "minute", "hour", "day", "week", "month", "quarter", "year") else f"{n} second"
            elif self.accept("refresh"):
                d["refresh"] = self.take().strip("`'\"")
            elif self.accept("state"):
                d["published"] = self.take().lower() == "published"
            elif self.accept("partition", "by"):
                d["partition"] = [self.name()]
                while self.accept(","):
                    d["partition"].append(self.name())
            elif self.accept("address"):
                kind, value = self.tokens[self.at]
                self.take()
                d["source"] = ("table", value.strip("`'\""))
            elif self.accept("query"):
                d["source"] = ("query", self.string(self.take()))
            elif self.accept("file"):
                if self.accept("["):
                    d["source"] = ("file", self.listed(lambda: self.take().strip("`'\""), "]"))
                else:
                    d["source"] = ("file", [self.take().strip("`'\"")])
                    if self.accept(":"):
                        d["write"] = self.take().strip("`'\"")
            else:
                return Statement("datasource", d)


@dataclass(frozen=True, eq=False)
class Query:
    """A nested select inside an expression."""

    select: dict


@lru_cache(256)
def parse(text: str) -> tuple[Statement, ...]:
    """The statements of a text, kept for texts that come again; callers don't change them."""
    return tuple(Parser(text).statements())


def parse_expression(text: str) -> Node:
    p = Parser(text)
    out = p.expression()
    p.expect("<end>")
    return out
