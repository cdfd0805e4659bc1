"""Code facts: one Arrow pass that parses every file once.

This is the only Python stage of a scan. It holds no rule and no threshold; rules are Catalyst
expressions over the nested columns it returns.
"""

from __future__ import annotations

import ast
import functools
import gc
import hashlib
import random
import re
import typing
import warnings
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTS_DDL = """
n_lines INT, parse_error STRING, error_line INT,
failures ARRAY<STRUCT<part: STRING, error: STRING>>,
functions ARRAY<STRUCT<bfs: BIGINT, name: STRING, lineno: INT, end_lineno: INT,
    params: ARRAY<STRING>, default_kinds: ARRAY<STRING>,
    decisions: ARRAY<STRUCT<kind: STRING, weight: INT>>,
    nesting: ARRAY<STRUCT<depth: INT, lineno: INT>>>>,
bodies ARRAY<STRUCT<bfs: BIGINT, name: STRING, lineno: INT, end_lineno: INT, digest: BINARY>>,
classes ARRAY<STRUCT<bfs: BIGINT, name: STRING, lineno: INT, end_lineno: INT>>,
imports ARRAY<STRUCT<bfs: BIGINT, ord: INT, lineno: INT, form: STRING, module: STRING,
    name: STRING, local: STRING, display: STRING, line_text: STRING>>,
names ARRAY<STRING>,
exported ARRAY<STRING>,
calls ARRAY<STRUCT<bfs: BIGINT, lineno: INT, form: STRING, func: STRING, recv: STRING,
    keywords: ARRAY<STRUCT<name: STRING, const: STRING>>, arg0_kind: STRING, arg0_op: STRING>>,
handlers ARRAY<STRUCT<bfs: BIGINT, lineno: INT, type_kind: STRING, type_name: STRING,
    only_pass: BOOLEAN>>
"""


def _rows_of(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


_I, _L, _S = pa.int32(), pa.int64(), pa.string()
_ARROW = {
    "n_lines": _I,
    "parse_error": _S,
    "error_line": _I,
    "failures": _rows_of(part=_S, error=_S),
    "functions": _rows_of(
        bfs=_L, name=_S, lineno=_I, end_lineno=_I,
        params=pa.list_(_S), default_kinds=pa.list_(_S),
        decisions=_rows_of(kind=_S, weight=_I),
        nesting=_rows_of(depth=_I, lineno=_I),
    ),
    "bodies": _rows_of(bfs=_L, name=_S, lineno=_I, end_lineno=_I, digest=pa.binary()),
    "classes": _rows_of(bfs=_L, name=_S, lineno=_I, end_lineno=_I),
    "imports": _rows_of(
        bfs=_L, ord=_I, lineno=_I, form=_S, module=_S, name=_S, local=_S, display=_S, line_text=_S
    ),
    "names": pa.list_(_S),
    "exported": pa.list_(_S),
    "calls": _rows_of(
        bfs=_L, lineno=_I, form=_S, func=_S, recv=_S,
        keywords=_rows_of(name=_S, const=_S), arg0_kind=_S, arg0_op=_S,
    ),
    "handlers": _rows_of(bfs=_L, lineno=_I, type_kind=_S, type_name=_S, only_pass=pa.bool_()),
}

_NESTING = {ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith}
# Nodes without content of their own, spelled out in the line of their parent.
_PLAIN_GROUPS = (ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.expr_context)
_PLAIN = {kind for group in _PLAIN_GROUPS for kind in group.__subclasses__()}
_WEIGHT = {
    ast.If: lambda n: 1,
    ast.For: lambda n: 1,
    ast.AsyncFor: lambda n: 1,
    ast.While: lambda n: 1,
    ast.ExceptHandler: lambda n: 1,
    ast.BoolOp: lambda n: len(n.values) - 1,
    ast.comprehension: lambda n: len(n.ifs),
    ast.Match: lambda n: len(n.cases),
}

_BRANCHING = _NESTING | _WEIGHT.keys()


def _kind(node: ast.AST | None) -> str | None:
    return None if node is None else type(node).__name__


def _text(value: str) -> str:
    """A string literal may hold lone surrogates, which UTF-8 columns cannot."""
    return value.encode("utf-8", "backslashreplace").decode("utf-8")


def _atom(value) -> str:
    try:
        return repr(value)
    except ValueError:  # an integer too long for decimal digits
        return hex(value)


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8")).digest()


def _node_fields(kind: type[ast.AST]) -> tuple[str, ...]:
    """The fields of a kind of node that can hold nodes other than operators and contexts."""
    return tuple(
        field
        for field, types in kind._field_types.items()
        if any(
            isinstance(t, type) and issubclass(t, ast.AST) and t not in _PLAIN_GROUPS
            for t in typing.get_args(types) or (types,)
        )
    )


_NODE_FIELDS = {
    kind: _node_fields(kind)
    for kind in vars(ast).values()
    if isinstance(kind, type) and issubclass(kind, ast.AST) and hasattr(kind, "_field_types")
    and (kind is ast.Constant or not issubclass(kind, ast.Constant))  # its subclasses are old names
}


def _children(node: ast.AST, names: set[str]) -> list[ast.AST]:
    """Child nodes in source order, but for operators, contexts and constants; names go to ``names``."""
    children = []
    for field in _NODE_FIELDS[type(node)]:
        value = getattr(node, field, None)
        for child in value if type(value) is list else (value,):
            kind = type(child)
            if kind is ast.Name:
                names.add(child.id)
            elif kind is not ast.Constant and child is not None:
                children.append(child)
    return children


def _spell(node: ast.AST) -> tuple[list[ast.AST], str]:
    """Child nodes, and the node itself as text: its kind, its plain values, a dot per child."""
    children, line = [], [type(node).__name__]
    for field in node._fields:
        value = getattr(node, field, None)
        if value is None:
            line.append("")
        elif type(value) is list:
            shape = []
            for item in value:
                if type(item) in _PLAIN:
                    shape.append(type(item).__name__)
                elif isinstance(item, ast.AST):
                    children.append(item)
                    shape.append(".")
                else:
                    shape.append(_atom(item))
            line.append(f"[{','.join(shape)}]" if shape else "[]")
        elif type(value) in _PLAIN:
            line.append(type(value).__name__)
        elif not isinstance(value, ast.AST):
            line.append(_atom(value))
        else:
            children.append(value)
            line.append(".")
    return children, ",".join(line)


def _branch(node: ast.AST, depth: int, owners: tuple) -> int:
    """Tell all enclosing functions about a decision or a nesting node; gives the depth below it."""
    kind = type(node)
    if kind in _WEIGHT:
        weight, name = _WEIGHT[kind](node), kind.__name__
        for function, _ in owners:
            function["decisions"][name] = function["decisions"].get(name, 0) + weight
    if kind not in _NESTING:
        return depth
    for function, base in owners:
        seen = function["nesting"]
        if depth + 1 - base > len(seen):  # depth grows by one at most, so this is the first such node
            seen.append({"depth": depth + 1 - base, "lineno": node.lineno})
    return depth + 1


def _has_docstring(node) -> bool:
    head = node.body[0]
    return (
        isinstance(head, ast.Expr)
        and isinstance(head.value, ast.Constant)
        and isinstance(head.value.value, str)
    )


class _FileFacts:
    """Facts of one parsed file, gathered in one depth-first walk with a stack of its own.

    ``bfs`` is (level, place in the walk): it sorts as breadth-first order does. Each node inside
    a function leaves one line that spells out its kind and plain fields, so the lines of a body
    are equal if and only if the bodies are, whatever their layout; only a digest is kept.
    """

    def __init__(self, tree: ast.AST, lines: list[str], parts: frozenset[str], digest: Callable[[str], object]):
        self.lines = lines
        self.digest = digest
        self.wanted = parts
        if "bodies" in parts:
            parts = parts | {"functions"}
        self.collectors = {kind: step for kind, step in self._COLLECTORS.items() if step[0] in parts}
        self.out = {
            part: []
            for part in ("functions", "bodies", "classes", "imports", "exported", "calls", "handlers")
        }
        self.names: set[str] = set()
        self.failures: dict[str, str] = {}
        self._walk(tree)
        for collected in self.out.values():
            collected.sort(key=lambda fact: fact["bfs"])
        self.out["exported"] = [fact["name"] for fact in self.out["exported"]]

    def _guard(self, part: str, step, *args) -> None:
        try:
            step(self, *args)
        except Exception as error:  # one broken fact group must not lose the file
            self.failures.setdefault(part, f"{type(error).__name__}: {error}")

    def _walk(self, tree) -> None:
        collectors = self.collectors
        spell, name = "bodies" in self.wanted, "names" in self.wanted
        by_function = ast.FunctionDef in collectors
        spelled: list[str] = []
        todo = [(tree, 0, 0, ())]
        place = 0
        while todo:
            node, level, depth, owners = todo.pop()
            if node is None:  # the edge of a function body: level is its fact, depth the edge
                level[depth] = len(spelled)
                continue
            kind = type(node)
            if kind is ast.Name:  # the two most frequent nodes, both without children
                if name:
                    self.names.add(node.id)
                if spell and owners:
                    spelled.append(node.id)
                continue
            if kind is ast.Constant:
                if spell and owners:
                    spelled.append(f"={_atom(node.value)}{node.kind or ''}")
                continue
            place += 1
            bfs = level << 32 | place
            collector = collectors.get(kind)
            if collector is not None:
                self._guard(collector[0], collector[1], bfs, node)
            if owners and kind in _BRANCHING:
                depth = _branch(node, depth, owners)
            if spell and owners:
                children, line = _spell(node)
                spelled.append(line)
            else:
                children = _children(node, self.names)
            if not by_function or kind is not ast.FunctionDef and kind is not ast.AsyncFunctionDef:
                if children:
                    todo += [(child, level + 1, depth, owners) for child in reversed(children)]
                continue
            fact = self.out["functions"][-1]
            owners = (*owners, (fact, depth))
            steps = [(child, level + 1, depth, owners) for child in children]
            body = children.index(node.body[0])
            steps.insert(body + len(node.body), (None, fact, "end", None))
            steps.insert(body + _has_docstring(node), (None, fact, "start", None))
            todo += reversed(steps)
        for fact in self.out["functions"]:
            text = "\n".join(spelled[fact.pop("start"):fact.pop("end")])
            if text:
                body = {key: fact[key] for key in ("bfs", "name", "lineno", "end_lineno")}
                body["digest"] = self.digest(text)
                self.out["bodies"].append(body)
            fact["decisions"] = [{"kind": k, "weight": w} for k, w in fact["decisions"].items()]

    def _function(self, bfs, node) -> None:
        args = node.args
        self.out["functions"].append({
            "bfs": bfs,
            "name": node.name,
            "lineno": node.lineno,
            "end_lineno": node.end_lineno,
            "params": [a.arg for group in (args.posonlyargs, args.args, args.kwonlyargs) for a in group],
            "default_kinds": [_kind(d) for group in (args.defaults, args.kw_defaults) for d in group],
            "decisions": {},
            "nesting": [],
        })

    def _class(self, bfs, node) -> None:
        self.out["classes"].append(
            {"bfs": bfs, "name": node.name, "lineno": node.lineno, "end_lineno": node.end_lineno}
        )

    def _import(self, bfs, node) -> None:
        plain = isinstance(node, ast.Import)
        line = self.lines[node.lineno - 1] if node.lineno <= len(self.lines) else ""
        for position, alias in enumerate(node.names):
            bound = alias.name.split(".")[0] if plain else alias.name
            self.out["imports"].append({
                "bfs": bfs,
                "ord": position,
                "lineno": node.lineno,
                "form": "import" if plain else "from",
                "module": None if plain else node.module,
                "name": alias.name,
                "local": alias.asname or bound,
                "display": alias.asname or alias.name,
                "line_text": line,
            })

    def _assign(self, bfs, node) -> None:
        if not isinstance(node.value, (ast.List, ast.Tuple)):
            return
        if any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
            for item in node.value.elts:
                if isinstance(item, ast.Constant) and isinstance(item.value, str):
                    self.out["exported"].append({"bfs": bfs, "name": _text(item.value)})

    def _call(self, bfs, node) -> None:
        func, recv, form = node.func, None, "other"
        name = None
        if isinstance(func, ast.Name):
            form, name = "name", func.id
        elif isinstance(func, ast.Attribute):
            form, name = "attribute", func.attr
            recv = func.value.id if isinstance(func.value, ast.Name) else None
        arg0 = node.args[0] if node.args else None
        self.out["calls"].append({
            "bfs": bfs,
            "lineno": node.lineno,
            "form": form,
            "func": name,
            "recv": recv,
            "keywords": [
                {
                    "name": k.arg,
                    "const": _text(_atom(k.value.value)) if _told(k) else None,
                }
                for k in node.keywords
            ],
            "arg0_kind": _kind(arg0),
            "arg0_op": _kind(getattr(arg0, "op", None)),
        })

    def _handler(self, bfs, node) -> None:
        self.out["handlers"].append({
            "bfs": bfs,
            "lineno": node.lineno,
            "type_kind": _kind(node.type),
            "type_name": node.type.id if isinstance(node.type, ast.Name) else None,
            "only_pass": len(node.body) == 1 and isinstance(node.body[0], ast.Pass),
        })

    _COLLECTORS = {
        ast.FunctionDef: ("functions", _function),
        ast.AsyncFunctionDef: ("functions", _function),
        ast.ClassDef: ("classes", _class),
        ast.Import: ("imports", _import),
        ast.ImportFrom: ("imports", _import),
        ast.Assign: ("exported", _assign),
        ast.Call: ("calls", _call),
        ast.ExceptHandler: ("handlers", _handler),
    }


#: Keywords of calls whose constant values rules read; no other value is kept, as it may be a secret.
TOLD_KEYWORDS = frozenset({"shell"})


def _told(keyword: ast.keyword) -> bool:
    return keyword.arg in TOLD_KEYWORDS and isinstance(keyword.value, ast.Constant)


_TREE_PARTS = ("functions", "bodies", "classes", "imports", "names", "exported", "calls", "handlers")


def file_facts(content: str | None, parts: frozenset[str] = frozenset(_TREE_PARTS)) -> dict:
    """Facts of one file as a plain row; every failure is data, none is raised. Only ``parts`` are gathered."""
    return _row_of(content, parts, _digest)


def _row_of(content: str | None, parts: frozenset[str], digest: Callable[[str], object]) -> dict:
    row = {column: [] for column in _ARROW}
    row.update(n_lines=None, parse_error=None, error_line=None)
    if content is None:
        return row
    lines = content.splitlines()
    row["n_lines"] = len(lines)
    try:
        tree = ast.parse(content)
    except SyntaxError as error:
        row["parse_error"] = _text(f"Cannot be parsed: {error.msg}, line {error.lineno}")
        row["error_line"] = error.lineno
        return row
    except Exception as error:  # recursion or memory limits of the parser
        row["parse_error"] = f"{type(error).__name__}: {_text(str(error))}"
        return row
    try:
        facts = _FileFacts(tree, lines, parts, digest)
    except Exception as error:
        text = f"{type(error).__name__}: {_text(str(error))}"
        row["failures"] = [{"part": part, "error": text} for part in _TREE_PARTS if part in parts]
        return row
    row.update(facts.out)
    row["names"] = sorted(facts.names)
    row["failures"] = [{"part": part, "error": _text(e)} for part, e in facts.failures.items()]
    for part in facts.failures:
        row[part] = []
    return row


#: Short texts that stand in many files, as empty packages and copied stubs do, are parsed once while a task
#: remembers them. Of other texts, up to LONG bytes, the shape is remembered when it comes for the third time.
#: So many bytes in all are remembered; what was not met for the longest time is forgotten first.
SHORT, LONG, REMEMBERED = 1000, 1 << 13, 1 << 20
#: So many files, and bytes of files up to LONG, are looked at in one piece.
PIECE_ROWS, PIECE_BYTES = 4096, 1 << 22

# What stands for the numbers of a shape while it is parsed: drawn at random, so that no text can hold it.
_MARK = str(random.SystemRandom().randrange(10**15, 10**16))
_HOLE = re.compile(_MARK + "([0-9]{4})")
# Bytes that make a number next to them part of a name, of another number or, before it, of an escape.
_JOINED = np.array([byte > 127 or chr(byte).isalnum() or chr(byte) in "_." for byte in range(256)])
_JOINED_BEFORE = _JOINED | (np.arange(256) == ord("\\"))
# What a wide shape leaves open: a quoted word, the digits at the end of a name, and a plain whole number.
_OPEN = re.compile(
    rb"""(?<=")[A-Za-z0-9_.-]+(?=")|(?<=')[A-Za-z0-9_.-]+(?=')"""
    rb"""|(?<![\\.0-9A-Za-z_\x80-\xff])(?:"""
    rb"""[A-Za-z_](?:[A-Za-z0-9_]*[A-Za-z_])?([0-9]+)(?![0-9A-Za-z_\x80-\xff])"""
    rb"""|(?:0|[1-9][0-9]{0,17})(?![.0-9A-Za-z_\x80-\xff]))"""
)


_Cut = tuple[list[bytes], list[int]]


def _cut(text: str) -> _Cut:
    """A spelling around what is open in a shape, and the places of this in the file."""
    pieces = _HOLE.split(text)
    return [piece.encode() for piece in pieces[::2]], [int(place) for place in pieces[1::2]]


def _marked(shape: bytes) -> str:
    """A shape with a mark for each zero byte."""
    pieces = shape.decode().split("\0")
    return "".join([pieces[0], *(f"{_MARK}{place:04d}{piece}" for place, piece in enumerate(pieces[1:]))])


class _Shapes:
    """The shapes of some texts without zero bytes: each plain whole number, as ``repr`` writes it, is one zero byte."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        joined = np.frombuffer(b"\0".join([b"", *texts, b""]), dtype=np.uint8)
        digits = joined - np.uint8(48) < 10
        edges = np.flatnonzero(digits[1:] != digits[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        plain = ~_JOINED_BEFORE[joined[starts - 1]] & ~_JOINED[joined[ends]] & (ends - starts <= 18)
        plain &= (joined[starts] != 48) | (ends - starts == 1)
        starts, ends = starts[plain], ends[plain]
        edge = np.zeros(len(joined), dtype=np.int8)
        edge[starts + 1], edge[ends] = 1, -1
        edge[ends[ends == starts + 1]] = 0
        kept = np.cumsum(edge, dtype=np.int8) == 0  # the first digit of a number stays, as its zero byte
        shaped = joined.copy()
        shaped[starts] = 0
        self.shaped = shaped[kept].tobytes()
        at = np.cumsum([1, *(len(text) + 1 for text in texts)])
        self.at = (np.cumsum(kept)[at - 1]).tolist()
        self.first = np.searchsorted(starts, at).tolist()
        lengths = np.repeat(at[:-1], np.diff(self.first))
        self.starts, self.ends = (starts - lengths).tolist(), (ends - lengths).tolist()

    def shape(self, file: int) -> bytes:
        return self.shaped[self.at[file] : self.at[file + 1] - 1]

    def marked(self, file: int) -> str:
        """The text with a mark for each number."""
        return _marked(self.shape(file))

    def filled(self, file: int, cut: _Cut) -> bytes:
        """A spelling with the numbers of this file."""
        text, first, (texts, places) = self.texts[file], self.first[file], cut
        pieces = [b""] * (len(texts) + len(places))
        pieces[::2] = texts
        pieces[1::2] = [text[self.starts[first + place] : self.ends[first + place]] for place in places]
        return b"".join(pieces)


class _WideShape:
    """The shape of one text without zero bytes in which quoted words and the digits that end a name are open as well.

    A quoted word is made of ASCII letters, digits and ``_.-``. Where it is the inside of a string or part of a
    comment, any other does as well; between two strings its mark, a number, cannot be parsed. Names that end in
    digits are no keywords, whatever these digits. What stands around an open place tells its kind, so equal
    shapes have the same kinds at the same places.
    """

    def __init__(self, text: bytes):
        spans = [found.span(found.lastindex or 0) for found in _OPEN.finditer(text)]
        self.own = [text[start:end] for start, end in spans]
        edges = [0, *(edge for span in spans for edge in span), len(text)]
        self.pieces = [text[start:end] for start, end in zip(edges[::2], edges[1::2])]
        self.shape = b"\0".join(self.pieces)

    def marked(self) -> str:
        return _marked(self.shape)

    def filled(self, cut: _Cut) -> bytes:
        texts, places = cut
        pieces = [b""] * (len(texts) + len(places))
        pieces[::2] = texts
        pieces[1::2] = [self.own[place] for place in places]
        return b"".join(pieces)


class _Own(typing.NamedTuple):
    """What files of one shape do not share: names of functions, names and digests of bodies."""

    functions: list[str]
    bodies: list[str]
    digests: list[bytes]


class _KnownShapes:
    """Facts of files, where those that differ in plain whole numbers only are parsed once.

    Such numbers may stand anywhere, in strings and comments too: none changes what the parser makes of the rest.
    Of the facts they reach the digests of bodies, which are made anew for each file. A shape in which they
    reach more, as the line of an import, or that does not parse, has no row; its files are parsed one by one.
    A file whose shape is not known yet may have a wide shape that is. What is open there may reach the names of
    functions as well.
    """

    def __init__(self, parts: frozenset[str]):
        self.parts = parts
        self.rows: OrderedDict[bytes, dict | int | None] = OrderedDict()
        self.size = 0

    def facts(self, text: str | None) -> dict:
        row, own = next(self.found([None if text is None else text.encode()]))
        functions = [{**fact, "name": name} for fact, name in zip(row["functions"], own.functions)]
        bodies = [
            {**body, "name": name, "digest": digest} for body, name, digest in zip(row["bodies"], own.bodies, own.digests)
        ]
        return {**row, "functions": functions, "bodies": bodies}

    def found(self, texts: list[bytes | None]) -> Iterator[tuple[dict, _Own]]:
        """For each text a row, one object for all texts of a known shape, and what is its own."""
        shaped = [text is not None and len(text) <= LONG and b"\0" not in text for text in texts]
        shapes = _Shapes([text for text, short in zip(texts, shaped) if short])
        file = -1
        for text, short in zip(texts, shaped):
            file += short
            row = self._known(shapes, file) if short else None
            if row is not None:
                yield row, self._own(row, functools.partial(shapes.filled, file))
                continue
            wide = _WideShape(text) if short else None
            row = self._known_wide(wide) if short else None
            if row is not None:
                yield row, self._own(row, wide.filled)
                continue
            row = file_facts(None if text is None else text.decode(), self.parts)
            if short and len(text) <= SHORT and shapes.first[file] == shapes.first[file + 1]:
                self._remember(text, row)  # without numbers the text is its own shape
            yield row, self._own(row, None)

    @staticmethod
    def _own(row: dict, filled: Callable[[_Cut], bytes] | None) -> _Own:
        if not row["functions"] and not row["bodies"]:
            return _NOTHING
        digests = [
            cut if type(cut) is bytes else hashlib.sha256(filled(cut)).digest()
            for cut in [body["digest"] for body in row["bodies"]]
        ]
        functions, bodies = (
            [name if type(name) is str else filled(name).decode() for name in [fact["name"] for fact in row[part]]]
            for part in ("functions", "bodies")
        )
        return _Own(functions, bodies, digests)

    def _known(self, shapes: _Shapes, file: int) -> dict | None:
        shape = shapes.shape(file)
        row = self.rows.get(shape, 0)
        if type(row) is int:  # met so often before
            if row < 2:
                self._remember(shape, row + 1)
                return None
            row = self._parsed(shapes.marked(file))
        self._remember(shape, row)
        return row

    def _known_wide(self, wide: _WideShape) -> dict | None:
        if not wide.own:
            return None
        shape = b"\0\0" + wide.shape  # no other shape begins so, as two numbers never touch
        row = self.rows.get(shape, 0)
        if type(row) is int:
            if row < 2:
                self._remember(shape, row + 1)
                return None
            row = self._parsed(wide.marked(), names=True)
        self._remember(shape, row)
        return row

    def _parsed(self, marked: str, names: bool = False) -> dict | None:
        row = _row_of(marked, self.parts, _cut)
        if row["parse_error"] is not None or row["failures"]:
            return None
        if names:
            for fact in [*row["functions"], *row["bodies"]]:
                if _MARK in fact["name"]:
                    fact["name"] = _cut(fact["name"])
        told = [row[part] for part in _TREE_PARTS if part != "bodies"]
        return None if _MARK in repr(told) else row

    def _remember(self, shape: bytes, row: dict | int | None) -> None:
        if shape not in self.rows:
            self.size += len(shape)
        self.rows[shape] = row
        self.rows.move_to_end(shape)
        while self.size > REMEMBERED and len(self.rows) > 1:
            self.size -= len(self.rows.popitem(last=False)[0])


_NOTHING = _Own([], [], [])


def _column(name: str, kind: pa.DataType, rows: list[dict], places: pa.Array, own: dict[str, list]) -> pa.Array:
    """A column of facts: each of ``rows`` is made once and taken as often as ``places`` names it; ``own`` is not shared."""
    if not own:
        return pa.array([row[name] for row in rows], type=kind).take(places)
    fields = list(kind.value_type)
    bare = pa.list_(pa.struct([field for field in fields if field.name not in own]))
    taken = pa.array([row[name] for row in rows], type=bare).take(places)
    flat = taken.flatten()
    columns = [
        pa.array(own[field.name], field.type) if field.name in own else flat.field(field.name) for field in fields
    ]
    return pa.ListArray.from_arrays(taken.offsets, pa.StructArray.from_arrays(columns, fields=fields))


def _pieces(lengths: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows, of PIECE_ROWS and about PIECE_BYTES at most."""
    start = size = 0
    for row, length in enumerate(lengths):
        size += length if length <= LONG else 0
        if row + 1 - start == PIECE_ROWS or size >= PIECE_BYTES:
            yield start, row + 1
            start, size = row + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def _extract(rows_per_batch: int, parts: frozenset[str], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with at most ``rows_per_batch`` different rows of facts each; files of one shape share theirs."""
    warnings.simplefilter("ignore")  # invalid escapes in scanned code are not our warnings
    gc.disable()  # syntax trees hold no cycles
    gathered = {c: t for c, t in _ARROW.items() if c in parts or c not in _TREE_PARTS}
    known = _KnownShapes(parts)
    try:
        for batch in batches:
            kept = [name for name in batch.schema.names if name != "content"]
            content = batch.column("content").cast(pa.large_binary())
            lengths = pc.fill_null(pc.binary_length(content), 0).to_pylist()
            for low, high in _pieces(lengths):
                rows, numbers, places, own, start = [], {}, [], _Own([], [], []), low
                found = known.found(content.slice(low, high - low).to_pylist())
                for at, (row, told) in enumerate(found, low + 1):
                    places.append(numbers.setdefault(id(row), len(rows)))
                    if places[-1] == len(rows):
                        rows.append(row)
                    if told is not _NOTHING:
                        for all_files, one in zip(own, told):
                            all_files += one
                    if len(rows) == rows_per_batch or at == high:
                        arrays = [batch.column(name).slice(start, at - start) for name in kept]
                        taken = pa.array(places)
                        apart = {
                            "functions": {"name": own.functions},
                            "bodies": {"name": own.bodies, "digest": own.digests},
                        }
                        arrays += [_column(c, t, rows, taken, apart.get(c, {})) for c, t in gathered.items()]
                        yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *gathered])
                        rows, numbers, places, own, start = [], {}, [], _Own([], [], []), at
    finally:
        gc.enable()


def extract_facts(
    files: DataFrame, partitions: int | None = None, rows_per_batch: int = 256, parts: Iterable[str] | None = None
) -> DataFrame:
    """``files`` (project, path, content, …) to one row of facts per file.

    Parsing keeps the partitions of ``files``, so no text is shuffled. Give ``partitions`` only
    where the table has too few of them to keep the cores busy.

    All other columns pass through; ``content`` is dropped, so text never crosses back from
    Python. A null content (unreadable file) gives a row without facts. With ``parts`` only those
    columns of the tree are gathered and returned.
    """
    wanted = frozenset(_TREE_PARTS if parts is None else parts)
    kept = [f for f in files.schema.fields if f.name != "content"]
    found = T._parse_datatype_string(FACTS_DDL).fields
    schema = T.StructType([*kept, *(f for f in found if f.name in wanted or f.name not in _TREE_PARTS)])
    if partitions is not None:
        files = files.repartition(partitions, "project", "path")
    return files.mapInArrow(lambda batches: _extract(rows_per_batch, wanted, batches), schema)


def functions(facts: DataFrame) -> DataFrame:
    """One row per function or method, with its length in lines."""
    return facts.select("project", "path", F.inline("functions")).withColumn(
        "n_lines", F.col("end_lineno") - F.col("lineno") + 1
    )


def bodies(facts: DataFrame) -> DataFrame:
    """One row per function body that is not empty, as digest and place.

    A column of its own next to ``functions``: rules over files never read the digests, and the
    search for copies reads nothing else.
    """
    return facts.select("project", "path", F.inline("bodies")).withColumn(
        "n_lines", F.col("end_lineno") - F.col("lineno") + 1
    )


def classes(facts: DataFrame) -> DataFrame:
    return facts.select("project", "path", F.inline("classes")).withColumn(
        "n_lines", F.col("end_lineno") - F.col("lineno") + 1
    )


def imports(facts: DataFrame) -> DataFrame:
    return facts.select("project", "path", F.inline("imports"))


def calls(facts: DataFrame) -> DataFrame:
    return facts.select("project", "path", F.inline("calls"))


def handlers(facts: DataFrame) -> DataFrame:
    return facts.select("project", "path", F.inline("handlers"))


def names(facts: DataFrame) -> DataFrame:
    return facts.select("project", "path", F.explode("names").alias("name"))


def exported(facts: DataFrame) -> DataFrame:
    return facts.select("project", "path", F.explode(F.array_distinct("exported")).alias("name"))


def binding_imports(array):
    """The elements of an imports array that bind a name: no ``*`` and no ``__future__``."""
    return F.filter(
        array,
        lambda b: (b["name"] != "*") & (F.coalesce(b["module"], F.lit("")) != "__future__")
        | (b["form"] == "import"),
    )


def resolved(array: Column, names: Column | None = None) -> Column:
    """The names that an imports array binds: place of the first binding, line and wording of the last one.

    All of them, or those of ``names`` in its order. Rules and tables of bindings both read this.
    """
    bound = binding_imports(array)
    names = F.array_distinct(F.transform(bound, lambda b: b["local"])) if names is None else names

    # The imports of a name are a field first: spelled out in each of the five fields they would be sought five times.
    own = F.transform(
        names, lambda name: F.struct(name.alias("local"), F.filter(bound, lambda b: b["local"] == name).alias("own"))
    )

    def ends(name):
        first, last = F.get(name["own"], F.lit(0)), F.element_at(name["own"], -1)
        fields = {"lineno": last, "display": last, "line_text": last, "bfs": first, "ord": first}
        return F.struct(name["local"].alias("local"), *(end[field].alias(field) for field, end in fields.items()))

    return F.transform(own, ends)


def has_mark(line_text: Column, marks: Sequence[str]) -> Column:
    """Whether a line carries one of the marks that suppress a rule."""
    return F.exists(F.array(*[F.lit(m) for m in marks]).cast("array<string>"), line_text.contains)


def imported_from(array: Column, name: Column) -> Column:
    """The module from which the last from-import of an imports array takes ``name``, or null."""
    named = F.filter(
        array, lambda b: (b["form"] == "from") & b["module"].isNotNull() & (b["local"] == name)
    )
    return F.get(F.reverse(named), F.lit(0))["module"]


def bindings(facts: DataFrame) -> DataFrame:
    """Imported names per file: last line and display text, position of the first binding."""
    return facts.select("project", "path", F.inline(resolved(F.col("imports"))))


def suppressions(facts: DataFrame, marks: Sequence[str]) -> DataFrame:
    """Lines of imports that carry a mark, one row for each mark on a line."""
    found = imports(facts).select("project", "path", "lineno", "line_text").distinct()
    marked = found.withColumn("mark", F.explode(F.array(*[F.lit(m) for m in marks])))
    return marked.filter(F.contains("line_text", "mark")).select("project", "path", "lineno", "mark")


def import_sources(facts: DataFrame) -> DataFrame:
    """Local name to module for from-imports; the last import of a name decides."""
    named = F.filter("imports", lambda b: (b["form"] == "from") & b["module"].isNotNull())
    names = F.array_distinct(F.transform(named, lambda b: b["local"]))
    pairs = F.transform(
        names, lambda name: F.struct(name.alias("local"), imported_from(F.col("imports"), name).alias("module"))
    )
    return facts.select("project", "path", F.inline(pairs))


def parse_errors(facts: DataFrame) -> DataFrame:
    """Files that could not be read or parsed."""
    read_error = F.col("read_error") if "read_error" in facts.columns else F.lit(None).cast("string")
    error = F.coalesce(read_error, F.col("parse_error"))
    return facts.filter(error.isNotNull()).select(
        "project", "path", error.alias("error"), F.col("error_line").alias("line")
    )
