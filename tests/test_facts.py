"""The extractor on its own: plain Python, no session, against the standard library."""

import ast
import re
import pathlib
from collections import defaultdict

import pyarrow as pa
import pytest

from quarrylint.functions import facts
from quarrylint.functions.facts import file_facts

SOURCES = sorted(pathlib.Path(ast.__file__).parent.glob("*.py"))[:60]


@pytest.fixture(scope="module")
def parsed():
    texts = [path.read_text(encoding="utf-8") for path in SOURCES]
    return [(ast.parse(text), text, file_facts(text)) for text in texts]


def functions_of(tree):
    return [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]


def test_functions_in_breadth_first_order(parsed):
    for tree, _, facts in parsed:
        assert [(n.name, n.lineno, n.end_lineno) for n in functions_of(tree)] == [
            (f["name"], f["lineno"], f["end_lineno"]) for f in facts["functions"]
        ]
        assert not facts["failures"]


def test_calls_names_and_lines(parsed):
    for tree, text, facts in parsed:
        assert [n.lineno for n in ast.walk(tree) if isinstance(n, ast.Call)] == [c["lineno"] for c in facts["calls"]]
        assert {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} == set(facts["names"])
        assert facts["n_lines"] == len(text.splitlines())


def test_digests_are_equal_exactly_if_bodies_are(parsed):
    digests, dumps = defaultdict(set), defaultdict(set)
    for tree, _, facts in parsed:
        by_place = {(b["name"], b["lineno"]): b["digest"] for b in facts["bodies"]}
        for node in functions_of(tree):
            body = node.body[1:] if ast.get_docstring(node, clean=False) is not None else node.body
            digest = by_place.get((node.name, node.lineno))
            assert (digest is None) == (not body)
            if body:
                dump = "\n".join(map(ast.dump, body))
                digests[dump].add(digest)
                dumps[digest].add(dump)
    assert len(dumps) > 1000
    assert all(len(group) == 1 for group in (*digests.values(), *dumps.values()))


@pytest.mark.parametrize("one,other", [
    ("if a:\n  b\nelse:\n  c", "if a:\n  b\nc"),
    ("f(a, b)", "f(a)\nb"),
    ("x = '1'", "x = 1"),
    ("x = b'1'", "x = '1'"),
    ("x = u'1'", "x = '1'"),
    ("global a, b", "global a\nglobal b"),
    ("pass\nx", "x\npass"),
    ("f(**a)", "f(*a)"),
    ("{**a}", "{a}"),
    ("a < b > c", "a > b < c"),
    ("x: int", "x: int = 1"),
    ("del a", "a"),
    ("a if b else c", "b if a else c"),
])
def test_different_bodies_have_different_digests(one, other):
    def digest(text):
        return file_facts("def f():\n" + "".join(f"  {line}\n" for line in text.split("\n")))["bodies"][0]["digest"]

    assert digest(one) != digest(other)


def test_digest_ignores_layout():
    spaced = "def f():\n\n    x = (1 +\n        2)  # note\n    return x\n"
    plain = "@d\ndef g(a, b=1):\n    'doc'\n    x = 1 + 2\n    return x\n"
    assert file_facts(spaced)["bodies"][0]["digest"] == file_facts(plain)["bodies"][0]["digest"]


@pytest.mark.parametrize("text,line", [("def f(:\n", 1), ("x = 1\ny = = 2\n", 2), ("\ufeffx = 1\n", None), ("x\0y", None)])
def test_syntax_errors_are_data(text, line):
    facts = file_facts(text)
    assert facts["parse_error"] and facts["functions"] == []
    if line:
        assert facts["error_line"] == line


def test_deep_code_never_raises():
    assert file_facts("x = " + "-" * 200_000 + "1")["parse_error"]
    long_sum = file_facts("def f():\n    return " + "+".join(["a"] * 3000) + "\n")
    assert long_sum["parse_error"] is None and len(long_sum["bodies"]) == 1
    assert file_facts("x = 0x" + "f" * 10_000 + "\n")["parse_error"] is None
    hexed = file_facts("def f():\n    return 0x" + "f" * 10_000 + "\n")
    assert hexed["bodies"][0]["digest"]


def test_lone_surrogates_stay_utf8():
    facts = file_facts('__all__ = ["\\ud800"]\nf(shell="\\ud800")\n')
    for text in (facts["exported"][0], facts["calls"][0]["keywords"][0]["const"]):
        text.encode("utf-8")


def test_unreadable_file_has_no_facts():
    facts = file_facts(None)
    assert facts["n_lines"] is None and facts["functions"] == []


def test_equal_short_texts_are_parsed_once(monkeypatch):
    texts = ["eval(x)\n", "import a\n"] * 50 + ["x = 1\n" * 400] * 2 + [None]
    parsed = []
    whole = facts.file_facts
    monkeypatch.setattr(facts, "file_facts", lambda text, parts: parsed.append(text) or whole(text, parts))
    batch = pa.RecordBatch.from_pydict({"content": pa.array(texts, pa.string())})
    rows = [row for out in facts._extract(16, frozenset(facts._TREE_PARTS), [batch]) for row in out.to_pylist()]
    assert len(parsed) == 2 + 2 + 1
    wanted = [whole(text) for text in texts]
    assert [(r["n_lines"], r["names"], len(r["calls"])) for r in rows] == [
        (w["n_lines"], w["names"], len(w["calls"])) for w in wanted
    ]


# Digits in every place where they are, or are not, a number of their own; ``{}`` is a number that varies.
DIGITS = [
    "def f(x):\n    a = {}\n    return -{} + x[{}:{}]\n",
    "def f():\n    return '\\1 {} \\{} \\x4{} %{}d', b'{}', f'{{x:{}}} {} {{{}=}}', 0x{}, {}.{}, 1e{}, {}_0, 0{}, {}j\n",
    "def f():\n    'part {}'\n    return a{}, 'a' '{}' \"'{}\", {} .real, {}if x else {}\n",
    "def f():\n    pass  # {}\nimport a  # line {}\n",
    "__all__ = ['a {}', 'b']\ndef f():\n    return run(c, shell={})\n",
    "def f(:\n    return {}\n",
    "def f():\n    return \\\n{}\n\n\fdef g{}(a={}):\n    match a:\n        case {} | -{}: return {}\n",
    "def f():\n    return " + "{} + " * 900 + "1\n",
]


@pytest.mark.parametrize("pattern", DIGITS)
def test_files_that_differ_in_numbers_only_have_their_own_facts(pattern):
    known = facts._KnownShapes(frozenset(facts._TREE_PARTS))
    for number in ["5", "3", "0", "12", "7", "007", "5", "1" * 18, "1" * 19, "9", "1_0", "x", "\u0663"]:
        text = pattern.replace("{{", "\0").replace("{}", number).replace("\0", "{").replace("}}", "}")
        assert known.facts(text) == file_facts(text)


def test_shapes_of_real_code_have_their_own_facts(parsed):
    known = facts._KnownShapes(frozenset(facts._TREE_PARTS))
    for tree, text, _ in parsed:
        lines = text.split("\n")
        for node in tree.body:
            part = "\n".join(lines[node.lineno - 1:node.end_lineno])
            for digits in ("0123456789", "0213456798", "0987654321", "1234567890"):
                varied = part.translate(str.maketrans("0123456789", digits))
                assert known.facts(varied) == file_facts(varied)


def test_files_that_differ_in_numbers_only_are_parsed_three_times(monkeypatch):
    parsed = []
    whole = ast.parse
    monkeypatch.setattr(facts.ast, "parse", lambda text: parsed.append(text) or whole(text))
    known = facts._KnownShapes(frozenset(facts._TREE_PARTS))
    texts = ["def f(x):\n" + "    x += 1\n" * 300 + f"    return {i}\n" for i in range(100)]
    digests = {known.facts(text)["bodies"][0]["digest"] for text in texts}
    assert len(digests) == 100 and len(parsed) == 3


# Words between quotes, inside strings and between them, and digits at the end of names; ``@`` is what varies.
WORDS = [
    "def f_@(x):\n    'part @'\n    a = \"@\"\n    return a, '@', \"it's '@' \", b'@', rb\"@\", u'@', f'@', f'{x}@', f\"{x['@']}\"\n",
    "def f():\n    return ''@'' or \"\"\"@\"\"\" or 'a'@'b' or \"@'\n",
    "def f(x):\n    return 'a'@'b'\n",
    "def f(x):\n    return \"\"@\"\" @ ''\n",
    "x = 'a\\'@'  # '@\n",
    "def f():\n    return '\\N{DIGIT @}', '\\x4@', '\\@', \"\\N{@}\", '\\\"@\"'\n",
    "__all__ = ['@', \"a\"]\nimport a@, b  # '@'\n",
    "import a  # '@'\ndef f(): run(c, shell='@', k=\"@\")\n",
    "class C@:\n    def m@(self, a@): return self.b@ + c@\n    async def n1@(self): 'only @'\n    def m@(self): return '@'\n",
    "def d@():\n    def e@(): return '@'\n    return md@(x), 1@, 1.e@, 0x@, 1_@, 1if x@ else 2, a.b@, x@y, x@\u00e9, \u00e9@\n",
    "def f@(:\n    return '@'\n",
    "def f_@(x):\n    match x:\n        case '@' | {'@': y@}: return f'{x!r:>@}' '@' \"@\"\n",
]


@pytest.mark.parametrize("pattern", WORDS)
def test_files_that_differ_in_words_have_their_own_facts(pattern):
    known = facts._KnownShapes(frozenset(facts._TREE_PARTS))
    words = ["5", "17", "3", "007", "abc", "if", "else", "x1", "md5", "a.b-c_9", "None", "rb", "0x1f", "1_0", "e5", "and",
             "in", "4e00", "", "x y", "\u0663", "LATIN SMALL LETTER A", "12", "5", "abc"]
    for word in [*words, *words]:
        text = pattern.replace("@", word)
        assert known.facts(text) == file_facts(text), text


def test_wide_shapes_of_real_code_have_their_own_facts(parsed):
    known = facts._KnownShapes(frozenset(facts._TREE_PARTS))
    for tree, text, _ in parsed:
        lines = text.split("\n")
        for node in tree.body:
            part = "\n".join(lines[node.lineno - 1:node.end_lineno])
            for i in range(5):
                varied = re.sub(r"(?<=['\"])([\w.-]+)(?=['\"])|\b([A-Za-z_]+)\d+\b", lambda m: f"{m[1] or m[2]}{i}", part)
                assert known.facts(varied) == file_facts(varied)


def test_files_that_differ_in_quoted_words_and_names_are_parsed_three_times(monkeypatch):
    parsed = []
    whole = ast.parse
    monkeypatch.setattr(facts.ast, "parse", lambda text: parsed.append(text) or whole(text))
    texts = [f"def d_{i}(x):\n    'part {i}'\n    a = '{i * 7:x}'\n    return a * {i}\n" for i in range(100)]
    batch = pa.RecordBatch.from_pydict({"content": pa.array(texts, pa.string())})
    rows = [row for out in facts._extract(256, frozenset(facts._TREE_PARTS), [batch]) for row in out.to_pylist()]
    assert [row["functions"][0]["name"] for row in rows] == [row["bodies"][0]["name"] for row in rows]
    assert [row["functions"][0]["name"] for row in rows] == [f"d_{i}" for i in range(100)]
    assert len({row["bodies"][0]["digest"] for row in rows}) == 100 and len(parsed) == 3


def test_a_shape_is_never_taken_for_a_wide_one():
    known = facts._KnownShapes(frozenset(facts._TREE_PARTS))
    for text in ['\nx = "a"\n', '\nx = "b"\n', '\nx = "c"\n', '5\nx = "7"\n', '\nx = "7"\n', '5\nx = "a"\n'] * 4:
        assert known.facts(text) == file_facts(text)


def test_shapes_are_forgotten_beyond_a_fixed_size(monkeypatch):
    monkeypatch.setattr(facts, "REMEMBERED", 1000)
    known = facts._KnownShapes(frozenset(facts._TREE_PARTS))
    for i in range(500):
        text = f"a{i} = {i}\n"
        assert known.facts(text) == file_facts(text)
    assert sum(map(len, known.rows)) == known.size <= 1000


def test_names_and_places_of_every_kind_of_child():
    text = "@d\nclass C(B, metaclass=M):\n    x: int = y\n    z = [a, {**b, 'k': c}][i:j]\n\ndef f() -> r: pass\n"
    found = file_facts(text)
    assert found["names"] == sorted({"d", "B", "M", "x", "int", "y", "z", "a", "b", "c", "i", "j", "r"})
    assert [f["bfs"] for f in found["functions"]] == [1 << 32 | 10]


def test_files_of_one_shape_share_their_facts_in_one_batch():
    shapes = ["def f(x):\n    return {}\n", "import a  # {}\n", "def g():\n    'a {}'\n    return [{}, 0{}, x{}]\n", "x = '\\0' \0{}\n"]
    texts = [shape.format(*[i % 50] * 4) for i in range(1500) for shape in shapes[:1]]
    texts += [None, "", "7", "x = 1\n" * 3000, *(shape.format(*[i] * 4) for i in range(9) for shape in shapes)]
    table = pa.RecordBatch.from_pydict({"path": pa.array(map(str, range(len(texts) + 1))), "content": pa.array(["0", *texts], pa.string())})
    batches = list(facts._extract(256, frozenset(facts._TREE_PARTS), [table.slice(1)]))
    assert len(batches) == 1
    batches[0].validate(full=True)
    rows = batches[0].to_pylist()
    assert [row.pop("path") for row in rows] == [str(i + 1) for i in range(len(texts))]
    wanted = [facts._row_of(text, frozenset(facts._TREE_PARTS), facts._digest) for text in texts]
    assert rows == wanted
    few = list(facts._extract(4, frozenset(facts._TREE_PARTS), [table.slice(1)]))
    assert [row for batch in few for row in batch.drop_columns(["path"]).to_pylist()] == wanted
