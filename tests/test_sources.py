import os
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylint.functions.text import decode, n_lines, split_lines
from quarrylint.plans.scan import scan
from quarrylint.sources import archives, stores, tree


def put(root, path, content=b"x = 1\n"):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content)


@pytest.fixture
def project(tmp_path):
    for path in ("a.py", "pkg/__init__.py", "_t.py", ".hidden.py", ".git/x.py", "venv/y.py", "build/z.py", "N.PY",
                 "notes.txt", "pkg/deep/er/m.py", "pkg/venv.py"):
        put(tmp_path, path)
    put(tmp_path, "bad.py", b"x = '\xff'\r\ny = 1\r")
    os.symlink(tmp_path / "nowhere", tmp_path / "dangling.py")
    os.symlink(tmp_path / "pkg", tmp_path / "linked")
    return tmp_path


KEPT = {"a.py", "pkg/__init__.py", "_t.py", ".hidden.py", "pkg/deep/er/m.py", "pkg/venv.py", "bad.py", "dangling.py"}


def test_tree(spark, project):
    rows = {r.path: r for r in tree.load_tree(spark, str(project), project="p").collect()}
    assert set(rows) == KEPT
    assert rows["bad.py"].content == "x = '\ufffd'\ny = 1\n"
    assert rows["dangling.py"].content is None and rows["dangling.py"].read_error.startswith("Not readable")
    assert rows["a.py"].project == "p"


def test_given_excludes_replace_the_defaults(spark, project):
    paths = {r.path for r in tree.load_tree(spark, str(project), excludes=["pkg"]).collect()}
    assert paths == {"a.py", "_t.py", ".hidden.py", "venv/y.py", "build/z.py", "bad.py", "dangling.py"}
    more = {r.path for r in tree.load_tree(spark, str(project), extra_excludes=["pkg"]).collect()}
    assert more == {"a.py", "_t.py", ".hidden.py", "bad.py", "dangling.py"}


def test_single_file(spark, project):
    assert [r.path for r in tree.load_tree(spark, str(project / "a.py")).collect()] == ["a.py"]
    assert tree.load_tree(spark, str(project / "notes.txt")).count() == 0
    lost = tree.load_tree(spark, str(project / "nothing")).collect()
    assert [(r.content, r.read_error) for r in lost] == [(None, "Not readable: No such file or directory")]


def test_names_that_are_no_utf_8(spark, tmp_path):
    for name in (b"a\xff.py", b"a\xfe.py"):
        with open(os.path.join(os.fsencode(tmp_path), name), "wb") as handle:
            handle.write(b"x = 1\n")
    found = tree.load_tree(spark, str(tmp_path)).collect()
    assert sorted((r.path, r.content) for r in found) == [("a\\xfe.py", "x = 1\n"), ("a\\xff.py", "x = 1\n")]


def test_folders_are_listed_in_rounds(spark, project, monkeypatch):
    """A task that opens no folder ahead hands all it finds to the next round."""
    monkeypatch.setattr(tree, "FOLDERS_AHEAD", 0)
    rounds, stage = [], tree.stage
    monkeypatch.setattr(tree, "stage", lambda df, *rest: rounds.append(df) or stage(df, *rest))
    assert {r.path for r in tree.load_tree(spark, str(project)).collect()} == KEPT
    assert len(rounds) == 4  # pkg, pkg/deep, pkg/deep/er and the root


def test_a_task_holds_few_of_very_many_folders(monkeypatch):
    """A root with 100,000 folders: the task opens some of them and hands the rest on, one by one."""
    opened = []

    def entries(folder):
        opened.append(folder)
        if folder == b"/root":
            yield from (stores.Entry(f"d{n}", b"/root/d%d" % n, True, None, None) for n in range(100_000))
        else:
            yield stores.Entry("a.py", folder + b"/a.py", False, 5, None)

    monkeypatch.setattr(stores, "entries", entries)
    monkeypatch.setattr(stores, "is_folder", lambda location: True)
    given = pa.RecordBatch.from_arrays([pa.array([""]), pa.array([b"/root"])], names=["path", "location"])
    batches = list(tree.Lister(".py", (), False)([given]))
    left = sum(folder for batch in batches for folder in batch["folder"].to_pylist())
    assert (left, len(opened)) == (100_000 - tree.FOLDERS_AHEAD, 1 + tree.FOLDERS_AHEAD)
    assert max(batch.num_rows for batch in batches) <= 4096


def test_tasks_of_equal_bytes(spark):
    files = spark.range(3000).selectExpr(
        "concat('p', id) AS path", "cast(concat('/', id) AS binary) AS location",
        "if(id % 1000 = 7, 9000000, id * 37 % 50000) AS length", "cast(null AS string) AS read_error",
    )
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        cut = tree.in_equal_tasks(files)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    weight = F.col("length") + tree.OPEN_BYTES
    tasks = [r.w for r in cut.groupBy(F.spark_partition_id()).agg(F.sum(weight).alias("w")).collect()]
    assert cut.count() == 3000 and cut.columns == files.columns
    assert max(tasks) <= (4 << 20) + 9_000_000 + tree.OPEN_BYTES
    assert sorted(tasks)[len(tasks) // 2] <= (4 << 20) + 50_000 + tree.OPEN_BYTES and len(tasks) > 40
    assert tree.in_equal_tasks(files.where("path IS NULL")).count() == 0


def test_other_stores(spark, project, tmp_path):
    """The reader for addresses, here on local files: names, sizes, links and errors as for paths."""
    root = f"file://{project}".encode()
    names = {entry.name: entry for entry in stores.entries(root)}
    assert names["pkg"].folder and names["a.py"].length == 6 and not names["a.py"].folder
    assert stores.is_folder(root) and not stores.is_folder(root + b"/a.py") and stores.length(root + b"/a.py") == 6
    with stores.opened(root + b"/pkg/deep/er/m.py") as handle:
        assert handle.read() == b"x = 1\n"
    with pytest.raises(OSError):
        stores.is_folder(root + b"/nothing")
    with pytest.raises(OSError, match="no reader"):
        list(stores.entries(b"unheard-of://x/y"))
    stores.write(root + b"/new/z.zip", b"PK")
    assert (project / "new" / "z.zip").read_bytes() == b"PK"


@pytest.fixture
def mounted(spark):
    """Mounts a folder in a table of its own and gives the address of that."""
    conf, names = spark._jsc.hadoopConfiguration(), []

    def mount(name, folder):
        table = f"t{uuid.uuid4().hex}"  # stores are remembered by their address
        names.append(f"fs.viewfs.mounttable.{table}.link./{name}")
        conf.set(names[-1], f"file://{folder}")
        return f"viewfs://{table}"

    yield mount
    for name in names:
        conf.unset(name)


def test_tree_behind_a_mount_table(spark, project, mounted):
    root = mounted("data", project)
    assert {r.path for r in tree.load_tree(spark, f"{root}/data").collect()} == KEPT
    assert [r.path for r in tree.load_tree(spark, f"{root}/data/pkg/venv.py").collect()] == ["venv.py"]
    whole = {r.path for r in tree.load_tree(spark, f"{root}/").collect()}
    assert whole == {f"data/{path}" for path in KEPT}
    lost = tree.load_tree(spark, f"{root}/data/nothing").collect()
    assert len(lost) == 1 and lost[0].read_error.startswith("Not readable")


def test_too_large_file_is_an_error_row(spark, project):
    rows = {r.path: r for r in tree.load_tree(spark, str(project), max_bytes=3).collect()}
    assert "larger than 3 bytes" in rows["a.py"].read_error and rows["a.py"].content is None


def test_read_errors_show_up_and_run_no_rules(spark, project):
    done = scan(tree.load_tree(spark, str(project)))
    errors = {r.path: r.error for r in done.parse_errors.collect()}
    assert set(errors) == {"dangling.py"} and errors["dangling.py"].startswith("Not readable")
    assert done.issues.count() == 0


def make_zip(path, entries):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as packed:
        for name, content in entries:
            packed.writestr(name, content)


@pytest.fixture
def uploads(tmp_path):
    make_zip(tmp_path / "good.zip", [("src/a.py", "x = 1\r\n"), ("src/_b.py", "y"), ("venv/c.py", ""), ("d.txt", ""),
                                     ("N.PY", ""), ("e/../f.py", "z"), ("./twice.py", "one"), ("twice.py", "two")])
    make_zip(tmp_path / "UPPER.ZIP", [("a.py", "")])
    make_zip(tmp_path / "empty.zip", [])
    make_zip(tmp_path / "only_text.zip", [("a.txt", "")])
    make_zip(tmp_path / "up.zip", [("ok.py", ""), ("../x.py", "")])
    make_zip(tmp_path / "out_and_in.zip", [("a/../../out_and_in/x.py", "")])
    make_zip(tmp_path / "abs.zip", [("/abs.py", "")])
    make_zip(tmp_path / "many.zip", [(f"f{i}.py", "") for i in range(2001)])
    make_zip(tmp_path / "just.zip", [(f"f{i}.py", "") for i in range(2000)])
    make_zip(tmp_path / "bomb.zip", [("a.bin", b"\0" * (150 << 20)), ("b.bin", b"\0" * (51 << 20))])
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    (tmp_path / "notes.tar").write_bytes(b"x")
    with open(tmp_path / "huge.zip", "wb") as handle:
        handle.truncate((20 << 20) + 1)
    raw = (tmp_path / "UPPER.ZIP").read_bytes()
    locked = bytearray(raw)
    locked[6] |= 1
    central = raw.index(b"PK\x01\x02")
    locked[central + 8] |= 1
    (tmp_path / "locked.zip").write_bytes(bytes(locked))
    make_zip(tmp_path / "damaged.zip", [("a.py", "x = 1"), ("notes.txt", "some text that is stored with a sum " * 9)])
    raw = bytearray((tmp_path / "damaged.zip").read_bytes())
    raw[raw.index(b"notes.txt") + 12] ^= 0xFF
    (tmp_path / "damaged.zip").write_bytes(bytes(raw))
    return tmp_path


def test_archives(spark, uploads):
    files, rejects = archives.load_archives(spark, str(uploads))
    reasons = {r.archive: r.reason for r in rejects.collect()}
    assert reasons == {
        "up.zip": "Entry leaves the archive root: ../x.py",
        "out_and_in.zip": "Entry leaves the archive root: a/../../out_and_in/x.py",
        "abs.zip": "Entry leaves the archive root: /abs.py",
        "many.zip": "Archive has more than 2000 entries",
        "bomb.zip": "Archive unpacks to over 200 MB",
        "broken.zip": "Archive cannot be opened as zip",
        "notes.tar": "Not a .zip file.",
        "huge.zip": "Archive is over 20 MB",
        "locked.zip": "Encrypted entry in zip: a.py",
        "damaged.zip": "Damaged entry in zip: notes.txt",
    }
    rows = files.collect()
    assert {r.path: r.content for r in rows if r.project == "good.zip"} == {
        "src/a.py": "x = 1\n", "src/_b.py": "y", "e/f.py": "z", "twice.py": "two"
    }
    assert sum(r.project == "just.zip" for r in rows) == 2000
    assert {r.project for r in rows} == {"good.zip", "UPPER.ZIP", "just.zip"}


def test_archives_behind_a_mount_table(spark, uploads, mounted):
    root = mounted("uploads", uploads)
    files, rejects = archives.load_archives(spark, f"{root}/uploads")
    assert {r.project for r in files.collect()} == {"good.zip", "UPPER.ZIP", "just.zip"}
    assert rejects.count() == 10


def test_states_of_uploads(spark, uploads):
    done = archives.open_archives(spark, str(uploads))
    crashes = spark.createDataFrame([("good.zip", "Scan stopped"), ("up.zip", "Scan stopped")], "project STRING, error STRING")
    states = archives.scan_states(done, crashes)
    told = {r.project: (r.status, r.files_scanned) for r in states.collect()}
    assert told == {
        **dict.fromkeys((r.archive for r in done.rejects.collect()), ("rejected", 0)),
        "good.zip": ("failed", 4), "UPPER.ZIP": ("ok", 1), "just.zip": ("ok", 2000),
        "empty.zip": ("empty", 0), "only_text.zip": ("empty", 0),
    }
    failed = {r.project: r for r in archives.failed_scans(states, done.found()).collect()}
    assert failed["good.zip"].files_list == ["e/f.py", "src/_b.py", "src/a.py", "twice.py"]
    assert failed["good.zip"].error == "Scan stopped" and failed["up.zip"].files_list == []
    assert "ok" not in {r.status for r in failed.values()} and len(failed) == 11


def test_failed_scan_lists_what_was_found(spark):
    states = spark.createDataFrame(
        [("p", "failed", "Scan crashed", 2), ("q", "ok", None, 1)],
        "project STRING, status STRING, error STRING, files_scanned INT",
    )
    files = spark.createDataFrame([("p", "b.py"), ("p", "a.py"), ("q", "c.py")], "project STRING, path STRING")
    row = archives.failed_scans(states, files).collect()[0]
    assert (row.error, row.files_scanned, row.files_list) == ("Scan crashed", 2, ["a.py", "b.py"])
    many = spark.range(25).select(F.lit("p").alias("project"), F.format_string("%02d.py", "id").alias("path"))
    states = states.withColumn("files_scanned", F.lit(25))
    rows = archives.failed_scans(states, many, part_rows=10).orderBy("part").collect()
    assert [(r.part, len(r.files_list), r.files_scanned) for r in rows] == [(0, 10, 25), (1, 10, 25), (2, 5, 25)]
    assert [path for r in rows for path in r.files_list] == [f"{i:02}.py" for i in range(25)]


@pytest.mark.parametrize("name,leaves", [
    ("a.py", False), ("../x", True), ("/abs", True), ("a/../b.py", False), ("a/../../b", True), ("./", False),
    ("a//b", False), ("..", True), ("a/..", False), ("..a/b", False),
])
def test_leaves_root(spark, name, leaves):
    df = spark.createDataFrame([(name,)], "name STRING")
    assert df.select(archives.leaves_root(F.col("name"))).first()[0] is leaves


def test_decode_like_python(spark):
    rng = np.random.default_rng(7)
    pieces = [b"a", b"\r", b"\n", b"\xff", b"\xc3", b"\xa9", b"\xe2\x82\xac", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xef\xbb\xbf"]
    raw = [b"".join(pieces[i] for i in rng.integers(0, len(pieces), rng.integers(0, 20))) for _ in range(2000)]
    df = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raw)], "i INT, content BINARY")
    for row in df.withColumn("text", decode(F.col("content"))).collect():
        wanted = raw[row.i].decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
        assert row.text == wanted, raw[row.i]


def test_lines_like_python(spark):
    rng = np.random.default_rng(11)
    pieces = ["a", "é", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u2028", "\u2029", "\t"]
    texts = ["", "\n", "a", "a\n", "\n\n"]
    texts += ["".join(pieces[i] for i in rng.integers(0, len(pieces), rng.integers(0, 12))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    for row in df.select("i", n_lines(F.col("t")).alias("n"), split_lines(F.col("t")).alias("l")).collect():
        wanted = texts[row.i].splitlines()
        assert row.l == wanted and row.n == len(wanted), repr(texts[row.i])


def test_archive_limits_are_arguments_and_hidden_folders_are_listed(spark, tmp_path):
    (tmp_path / ".hidden").mkdir()
    make_zip(tmp_path / ".hidden" / "in.zip", [("a.py", "x"), ("b.py", "y")])
    make_zip(tmp_path / "one.zip", [("a.py", "x")])
    files, rejects = archives.load_archives(spark, str(tmp_path), max_entries=1)
    assert [(r.archive, r.reason) for r in rejects.collect()] == [(".hidden/in.zip", "Archive has more than 1 entries")]
    assert [r.project for r in files.collect()] == ["one.zip"]
