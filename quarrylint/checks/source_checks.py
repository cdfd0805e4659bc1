"""Checks of sources: loading, guards, decoding, lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylint.checks import corpus as made
from quarrylint.checks import files_on_disk, oracle
from quarrylint.checks.base import check
from quarrylint.functions.staging import numbered
from quarrylint.functions.text import decode, lines, n_lines
from quarrylint.plans.scan import scan
from quarrylint.sources import archives, paths, tree


@check("s01_load_tree", f"""WITH {oracle.PART}
    SELECT 'tree' AS project, project || '/' || folder || '/part_' || k || '.py' AS path,
        md5('x = ' || k || chr(10)) AS content_md5
    FROM (SELECT *, CASE s % 4 WHEN 0 THEN 'src' WHEN 1 THEN '_pkg' WHEN 2 THEN 'venv' ELSE '.hidden' END AS folder
        FROM part_rows) WHERE folder IN ('src', '_pkg')""")
def load_tree(spark, sf_dir):
    root = files_on_disk.write_tree(files_on_disk.tree_files(spark, sf_dir))
    return tree.load_tree(spark, root, project="tree").select("project", "path", F.md5("content").alias("content_md5"))


@check("s02_single_file", """WITH brands AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)
    SELECT 'one' AS project, 'brands.py' AS path, md5(string_agg(p_brand || ' = ' || n, chr(10) ORDER BY p_brand || ' = ' || n))
        AS content_md5 FROM brands""")
def single_file(spark, sf_dir):
    root = files_on_disk.write_tree(files_on_disk.brand_files(spark, sf_dir))
    found = [tree.load_tree(spark, f"{root}/brands.{suffix}", project="one") for suffix in ("py", "txt")]
    return found[0].unionByName(found[1]).select("project", "path", F.md5("content").alias("content_md5"))


S03_PATH = """CASE s % 8 WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'venv/a.py' WHEN 2 THEN 'x/build/y/a.py'
    WHEN 3 THEN '.git/a.py' WHEN 4 THEN 'x/.cache/a.py' WHEN 5 THEN '.dot.py' WHEN 6 THEN 'x/build.py'
    ELSE 'my.venv/a.py' END"""


@check("s03_exclude_dirs", f"""WITH {oracle.PART}
    SELECT project, 'part_' || k || '/' || {S03_PATH} AS path FROM part_rows WHERE s % 8 IN (0, 5, 6, 7)""")
def exclude_dirs(spark, sf_dir):
    files = made.table(spark, sf_dir, "part").selectExpr(
        "p_brand AS project", "p_partkey AS k", "p_size AS s"
    ).selectExpr("project", f"concat('part_', k, '/', {S03_PATH}) AS path")
    return paths.exclude_dirs(files)


@check("s03_replaced_excludes", f"""WITH {oracle.PART}
    SELECT project, 'part_' || k || '/' || {S03_PATH} AS path FROM part_rows WHERE s % 8 IN (1, 2, 5, 6, 7)""")
def replaced_excludes(spark, sf_dir):
    files = made.table(spark, sf_dir, "part").selectExpr(
        "p_brand AS project", "p_partkey AS k", "p_size AS s"
    ).selectExpr("project", f"concat('part_', k, '/', {S03_PATH}) AS path")
    return paths.exclude_dirs(files, excludes=["src"])


@check("s04_load_archives", f"""WITH {oracle.PART}
    SELECT 'part_' || k || '.zip' AS project, path, md5(content) AS content_md5
    FROM (SELECT *, UNNEST([
        {{path: 'src/a.py', content: 'x = ' || k || chr(10)}},
        {{path: 'src/__init__.py', content: ''}},
        {{path: 'b/c.py', content: t || chr(10)}}], recursive := true) FROM part_rows)
    WHERE s % 5 <> 0 AND s % 7 <> 3 AND s % 11 <> 2""")
def load_archives(spark, sf_dir):
    root = files_on_disk.write_archives(spark, sf_dir)
    files, _ = archives.load_archives(spark, root)
    return files.select("project", "path", F.md5("content").alias("content_md5"))


@check("s05_archive_rejects", f"""WITH {oracle.PART}
    SELECT 'part_' || k || '.zip' AS archive, CASE WHEN s % 5 = 0 AND s % 11 <> 2 THEN 'Entry leaves the archive root: ../evil.py'
        ELSE 'Damaged entry in zip: notes.txt' END AS reason
    FROM part_rows WHERE s % 5 = 0 AND s % 11 <> 2 OR s % 7 = 3""")
def archive_rejects(spark, sf_dir):
    root = files_on_disk.write_archives(spark, sf_dir)
    _, rejects = archives.load_archives(spark, root)
    return rejects


@check("s05_all_reasons", """SELECT 'part_' || p_partkey || CASE p_partkey % 9 WHEN 1 THEN '.tar' ELSE '.ZIP' END AS archive,
        CASE p_partkey % 9 WHEN 1 THEN 'Not a .zip file.' WHEN 2 THEN 'Archive is over 4096 bytes'
        WHEN 3 THEN 'Archive cannot be opened as zip' WHEN 4 THEN 'Archive has more than 4 entries'
        WHEN 5 THEN 'Entry leaves the archive root: a/../../b.py' WHEN 6 THEN 'Archive unpacks to over 20000 bytes'
        WHEN 7 THEN 'Encrypted entry in zip: a.py' WHEN 8 THEN 'Damaged entry in zip: notes.txt' END AS reason
    FROM part WHERE p_partkey % 9 <> 0""")
def all_reasons(spark, sf_dir):
    root = files_on_disk.write_odd_archives(spark, sf_dir)
    return archives.open_archives(spark, root, **files_on_disk.ODD_LIMITS).rejects


# Entry tables from line items: an archive per order; sizes make some orders cross the limit.
S05_LIMIT = 150 * 1024 * 1024
S05_NAME = "CASE WHEN {tax} >= 8 THEN 'a/../../b.py' WHEN {tax} = 7 THEN 'a/../c.py' ELSE 'd/e.py' END"


@check("s05_entry_rejects", f"""WITH entries AS (
        SELECT l_orderkey::VARCHAR AS archive, {S05_NAME.format(tax='round(l_tax * 100)::INT')} AS name,
            (l_extendedprice * 400)::BIGINT AS size,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_tax) AS idx
        FROM lineitem),
    running AS (SELECT *, sum(size) OVER (PARTITION BY archive ORDER BY idx) AS total, count(*) OVER (PARTITION BY archive) AS n
        FROM entries),
    reasons AS (SELECT archive, idx, CASE WHEN name = 'a/../../b.py' THEN 'Entry leaves the archive root: ' || name
        WHEN total > {S05_LIMIT} THEN 'Archive unpacks to over 150 MB' END AS reason
        FROM running WHERE n <= 6)
    SELECT archive, min_by(reason, idx) AS reason FROM reasons WHERE reason IS NOT NULL GROUP BY archive
    UNION ALL SELECT DISTINCT archive, 'Archive has more than 6 entries' FROM running WHERE n > 6""")
def entry_rejects(spark, sf_dir):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax"]
    items = made.table(spark, sf_dir, "lineitem").select("l_orderkey", *order)
    entries = numbered(items, ["l_orderkey"], order, "idx").selectExpr(
        "cast(l_orderkey AS string) AS archive",
        "cast(idx AS int) AS idx",
        S05_NAME.format(tax="cast(round(l_tax * 100) AS int)") + " AS name",
        "cast(round(l_extendedprice * 400) AS bigint) AS file_size",
        "false AS is_dir", "false AS encrypted",
    )
    return archives.entry_rejects(entries, max_entries=6, max_unpacked=S05_LIMIT)


@check("s06_decode", r"""SELECT doc_id, md5(regexp_replace(text, '\r\n?', chr(10), 'g')) AS text_md5 FROM documents""")
def decoded(spark, sf_dir):
    raw = made.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return raw.select("doc_id", F.md5(decode(F.col("content"))).alias("text_md5"))


@check("s06_bad_bytes", r"""SELECT doc_id, md5(chr(65533) || regexp_replace(text, '\r\n?', chr(10), 'g') || chr(65533)) AS text_md5
    FROM documents""")
def bad_bytes(spark, sf_dir):
    """A byte that starts nothing ahead of each text, one that lacks the rest behind it."""
    raw = made.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat(unhex('FF'), cast(text AS binary), unhex('C3')) AS content"
    )
    return raw.select("doc_id", F.md5(decode(F.col("content"))).alias("text_md5"))


@check("s07_read_failures", f"""WITH {oracle.PART}
    SELECT project || '/' || folder || '/part_' || k || '.py' AS path, 'Not read: larger than 7 bytes' AS error
    FROM (SELECT *, CASE s % 4 WHEN 0 THEN 'src' ELSE '_pkg' END AS folder FROM part_rows WHERE s % 4 < 2)
    WHERE length('x = ' || k) + 1 > 7""")
def read_failures(spark, sf_dir):
    """Files that are not read are error rows of the scan; no rule runs on them."""
    root = files_on_disk.write_tree(files_on_disk.tree_files(spark, sf_dir))
    done = scan(tree.load_tree(spark, root, project="tree", max_bytes=7), profile=["long-file"])
    return done.parse_errors.select("path", "error")


@check("s08_lines", f"""WITH split AS (SELECT source AS project, doc_id::VARCHAR AS path,
        {oracle.line_list('text')} AS parts FROM documents)
    SELECT project, path, unnest(range(1, len(parts) + 1))::INT AS line_no, unnest(parts) AS text FROM split""")
def document_lines(spark, sf_dir):
    return lines(made.document_files(spark, sf_dir))


@check("s08_line_counts", f"""SELECT source AS project, doc_id::VARCHAR AS path,
    len({oracle.line_list('text')})::INT AS n_lines FROM documents""")
def line_counts(spark, sf_dir):
    return made.document_files(spark, sf_dir).select("project", "path", n_lines(F.col("content")).alias("n_lines"))


@check("s09_files_list", f"WITH {oracle.PART}, {oracle.EVENTS}, {oracle.FILES} SELECT project, path FROM files")
def files_list(spark, sf_dir):
    return paths.files_list(made.corpus(spark, sf_dir))
