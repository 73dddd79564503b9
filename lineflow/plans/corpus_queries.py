"""Corpus queries over the driver tables and the same statements for the SQL check."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lineflow.config import FilterConfig
from lineflow.functions import text
from lineflow.operators import attrition as cascade
from lineflow.operators import eda, linediff
from lineflow.plans.views import corpus, fixed_corpus, raw_release, texts
from lineflow.session import shared_folder
from lineflow.sources import quoted
from lineflow.sources.corpus import canonicalise
from lineflow.sources.files import manifest, read_sources, write_sources

CONFIG = FilterConfig()
CWES = ["CWE-119", "CWE-125"]


def _survivors(spark, sf):
    return cascade.filter_corpus(corpus(spark, sf), CONFIG, derive=False)


def _rounded(df, digits=6):
    return df.select(
        *[
            F.round(c, digits).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


def canonical_corpus(spark, sf):
    """Alias resolution and canonical columns of every row."""
    return corpus(spark, sf).select(
        "sample_id", "project", "commit_id", "cwe", "vul",
        F.sha1(F.encode("func_before", "UTF-8")).alias("before_sha1"),
        F.length("func_after").alias("after_chars"),
        F.sha1(F.encode(F.array_join("flaw_lines", "|"), "UTF-8")).alias("flaw_lines_sha1"),
        F.array_join(F.col("flaw_line_indices").cast("array<string>"), ",").alias("flaw_indices"),
    )


def filtered_functions(spark, sf):
    return _survivors(spark, sf).select(
        "sample_id", "cwe", "num_lines", "body_hash",
        F.array_join(F.col("flaw_line_indices").cast("array<string>"), ",").alias("flaw_indices"),
        F.sha1(F.encode(F.array_join("flaw_lines", "|"), "UTF-8")).alias("flaw_lines_sha1"),
    )


def filter_attrition(spark, sf):
    return cascade.attrition(corpus(spark, sf), CONFIG, derive=False)


def attrition_by_cwe(spark, sf):
    return cascade.attrition_by_cwe(corpus(spark, sf), CWES, CONFIG, derive=False)


def attrition_from_diff(spark, sf):
    """The cascade where flaw lines come from the diff with the fixed body."""
    return cascade.attrition(fixed_corpus(spark, sf), CONFIG)


def derived_flaw_lines(spark, sf):
    return (
        cascade.staged(fixed_corpus(spark, sf), CONFIG)
        .filter("level >= 3")
        .select("sample_id", F.array_join(F.col("flaw_line_indices").cast("array<string>"), ",").alias("flaw_indices"))
    )


def fix_diff_rows(spark, sf):
    """Rows of each fix by kind, with the sum of their old line numbers and their texts."""
    rows = linediff.fix_rows(fixed_corpus(spark, sf), "sample_id", F.col("func_before"), F.col("func_after"))
    return rows.groupBy("sample_id", "kind").agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("line"), F.lit(0)).alias("line_sum"),
        F.sha1(F.encode(F.array_join(F.array_sort(F.collect_list(F.struct("at", "text")))["text"], "|"), "UTF-8")).alias("text_sha1"),
    )


def diff_matches(spark, sf):
    """How many lines of each function its fix keeps, and where the first and last of them go."""
    rows = linediff.matches(fixed_corpus(spark, sf), "ordinal", F.col("func_before"), F.col("func_after"))
    pairs = F.transform("matched", lambda m: F.concat_ws(":", m["i"].cast("string"), m["j"].cast("string")))
    return rows.select("ordinal", F.size("matched").alias("kept"), F.sha1(F.array_join(pairs, ",")).alias("pairs_sha1"))


def csv_release(spark, sf):
    """The functions after a round trip through a quoted CSV release, read block by block."""
    path = f"{shared_folder(spark)}/lineflow-csv/{uuid.uuid4().hex}.csv"
    raw = raw_release(spark, sf).withColumnRenamed("ordinal", "doc_id")
    raw.write.csv(path, header=True, quoteAll=True, quote='"', escape='"')
    rows = quoted.read_csv(spark, path)
    canonical = canonicalise(rows.drop("ordinal").withColumn("ordinal", F.col("doc_id").cast("long")))
    return canonical.select(
        "sample_id", "project", "commit_id", "cwe", "vul", F.sha1(F.encode("func_before", "UTF-8")).alias("before_sha1"),
        F.array_join(F.col("flaw_line_indices").cast("array<string>"), ",").alias("flaw_indices"),
    )


def comment_stripping(spark, sf):
    """Pages hold markup, scripts and URLs: every comment form occurs."""
    html = F.col("html")
    mask = text.code_line_mask(html)
    return texts(spark, sf, "pages", "page_id").select(
        "page_id",
        F.sha1(F.encode(text.strip_comments(html), "UTF-8")).alias("stripped_sha1"),
        text.body_hash(html).alias("body_hash"),
        text.num_lines(html).alias("num_lines"),
        F.array_join(F.transform(mask, lambda m: m.cast("int").cast("string")), "").alias("code_mask"),
    )


def trivial_lines(spark, sf):
    """Fragments between angle brackets, judged one by one."""
    parts = texts(spark, sf, "pages", "page_id").select("page_id", F.explode(F.split("html", "[<>]", -1)).alias("part"))
    return parts.groupBy("page_id").agg(
        F.count("*").alias("fragments"),
        F.count_if(text.is_trivial_line(F.col("part"))).alias("trivial"),
    )


def vulnerable_cwe_counts(spark, sf):
    return eda.vulnerable_cwe_counts(corpus(spark, sf))


def top_cwes(spark, sf):
    return eda.vulnerable_cwe_counts(corpus(spark, sf)).limit(15)


def dataset_summary(spark, sf):
    return _rounded(eda.dataset_summary(_survivors(spark, sf)))


def flaw_positions(spark, sf):
    return _rounded(eda.position_summary(eda.relative_flaw_positions(_survivors(spark, sf))))


def first_flaw_positions(spark, sf):
    return _rounded(eda.first_flaw_positions(_survivors(spark, sf)))


def source_manifest(spark, sf):
    return manifest(_survivors(spark, sf), batch_size=50)


def source_files(spark, sf):
    """Every kept function as it reads back from its two source files."""
    path = f"{shared_folder(spark)}/lineflow-sources/{uuid.uuid4().hex}"
    write_sources(_survivors(spark, sf), path, batch_size=50)
    return read_sources(spark, path).select(
        "sample_id", "batch", "extension", F.sha1(F.encode("text", "UTF-8")).alias("text_sha1")
    )


QUERIES = {
    f.__name__: f
    for f in (
        canonical_corpus, filtered_functions, filter_attrition, attrition_by_cwe,
        attrition_from_diff, derived_flaw_lines, fix_diff_rows, diff_matches, csv_release,
        comment_stripping,
        trivial_lines, vulnerable_cwe_counts, top_cwes, dataset_summary, flaw_positions,
        first_flaw_positions, source_manifest, source_files,
    )
}

# --- the same in SQL ----------------------------------------------------------------------

S_CLASS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
S_TRIVIAL = r"^[\t-\r\x1c-\x20\x{85}\p{Z}{}();]*$"


def sql_strip_comments(x: str) -> str:
    block = r"(?s)/\*.*?\*/"
    return (
        f"regexp_replace(CASE WHEN contains({x}, '/*') THEN array_to_string(list_transform(list_zip("
        f"string_split_regex({x}, '{block}'), list_transform(regexp_extract_all({x}, '{block}'),"
        f" lambda c: regexp_replace(c, '[^\\n]+', '', 'g'))), lambda p: p[1] || coalesce(p[2], '')), '')"
        f" ELSE {x} END, '//[^\\n]*', '', 'g')"
    )


def sql_hash(x: str) -> str:
    return f"sha1(trim(regexp_replace({sql_strip_comments(x)}, '{S_CLASS}+', ' ', 'g')))"


SQL_CORPUS = f"""
corpus AS (
  SELECT d.doc_id AS ordinal, printf('bigvul_%06d', d.doc_id) AS sample_id, d.source AS project,
         d.source || '/' || d.lang || '/' || CAST(d.n_chars // 512 AS VARCHAR) AS commit_id,
         CASE d.lang WHEN 'en' THEN 'CWE-119' WHEN 'fr' THEN 'CWE-125' WHEN 'de' THEN 'CWE-119' ELSE '' END AS cwe,
         CAST(CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 0 ELSE 1 END AS INTEGER) AS vul,
         'int f() {{' || chr(10) || d.text || chr(10) || '}}' AS func_before,
         string_split('int f() {{' || chr(10) || d.text || chr(10) || '}}', chr(10)) AS all_lines
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
corpus_lines AS (
  SELECT ordinal, unnest(all_lines) AS x, generate_subscripts(all_lines, 1) - 1 AS i,
         unnest(string_split({sql_strip_comments('func_before')}, chr(10))) AS bare FROM corpus),
flaws AS (
  SELECT ordinal, count(*) AS listed,
         count(*) FILTER (NOT regexp_matches(bare, '{S_TRIVIAL}')) AS coded,
         string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS all_idx,
         string_agg(x, '|' ORDER BY i) AS all_txt,
         string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (NOT regexp_matches(bare, '{S_TRIVIAL}')) AS idx,
         string_agg(x, '|' ORDER BY i) FILTER (NOT regexp_matches(bare, '{S_TRIVIAL}')) AS txt,
         min(i) FILTER (NOT regexp_matches(bare, '{S_TRIVIAL}')) AS first_i
  FROM corpus_lines WHERE length(x) % 5 = 0 GROUP BY ordinal),
levels AS (
  SELECT c.*, len(all_lines) AS num_lines, f.idx, f.txt, f.first_i, coalesce(f.coded, 0) AS flaw_count,
         CASE WHEN vul <> 1 THEN 0 WHEN cwe NOT IN ('CWE-119', 'CWE-125') THEN 1
              WHEN coalesce(listed, 0) = 0 THEN 2 WHEN coded = 0 THEN 3
              WHEN len(all_lines) NOT BETWEEN 5 AND 300 THEN 4 ELSE 5 END AS level,
         {sql_hash('func_before')} AS body_hash
  FROM corpus c LEFT JOIN flaws f USING (ordinal)),
survivors AS (
  SELECT * FROM levels WHERE level = 5
  QUALIFY row_number() OVER (PARTITION BY body_hash ORDER BY ordinal) = 1),
positions AS (
  SELECT s.sample_id, l.i / greatest(s.num_lines - 1, 1) AS position
  FROM survivors s JOIN corpus_lines l USING (ordinal)
  WHERE length(l.x) % 5 = 0 AND NOT regexp_matches(l.bare, '{S_TRIVIAL}'))
"""

# The diff with the fixed body: lines that occur once on both sides, in their longest rising run,
# are anchors; in the gaps between them occurrences pair up, counted from either end.


def sql_rising(source: str, pairs: str) -> str:
    """For every ordinal of ``source``, the longest run of its ``pairs`` that rises on both sides."""
    return f"""(
  SELECT ordinal, ps, list_reverse(list_reduce(st.tops, lambda run, x: list_append(run,
      CASE WHEN len(run) = 0 THEN st.tops[-1] ELSE st.back[run[-1] + 1] END), CAST([] AS INTEGER[]))) AS picked
  FROM (SELECT ordinal, ps, list_reduce(list_transform(range(len(ps)), lambda t: CAST(t AS INTEGER)), lambda acc, t: {{
      'tops': list_concat(list_append(acc.tops[1:len(list_filter(acc.tops, lambda k: ps[k + 1].j < ps[t + 1].j))], t),
        acc.tops[len(list_filter(acc.tops, lambda k: ps[k + 1].j < ps[t + 1].j)) + 2:]),
      'back': list_append(acc.back, coalesce(acc.tops[len(list_filter(acc.tops, lambda k: ps[k + 1].j < ps[t + 1].j))], -1))}},
      {{'tops': CAST([] AS INTEGER[]), 'back': CAST([] AS INTEGER[])}}) AS st
    FROM (SELECT ordinal, list({{'i': i, 'j': j}} ORDER BY i, j DESC) AS ps FROM ({pairs}) GROUP BY ordinal)))"""


SQL_DIFF = f"""{SQL_CORPUS},
after_lines AS (
  SELECT ordinal, list_transform(list_filter(all_lines, lambda x: length(x) % 5 <> 0),
    lambda x: CASE WHEN length(x) % 7 = 1 THEN regexp_replace(x, '\\.$', ';') ELSE x END) AS ls FROM corpus),
sided AS MATERIALIZED (
  SELECT ordinal, 0 AS side, i, x FROM corpus_lines
  UNION ALL SELECT ordinal, 1, generate_subscripts(ls, 1) - 1, unnest(ls) FROM after_lines),
anchor AS MATERIALIZED (SELECT ordinal, unnest(list_transform(picked, lambda t: ps[t + 1].i)) AS i, unnest(list_transform(picked, lambda t: ps[t + 1].j)) AS j
  FROM {sql_rising("sided", "SELECT ordinal, min(i) FILTER (side = 0) AS i, min(i) FILTER (side = 1) AS j FROM sided GROUP BY ordinal, x HAVING count(*) FILTER (side = 0) = 1 AND count(*) FILTER (side = 1) = 1")}),
gapped AS (
  SELECT s.*, a.ordinal IS NOT NULL AS anchored, count(a.ordinal) OVER (PARTITION BY s.ordinal, s.side ORDER BY s.i) AS gap
  FROM sided s LEFT JOIN anchor a ON a.ordinal = s.ordinal AND CASE WHEN side = 0 THEN a.i ELSE a.j END = s.i),
counted AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY ordinal, side, gap, anchored, x) AS al
  FROM gapped WINDOW w AS (PARTITION BY ordinal, side, gap, anchored, x ORDER BY i)),
candidates AS (
  SELECT DISTINCT b.ordinal, b.i, a.i AS j FROM counted b JOIN counted a ON b.side = 0 AND a.side = 1
    AND a.ordinal = b.ordinal AND a.gap = b.gap AND a.anchored = b.anchored AND a.x = b.x AND (a.n = b.n OR a.al - a.n = b.al - b.n)),
matched AS MATERIALIZED (SELECT ordinal, generate_subscripts(picked, 1) - 1 AS g, unnest(list_transform(picked, lambda t: ps[t + 1].i)) AS i,
    unnest(list_transform(picked, lambda t: ps[t + 1].j)) AS j FROM {sql_rising("candidates", "SELECT * FROM candidates")}),
removed AS (SELECT l.* FROM corpus_lines l ANTI JOIN matched m ON m.ordinal = l.ordinal AND m.i = l.i),
changed AS (
  SELECT ordinal, count(*) AS listed, count(*) FILTER (NOT regexp_matches(bare, '{S_TRIVIAL}')) AS coded,
    string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (NOT regexp_matches(bare, '{S_TRIVIAL}')) AS idx
  FROM removed GROUP BY ordinal),
diff_levels AS (
  SELECT c.*, d.idx,
         CASE WHEN vul <> 1 THEN 0 WHEN cwe NOT IN ('CWE-119', 'CWE-125') THEN 1
              WHEN coalesce(listed, 0) = 0 THEN 2 WHEN coded = 0 THEN 3
              WHEN len(all_lines) NOT BETWEEN 5 AND 300 THEN 4 ELSE 5 END AS level,
         {sql_hash('func_before')} AS body_hash
  FROM corpus c LEFT JOIN changed d USING (ordinal)),
script AS (
  SELECT ordinal, kind, line, x, row_number() OVER (PARTITION BY ordinal ORDER BY g, rank, i) - 1 AS p FROM (
    SELECT ordinal, 'removed' AS kind, 0 AS rank, i, i + 1 AS line, x, (SELECT count(*) FROM matched m WHERE m.ordinal = r.ordinal AND m.i < r.i) AS g FROM removed r
    UNION ALL
    SELECT ordinal, 'added', 1, i, NULL, x, (SELECT count(*) FROM matched m WHERE m.ordinal = s.ordinal AND m.j < s.i)
    FROM sided s WHERE side = 1 AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.ordinal = s.ordinal AND m.j = s.i)
    UNION ALL
    SELECT ordinal, 'context', 2, i, i + 1, x, g FROM matched JOIN corpus_lines USING (ordinal, i))),
near AS (
  SELECT *, coalesce(p - max(p) FILTER (kind <> 'context') OVER (PARTITION BY ordinal ORDER BY p) <= 2, false)
    OR coalesce(min(p) FILTER (kind <> 'context') OVER (PARTITION BY ordinal ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - p <= 2, false) AS shown
  FROM script),
fix AS (
  SELECT ordinal, kind, line, x, p, 1 AS o FROM near WHERE shown
  UNION ALL
  SELECT ordinal, 'gap', NULL, '', p, 0 FROM (
    SELECT *, lag(shown) OVER (PARTITION BY ordinal ORDER BY p) AS was, max(p) FILTER (shown) OVER (PARTITION BY ordinal ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
    FROM near) WHERE shown AND NOT was AND seen IS NOT NULL)
"""

_STAGES = "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(cascade.STAGES)) + ") s(position, step)"


def _sql(body: str) -> str:
    return f"WITH {SQL_CORPUS} {body}"


ORACLE = {
    "canonical_corpus": _sql(
        "SELECT sample_id, project, commit_id, cwe, vul, sha1(func_before) AS before_sha1,"
        " CAST(0 AS INTEGER) AS after_chars, sha1(coalesce(all_txt, '')) AS flaw_lines_sha1,"
        " coalesce(all_idx, '') AS flaw_indices FROM corpus LEFT JOIN flaws USING (ordinal)"
    ),
    "csv_release": _sql(
        "SELECT sample_id, project, commit_id, cwe, vul, sha1(func_before) AS before_sha1,"
        " coalesce(all_idx, '') AS flaw_indices FROM corpus LEFT JOIN flaws USING (ordinal)"
    ),
    "filtered_functions": _sql(
        "SELECT sample_id, cwe, CAST(num_lines AS INTEGER) AS num_lines, body_hash, idx AS flaw_indices,"
        " sha1(txt) AS flaw_lines_sha1 FROM survivors"
    ),
    "filter_attrition": _sql(
        f"SELECT CAST(s.position AS INTEGER) AS position, s.step, CASE WHEN s.position = 6"
        f" THEN (SELECT count(*) FROM survivors) ELSE (SELECT count(*) FROM levels WHERE level >= s.position) END"
        f" AS rows FROM {_STAGES}"
    ),
    "attrition_by_cwe": _sql(
        f"SELECT c.cwe, CAST(s.position AS INTEGER) AS position, s.step, CASE WHEN s.position = 6"
        f" THEN (SELECT count(DISTINCT body_hash) FROM levels l WHERE level = 5 AND l.cwe = c.cwe)"
        f" ELSE (SELECT count(*) FROM levels l WHERE level >= s.position AND l.cwe = c.cwe) END AS rows"
        f" FROM {_STAGES}, (VALUES ('CWE-119'), ('CWE-125')) c(cwe) WHERE s.position >= 2"
    ),
    "diff_matches": f"WITH {SQL_DIFF} SELECT ordinal, CAST(count(*) AS INTEGER) AS kept,"
        " sha1(string_agg(i || ':' || j, ',' ORDER BY i)) AS pairs_sha1 FROM matched GROUP BY ordinal",
    "derived_flaw_lines": f"WITH {SQL_DIFF} SELECT sample_id, coalesce(idx, '') AS flaw_indices FROM diff_levels WHERE level >= 3",
    "attrition_from_diff": f"WITH {SQL_DIFF} SELECT CAST(s.position AS INTEGER) AS position, s.step, CASE WHEN s.position = 6"
        f" THEN (SELECT count(DISTINCT body_hash) FROM diff_levels WHERE level = 5) ELSE (SELECT count(*) FROM diff_levels WHERE level >= s.position) END"
        f" AS rows FROM {_STAGES}",
    "fix_diff_rows": f"WITH {SQL_DIFF} SELECT sample_id, kind, count(*) AS rows, CAST(coalesce(sum(line), 0) AS BIGINT) AS line_sum,"
        " sha1(string_agg(x, '|' ORDER BY p, o)) AS text_sha1 FROM fix JOIN corpus USING (ordinal) GROUP BY sample_id, kind",
    "comment_stripping": f"""
        WITH p AS (SELECT page_id, html, {sql_strip_comments('html')} AS bare FROM pages)
        SELECT page_id, sha1(bare) AS stripped_sha1, {sql_hash('html')} AS body_hash,
               CAST(len(string_split(html, chr(10))) AS INTEGER) AS num_lines,
               array_to_string(list_transform(string_split(bare, chr(10)),
                 lambda t: CASE WHEN regexp_matches(t, '{S_TRIVIAL}') THEN '0' ELSE '1' END), '') AS code_mask
        FROM p""",
    "trivial_lines": f"""
        WITH f AS (SELECT page_id, unnest(string_split_regex(html, '[<>]')) AS part FROM pages),
        g AS (SELECT page_id, part, regexp_replace(regexp_replace(part, '^{S_CLASS}+', ''), '{S_CLASS}+$', '') AS b FROM f)
        SELECT page_id, count(*) AS fragments, count(*) FILTER (
            b LIKE '//%' OR b LIKE '/*%' OR b LIKE '*/%' OR b = '*' OR b LIKE '* %'
            OR regexp_matches({sql_strip_comments('part')}, '{S_TRIVIAL}')) AS trivial
        FROM g GROUP BY page_id""",
    "vulnerable_cwe_counts": _sql(
        "SELECT CASE WHEN cwe = '' THEN '(none)' ELSE cwe END AS cwe, count(*) AS functions"
        " FROM corpus WHERE vul = 1 GROUP BY 1"
    ),
    "top_cwes": _sql(
        "SELECT CASE WHEN cwe = '' THEN '(none)' ELSE cwe END AS cwe, count(*) AS functions"
        " FROM corpus WHERE vul = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"
    ),
    "dataset_summary": _sql(
        "SELECT count(*) AS functions, count(DISTINCT project) AS projects,"
        " count(DISTINCT commit_id) AS fixing_commits, round(median(num_lines), 6) AS median_lines,"
        " round(avg(num_lines), 6) AS mean_lines, round(median(flaw_count), 6) AS median_flaw_lines,"
        " round(avg(flaw_count), 6) AS mean_flaw_lines,"
        " round(avg(CASE WHEN flaw_count = 1 THEN 1.0 ELSE 0.0 END), 6) AS single_flaw_line_share,"
        " round((SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM survivors GROUP BY project)), 6)"
        " AS largest_project_share FROM survivors"
    ),
    "flaw_positions": _sql(
        "SELECT round(b.b / 10, 2) AS \"from\", round((b.b + 1) / 10, 2) AS \"to\","
        " round((SELECT count(*) FROM positions WHERE position >= b.b / 10 AND (position < (b.b + 1) / 10 OR b.b = 9))"
        " / (SELECT greatest(count(*), 1) FROM positions), 6) AS share, CAST(0.1 AS DOUBLE) AS uniform"
        " FROM range(10) b(b)"
    ),
    "first_flaw_positions": _sql(
        "SELECT sample_id, round(first_i / greatest(num_lines - 1, 1), 6) AS position FROM survivors"
    ),
    "source_manifest": _sql(
        "SELECT sample_id, printf('batch_%04d', p // 50) AS batch,"
        " printf('batch_%04d', p // 50) || '/' || sample_id || '.c' AS path"
        " FROM (SELECT sample_id, row_number() OVER (ORDER BY ordinal) - 1 AS p FROM survivors)"
    ),
    "source_files": _sql(
        "SELECT sample_id, printf('batch_%04d', p // 50) AS batch, extension, sha1(body || chr(10)) AS text_sha1"
        " FROM (SELECT sample_id, replace(replace(func_before, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS body,"
        " row_number() OVER (ORDER BY ordinal) - 1 AS p FROM survivors), (VALUES ('.c'), ('.cpp')) e(extension)"
    ),
}
