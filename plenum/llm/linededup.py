"""Removal of cross-site boilerplate lines by the number of distinct sites that a line appears on.

Each line hash gets a HyperLogLog sketch of its sites; sketches merge in the aggregation, on the map side first, so a line on every
page is as cheap as any other. A sketch that is clearly above or below the threshold decides; lines near it get an exact count of
distinct sites. The first occurrence of a removed line stays, so that no content leaves the corpus altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.shared import written

#: A line on this many sites or more is boilerplate.
MIN_SITES = 3
#: Log2 of a sketch's registers, and the standard errors (1.04 / sqrt(registers)) within which a line counts as near the threshold.
LG_REGISTERS, ERRORS = 8, 4


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_places(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, body, pos, site, a, b) for each line that is not blank: its document, its place from 0, its site and two hashes of the trimmed line."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("body"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
        F.posexplode(split_lines(text)).alias("pos", "line"),
    )
    line = F.trim(F.translate("line", "\t\x0b\x0c\r", "    "))
    return rows.where(line != "").select("id", "body", "pos", "site", F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b, first) of the lines on `min_sites` sites or more; `first` is the smallest (id, body, pos)."""
    spread = written(
        lines.groupBy("a", "b").agg(
            F.hll_sketch_agg("site", F.lit(LG_REGISTERS)).alias("sketch"), F.min(F.struct("id", "body", "pos")).alias("first")
        ).select("a", "b", "first", F.hll_sketch_estimate("sketch").alias("sites")),
        "line-spread",
    )
    margin = 1 + min_sites * ERRORS * 1.04 / 2 ** (LG_REGISTERS / 2)
    sure = spread.where(F.col("sites") > min_sites + margin)
    near = spread.where((F.col("sites") >= min_sites - margin) & (F.col("sites") <= min_sites + margin))
    counted = (
        lines.join(near.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.countDistinct("site").alias("exact"))
        .where(F.col("exact") >= min_sites).select("a", "b")
    )
    return sure.select("a", "b", "first").union(near.join(counted, ["a", "b"], "left_semi").select("a", "b", "first"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES
) -> DataFrame:
    """All columns of `docs` with boilerplate lines taken out of `text_col`, and `_lines`, `_removed`: lines before, and lines taken out.

    Lines are parts between \\n, compared without white space at their ends; blank lines are never taken out. A line on `min_sites` sites
    stays only where (id, hash of the text, place) is smallest; null ids come first. A null site is a site of its own; a null text
    stays null and an empty one empty (no lines and one line); equal rows are treated alike; an empty table gives an empty table. No row is ever
    dropped. Columns of `docs` named like the two are replaced.
    """
    lines = written(line_places(docs, id_col, text_col, site_col), "lines")
    found = written(boilerplate(lines, min_sites), "boilerplate")
    gone = (
        lines.join(found, ["a", "b"]).where(~F.struct("id", "body", "pos").eqNullSafe(F.col("first")))
        .groupBy(F.col("id").alias("_gone_id"), F.col("body").alias("_gone_body")).agg(F.collect_set("pos").alias("_gone"))
    )
    text = F.col(text_col).cast("string")
    own = docs.drop("_lines", "_removed", "_gone_id", "_gone_body", "_gone")
    joined = own.join(gone, F.col(id_col).eqNullSafe(F.col("_gone_id")) & (F.xxhash64(text) == F.col("_gone_body")), "left")
    parts = split_lines(text)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_gone")
    kept = F.concat_ws("\n", F.transform(stay, lambda i: F.get(parts, i)))
    columns = [F.when(F.col("_gone").isNull(), text).otherwise(kept).alias(text_col) if c == text_col else own[c] for c in own.columns]
    n = F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long")
    return joined.select(*columns, n.alias("_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_removed"))


#: The same in DuckDB: exact counts throughout; hashes of texts are not the same there, and ids are taken as unique.
ORACLE = f"""
WITH split AS (SELECT doc_id, text, coalesce(source, '') AS site, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, site, i, parts[i] AS raw, trim(translate(parts[i], chr(9) || chr(11) || chr(12) || chr(13), '    '), ' ') AS line
  FROM (SELECT doc_id, site, parts, unnest(range(1, len(parts) + 1)) AS i FROM split)
), found AS (
  SELECT line, min(struct_pack(d := doc_id, p := i)) AS first FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}
), marked AS (
  SELECT l.doc_id, l.i, l.raw, f.first IS NOT NULL AND f.first <> struct_pack(d := l.doc_id, p := l.i) AS gone
  FROM lines l LEFT JOIN found f ON l.line = f.line
), joined AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept, count(*) AS n, count(*) FILTER (WHERE gone) AS removed
  FROM marked GROUP BY doc_id
)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text, coalesce(n, 0) AS n_lines, coalesce(removed, 0) AS n_removed
FROM split s LEFT JOIN joined j USING (doc_id)
"""
