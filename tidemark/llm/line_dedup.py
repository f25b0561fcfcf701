"""Line dedup by distinct-site spread.

Every line's hash gets a HyperLogLog sketch of the sites (sources) that hold it; sketches merge by
aggregation. Lines that the sketch puts far above the threshold are boilerplate; lines near it get
an exact distinct count of sites. A boilerplate line stays at its first place (smallest doc_id, then
smallest line number) and goes everywhere else.

Only (doc_id, line number) of lines that go are joined back to their documents, so the texts are
shuffled once and hot lines are spread by skew-aware joins. What a text is cut into stands behind
generators, which the optimizer doesn't move expressions through: a text is cut once, whatever is
asked of the result, and the work is linear in the lines of a text and in those that go.

Defined results: a null text stays null and has no lines; very long texts are taken whole; blank lines are
never boilerplate; places tie by doc_id, then line number; a null source is no site; of repeated rows each keeps or loses the same lines; rows that share a doc_id but
not a text lose only lines that they have at that place themselves; a row with a null doc_id loses
nothing; an empty table gives an empty result; the other columns of the input are kept as they are,
but that n_lines, n_removed and n_left are replaced. Equality of lines is that of 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import settle

#: Sites from which a line is boilerplate.
MIN_SITES = 8
#: 2 ** LG_K registers in a sketch; its relative error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 10
NOT_BLANK = r"[^ \t\r]"
#: Estimates within this factor of the threshold are counted exactly.
BAND = 2.0


def lines_of(df: DataFrame) -> DataFrame:
    """doc_id, site, place and line hash of each line that isn't blank."""
    rows = df.select("doc_id", F.col("source").alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    return rows.filter(F.regexp_like("line", F.lit(NOT_BLANK))).select("doc_id", "site", "place", F.xxhash64("line").alias("line"))


def boilerplate(df: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line (hash), first (doc_id and place) of each line on min_sites sites or more."""
    lines = lines_of(df)
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("doc_id", "place")).alias("first"))
    spread = spread.select("line", "first", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites / BAND)
    spread = settle(spread, "line-spread")
    near = spread.filter(F.col("sites") < min_sites * BAND)
    exact = lines.filter(F.col("site").isNotNull()).join(near.select("line"), "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites)
    return settle(spread.filter(F.col("sites") >= min_sites * BAND).select("line", "first").unionByName(near.join(exact, "line", "left_semi").select("line", "first")), "boilerplate")


def dedup_lines(df: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """df with text without the boilerplate lines that go, n_lines, n_removed and n_left (lines that
    aren't blank of what is left)."""
    found = boilerplate(df, min_sites)
    gone = lines_of(df).join(found, "line").filter(~F.struct("doc_id", "place").eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("doc_id").alias("_gone_id")).agg(F.array_sort(F.collect_set(F.struct("place", "line"))).alias("_gone"))
    rows = df.join(gone, df["doc_id"] == F.col("_gone_id"), "left").select(*[df[c] for c in df.columns], "_gone", F.explode(F.array(F.split("text", "\n", -1))).alias("_lines"))
    lines = F.col("_lines")
    # Places where this row has that line: another row of the same doc_id may have another text.
    held = F.filter("_gone", lambda g: F.xxhash64(F.get(lines, g["place"])) == g["line"])
    places = F.coalesce(F.transform(held, lambda g: g["place"]), F.array().cast("array<int>"))
    rows = rows.withColumn("_bounds", F.explode(F.array(F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines)))))).drop("_gone")
    # The runs of lines between those that go.
    bound = lambda k: F.get("_bounds", k)
    runs = F.transform(F.sequence(F.lit(1), F.size("_bounds") - 1), lambda k: F.slice(lines, bound(k - 1) + 2, bound(k) - bound(k - 1) - 1))
    left = F.when(F.size("_bounds") == 2, lines).otherwise(F.flatten(runs))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("_bounds") - 2).cast("long")
    rows = rows.withColumns({"n_lines": n_lines, "n_removed": n_removed}).withColumn("_left", F.explode(F.array(left)))
    n_left = F.coalesce(F.size(F.filter("_left", lambda x: F.regexp_like(x, F.lit(NOT_BLANK)))), F.lit(0)).cast("long")
    rows = rows.withColumns({"n_left": F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_left), "text": F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.array_join("_left", "\n"))})
    return rows.drop("_bounds", "_lines", "_left")


def line_report(df: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    out = dedup_lines(df.select("doc_id", "text", "source"), min_sites)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE_SQL = f"""
WITH parts AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, source, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM parts),
b AS (
  SELECT line, arg_min(doc_id, (doc_id, place)) AS first_doc, arg_min(place, (doc_id, place)) AS first_place
  FROM l WHERE regexp_matches(line, '[^ \\t\\r]') GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
),
gone AS (SELECT l.doc_id, list(DISTINCT l.place) AS places FROM l JOIN b USING (line) WHERE NOT (l.doc_id = b.first_doc AND l.place = b.first_place) GROUP BY l.doc_id)
SELECT p.doc_id, coalesce(len(p.lines), 0) AS n_lines, coalesce(len(g.places), 0) AS n_removed,
       sha256(coalesce(CASE WHEN g.places IS NULL THEN p.text ELSE array_to_string(
         list_transform(list_filter(list_zip(p.lines, range(len(p.lines))), lambda x: NOT list_contains(g.places, x[2])), lambda x: x[1]), chr(10)) END, '')) AS text_sha256
FROM parts p LEFT JOIN gone g USING (doc_id)
"""
