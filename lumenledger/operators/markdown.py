"""Structure and references of Markdown sources as one plan over their lines.

Fences are told apart first: the marks of a source's fence lines, one character each, form a short
text, and a pattern cuts it into blocks, each from a mark to the next one of its kind. Windows over a
source's lines then tell which lines lie in a block, which heading a line stands under (for each
level the last one before it, of which the latest of a lower level counts), and where tables
begin. Lines inside fences count as nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenledger.functions.text import slug

# What a line must look like to be a heading, a fence, a relation, a link, a file reference or a commit.
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
FENCE = r"^\s*(```+|~~~+)(.*)$"
RELATION = r"(?i)^\s*(Status|Decision|Supersedes|Contradicts|Evidence|Rollback)\s*:\s*(.+)$"
LINK = r"""(?<!!)\[[^\]]*\]\(([^)\s]+)(?:\s+["'][^"']*["'])?\)"""
FILE_REFERENCE = r"(?<![A-Za-z0-9_.-])((?:\.?[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9]+)(?![A-Za-z0-9_.-])"
COMMIT = r"(?<![0-9a-f])([0-9a-f]{7,40})(?![0-9a-f])"
TARGETED = {"supersedes": "supersedes", "contradicts": "contradicts", "evidence": "evidence", "rollback": "rollback_for"}
_LEVELS = range(1, 7)


def outside(sources: DataFrame) -> DataFrame:
    """path, line, row, role, info, under of every line that lies in no fence, and of the lines that open one.

    role is open for a fence that ends, lost for one that never does, null for other lines. under is the anchor
    of the heading that a line stands under, of a lower level if the line is a heading; anchor is a heading's own.
    """
    rows = F.split(F.col("text"), "\n", -1)
    marked = F.filter(F.transform(rows, lambda r, i: F.struct((i + 1).cast("long").alias("line"), F.substring(F.trim(F.regexp_extract(r, FENCE, 1)), 1, 1).alias("mark"))), lambda x: x["mark"] != "")
    held = sources.where(F.length("text") > 0).select("path", rows.alias("rows"), marked.alias("marked"))
    marks = F.array_join(F.transform("marked", lambda x: x["mark"]), "")
    # Every character of marks lies in one block: o opens it, i is inside, c closes it, l opens one that never ends.
    blocks = F.regexp_extract_all(marks, F.lit("`[^`]*(?:`|$)|~[^~]*(?:~|$)"), F.lit(0))
    n = F.length
    closed = lambda b: (n(b) > 1) & (F.substring(b, 1, 1) == F.substring(b, -1, 1))
    roles = lambda b: F.when(closed(b), F.concat(F.lit("o"), F.repeat(F.lit("i"), n(b) - 2), F.lit("c"))).otherwise(F.concat(F.lit("l"), F.repeat(F.lit("i"), n(b) - 1)))
    told = F.split(F.array_join(F.transform(blocks, roles), ""), "")
    fences = held.where(F.size("marked") > 0).select("path", F.inline(F.zip_with("marked", told, lambda x, r: F.struct(x["line"].alias("line"), r.alias("role")))))
    each = held.select("path", F.posexplode("rows").alias("at", "row")).select("path", (F.col("at") + 1).cast("long").alias("line"), "row")
    each = each.join(fences, ["path", "line"], "left")
    so_far = Window.partitionBy("path").orderBy("line")
    each = each.withColumn("last", F.last("role", ignorenulls=True).over(so_far)).where("role IN ('o', 'l') OR role IS NULL AND coalesce(last, 'c') = 'c'")
    level = F.when(F.col("role").isNull() & F.col("row").rlike(HEADING), F.length(F.regexp_extract("row", HEADING, 1)))
    each = each.withColumn("level", level).withColumn("title", F.when(F.col("level").isNotNull(), F.trim(F.regexp_extract("row", HEADING, 2))))
    base = F.coalesce(F.nullif(slug(F.col("title")), F.lit("")), F.concat(F.lit("heading-"), F.col("line").cast("string")))
    each = each.withColumn("base", F.when(F.col("level").isNotNull(), base))
    again = F.row_number().over(Window.partitionBy("path", "base").orderBy("line"))
    named = each.where("level IS NOT NULL").withColumn("anchor", F.concat("base", F.when(again > 1, F.concat(F.lit("-"), again.cast("string"))).otherwise("")))
    each = named.unionByName(each.where("level IS NULL").withColumn("anchor", F.lit(None).cast("string")))
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    above = {k: F.last(F.when(F.col("level") == k, F.struct("line", "anchor")), ignorenulls=True).over(before) for k in _LEVELS}
    lower = F.array_max(F.array_compact(F.array(*(F.when(F.coalesce("level", F.lit(7)) > k, F.col(f"above{k}")) for k in _LEVELS))))
    each = each.withColumns({f"above{k}": c for k, c in above.items()}).withColumn("under", F.coalesce(lower["anchor"], F.lit("document")))
    info = F.coalesce(F.nullif(F.trim(F.regexp_extract("row", FENCE, 2)), F.lit("")), F.lit("plain"))
    role = F.when(F.col("role") == "o", "open").when(F.col("role") == "l", "lost")
    return each.select("path", "line", "row", role.alias("role"), F.when(F.col("role").isNotNull(), info).alias("info"), "title", "anchor", "under")


def _is_table(row: Column) -> Column:
    return row.rlike(r"^\s*\|") & (F.length(row) - F.length(F.replace(row, F.lit("|"), F.lit(""))) >= 2)


def nodes(lines: DataFrame) -> DataFrame:
    """path, line, kind, name, qualified, parent of the lines of outside(): headings, fences, tables and stated relations.

    A fence that never ends is an unterminated_fence. A table begins where the line before, fences left out, is none of it.
    """
    at = F.col("line").cast("string")
    plain = lines.where("role IS NULL").withColumn("is_table", _is_table(F.col("row")))
    earlier = F.coalesce(F.lag("is_table").over(Window.partitionBy("path").orderBy("line")), F.lit(False))
    tables = plain.withColumn("earlier", earlier).where("is_table AND NOT earlier")
    kind = F.lower(F.regexp_extract("row", RELATION, 1))
    node = lambda k, name, qualified: (k.alias("kind"), name.alias("name"), qualified.alias("qualified"), F.col("under").alias("parent"))
    own = F.concat(F.lit("table-"), at)
    parts = (
        lines.where("anchor IS NOT NULL").select("path", "line", *node(F.lit("heading"), F.col("title"), F.col("anchor"))),
        lines.where("role IS NOT NULL").select("path", "line", *node(F.when(F.col("role") == "open", "code_fence").otherwise("unterminated_fence"), F.col("info"), F.concat(F.lit("code-"), at))),
        tables.select("path", "line", *node(F.lit("table"), own, own)),
        plain.where(F.col("row").rlike(RELATION)).select("path", "line", *node(kind, F.trim(F.regexp_extract("row", RELATION, 2)), F.concat(kind, F.lit("-"), at))),
    )
    return reduce(DataFrame.unionByName, parts)


def _walked(path: Column) -> Column:
    """A path without empty and dot steps, with each .. taking the step before it; null if it leaves the root."""
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    start = F.array(F.lit("/")).cast("array<string>")
    up = lambda at: F.when(F.size(at) > 1, F.slice(at, F.lit(1), F.size(at) - 1)).otherwise(F.array().cast("array<string>"))
    walked = F.aggregate(steps, start, lambda at, s: F.when(s != "..", F.concat(at, F.array(s))).otherwise(up(at)))
    return F.when((F.size(walked) > 1) & (F.get(walked, F.lit(0)) == "/"), F.array_join(F.slice(walked, F.lit(2), F.size(walked)), "/"))


def references(lines: DataFrame) -> DataFrame:
    """path, line, kind, stated: what the lines of outside() refer to, each once: links, files named outside of links, commits, and the files that a relation names."""
    plain = lines.where("role IS NULL")
    links = F.transform(F.regexp_extract_all("row", F.lit(LINK), F.lit(1)), lambda t: F.regexp_replace(t, "^[<>]+|[<>]+$", ""))
    files = F.transform(F.regexp_extract_all("row", F.lit(FILE_REFERENCE), F.lit(1)), lambda t: F.regexp_replace(t, "[.,;:)]+$", ""))
    bare = F.array_except(files, F.transform(links, lambda t: F.substring_index(t, "#", 1)))
    commits = F.regexp_extract_all("row", F.lit(COMMIT), F.lit(1))
    relation = F.lower(F.regexp_extract("row", RELATION, 1))
    targeted = reduce(lambda c, kv: c.when(relation == kv[0], kv[1]), TARGETED.items(), F.when(F.lit(False), ""))
    told = lambda kind, xs: F.transform(xs, lambda x: F.struct(kind.alias("kind"), x.alias("stated")))
    found = F.concat(told(F.lit("links_to"), links), told(F.lit("references_file"), bare), told(F.lit("evidence_commit"), commits), F.when(targeted.isNotNull(), told(targeted, files)).otherwise(F.array()))
    return plain.select("path", "line", F.inline(found)).distinct()


def resolved(references: DataFrame, sources: DataFrame) -> DataFrame:
    """references with target and anchor: the known path that each names, from the root if there is one, else from the source's own folder.

    A candidate has a rank, and of the known ones the best stays. External links, commits and unknown paths have no target; an
    anchor alone names the source itself.
    """
    bare = F.substring_index("stated", "#", 1)
    external = F.col("stated").rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^//") | (F.col("kind") == "evidence_commit")
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    candidates = F.when(external, F.array()).when(bare == "", F.array(F.col("path"))).otherwise(F.array(_walked(bare), _walked(F.concat(folder, bare)))).cast("array<string>")
    asked = references.select("*", F.posexplode_outer(candidates).alias("rank", "candidate"))
    known = sources.select(F.col("path").alias("candidate"), F.lit(True).alias("known")).distinct()
    best = asked.join(known, "candidate", "left").groupBy("path", "line", "kind", "stated").agg(F.min_by("candidate", F.when(F.col("known"), F.col("rank"))).alias("target"))
    anchor = F.nullif(slug(F.regexp_extract("stated", "#(.*)$", 1)), F.lit(""))
    return best.select("path", "line", "kind", "stated", "target", F.when(~external, anchor).alias("anchor"))
