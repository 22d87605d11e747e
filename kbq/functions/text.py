"""Column functions on document text. Built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
HEADING = r"^(#{1,6})\s+(.+)$"
LINK = r"\[([^\]]*)\]\(([^)]+)\)"
FENCE = r"(?s)```(\w*)\n(.*?)```"
MARKDOWN = ["md", "markdown", "mdx"]


def once(c: Column) -> Column:
    """A generator with c as its only value, computed once: Spark copies a projected column into the conditions on it."""
    return F.explode(F.array(c))


def any_of(c: Column, parts: list[str]) -> Column:
    """Whether c, computed once, contains one of the parts: a scan of bytes, many times as fast as a pattern."""
    return F.exists(F.array(c), lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(p)) for p in parts]))


def strip(c: Column) -> Column:
    """Without white space at either end: looked for from the ends, not by a pattern at every character."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def extension(uri: Column) -> Column:
    return F.lower(F.regexp_extract(uri, r"\.([^./]*)$", 1))


def directory(uri: Column) -> Column:
    """Up to and with the last slash; empty without one."""
    return F.regexp_extract(uri, r"^(.+/)", 1)


def stem(uri: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(uri, r"^.*/", ""), r"(.)\.[^.]*$", "$1")


def domain(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:https?://)?([^/:]*)", 1)


def front_matter(text: Column) -> Column:
    """map<string,string> of the leading block's `key: value` lines; the last of equal keys wins."""
    lines = F.split(F.when(text.startswith("---"), F.regexp_extract(text, FRONT_MATTER, 1)).otherwise(""), "\n")
    pairs = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(strip(F.regexp_extract(x, "^([^:]*):", 1)), strip(F.regexp_extract(x, "^[^:]*:(.*)$", 1))))
    return F.map_from_entries(pairs)


def body(text: Column) -> Column:
    return F.when(text.startswith("---"), F.regexp_replace(text, FRONT_MATTER, "")).otherwise(text)


def headings(lines: Column) -> Column:
    """array<struct<line, level, text>> of ATX headings; fenced lines count too."""
    numbered = F.transform(lines, lambda x, i: F.when(x.startswith("#"), F.struct((i + 1).alias("line"), x.alias("text"))))
    found = F.transform(F.filter(numbered, lambda n: n.isNotNull()), lambda n: F.struct(n["line"].alias("line"), F.length(F.regexp_extract(n["text"], HEADING, 1)).alias("level"), strip(F.regexp_extract(n["text"], HEADING, 2)).alias("text")))
    return F.filter(found, lambda h: h["level"] > 0)


def underlined_headings(lines: Column) -> Column:
    """array<struct<line, level, text>> of titles with an underline of one repeated character (reStructuredText)."""
    marks = {"=": 1, "-": 2, "~": 3, "`": 4, "'": 5, '"': 6}
    level = lambda x: F.coalesce(*[F.when(F.substring(x, 1, 1) == m, F.lit(n)) for m, n in marks.items()], F.lit(2))
    under = lambda i: F.coalesce(F.try_element_at(lines, i + 2), F.lit(""))
    found = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.when(under(i).rlike(r"""^([=\-~`'"^_*+#])\1+\s*$""") & (strip(x) != ""), level(under(i))).otherwise(F.lit(0)).alias("level"), strip(x).alias("text")))
    return F.filter(found, lambda h: h["level"] > 0)


def sections(lines: Column, heads: Column) -> Column:
    """array<struct<heading, level, text, line_start, line_end>>: what follows each heading, and before the first if not blank."""
    n = F.size(lines)

    def part(start: Column, stop: Column) -> Column:
        """Lines start + 1 .. stop, 1-based, as text."""
        return strip(F.array_join(F.slice(lines, start + 1, F.greatest(stop - start, F.lit(0))), "\n"))

    def section(h: Column, i: Column) -> Column:
        following = F.try_element_at(heads, i + 2)["line"]
        stop = F.coalesce(following - 1, n)
        return F.struct(h["text"].alias("heading"), h["level"].alias("level"), part(h["line"], stop).alias("text"), h["line"].alias("line_start"), stop.alias("line_end"))

    first = F.try_element_at(heads, F.lit(1))["line"]
    stop = F.coalesce(first - 1, n)
    lead = F.struct(F.lit(None).cast("string").alias("heading"), F.lit(None).cast("int").alias("level"), part(F.lit(0), stop).alias("text"), F.lit(1).alias("line_start"), stop.alias("line_end"))
    leads = F.filter(F.array(lead), lambda s: (F.size(heads) == 0) | (s["text"] != ""))
    return F.concat(leads, F.transform(heads, section))


def paragraphs(parts: Column) -> Column:
    """array<struct<text, section_heading, line>> of the sections' blocks, without code fences and tables."""
    blocks = F.flatten(F.transform(parts, lambda s: F.transform(F.split(s["text"], "\n\n", -1), lambda p: F.struct(strip(p).alias("text"), F.coalesce(s["heading"], F.lit("")).alias("section_heading"), s["line_start"].alias("line")))))
    return F.filter(blocks, lambda p: (p["text"] != "") & ~p["text"].startswith("```") & ~p["text"].startswith("|"))


def links(lines: Column) -> Column:
    """array<struct<text, target, line, is_internal>> of Markdown links; images and mail addresses count as internal."""

    def of_line(x: Column, i: Column) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(x, F.lit(LINK), F.lit(1)).alias("text"), F.regexp_extract_all(x, F.lit(LINK), F.lit(2)).alias("target"))
        found = F.transform(pairs, lambda p: F.struct(p["text"].alias("text"), strip(p["target"]).alias("target"), (i + 1).alias("line"), (~strip(p["target"]).rlike("^https?://")).alias("is_internal")))
        return F.when(F.contains(x, F.lit("](")), found).otherwise(F.array().cast("array<struct<text:string,target:string,line:int,is_internal:boolean>>"))

    return F.flatten(F.transform(lines, of_line))


def code_blocks(text: Column) -> Column:
    """array<struct<language, text, line>> of fenced blocks; the line is that of the opening fence."""
    every = [F.regexp_extract_all(text, F.lit(FENCE), F.lit(g)) for g in (0, 1, 2)]
    rows = F.arrays_zip(F.split(text, FENCE, -1).alias("gap"), every[0].alias("whole"), every[1].alias("language"), every[2].alias("text"))
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    kind = "array<struct<language:string,text:string,line:int>>"

    def step(done: Column, r: Column) -> Column:
        line = done["line"] + breaks(r["gap"])
        one = F.array(F.struct(F.when(r["language"] == "", F.lit("text")).otherwise(r["language"]).alias("language"), r["text"].alias("text"), line.alias("line")))
        found = F.when(r["whole"].isNotNull(), F.concat(done["found"], one)).otherwise(done["found"])
        return F.struct((line + F.coalesce(breaks(r["whole"]), F.lit(0))).alias("line"), found.alias("found"))

    none = F.array().cast(kind)
    return F.when(F.contains(text, F.lit("```")), F.aggregate(rows, F.struct(F.lit(1).alias("line"), none.alias("found")), step, lambda done: done["found"])).otherwise(none)


def word_count(text: Column) -> Column:
    """Pieces between white space; texts without tabs and the like are split at single blanks, which needs no pattern."""
    rare = any_of(text, ["\t", "\x0b", "\f", "\r"])
    pieces = F.when(rare, F.split(text, r"\s+")).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "))
    return F.size(F.array_remove(pieces, "")).cast("long")


def normal_path(path: Column) -> Column:
    """The path without `.` and `..` steps, as far as they can be taken."""

    def step(done: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        return F.when((s == "") | (s == "."), done).when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def short_hash(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)
