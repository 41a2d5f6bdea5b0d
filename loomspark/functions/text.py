"""Mentions, splitting, templates and rules on text columns, in built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import col, trim_all

#: Limits of user-given patterns and of the texts they run on.
MOST_PATTERN, MOST_INPUT = 100, 100_000


def brand_pattern(name: str) -> str:
    """A name as a regular expression: any white space inside, no letter or digit on either side."""
    parts = [re.escape(p) for p in name.split()]
    return r"(?iu)(?<![\p{L}\p{N}])" + r"\s+".join(parts) + r"(?![\p{L}\p{N}])"


def sentences(text: str | Column) -> Column:
    return F.filter(F.split(col(text), r"(?<=[.!?])\s+|\n+"), lambda s: trim_all(s) != "")


def find_mention(text: str | Column, name: str) -> Column:
    """struct(present, position, count): the first mention's sentence, from 1, and mentions within sentences."""
    pattern = F.lit(brand_pattern(name))
    counts = F.transform(sentences(F.coalesce(col(text), F.lit(""))), lambda s: F.regexp_count(s, pattern))
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    first = F.aggregate(F.transform(counts, lambda x, i: F.when(x > 0, i + 1)), F.lit(None).cast("int"), lambda a, x: F.coalesce(a, x))
    blank = F.lit(not name.strip())
    return F.struct((~blank & (total > 0)).alias("present"), F.when(~blank, first).alias("position"), F.when(blank, 0).otherwise(total).alias("count"))


def competitors_in(text: str | Column, names: list[str]) -> Column:
    """The names that the whole text mentions, in the order of the list."""
    own = [n for n in names if n.strip()]
    return F.array_compact(F.array(*[F.when(col(text).rlike(brand_pattern(n)), F.lit(n)) for n in own])) if own else F.array().cast("array<string>")


def snippet(text: str | Column, name: str, around: int = 240) -> Column:
    """The first mention with its surroundings; null without a mention."""
    t, pattern = col(text), F.lit(brand_pattern(name))
    at, size = F.regexp_instr(t, pattern), F.length(F.regexp_substr(t, pattern))
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, trim_all(F.substring(t, start, at + size + around - start)))


def parse_prompt_lines(text: str | Column) -> Column:
    """Lines without list marks and one quote at each end, of five characters at least."""
    lines = F.transform(F.split(col(text), r"\r?\n"), lambda x: trim_all(x))
    lines = F.transform(lines, lambda x: trim_all(F.regexp_replace(F.regexp_replace(x, r"^(?:[-*•]\s*|\d+[.)]\s*)+", ""), r"^[\"']|[\"']$", "")))
    return F.filter(lines, lambda x: F.length(x) >= 5)


def nested_quantifiers(pattern: str) -> bool:
    """Whether a group that holds a quantifier, at any depth, is itself repeated: such patterns may take time without end."""
    groups, at = [False], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "(":
            groups.append(False)
        elif c == ")" and len(groups) > 1:
            held, repeated = groups.pop(), pattern[at + 1 : at + 2] in ("+", "*", "{")
            if held and repeated:
                return True
            groups[-1] |= held or repeated
        elif c in "+*" and len(groups) > 1:
            groups[-1] = True
        at += 2 if c == "\\" else 1
    return False


def regex_guard(pattern: str) -> str | None:
    """Why a pattern, plain or as /pattern/flags, is refused, or None."""
    if len(pattern) > MOST_PATTERN:
        return f"Regex pattern too long (max {MOST_PATTERN} characters)"
    body = m[1] if (m := re.fullmatch(r"/(.+)/[a-zA-Z]*", pattern, re.S)) else pattern
    if nested_quantifiers(body):
        return "Regex pattern rejected: nested quantifiers can cause catastrophic backtracking"
    try:
        re.compile(body)
    except re.error as e:
        return f"Invalid split pattern: {e}"
    return None


def split_text(text: str | Column, mode: str = "delimiter", delimiter: str = "*", pattern: str = "", trim: bool = True, drop_empty: bool = True) -> Column:
    """struct(items, error). Modes: delimiter (literal), newline, regex (plain or /pattern/flags).

    An empty delimiter or pattern gives one item; a null or empty text none.
    """
    t = col(text)
    error = F.lit(None).cast("string")
    if mode == "newline":
        items = F.split(t, r"\r?\n", -1)
    elif mode == "delimiter":
        items = F.split(t, r"\Q" + delimiter.replace(r"\E", r"\E\\E\Q") + r"\E", -1) if delimiter else F.array(t)
    else:
        flags = ""
        if pattern and (reason := regex_guard(pattern)):
            error = F.when(F.coalesce(t, F.lit("")) != "", reason)
            return F.struct(F.array().cast("array<string>").alias("items"), error.alias("error"))
        if m := re.fullmatch(r"/(.+)/([a-zA-Z]*)", pattern, re.S):
            pattern, flags = m[1], "".join(f for f in m[2] if f in "ims")
        items = F.split(t, (f"(?{flags})" if flags else "") + pattern, -1) if pattern else F.array(t)
        error = F.when(F.length(t) > MOST_INPUT, F.lit(f"Input too long for regex mode (max {MOST_INPUT:,} characters)"))
    if trim:
        items = F.transform(items, lambda x: trim_all(x))
    if drop_empty:
        items = F.filter(items, lambda x: x != "")
    none = F.array().cast("array<string>")
    return F.struct(F.when(t.isNull() | (t == "") | error.isNotNull(), none).otherwise(items).alias("items"), error.alias("error"))


def register_split(spark, name: str = "split_text") -> None:
    """``split_text(text, mode, delimiter_or_pattern)`` as a table function of SQL: a row (ord, item) for each trimmed item that is not empty.

    For SQL alone; ``split_text`` on columns does the same without Python.
    """

    class Split:
        def eval(self, text: str, mode: str, by: str):
            if not text or (mode == "regex" and by and (regex_guard(by) or len(text) > MOST_INPUT)):
                return
            if mode == "newline":
                parts = re.split(r"\r?\n", text)
            elif mode == "regex" and by:
                m = re.fullmatch(r"/(.+)/([a-zA-Z]*)", by, re.S)
                flags = "".join(f for f in m[2] if f in "ims") if m else ""
                parts = re.split((f"(?{flags})" if flags else "") + (m[1] if m else by), text)
            else:
                parts = text.split(by) if by else [text]
            yield from enumerate(p.strip() for p in parts if p and p.strip())

    spark.udtf.register(name, F.udtf(Split, returnType="ord: int, item: string"))


def var_tags(text: str | Column) -> Column:
    """<var="name">value</var> tags as an array of struct(name, value)."""
    tag = r'(?s)<var="([^"]+)">(.*?)</var>'
    names, values = (F.regexp_extract_all(col(text), F.lit(tag), F.lit(i)) for i in (1, 2))
    return F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.alias("value")))


def fill_template(template: str | Column, variables: str | Column) -> Column:
    """struct(text, unresolved): each @name, in order, replaces all its plain occurrences; unknown names are listed once.

    As a shorter name may be the start of a longer one, "@a" also replaces inside "@ab"; that is the rule.
    """
    t, v = col(template), F.coalesce(col(variables), F.create_map().cast("map<string,string>"))
    names = F.array_distinct(F.regexp_extract_all(t, F.lit(r"@(\w+)"), F.lit(1)))
    text = F.aggregate(names, t, lambda a, n: F.when(F.map_contains_key(v, n), F.replace(a, F.concat(F.lit("@"), n), F.coalesce(F.try_element_at(v, n), F.lit("")))).otherwise(a))
    return F.struct(text.alias("text"), F.filter(names, lambda n: ~F.map_contains_key(v, n)).alias("unresolved"))


def json_from_text(text: str | Column) -> Column:
    """The first that parses: the text, a fenced block, the outermost braces."""
    t = col(text)
    fenced = F.nullif(F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    outer = F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(F.try_parse_json(t), F.try_parse_json(fenced), F.try_parse_json(outer))


def match_rule(text: str | Column, value: str, mode: str = "contains") -> Column:
    """Whether a text meets one of the comma-separated values: exact, contains, starts-with or ends-with; case and ends ignored."""
    t = F.lower(trim_all(F.coalesce(col(text), F.lit(""))))
    tests = {"exact": lambda v: t == v, "contains": t.contains, "starts-with": t.startswith, "ends-with": t.endswith}
    out = F.lit(False)
    for v in (x.strip().lower() for x in value.split(",")):
        if v:
            out = out | tests[mode](F.lit(v))
    return (t != "") & out


def classify_error(message: str | Column) -> Column:
    """struct(status, retriable) of an error's text: timeout before rate_limited before error."""
    m = col(message)
    status = F.when(m.rlike("(?i)abort|timeout"), "timeout").when(m.rlike("(?i)429|rate.?limit"), "rate_limited").otherwise("error")
    return F.struct(status.alias("status"), F.coalesce(m.rlike(r"(?i)429|5\d\d|timeout|ETIMEDOUT|ECONNRESET|ENOTFOUND|abort"), F.lit(False)).alias("retriable"))


def url_domain(url: str | Column) -> Column:
    return F.regexp_extract(col(url), r"^(?:https?://)?(?:www\.)?([^/]*)", 1)
