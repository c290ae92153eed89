"""Text as column expressions: sentences, paragraphs, chunks, citations, roles."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_CHARS = 1500


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def plain_newlines(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def line_count(text: Column) -> Column:
    """Lines of a text; 0 for null and empty ones."""
    return F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).otherwise(0)


def plural(n: Column, word: str) -> Column:
    """A number of things in words."""
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text)


def first_line(text: Column) -> Column:
    return F.regexp_extract(text, r"^([^\r\n\x0b\x0c\x{85}\x{2028}\x{2029}]*)", 1)


def first_sentence(text: Column, cap: int = 220) -> Column:
    """Up to the first full stop that a space follows; empty for null."""
    clean = collapse(F.coalesce(text, F.lit("")))
    dot = F.instr(clean, ". ")
    return F.left(F.when(dot > 0, F.left(clean, dot)).otherwise(clean), F.lit(cap))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1, inclusive)."""
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0))), "\n")


def line_of(text: Column, pattern: str) -> Column:
    """The line, from 1, on which the first match of the pattern starts; null without one."""
    before = F.regexp_extract(text, rf"(?s)^(.*?)(?:{pattern})", 1)
    return F.when(text.rlike(pattern), F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)


def paragraphs(text: Column) -> Column:
    """What blank lines separate, as it is."""
    return F.split(text, r"\n\s*\n", -1)


def chunks(text: Column, size: int = CHUNK_CHARS) -> Column:
    """Paragraphs gathered greedily: a chunk is closed when the next one would take it beyond size.

    Each paragraph counts with the blank line after it; chunks have no white space at their ends.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, p: Column) -> Column:
        full = (F.length(acc["open"]) > 0) & (F.length(acc["open"]) + F.length(p) > size)
        done = F.when(full, F.concat(acc["done"], F.array(strip(acc["open"])))).otherwise(acc["done"])
        opened = F.concat(F.when(full, F.lit("")).otherwise(acc["open"]), p, F.lit("\n\n"))
        return F.struct(done.alias("done"), opened.alias("open"))

    def finish(acc: Column) -> Column:
        rest = strip(acc["open"])
        return F.when(F.length(rest) > 0, F.concat(acc["done"], F.array(rest))).otherwise(acc["done"])

    return F.aggregate(paragraphs(F.coalesce(text, F.lit(""))), start, add, finish)


def citations(text: Column) -> Column:
    """The numbers in [n] markers, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("long"))


def terms(text: Column) -> Column:
    """Search terms: lower-cased runs of letters, digits and underscores."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")


def json_object(text: Column) -> Column:
    """The first { to the last } of a reply, fenced or not, if that is JSON; else null."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def sanitise_label(text: Column) -> Column:
    """Without the characters that end a diagram's label."""
    return F.translate(text, "\"[]\n`", "'() '")


def clamp_fields(fields: Column, most: int = 8, chars: int = 300) -> Column:
    """A map's first `most` entries, values cut to `chars` characters."""
    return F.map_from_entries(F.transform(F.slice(F.map_entries(fields), 1, most), lambda e: F.struct(e["key"], F.left(e["value"], F.lit(chars)))))


def xml_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def parameters(signature: Column) -> Column:
    """Names in the outermost parentheses, split at commas; self, cls and non-names are left out."""
    inside = F.regexp_extract(signature, r"(?s)\((.*)\)", 1)
    names = F.transform(F.split(inside, ","), lambda p: F.trim(F.regexp_extract(p, r"^\s*\**\s*([^:=]*)", 1)))
    return F.filter(names, lambda n: n.rlike(r"^[A-Za-z_]\w*$") & ~n.isin("self", "cls"))


def return_type(signature: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(signature, r"(?s)^.*->(.*)$", 1)), F.lit(""))


# What names and paths say about a symbol's role, the first that fits.
# The boundaries are: no letter or digit on that side.
_B, _E = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
ROLE_PATTERNS = (
    ("test", rf"(^|/)tests?/|{_B}test_"),
    ("cache", rf"cach(e|ing)|redis|memoiz|{_B}lru{_E}"),
    ("queue", rf"{_B}queue{_E}|celery|kafka|{_B}mq{_E}"),
    ("worker", rf"{_B}worker{_E}|{_B}consumer{_E}|task_runner"),
    ("validator", rf"{_B}(validate|verify|sanitiz)|validator"),
    ("parser", rf"{_B}(parse|normali[sz]e|transform|extract){_E}|{_B}parser{_E}"),
    ("calculator", rf"{_B}(calculate|compute|predict|estimate|rank){_E}|{_B}model{_E}"),
    ("database", rf"{_B}repositor|{_B}backend{_E}|{_B}storage{_E}|{_B}(save|persist|fetch|query){_E}"),
    ("api", rf"{_B}route{_E}|{_B}endpoint{_E}|dispatch|{_B}view{_E}|{_B}handler{_E}"),
)


def role(qualified_name: Column, path: Column, kind: Column) -> Column:
    text = F.concat_ws(" ", qualified_name, path)
    out = None
    for name, pattern in ROLE_PATTERNS:
        fits = text.rlike(f"(?i){pattern}")
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise(F.when(kind == "class", "object").when(kind == "method", "method").otherwise("function"))


def salvage_json(raw: str) -> dict | None:
    """What a truncated reply still holds: its scenario, and the complete objects of its steps."""
    at = raw.find('"steps"')
    at = raw.find("[", at) if at >= 0 else -1
    if at < 0:
        return None
    decoder, steps, i = json.JSONDecoder(), [], at + 1
    while True:
        while i < len(raw) and raw[i] in " \t\r\n,":
            i += 1
        try:
            step, i = decoder.raw_decode(raw, i)
        except ValueError:
            break
        if isinstance(step, dict):
            steps.append(step)
    scenario = ""
    key = raw.find('"scenario"')
    if key >= 0:
        colon = raw.find(":", key)
        try:
            found, _ = decoder.raw_decode(raw[colon + 1 :].lstrip()) if colon >= 0 else ("", 0)
            scenario = found if isinstance(found, str) else ""
        except ValueError:
            pass
    return {"scenario": scenario, "steps": steps} if steps else None
