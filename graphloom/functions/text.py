"""Scalar text functions as Column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a feature.
STOP_WORDS = tuple(
    "the for and of to a an in with on by via from using support enable adds add new allows allow provides providing improved improvement including through are is was were can cannot be being been "
    "now also into than then up down across before after it its their there within without over where command feature postgresql database data type types function functions operator operators option options".split()
)


def tokenize(c: Column) -> Column:
    """Words in lower case without empty ones, stop words and numbers."""
    words = F.split(F.lower(c), r"(?U)[^\w]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS) & ~w.rlike(r"^[0-9]+$"))


def score_text(text: Column, tokens: list[str]) -> Column:
    """Mean over the tokens of 1 for a word, 0.5 for a part of a word, else 0."""
    words = tokenize(text)

    def one_of(t: str) -> Column:
        return F.when(F.array_contains(words, t), 1.0).when(F.exists(words, lambda w: w.contains(t)), 0.5).otherwise(0.0)

    one = [one_of(t) for t in tokens]
    return sum(one[1:], one[0]) / len(tokens)


def score_path(path: Column, tokens: list[str]) -> Column:
    """The same over path segments, with 0.35 for a part."""
    segments = F.split(F.lower(path), r"[/\\.]")
    one = [F.when(F.array_contains(segments, t), 1.0).when(F.lower(path).contains(t), 0.35).otherwise(0.0) for t in tokens]
    return sum(one[1:], one[0]) / len(tokens)


def combine_scores(*scores: Column) -> Column:
    """Mean of the scores that are not zero, else zero."""
    kept = F.filter(F.array(*scores), lambda s: s != 0)
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)).otherwise(0.0)


def slug(c: Column, default: str = "feature") -> Column:
    s = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", default).otherwise(s)


def normalize_subject(c: Column) -> Column:
    """Without one leading Re: or Fwd:, without list tags, blanks collapsed."""
    s = F.regexp_replace(c, r"(?i)^\s*(?:re|fwd|fw):\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?i)\[hackers\]", ""), r"\s+", " "))


def clean_body(c: Column) -> Column:
    """Without quoted and introducing lines, up to the signature mark, at most one blank line running."""
    lines = F.split(c, "\n")
    cut = F.array_position(F.transform(lines, lambda x: F.trim(x)), "--").cast("int")
    lines = F.when(cut > 0, F.slice(lines, 1, F.greatest(cut - 1, F.lit(0)))).otherwise(lines)
    kept = F.filter(lines, lambda x: ~F.ltrim(x).startswith(">") & ~x.rlike(r"^On .*wrote:\s*$"))
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def email_address(c: Column) -> Column:
    inner = F.regexp_extract(c, "<(.+?)>", 1)
    return F.coalesce(F.when(inner != "", inner), F.trim(c))


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def truncate(c: Column, n: int, suffix: str = "... [truncated]") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - len(suffix)), F.lit(suffix))).otherwise(c)


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def component_from_path(path: Column) -> Column:
    """The segment after backend, else after include, else unknown."""
    parts = F.split(path, "/")
    after = lambda name: F.try_element_at(parts, F.nullif(F.array_position(parts, name), F.lit(0)).cast("int") + 1)
    return F.coalesce(after("backend"), after("include"), F.lit("unknown"))


def path_keywords(path: Column) -> Column:
    parts = F.split(F.regexp_replace(F.lower(path), r"\.\w+$", ""), "/")
    return F.filter(parts, lambda p: ~p.isin("src", "backend", "include", "frontend", ""))


def safe_filename(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\s]', "_"), "_+", "_"), F.lit("_"))


def split_sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def split_paragraphs(c: Column) -> Column:
    return F.split(c, r"\n\s*\n")


def sliding_windows(c: Column, size: int, step: int) -> Column:
    """Windows of ``size`` words every ``step`` words. The words are cut once: a one-element array binds them for all windows."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")

    def windows(ws: Column) -> Column:
        starts = F.when(F.size(ws) > 0, F.sequence(F.lit(0), F.size(ws) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(ws, i + 1, size), " "))

    return F.flatten(F.transform(F.array(words), windows))


def extract_functions(c: Column) -> Column:
    """Names in snake case and camel case, sorted, once each."""
    snake = F.regexp_extract_all(c, F.lit(r"\b([a-z]+(?:_[a-z0-9]+)+)\b"))
    camel = F.regexp_extract_all(c, F.lit(r"\b((?:[A-Z][a-z0-9]+){2,})\b"))
    return F.array_sort(F.array_distinct(F.concat(snake, camel)))


def extract_files(c: Column) -> Column:
    """Paths of C files, whole."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"([\w/]+\.[ch])\b"))))


def entity_prf(found: Column, expected: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two sets; both empty is perfect."""
    common, nf, ne = F.size(F.array_intersect(found, expected)), F.size(found), F.size(expected)
    both = (nf == 0) & (ne == 0)
    p = F.when(both, 1.0).when(nf == 0, 0.0).otherwise(common / nf)
    r = F.when(both, 1.0).when(ne == 0, 0.0).otherwise(common / ne)
    return p, r, F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def extract_query(c: Column, default: str = "cpg.method.name.l") -> Column:
    """The first line that starts a traversal, without comments, with a terminator."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("cpg."))
    q = F.trim(F.regexp_replace(F.try_element_at(lines, F.lit(1)), r"\s*(?://|#).*$", ""))
    q = F.when(q.rlike(r'[)"]$'), F.concat(q, F.lit(".l"))).otherwise(q)
    return F.coalesce(q, F.lit(default))


def query_issues(c: Column) -> Column:
    """What keeps a traversal from being run, as a list."""
    opened, closed = F.length(F.regexp_replace(c, r"[^(]", "")), F.length(F.regexp_replace(c, r"[^)]", ""))
    quotes = F.length(F.regexp_replace(c, '[^"]', ""))
    return F.array_compact(
        F.array(
            F.when(~c.contains("cpg."), "no-root"),
            F.when(~c.rlike(r"\.(l|toList|size|head)$"), "no-terminator"),
            F.when(c.rlike(r"(?i)delete|drop|remove|clear"), "forbidden"),
            F.when(opened != closed, "parentheses"),
            F.when(quotes % 2 != 0, "quotes"),
            F.when(c.contains(".."), "double-dot"),
        )
    )
