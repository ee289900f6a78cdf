"""Keyword-stuffed and link-list pages.

Bagged decision trees judge pages by features of content and links; they learn from weak labels,
which a few plain conditions give to clear pages only. The prediction of a page is then moved
towards the spam rate of its host, counted over all pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.defects import STOPWORDS
from graphloom.llm.trees import BaggedTrees
from graphloom.session import materialize
from graphloom.skew import lookup_join

_URL = re.compile(r"https?://[^\s\"'<>)\]]+|www\.[^\s\"'<>)\]]+")
_ANCHOR = re.compile(r"<a\s[^<>]*>(.*?)</a>|\[([^\[\]]*)\]\([^()\s]*\)", re.I | re.S)
_WORD = re.compile(r"[^\W_]+(?:_[^\W_]+)*")
_TAG = re.compile(r"#\w+|\btags?\s*:", re.I)
_PRICE = re.compile(r"\b\d+[.,]\d\d\b(?![.,]?\d)")
_CODE = re.compile(r"[{}=\\]|->|::|/\*|\*/|\(\)|^\s*--\s|^(?:SELECT|UPDATE|SET|CREATE|EXPLAIN|INSERT|DELETE|ALTER)\b", re.M)
_LOG = re.compile(r"^(?:\S+\s){0,3}(?:LOG|DEBUG\d?|ERROR|WARNING|INFO|NOTICE|FATAL|STATEMENT|DETAIL|HINT|CONTEXT)\s*:", re.M)
_LEVELS = ("LOG", "DEBUG", "ERROR", "WARNING", "INFO", "NOTICE", "FATAL", "STATEMENT", "DETAIL", "HINT", "CONTEXT")
_LEADERS = re.compile(r"\.{3,}\s*\d+\s*$", re.M)
_PARAMETER = re.compile(r"^\s*[\w.-]+\s*(?:\([^()]*\)|=|:)\s", re.M)
_IDENTIFIER = re.compile(r"\b[a-z]+(?:_[a-z0-9]+)+\b|\b(?:[A-Z][a-z]+){2,}\b|\b[\w.-]+/[\w./-]+\.\w+")
# Function words, which sentences hold and keyword lists lack.
FUNCTION_WORDS = frozenset(w for v in STOPWORDS.values() for w in v.split()) | frozenset(
    "the a an of to and or is are was were be been has have had it its that this these those which who for with without on in at by from as if when while then than not no but so can could may must should would will each every any all only more up out into over before after until because since there they we you i he she my our your what how why where does do did between both under two about neither nor one them"
    .split()
)

FEATURES = [
    "function_share", "url_share", "links_per_word", "bare_link_share", "tag_share", "price_share", "distinct_share", "pair_cover", "top_word_share", "code_share",
    "log_share", "leader_share", "parameter_share", "identifier_share", "sentence_share", "plain_share", "log_words", "line_words", "sentence_chars", "line_repeat", "rest_pair_cover", "rest_words", "top_pair_share",
]


def features_of(text: str) -> list[float]:
    """Content and link features of a page; every one is a share or a logarithm."""
    lines = [x for x in text.split("\n") if x.strip()]
    chars = max(1, sum(map(len, lines)))
    # most pages hold no link or no markup at all; what cannot be there is not looked for
    low = text.lower()
    has_url, has_anchor = "http" in text or "www." in text, "<a" in low or "](" in text
    urls = _URL.findall(text) if has_url else []
    anchors = [a or b for a, b in _ANCHOR.findall(text)] if has_anchor else []

    def unlinked(x: str) -> str:
        x = _ANCHOR.sub(" ", x) if has_anchor else x
        return _URL.sub(" ", x) if has_url else x

    rest = unlinked(text)
    line_words = [_WORD.findall(x.lower()) for x in lines]
    words = [w for ws in line_words for w in ws] if rest is text else _WORD.findall(rest.lower())
    n = max(1, len(words))
    anchor_words = [w.lower() for a in anchors for w in _WORD.findall(a)]
    own = words + anchor_words
    m = max(1, len(own))
    pairs = Counter(zip(own, own[1:]))
    repeated = sum(c for c in pairs.values() if c >= 3)
    counts = Counter(own)
    function = sum(w in FUNCTION_WORDS for w in own) / m
    sentence_chars, other = 0, []
    for line, ws in zip(lines, line_words):
        if line.lstrip().startswith("#"):
            continue
        if has_url or has_anchor:
            line = unlinked(line)
            if not line.strip():
                continue
            ws = _WORD.findall(line.lower())
        ends = line.rstrip()[-1] in ".?!;:,)" or len(ws) >= 9
        least = 0.09 if line.rstrip()[-1] in ".?!" and len(ws) >= 6 else 0.18
        if ends and len(ws) >= 5 and sum(w in FUNCTION_WORDS for w in ws) >= least * len(ws):
            sentence_chars += len(line)
        else:
            other += ws
    other_pairs = Counter(zip(other, other[1:]))
    explained = 0
    linked = 0
    for x in lines if has_url else ():
        if _URL.search(x):
            linked += 1
            ws = _WORD.findall(unlinked(x).lower())
            explained += len(ws) >= 3 and sum(w in FUNCTION_WORDS for w in ws) >= 0.15 * len(ws) and len(set(ws)) > 0.5 * len(ws)
    starts = Counter(tuple(ws[:2]) for ws in line_words)
    return [
        function,
        sum(map(len, urls)) / chars,
        len(urls) / m,
        (linked - explained) / max(1, len(lines)) if urls else 0.0,
        (len(_TAG.findall(text)) / m if "#" in text or "tag" in low else 0.0),
        len(_PRICE.findall(rest)) / max(1, len(lines)),
        len(counts) / m**0.8,
        repeated / m,
        counts.most_common(1)[0][1] / m if own else 0.0,
        len(_CODE.findall(text)) / max(1, len(lines)),
        (len(_LOG.findall(text)) / max(1, len(lines)) if any(x in text for x in _LEVELS) else 0.0),
        (len(_LEADERS.findall(text)) / max(1, len(lines)) if "..." in text else 0.0),
        len(_PARAMETER.findall(text)) / max(1, len(lines)),
        len(_IDENTIFIER.findall(rest)) / n,
        len(re.findall(r"[.?!](?:\s|$)", rest)) / n,
        sum(w.isalpha() and w not in FUNCTION_WORDS for w in words) / n,
        float(np.log1p(len(words))),
        float(np.log1p(len(words) / max(1, len(lines)))),
        sentence_chars / chars,
        sum(c for c in starts.values() if c > 1) / max(1, len(lines)),
        sum(c for c in other_pairs.values() if c >= 3) / max(1, len(other)),
        float(np.log1p(len(other))),
        2 * max(pairs.values(), default=0) / m,
    ]


_AT = {name: i for i, name in enumerate(FEATURES)}


def weak_labels(x: np.ndarray) -> np.ndarray:
    """1 spam, 0 not, -1 unclear, by conditions that only clear pages meet."""
    at = lambda k: x[:, _AT[k]]
    listing = (at("code_share") > 0.3) | (at("log_share") > 0.2) | (at("leader_share") > 0.3) | (at("identifier_share") > 0.08) | (at("parameter_share") > 0.5)
    little = at("sentence_chars") < 0.5
    long_enough = (at("log_words") > np.log1p(12)) | (at("links_per_word") > 0.2)
    repeats = (at("top_pair_share") > 0.25) | (at("top_word_share") > 0.3)
    stuffed = repeats | ((at("pair_cover") > 0.5) & (at("function_share") < 0.14) & (at("top_pair_share") > 0.1))
    stuffed |= (at("rest_pair_cover") > 0.5) & (at("rest_words") > np.log1p(12)) & (at("top_pair_share") > 0.12)
    # short lines that begin alike and hold nothing technical
    stuffed |= (at("line_repeat") > 0.45) & (at("line_words") < np.log1p(7)) & (at("identifier_share") < 0.03) & (at("log_words") > np.log1p(25))
    linked = (at("url_share") > 0.35) & (at("bare_link_share") > 0.3)
    mixed = (at("url_share") > 0.15) & (at("bare_link_share") > 0.3) & (stuffed | (at("top_pair_share") > 0.1))
    tagged = (at("tag_share") > 0.3) | ((at("tag_share") > 0.05) & (at("price_share") > 0.4))
    spam = long_enough & ((little & (tagged | linked | mixed | (stuffed & ~listing))) | (repeats & ~listing & (at("top_pair_share") > 0.3)))
    short = (at("log_words") < np.log1p(8)) & (at("url_share") == 0) & (at("tag_share") == 0)
    told = (at("sentence_chars") > 0.6) & (at("top_pair_share") < 0.2)
    plain = (at("function_share") > 0.2) & (at("sentence_chars") > 0.4) & (at("url_share") < 0.15) & (at("tag_share") < 0.1) & (at("top_pair_share") < 0.12)
    ham = short | told | plain | (listing & ~linked & ~mixed & ~tagged & (at("url_share") < 0.15))
    return np.where(spam & ~ham, 1, np.where(ham & ~spam, 0, -1))


def train(pages: DataFrame, sample: int = 20_000) -> BaggedTrees | None:
    """Bagged trees on the clear pages among at most ``sample`` (those of lowest hash of the key)."""
    pdf = pages.where("features is not null").orderBy(F.xxhash64("doc"), "doc").limit(sample).select("features").toPandas()
    if pdf.empty:
        return None
    x = np.array(pdf["features"].tolist())
    y = weak_labels(x)
    if len(np.unique(y[y >= 0])) < 2:
        return None
    return BaggedTrees.fit(x[y >= 0], y[y >= 0].astype(float))


def scored(spark: SparkSession, documents: DataFrame, sample: int = 20_000) -> DataFrame:
    """(doc_id, host, page_score, score): the trees' score of each page, and it smoothed by its host.

    The host is that of source_url, else ``source``. Null and blank texts score 0. Rows repeated
    with one doc_id give one row (of the first text in order); a null doc_id is not scored. Features
    are taken from whole texts; only they, not the texts, go to the later stages.
    """
    host = F.coalesce(F.nullif(F.lower(F.regexp_extract(F.coalesce("source_url", F.lit("")), r"^[a-zA-Z]+://([^/?#:]+)", 1)), F.lit("")), F.col("source"))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc"), F.coalesce("text", F.lit("")).alias("text"), host.alias("host")).where("doc is not null")

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features_of(t) if t.strip() else None for t in texts], dtype=object)

    pages = docs.select("doc", "host", F.xxhash64("text").alias("h"), features("text").alias("features"))
    pages = pages.groupBy("doc").agg(F.min_by(F.struct("features", "host"), "h").alias("p"))
    pages = materialize(pages.select("doc", "p.features", "p.host"), "features")
    model = spark.sparkContext.broadcast(train(pages, sample))

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            out = np.zeros(len(rows))
            real = np.flatnonzero(rows.notna().to_numpy())
            if len(real):
                x = np.stack([np.asarray(rows.iloc[i]) for i in real])
                out[real] = model.value.score(x) if model.value is not None else (weak_labels(x) == 1)
            yield pd.Series(out)

    pages = materialize(pages.withColumn("page_score", judge("features")).select("doc", "host", "page_score"), "pages")
    everywhere = pages.agg(F.coalesce(F.avg("page_score"), F.lit(0.0))).first()[0]
    hosts = pages.where("host is not null").groupBy("host").agg(F.sum("page_score").alias("s"), F.count(F.lit(1)).alias("n"))
    hosts = hosts.select("host", ((F.col("s") + 20 * everywhere) / (F.col("n") + 20)).alias("rate"))
    joined = lookup_join(pages, hosts, "host", "left")
    logit = lambda c: F.log((c + 0.01) / (1.01 - c))
    moved = logit(F.col("page_score")) + F.coalesce(0.25 * (logit(F.col("rate")) - logit(F.lit(everywhere))), F.lit(0.0))
    return joined.select(F.col("doc").alias("doc_id"), "host", "page_score", (1 / (1 + F.exp(-moved))).alias("score"))


def spam_pages(spark: SparkSession, documents: DataFrame, sample: int = 20_000) -> DataFrame:
    """(doc_id) of pages made mainly of repeated keywords, links or tags."""
    return scored(spark, documents, sample).where("score >= 0.5").select("doc_id")
