"""The text newly written in an email.

A body is cut into blocks: runs of lines of one kind within a paragraph. Blocks are classified by
gradient-boosted trees on contact density, quote depth, frequency of the lines among all mails and
those of the sender, overlap with the ancestors' text, and place in the mail. The labels come from
the mails themselves: lines that a reply quotes at the first level were written by the replied-to
sender, lines behind quote marks that stand in an ancestor were not, and the conventional forms of
signatures, notices and footers are not new text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.conversations import bare_identifier, instant_of, sender_address
from graphloom.llm.trees import BoostedTrees
from graphloom.session import materialize
from graphloom.skew import lookup_join

QUOTE = re.compile(r"^\s{0,3}(?:(?:>|\||:(?=\s|$)|[A-ZÀ-Þ]{1,3}>|%(?=\s))\s?)+")
_MARKS = frozenset(">|:%ABCDEFGHIJKLMNOPQRSTUVWXYZ") | frozenset(map(chr, range(0xC0, 0xDF)))
_TABLE = re.compile(r"^\s*\|.*\|\s*$")
_HEADER = re.compile(r"^\*?(?:From|De|Von|Da|Sent|Gesendet|Envoyé|Enviado|Date|Datum|Fecha|To|An|À|Para|Cc|Subject|Betreff|Objet|Asunto|Reply-To|Message-ID)\*?\s?:\*?\s", re.I)
_SEPARATOR = re.compile(r"^\s*(?:-{3,}\s*[^-\s].*?-{3,}|-{3,}\s*(?:original|forwarded|ursprüngliche|message|weitergeleitete).*|\*\s\*\s\*|_{20,}|={5,}|Begin forwarded message:)\s*$", re.I)
_DELIMITER = re.compile(r"^(?:--|--\s|—|–|_{4,}|-{3,}|={3,}|\*{3,}|~{3,})\s*$")
_INTRO_END = re.compile(
    r"(?:\b(?:wrote|writes|said|says|schrieb|écrit|escribió|escreveu|ha scritto|napisał|skrev)\b[^:]{0,80}:\s*$|^>{3,}\s*\S.*\bat\b|^\*\s.*\(.*\)\s*\[.*\]:?\s*$"
    r"|\bsaid on\b.*:\s*$|\bschrieb\b.*:\s*$|\ba\s+écrit\s*:\s*$|^In (?:message|article) .*:\s*$)",
    re.I,
)
_DATE = re.compile(r"\b\d{4}-\d{2}-\d{2}|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}|\b\d{1,2}:\d{2}\b|\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\b")
_CONTACT = re.compile(r"[^\s<>()]+@[^\s<>()]+|https?://\S+|www\.\S+|(?:\+|00|\b0)\s?\d[\d\s./()-]{6,}\d|\b\d{3}[ .-]\d{3,4}\b|\bext\.|\b(?:phone|tel|mob|mobile|fax)\b", re.I)
_CONTACT_SIGNS = frozenset("@:+0123456789")
_CONTACT_WORD = re.compile(r"www\.|ext\.|phone|tel|mob|fax", re.I)
# Closing formulas, and words of notices and list footers.
CLOSINGS = {
    "regards", "kind regards", "best regards", "best", "thanks", "thanks in advance", "thank you", "many thanks", "cheers", "sincerely", "yours", "yours sincerely",
    "best wishes", "warm regards", "with kind regards", "rgds", "br", "thx", "ciao", "greetings", "mit freundlichen grüßen", "viele grüße", "freundliche grüße",
    "beste grüße", "liebe grüße", "gruß", "grüße", "mfg", "cordialement", "bien cordialement", "salutations", "amicalement", "saludos", "un saludo", "atentamente",
    "saludos cordiales", "cordiali saluti", "saluti", "met vriendelijke groet", "groeten", "atenciosamente", "abraços", "с уважением", "pozdrawiam", "vriendelijke groeten",
    "bis dann", "kind regards and thanks", "all the best", "take care", "yours truly", "respectfully", "hth", "thanks and regards",
}
_NOTICE = re.compile(
    r"privileged|confidential|liabilit|intended (?:only )?(?:for|recipient)|registered office|register no|virus|disclaimer|copying or|passing it on|unless agreed|strictly prohibited|"
    r"^sent (?:from|via|with) (?!.*\d)(?!.*:)|^get \w+ for |^von meinem .* gesendet|^envoyé de|^enviado desde|sorry for typos|this e-?mail and any|think of the environment|consider the environment|vertraulich",
    re.I,
)
_FOOTER = re.compile(r"mailing list|^to (?:leave|unsubscribe|make changes)|unsubscribe|you (?:are )?receiv\w* this (?:because|message)|~--~|^list (?:info|archive)|^archives?:|manage your subscription|follow the .* list", re.I)
# one of these stands in every line that the two patterns above can fit; looking for them first is cheaper
_NOTICE_SIGNS = ("privileged", "confidential", "liabilit", "intended ", "registered office", "register no", "virus", "disclaimer", "copying or", "passing it on", "unless agreed", "strictly prohibited", "sent ", "get ", "von meinem", "envoyé de", "enviado desde", "sorry for typos", "mail and any", "the environment", "vertraulich")
_FOOTER_SIGNS = ("mailing list", "to leave", "to make changes", "unsubscribe", "receiv", "~--~", "list info", "list archive", "archive", "manage your subscription", "follow the")


def _hits(pattern: re.Pattern, signs: tuple[str, ...], line: str) -> bool:
    low = line.lower()
    return any(x in low for x in signs) and pattern.search(line) is not None


_GREETING = re.compile(r"^(?:hi|hello|hey|hallo|dear|good (?:morning|afternoon|evening|day)|moin|bonjour|salut|hola|ciao|guten tag|liebe[rs]?|all)\b[^.?!]{0,40}[,!]?\s*$", re.I)
_WORD = re.compile(r"\w+")

FEATURES = [
    "depth", "overlap", "contacts", "global_rate", "sender_frequency", "intro", "in_forward", "header", "separator", "delimiter", "after_delimiter", "closing",
    "after_closing", "notice", "footer", "name", "words", "lines", "sentence", "greeting", "from_end", "from_start", "next_depth", "before_depth", "before_blank", "cleaned",
]


def strip_quote(line: str) -> tuple[int, str]:
    """(depth, text) of a line without its quote marks; tables drawn with bars are no quotes."""
    # most lines have no mark, nor a capital that an initial could be, before their fifth sign
    if ">" not in line[:8] and line[:4].strip()[:1] not in _MARKS:
        return 0, line
    if _TABLE.match(line) and not line.lstrip().startswith(">"):
        return 0, line
    m = QUOTE.match(line)
    if not m:
        return 0, line
    return len(re.findall(r"[>|:%]", m[0])), line[m.end() :]


def _grams(words: list[str]) -> list[tuple[str, ...]]:
    n = min(4, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


class Ancestors:
    """Word runs of the earlier mails a message may repeat; runs of a length are made when a line first asks for them."""

    def __init__(self, bodies: list[str]):
        self.words = [w for body in bodies for line in (body or "").split("\n") for w in _WORD.findall((strip_quote(line)[1] if line[:4].strip()[:1] in _MARKS else line).lower())]
        self.runs: dict[int, set] = {}

    def overlap(self, text: str) -> float:
        if not self.words:
            return 0.0
        grams = _grams(_WORD.findall(text.lower()))
        if not grams:
            return 0.0
        n = len(grams[0])
        if n not in self.runs:
            self.runs[n] = set(zip(*(self.words[i:] for i in range(n))))
        known = self.runs[n]
        return sum(g in known for g in grams) / len(grams)


def _mean(values: list) -> float:
    return sum(values) / len(values)


def blocks_of(body: str, bodies: list[str], sender: str, frequency: dict[int, tuple[float, float]], cleaned: str | None = None) -> tuple[list[list[int]], np.ndarray]:
    """(line numbers of each block, features of each block). ``frequency`` has, by line number from
    1, in which share of all mails and in how many of the sender's the line stands; ``cleaned`` is what
    an earlier cleaning left of the body, a hint that may be wrong or missing."""
    kept = None if cleaned is None else {x.strip() for x in cleaned.split("\n")}
    lines = [x.rstrip("\r") for x in body.split("\n")]
    n = len(lines)
    old = Ancestors(bodies)
    stripped = [strip_quote(x) for x in lines]
    blank = [not x.strip() for x in lines]
    depth = [d if t.strip() or d else 0 for d, t in stripped]
    overlap = [0.0 if blank[i] or _GREETING.match(stripped[i][1].strip()) else old.overlap(stripped[i][1]) for i in range(n)]
    name_words = {w.lower() for w in _WORD.findall(re.sub(r"\S+@\S+", "", sender or ""))}
    name_words |= {w.lower() for w in re.split(r"[._+\d@-]+", (re.search(r"([^\s<>()]+)@", sender or "") or [""])[0]) if len(w) > 1}

    following = [None] * n  # the next line that is not blank
    nxt = None
    for i in range(n - 1, -1, -1):
        following[i] = nxt
        if not blank[i]:
            nxt = i

    intro = [False] * n
    for i in range(n):
        if blank[i] or depth[i] and not lines[i].startswith(">>>"):
            continue
        f = following[i]
        joined = lines[i] + " " + (lines[f] if f is not None and not depth[f] else "")
        for text, last in ((lines[i], i), (joined, f)):
            # an introduction ends in a colon or bracket, or is marked by a run of angles
            if last is None or intro[i] or (text.rstrip()[-1:] not in (":", "]") and not text.startswith(">>>")):
                continue
            after = following[last]
            quoted = after is not None and (depth[after] > 0 or overlap[after] > 0.6)
            if _INTRO_END.search(text.strip()) and (quoted or _DATE.search(text) and re.search(r"[:\]]\s*$", text) or text.startswith(">>>>")):
                if last != i and (last != i + 1 or _INTRO_END.search(lines[last].strip()) and len(lines[i]) < 25 and not _DATE.search(lines[i])):
                    continue
                for k in range(i, last + 1):
                    intro[k] = True
                    depth[k] = 0
    is_footer = [not blank[i] and _hits(_FOOTER, _FOOTER_SIGNS, lines[i]) for i in range(n)]
    header = [False] * n
    forward = [False] * n
    separator = [bool(_SEPARATOR.match(x)) for x in lines]
    is_header = [bool(":" in x and _HEADER.match(x)) and not depth[i] for i, x in enumerate(lines)]
    inside = False
    for i in range(n):
        f = following[i]
        starts = is_header[i] and ((i + 1 < n and is_header[i + 1]) or (i > 0 and is_header[i - 1]) or (i > 0 and header[i - 1]))
        if separator[i] and f is not None and (is_header[f] or "orig" in lines[i].lower() or "forward" in lines[i].lower() or "ursprüng" in lines[i].lower()):
            inside, header[i] = True, True
        elif starts or (inside and is_header[i] and i > 0 and header[i - 1]):
            inside, header[i] = True, True
        elif inside and (is_footer[i] or _DELIMITER.match(lines[i]) and f is not None and is_footer[f]):
            inside = False
        forward[i] = inside
    footer, notice = [False] * n, [False] * n
    start = 0
    for i in range(n + 1):
        if i == n or blank[i]:
            para = [k for k in range(start, i) if not depth[k]]
            if para:
                at = [k for k in para if len(lines[k]) < 120 and is_footer[k]]
                if at:
                    first = min(at)
                    if first - 1 in para and (_DELIMITER.match(lines[first - 1]) or re.match(r"^[-_~=*\s]{4,}$", lines[first - 1])):
                        first -= 1
                    for k in para:
                        footer[k] = k >= first
                hits = [k for k in para if _hits(_NOTICE, _NOTICE_SIGNS, lines[k])]
                if hits and not forward[para[0]]:
                    for k in para:
                        notice[k] = k >= min(hits)
            start = i + 1
    delimiter, after_delimiter = [False] * n, [False] * n
    closing, after_closing = [False] * n, [False] * n
    state = None
    begun = False
    for i in range(n):
        if blank[i]:
            if state == "delimiter" and begun:
                state = None
            continue
        f = following[i]
        if depth[i] or intro[i] or header[i] or forward[i] or footer[i] or notice[i]:
            state = None
            continue
        bare = re.sub(r"[\s,.!;:–-]+$", "", lines[i].strip()).lower()
        if _DELIMITER.match(lines[i]) and i + 1 < n and not blank[i + 1] and len(lines[i + 1]) < 80:
            state, begun = "delimiter", False
            delimiter[i] = True
        elif bare in CLOSINGS and (f is None or len(lines[f]) < 60 or depth[f] or intro[f]):
            state = "closing"
            closing[i] = True
        elif state == "delimiter":
            after_delimiter[i] = begun = True
        elif state == "closing":
            short = len(_WORD.findall(lines[i])) <= 9 or bool(_CONTACT.search(lines[i]))
            if short and not re.search(r"[.?]$", lines[i].strip()):
                after_closing[i] = True
            else:
                state = None

    kinds = [
        (depth[i] > 0, intro[i], header[i], forward[i], footer[i], notice[i], delimiter[i], after_delimiter[i], closing[i], after_closing[i], overlap[i] > 0.8, bool(_GREETING.match(lines[i].strip())))
        for i in range(n)
    ]
    blocks: list[list[int]] = []
    for i in range(n):
        if blank[i]:
            continue
        if blocks and blocks[-1][-1] == i - 1 and kinds[i] == kinds[i - 1]:
            blocks[-1].append(i)
        else:
            blocks.append([i])
    full = [i for i in range(n) if not blank[i]]
    x = np.zeros((len(blocks), len(FEATURES)))
    for b, block in enumerate(blocks):
        text = [stripped[i][1] if depth[i] else lines[i] for i in block]
        words = [_WORD.findall(t) for t in text]
        count = max(1, sum(map(len, words)))
        i, j = block[0], block[-1]
        f = following[j]
        freq = [frequency.get(k + 1, (0.0, 1.0)) for k in block]
        x[b] = [
            _mean([depth[k] for k in block]), _mean([overlap[k] for k in block]), sum(len(_CONTACT.findall(t)) for t in text if any(c in _CONTACT_SIGNS for c in t) or _CONTACT_WORD.search(t)) / len(block),
            math.log1p(1e4 * _mean([v[0] for v in freq])), math.log1p(_mean([v[1] for v in freq])), intro[i], forward[i], header[i], separator[i] and not blank[i], delimiter[i],
            after_delimiter[i], closing[i], after_closing[i], notice[i], footer[i],
            sum(w.lower() in name_words for ws in words for w in ws) / count, min(60, count / len(block)), len(block),
            _mean([t.rstrip()[-1:] in (".", "?", "!", ";", ":") for t in text]), kinds[i][-1], len(full) - full.index(j) - 1, full.index(i),
            depth[f] if f is not None else 0, depth[blocks[b - 1][-1]] if b else 0, i == 0 or blank[i - 1],
            0.5 if kept is None else _mean([lines[k].strip() in kept for k in block]),
        ]
    return [[k + 1 for k in block] for block in blocks], x


_AT = {name: i for i, name in enumerate(FEATURES)}


def weak_labels(x: np.ndarray, quoted: np.ndarray) -> np.ndarray:
    """1 new, 0 not new, -1 unknown, of blocks. ``quoted``: share of the block's lines that a reply
    to the mail quotes at the first level."""
    at = lambda k: x[:, _AT[k]]
    form = sum(at(k) for k in ("intro", "in_forward", "header", "delimiter", "after_delimiter", "closing", "after_closing", "notice", "footer")) > 0
    old = (at("depth") > 0) | (at("overlap") > 0.8)
    # a line in one of 250 mails that greets nobody is no one's own
    common = (at("global_rate") > np.log1p(40)) & (at("greeting") == 0)
    label = np.where(form | old | common, 0, np.where((quoted > 0.5) | (at("greeting") > 0) | (at("words") >= 4), 1, -1))
    return np.where((quoted > 0.5) & ~form & ~common & (at("depth") == 0), 1, label)


def _line_frequencies(rows: DataFrame) -> DataFrame:
    """(msg, entries) with entries (line_no, rate, n_sender) of lines that stand in five mails or more."""
    lines = rows.select("msg", "sender", F.posexplode(F.split("body", "\n")).alias("p", "line"))
    lines = lines.where(F.trim("line") != "").select("msg", (F.col("p") + 1).alias("line_no"), F.xxhash64(F.trim("line")).alias("h"), F.xxhash64(F.trim("line"), "sender").alias("k"))
    lines = materialize(lines, "lines")
    by_sender = materialize(lines.groupBy("h", "k").agg(F.count(F.lit(1)).alias("n_sender")), "by-sender")
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    overall = by_sender.groupBy("h").agg(F.sum("n_sender").alias("n_all")).where("n_all > 4")
    overall = overall.select("h", (F.col("n_all") / total).alias("rate"))
    repeated = materialize(lookup_join(lines, materialize(overall, "frequent"), "h"), "repeated")
    counts = by_sender.where("n_sender > 1").select("k", "n_sender").dropDuplicates(["k"])
    joined = lookup_join(repeated, counts, "k", "left")
    return joined.groupBy("msg").agg(F.collect_list(F.struct("line_no", "rate", F.coalesce("n_sender", F.lit(1)).alias("n_sender"))).alias("entries"))


def ancestor_pairs(links: DataFrame) -> DataFrame:
    """(id, ancestor, level) of every message and every message above it, of (id, up) pairs. Paths are doubled each
    round, so the rounds grow with the logarithm of the depth; in a circle each pair is met once and the search ends."""
    first = links.where("up is not null and up <> id").select("id", F.col("up").alias("ancestor"), F.lit(1).alias("level")).distinct()
    pairs, far, reach = materialize(first, "above"), None, 1
    while True:
        far = pairs.where(F.col("level") == reach)
        upper = pairs.select(F.col("id").alias("mid"), F.col("ancestor").alias("top"), F.col("level").alias("more"))
        longer = far.select("id", F.col("ancestor").alias("mid")).join(upper, "mid").where("top <> id").groupBy("id", F.col("top").alias("ancestor")).agg((F.min("more") + reach).alias("level"))
        longer = materialize(longer.join(pairs.select("id", "ancestor"), ["id", "ancestor"], "left_anti"), "above")
        if not longer.take(1):
            return pairs
        pairs, reach = pairs.unionByName(longer), 2 * reach


def own_lines(body: Column) -> Column:
    """The lines of a body that bear no quote mark."""
    return F.array_join(F.filter(F.split(body, "\n"), lambda x: ~x.rlike(r"^\s{0,3}[>|]")), "\n")


def prepared(rows: DataFrame) -> DataFrame:
    """One row per message: body, sender, frequencies of its lines, and the texts of its ancestors, all the way
    up: the parent's whole body, and what further ones added to theirs without quote marks."""
    base = rows.select(
        F.col("msg_key").cast("bigint").alias("msg"),
        bare_identifier(F.col("message_id")).alias("id"),
        bare_identifier(F.col("parent_id")).alias("up"),
        F.col("from").alias("sender_field"),
        F.coalesce(sender_address(F.col("from")), F.lit("")).alias("sender"),
        instant_of(F.col("date")).alias("at"),
        "body",
        (F.col("cleaned_body") if "cleaned_body" in rows.columns else F.lit(None).cast("string")).alias("cleaned"),
    ).where("msg is not null and body is not null")
    others = [c for c in base.columns if c != "msg"]
    base = base.groupBy("msg").agg(F.min(F.struct(*others)).alias("r")).select("msg", "r.*")
    base = materialize(base, "bodies")
    by_id = base.where("id is not null").groupBy("id").agg(F.min_by(F.struct("up", "body", "at"), "msg").alias("m"))
    by_id = materialize(by_id.select("id", "m.up", "m.at", "m.body"), "by-id")
    # first only identifiers climb; then the texts are fetched once. What was sent later is no ancestor
    parents = base.where("up is not null and not up <=> id").select("msg", "at", F.col("up").alias("id"))
    pairs = ancestor_pairs(by_id.select("id", "up"))
    above = parents.join(pairs, "id").select("msg", "at", F.col("ancestor").alias("id"), "level")
    found = materialize(parents.withColumn("level", F.lit(0)).select("msg", "at", "id", "level").unionByName(above), "ancestor-ids")
    texts = by_id.select("id", F.col("at").alias("_at"), "body", own_lines(F.col("body")).alias("own"))
    found = lookup_join(found, texts, "id").where(~F.coalesce(F.col("_at") >= F.col("at"), F.lit(False)))
    text = F.when(F.col("level") == 0, F.col("body")).otherwise(F.col("own"))
    old = found.groupBy("msg").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", text.alias("text")))), lambda x: x["text"]).alias("old"))
    lines = _line_frequencies(base.select("msg", "sender", "body"))
    df = base.join(old, "msg", "left").join(lines, "msg", "left")
    return df.select("msg", "id", "sender_field", "body", "cleaned", "old", "entries")


def _blocks(row) -> tuple[list[list[int]], np.ndarray]:
    frequency = {e["line_no"]: (e["rate"], e["n_sender"]) for e in row.entries} if row.entries is not None else {}
    return blocks_of(row.body, list(row.old) if row.old is not None else [], row.sender_field or "", frequency, row.cleaned)


def train(spark: SparkSession, ready: DataFrame, rows: DataFrame, sample: int = 3000) -> BoostedTrees:
    """Boosted trees on the blocks of at most ``sample`` messages (those of lowest hash of the key),
    labelled by :func:`weak_labels`; the replies' quotes of just these messages are looked up."""
    chosen = ready.orderBy(F.xxhash64("msg"), "msg").limit(sample)
    chosen = materialize(chosen, "sample")
    ids = chosen.select("id").where("id is not null").distinct()
    replies = rows.select(bare_identifier(F.col("parent_id")).alias("id"), "body").join(F.broadcast(ids), "id", "left_semi")
    quoted = replies.select("id", F.explode(F.split("body", "\n")).alias("line")).where(F.col("line").rlike(r"^\s?>\s?[^>\s]"))
    quoted = quoted.select("id", F.trim(F.regexp_replace("line", r"^\s?>\s?", "")).alias("line")).distinct()
    # only lines that the mail itself holds count, so a mail gets no more of them than it has lines
    own = chosen.where("id is not null").select("id", F.explode(F.split("body", "\n")).alias("line")).select("id", F.trim("line").alias("line")).distinct()
    quoted = own.join(quoted, ["id", "line"], "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("line")).alias("quoted"))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xs, ys = [], []
            for row in pdf.itertuples():
                blocks, x = _blocks(row)
                if not blocks:
                    continue
                lines = row.body.split("\n")
                seen = set(row.quoted) if isinstance(row.quoted, (list, np.ndarray)) else set()
                share = np.array([np.mean([lines[k - 1].strip() in seen for k in b]) for b in blocks])
                y = weak_labels(x, share)
                xs += list(x[y >= 0])
                ys += list(y[y >= 0].astype(float))
            yield pd.DataFrame({"x": pd.Series(xs, dtype=object), "y": pd.Series(ys, dtype="float64")})

    # the blocks are made and labelled by the executors; only numbers come to the driver
    pdf = chosen.join(quoted, "id", "left").mapInPandas(label, "x array<double>, y double").toPandas()
    if pdf.empty or pdf["y"].nunique() < 2:
        return BoostedTrees([], 0.0, 0.2)
    return BoostedTrees.fit(np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy())


def new_lines(spark: SparkSession, rows: DataFrame, sample: int = 3000) -> DataFrame:
    """(msg_key, line_no) of the lines newly written by the sender of each message.

    Null or blank bodies and null keys give nothing; a null sender or a missing parent only leaves
    its evidence out; repeated rows of one key count once. Whole bodies are read. Further columns
    are not. An empty table gives an empty result.
    """
    ready = materialize(prepared(rows), "prepared")
    model = spark.sparkContext.broadcast(train(spark, ready, rows, sample))

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, blocks, xs = [], [], []
            for row in pdf.itertuples():
                bs, x = _blocks(row)
                keys += [row.msg] * len(bs)
                blocks += bs
                xs.append(x)
            new = model.value.score(np.concatenate(xs)) >= 0.5 if blocks else []
            out = [(k, line) for k, b, yes in zip(keys, blocks, new) if yes for line in b]
            yield pd.DataFrame(out, columns=["msg_key", "line_no"]).astype("int64")

    spread = ready.repartition(spark.sparkContext.defaultParallelism * 2)
    return spread.mapInPandas(classify, "msg_key bigint, line_no bigint")
