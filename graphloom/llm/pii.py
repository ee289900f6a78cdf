"""Personal information in free text: bootstrapped contextual extraction.

One pass over the texts cuts out candidates with their contexts: mail and postal addresses, numbers and
capitalised phrases as what they may be. Seeds - known parts of names, labelled identity numbers,
international phone numbers, complete addresses - score the contexts (patterns) they stand in, good
patterns score the parts or shapes (instances) found in them, and so on for some rounds: a graph of
patterns and instances, kept in tables and scored by joins. What is not complete in itself - a mail
address in plain words with an unknown end, a street without a town - counts only in good patterns. Patterns that proved good then name
unseen candidates, and single words that are also ordinary ones count only in such patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.newtext import CLOSINGS
from graphloom.session import materialize
from graphloom.skew import hot_keys, lookup_join

_AT = r"\s?(?:@|＠|\(at\)|\[at\]|\{at\}|<at>|&#64;|\s_?at_?\s|\(@\))\s?"
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\sdot\s)"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
EMAIL = re.compile(rf"(?<![\w.+@/-])[A-Za-z0-9](?:[\w.+'-]*[A-Za-z0-9_+])?{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}(?![\w@])", re.I)
_DIGIT = re.compile(r"\d")
_AT_SIGN = re.compile(r"[@＠]|&#64;|[(\[{<\s_]at[)\]}>\s_]", re.I)
_SPELLED_OUT = re.compile(r"\sat\s", re.I)
_MESSAGE_CONTEXT = re.compile(r"(?:message(?:[- ]?ids?)?|in-reply-to|references|msgid)\s*:?\s*[<\"']?\s*$|message-id/(?:\S*/)?$", re.I)
# The ends of host names that spelled-out addresses without a written dot may have.
TOP_LEVELS = {"com", "org", "net", "edu", "gov", "int", "info", "example", "test", "invalid", "localhost", "de", "fr", "uk", "us", "eu", "jp", "in", "au", "io", "dev", "ch", "at", "nl", "it", "es", "ru", "pl", "se", "cz", "br", "ca"}

_CAP = r"[A-ZÀ-ÖØ-ÞŠŽŁŚŐŰĆČ](?:\w|['’](?=\w))*(?:-[A-ZÀ-ÖØ-Þ](?:\w|['’](?=\w))*)*"
_TOWN = rf"{_CAP}(?: (?:(?:am|an der|im|in der|ob der|upon|sur|la|le|les|de|del|of|bei|den|der) )?{_CAP})*"
_STREET = rf"(?:{_CAP}(?: {_CAP})* )"
_POSTAL = r"(?:[A-Z]{1,2}-)?\d{4,5}(?:-\d{4})?"
ADDRESS = re.compile(
    rf"(?<![\w])(?:"
    rf"(?:Flat|Apt\.?|Apartment|Unit|Suite|Room) \w+, \d+\w? {_STREET}(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Way|Square|Court|Place|Close|Terrace|Boulevard|Blvd\.?)"
    rf"(?:, (?:{_POSTAL} )?{_TOWN}(?: {_POSTAL})?)?"
    rf"|\d+\w? {_STREET}(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Way|Square|Court|Place|Close|Terrace|Boulevard|Blvd\.?)(?:,? (?:Apt\.?|Flat|Unit|Suite|Room|#) ?\w+)?,? (?:{_POSTAL} {_TOWN}|{_TOWN}(?:,? (?:[A-Z]{{2}} )?{_POSTAL})?)"
    rf"|\d+\w?,? (?:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|calle|via|viale|rua) (?:(?:du|de la|de|des|d'|del|della|la|le|les) ?)*{_CAP}(?: {_CAP})*,? {_POSTAL} {_TOWN}"
    rf"|(?:{_CAP} )*[A-ZÀ-ÖØ-Þ][\w'’-]*?(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer|gata|gatan|vägen|straat|laan) \d+ ?[a-z]?,? {_POSTAL} {_TOWN}"
    rf"|(?:{_CAP} )+(?:Straße|Strasse|Str\.|Weg|Allee|Gasse|Platz|Ring|Damm|Ufer) \d+ ?[a-z]?,? {_POSTAL} {_TOWN}"
    rf"|(?:P\. ?O\. ?Box|PO Box|Post(?:al)? Box|Postfach|BP|Apartado) \d[\d ]*\d?, (?:{_POSTAL} )?{_TOWN}(?: {_POSTAL})?"
    rf")(?![\w])"
)
NUMBER = re.compile(r"(?<![\w.+@/#~^{-])(?:\+ ?|\()?(?:[A-Z]{1,3}-?(?=\d)|(?!ID|NO|NR)[A-Z]{2} )?\d[\d]*(?:\)?[ ./-]\(?[\d]+\)?|\) ?\d+| [A-Z](?![\w])|[A-Z](?![\w]))*(?: ?(?:ext\.?|extension|x|Durchwahl|App\.) ?\d+)?(?![\w@/]|-\w|\.\d)", re.M)
_ID_LABEL = re.compile(r"(?:ssn|social security(?: number| no\.?)?|passport(?: number| no\.?)?(?:, it is)?|tax (?:id|number|no\.?)|national (?:id|insurance)(?: number| no\.?)?|identity (?:card|number)|id (?:card|number|no\.?)|personal (?:id|number)|steuer-?id|ausweis\w*)(?: is)?:?\s*$", re.I)

_TOKEN = rf"(?:[A-ZÀ-ÖØ-Þ]\.(?:-?[A-ZÀ-ÖØ-Þ]\.)*|{_CAP})"
_PARTICLE = r"(?:van der|van den|van de|van|von der|von|de la|de las|de los|de|del|della|da|di|dos|du|le|la|ter|ten|zu|zur|bin|ibn|al|el|VAN DER|DE LA|VAN|DE|VON)"
NAME = re.compile(rf"(?<![\w@./&-])(?<!\w['’])(?:{_PARTICLE} (?={_CAP}))?{_TOKEN}(?:(?:, | )(?:{_PARTICLE} )?{_TOKEN})*(?![\w@]|-\w|\.\w)")
_NAME_PART = re.compile(rf"{_PARTICLE} {_CAP}|[A-ZÀ-ÖØ-Þ]\.|{_CAP}")
# Capitalised words that open greetings, lines and sentences and are no part of a name.
OPENERS = frozenset(
    "Hello Hi Dear Hey Hallo Good Morning Evening Afternoon Moin Bonjour Salut Hola Ciao Liebe Lieber As Thanks Thank Cc To From By Author Reviewed Reported Tested Signed Contact The A An "
    "In On At For With And But Or If When While Since After Before Le Am Il De Von Best Kind Regards Mit Monday Tuesday Wednesday Thursday Friday Saturday Sunday Mon Tue Wed Thu Fri Sat Sun "
    "January February March April June July August September October November December Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Re Fwd Aw Subject Date Sent I We You He She They It My Our Your Mr Mrs Ms Dr Prof Herr Frau".split()
)
_QUOTE = re.compile(r"^\s{0,3}(?:(?:>(?!>>>)|\||:(?=\s)|[A-Z]{1,3}>)\s?)+")
_ORGANISATION = re.compile(r"\b(?:GmbH|Ltd|Inc|Corp|LLC|AG|SA|University|Universität|Labs|Institute|Foundation|Group|Company|Team|Department|Relay|Bot|List)\b")

# Words that name streets.
_STREETS = frozenset("street st road rd avenue ave lane ln drive dr way square court place close terrace boulevard blvd rue av bd chemin impasse allée quai calle via viale rua straße strasse str weg allee gasse platz ring damm ufer".split())
#: A street with its number and nothing behind it: an address only where its surroundings say so.
STREET_ALONE = re.compile(
    rf"(?<![\w])(?:\d+\w? {_STREET}(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Way|Square|Court|Place|Close|Terrace|Boulevard|Blvd\.?)"
    rf"|[A-ZÀ-ÖØ-Þ][\w'’-]*?(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer) \d+ ?[a-z]?)(?![\w])"
)
CANDIDATES = "delivery bigint, field string, kind string, piece string, pattern string, shape string, parts array<string>"


_TOKENS = re.compile(r"[^\W\d_]+|9+|[^\w\s]")


class Shadow:
    """A line whose mail addresses are one sign and whose digits are nines, at the same places as in the line."""

    def __init__(self, line: str, mails: list[tuple[int, int]], before: str):
        out = line
        for a, b in mails:
            out = out[:a] + " E".ljust(b - a)[: b - a] + out[b:]
        self.text, self.before = _DIGIT.sub("9", out), before

    def context(self, start: int, end: int) -> str:
        """The pattern of a span: the words next to it; ^ and $ at the line's ends, with what the line before is."""
        left = _TOKENS.findall(self.text, max(0, start - 80), start)
        right = _TOKENS.findall(self.text, end, end + 80)[:1]
        low = ["9" if w[0] == "9" else w if w == "E" else w.lower() for w in (*left[-2:], *right)]
        near = low[: len(left[-2:])]
        return " ".join([self.before + "^" if len(left) < 2 else "", *near, "_", *low[len(near) :]]) + ("" if right else "$")


def _shape(text: str) -> str:
    return re.sub(r"[A-Z]", "A", _DIGIT.sub("9", text))


def _style(mail: str) -> str:
    """How a mail address is spelled: its signs with every name as one letter, and its last part."""
    return re.sub(r"[^\W_][\w'-]*", lambda m: m[0].lower() if m[0].lower() in ("at", "dot") else "a", mail[: mail.rfind(".") if "." in mail else len(mail)]) + "|" + re.split(r"[\W_]", mail)[-1].lower()


def _form(address: str) -> str:
    """An address with its names as one letter and its numbers as one nine."""
    return re.sub(r"\d+", "9", re.sub(r"[^\W\d_][\w'’-]*", lambda m: m[0].lower() if m[0].lower() in _STREETS else "a", address))


def _kind_of(line: str) -> str:
    bare = re.sub(r"[\s,.!;:–-]+$", "", line.strip()).lower()
    if not bare:
        return "blank" if not line.strip() else "rule"
    if bare in CLOSINGS:
        return "closing"
    return "text"


def email_spans(text: str) -> list[tuple[int, int]]:
    """Spans of what is a mail address by its form alone."""
    return [(a, b) for a, b, sure in mail_spans(text) if sure]


def mail_spans(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, sure) of mail addresses in one line, spelled out or not; message identifiers are none. Not sure
    is one whose sign and points are words and whose end is no known one: it could be a plain sentence."""
    if not _AT_SIGN.search(text):
        return []
    out = []
    for m in EMAIL.finditer(text):
        if _MESSAGE_CONTEXT.search(text[: m.start()]):
            continue
        spelled = not re.search(r"[@＠]|&#64;", m[0])
        host = re.split(_AT, m[0], maxsplit=1, flags=re.I)[-1]
        top = re.split(_DOT, host, flags=re.I)[-1].lower()
        if not re.match(r"^\d+$", top):
            out.append((*m.span(), not (spelled and _SPELLED_OUT.search(m[0]) and top not in TOP_LEVELS)))
    return out


def line_candidates(body: str, before: str) -> list[tuple]:
    """(kind, piece, pattern, shape, parts) of every candidate in a line; ``before`` is what the line before it is."""
    out, taken = [], []
    mails = mail_spans(body)
    shadow = Shadow(body, [(a, b) for a, b, _ in mails], before)
    for a, b, sure in mails:
        out.append(("email", body[a:b], shadow.context(a, b), _style(body[a:b]) + ("|sure" if sure else ""), None))
        if sure:
            taken.append((a, b))
    digits = len(_DIGIT.findall(body))
    if digits:
        for pattern, sure in ((ADDRESS, "|sure"), (STREET_ALONE, "")):
            for m in pattern.finditer(body):
                if not any(a < m.end() and m.start() < b for a, b in taken):
                    out.append(("address", m[0], shadow.context(*m.span()), _form(m[0]) + sure, None))
                    if sure:
                        taken.append(m.span())
    rest = body
    for a, b in taken:
        rest = rest[:a] + "\x00" * (b - a) + rest[b:]
    for m in NUMBER.finditer(rest) if digits >= 4 else ():
        piece = m[0]
        lead = len(piece) - len(piece.lstrip())
        a, b = m.start() + lead, m.end()
        piece = body[a:b].strip()
        if re.fullmatch(r"\([^()]*\)", piece):
            a, piece = a + 1, piece[1:-1]
        if piece.startswith("(") and ")" not in piece:
            a, piece = a + 1, piece[1:]
        while piece.endswith(")") and piece.count(")") > piece.count("("):
            piece = piece[:-1]
        n = len(_DIGIT.findall(piece))
        # under six digits only what is labelled as an identity number may be one
        if n < 4:
            continue
        labelled = "label" if _ID_LABEL.search(body[:a]) else ""
        if n >= 6 or labelled:
            out.append(("number", piece, shadow.context(a, a + len(piece)), _shape(piece) + "|" + labelled, None))
    for m in NAME.finditer(rest):
        a, piece = m.start(), m[0]
        # openers before the name and sentence ends behind it are not part of it
        while True:
            first = re.match(r"[\w'’-]+\.?(?:, | )?", piece)
            if first and (first[0].rstrip(" ,.") if len(first[0].rstrip(" ,.")) > 1 else first[0].rstrip(" ,")) in OPENERS:
                a += first.end()
                piece = piece[first.end() :]
                continue
            break
        if not piece or len(piece) < 2:
            continue
        # a list of names is taken apart, "family, given" is kept together
        for sub in piece.split(", ") if piece.count(", ") > 1 else [piece]:
            at = piece.find(sub)
            parts = [p.lower() for p in _NAME_PART.findall(sub)]
            if sub.lower() not in CLOSINGS and any(len(p) > 2 for p in parts):
                out.append(("name", sub, shadow.context(a + at, a + at + len(sub)), "", parts))
    return out


def candidates_of(text: str, field: str, memo: dict | None = None) -> list[tuple]:
    """(kind, piece, pattern, shape, parts) of every candidate in a text. ``memo`` keeps those of lines met
    before: quotations and signatures recur."""
    memo = {} if memo is None else memo
    out = []
    before, anchor = "start", "start"
    for raw in (text or "").split("\n"):
        line = raw.rstrip("\r")
        prefix = _QUOTE.match(line)
        body = line[prefix.end() :] if prefix and not re.match(r"^\s*\|.*\|\s*$", line) else line
        kind = _kind_of(body)
        if kind != "blank":
            found = memo.get((body, before))
            if found is None:
                found = memo[body, before] = line_candidates(body, before)
            out += found
        if field == "body" and anchor == "closing" and re.fullmatch(r"\s*[^\W\d_][\w'’-]*(?: [^\W\d_][\w'’.-]*){1,4}\s*", body) and body.strip() == body.strip().lower():
            sub = body.strip()
            parts = [p.replace("~", " ") for p in re.sub(rf"\b({_PARTICLE}) ", lambda k: k[1].replace(" ", "~") + "~", sub).replace("~ ", "~").split(" ")]
            out.append(("name", sub, "closing^ _$", "low", parts))
        if kind != "blank":
            before = anchor = kind
    return out


#: Lines whose candidates a process remembers.
REMEMBERED = 100_000


def _extract(mail: DataFrame) -> DataFrame:
    rows = mail.select(F.col("delivery_id").cast("bigint").alias("delivery"), "body", F.col("from").alias("sender")).where("delivery is not null")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict = {}
        for pdf in batches:
            out = []
            if len(memo) > REMEMBERED:
                memo.clear()
            for delivery, body, sender in zip(pdf["delivery"], pdf["body"], pdf["sender"]):
                for field, text in (("body", body), ("from", sender)):
                    if text:
                        # equal (kind, piece, pattern, shape) of one text count once
                        out += [(delivery, field, *c) for c in {c[:4]: c for c in candidates_of(text, field, memo)}.values()]
            frame = pd.DataFrame(out, columns=["delivery", "field", "kind", "piece", "pattern", "shape", "parts"])
            frame["delivery"] = frame["delivery"].astype("int64")
            yield frame

    return materialize(rows.mapInPandas(cut, CANDIDATES), "candidates")


def _score_forms(cand: DataFrame, rounds: int) -> DataFrame:
    """(delivery, field, pii_type, piece) of the numbers, mail and postal addresses whose pattern, or in rare patterns
    form, is good. All kinds are instances of one graph: the surroundings of a piece are its pattern, its shape the
    instance. Labelled numbers, international phones and complete addresses are the seeds."""
    n = cand.where("kind <> 'name'").withColumns(
        {"pattern": F.concat_ws(" ", "kind", "pattern"), "form": F.concat_ws(" ", "kind", F.regexp_replace("shape", r"\|(?:label|sure)?$", "")), "mark": F.regexp_extract("shape", r"\|(label|sure)$", 1)}
    )
    digits = F.length(F.regexp_replace("form", "[^9]", ""))
    number, marked = F.col("kind") == "number", F.col("mark") != ""
    international = number & F.col("form").rlike(r"^number \+ ?9") & (digits >= 9)
    # every different (pattern, form, mark) is judged once; how many different pieces it has weighs it
    slots = n.groupBy("kind", "pattern", "form", "mark").agg(F.countDistinct("piece").alias("m"), F.max(international).alias("far"))
    slots = materialize(slots, "slots")
    edges = slots.groupBy("pattern", "form").agg(F.sum("m").alias("m"), F.max(marked.cast("double")).alias("own_seed"), F.max((F.col("far") & ~marked).cast("double")).alias("phone_seed"))
    edges = materialize(edges, "edges")
    hot_pattern, hot_form = (materialize(hot_keys(edges.select(k), k), "hot") for k in ("pattern", "form"))
    score = edges.select("pattern", "form", "m", F.col("own_seed").alias("own"), F.col("phone_seed").alias("phone"))
    patterns = forms = None
    for _ in range(rounds):
        # patterns by their instances (forms), instances by their patterns; seeds stay what they are
        # (a pattern without a seed of its own needs three different forms to be believed)
        seeded = lambda c: (F.countDistinct("form") >= 3) | (F.max(c) >= 1)
        share = lambda c: F.sum(F.col(c) * F.col("m")) / (F.sum("m") + 1)
        patterns = score.groupBy("pattern").agg(
            F.sum("m").alias("support"), F.when(seeded("own"), share("own")).otherwise(0.0).alias("p_own"), F.when(seeded("phone"), share("phone")).otherwise(0.0).alias("p_phone")
        )
        patterns = materialize(patterns, "form-patterns")
        joined = lookup_join(edges, patterns, "pattern", hot=hot_pattern)
        forms = joined.groupBy("form").agg((F.sum(F.col("p_own") * F.col("m")) / F.sum("m")).alias("f_own"), (F.sum(F.col("p_phone") * F.col("m")) / F.sum("m")).alias("f_phone"))
        forms = materialize(forms, "forms")
        score = lookup_join(edges, forms, "form", hot=hot_form).select("pattern", "form", "m", F.greatest("own_seed", "f_own").alias("own"), F.greatest("phone_seed", "f_phone").alias("phone"))
    judged = lookup_join(lookup_join(slots, patterns, "pattern", "left", hot=hot_pattern), forms, "form", "left", hot=hot_form)
    own = F.when(marked, 1.0).when(F.col("support") >= 4, F.col("p_own")).otherwise(F.when(number, F.col("f_own") * 0.9).otherwise(0.0))
    phone = F.when(~number | marked, 0.0).when(F.col("far"), 1.0).when(F.col("support") >= 4, F.col("p_phone")).otherwise(F.col("f_phone") * 0.9)
    judged = judged.withColumns({"i": F.coalesce(own, F.lit(0.0)), "p": F.coalesce(phone, F.lit(0.0))})
    # what is no number and not complete in itself has to stand where complete ones do, in two cases of three
    kinds = F.when(number, "id_number").otherwise(F.col("kind"))
    named = F.when((F.col("i") >= F.when(number, 0.5).otherwise(0.66)) & (F.col("i") >= F.col("p")), kinds).when(F.col("p") >= 0.5, "phone")
    slot = F.concat_ws("\0", "pattern", "form", "mark")
    verdicts = materialize(judged.withColumn("pii_type", named).where("pii_type is not null").select(slot.alias("slot"), "pii_type"), "verdicts")
    return lookup_join(n.withColumn("slot", slot), verdicts, "slot").select("delivery", "field", "pii_type", "piece")


def _common_words(mail: DataFrame) -> DataFrame:
    """(part, low): how many mails hold a word in lower case, of words in three mails or more."""
    words = mail.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?<=^|[\s(])(\p{Ll}{2,})(?=[\s,;:)]|\.(?:\s|$)|$)")))).alias("part"))
    return words.where(F.col("part").rlike(r"^\p{Ll}{2,}$")).groupBy("part").agg(F.count(F.lit(1)).alias("low")).where("low >= 3")


def _score_names(cand: DataFrame, mail: DataFrame, known: DataFrame, rounds: int) -> DataFrame:
    """(delivery, field, pii_type, piece) of the names. Everything is judged once for each different (pattern, piece);
    only the verdict goes back to the rows."""
    slot = F.concat_ws("\0", "shape", "piece", "pattern")
    names = cand.where("kind = 'name'").select("delivery", "field", "piece", "pattern", "shape", "parts", slot.alias("slot"))
    strings = names.groupBy("slot", "pattern", "piece", "shape").agg(F.first("parts").alias("parts")).withColumn("organisation", F.col("piece").rlike(_ORGANISATION.pattern))
    strings = materialize(strings, "names")
    slots = materialize(strings.select("pattern", "piece", "organisation", F.explode(F.array_distinct("parts")).alias("part")).where("length(part) > 2").distinct(), "slots")
    capital = names.select("delivery", F.explode("parts").alias("part")).distinct().groupBy("part").agg(F.count(F.lit(1)).alias("cap"))
    ordinary = capital.join(_common_words(mail), "part").where(F.col("low") >= 0.05 * F.col("cap")).select("part")
    ordinary = materialize(ordinary, "ordinary")
    seeds = known.where("name_part is not null").select(F.lower("name_part").alias("part")).distinct()
    seeds = materialize(seeds.join(ordinary, "part", "left_anti").withColumn("score", F.lit(1.0)), "seeds")
    listed = known.where("name_part is not null").groupBy(F.lower("name_part").alias("part")).agg(F.lit(True).alias("listed"), (F.max(F.coalesce("kind", F.lit("")) == "given")).alias("given"))
    hot_part, hot_pattern = (materialize(hot_keys(slots.select(k), k), "hot") for k in ("part", "pattern"))
    lexicon, patterns = seeds, None
    for _ in range(rounds):
        # a pattern is as good as the share of its different fillings that hold a good part
        held = lookup_join(slots, lexicon, "part", "left", hot=hot_part).groupBy("pattern", "piece").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("good"), F.max("organisation").alias("organisation"))
        patterns = held.groupBy("pattern").agg((F.sum(F.when(F.col("organisation"), 0.0).otherwise(F.col("good"))) / (F.count(F.lit(1)) + 2)).alias("pscore"), F.count(F.lit(1)).alias("fillings"))
        patterns = materialize(patterns.where("pscore > 0.05"), "name-patterns")
        # a part is as good as the patterns it fills, once it stands in different names
        seen = lookup_join(slots, patterns, "pattern", "left", hot=hot_pattern)
        parts = seen.groupBy("part").agg(F.avg(F.coalesce("pscore", F.lit(0.0))).alias("mean"), F.max("pscore").alias("best"), F.countDistinct("piece").alias("strings"), F.countDistinct("pattern").alias("places"), F.avg(F.col("organisation").cast("double")).alias("org"))
        found = parts.where("strings >= 2 and places >= 2 and best >= 0.6 and mean >= 0.35 and org < 0.3").select("part", F.least(F.lit(0.95), F.col("mean") + 0.4).alias("score"))
        found = found.join(ordinary, "part", "left_anti").join(seeds, "part", "left_anti")
        lexicon = materialize(seeds.unionByName(found), "lexicon")
    # in good patterns even ordinary words and parts never seen elsewhere are names
    known_parts = lexicon.join(listed, "part", "full").join(ordinary.withColumn("plain", F.lit(True)), "part", "full")
    text = F.concat_ws("\0", "shape", "piece")
    texts = strings.select(text.alias("text"), "parts").dropDuplicates(["text"])
    exploded = texts.select("text", F.posexplode("parts").alias("pos", "part"))
    marks = lookup_join(exploded, materialize(known_parts, "known-parts"), "part", "left")
    marks = marks.groupBy("text").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("given", F.lit(False)).alias("given"), F.coalesce("plain", F.lit(False)).alias("plain")))).alias("marks"))
    judged = lookup_join(strings.withColumn("text", text), patterns, "pattern", "left", hot=hot_pattern)
    judged = lookup_join(judged, materialize(marks, "marks"), "text", "left")

    @F.pandas_udf("array<string>")
    def decide(pieces: pd.Series, parts: pd.Series, marks: pd.Series, pscore: pd.Series, fillings: pd.Series, organisation: pd.Series, shape: pd.Series) -> pd.Series:
        return pd.Series([name_in(p, list(q), list(m) if m is not None else [], s if s == s and s is not None else 0.0, f if f == f and f is not None else 0, o, h) for p, q, m, s, f, o, h in zip(pieces, parts, marks, pscore, fillings, organisation, shape)], dtype=object)

    judged = judged.select("slot", decide("piece", "parts", "marks", "pscore", "fillings", "organisation", "shape").alias("found"))
    verdicts = materialize(judged.where("size(found) > 0"), "verdicts")
    return lookup_join(names.select("delivery", "field", "slot"), verdicts, "slot").select("delivery", "field", F.lit("name").alias("pii_type"), F.explode("found").alias("piece"))


def name_in(piece: str, parts: list[str], marks: list, pscore: float, fillings: float, organisation: bool, shape: str) -> list[str]:
    """The names in a candidate phrase, by the marks of its parts and the score of its pattern."""
    initial = [bool(re.fullmatch(r"[^\W\d_]\.?", p)) for p in parts]
    good = [m["score"] > 0.5 for m in marks]
    maybe = [g or m["listed"] for g, m in zip(good, marks)]
    if len(marks) != len(parts):
        return []
    if shape == "low":
        return [piece] if all(x or i for x, i in zip(maybe, initial)) and any(maybe) else []
    trusted = pscore >= 0.6 and not organisation
    if ", " in piece:
        # family, given: one name; else what lies before and behind the comma, where known parts tell
        first = len(_NAME_PART.findall(piece.split(", ")[0]))
        if all(x or i for x, i in zip(maybe, initial)) and (any(good) or trusted) and not initial[0] and first <= 2 and len(parts) - first <= 2:
            return [piece]
        sides = zip(piece.split(", "), (slice(0, first), slice(first, len(parts))))
        return [n for side, k in sides for n in name_in(side, parts[k], marks[k], 0.0, 0.0, bool(_ORGANISATION.search(side)), "side")]
    if all(x or i for x, i in zip(maybe, initial)):
        if len(parts) == 1 and marks[0]["listed"] and not marks[0]["given"]:
            return []  # a family name alone may be anything
        sure = any(good) and (len(parts) > 1 or marks[0]["given"])
        return [piece] if sure or (trusted and any(maybe)) else []
    if organisation:
        return []
    unknown = [not x and not i for x, i in zip(maybe, initial)]
    if trusted and sum(unknown) == 1 and any(maybe) and len(parts) <= 4:
        return [piece]
    if trusted and all(unknown) and len(parts) == 1 and not marks[0]["plain"] and pscore >= 0.7:
        return [piece]
    if trusted and len(parts) in (2, 3) and not any(m["plain"] for m in marks) and pscore >= 0.8 and fillings >= 20:
        return [piece]
    # a name inside a longer phrase: the longest run of its parts
    spans = [m.span() for m in _NAME_PART.finditer(piece)]
    if len(spans) != len(parts):
        return []
    out, at = [], 0
    while at < len(parts):
        end = at
        while end < len(parts) and (maybe[end] or initial[end]):
            end += 1
        if end > at and sum(good[at:end]) >= 1 and end - at >= 2:
            out.append(piece[spans[at][0] : spans[end - 1][1]])
        at = max(end, at + 1)
    return out


def personal_data(spark: SparkSession, mail: DataFrame, known: DataFrame, rounds: int = 3) -> DataFrame:
    """(delivery_id, field_name, pii_type, pii_text): every distinct piece of personal data in body
    and from of each delivery.

    Null keys and texts give nothing; empty tables an empty result; repeated rows one row a piece.
    Without known names only the forms of the other types are found. Texts are read whole.
    """
    cand = _extract(mail)
    found = _score_forms(cand, rounds).unionByName(_score_names(cand, mail, known, rounds))
    found = materialize(found.distinct(), "personal")
    return found.select(F.col("delivery").alias("delivery_id"), F.col("field").alias("field_name"), "pii_type", F.col("piece").alias("pii_text"))


def masked(spark: SparkSession, mail: DataFrame, known: DataFrame) -> DataFrame:
    """(delivery_id, from, body) with every piece replaced by <TYPE>; longer pieces first, so that
    none is left half replaced. Null texts stay null."""
    pieces = personal_data(spark, mail, known)
    by = pieces.groupBy("delivery_id").agg(F.collect_list(F.struct("field_name", "pii_type", "pii_text")).alias("pieces"))
    rows = mail.select("delivery_id", "from", "body").join(by, "delivery_id", "left")

    def replaced(field: str):
        @F.pandas_udf("string")
        def run(texts: pd.Series, pieces: pd.Series) -> pd.Series:
            out = []
            for text, ps in zip(texts, pieces):
                own = {p["pii_text"]: p["pii_type"] for p in (ps if ps is not None else []) if p["field_name"] == field}
                if text and own:
                    pattern = "|".join(rf"(?<![^\W_]){re.escape(k)}(?![^\W_])" for k in sorted(own, key=lambda k: (-len(k), k)))
                    text = re.sub(pattern, lambda m: f"<{own[m[0]].upper()}>", text)
                out.append(text)
            return pd.Series(out, dtype=object)

        return run

    return rows.select("delivery_id", replaced("from")("from", "pieces").alias("from"), replaced("body")("body", "pieces").alias("body"))
