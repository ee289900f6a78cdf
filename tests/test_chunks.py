import random
import re

from graphloom.plans import catalog


def chunks(text):
    """The reference's packing (pg_books/content_chunker.py) with estimated tokens, on the joined text."""
    out, now, sep = [], "", ""
    for para in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if not para:
            continue
        if len(para) // 4 > 1000:
            if now:
                out.append(now)
            now = ""
            pieces, after = [s.strip() for s in re.split(r"(?<=[.!?])\s+", para) if s.strip()], " "
        else:
            pieces, after = [para], "\n\n"
        for s in pieces:
            if now and len(now + sep + s) // 4 > 1000:
                out.append(now)
                now = ""
            now, sep = now + sep + s if now else s, after
    return out + [now] if now else out or [text]


def test_long_paragraphs_are_packed_by_sentences(spark, tmp_path):
    rng = random.Random(3)

    def sentence():
        return " ".join(rng.choices(["page", "lock", "buffer", "is", "read"], k=rng.randint(3, 40))) + rng.choice(".!?")

    texts = ["", " \n\n ", "one.", "x" * 9000, "a.\n\n" + "y" * 4500 + ". b.\n\nc."]
    for _ in range(40):
        paragraphs = [rng.choice([" ", "\n"]).join(sentence() for _ in range(rng.choice([1, 5, 30, 80]))) for _ in range(rng.randint(1, 12))]
        texts.append(rng.choice(["", "\n "]) + rng.choice(["\n\n", "\n \t\n"]).join(paragraphs))
    spark.createDataFrame(list(enumerate(texts)) + [(900, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["chunk_no"]): r["chars"] for r in catalog.QUERIES["chunk_semantic"](spark, str(tmp_path)).collect()}
    assert got == {(n, k): len(c) for n, t in enumerate(texts) for k, c in enumerate(chunks(t))}
    assert max(v for (n, _), v in got.items() if n > 4) < 4004
