import random

from graphloom.llm.pii import ADDRESS, candidates_of, email_spans, masked, personal_data

KNOWN = "name_part string, kind string"
MAIL = "delivery_id bigint, `from` string, body string, piece string, pattern string"


def test_mail_addresses():
    for t in ("a.b+c@x.example", "a.b at x dot example", "a (at) x (dot) example", "a[at]x.example", "A.B@X.EXAMPLE"):
        assert [t[a:b] for a, b in email_spans(t)] == [t]
    for t in ("see message <5c302496d2.66e779e13e@mail.test>", "function f@14.2 is", "HEAD@{99}", "operator @> and", "look at the list", "In-Reply-To: <x@y.test>"):
        assert email_spans(t) == []


def test_addresses():
    for t in ("70 Birkenfeld Street, 90092 Norrmark", "Old Millstraße 206a, 96502 Lower Denby", "155, rue du Ferry, 97102 Grünau am See", "P.O. Box 97652, Norrmark", "Flat 4, 48 Hollin Road, Port Ellery", "126 Larkmoor Ave., Apt. 7B, Sankt Oswin 96505"):
        assert ADDRESS.search(f"We moved to {t} last month.")[0] == t


def corpus():
    rng = random.Random(1)
    given, family = ["Torvin", "Maelis", "Oskar", "Kelwin", "Jelvira", "Mark"], ["Haldrek", "Lindqvarn", "Tselikov", "Vellamy", "Page", "Lock"]
    rows = []
    for i in range(400):
        g, f, h = rng.choice(given), rng.choice(family), rng.choice(given)
        phone = rng.choice([f"+1 555 0{i % 900 + 100} 2020", f"555-0{i % 900 + 100}", f"00 44 5550 0{i % 9000 + 1000}"])
        number = rng.choice([f"900-{i % 90 + 10}-{1000 + i}", f"X{1000000 + i}"])
        rows.append((i, f"{g} {f} <{g.lower()}.{f.lower()}@x.example>", f"Hello {h},\n\nPage Lock waits rose to {i} per second and a page may lock, mark it.\nThe build 249-{i % 90 + 10}-{1740 + i} failed.\nCall me on {phone} please.\nMy passport number is {number}.\n\nRegards\n{g} {f}", "x", "y"))
    return rows


def test_personal_data(spark):
    rows = corpus() + [(900, None, None, "x", "y"), (None, "A B <a@x.example>", "x", "x", "y"), (901, "", "word " * 3000, "x", "y"), corpus()[0]]
    known = spark.createDataFrame([("Torvin", "given"), ("Maelis", "given"), ("Oskar", "given"), ("Mark", "given"), ("Haldrek", "family"), ("Lindqvarn", "family"), ("Page", "family"), ("Lock", "family"), (None, None)], KNOWN)
    df = spark.createDataFrame(rows, MAIL)
    got = {tuple(r) for r in personal_data(spark, df, known).collect()}
    want = set()
    for i, sender, body, _, _ in corpus():
        name, address = sender[:-1].split(" <")
        lines = body.split("\n")
        want |= {(i, "from", "email", address), (i, "from", "name", name), (i, "body", "name", name), (i, "body", "name", lines[0][6:-1]), (i, "body", "phone", lines[4][11:-8]), (i, "body", "id_number", lines[5][22:-1])}
    assert len(want - got) <= 0.03 * len(want) and len(got - want) <= 0.01 * len(want)
    out = {r["delivery_id"]: r for r in masked(spark, df.where("delivery_id in (1, 900)"), known).collect()}
    assert "<EMAIL>" in out[1]["from"] and out[900]["body"] is None


def test_what_is_not_complete_counts_in_good_patterns_only(spark):
    rows = []
    for i in range(60):
        rows.append((i, None, f"Write to a{i}.b@x{i % 7}.example soon.\nHis home is at {i + 3} Hollin Road, 90{i:03d} Norrmark now.\nThe parser stops at line {i} dot com files are next.", "x", "y"))
    rows += [(900, None, "Write to jo.fay at relay dot zz soon.\nHis home is at 12 Larkmoor Street now.", "x", "y"), (901, None, "we look at it dot zz by dot.\nBench 12 Larkmoor Street was slow.", "x", "y")]
    got = {tuple(r) for r in personal_data(spark, spark.createDataFrame(rows, MAIL), spark.createDataFrame([], KNOWN)).collect() if r["delivery_id"] >= 900}
    assert got == {(900, "body", "email", "jo.fay at relay dot zz"), (900, "body", "address", "12 Larkmoor Street")}


def test_numbers_in_the_sender_and_long_names(spark):
    long = "Torvin Maelis Oskar Haldrek Lindqvarn Torvin Haldrek"
    rows = corpus()[:150] + [(900, "Torvin Haldrek +1 555 0123 2020 <t@x.example>", f"Hello Oskar,\n\nRegards\n{long}", "x", "y")]
    known = spark.createDataFrame([(n, "given") for n in ("Torvin", "Maelis", "Oskar")] + [(n, "family") for n in ("Haldrek", "Lindqvarn")], KNOWN)
    got = {tuple(r)[1:] for r in personal_data(spark, spark.createDataFrame(rows, MAIL), known).collect() if r["delivery_id"] == 900}
    assert {("from", "phone", "+1 555 0123 2020"), ("from", "email", "t@x.example"), ("from", "name", "Torvin Haldrek"), ("body", "name", long), ("body", "name", "Oskar")} <= got


def test_empty(spark):
    assert personal_data(spark, spark.createDataFrame([], MAIL), spark.createDataFrame([], KNOWN)).count() == 0
    assert candidates_of("", "body") == []
