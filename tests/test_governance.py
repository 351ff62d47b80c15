"""Redaction against an independent pattern loop, classification and flow cases."""

import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tillwork import schemas
from tillwork.functions import redaction
from tillwork.operators import governance as gov
from tillwork.operators.quality import enforce
from tillwork.registry.payments import fct


def plain_redact(text):
    """Reference behaviour spelt out with Python's regular expressions."""
    def passes(run):
        digits = [int(c) for c in run if c.isdigit()]
        doubled = [d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9) for i, d in enumerate(reversed(digits))]
        return sum(doubled) % 10 == 0

    hits = 0
    out, last = [], 0
    for m in re.finditer(r"\b(?:\d[ -]?){12,18}\d\b", text):
        if passes(m.group()):
            out += [text[last:m.start()], "[REDACTED_CARD]"]
            last, hits = m.end(), hits + 1
    text = "".join(out) + text[last:]
    text, n = re.subn(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]", text)
    text, m = re.subn(r"(?<!\w)(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)", "[REDACTED_PHONE]", text)
    return text, hits + n + m


def redacted(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    return [(r["text"], r["redactions"]) for r in redaction.redact(df, "text").orderBy("id").collect()]


def with_check_digit(digits):
    """The digits and the one that makes their Luhn sum a multiple of ten."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return digits + str(-total % 10)


def test_known_cases(spark):
    card = with_check_digit("620000731894052")
    spaced = " ".join(card[i:i + 4] for i in range(0, 16, 4))
    texts = [f"Write to kim@shop.example, ring 604.555.0123 or use {spaced} instead", "parcel 7000000000000001 left on 2025-02-03 for 12.50",
             f"a@b.co.x@d.com é{card} {card}é", f"{spaced} 123", "٤" * 16, "", "+1 (403) 555 0199 and 1.403.555.0199x"]
    got = redacted(spark, texts)
    assert got[0] == ("Write to [REDACTED_EMAIL], ring [REDACTED_PHONE] or use [REDACTED_CARD] instead", 3)
    assert got == [plain_redact(t) for t in texts]


@pytest.mark.parametrize("digits", ["620000731894052", "35", "90071992547409", "123456789012345678"])
def test_luhn(spark, digits):
    whole = with_check_digit(digits)
    wrong = whole[:-1] + str((int(whole[-1]) + 1) % 10)
    got = spark.range(1).select(redaction.luhn_valid(F.lit(whole)), redaction.luhn_valid(F.lit(wrong))).first()
    assert tuple(got) == (True, False)


def test_random_texts(spark):
    rng = random.Random(5)
    bits = ["4111111111111111", "4111-1111-1111-1111", "5500 0000 0000 0004", "403-555-0199", "+14035550199", "x@y.org",
            "a.b%c@d-e.co.uk", "@", " ", "1", "12", "-", "(403) 555.0199", "é", "_", ".", "word", "@@", "é@ü.com"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    assert redacted(spark, texts) == [plain_redact(t) for t in texts]


def test_whole_documents(spark, sf):
    texts = pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()
    assert redacted(spark, texts) == [plain_redact(t) for t in texts]


def test_multi_part_messages(spark):
    df = spark.createDataFrame([(1, [("text", "mail a@b.com"), ("image", "a@b.com"), ("text", "403-555-0199")])],
                               "conv_id int, content array<struct<type:string,text:string>>")
    parts = redaction.redact_conversations(redaction.flatten_parts(df, "content"), "content")
    assert sorted(r["content"] for r in parts.collect()) == ["[REDACTED_PHONE]", "mail [REDACTED_EMAIL]"]
    assert redaction.conversation_totals(parts).first()["redactions"] == 2


def test_role_views(spark, sf):
    facts = fct(spark, sf)
    people = enforce(spark.createDataFrame([], schemas.STG_CUSTOMERS), schemas.STG_CUSTOMERS)
    analyst, ops = gov.ROLES["analyst"], gov.ROLES["fraud_ops"]
    assert set(facts.columns) - set(gov.role_view(facts, analyst, "marts").columns) == {"customer_email_hash"}
    assert gov.role_view(people, analyst, "staging") is None
    assert "email" in gov.role_view(people, ops, "staging").columns
    secret = people.select("email")
    assert gov.role_view(secret, analyst, "marts") is None
    made = gov.create_role_views({"fct": ("marts", facts), "customers": ("staging", people)})
    assert made == {"analyst": ["fct"], "fraud_ops": ["fct", "customers"]}
    assert "customer_email_hash" not in spark.table("role_analyst_fct").columns


def test_flows_masked_leaking_and_cyclic(spark):
    edges = gov.edge_table(spark, [
        ("stg.email", "int.email", False), ("int.email", "fct.email_hash", True), ("stg.name", "int.name", False),
        ("stg.contact", "mid.contact", False), ("mid.contact", "mart.contact", False), ("mid.contact", "loop", False),
        ("loop", "mid.contact", False), ("mid.contact", "safe", True), ("safe", "mart.contact", False),
        ("stg.email", "stg.contact", False)])
    one = "column_name string"
    pii = spark.createDataFrame([("stg.email",), ("stg.name",), ("stg.contact",)], one)
    published = spark.createDataFrame([("fct.email_hash",), ("mart.contact",)], one)
    flows = gov.pii_flows(edges, pii, published)
    assert {tuple(r) for r in flows.collect()} == {
        ("stg.email", "fct.email_hash", True), ("stg.contact", "mart.contact", False)}
    assert [r[1] for r in gov.leaks(flows).collect()] == ["mart.contact"]
    assert [r[0] for r in gov.contained(pii, flows).collect()] == ["stg.name"]


BITS = ["4111111111111111", "4111 1111 1111 1111", "5500 0000 0000 0004", "403-555-0199", "+1 (403) 555 0199", "x@y.org", "@", " ", "-", "(", "++",
        "1", "123", "é", "_", "word", "²", "½", "Ⅷ", "́", "‿", "‍", "٤" * 16, "٤" * 10, "\U0001d7d2" * 16,
        "\U0001d7d2" * 10, "[REDACTED_CARD]", "\x00", "\x01", "\x02", "\x03", "\n", "\\1", "$1", "\U0001f600"]


def test_texts_of_any_script_and_their_sql(spark, tmp_path):
    import duckdb

    from tillwork import registry

    rng = random.Random(7)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(14))) for _ in range(1500)]
    want = [*((i, *plain_redact(t)) for i, t in enumerate(texts)), (len(texts), None, None)]
    spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["redact_text"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert con.execute(registry.oracles()["redact_text"] + " order by doc_id").fetchall() == want
